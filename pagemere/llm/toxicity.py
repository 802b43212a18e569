"""Toxicity: a lexicon trie met by Levenshtein automata, and context windows around what they catch.

The lexicon is learned from labelled rows: words and word beginnings (``stem*``) that stand in toxic documents
at least ``lift`` times as often as in others, with a gain in likelihood that chance does not reach; a few common
insults are always in.  A document's word is an exact hit if it is a term or begins with a stem.  Otherwise digits
and signs that stand for letters are read as those and runs of three or more letters as one, and the word is a
misspelled hit if that gives a term or a stem's word, or if a Levenshtein automaton of it, walked along the trie of
all learned words, accepts a term: one edit (a letter put in, left out or replaced, or two swapped) from five letters
on; for terms of four letters too if the first stays and none is left out; from nine letters on two edits that leave
a third of the term whole.  Words that stand in documents of the sample that aren't toxic at least twice, or more
often than in toxic ones, are ordinary and no misspellings.

Each hit has a context window of ``WINDOW`` words: a hit whose nearest mark on its left opens a quotation and whose
nearest mark on its right closes one, or that follows a word of reporting, counts as quoted, else as abuse.  A mark's
side follows from the letters and blanks around it; an apostrophe is no mark.  A logistic model over the four counts
gives the score; its weights are drawn towards a prior that rates quoted hits lower, so a label set without
quotations does no harm.

At most ``bound`` labelled ids are learned from, held-out ones left aside; every document is scored over its
whole text, and nothing but the text enters.  Defined results: null and empty texts get the score of no hits; words
and texts may have any length; without labels, or without rows, the common insults and the prior alone decide;
repeated rows get equal scores; terms whose evidence is equal (ties) are all taken; columns other than doc_id and
text are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, only
from .labelled import held_out, training_rows
from .minhash import coefficients, signature

BOUND = 12_000
LIFT = 20.0
#: Least log-likelihood gain of a term: some e**16 words and stems are tried on a large sample.
EVIDENCE = 16.0
STEMS = (4, 5, 6, 7)
#: Common insults, words of reporting, quotation marks, signs read as letters.
COMMON = ("idiot", "moron", "imbecile", "stupid", "bastard", "scumbag")
REPORTING = frozenset("said says called calls wrote writes word words term quote quoted slur insult dit appelé mot sagte nannte wort dijo llamó palabra".split())
_MARK = re.compile("[\"“”«»„‘’‚]")
_RUN = re.compile(r"(.)\1{2,}")
_LEET = str.maketrans("013457@$", "oleastas")
_WORD = re.compile(r"[\w@$]+")
_KEPT = 200_000
WINDOW = 6
BANDS, BAND_ROWS = 16, 8
#: Prior: bias, then log(1 + hits) of exact abuse, misspelled abuse, exact quoted, misspelled quoted.
PRIOR = np.array([-3.0, 4.0, 1.5, 1.0, 0.4])


class Automaton:
    """The words within ``n`` edits of ``word``; with ``swaps``, two neighbours in the wrong order are one edit.

    A state holds (position, edits); a position -i-1 is within a swap: letter i + 1 was read, letter i must follow.
    """

    def __init__(self, word: str, n: int, swaps: bool = False):
        self.word, self.n, self.swaps = word, n, swaps

    def start(self) -> tuple[tuple[int, int], ...]:
        return tuple((i, i) for i in range(min(self.n, len(self.word)) + 1))

    def step(self, state: tuple[tuple[int, int], ...], c: str) -> tuple[tuple[int, int], ...]:
        word, n = self.word, self.n
        out: dict[int, int] = {}

        def put(i: int, e: int) -> None:
            if e <= n and e < out.get(i, n + 1):
                out[i] = e

        for i, e in state:
            if i < 0:
                if c == word[-i - 1]:
                    put(1 - i, e)
                continue
            put(i, e + 1)  # c is inserted
            if i < len(word):
                put(i + 1, e + (word[i] != c))
                if self.swaps and i + 1 < len(word) and word[i + 1] == c:
                    put(-i - 1, e + 1)
        for i in sorted(i for i in out if i >= 0):  # letters of the word are left out
            for d in range(1, min(n - out[i], len(word) - i) + 1):
                put(i + d, out[i] + d)
        return tuple(sorted(out.items()))

    def distance(self, state: tuple[tuple[int, int], ...]) -> int:
        """Edits of what was read; above ``n`` where it isn't within reach."""
        return min((len(self.word) - i + e for i, e in state if i >= 0), default=self.n + 1)

    def accepts(self, state: tuple[tuple[int, int], ...]) -> bool:
        return self.distance(state) <= self.n


class Lexicon:
    def __init__(self, terms: list[str], ordinary: Iterable[str] = ()):
        self.words = frozenset(t for t in terms if not t.endswith("*"))
        self.stems = frozenset(t[:-1] for t in terms if t.endswith("*"))
        self.stem_sizes = tuple(sorted({len(s) for s in self.stems}))
        self.ordinary = frozenset(ordinary)
        self.trie: dict = {}
        self.cut: set[str] = set()  # terms, and terms without one letter
        self.thirds: dict[int, dict[str, list[tuple[int, int]]]] = {}  # by size: place in the term and its length
        for w in self.words:
            n = len(w)
            if n < 4:
                continue
            node = self.trie
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w
            self.cut.add(w)
            self.cut.update(w[:i] + w[i + 1 :] for i in range(n))
            if n >= 9:
                for a, b in ((0, n // 3), (n // 3, 2 * n // 3), (2 * n // 3, n)):
                    self.thirds.setdefault(b - a, {}).setdefault(w[a:b], []).append((a, n))
        self.longest = max((len(w) for w in self.words), default=0)
        self.kept: dict[str, int] = {}

    def near(self, word: str) -> bool:
        """Whether a term lies within its number of edits."""
        if not 4 <= len(word) <= self.longest + 2:
            return False
        edits = 2 if self._third(word) else 1 if self._one_cut(word) else 0
        if not edits:
            return False
        found = Automaton(word, edits, swaps=True)
        todo = [(self.trie, found.start())]
        while todo:
            node, state = todo.pop()
            if (term := node.get("")) and found.distance(state) <= (1 if len(term) < 9 else 2) and (len(term) > 4 or word[0] == term[0]):
                return True
            for c, child in node.items():
                if c and (after := found.step(state, c)):
                    todo.append((child, after))
        return False

    def _one_cut(self, w: str) -> bool:
        """Words one edit apart are equal once each lacks a letter or none."""
        cut = self.cut
        return w in cut or any(w[:i] + w[i + 1 :] in cut for i in range(len(w)))

    def _third(self, w: str) -> bool:
        """Whether a third of a long term stands in the word, moved by no more than two letters, as two edits leave it."""
        n = len(w)
        if n >= 7:
            for size, of in self.thirds.items():
                for i in range(n - size + 1):
                    if (spots := of.get(w[i : i + size])) and any(abs(i - at) <= 2 and abs(n - m) <= 2 for at, m in spots):
                        return True
        return False

    def _known(self, w: str) -> bool:
        return w in self.words or any(w[:n] in self.stems for n in self.stem_sizes if len(w) > n)

    def kind(self, w: str) -> int:
        """0: none, 1: exact, 2: misspelled."""
        k = 0
        if self._known(w):
            k = 1
        elif len(w) >= 4 and w not in self.ordinary:
            plain = w.translate(_LEET)
            forms = {plain, _RUN.sub(r"\1", plain)}
            if any(f != w and self._known(f) or self.near(f) for f in forms):
                k = 2
        if len(self.kept) >= _KEPT:
            self.kept.clear()
        self.kept[w] = k
        return k

    def hits(self, text: str | None) -> np.ndarray:
        """Counts: exact abuse, misspelled abuse, exact quoted, misspelled quoted."""
        out = np.zeros(4)
        low = (text or "").lower()
        words = _WORD.findall(low)
        kept = self.kept
        kinds = [kept[w] if w in kept else self.kind(w) for w in words]
        if any(kinds):
            spans = [m.span() for m in _WORD.finditer(low)]
            at, sides = marks(low)
            for i, k in enumerate(kinds):
                if k:
                    left = spans[i - WINDOW - 1][1] if i > WINDOW else 0
                    right = spans[i + WINDOW + 1][0] if i + WINDOW + 1 < len(spans) else len(low)
                    n = bisect_left(at, spans[i][0])  # marks before the hit
                    marked = 0 < n < len(at) and at[n - 1] >= left and at[n] < right and sides[n - 1 : n + 1] == [1, -1]
                    reported = not REPORTING.isdisjoint(words[max(0, i - WINDOW) : i])
                    out[k - 1 + 2 * (marked or reported)] += 1
        return out


def marks(text: str) -> tuple[list[int], list[int]]:
    """Places of quotation marks, and 1 for each that opens, -1 for each that closes."""
    at, sides, single = [], [], False
    for m in _MARK.finditer(text):
        i, c = m.start(), m[0]
        before, after = text[i - 1 : i] or " ", text[i + 1 : i + 2] or " "
        free = (before.isspace() or before in "([{-–—", not (after.isalnum() or after in "¿¡_"))
        if c in "‘‚":
            side, single = 1, True
        elif c == "’":  # an apostrophe unless it closes what a mark of its kind opened
            if not single or after.isalnum():
                continue
            side, single = -1, False
        elif free == (True, False):
            side = 1
        elif free == (False, True):
            side = -1
        else:
            side = 1 if c in "“„«" else -1 if c in "”»" else -1 if sides and sides[-1] == 1 else 1
        at.append(i)
        sides.append(side)
    return at, sides


@lru_cache(maxsize=3)
def _lexicon(terms: tuple[str, ...], ordinary: tuple[str, ...]) -> Lexicon:
    """Kept from task to task, with the words it has seen."""
    return Lexicon(list(terms), ordinary)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of ``BANDS`` bands of a text's minima over its words: near copies share one."""
    a, b = coefficients(BANDS * BAND_ROWS)
    for batch in batches:
        out = []
        for text in batch.column(2):
            words = {w.encode() for w in _WORD.findall((text.as_py() or "").lower())}
            sig = signature(np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64), a, b).reshape(BANDS, BAND_ROWS)
            out.append(b"".join(xxhash.xxh64_digest(r.tobytes() + bytes([n])) for n, r in enumerate(sig)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "y", "bands"])


def one_of_each_family(rows: DataFrame) -> list[int]:
    """Of near copies with one label the least id; ``rows`` are bounded, so their bands fit the driver."""
    got = rows.select("doc_id", "y", "text").mapInArrow(_bands, "doc_id bigint, y int, bands binary").toArrow().sort_by("doc_id")
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    first: dict[bytes, int] = {}
    for i, bands in zip(got["doc_id"].to_pylist(), got["bands"].to_pylist(), strict=True):
        for at in range(0, len(bands), 8):
            root[top(i)] = top(first.setdefault(bands[at : at + 8], i))
    kept: dict[tuple[int, int], int] = {}
    for i, y in zip(got["doc_id"].to_pylist(), got["y"].to_pylist(), strict=True):
        kept.setdefault((top(i), y), i)
    return sorted(kept.values())


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic documents, other documents) of a batch; the empty term counts documents."""
    for b in batches:
        got: tuple[Counter, Counter] = (Counter(), Counter())
        for y, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            words = set(_WORD.findall((text.as_py() or "").lower()))
            got[y == 1].update(words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n} | {""})
        terms = list(got[0].keys() | got[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array([got[1][t] for t in terms]), pa.array([got[0][t] for t in terms])], ["term", "toxic", "other"])


def is_ordinary(toxic, other):
    """Of counts of documents with a word, by label; numbers or columns."""
    return (other >= 2) | (other > toxic)


def _near_terms(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    lexicon = Lexicon(shared.value)
    for b in batches:
        yield b.filter(pa.array([lexicon.kind(w) == 2 for w in b.column(0).to_pylist()], pa.bool_()))


def learn_lexicon(rows: DataFrame, tables: Tables, lift: float = LIFT) -> tuple[list[str], list[tuple[str, int, int]]]:
    """Terms, and the words near them that may be ordinary, with the toxic and the other documents that have them."""
    spark = rows.sparkSession
    # of near copies one counts, or the words of a copied document would look toxic
    ids = spark.createDataFrame([(i,) for i in one_of_each_family(rows)], "doc_id bigint")
    rows = rows.join(F.broadcast(ids), "doc_id")
    counts = tables.write(rows.select("y", "text").mapInArrow(_terms, "term string, toxic bigint, other bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")), "terms")
    whole = counts.filter("term = ''").first()
    n1, n0 = (whole[1], whole[2]) if whole else (0, 0)
    found: dict[str, int] = {}
    if n1 and n0:
        ratio = (F.col("toxic") / n1) / ((F.col("other") + 0.5) / n0)
        good = (F.col("toxic") >= max(3, round(0.01 * n1))) & (ratio >= lift) & (F.col("toxic") * F.log(ratio) >= EVIDENCE) & (F.length("term") >= 3)
        found = {r[0]: r[1] for r in counts.filter(good).select("term", "toxic").collect()}  # bounded by the bounded sample
    terms = _shortest(found)
    shared = spark.sparkContext.broadcast(terms)
    clean = counts.filter(~F.col("term").endswith("*") & (F.length("term") >= 4) & is_ordinary(F.col("toxic"), F.col("other")))
    near = clean.select("term", "toxic", "other").mapInArrow(lambda it: _near_terms(it, shared), "term string, toxic bigint, other bigint").collect()  # as above
    tables.drop(counts)
    return terms, sorted((r[0], r[1], r[2]) for r in near)


def _shortest(found: dict[str, int]) -> list[str]:
    """All words, for the trie, and stems that no shorter one covers; a stem that is nearly always one word gives way to that word."""
    whole = [w for w in found if not w.endswith("*")]
    terms = {*COMMON, *whole}
    for t in sorted(found, key=lambda t: (len(t.rstrip("*")), not t.endswith("*"), t)):
        if any(t[:n] + "*" in terms for n in STEMS if len(t.rstrip("*")) > n):
            continue
        if t.endswith("*") and any(w.startswith(t[:-1]) and found[w] >= 0.9 * found[t] for w in whole):
            continue
        terms.add(t)
    return sorted(terms)


def _counts(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Counts of the sample's rows, with words ordinary by the other rows only, as they are for unseen texts."""
    terms, seen = shared.value
    of = [_lexicon(terms, tuple(w for w, toxic, other in seen if is_ordinary(toxic - y, other - 1 + y))) for y in (0, 1)]
    for b in batches:
        hits = [of[y == 1].hits(t.as_py()) for y, t in zip(b.column(0).to_pylist(), b.column(1), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h.tolist() for h in hits], pa.list_(pa.float64()))], ["y", "hits"])


def fit(hits: np.ndarray, y: np.ndarray, strength: float = 2.0) -> np.ndarray:
    """Logistic regression drawn towards PRIOR; no kind of hit speaks against toxicity, so a weight below 0 is left out."""
    used = np.ones(5, bool)
    while True:
        w = _newton(np.concatenate((np.ones((len(y), 1)), np.log1p(hits)), axis=1) * used, y, PRIOR * used, strength)
        if not (w[1:] < 0).any():
            return w
        used[1:] &= w[1:] >= 0


def _newton(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float) -> np.ndarray:
    """Newton steps that never raise the loss."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + strength / 2 * ((w - prior) ** 2).sum())

    w = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + strength * (w - prior)
        h = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step, size, now = np.linalg.solve(h, g), 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
    return w


class Model:
    def __init__(self, terms: tuple[str, ...], ordinary: tuple[str, ...], weights: np.ndarray):
        self.terms, self.ordinary, self.weights = terms, ordinary, weights


def train(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> Model:
    spark = docs.sparkSession
    tables = Tables(spark, "toxic")
    rows = training_rows(docs, labels, F.col("toxic"), bound, tables)
    terms, seen = learn_lexicon(rows, tables)
    shared = spark.sparkContext.broadcast((tuple(terms), seen))
    got = rows.select("y", "text").mapInArrow(lambda it: _counts(it, shared), "y int, hits array<double>").toArrow()
    tables.drop(rows)
    y = np.array(got["y"].to_pylist(), np.float64).reshape(-1)
    hits = np.array(got["hits"].to_pylist(), np.float64).reshape(-1, 4)
    order = np.lexsort((y, *hits.T))  # sums don't hang on the order of arrival
    return Model(tuple(terms), tuple(w for w, toxic, other in seen if is_ordinary(toxic, other)), fit(hits[order], y[order]) if len(y) else PRIOR)


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    lexicon = _lexicon(model.terms, model.ordinary)
    only(lexicon.kept)
    for b in batches:
        hits = np.array([lexicon.hits(t.as_py()) for t in b.column(1)]).reshape(-1, 4)
        s = 1 / (1 + np.exp(-np.clip(model.weights[0] + np.log1p(hits) @ model.weights[1:], -30, 30)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), *(pa.array(h.astype(np.int64)) for h in hits.T)], ["doc_id", "score", "exact_abuse", "near_abuse", "exact_quoted", "near_quoted"])


def score(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted and the four counts."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, bound))
    got = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = got.mapInArrow(lambda it: _score(it, model), "doc_id bigint, score double, exact_abuse bigint, near_abuse bigint, exact_quoted bigint, near_quoted bigint")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "exact_abuse", "near_abuse", "exact_quoted", "near_quoted")


def scorer(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> Callable[[Column], Column]:
    """Learns from ``docs``; gives the score of a column of texts as a column, so no name is taken."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, bound))

    @F.pandas_udf("double")
    def tox(texts):
        import pandas as pd

        batch = pa.RecordBatch.from_arrays([pa.nulls(len(texts), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
        return pd.Series(next(_score(iter([batch]), model)).column(1).to_numpy())

    return lambda text: tox(text.cast("string"))

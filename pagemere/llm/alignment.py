"""Alignment of two tokenizers' tokens over the bytes of a text, with corpus-wide counts of linked ids.

Both tokenizers encode the same bytes (a blank and the text).  Every byte gets the index of the token of A and of
the token of B that own it (``np.repeat``): each run of one pair of owners is an overlap, a link, and a place where
both owners change at once is a cut between groups.  Two passes: the first encodes and aligns every text, writes ids
and the number of documents of each linked pair of ids (a sum a chunk of some MB of text, so what is shuffled is
the chunks' pairs, not the links); the second looks its links up in the corpus-wide counts.

The table of pairs is bounded by the two vocabularies, not by the corpus, but the bound is large; so it is broadcast
only if its measured size allows it.  Beyond that each chunk of documents is joined with the pairs of its own.

Defined results: a null or empty text, and one that a tokenizer doesn't give back byte for byte, has no tokens: zeros
and an empty string; very long texts are aligned in windows that end at cuts; equal texts have equal rows; repeated
rows, also of one id, count as documents of their own; columns other than doc_id and text are not read, so clashing
names do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Tables, only

#: Words whose ids a Python worker remembers for each tokenizer, and as many that it saw before; some 200 bytes each.
KEPT = 250_000
#: Bytes of text that are aligned at once, and of a chunk, whose pairs are summed.
SPAN, CHUNK = 1 << 20, 16 << 20

#: The Latin-1 letters, numbers and blanks, as the classes of the byte-level pattern have them.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
#: Fixed value: the pattern that cuts a text before the merges of a byte-level file, for Latin-1 text.
_BYTE_LEVEL = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_WORD = re.compile(" +[^ ]*|[^ ]+")


class Encoder:
    """Ids of a blank and a text; ``spelled[i]`` are the bytes of id ``i``.

    Pieces that the tokenizer encodes apart are remembered; a piece whose bytes don't come back is remembered as such.
    """

    spelled: list[bytes]

    def __init__(self):
        self.kind = np.dtype("<u2" if len(self.spelled) <= 1 << 16 else "<u4")
        self.lengths = np.array([len(x) for x in self.spelled], np.int64)
        #: words seen lately, and those seen before ``kept`` was last full
        self.kept: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}

    def cut(self, text: str) -> list[str] | None:
        """Pieces of a blank and the text; none if only the tokenizer knows them."""
        raise NotImplementedError

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """Ids of strings that each begin where a text (after the blank) or a piece does."""
        raise NotImplementedError

    def _checked(self, pieces: list[str]) -> list[bytes | None]:
        """Ids of each piece; none where they don't spell it.  All are compared at once, one by one only if some differ."""
        ids = self.encode(pieces)
        flat = np.array([i for x in ids for i in x], np.int64)
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        stops = np.cumsum([len(x) for x in ids])
        written = np.concatenate(([0], np.cumsum(self.lengths[flat])))[stops]
        spelled = [self.spelled[i] for i in flat.tolist()]
        out, at, alike = flat.astype(self.kind).tobytes(), 0, b"".join(spelled) == b"".join(raw) and np.array_equal(written, np.cumsum([len(x) for x in raw]))
        found: list[bytes | None] = []
        for stop, r in zip(stops.tolist(), raw, strict=True):
            found.append(out[at * self.kind.itemsize : stop * self.kind.itemsize] if alike or b"".join(spelled[at:stop]) == r else None)
            at = stop
        return found

    def _learn(self, used: set[str]) -> None:
        new = used.difference(self.kept)
        if len(self.kept) + len(new) > KEPT:
            self.old.clear()
            self.old.update(self.kept)
            self.kept.clear()
            new = used
        known = [w for w in new if w in self.old]
        self.kept.update(zip(known, map(self.old.__getitem__, known), strict=True))
        if new := list(new.difference(known)):
            self.kept.update(zip(new, self._checked(new), strict=True))

    def __call__(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of a blank and each text; none for a text that they don't spell."""
        cuts = [self.cut(t) for t in texts]
        self._learn(set().union(*(c for c in cuts if c is not None)))
        out = []
        for text, pieces in zip(texts, cuts, strict=True):
            try:
                raw = self._checked([" " + text])[0] if pieces is None else b"".join(map(self.kept.__getitem__, pieces))
            except TypeError:
                raw = None
            out.append(None if raw is None else np.frombuffer(raw, self.kind))
        return out


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class ByteLevel(Encoder):
    """A byte-level BPE file in the ``tokenizers`` format; strings of special tokens are plain text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        # printable Latin-1 characters stand for their own byte, the other bytes for characters from 256 on, in order
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(sorted(set(range(256)) - set(own)))}
        self.spelled = [b""] * (max(self.t.get_vocab(with_added_tokens=True).values()) + 1)
        for token, i in vocab.items():
            self.spelled[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        super().__init__()

    def cut(self, text: str) -> list[str] | None:
        return _BYTE_LEVEL.findall(" " + text) if _latin(text) else None

    def encode(self, pieces: list[str]) -> list[list[int]]:
        return [x.ids for x in self.t.encode_batch_fast(pieces, add_special_tokens=False)]


class Pieces(Encoder):
    """A sentencepiece model that puts a blank before a text; no piece has a blank after another character."""

    def __init__(self, path: str):
        import sentencepiece

        self.t = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.t.id_to_piece(i) for i in range(self.t.get_piece_size())]
        self.apart = not any(re.search("[^▁]▁", x) for x in names)
        self.spelled = [bytes([int(x[3:5], 16)]) if self.t.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        super().__init__()

    def cut(self, text: str) -> list[str] | None:
        return _WORD.findall(" " + text) if self.apart and _latin(text) else None

    def encode(self, pieces: list[str]) -> list[list[int]]:
        lone = [self.t.piece_to_id("▁")]  # an empty text gets no blank
        return [x if p != " " else lone for p, x in zip(pieces, self.t.encode([x[1:] for x in pieces], num_threads=1), strict=True)]


@cache
def encoder(path: str) -> Encoder:
    return (ByteLevel if path.endswith(".json") else Pieces)(path)


def _owners(la: np.ndarray, lb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A's, B's token of each link; the group of each token of A, of B) for tokens of these lengths over the same bytes."""
    a, b = np.repeat(np.arange(len(la), dtype=np.int32), la), np.repeat(np.arange(len(lb), dtype=np.int32), lb)
    new_a, new_b = np.ones(len(a), bool), np.ones(len(b), bool)
    np.not_equal(a[1:], a[:-1], out=new_a[1:])
    np.not_equal(b[1:], b[:-1], out=new_b[1:])
    at = np.flatnonzero(new_a | new_b)
    group = np.cumsum(new_a & new_b, dtype=np.int64) - 1
    return a[at].astype(np.int64), b[at].astype(np.int64), group[new_a], group[new_b]


def align(la: np.ndarray, lb: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``_owners``, in windows of about ``span`` bytes that end where tokens of both end."""
    total = int(la.sum())
    if not total:
        return (np.zeros(0, np.int64),) * 4
    if total <= 2 * span:
        return _owners(la, lb)
    ends_a, ends_b = np.cumsum(la), np.cumsum(lb)
    both = ends_a[ends_b[np.minimum(np.searchsorted(ends_b, ends_a), len(ends_b) - 1)] == ends_a]
    stops = np.unique(both[np.minimum(np.searchsorted(both, np.arange(span, total + span, span)), len(both) - 1)])
    sa, sb = np.searchsorted(ends_a, stops) + 1, np.searchsorted(ends_b, stops) + 1
    parts, i, j, g = [], 0, 0, 0
    for x, y in zip(sa.tolist(), sb.tolist(), strict=True):
        p, q, ga, gb = _owners(la[i:x], lb[j:y])
        parts.append((p + i, q + j, ga + g, gb + g))
        i, j, g = x, y, g + int(ga[-1]) + 1
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class Aligner:
    """Alignment of several documents at once: where a document begins, tokens of both begin."""

    def __init__(self, a: str, b: str):
        self.a, self.b = encoder(a), encoder(b)
        self.base = len(self.b.spelled)
        #: one document's codes of pairs end where the next one's begin
        self.codes = len(self.a.spelled) * self.base
        self._names: list[str] | None = None

    def links(self, ids_a: list[np.ndarray], ids_b: list[np.ndarray]):
        """(A's ids, B's ids, of each token of A its document, links, groups): links are pairs of token indices."""
        a, b = np.concatenate(ids_a).astype(np.int64), np.concatenate(ids_b).astype(np.int64)
        doc = np.repeat(np.arange(len(ids_a)), [len(x) for x in ids_a])
        la, lb, ga, gb = align(self.a.lengths[a], self.b.lengths[b])
        return a, b, doc, la, lb, ga, gb

    def per_document(self, a, b, doc, la, lb) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, code of the pair of ids, its links there), each once, in order."""
        key, n = np.unique(doc[la] * self.codes + a[la] * self.base + b[lb], return_counts=True)
        return key // self.codes, key % self.codes, n

    def written(self, ids_a, ids_b, a, b, ga, gb) -> list[str]:
        """Digest of each document's groups: A's ids, a bar, B's ids; groups parted by semicolons."""
        if self._names is None:
            most = max(len(self.a.spelled), self.base)
            self._names = [f"{i}{end}" for end in ",|;" for i in range(most)]
        most, names = len(self._names) // 3, self._names
        out = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.append(ga[1:] != ga[:-1], True), np.append(gb[1:] != gb[:-1], True)
        out[np.arange(len(a)) + np.searchsorted(gb, ga, "left")] = a + most * last_a
        out[np.arange(len(b)) + np.searchsorted(ga, gb, "right")] = b + 2 * most * last_b
        digests, at = [], 0
        for x, y in zip(ids_a, ids_b, strict=True):
            sha, stop = hashlib.sha256(), at + len(x) + len(y)
            for i in range(at, stop, 1 << 18):
                text = "".join(map(names.__getitem__, out[i : min(stop, i + (1 << 18))].tolist()))
                sha.update((text[:-1] if i + (1 << 18) >= stop else text).encode())
            digests.append(sha.hexdigest())
            at = stop
        return digests


@cache
def aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


_FIRST = "chunk bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, a binary, b binary, pairs binary, counts binary"
_FIRST_ARROW = pa.schema([*((n, pa.int64()) for n in ("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), *((n, pa.binary()) for n in ("a", "b", "pairs", "counts"))])


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pairs, where = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    return pairs, np.bincount(where, np.concatenate([n for _, n in parts]), len(pairs)).astype(np.int64)


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[list[int | None], list[str | None]]]:
    """Ids and texts of documents, as many at once as make about ``SPAN`` characters."""
    ids, texts, size = [], [], 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        ids.append(doc_id)
        texts.append(text.as_py())
        size += len(texts[-1] or "")
        if size >= SPAN:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _first(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    """A row a document with its ids, and a row a chunk with its pairs and their numbers of documents."""
    by = aligner(path_a, path_b)
    only(by.a.kept, by.a.old, by.b.kept, by.b.old)
    task = TaskContext.get().partitionId() << 32
    chunk, size, parts, held = task, 0, [], 0

    def some(rows: list[tuple]) -> tuple[list[dict], int]:
        """Rows of documents with tokens, and bytes."""
        nonlocal parts, held
        ids_a, ids_b = [r[1] for r in rows], [r[2] for r in rows]
        a, b, doc, la, lb, ga, gb = by.links(ids_a, ids_b)
        at, pairs, _ = by.per_document(a, b, doc, la, lb)
        parts.append(np.unique(pairs, return_counts=True))
        held += len(parts[-1][0])
        if held > 1 << 21:
            parts = [_summed(parts)]
            held = len(parts[0][0])
        n = np.bincount(doc[la], minlength=len(rows))
        groups = np.bincount(doc[np.append(True, ga[1:] != ga[:-1])], minlength=len(rows))
        digests = by.written(ids_a, ids_b, a, b, ga, gb)
        return [
            {"chunk": chunk, "doc_id": r[0], "n_a": len(r[1]), "n_b": len(r[2]), "n_groups": int(g), "n_links": int(k), "groups_sha256": d, "a": r[1].tobytes(), "b": r[2].tobytes()}
            for r, g, k, d in zip(rows, groups, n, digests, strict=True)
        ], int(by.a.lengths[a].sum())

    def summed() -> dict:
        pairs, n = _summed(parts)
        return {"chunk": chunk, "pairs": pairs.tobytes(), "counts": n.tobytes()}

    for batch in batches:
        rows: list[dict] = []
        for ids, texts in _groups(batch):
            full = [i for i, t in enumerate(texts) if t]
            a, b = by.a([texts[i] for i in full]), by.b([texts[i] for i in full])
            good = {i: (ids[i], x, y) for i, x, y in zip(full, a, b, strict=True) if x is not None and y is not None}
            rows += [{"chunk": chunk, "doc_id": d, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "a": b"", "b": b""} for i, d in enumerate(ids) if i not in good]
            if good:
                more, k = some(list(good.values()))
                rows, size = rows + more, size + k
            if size >= CHUNK:
                rows.append(summed())
                chunk, size, parts, held = chunk + 1, 0, [], 0
        yield pa.RecordBatch.from_pylist(rows, _FIRST_ARROW)
    if parts:
        yield pa.RecordBatch.from_pylist([summed()], _FIRST_ARROW)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, pairs, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            p, n = np.frombuffer(pairs, "<i8"), np.frombuffer(counts, "<i8")
            for i in range(0, len(p), 1 << 16):
                part = p[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunk)), pa.array(part), pa.array(n[i : i + (1 << 16)])], ["chunk", "pair", "n"])


def _looked_up(by: Aligner, ids_a: list[np.ndarray], ids_b: list[np.ndarray], pair: np.ndarray, n: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(links that are best, sum of counts) of each document; the pairs are sorted and hold all that occur."""
    best_sum, n_sum = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_a), np.int64)
    a, b, doc, la, lb, _, _ = by.links(ids_a, ids_b)
    if len(a):
        at, codes, times = by.per_document(a, b, doc, la, lb)
        i = np.searchsorted(pair, codes)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        best_sum[at[first]] = np.add.reduceat(best[i] * times, first)
        n_sum[at[first]] = np.add.reduceat(n[i] * times, first)
    return best_sum, n_sum


_KEPT = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
_RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"


def _rounds(ids_a: list[bytes], ids_b: list[bytes], by: Aligner) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    """Documents in order, as many at once as make about ``SPAN`` bytes."""
    some_a, some_b, size = [], [], 0
    for a, b in zip(ids_a, ids_b, strict=True):
        some_a.append(np.frombuffer(a, by.a.kind))
        some_b.append(np.frombuffer(b, by.b.kind))
        size += 4 * len(some_a[-1])
        if size >= SPAN:
            yield some_a, some_b
            some_a, some_b, size = [], [], 0
    if some_a:
        yield some_a, some_b


def _sums(ids_a: list[bytes], ids_b: list[bytes], by: Aligner, pair, n, best) -> tuple[np.ndarray, np.ndarray]:
    got = [_looked_up(by, x, y, pair, n, best) for x, y in _rounds(ids_a, ids_b, by)] or [(np.zeros(0, np.int64),) * 2]
    return np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])


def _second(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, shared) -> Iterator[pa.RecordBatch]:
    by, (pair, n, best) = aligner(path_a, path_b), shared.value
    for batch in batches:
        best_sum, n_sum = _sums(batch.column("a").to_pylist(), batch.column("b").to_pylist(), by, pair, n, best)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _KEPT), batch.column("groups_sha256"), pa.array(best_sum), pa.array(n_sum)], [*_KEPT, "groups_sha256", "n_best", "count_sum"])


def linked(docs: DataFrame, path_a: str, path_b: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum.

    ``limit``: bytes of the table of pairs up to which it is broadcast; beyond, chunks are joined with their pairs.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "alignment")
    by = aligner(path_a, path_b)
    got = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = tables.write(got.mapInArrow(lambda it: _first(it, path_a, path_b), _FIRST), "aligned")
    of_chunk = first.filter("pairs IS NOT NULL").select("chunk", "pairs", "counts").mapInArrow(_pairs, "chunk bigint, pair bigint, n bigint")
    counted = of_chunk.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.expr(f"pair div {by.base}"))
    # an id of A has at most as many partners as B has ids, so a window of it is bounded by B's vocabulary
    best = (F.col("n") == F.max("n").over(Window.partitionBy("a"))).cast("bigint")
    pairs = tables.write(counted.select("pair", "n", best.alias("best")), "pairs")
    rows = first.filter("pairs IS NULL").select("chunk", *_KEPT, "groups_sha256", "a", "b")
    if 24 * pairs.count() <= limit:
        t = pairs.orderBy("pair").toArrow()
        shared = spark.sparkContext.broadcast(tuple(t.column(i).to_numpy() for i in range(3)))
        tables.drop(pairs)
        return rows.drop("chunk").mapInArrow(lambda it: _second(it, path_a, path_b, shared), _RESULT)

    def of_one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("pair")
        left["n_best"], left["count_sum"] = _sums(left["a"].tolist(), left["b"].tolist(), aligner(path_a, path_b), *(right[c].to_numpy() for c in ("pair", "n", "best")))
        return left[[*_KEPT, "groups_sha256", "n_best", "count_sum"]]

    known = of_chunk.select("chunk", "pair").join(pairs, "pair")
    return rows.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInPandas(of_one, _RESULT)

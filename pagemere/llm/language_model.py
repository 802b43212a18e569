"""Masked pseudo-likelihood: a bidirectional window network, trained here in numpy, scores documents.

Words are counted over all documents.  An id is three digits (a, b, c) whose base grows with the counted vocabulary,
up to 64 (262,144 ids, what a worker holds).  Words seen often enough have an id of their own, on a small corpus all
of them; the rest share the ids left, by a hash.  The network sees ``REACH`` words on each side of a place, not the
word itself: h = tanh(sum over offsets of d_o * E[word] + c).  It gives P(a | h), P(b | a, h) and P(c | a, b, h), so
every id has a probability and they sum to 1; before training they are the ids' shares of all words.  A word of a
shared id has P(id | h) * count(word) / count(all words of the id), from the full counts, so probabilities are of
words.  A document's score is the sum over its words of log P(word | both sides).

Training is data-parallel over all documents: in each round every partition starts from the shared parameters,
learns from its masked places, and the new parameters are averaged.  The masks of the rounds are disjoint and
cover all: a document's places are numbered off in blocks of ``BLOCK``, and round r takes each block whose number, plus
the doc_id, leaves r when divided by the rounds, so every place is a target once, whatever the batches and partitions,
and a step needs few words that are not targets themselves.  Averages are weighted, for rows that
belong to an id or to leading digits, by how often a partition saw them, else by places.  They are grouped sums in
Spark of the rows that changed, so only one set of parameters comes to the driver whatever the number of partitions.
Counts, places and partitions all grow with the input.  Texts are cut into ids once, in a table that both training
and scoring read.

Defined results: null, empty and wordless texts have 0 tokens, a score of 0 and a null mean; repeated rows get
equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables

BASES = (16, 32, 48, 64)  # multiples of DIM, so that a row of any table is whole blocks of DIM
SHARED = 9  # one id in so many, at least, is for words without their own
BASE = BASES[0]
SIZE = BASE**3
DIM, REACH, ROUNDS = 16, 3, 2
BLOCK = 64  # neighbouring places that are targets of the same round
NEVER = -1e4  # the bias of an id that no word has
OFFSETS = [o for o in range(-REACH, REACH + 1) if o]


def shapes(base: int) -> dict[str, tuple[int, ...]]:
    return {"E": (base**3 + 1, DIM), "d": (2 * REACH, DIM), "c": (DIM,), "A": (DIM, base), "a": (base,), "B": (DIM, base), "b": (base, base), "G": (DIM, base), "g": (base * base, base)}


SHAPES = shapes(BASE)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after the other, as ``str.lower`` and ``str.split`` give them, and how many each text has."""
    lowered = pa.array([(t or "").lower().strip() or None for t in texts.to_pylist()], pa.string())
    got = pc.utf8_split_whitespace(lowered)
    return got.flatten(), pc.list_value_length(got).fill_null(0).to_numpy().astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and how often they occur, summed over some 48 MB of words, about four million."""
    held: list[pa.Array] = []

    def done():
        got = pa.chunked_array(held, pa.string()).value_counts()
        return pa.RecordBatch.from_arrays([got.field("values"), got.field("counts")], ["word", "n"])

    for b in batches:
        held.append(_words(b.column(0))[0])
        if sum(x.nbytes for x in held) > 48 << 20:
            yield done()
            held.clear()
    yield done()


def counted(texts: DataFrame, tables: Tables) -> DataFrame:
    """Every word of all documents and how often it occurs."""
    return tables.write(texts.mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "counts")


def vocabulary(counts: DataFrame, bases: tuple[int, ...] = BASES) -> tuple[int, list[str], list[int]]:
    """The base, the words with ids of their own, the most frequent first (ties by the word), and their counts.

    The base is the least that holds all words, or the largest.  A histogram of counts (some 120 rows) gives the least
    count from which on all words fit; only those words come to the driver, at most 8/9 of the largest base's ids.
    """
    exact = F.when(F.col("n") < 64, F.col("n")).otherwise(F.lit(2).cast("bigint") ** F.floor(F.log2("n")))
    steps = sorted(((int(x), k) for x, k in counts.groupBy(exact.alias("x")).count().collect()), reverse=True)
    distinct = sum(k for _, k in steps)
    base = next((x for x in bases if x**3 - x**3 // SHARED >= distinct), bases[-1])
    room, least = base**3 - base**3 // SHARED, None
    for x, k in steps:
        room -= k
        if room < 0:
            break
        least = x
    got = [] if least is None else sorted(counts.filter(F.col("n") >= least).collect(), key=lambda r: (-r["n"], r["word"]))
    return base, [r["word"] for r in got], [r["n"] for r in got]


def shared_id(word: str, own: int, size: int) -> int:
    return own + zlib.crc32(word.encode()) % (size - own)


def sharing(counts: DataFrame, base: int, n_own: int, own_least: int | None) -> DataFrame:
    """word, n and id of each word without an id of its own; ``shared_id`` in Spark."""
    rest = counts.filter(F.col("n") < own_least) if own_least is not None else counts
    return rest.withColumn("id", F.lit(n_own) + F.crc32(F.col("word").cast("binary")) % F.lit(base**3 - n_own))


def _ids(words: pa.Array, own: pa.Array, size: int) -> np.ndarray:
    """The id of each word: its place in ``own``, else its shared id."""
    ids = pc.index_in(words, value_set=own).fill_null(-1).to_numpy().copy()
    rest = np.flatnonzero(ids < 0)
    coded = words.take(pa.array(rest)).dictionary_encode()
    shared = [shared_id(w, len(own), size) for w in coded.dictionary.to_numpy(zero_copy_only=False)]
    ids[rest] = np.array(shared, np.int32)[coded.indices.to_numpy()]
    return ids


def initial(seed: int = 11, base: int = BASE, counts: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Parameters to start from; counts by id make the biases those of the ids' shares, of ids without words none."""
    rng = np.random.default_rng(seed)
    shape = shapes(base)
    out = {k: np.zeros(s, np.float32) for k, s in shape.items()}
    for k, scale in (("E", 0.3), ("A", 0.1), ("B", 0.1), ("G", 0.1)):
        out[k] = rng.normal(0, scale, shape[k]).astype(np.float32)
    out["d"] += 0.5
    if counts is not None:
        n = counts.reshape(base, base, base).astype(np.float64)
        ab = n.sum(axis=2)

        def log_share(x, of):
            return np.where(x > 0, np.log(np.maximum(x, 1) / np.maximum(of, 1)), NEVER).astype(np.float32)

        out["a"] = log_share(ab.sum(axis=1), n.sum())
        out["b"] = log_share(ab, ab.sum(axis=1, keepdims=True))
        out["g"] = log_share(n, ab[:, :, None]).reshape(base * base, base)
    return out


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def unflat(x: np.ndarray, base: int = BASE) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shapes(base).items():
        n = int(np.prod(s))
        out[k] = x[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def _joint(p) -> np.ndarray:
    """The weights of the three levels beside each other, so that their logits are one product."""
    return np.concatenate((p["A"], p["B"], p["G"]), axis=1)


def _overflows(w: np.ndarray, *biases: np.ndarray) -> bool:
    """Whether exp could overflow where h is anything tanh gives."""
    return np.abs(w).sum(axis=0).max() + max(x.max() for x in biases) > 30


def _exp(z: np.ndarray, lower: bool) -> np.ndarray:
    """z becomes exp(z) and the sums of its rows are given; each row is first lowered by its most where z could overflow."""
    if lower:
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    return z @ np.ones(z.shape[1], np.float32)


def _window(ids: np.ndarray, at: np.ndarray) -> tuple[int, np.ndarray]:
    """The first place of the run of ids around ``at``, and the run."""
    first = int(at.min()) - REACH
    return first, ids[first : int(at.max()) + REACH + 1]


def _shifted(x: np.ndarray, o: int) -> np.ndarray:
    """The columns of x at o from each place but the REACH at either end."""
    return x[:, REACH + o : x.shape[1] - REACH + o]


def _hidden(p, near: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """The hidden layer of the places ``inner`` of a run, from ``near``, the run's embeddings: a column a place, each fetched once."""
    h = np.zeros((DIM, near.shape[1] - 2 * REACH), np.float32)
    part = np.empty_like(h)
    for k, o in enumerate(OFFSETS):
        h += np.multiply(_shifted(near, o), p["d"][k][:, None], out=part)
    h = h.take(inner, axis=1)
    h += p["c"][:, None]
    return np.tanh(h, out=h)


def _digits(ids: np.ndarray, base: int) -> np.ndarray:
    """The three digits of each id."""
    return np.stack((ids // (base * base), ids // base % base, ids % base), axis=1)


def _targets(ids: np.ndarray, base: int) -> np.ndarray:
    """Where the three digits of each id lie in rows of three levels' logits, all laid end to end."""
    return (_digits(ids, base) + np.arange(3 * len(ids)).reshape(-1, 3) * base).ravel()


def log_probabilities(p, ids: np.ndarray, at: np.ndarray, lower: bool | None = None) -> np.ndarray:
    """log P(ids[at] | both sides); ids are padded with REACH pads on either side of each text.

    ``lower`` is ``_overflows`` of the parameters, for callers that ask often.
    """
    if not len(at):
        return np.zeros(0, np.float32)
    base, w = len(p["a"]), _joint(p)
    if lower is None:
        lower = _overflows(w, p["a"], p["b"], p["g"])
    first, run = _window(ids, at)
    h = _hidden(p, np.ascontiguousarray(p["E"].take(run, axis=0).T), at - first - REACH)
    mine = ids[at]
    z = (h.T @ w).reshape(-1, 3, base)
    z[:, 0] += p["a"]
    z[:, 1] += p["b"].take(mine // (base * base), axis=0)
    z[:, 2] += p["g"].take(mine // base, axis=0)
    sums = _exp(z.reshape(-1, base), lower)
    got = z.ravel()[_targets(mine, base)]
    return np.log(np.maximum(got, 1e-30) / sums).reshape(-1, 3) @ np.ones(3, np.float32)


def _heads(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values of a sorted x begin."""
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return np.flatnonzero(new)


def _run_sums(x: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The sum of the rows of each run; the many short runs go row by row together, the few long ones alone."""
    size = np.diff(np.append(heads, len(x)))
    out = x[heads]
    some, n = np.flatnonzero((size > 1) & (size < 6)), 1
    while len(some):
        out[some] += x[heads[some] + n]
        n += 1
        some = some[size[some] > n]
    for i in np.flatnonzero(size >= 6):
        np.add.reduce(x[heads[i] : heads[i] + size[i]], axis=0, out=out[i])
    return out


@functools.lru_cache(maxsize=1)
def _slots(size: int) -> np.ndarray:
    return np.zeros(size, np.int32)


def _distinct(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different ids below size, and which of them each place has; no sorting."""
    slots, nth = _slots(size), np.arange(len(x), dtype=np.int32)
    slots[x] = nth
    last = slots[x]
    mine = np.flatnonzero(last == nth)
    slots[x[mine]] = np.arange(len(mine), dtype=np.int32)
    return x[mine], slots[x]


def _change(p: np.ndarray, square: np.ndarray, which: np.ndarray, was: np.ndarray, x: np.ndarray, rate: float) -> None:
    """The Adagrad step of the different rows ``which`` of a table, which were ``was``; x is used up."""
    now = square.take(which, axis=0)
    now += x * x
    square[which] = now
    now += 1e-6
    x /= np.sqrt(now, out=now)
    x *= rate
    p[which] = np.subtract(was, x, out=x)


def learn(p, square, ids: np.ndarray, at: np.ndarray, rate: float = 0.1) -> None:
    """One Adagrad step on the places ``at``."""
    base, w = len(p["a"]), _joint(p)
    first, run = _window(ids, at)
    at = at[np.argsort((ids[at] // base).astype(np.uint16), kind="stable")]
    inner, mine = at - first - REACH, ids[at]
    words, which = _distinct(run, len(p["E"]))
    had = p["E"].take(words, axis=0)
    near = had.T.take(which, axis=1)
    h = _hidden(p, near, inner)
    rows = np.ascontiguousarray(h.T)
    # places lie by their first two digits, so the biases of a run of equal ones are fetched, and their gradients summed, once
    heads = _heads(mine // base)
    ab = mine[heads] // base
    was = p["g"].take(ab, axis=0)
    bias = np.empty((len(ab), 3, base), np.float32)
    bias[:, 0], bias[:, 1], bias[:, 2] = p["a"], p["b"].take(ab // base, axis=0), was
    bias = bias.reshape(len(ab), -1)
    z = rows @ w
    z += bias.take(np.repeat(np.arange(len(ab)), np.diff(np.append(heads, len(at)))), axis=0)
    level = z.reshape(-1, base)
    level *= (1 / _exp(level, _overflows(w, p["a"], p["b"], was)))[:, None]
    z.ravel()[_targets(mine, base)] -= 1
    dh = z @ w.T
    dh *= 1 - rows * rows
    dw = (z.T @ rows).T
    dz = _run_sums(z[:, base:], heads)
    ones = np.ones(len(at), np.float32)
    dense = {"A": dw[:, :base], "B": dw[:, base : 2 * base], "G": dw[:, 2 * base :], "a": ones @ z[:, :base], "c": ones @ dh}
    # gradients are summed by place of the run first, then by id
    dp = np.zeros((len(run) - 2 * REACH, DIM), np.float32)
    if np.bincount(inner).max() == 1:
        dp[inner] = dh
    else:
        np.add.at(dp, inner, dh)
    dp = np.ascontiguousarray(dp.T)
    de, part = np.zeros_like(near), np.empty_like(dp)
    for k, o in enumerate(OFFSETS):
        into = _shifted(de, o)
        into += np.multiply(dp, p["d"][k][:, None], out=part)
    dense["d"] = np.stack([np.vecdot(dp, _shifted(near, o)) for o in OFFSETS])
    by_word = np.empty((DIM, len(words)), np.float32)
    for k, x in enumerate(de):
        by_word[k] = np.bincount(which, x, len(words))
    starts = _heads(ab // base)
    firsts = ab[starts] // base
    by_first = np.add.reduceat(dz[:, :base], starts, axis=0)
    for k, x in dense.items():
        square[k] += x * x
        p[k] -= rate * x / np.sqrt(square[k] + 1e-6)
    _change(p["E"], square["E"], words, had, np.ascontiguousarray(by_word.T), rate)
    _change(p["b"], square["b"], firsts, p["b"].take(firsts, axis=0), by_first, rate)
    _change(p["g"], square["g"], ab, was, dz[:, base:], rate)


def _together(batches: Iterator[pa.RecordBatch], n_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in batches of n_bytes or a little more."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= n_bytes:
            yield pa.concat_batches(held)
            held.clear()
    if held:
        yield pa.concat_batches(held)


def _encode(batches: Iterator[pa.RecordBatch], words, size: int) -> Iterator[pa.RecordBatch]:
    """Each text's ids as int32 bytes, and its words that share an id."""
    own = pa.array(words.value, pa.string())
    for b in _together(batches):
        got, sizes = _words(b.column(2))
        x = _ids(got, own, size)
        ends = np.append(0, np.cumsum(sizes))
        codes = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(x)])
        sharing = x >= len(own)
        rare = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sharing))[ends], pa.int32()), got.filter(pa.array(sharing)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), codes, rare], ["row", "doc_id", "ids", "rare"])


def _joined(codes: pa.Array, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a batch's texts with pads between, and the number of words of each."""
    pads = np.full(REACH, pad, np.int32)
    out, sizes = [pads], []
    for x in codes:
        got = np.frombuffer(x.as_py(), np.int32)
        sizes.append(len(got))
        out += [got, pads]
    return np.concatenate(out), np.array(sizes, np.int64)


def _blocks(k: str, weight: np.ndarray | float, base: int) -> np.ndarray:
    """A weight for each block of DIM of a table; weights are by row, or one for all."""
    n = int(np.prod(shapes(base)[k])) // DIM
    return np.full(n, weight, np.float64) if np.isscalar(weight) else np.repeat(weight.astype(np.float64), n // len(weight))


SLICES = 1024  # so that an Arrow batch of the changes of many partitions stays small
SENT = "slice int, k binary, w binary, x binary"
_SENT_TYPES = (np.int32, np.float64, np.float32)


def _sent(slices: list[int], parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    columns = (pa.array([x.astype(t).tobytes() for x in xs], pa.binary()) for xs, t in zip(zip(*parts, strict=True), _SENT_TYPES))
    return pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), *columns], ["slice", "k", "w", "x"])


def _sliced(k: np.ndarray, w: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks, their weights and weighted changes by slice, a row each."""
    order = np.argsort((k % SLICES).astype(np.uint16), kind="stable")
    k, w, x = k[order], w[order], x[order]
    ends = np.searchsorted(k % SLICES, np.arange(SLICES + 1))
    some = np.flatnonzero(ends[1:] > ends[:-1]).tolist()
    for i in range(0, len(some), 64):
        yield _sent(some[i : i + 64], [(k[ends[n] : ends[n + 1]], w[ends[n] : ends[n + 1]], x[ends[n] : ends[n + 1]]) for n in some[i : i + 64]])


def _sum(batches: Iterator[pa.RecordBatch], base: int) -> Iterator[pa.RecordBatch]:
    """Sums of the weights and weighted changes of each slice's blocks."""
    n_blocks = sum(int(np.prod(s)) for s in shapes(base).values()) // DIM
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        for i, n in enumerate(b.column(0).to_pylist()):
            k, w, x = (np.frombuffer(b.column(1 + c)[i].as_buffer(), t) for c, t in enumerate(_SENT_TYPES))
            if n not in sums:
                m = -(-(n_blocks - n) // SLICES)
                sums[n] = np.zeros(m), np.zeros((m, DIM))
            sums[n][0][k // SLICES] += w
            sums[n][1][k // SLICES] += x.reshape(-1, DIM)
    for n, (w, x) in sums.items():
        seen = np.flatnonzero(w)
        yield _sent([n], [(n + seen * SLICES, w[seen], x[seen])])


def masked(doc_ids: pa.Array, sizes: np.ndarray, r: int, rounds: int) -> np.ndarray:
    """Places of ``_joined`` ids that round r learns from."""
    begins = np.cumsum(sizes + REACH) - sizes
    which = np.repeat(np.arange(len(sizes)), sizes)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = np.array([(x or 0) % rounds for x in doc_ids.to_pylist()], np.int64)
    mine = (nth // BLOCK + key[which]) % rounds == r
    return (begins[which] + nth)[mine]


def _around(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids within REACH of the places ``at``, in their order, and where the places, in order too, lie among them."""
    near = np.zeros(len(ids), bool)
    for o in range(-REACH, REACH + 1):
        near[at + o] = True
    return ids[near], (np.cumsum(near) - 1)[at]


def _train(batches: Iterator[pa.RecordBatch], params, base: int, r: int, rounds: int) -> Iterator[pa.RecordBatch]:
    """Blocks of DIM parameters that changed: their weight, and weight times the change."""
    p = unflat(params.value, base)
    square = {k: np.full(s, 0.1, np.float32) for k, s in shapes(base).items()}
    pad = base**3
    places, seen, first = 0, np.zeros(pad + 1, np.int64), np.zeros(pad, np.int64)
    for b in batches:
        got, sizes = _joined(b.column(1), pad)
        got, at = _around(got, masked(b.column(0), sizes, r, rounds))
        for i in range(0, len(at), 2048):
            learn(p, square, got, at[i : i + 2048])
        places += len(at)
        near = np.zeros(len(got), np.int64)
        for o in OFFSETS:
            near[at + o] += 1
        seen += np.bincount(got, near, pad + 1).astype(np.int64)
        first += np.bincount(got[at], minlength=pad)
    if places:
        weights = {"E": seen, "b": first.reshape(base, -1).sum(axis=1), "g": first.reshape(base * base, -1).sum(axis=1)}
        w = np.concatenate([_blocks(k, weights.get(k, float(places)), base) for k in SHAPES])
        k = np.flatnonzero(w).astype(np.int32)
        x = ((flat(p) - params.value).reshape(-1, DIM)[k] * w[k, None]).astype(np.float32)
        yield from _sliced(k, w[k], x)


def _score(batches: Iterator[pa.RecordBatch], params, shared, base: int) -> Iterator[pa.RecordBatch]:
    """Sums of log P, where a word of a shared id still lacks the log of its own count."""
    p = unflat(params.value, base)
    pad, lower = base**3, _overflows(_joint(p), p["a"], p["b"], p["g"])
    for b in batches:
        got, sizes = _joined(b.column(2), pad)
        at = np.flatnonzero(got != pad)
        logs = np.concatenate([np.zeros(0)] + [log_probabilities(p, got, at[i : i + 2048], lower) for i in range(0, len(at), 2048)]).astype(np.float64)
        logs -= shared.value[got[at]]
        ends = np.cumsum(sizes)
        total = np.concatenate(([0.0], np.cumsum(logs)))
        sums = total[ends] - total[ends - sizes]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes), pa.array(sums)], ["row", "doc_id", "n_tokens", "by_id"])


def train(docs: DataFrame, rounds: int = ROUNDS, bases: tuple[int, ...] = BASES):
    """The documents as ids, the words that share an id, the base, and broadcast logs of shared ids' counts and parameters."""
    spark = docs.sparkSession
    tables = Tables(spark, "words")
    sc = spark.sparkContext
    counts = counted(docs.select(F.col("text").cast("string").alias("text")), tables)
    base, words, n = vocabulary(counts, bases)
    rest = sharing(counts, base, len(words), n[-1] if n else None)
    by_id = np.zeros(base**3)
    by_id[: len(n)] = n
    got = rest.groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    by_id[got["id"].to_numpy()] = got["n"].to_numpy()
    shared = np.log(np.maximum(by_id, 1))
    shared[: len(n)] = 0
    own, shared = sc.broadcast(words), sc.broadcast(shared)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    encoded = tables.write(rows.mapInArrow(lambda it: _encode(it, own, base**3), "row bigint, doc_id bigint, ids binary, rare array<string>"), "ids")
    params = sc.broadcast(flat(initial(base=base, counts=by_id)))
    for r in range(rounds):
        now = params
        sent = encoded.select("doc_id", "ids").mapInArrow(lambda it, now=now, r=r: _train(it, now, base, r, rounds), SENT)
        summed = tables.write(sent.repartition("slice").mapInArrow(lambda it: _sum(it, base), SENT), "round")
        got = summed.toArrow()
        tables.drop(summed)
        x = now.value.reshape(-1, DIM).copy()
        for part in got.to_pylist():
            k, w = np.frombuffer(part["k"], np.int32), np.frombuffer(part["w"])
            x[k] += np.frombuffer(part["x"], np.float32).reshape(-1, DIM) / w[:, None]
        params = sc.broadcast(x.ravel())
    return encoded, rest, base, shared, params


def score(docs: DataFrame, rounds: int = ROUNDS, bases: tuple[int, ...] = BASES) -> DataFrame:
    """Per document: doc_id, n_tokens, pseudo_log_likelihood, mean_log_probability."""
    encoded, rest, base, shared, params = train(docs, rounds, bases)
    ids = encoded.select("row", "doc_id", "ids").mapInArrow(lambda it: _score(it, params, shared, base), "row bigint, doc_id bigint, n_tokens bigint, by_id double")
    words = encoded.select("row", F.explode("rare").alias("word")).join(rest.select("word", F.log("n").alias("log_n")), "word").groupBy("row").agg(F.sum("log_n").alias("log_n"))
    out = ids.join(words, "row", "left").select("doc_id", "n_tokens", (F.col("by_id") + F.coalesce("log_n", F.lit(0.0))).alias("pseudo_log_likelihood"))
    return out.withColumn("mean_log_probability", F.when(F.col("n_tokens") > 0, F.col("pseudo_log_likelihood") / F.col("n_tokens")))

"""Spelling variant groups: words one edit apart, found by hashed deletions, and the frequent form each word leads to.

Two different words are one edit apart if one becomes the other by a deletion, or if both become one string by a
deletion at the same place.  So every word is dealt out under the hash of each of its deletions, with the place, and
under its own hash.  A deletion's hash is made of the polynomial hashes of the prefix before and the suffix behind the
place, for all words of one length at once.  Keys are dealt out by their upper bits (radix) and sorted; in a run
of equal keys the strings themselves are compared, so a collision of hashes is no link.

Nothing is quadratic: the words that share a deletion at one place differ in one character, so they are at most as
many as the alphabet, and a run gives a count and its two most frequent words, not pairs.  The words of a corpus are
counted before they are shuffled.

Defined results: null and empty texts have no words; a null doc_id damages no word; texts of any length are read
whole; repeated rows count again; equal counts (ties) are decided by code-point order; columns other than doc_id and
text are not read, so clashing names do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables

#: A word's characters, and one run in so many whose checksum deletes a character.
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
DAMAGED = 199
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Distinct runs that a task counts before it sends them on.
HELD = 200_000
#: Words, each with a key a character, in a partition of keys at most.
WORDS = 200_000
#: Deletions that are hashed at once.
STEP = 1 << 18
_M = np.uint64(0x9E3779B97F4A7C15)


def runs_of(doc_id: int | None, text: str | None) -> Counter:
    """The words of a document with their numbers; one in ``DAMAGED`` lacks a character."""
    found = Counter(_RUN.findall((text or "").translate(_LOWER)))
    if doc_id is None:
        return found
    seed = zlib.crc32(f"{doc_id}:".encode())
    damaged = [(r, h) for r in found if (h := zlib.crc32(r.encode(), seed)) % DAMAGED == 0]
    # all are taken out before any is put back, for what is left of one may be another's whole run
    for r, h, n in [(r, h, found.pop(r)) for r, h in damaged]:
        found[r[: h % len(r)] + r[h % len(r) + 1 :]] += n
    return found


def _count(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def rows() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return out

    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            for word, n in runs_of(doc_id, text.as_py()).items():
                if len(word) >= least:
                    held[word] += n
            if len(held) >= HELD:
                yield rows()
    if held:
        yield rows()


def words(docs: DataFrame, length: int = 6, times: int = 5) -> DataFrame:
    """(word, n): words of at least ``length`` characters that occur at least ``times`` times."""
    got = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return got.mapInArrow(lambda it: _count(it, length), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a hash hangs on all bits, so that the upper ones deal keys out evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deletion_keys(same: list[str]) -> np.ndarray:
    """For words of one length: a row each, the hash of the word itself and of its deletions at 0, 1, ...

    A string's hash is the sum of c * M**(characters behind c); a deletion's is the prefix's, moved by the length
    of what is left, and the suffix's.
    """
    size = len(same[0])
    c = np.frombuffer("".join(same).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(same), size).astype(np.uint64) + np.uint64(1)
    power = np.ones(size + 1, np.uint64)
    power[1:] = np.multiply.accumulate(np.full(size, _M))
    prefix, suffix = np.zeros((2, len(same), size + 1), np.uint64)
    for i in range(size):
        prefix[:, i + 1] = prefix[:, i] * _M + c[:, i]
        suffix[:, size - 1 - i] = suffix[:, size - i] + c[:, size - 1 - i] * power[i]
    out = np.empty((len(same), size + 1), np.uint64)
    out[:, 0] = prefix[:, size]
    out[:, 1:] = prefix[:, :size] * power[size - 1 - np.arange(size)] + suffix[:, 1:]
    return _mixed(out)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        w, n = b.column(0).to_pylist(), b.column(1).to_numpy()
        sizes = np.array([len(x) for x in w], np.int64)
        for size in np.unique(sizes).tolist():
            which = np.flatnonzero(sizes == size)
            most = max(1, STEP // (size + 1))
            for i in range(0, len(which), most):
                some = which[i : i + most]
                same = [w[j] for j in some]
                keys = deletion_keys(same).ravel().view(np.int64)
                at = np.tile(np.arange(-1, size, dtype=np.int32), len(same))
                word = pa.array(same, pa.string()).take(pa.array(np.repeat(np.arange(len(same)), size + 1)))
                for k in range(0, len(keys), 1 << 15):
                    part = slice(k, k + (1 << 15))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array(at[part]), word.slice(k, 1 << 15), pa.array(np.repeat(n[some], size + 1)[part])], ["key", "at", "word", "n"])


def _best(rows: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The two most frequent of (-n, word); of equals the first in code-point order."""
    first = min(rows)
    rest = [r for r in rows if r != first]
    return [first, min(rest)] if rest else [first]


def _run(rows: list[tuple[int, str, int]], out: list[tuple[str, int, int, str]]) -> None:
    """(place, word, n) of one key: adds (word, near words, n of the best, the best) of the words that are linked here."""
    left: dict[str, list[tuple[int, str, int]]] = {}
    for at, w, n in rows:
        left.setdefault(w if at < 0 else w[:at] + w[at + 1 :], []).append((at, w, n))
    for string, of_string in left.items():
        if len(of_string) < 2:
            continue
        whole = next(((-n, w) for at, w, n in of_string if at < 0), None)
        places: dict[int, list[tuple[int, str]]] = {}
        for at, w, n in of_string:
            if at >= 0:
                places.setdefault(at, []).append((-n, w))
        for same in places.values():
            if len(same) > 1:
                best = _best(same)
                out.extend((w, len(same) - 1, -b[0], b[1]) for n, w in same for b in [best[0] if best[0][1] != w else best[1]])
        if whole:
            longer = {r for same in places.values() for r in same}  # one deletion from several places is one
            if longer:
                out.append((string, len(longer), -min(longer)[0], min(longer)[1]))
                out.extend((w, 1, -whole[0], string) for _, w in longer)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted keys in; runs of equal keys may go over the ends of batches."""
    def linked(t: pa.Table) -> pa.RecordBatch:
        key, out = t.column("key").to_numpy(), []
        same = key[1:] == key[:-1]
        many = np.flatnonzero(np.append(False, same) | np.append(same, False))
        at, w, n, key = t.column("at").to_numpy()[many].tolist(), t.column("word").take(pa.array(many)).to_pylist(), t.column("n").to_numpy()[many].tolist(), key[many]
        stops = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)).tolist() if len(key) else []
        start = 0
        for stop in stops:
            _run(list(zip(at[start:stop], w[start:stop], n[start:stop], strict=True)), out)
            start = stop
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "best_n", "best"])

    held, rows = [], 0
    for b in batches:
        held.append(pa.Table.from_batches([b]))
        rows += b.num_rows
        if rows >= 1 << 16:
            t = pa.concat_tables(held).combine_chunks()
            key = t.column("key").to_numpy()
            stop = int(np.searchsorted(key, key[-1]))  # the last run may go on
            if stop:
                yield linked(t.slice(0, stop))
            held, rows = [t.slice(stop)], t.num_rows - stop
    if rows:
        yield linked(pa.concat_tables(held).combine_chunks())


def near(counted: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words of ``counted(word, n)`` that have a word one edit apart."""
    keys = counted.select("word", "n").mapInArrow(_keys, "key bigint, at int, word string, n bigint")
    n = max(int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")), counted.count() // WORDS)
    dealt = keys.repartition(n, F.shiftrightunsigned("key", 44)).sortWithinPartitions("key")
    found = dealt.mapInArrow(_links, "word string, n_near bigint, best_n bigint, best string")
    order = F.struct((-F.col("best_n")).alias("low"), F.col("best").alias("best"))
    one = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(order).alias("o"))
    return one.select("word", "n_near", (-F.col("o.low")).alias("best_n"), F.col("o.best").alias("best"))


def _roots(formed: DataFrame, tables: Tables) -> DataFrame:
    """``formed(word, form)`` to (word, root): every round each word looks twice as far; forms grow by a factor, so rounds are few."""
    now = tables.write(formed.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = tables.write(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        tables.drop(now)
        now = step
        if now.filter("moved").isEmpty():
            return now.select("word", "root")


def variants(docs: DataFrame, length: int = 6, times: int = 5, ratio: int = 5) -> DataFrame:
    """docs(doc_id, text) to word, form, root, n, n_near, form_n: a word each.

    ``form`` is the most frequent word one edit apart, if it is at least ``ratio`` times as frequent; ``root`` is where
    forms of forms end.
    """
    tables = Tables(docs.sparkSession, "spelling")
    counted = tables.write(words(docs, length, times), "words")
    is_form = F.col("best_n") >= ratio * F.col("n")
    got = counted.join(near(counted), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    got = tables.write(got, "forms")
    tables.drop(counted)
    roots = _roots(got.filter("form IS NOT NULL"), tables)
    return got.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

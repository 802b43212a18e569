"""Training-order materialisation: a keyed permutation gives every sequence its slot; shards have a fixed stride.

Documents are cut into sequences of at most ``length`` tokens and numbered in the order of a hash of their id, text
and piece (ties by the record), so the order is a function of the key and the rows alone, however they are laid out.
Sequence i of N gets slot P(i), where P is a Feistel network over the smallest even-bit domain that holds N, walked
along its cycle until it is below N.  Slots are dense, so slot s lies in shard s // per_shard at byte
(s % per_shard) * stride; a reader can go on from any slot without an index.  A record: doc_id (int64), piece
(int32), tokens (int32), then ``length`` unsigned 16-bit ids, zero-padded, all little-endian.

Sequences are made once and dealt to equal ranges of the hash, where they are sorted and numbered; equal rows of a
batch travel as one with their number, so an id repeated without end doesn't fill one range.  Only the number of
sequences of each range comes to the driver.  Records are then dealt to ranges of shards and written.

Shards are rows of a binary column in the shared folder, which any store can hold; ``export`` writes them as
files.  Defined results: a null or empty text is one sequence of the end id; a null doc_id is stored as
-2**63 and read as null; repeated rows (ties) have sequences of their own; texts of any length are cut whole;
columns other than doc_id and text are not read; an empty table gives no shards; a tokenizer with ids beyond 16
bits is refused.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, Tables
from .tokens import byte_ids

_NO_ID = -(2**63)
ROUNDS = 6


def _round(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permute(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slots of the sequences i of n; a bijection on 0..n-1."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, bits = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [(key * 0x9E3779B1 + r * 0x85EBCA77 + 1) % 2**63 for r in range(ROUNDS)]
    x = i.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        v = x[todo]
        left, right = v >> bits, v & mask
        for k in keys:
            left, right = right, left ^ (_round(right, k) & mask)
        v = (left << bits) | right
        x[todo] = v
        todo = todo[v >= n]
    return x.astype(np.int64)


def _sequences(batches: Iterator[pa.RecordBatch], path: str, end_id: int, length: int, parts: int) -> Iterator[pa.RecordBatch]:
    encode = byte_ids(path).encode_to_numpy
    end = np.array([end_id], "<u2").tobytes()
    size = 2 * length
    for batch in batches:
        records, hashes, times = [], [], []
        rows: dict[tuple, int] = Counter(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for (doc_id, text), n in rows.items():
            head = struct.pack("<q", _NO_ID if doc_id is None else doc_id)
            raw = encode(text or "", disallowed_special=()).astype("<u2").tobytes() + end
            h = xxhash.xxh64_intdigest(head + (text or "").encode("utf-8", "surrogatepass"))
            for p, i in enumerate(range(0, len(raw), size)):
                ids = raw[i : i + size]
                records.append(head + struct.pack("<ii", p, len(ids) // 2) + ids)
                hashes.append((h + p * 0x9E3779B97F4A7C15) % 2**64)
                times.append(n)
        x = np.array(hashes, np.uint64)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        of = ((x >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(of), pa.array((x ^ np.uint64(1 << 63)).view(np.int64)), pa.array(np.array(times, np.int64)), pa.array(records, pa.binary())], ["part", "hash", "times", "record"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places within the range, of which a task has all rows in order."""
    at = 0
    for b in batches:
        times = b.column(2).to_numpy()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at + np.cumsum(times) - times), b.column(2), b.column(3)], ["part", "nth", "times", "record"])
        at += int(times.sum())


def _slots(batches, starts: dict[int, int], total: int, key: int, per_shard: int, parts: int) -> Iterator[pa.RecordBatch]:
    shards = -(-total // per_shard)
    for b in batches:
        first = np.fromiter((starts[p] for p in b.column(0).to_pylist()), np.int64, b.num_rows) + b.column(1).to_numpy()
        times = b.column(2).to_numpy()
        for i in range(0, int(times.sum()), BATCH_ROWS):  # a row for each of the equal ones
            nth = np.arange(i, min(i + BATCH_ROWS, int(times.sum())))
            row = np.searchsorted(np.cumsum(times), nth, "right")
            slots = permute(first[row] + nth - (np.cumsum(times) - times)[row], total, key)
            shard = slots // per_shard
            yield pa.RecordBatch.from_arrays([pa.array((shard * parts // shards).astype(np.int32)), pa.array(shard), pa.array(slots), b.column(3).take(pa.array(row))], ["range", "shard", "slot", "record"])


def _shards(batches, stride: int, per_shard: int) -> Iterator[pa.RecordBatch]:
    """Rows of one task come by slot; a shard's rows are all in one task."""
    shard, held, first = None, [], 0

    def done():
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([first], pa.int64()), pa.array([len(held)], pa.int32()), pa.array([b"".join(held)], pa.binary())], ["shard", "first_slot", "n", "payload"])

    for b in batches:
        for s, slot, record in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            if s != shard:
                if held:
                    yield done()
                shard, held, first = s, [], slot
            held.append(record.ljust(stride, b"\0"))
    if held:
        yield done()


def materialise(docs: DataFrame, tokenizer: str, key: int, end_id: int = 50_256, length: int = 1024, per_shard: int = 512) -> DataFrame:
    """Writes the shards; returns their table (shard, first_slot, n, payload)."""
    if max(byte_ids(tokenizer).max_token_value, end_id) >= 1 << 16:
        raise ValueError("ids must fit 16 bits")
    spark = docs.sparkSession
    tables = Tables(spark, "order")
    got = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stride = 16 + 2 * length
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = got.mapInArrow(lambda it: _sequences(it, tokenizer, end_id, length, parts), "part int, hash bigint, times bigint, record binary")
    dealt = made.repartitionById(parts, "part").sortWithinPartitions("part", "hash", "record")
    rows = tables.write(dealt.mapInArrow(_numbered, "part int, nth bigint, times bigint, record binary"), "sequences")
    starts, total = {}, 0
    for part, n in sorted(rows.groupBy("part").agg(F.sum("times")).collect()):  # a row for each range
        starts[part] = total
        total += n
    ranges = max(parts, -(-total * stride // (64 << 20)))
    made = rows.mapInArrow(lambda it: _slots(it, starts, total, key, per_shard, ranges), "range int, shard bigint, slot bigint, record binary")
    dealt = made.repartitionById(ranges, "range").sortWithinPartitions("slot")
    out = tables.write(dealt.mapInArrow(lambda it: _shards(it, stride, per_shard), "shard bigint, first_slot bigint, n int, payload binary"), "shards", product=True)
    tables.drop(rows)
    return out


def _read(batches, length: int, start: int) -> Iterator[pa.RecordBatch]:
    stride = 16 + 2 * length
    kind = np.dtype([("doc_id", "<i8"), ("piece", "<i4"), ("n", "<i4"), ("ids", "<u2", (length,))])
    for b in batches:
        for shard, first, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
            r = np.frombuffer(payload.as_buffer(), kind)
            r = r[max(0, start - first) :]
            slots = np.arange(len(r)) + max(first, start)
            ids = [x["ids"][: x["n"]].tobytes() for x in r]
            doc = r["doc_id"].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots), pa.array(np.full(len(r), shard)), pa.array((slots - first) * stride), pa.array(doc, mask=doc == _NO_ID), pa.array(r["piece"].astype(np.int32)), pa.array(r["n"].astype(np.int64)), pa.array(ids, pa.binary())],
                ["slot", "shard", "byte_offset", "doc_id", "piece", "n_tokens", "ids"],
            )


def read(shards: DataFrame, length: int = 1024, start: int = 0) -> DataFrame:
    """Sequences from slot ``start`` on: slot, shard, byte_offset, doc_id, piece, n_tokens, ids (unsigned 16-bit)."""
    left = shards.filter(F.col("first_slot") + F.col("n") > start).select("shard", "first_slot", "n", "payload")
    return left.mapInArrow(lambda it: _read(it, length, start), "slot bigint, shard bigint, byte_offset bigint, doc_id bigint, piece int, n_tokens bigint, ids binary")


def export(shards: DataFrame, folder: str) -> None:
    """Writes shard files into a folder that all executors see; each by way of a temporary name."""

    def write(batches):
        import os

        for b in batches:
            for shard, payload in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                path = f"{folder}/{shard:012d}.bin"
                with open(f"{path}.{os.getpid()}", "wb") as f:
                    f.write(payload.as_py())
                os.replace(f"{path}.{os.getpid()}", path)
            yield b.select(["shard"])

    shards.select("shard", "payload").mapInArrow(write, "shard bigint").count()

"""Best-fit packing of token sequences, bulk-synchronously.

Documents are cut into pieces of at most ``capacity`` tokens.  Pieces are range-sorted by length, longest
first; open sequences (gaps) are kept sorted by the room left.  A superstep takes one length: its successor
sweep finds the smallest gap that fits, ranks within the length decide who gets which gap, gaps are updated,
and the next length follows.  Since pieces of one length can stand for each other, the sweep is over runs
(length, count) and (room, first sequence, count): at most ``capacity`` lengths, whatever the input's size.
The runs give segments of the global order, and each row finds its place by its position in that order in one
distributed pass.  Only the histogram of lengths, the number of rows of each range partition and the segments
are on the driver; none grows with the rows.

Defined results: a null text counts as empty; texts of any length are cut whole; repeated rows (ties) are pieces
of their own; lengths that are null, below 1 or above ``capacity`` given to ``pack`` get a null place; of ``docs``
only doc_id and text are read; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, fresh, only
from .tokens import KEPT, word_ids


def _cut(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int, words: int) -> Iterator[pa.RecordBatch]:
    known = word_ids(path, words)
    encode = known.ids
    only(known.kept)
    end = np.array([end_id], "<u4").tobytes()
    size = 4 * capacity
    for batch in batches:
        cols: tuple[list, ...] = ([], [], [], [], [])
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = encode(text.as_py() or "") + end
            for i, at in enumerate(range(0, len(raw), size)):
                part = raw[at : at + size]
                for c, v in zip(cols, (doc_id, i, at // 4, len(part) // 4, part), strict=True):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "piece", "start", "length", "ids"])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, words: int = KEPT) -> DataFrame:
    """docs(doc_id, text) to (doc_id, piece, start, length, ids); ids: little-endian unsigned 32-bit, end id included."""
    got = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return got.mapInArrow(lambda it: _cut(it, tokenizer, end_id, capacity, words), "doc_id bigint, piece int, start bigint, length bigint, ids binary")


def best_fit(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, ...]:
    """Segments of the order by falling length: first position, pieces a sequence gets, first sequence, offset, length."""
    rooms: list[int] = []  # sorted, those with open runs
    runs: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, count)
    made: list[tuple[int, int, int, int, int]] = []
    position = sequences = 0

    def put(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in runs:
                insort(rooms, room)
                runs[room] = []
            runs[room].append((first, count))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
            else:
                room, first = capacity, sequences
                count = -(-left // (capacity // length))
                sequences += count
            each = room // length
            full = min(count, left // each)
            if full:
                made.append((position, each, first, capacity - room, length))
                position += full * each
                left -= full * each
                put(room - each * length, first, full)
            if full < count and left and left < each:
                made.append((position, left, first + full, capacity - room, length))
                position += left
                put(room - left * length, first + full, 1)
                left, full = 0, full + 1
            put(room, first + full, count - full)
    return tuple(np.array(c, np.int64) for c in zip(*made, strict=True)) if made else tuple(np.empty(0, np.int64) for _ in range(5))


def _numbered(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(at, at + b.num_rows, dtype=np.int64))], names)
        at += b.num_rows


def _placed(batches: Iterator[pa.RecordBatch], starts: dict[int, int], plan, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The last two columns, partition and number within it, give way to the place."""
    first, each, sequence, offset, length = plan.value
    for b in batches:
        if b.num_rows:
            parts, nth = (b.column(i).to_numpy() for i in (-2, -1))
            at = nth + np.array([starts[p] for p in np.unique(parts)], np.int64)[np.searchsorted(np.unique(parts), parts)]
            s = np.searchsorted(first, at, "right") - 1
            k = at - first[s]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(sequence[s] + k // each[s]), pa.array(offset[s] + k % each[s] * length[s])], names)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def pack(rows: DataFrame, capacity: int = 2048, tables: Tables | None = None, partitions: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` and, for the order of ties, ``doc_id`` and ``piece``.

    ``rows`` should be narrow: every column is sorted along.  Sequence ids begin at 0.  Columns of these two names
    give way to the places; any other column stays.
    """
    rows = rows.drop("sequence_id", "offset")
    spark = rows.sparkSession
    tables = tables or Tables(spark, "pack")
    fits = F.coalesce(F.col("length").between(1, capacity), F.lit(False))
    good = rows.filter(fits)
    counts = dict(good.groupBy(F.col("length").cast("int")).count().collect())  # at most ``capacity`` rows
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    part, nth = fresh("part", rows), fresh("nth", rows)
    order = [F.col("length").desc(), F.col("doc_id"), F.col("piece")]
    # equal rows may change places, so the rest of the key, which only splits them, needn't hang on the rows
    ordered = good.repartitionByRange(n, *order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    names = [*rows.columns, part, nth]
    ordered = tables.write(ordered.mapInArrow(lambda it: _numbered(it, names), _ddl(rows) + f", `{part}` int, `{nth}` bigint"), "ordered")
    starts, total = {}, 0
    for p, size in sorted(ordered.groupBy(part).count().collect()):  # a row for each range partition
        starts[p] = total
        total += size
    plan = spark.sparkContext.broadcast(best_fit(counts, capacity))
    names_out = [*rows.columns, "sequence_id", "offset"]
    out = ordered.mapInArrow(lambda it: _placed(it, starts, plan, names_out), _ddl(rows) + ", sequence_id bigint, offset bigint")
    rest = rows.filter(~fits).withColumns({"sequence_id": F.lit(None).cast("bigint"), "offset": F.lit(None).cast("bigint")})
    return out.unionByName(rest)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, words: int = KEPT) -> tuple[DataFrame, DataFrame]:
    """The written pieces with their ids, and each piece's place: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    ``words`` bounds the words a worker remembers; the ids are the same whatever it is.
    """
    tables = Tables(docs.sparkSession, "pack")
    cut = tables.write(pieces(docs, tokenizer, capacity, end_id, words).withColumn("ids_crc32", F.crc32("ids")), "pieces", product=True)
    return cut, pack(cut.drop("ids"), capacity, tables)

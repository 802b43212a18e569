"""A bounded sample of labelled rows, with their texts, for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def held_out(doc_id):
    """Every fifth document by crc32 of its id as text; never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, target, bound: int, tables: Tables) -> DataFrame:
    """(doc_id, y, text) of at most ``bound`` labelled ids, those with the least hashes, without held-out ones.

    A row for each id: its largest label, and of its texts the least, so repeated ids don't add to the bound and
    runs agree.  The sample of ids is bounded, so it is broadcast and the documents are filtered where they are
    read; the hash is cut first, so that little more than ``bound`` ids are sorted.
    """
    some = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), target.cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
    some = some.groupBy("doc_id").agg(F.max("y").alias("y"))
    share = min(1.0, 1.1 * bound / max(1, some.count()) + 1e-5)
    mix = F.xxhash64("doc_id")
    some = some.filter(F.pmod(mix, F.lit(1_000_000)) < int(share * 1_000_000)).orderBy(mix, "doc_id").limit(bound)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return tables.write(texts.join(F.broadcast(some), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")), "training")

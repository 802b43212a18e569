"""A store of books for the quotation matcher: pages in normal form, in buckets of works, sorted.

Texts are brought to their normal form once, not by each search.  A search for a work reads one bucket and, since
pages are sorted by work, the row groups of that work.  A long work is sorted over several files.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemere.operators.matcher import normal_forms

BUCKETS = 64
#: Pages in a file of a bucket on average at most.
FILE_PAGES = 200_000


def _bucket(work: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(work.cast("binary")), F.lit(buckets)).cast("int")


def build(pages: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Writes pages(work_id, page_index, printed_page, text) as a store; a page without a work can't be looked up."""
    rows = normal_forms(pages.filter("work_id IS NOT NULL")).withColumn("bucket", _bucket(F.col("work_id"), buckets))
    n = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), pages.count() // FILE_PAGES)
    dealt = rows.repartitionByRange(n, "bucket", "work_id", "page_index").sortWithinPartitions("bucket", "work_id", "page_index")
    dealt.write.partitionBy("bucket").parquet(path)


def book(spark: SparkSession, path: str, works: Iterable[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(work_id, page_index, printed_page, normal) of all works, or of some that are named: only their buckets are read."""
    got = spark.read.parquet(path)
    if works is not None:
        named = sorted(set(works))
        of = [r[0] for r in spark.createDataFrame([(w,) for w in named], "w string").select(_bucket(F.col("w"), buckets)).distinct().collect()]
        got = got.filter(F.col("bucket").isin(*of) & F.col("work_id").isin(*named))
    return got.select("work_id", "page_index", "printed_page", "normal")

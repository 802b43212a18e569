"""State carried down ordered rows, and row numbers, without a window over all rows.

Rows are dealt to sorted ranges.  Each range is worked through alone and gives a summary; the summaries, a row a range
(and a group), are combined in order; what a range starts with is added to its rows.  So neither a long group nor a
table without groups meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemere.sources.shared import written

#: Rows of a range on average at most.
RANGE_ROWS = 1_000_000


def _ranged(rows: DataFrame, order: list[str], ranges: int | None) -> DataFrame:
    """With ``_range``, the number of the sorted range a row lies in, and ``_at``, which rises along it."""
    n = ranges or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // RANGE_ROWS)
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return dealt.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())


def numbered(rows: DataFrame, order: list[str], name: str, ranges: int | None = None) -> DataFrame:
    """Rows with their number from 0 in the order of the columns, which have to tell all rows apart."""
    got = written(_ranged(rows, order, ranges), "numbered")
    # a range's rows are numbered without gaps from the range's first number on
    sizes = got.groupBy("_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # one row a range
    before = sizes.select("_range", "_first", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return got.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_at") - F.col("_first")).select(*rows.columns, name)


def carried(rows: DataFrame, by: list[str], order: list[str], last: dict[str, Column], counts: dict[str, tuple[Column, Column | None]], ranges: int | None = None, tops: dict[str, Column] | None = None) -> DataFrame:
    """Rows with further columns that hang on all rows before them of the same ``by``, and on themselves.

    ``last``: the newest value that isn't null.  ``counts``: (counted, reset): how often ``counted`` was true since
    ``reset`` last was (a row that resets isn't counted), or since the beginning.  ``tops``: the largest value so far.
    """
    tops = tops or {}
    w = Window.partitionBy("_range", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = _ranged(rows, [*by, *order], ranges)
    total = {n: F.sum(F.coalesce(c, F.lit(False)).cast("bigint")).over(w) for n, (c, _) in counts.items()}
    got = got.select("*", *(F.last(c, ignorenulls=True).over(w).alias(f"_l_{n}") for n, c in last.items()), *(c.alias(f"_t_{n}") for n, c in total.items()), *(F.max(c).over(w).alias(f"_m_{n}") for n, c in tops.items()))
    none = F.lit(None).cast("bigint")
    base = {n: none if r is None else F.last(F.when(r, F.col(f"_t_{n}")), ignorenulls=True).over(w) for n, (_, r) in counts.items()}
    got = written(got.select("*", *(c.alias(f"_b_{n}") for n, c in base.items())), "carried")
    own = [f"_l_{n}" for n in last] + [f"_{k}_{n}" for k in "tb" for n in counts] + [f"_m_{n}" for n in tops]
    ends = got.groupBy("_range", *by).agg(F.max_by(F.struct(*own), "_at").alias("e")).select("_range", *by, "e.*")
    # a group has a row a range it lies in
    g = Window.partitionBy(*by).orderBy("_range")
    before = g.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("*", *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in counts))
    starts = [F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_sl_{n}") for n in last] + [F.last(F.col(f"_o_{n}") + F.col(f"_b_{n}"), ignorenulls=True).over(before).alias(f"_sb_{n}") for n in counts] + [F.max(f"_m_{n}").over(before).alias(f"_sm_{n}") for n in tops]
    ends = ends.select(F.col("_range").alias("_r"), *(F.col(c).alias(f"_by_{c}") for c in by), *starts, *(f"_o_{n}" for n in counts))
    on = F.col("_range") == F.col("_r")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    out = got.join(ends, on)
    since = {n: F.col(f"_t_{n}") - F.coalesce(F.col(f"_b_{n}"), F.col(f"_sb_{n}") - F.col(f"_o_{n}"), -F.col(f"_o_{n}")) for n in counts}
    return out.select(*rows.columns, *(F.coalesce(f"_l_{n}", f"_sl_{n}").alias(n) for n in last), *(c.alias(n) for n, c in since.items()), *(F.greatest(f"_m_{n}", f"_sm_{n}").alias(n) for n in tops))

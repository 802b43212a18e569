"""Printed page numbers, derived and never stored, and the judge of a work's page offset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def printed_pages(pages: DataFrame, works: DataFrame, ranges: DataFrame) -> DataFrame:
    """pages(work_id, page_index, ...) with printed_page = index + the offset of the range it lies in, else the work's.

    Works and ranges join on the work; Spark broadcasts them when small.  Ranges of one work don't overlap.
    """
    r = ranges.select(F.col("work_id").alias("r_work"), "from_page", "to_page", F.col("page_offset").alias("r_offset"))
    w = works.select(F.col("id").alias("w_id"), F.col("page_offset").alias("w_offset"))
    in_range = (F.col("work_id") == F.col("r_work")) & F.col("page_index").between(F.col("from_page"), F.col("to_page"))
    out = pages.join(r, in_range, "left").join(w, F.col("work_id") == F.col("w_id"))
    return out.select(*pages.columns, (F.col("page_index") + F.coalesce("r_offset", "w_offset")).cast("int").alias("printed_page"))


def offset_verdicts(pages: DataFrame, ranges: DataFrame, confident: float = 0.9, least_folios: int = 8, least_run: int = 5, least_repeat: int = 3) -> DataFrame:
    """Per work of pages(work_id, page_index, printed_page, folio): verdict, offset, folios, agreeing.

    Implied offsets that fewer than ``least_repeat`` pages share are strays.  A run of one offset counts as a
    numbering sequence if it spans at least ``least_run`` file pages.
    """
    read = pages.filter("folio is not null").withColumn("implied", F.col("folio") - F.col("page_index"))
    repeats = read.groupBy("work_id", "implied").agg(F.count("*").alias("n"), F.min("page_index").alias("first_seen")).filter(F.col("n") >= least_repeat)
    found = read.join(repeats.select("work_id", "implied"), ["work_id", "implied"], "left_semi")
    by_page = Window.partitionBy("work_id").orderBy("page_index")
    new = F.when(F.lag("implied").over(by_page) == F.col("implied"), 0).otherwise(1)
    runs = found.withColumn("new", new).withColumn("run", F.sum("new").over(by_page)).groupBy("work_id", "run", "implied").agg((F.max("page_index") - F.min("page_index")).alias("span"))
    sequences = runs.filter(F.col("span") >= least_run).groupBy("work_id").agg(F.count_distinct("implied").alias("sequences"))
    top = repeats.groupBy("work_id").agg(F.max_by(F.struct("implied", "n"), F.struct("n", -F.col("first_seen"))).alias("top"))
    agree = found.groupBy("work_id").agg(F.count("*").alias("folios"), F.count_if(F.col("printed_page") == F.col("folio")).alias("agreeing"))
    totals = pages.groupBy("work_id").agg(F.count("*").alias("total"))
    ranged = ranges.select("work_id").distinct().withColumn("ranged", F.lit(True))
    out = totals.join(agree, "work_id", "left").join(sequences, "work_id", "left").join(top, "work_id", "left").join(ranged, "work_id", "left")
    n = F.coalesce("folios", F.lit(0))
    verdict = (
        F.when(n < least_folios, "problem")
        .when(F.col("agreeing") / n >= confident, "confirmed")
        .when(F.coalesce("ranged", F.lit(False)), "problem")
        .when(F.coalesce("sequences", F.lit(0)) > 1, "problem")
        .when(F.col("top.n") / n >= confident, "corrected")
        .otherwise("problem")
    )
    out = out.withColumn("verdict", verdict)
    return out.select("work_id", "verdict", F.when(F.col("verdict") == "corrected", F.col("top.implied")).cast("int").alias("page_offset"), n.alias("folios"), F.coalesce("agreeing", F.lit(0)).alias("agreeing"))


def running_heads(pages: DataFrame, share: float = 0.25, least_pages: int = 12, least_count: int = 8) -> DataFrame:
    """(work_id, head, n): first and last lines, numbers masked, that stand on enough pages of their work.

    A page whose first and last lines mask alike counts twice; a page of one line once.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    edge = pages.select("work_id", lines.alias("l")).filter(F.size("l") > 0)
    ends = F.when(F.size("l") > 1, F.array(F.element_at("l", 1), F.element_at("l", -1))).otherwise(F.slice("l", 1, 1))
    heads = edge.select("work_id", F.explode(ends).alias("line")).select("work_id", F.trim(F.regexp_replace("line", r"\d+", "#")).alias("head"))
    counts = heads.filter((F.col("head") != "") & (F.length("head") < 120)).groupBy("work_id", "head").agg(F.count("*").alias("n"))
    totals = pages.groupBy("work_id").agg(F.count("*").alias("total")).filter(F.col("total") >= least_pages)
    often = F.col("n") >= share * F.col("total")
    short = (F.col("n") >= least_count) & (F.length("head") <= 60) & ~F.col("head").rlike(r"[.!?:;,]$")
    return counts.join(totals, "work_id").filter(often | short).select("work_id", "head", "n")

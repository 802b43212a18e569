"""The strip of a motif over works, marks on a page track, and the map of axes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemere.functions.layout import wrap

# Sizes of the map of axes.
COLUMN, MARGIN, ROW, BRIDGE_GAP = 190, 20, 24, 132


def word_hits(chunks: DataFrame, patterns: list[str], limit: int | None = 3000) -> DataFrame:
    """Chunks in page order that any pattern finds in ``text``, with ``hits`` over all patterns and ``capped``.

    The limit is the feature's own; None gives every chunk.
    """
    if not patterns:
        return chunks.select("*", F.lit(0).alias("hits"), F.lit(False).alias("capped")).limit(0)
    hits = sum((F.regexp_count("text", F.lit(p)) for p in patterns), F.lit(0))
    got = chunks.withColumn("hits", hits).filter("hits > 0")
    if limit is None:
        return got.withColumn("capped", F.lit(False))
    reached = got.limit(limit).agg((F.count("*") >= limit).alias("capped"))
    return got.orderBy("start_page", "chunk_id").limit(limit).join(F.broadcast(reached), F.lit(True))


def strip(found: DataFrame, works: DataFrame, bounds: DataFrame, memberships: DataFrame, by: str = "hits") -> DataFrame:
    """One row a work: its place, ``hits``, and ``marks`` by start page with a weight of 0 to 1.

    found(work_id, chunk_id, start_page, end_page, hits or score); bounds(work_id, first, last);
    memberships(work_id, list_sort).  Words weigh by the root of their share of the most hits; scores by their range.
    """
    top = found.agg(F.max(by).alias("hi"), F.min(by).alias("lo"))
    if by == "hits":
        weight = F.sqrt(F.col("hits") / F.greatest(F.col("hi"), F.lit(1)))
    else:
        weight = F.when(F.col("hi") > F.col("lo"), (F.col(by) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    each = found.join(F.broadcast(top)).withColumn("weight", F.round(weight, 6)).withColumn("counts", F.col("hits") if by == "hits" else F.lit(1))
    rows = each.groupBy("work_id").agg(F.sum("counts").alias("hits"), F.array_sort(F.collect_list(F.struct("start_page", "end_page", "chunk_id", "weight"))).alias("marks"))
    w = works.select(F.col("id").alias("work_id"), F.coalesce("author", "title").alias("name"), "container_id")
    own = w.select("work_id", F.col("work_id").alias("member")).union(w.filter("container_id is not null").select("work_id", "container_id"))
    lists = own.join(memberships.withColumnRenamed("work_id", "member"), "member").groupBy("work_id").agg(F.min("list_sort").alias("list_sort"))
    got = rows.join(w, "work_id").join(bounds, "work_id", "left").join(lists, "work_id", "left")
    return got.select("work_id", "name", "list_sort", "first", "last", F.col("hits").cast("bigint").alias("hits"), "marks").orderBy(F.asc_nulls_last("list_sort"), F.desc("hits"), "name", "work_id")


def marks(strips: DataFrame, track: int = 1000, least: int = 4) -> DataFrame:
    """Each mark as (x, width) on a track of the work's pages; a narrow one stays wide enough to see and inside."""
    m = strips.select("work_id", "first", "last", F.explode("marks").alias("m"))
    span = F.greatest(F.col("last") - F.col("first"), F.lit(1))

    def at(page):
        return F.least(F.lit(float(track)), F.greatest(F.lit(0.0), (page - F.col("first")) / span * track))

    x, width = at(F.col("m.start_page")), F.greatest(F.lit(float(least)), at(F.col("m.end_page")) - at(F.col("m.start_page")))
    return m.select("work_id", F.col("m.chunk_id").alias("chunk_id"), F.round(F.least(x, track - width), 6).alias("x"), F.round(width, 6).alias("width"))


def axis_map(axes: DataFrame, edges: DataFrame) -> DataFrame:
    """axes(axis_id, title), edges(axis_id, work_id, label): (work_id, shared, x, row).

    Works of several axes stand at the mean of their centres, in the first row with room; works of one axis stand
    under it in the order of their labels.  A map shows a catalogue's tens of axes and hundreds of bridges, and
    only bridges, the part that is packed in order, meet in one task.
    """
    nth = F.row_number().over(Window.orderBy("axis_id")) - 1
    placed = axes.select("axis_id", (MARGIN + nth * COLUMN).alias("left")).withColumn("centre", F.col("left") + COLUMN / 2)
    works = edges.select("axis_id", "work_id", "label").distinct().join(placed, "axis_id").groupBy("work_id").agg(F.count("*").alias("axes"), F.avg("centre").alias("x"), F.min("left").alias("left"), F.min("label").alias("label"))
    down = Window.partitionBy("left").orderBy("label", "work_id")
    alone = works.filter("axes = 1").select("work_id", F.lit(False).alias("shared"), (F.col("left") + 22.0).alias("x"), (F.row_number().over(down) - 1).alias("row"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        ends: list[float] = []
        rows = []
        for r in frame.sort_values(["x", "label", "work_id"]).itertuples():
            row = next((i for i, e in enumerate(ends) if r.x - e >= BRIDGE_GAP), len(ends))
            ends[row:] = [r.x] if row == len(ends) else [r.x, *ends[row + 1 :]]
            rows.append((r.work_id, True, r.x, row))
        return pd.DataFrame(rows, columns=["work_id", "shared", "x", "row"])

    bridges = works.filter("axes > 1").groupBy(F.lit(0).alias("one")).applyInPandas(pack, "work_id string, shared boolean, x double, row int")
    return bridges.unionByName(alone)


def axis_titles(axes: DataFrame) -> DataFrame:
    @F.pandas_udf("array<string>")
    def lines(s: pd.Series) -> pd.Series:
        return s.map(wrap, na_action="ignore")

    return axes.select("axis_id", lines("title").alias("lines"))

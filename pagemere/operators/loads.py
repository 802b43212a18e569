"""Sections and chunks of extracted files, loaded with printed pages for file pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: most characters of a section's title.
TITLE_CHARS = 300


def page_intervals(printed: DataFrame) -> DataFrame:
    """(work, from_page, to_page, shift) of printed(work_id, page_index, printed_page): runs of file pages without a gap
    whose printed page is the file page and one shift.  A work has a few, however many pages it has."""
    p = printed.select("work_id", "page_index", (F.col("printed_page") - F.col("page_index")).alias("shift"))
    run = F.col("page_index") - F.row_number().over(Window.partitionBy("work_id", "shift").orderBy("page_index"))
    got = p.withColumn("run", run).groupBy("work_id", "shift", "run").agg(F.min("page_index").alias("from_page"), F.max("page_index").alias("to_page"))
    return got.select(F.col("work_id").alias("work"), "from_page", "to_page", "shift")


def _mapped(rows: DataFrame, intervals: DataFrame, page: str, to: str, fallback: Column | None = None) -> DataFrame:
    """With the printed page of a file page; where it isn't loaded the fallback, or null."""
    i = intervals.select(*(F.col(c).alias(f"_{c}") for c in intervals.columns))
    on = (F.col("work_id") == F.col("_work")) & F.col(page).between(F.col("_from_page"), F.col("_to_page"))
    at = F.col(page) + F.col("_shift")
    return rows.join(i, on, "left").select(*rows.columns, (at if fallback is None else F.coalesce(at, fallback)).cast("int").alias(to))


def load_sections(chapters: DataFrame, printed: DataFrame) -> DataFrame:
    """chapters(work_id, place, level, title, page, last_page, source) in file pages to sections in printed pages.

    Chapters of no source, of pages that aren't loaded and of front matter fall out, then the rest is numbered and tiled
    anew: a section ends on the page before the next begins, the last one where its own end is known, none before it begins.
    """
    i = page_intervals(printed)
    c = chapters.filter(F.coalesce(F.col("source"), F.lit("none")) != "none")
    c = _mapped(_mapped(c, i, "page", "first_page"), i, "last_page", "own_last").filter("first_page >= 1")
    w = Window.partitionBy("work_id").orderBy("place")
    last = F.coalesce(F.lead("first_page").over(w) - 1, F.when(F.col("own_last") >= F.col("first_page"), F.col("own_last")))
    c = c.select("work_id", F.row_number().over(w).alias("ordinal"), F.coalesce("level", F.lit(1)).alias("level"), F.substring("title", 1, TITLE_CHARS).alias("title"), "first_page", last.alias("last"), "source")
    return c.select("work_id", "ordinal", "level", "title", "first_page", F.when(F.col("last").isNotNull(), F.greatest("last", "first_page")).cast("int").alias("last_page"), "source")


def load_chunks(chunks: DataFrame, printed: DataFrame, works: DataFrame) -> DataFrame:
    """chunks(work_id, start_page_index, end_page_index, ...) with start_page, end_page, section_type and ``unloaded``.

    A page that isn't loaded is the file page and the work's offset, and the chunk says so; a chunk that starts before
    page 1 is front matter.  Chunks of works that aren't known fall out.
    """
    i = page_intervals(printed)
    c = chunks.join(works.select(F.col("id").alias("_id"), F.coalesce("page_offset", F.lit(0)).alias("_offset")), F.col("work_id") == F.col("_id"))
    c = _mapped(_mapped(c, i, "start_page_index", "_start"), i, "end_page_index", "_end")
    start, end = (F.coalesce(f"_{n}", F.col(f"{n}_page_index") + F.col("_offset")).cast("int") for n in ("start", "end"))
    unloaded = F.col("_start").isNull() | F.col("_end").isNull()
    return c.select(*chunks.columns, start.alias("start_page"), end.alias("end_page"), F.when(start < 1, "front").alias("section_type"), unloaded.alias("unloaded"))

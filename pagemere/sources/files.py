"""Page and chunk documents, catalogue CSV, and sinks that replace one work's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemere.functions import text as T

PAGES = "work_id string, extracted_at string, extractor string, page_offset int, pages array<struct<page:int, printed_page:int, folio:int, chars:int, text:string>>"
CHUNKS = "work_id string, chunker_version int, chunks array<struct<ordinal:int, start_page_index:int, end_page_index:int, lang:string, chars:int, text:string, text_search:string>>"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document a work, one row a page."""
    return spark.read.schema(PAGES).json(path, multiLine=True).select("work_id", "page_offset", F.inline("pages")).withColumnRenamed("page", "page_index")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNKS).json(path, multiLine=True).select("work_id", "chunker_version", F.inline("chunks"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """With a header; a byte-order mark before the first name is dropped."""
    df = spark.read.csv(path, header=True, escape='"', multiLine=True)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def replace_works(df: DataFrame, path: str) -> None:
    """Partitions of the works in ``df`` are replaced, others stay; safe to run again."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("work_id").parquet(path)


def csv_lines(df: DataFrame) -> DataFrame:
    """RFC 4180 lines (column ``value``): quotes doubled, arrays joined by '; ', nulls empty."""
    cells = []
    for name, kind in df.dtypes:
        c = F.array_join(name, "; ") if kind.startswith("array") else F.col(name).cast("string")
        c = F.coalesce(c, F.lit(""))
        cells.append(F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c))
    return df.select(F.concat_ws(",", *cells).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    """CRLF line ends; a text file a partition."""
    csv_lines(df).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def listed(paths: DataFrame, suffixes: tuple[str, ...] = ("pdf", "epub")) -> DataFrame:
    """paths(path) to (key, paths): files by the key of their names, duplicates kept; hidden ones and other kinds left out."""
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.lower(F.element_at(F.split(name, r"\."), -1))
    some = paths.filter(~name.startswith(".") & kind.isin(*suffixes))
    return some.select(T.file_key(name).alias("key"), "path").groupBy("key").agg(F.array_sort(F.collect_list("path")).alias("paths"))

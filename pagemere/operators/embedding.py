"""Pending chunks embedded batch by batch in rounds that are committed one after the other, so a stopped run goes on.

A round is one Spark job over many batches.  Its vectors are a folder; a row of the log, written after it, commits it.
Readers and later runs see committed rounds only; what a stopped round left is written over.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemere.operators.ordered import numbered
from pagemere.sources.shared import exists, written

BATCH, ROUND_BATCHES = 64, 2_000
_VECTORS = "id bigint, batch bigint, model string, dim int, embedding array<float>"
_LOG = "round int, first_batch bigint, batches bigint, rows bigint, model string, dim int"


def log(spark: SparkSession, store: str) -> DataFrame:
    """(round, first_batch, batches, rows, model, dim): a row a committed round."""
    path = f"{store}/log"
    return spark.read.schema(_LOG).parquet(path) if exists(spark, path) else spark.createDataFrame([], _LOG)


def embedded(spark: SparkSession, store: str) -> DataFrame:
    """(id, batch, model, dim, embedding) of the committed rounds, an id's newest."""
    rounds = log(spark, store).select("round")
    if not exists(spark, f"{store}/vectors"):
        return spark.createDataFrame([], _VECTORS)
    got = spark.read.schema(_VECTORS + ", round int").parquet(f"{store}/vectors").join(F.broadcast(rounds), "round")
    newest = got.groupBy("id").agg(F.max("round").alias("round"))
    return got.join(newest, ["id", "round"], "left_semi").drop("round")


def embed_pending(chunks: DataFrame, store: str, embed: Callable[[list[str]], list[list[float]]], model: str, dim: int, order: list[str], batch: int = BATCH, round_batches: int = ROUND_BATCHES, most_rounds: int | None = None, replace: bool = False) -> int:
    """Embeds chunks(id, text, ...) that have no vector, or with ``replace`` none of this model; gives the rounds run.

    ``embed`` gets the texts of one batch, in the order of the columns ``order``, which tell chunks apart.  A store has
    vectors of one dimension: another one is refused before anything is embedded, and so is a wrong answer.
    """
    spark = chunks.sparkSession
    before = log(spark, store).agg(F.max("round"), F.coalesce(F.max(F.col("first_batch") + F.col("batches")), F.lit(0)), F.min("dim"), F.max("dim")).first()
    if before[2] is not None and not before[2] == before[3] == dim:
        raise ValueError(f"the store has vectors of {before[2]} dimensions, not {dim}")
    done = embedded(spark, store)
    done = done.filter(F.col("model") == model) if replace else done
    keys = list(dict.fromkeys(["id", *order]))
    todo = chunks.filter("id IS NOT NULL AND text IS NOT NULL").select(*keys).join(done.select("id"), "id", "left_anti")
    # keys are numbered alone; only texts of rounds that will run are moved, and once
    nth = numbered(todo, order, "_row")
    rows = nth.count()
    total, first, start = -(-rows // batch), 0, before[1]
    last = rows if most_rounds is None else min(rows, most_rounds * round_batches * batch)
    due = nth.filter(F.col("_row") < last).select("_row", *(F.col(c).alias(f"_k_{c}") for c in keys))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys))
    texts = chunks.filter("id IS NOT NULL AND text IS NOT NULL").select(*keys, "text").join(due, same)
    plan = written(texts.select("id", "text", F.col("_row").alias("row"), F.expr(f"_row div {batch}").alias("batch")).repartitionByRange("row"), "pending")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row")
        got = embed(rows["text"].tolist())
        if len(got) != len(rows):
            raise ValueError(f"{len(got)} vectors for {len(rows)} texts")
        if any(len(v) != dim for v in got):
            raise ValueError(f"a vector doesn't have {dim} dimensions")
        return pd.DataFrame({"id": rows["id"], "batch": rows["batch"] + start, "model": model, "dim": dim, "embedding": [list(map(float, v)) for v in got]})

    rounds = 0
    while first < total and (most_rounds is None or rounds < most_rounds):
        number = (-1 if before[0] is None else before[0]) + 1 + rounds
        some = plan.filter(F.col("batch").between(first, first + round_batches - 1))
        some.groupBy("batch").applyInPandas(one, _VECTORS).write.mode("overwrite").parquet(f"{store}/vectors/round={number}")
        rows, batches = min(round_batches, total - first) * batch, min(round_batches, total - first)
        rows = min(rows, spark.read.parquet(f"{store}/vectors/round={number}").count())
        spark.createDataFrame([(number, start + first, batches, rows, model, dim)], _LOG).coalesce(1).write.mode("append").parquet(f"{store}/log")
        first, rounds = first + round_batches, rounds + 1
    return rounds

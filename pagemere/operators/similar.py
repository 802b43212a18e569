"""Vectors: cosine top-k, works with their language's average removed, neighbours and the map of works."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return F.try_divide(_dot(a, b), F.sqrt(_dot(a, a) * _dot(b, b)))


def nearest(chunks: DataFrame, query: list[float] | DataFrame, k: int = 8) -> DataFrame:
    """chunks(chunk_id, embedding, ...) nearest to a vector, or to the one row of a DataFrame(query); ties by id.

    The score that orders them is not rounded; the one shown has six digits.
    """
    if isinstance(query, DataFrame):
        chunks, q = chunks.join(F.broadcast(query.select(F.col("query").alias("_query")).limit(1))), F.col("_query")
    else:
        q = F.array(*(F.lit(float(x)) for x in query))
    best = chunks.filter("embedding is not null").withColumn("score", cosine(F.col("embedding"), q)).orderBy(F.desc("score"), "chunk_id").limit(k)
    return best.withColumn("score", F.round("score", 6)).drop("_query")


def _mean(df: DataFrame, by: str, vector: str) -> DataFrame:
    """Average vector of each key: positions are averaged before the shuffle, then put in order."""
    at = df.select(by, F.posexplode(vector).alias("i", "x")).groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return at.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))


def centred(chunks: DataFrame) -> DataFrame:
    """(work_id, lang, v): average of a work's chunks outside the front matter, less the average work of its language."""
    used = chunks.filter("embedding is not null and section_type is distinct from 'front'")
    lang = used.groupBy("work_id").agg(F.mode("lang", True).alias("lang"))
    w = _mean(used, "work_id", "embedding").join(lang, "work_id").filter("lang is not null")
    m = _mean(w, "lang", "mean").withColumnRenamed("mean", "lang_mean")
    return w.join(m, "lang").select("work_id", "lang", F.zip_with("mean", "lang_mean", lambda x, y: x - y).alias("v"))


#: Most works of a catalogue whose every two are compared, and most on a map, whose matrix one task holds.
MOST_PAIRED, MOST_MAPPED = 20_000, 4_000


def _bounded(vectors: DataFrame, most: int) -> DataFrame:
    n = vectors.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} works")
    return vectors


def pairs(vectors: DataFrame) -> DataFrame:
    """Similarity of every two works of a catalogue; more than ``MOST_PAIRED`` are refused."""
    vectors = _bounded(vectors, MOST_PAIRED)
    a, b = vectors.select(F.col("work_id").alias("a"), F.col("v").alias("va")), vectors.select(F.col("work_id").alias("b"), F.col("v").alias("vb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(cosine(F.col("va"), F.col("vb")), 6).alias("similarity"))


def neighbours(vectors: DataFrame, k: int = 5) -> DataFrame:
    p = pairs(vectors)
    both = p.union(p.select("b", "a", "similarity"))
    w = Window.partitionBy("a").orderBy(F.desc_nulls_last("similarity"), "b")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(F.col("a").alias("work_id"), F.col("b").alias("neighbour"), "similarity", "rank")


def mds(similarity: np.ndarray) -> np.ndarray:
    """Classical scaling to two dimensions, each scaled to 0..1; signs fixed by the largest component."""
    n = len(similarity)
    if n < 3:
        return np.empty((0, 2))
    d2 = np.maximum(0, 1 - similarity) ** 2
    centre = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-0.5 * centre @ d2 @ centre)
    order = np.argsort(-np.abs(values))[:2]  # what power iteration finds: the largest in absolute value
    out = np.empty((n, 2))
    for c, i in enumerate(order):
        v = vectors[:, i]
        v = v * (np.sign(v[np.abs(v).argmax()]) or 1) * np.sqrt(abs(values[i]))
        out[:, c] = (v - v.min()) / (v.max() - v.min()) if v.max() > v.min() else 0.5
    return out


def corpus_map(vectors: DataFrame) -> DataFrame:
    """(work_id, x, y); the matrix of a catalogue's works goes to one task, so more than ``MOST_MAPPED`` are refused."""
    vectors = _bounded(vectors, MOST_MAPPED)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("work_id").reset_index(drop=True)
        v = np.array(frame["v"].to_list())
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        s = v @ v.T
        np.fill_diagonal(s, 1)
        at = mds(s)
        return pd.DataFrame({"work_id": frame["work_id"][: len(at)], "x": at[:, 0].round(6), "y": at[:, 1].round(6)})

    return vectors.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(run, "work_id string, x double, y double")

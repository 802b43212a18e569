"""The corpus pipeline: stages over ``documents``, each reading what its predecessor kept.

Quality, toxicity, near-duplicates and benchmark passages each remove rows and keep the columns of documents;
the last stage packs what is left into sequences.  Each stage is written as Parquet and read again.

Defined results: null and empty texts are scored like texts without features, are no near-duplicates and hold no
benchmark passage; a document without an id is never removed as a copy or a leak; repeated rows of one id stay or go
together; further columns, whatever their names, come through unchanged up to packing; an empty table gives an empty
result in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemere.llm.common import Tables, table
from pagemere.llm.decontaminate import contamination
from pagemere.llm.minhash import near_duplicates
from pagemere.llm.packing import pack_documents
from pagemere.llm.quality import ratings
from pagemere.llm.quality import scorer as quality_scorer
from pagemere.llm.toxicity import scorer as toxicity_scorer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are usable or better with a probability of at least a half."""
    tail = quality_scorer(docs, table(spark, sf_dir, "labels"), ratings(), least=1)
    return docs.filter(tail(docs["text"]) >= 0.5)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents scored 0.5 or more."""
    score = toxicity_scorer(docs, table(spark, sf_dir, "labels"))
    return docs.filter(score(docs["text"]) < 0.5)


def _kept(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """Without the rows of the removed ids; null ids stay."""
    return docs.join(removed, docs.doc_id == removed.gone, "left_anti").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: five words a shingle, a similarity of 0.8."""
    classes = near_duplicates(docs, k=5, percent=80)
    gone = Tables(spark, "dedup").write(classes.filter("not kept").select(F.col("doc_id").alias("gone")), "gone")
    return _kept(docs, gone)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a window of a benchmark item."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    gone = Tables(spark, "leaks").write(found.filter("contaminated").select(F.col("doc_id").cast("bigint").alias("gone")).distinct(), "gone")
    return _kept(docs, gone)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)[1]


STAGES = [("quality_classifier", quality), ("toxicity", toxicity), ("minhash_near_dedup", near_dedup), ("benchmark_decontamination", decontaminate), ("best_fit_packing", packing)]

#: Learned models and tokenizers have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables = table(spark, sf_dir, "documents"), Tables(spark, "pipeline")
    for name, stage in STAGES:
        docs = tables.write(stage(spark, docs, sf_dir), name)
    return docs

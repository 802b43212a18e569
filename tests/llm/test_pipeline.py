from pyspark.sql import functions as F

import corpus_pipeline
from pagemere.llm import packing
from tests.llm.test_operators import awkward

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_drop_rows(spark):
    sf = "/root/testdata/sf0.01"  # the smallest has some ten rejected rows, too few to learn from
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids, labels = docs.count(), spark.read.parquet(f"{sf}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        out = spark.createDataFrame(out.collect(), docs.schema)
        assert out.count() <= ids
        docs, ids = out, out.count()
    kept = {r.doc_id for r in docs.collect()}
    bad = {r.doc_id for r in labels.filter("quality = 0").collect()}
    assert len(kept & bad) <= 0.1 * len(bad)


def test_run_packs(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048


def test_awkward_rows_pass(spark):
    docs = awkward(spark)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert docs.count() > 0


def test_further_columns_come_through(spark):
    names = ["score", "tail_probability", "part", "nth", "sequence_id", "offset", "length", "piece", "component_id", "kept", "gone", "contaminated", "predicted", "held_out"]
    docs = awkward(spark).select("doc_id", "text", *(F.concat_ws("-", F.lit(n), F.coalesce("doc_id", F.lit(99))).alias(n) for n in names))
    before = {(r.doc_id, r.text): r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and all(before[r.doc_id, r.text] == r for r in out.collect()), name
    assert corpus_pipeline.packing(spark, docs, SF).count() == packing.pack_documents(docs.select("doc_id", "text"), corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"))[1].count()


def test_empty_tables(spark):
    docs = awkward(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0, name
        docs = out if name != "best_fit_packing" else docs

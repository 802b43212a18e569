"""Registered queries of the training-data operators, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import grade_documents, ratings

    return grade_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ratings())


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)[1]


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import read, store

    got = read(store(table(spark, sf_dir, "documents")))
    sha = F.sha2(F.concat_ws(",", F.col("times").cast("array<string>"), F.col("codes").cast("array<string>")), 256)
    return got.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("times").cast("string"), sha).alias("feature"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    got = scan(table(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct("base"))
    every = F.array_sort(F.array_union("base", F.transform("found", lambda x: x["label"])))
    return got.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("bigint").alias("n_base"),
        F.array_min("starts").alias("first_word"),
        F.array_max("starts").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        "score",
        F.col("found").alias("spans"),
    )


def op8_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import score

    return score(table(spark, sf_dir, "documents"))


def op9_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read, write

    got = read(write(table(spark, sf_dir, "pages"), least=0))
    return got.filter("record_type != 'quarantine'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .order import materialise, read

    got = read(materialise(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), key=20_240_601))
    return got.select("doc_id", "piece", "n_tokens", "slot", "shard", "byte_offset", F.crc32("ids").alias("ids_crc32"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants

    return variants(table(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import linked

    return linked(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations, and one (-1) of two turns that are made of control strings."""
    from .chat import format_conversations, read

    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-1, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))], own.schema)
    return read(format_conversations(own.union(hard)))


_ALL = (op1_quality_classifier, op2_toxicity, op3_minhash_near_dedup, op4_benchmark_decontamination, op5_best_fit_packing, op6_media_columns, op7_license_scan, op8_pseudo_likelihood, op9_warc_salvage, op10_training_order, op11_spelling_variants, op12_tokenizer_alignment, op13_chat_format)
QUERIES = {f.__name__: f for f in _ALL}

_OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i : least(i + 9, len(w))], ' ') AS win, least(10, len(w)) AS n FROM b, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
spot AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM d, lens, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
hit AS (SELECT DISTINCT spot.doc_id, spot.i, spot.n, win.item_id FROM spot JOIN win ON spot.win = win.win AND spot.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(pos.n_hit, 0)::BIGINT AS n_hit, coalesce(its.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(its.items, '')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_OP9_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_sum(list_transform(range(i, i + 5), lambda j: (((strpos('0123456789abcdef', substr(h, 1 + (j // 4)::INT, 1)) - 1) >> (3 - j % 4)::INT) & 1) << (i + 4 - j)::INT))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

ORACLE_SQL: dict[str, str] = {"op4_benchmark_decontamination": _OP4_SQL, "op9_warc_salvage": _OP9_SQL}

"""Registered queries and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemere.functions import text as T
from pagemere.operators import chunks, citations, link, matcher, pages, similar, writes
from pagemere.sources import files
from pagemere.sources.overlay import duck_sql, spark_sql
from pagemere.sources.shared import small_batches

from . import catalogue, derived, lists, loaded, requested, seeded, written
from .relational import OTHER, SQL


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    small_batches(spark)
    return spark.sql(spark_sql(text, sf_dir))


def _text_query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _sql(spark, sf_dir, SQL[name])

    run.__name__ = name
    return run


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _sql(spark, sf_dir, f"SELECT * FROM {name}")


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.printed_pages(*(relation(spark, sf_dir, n) for n in ("page", "work", "page_range")))


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.col("text").alias("quote"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return relation(spark, sf_dir, "chunk").join(e, "chunk_id", "left")


def j1_printed_pages(spark, sf_dir):
    return _printed(spark, sf_dir).select("work_id", "page_index", "folio", "printed_page")


def x24_offset_judge(spark, sf_dir):
    return pages.offset_verdicts(_printed(spark, sf_dir), relation(spark, sf_dir, "page_range"))


def x14_running_heads(spark, sf_dir):
    return pages.running_heads(relation(spark, sf_dir, "scan"))


def m4_quotation_exact(spark, sf_dir):
    """Places on single pages, by quotation."""
    hits = matcher.find_exact(_printed(spark, sf_dir), _quotes(spark, sf_dir)).filter("alone")
    return hits.select("item_id", "work_id", "page_index", "printed_page", "match")


_BREAKS = "SELECT chunk_id AS item_id, concat(right(text, 40), ' ', substr(next, 1, 40)) AS quote FROM (SELECT chunk_id, text, lead(text) OVER (PARTITION BY work_id ORDER BY page_index) AS next FROM page) x WHERE next IS NOT NULL AND text IS NOT NULL"


def m3_quotation_joined(spark, sf_dir):
    """Quotations over every page's end, found in the pages joined."""
    return matcher.find_exact(_printed(spark, sf_dir), _sql(spark, sf_dir, _BREAKS)).filter("not alone").select("item_id", "work_id", "pages")


def m6_quotation_close(spark, sf_dir):
    """Quotations with their last word dropped and letters changed, looked up near the page of the original."""
    hits = matcher.find_exact(_printed(spark, sf_dir), _quotes(spark, sf_dir)).filter("alone")
    near = hits.groupBy("item_id", "work_id").agg(F.min("printed_page").alias("near"))
    broken = _quotes(spark, sf_dir).withColumn("quote", F.regexp_replace("quote", "(.{60})e", "$1x"))
    return matcher.find_close(_printed(spark, sf_dir), broken.join(near, "item_id")).select("item_id", "work_id", "printed_page", "match")


def t1_topk_cosine(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    query = v.filter("chunk_id = 7").select(F.col("embedding").alias("query"))
    return similar.nearest(v.filter("section_type is distinct from 'front'"), query, 30).select("chunk_id", "work_id", "score")


def v4_centred_vectors(spark, sf_dir):
    return similar.centred(_vectors(spark, sf_dir)).select("work_id", "lang", F.round(F.element_at("v", 1), 6).alias("first"), F.size("v").alias("dims"))


def v6_pairs(spark, sf_dir):
    return similar.pairs(similar.centred(_vectors(spark, sf_dir)))


def v5_neighbours(spark, sf_dir):
    return similar.neighbours(similar.centred(_vectors(spark, sf_dir)), 5)


def v7_corpus_map(spark, sf_dir):
    return similar.corpus_map(similar.centred(_vectors(spark, sf_dir)))


def x10_chunker(spark, sf_dir):
    return chunks.chunk(relation(spark, sf_dir, "page")).select("work_id", "ordinal", "start_page_index", "end_page_index", "lang", "chars")


def x7_language(spark, sf_dir):
    return chunks.page_languages(relation(spark, sf_dir, "page"))


def x1_fold(spark, sf_dir):
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", *(T.folded(F.col("text"), m).alias(f"fold_{m}") for m in "abcdef"))


def x5_key(spark, sf_dir):
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", T.keyed(F.col("text")).alias("key"))


def fmt1_uninvert(spark, sf_dir):
    return relation(spark, sf_dir, "work").select("id", T.uninvert(F.col("author")).alias("name"))


def fmt7_isbn13(spark, sf_dir):
    raw = F.lpad(F.pmod(F.col("p_partkey") * 7919, F.lit(10**9)).cast("string"), 9, "0")
    checks = [F.concat(raw, F.lit(c)) for c in "0123456789X"]
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", F.coalesce(*(T.isbn13(c) for c in checks)).alias("isbn13"))


def fmt2_bibliography(spark, sf_dir):
    w = citations.with_container(relation(spark, sf_dir, "work"))
    return w.select("id", *(citations.bibliography(s).alias(s) for s in (citations.CHICAGO, citations.CHICAGO_18, citations.MLA)), citations.html(citations.bibliography(citations.MLA)).alias("html"))


def fmt3_footnote(spark, sf_dir):
    w = citations.with_container(relation(spark, sf_dir, "work"))
    note = citations.footnote(F.col("n"))
    return w.select("id", note.alias("footnote"), citations.mark_page(note, F.col("n")).alias("marked"), citations.short_note(F.when(F.col("n") % 2 == 0, F.col("n"))).alias("short"))


def _fresh(spark, sf_dir):
    """Customers, and new rows by the customers of all orders, some of whom are not there yet."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment")
    return c, _sql(spark, sf_dir, "SELECT o_custkey + 100 AS c_custkey, 'new' AS c_name, min(o_orderpriority) AS c_mktsegment FROM {orders} GROUP BY o_custkey")


def snk5_upsert(spark, sf_dir):
    return writes.upsert(*_fresh(spark, sf_dir), ["c_custkey"])


def snk6_append_absent(spark, sf_dir):
    return writes.append_absent(*_fresh(spark, sf_dir), ["c_custkey"])


def snk9_history(spark, sf_dir):
    return writes.revise(*_fresh(spark, sf_dir), "c_custkey", ["c_name", "c_mktsegment"])[1]


def snk11_csv_lines(spark, sf_dir):
    return files.csv_lines(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "props"))


def _parts(spark, sf_dir):
    """Every name of the parts, and every name with its type; texts that are alike are one row."""
    left = "SELECT min(p_partkey) AS id, p_name AS title, min(p_brand) AS surname, min(p_size) AS year FROM {part} GROUP BY p_name"
    right = "SELECT min(p_partkey) AS id, concat_ws(' ', p_name, p_type) AS title, min(p_brand) AS surname, min(p_size) AS year FROM {part} GROUP BY p_name, p_type"
    return _sql(spark, sf_dir, left), _sql(spark, sf_dir, right)


def e4_coverage(spark, sf_dir):
    return link.ready(link.candidates(*_parts(spark, sf_dir), least=0.35))


def e2_one_to_one(spark, sf_dir):
    return link.one_to_one(link.candidates(*_parts(spark, sf_dir), least=0.5))


QUERIES = {n: _text_query(n) for n in SQL} | {
    f.__name__: f
    for f in (
        j1_printed_pages, x24_offset_judge, x14_running_heads, m4_quotation_exact, m3_quotation_joined, m6_quotation_close, t1_topk_cosine, v4_centred_vectors,
        v6_pairs, v5_neighbours, v7_corpus_map, x10_chunker, x7_language, x1_fold, x5_key, fmt1_uninvert, fmt7_isbn13,
        fmt2_bibliography, fmt3_footnote, snk5_upsert, snk6_append_absent, snk9_history, snk11_csv_lines, e4_coverage, e2_one_to_one,
    )
} | derived.QUERIES | catalogue.QUERIES | written.QUERIES | lists.QUERIES | loaded.QUERIES | requested.QUERIES | seeded.QUERIES

_CENTRED = """w0 AS (SELECT c.work_id, c.lang, e.embedding::DOUBLE[] AS v FROM chunk c JOIN {embeddings} e ON e.vec_id = c.chunk_id WHERE c.section_type IS DISTINCT FROM 'front'),
 l AS (SELECT work_id, mode() WITHIN GROUP (ORDER BY lang) AS lang FROM w0 GROUP BY work_id),
 x AS (SELECT work_id, i, avg(v[i]) AS x FROM w0, range(1, 65) r(i) GROUP BY work_id, i),
 m AS (SELECT l.lang, x.i, avg(x.x) AS m FROM x JOIN l USING (work_id) GROUP BY l.lang, x.i),
 cv AS (SELECT x.work_id, l.lang, list(x.x - m.m ORDER BY x.i) AS v FROM x JOIN l USING (work_id) JOIN m ON m.lang = l.lang AND m.i = x.i GROUP BY x.work_id, l.lang),
 pr0 AS (SELECT a.work_id AS a, b.work_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM cv a JOIN cv b ON a.work_id < b.work_id),
 pr AS (SELECT a, b, CASE WHEN NOT isnan(similarity) THEN similarity END AS similarity FROM pr0)"""

_FRESH = "c AS (SELECT c_custkey, c_name, c_mktsegment FROM {customer}), f AS (SELECT o_custkey + 100 AS c_custkey, 'new' AS c_name, min(o_orderpriority) AS c_mktsegment FROM {orders} GROUP BY o_custkey)"
_WORDS = """list_distinct(list_filter(string_split(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'), ' '),
  lambda w: len(w) > 2 AND w NOT IN ('the', 'and', 'of', 'for', 'los', 'las', 'del', 'una', 'con', 'der', 'die', 'das', 'les', 'des')))"""
_PARTS = f"""x AS (SELECT id, s, y, {_WORDS} AS k FROM (SELECT min(p_partkey) AS id, p_name AS title, min(p_brand) AS s, min(p_size) AS y FROM {{part}} GROUP BY p_name)),
 z AS (SELECT id, s, y, {_WORDS} AS k FROM (SELECT min(p_partkey) AS id, concat_ws(' ', p_name, p_type) AS title, min(p_brand) AS s, min(p_size) AS y FROM {{part}} GROUP BY p_name, p_type)),
 pr AS (SELECT x.id AS a, z.id AS b, x.k AS ka, z.k AS kb, len(list_intersect(x.k, z.k)) AS n, x.s = z.s AS ss, x.y = z.y AS yy FROM x, z),
 sc AS (SELECT a, b, round(least(1.0, n::DOUBLE / len(ka) + CASE WHEN ss THEN 0.35 ELSE 0 END + CASE WHEN yy THEN 0.1 ELSE 0 END), 6) AS score, round(n::DOUBLE / (len(ka) + len(kb) - n), 6) AS jaccard FROM pr WHERE n > 0),
 rk AS (SELECT a, b, score, jaccard, row_number() OVER w AS rank, lead(score) OVER w AS second FROM sc WHERE score >= 0.35 WINDOW w AS (PARTITION BY a ORDER BY score DESC, jaccard DESC, b))"""



_CITED = """im AS (SELECT w.*, c.id IS NOT NULL AS held, c.title AS ct, c.editor AS ce0, 'Itor Ed' AS spoken, CASE WHEN c.editor IS NOT NULL THEN 'Itor Ed' END AS ce, 'Given ' || string_split(w.author, ',')[1] AS said, CASE WHEN c.id IS NULL THEN w.publisher ELSE c.publisher END AS ip, CASE WHEN c.id IS NULL THEN w.place ELSE c.place END AS ic, CASE WHEN c.id IS NULL THEN w.year ELSE c.year END AS iy FROM work w LEFT JOIN work c ON c.id = w.container_id)"""


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


_OWN = {
    "e4_coverage": f"WITH {_PARTS} SELECT a, b, score, jaccard, rank::INT AS rank, rank = 1 AND score >= 0.6 AND score - coalesce(second, 0) > 0.15 AS ready FROM rk WHERE rank <= 4",
    "snk5_upsert": f"WITH {_FRESH} SELECT * FROM c WHERE c_custkey NOT IN (SELECT c_custkey FROM f) UNION ALL SELECT * FROM f",
    "snk6_append_absent": f"WITH {_FRESH} SELECT * FROM f WHERE c_custkey NOT IN (SELECT c_custkey FROM c)",
    "snk9_history": f"WITH {_FRESH} SELECT c.* FROM c JOIN f USING (c_custkey) WHERE c.c_name IS DISTINCT FROM f.c_name OR c.c_mktsegment IS DISTINCT FROM f.c_mktsegment",
    "snk11_csv_lines": "SELECT concat_ws(',', event_id::VARCHAR, event_type, CASE WHEN props LIKE '%\"%' THEN concat('\"', replace(props, '\"', '\"\"'), '\"') ELSE props END) AS value FROM {events}",
    "j1_printed_pages": "SELECT work_id, page_index, folio, printed_page FROM printed",
    "m4_quotation_exact": "SELECT b.item_id, p.work_id, p.page_index, q.printed_page, 'exact' AS match FROM page p JOIN printed q ON q.work_id = p.work_id AND q.page_index = p.page_index JOIN {benchmark} b ON contains(lower(regexp_replace(p.text, '\\s+', ' ', 'g')), lower(trim(regexp_replace(b.text, '\\s+', ' ', 'g'), ' \"''')))",
    "t1_topk_cosine": "SELECT c.chunk_id, c.work_id, round(list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM {embeddings} WHERE vec_id = 7)), 6) AS score FROM chunk c JOIN {embeddings} e ON e.vec_id = c.chunk_id WHERE c.section_type IS DISTINCT FROM 'front' ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM {embeddings} WHERE vec_id = 7)) DESC, chunk_id LIMIT 30",
    "fmt2_bibliography": f"""WITH {_CITED}, p AS (SELECT *, CASE WHEN kind = 'film' THEN '' ELSE concat(CASE WHEN author IS NOT NULL THEN author || '. ' WHEN editor IS NOT NULL THEN editor || ', ed. ' END, CASE WHEN kind = 'essay' THEN '"' || title || '."' ELSE '*' || title || '*.' END,
      CASE WHEN held THEN concat(' In *', ct, '*,', ' edited by ' || ce || ',', ' ' || first_page || '.') END) END AS head, concat(' Accessed ' || accessed || '. ' || url || '.', CASE WHEN accessed IS NULL THEN ' ' || url || '.' END) AS online FROM im),
      m AS (SELECT id, concat(CASE WHEN author IS NOT NULL THEN author || '. ' WHEN editor IS NOT NULL THEN editor || ', editor. ' END, CASE WHEN kind = 'essay' THEN '"' || title || '."' ELSE '*' || title || '*.' END, CASE WHEN held THEN concat(' *', ct, '*,', ' edited by ' || ce || ',') END, ' ' || nullif(concat_ws(', ', ip, iy), '') || ',', CASE WHEN held THEN ' pp. ' || first_page || ',' END) AS body, concat(' ' || url || '.', CASE WHEN url IS NOT NULL THEN ' Accessed ' || accessed || '.' END) AS tail FROM im),
      f AS (SELECT p.id, CASE WHEN kind = 'film' THEN concat(author || ', dir. ', '*', title, '*.', ' ' || year || '.') ELSE concat(head, ' ' || nullif(concat_ws(', ', nullif(concat_ws(': ', ic, ip), ''), iy), '') || '.', online) END AS chicago, CASE WHEN kind = 'film' THEN concat(author || ', dir. ', '*', title, '*.', ' ' || year || '.') ELSE concat(head, ' ' || nullif(concat_ws(', ', ip, iy), '') || '.', online) END AS chicago18,
      CASE WHEN kind = 'film' THEN concat('*', title, '*.', ' Directed by ' || said || ',', ' ' || year || '.') ELSE regexp_replace(body, ',$', '.') || tail END AS mla FROM p JOIN m ON m.id = p.id) SELECT *, regexp_replace(mla, '\\*([^*]+)\\*', '<i>\\1</i>', 'g') AS html FROM f""",
    "fmt3_footnote": f"""WITH {_CITED}, b AS (SELECT *, concat(CASE WHEN author IS NOT NULL THEN said || ', ' WHEN editor IS NOT NULL THEN 'Itor Ed, ed., ' END, CASE WHEN kind = 'essay' THEN '"' || title || CASE WHEN held THEN ',' ELSE '' END || '"' ELSE '*' || title || '*' END, ' in *' || ct || '*', ', (' || nullif(concat_ws(', ', nullif(concat_ws(': ', ic, ip), ''), iy), '') || ')') AS head FROM im)
      SELECT id, head || ', ' || n || '.' AS footnote, head || ', ' || n || '*.' AS marked, concat(coalesce(string_split(author, ',')[1], string_split(editor, ',')[1]) || ', ', CASE WHEN kind = 'essay' THEN '"' ELSE '*' END, 'Title of ', id, CASE WHEN kind = 'essay' THEN '"' ELSE '*' END, CASE WHEN n % 2 = 0 THEN ', ' || n END, '.') AS short FROM b""",
    "x7_language": f"""WITH w AS (SELECT work_id, page_index, regexp_extract_all(lower(text), '[a-záéíóúüñ]+') AS w FROM page WHERE len(text) >= 50), n AS (SELECT work_id, page_index, len(w) AS n, len(list_filter(w, lambda x: list_contains([{_listed(chunks.SPANISH)}], x))) AS es, len(list_filter(w, lambda x: list_contains([{_listed(chunks.ENGLISH)}], x))) AS en FROM w)
      SELECT work_id, page_index, last_value(CASE WHEN n < 20 OR es + en = 0 THEN NULL WHEN es >= 1.5 * en THEN 'spanish' WHEN en >= 1.5 * es THEN 'english' END IGNORE NULLS) OVER (PARTITION BY work_id ORDER BY page_index) AS language FROM n""",
    "m3_quotation_joined": f"""WITH q AS (SELECT item_id, trim(lower(regexp_replace(trim(quote), '\\s+', ' ', 'g')), ' "' || chr(39)) AS q FROM ({_BREAKS})), p AS (SELECT work_id, page_index, lower(regexp_replace(trim(text), '\\s+', ' ', 'g')) AS t, printed_page FROM (SELECT p.work_id, p.page_index, p.text, q.printed_page FROM page p JOIN printed q ON q.work_id = p.work_id AND q.page_index = p.page_index)),
      j AS (SELECT work_id, t, lead(t) OVER w AS u, printed_page || '–' || lead(printed_page) OVER w AS pages FROM p WINDOW w AS (PARTITION BY work_id ORDER BY page_index)) SELECT q.item_id, j.work_id, j.pages FROM j JOIN q ON contains(right(j.t, 90) || ' ' || substr(j.u, 1, 90), q.q) AND NOT contains(j.t, q.q) AND NOT contains(substr(j.u, 1, 90), q.q) WHERE len(q.q) >= 25""",
    "x24_offset_judge": """WITH r AS (SELECT work_id, page_index, folio, printed_page, folio - page_index AS o FROM printed WHERE folio IS NOT NULL), f AS (SELECT *, count(*) OVER (PARTITION BY work_id, o) AS k FROM r QUALIFY k >= 3),
      i AS (SELECT *, page_index - 0 AS x, row_number() OVER (PARTITION BY work_id ORDER BY page_index) - row_number() OVER (PARTITION BY work_id, o ORDER BY page_index) AS g FROM f), s AS (SELECT work_id, count(DISTINCT o) AS s FROM (SELECT work_id, o, g, max(x) - min(x) AS span FROM i GROUP BY 1, 2, 3) WHERE span >= 5 GROUP BY 1),
      t AS (SELECT work_id, o, count(*) AS k FROM f GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY count(*) DESC, min(page_index)) = 1), a AS (SELECT work_id, count(*) AS n, count(*) FILTER (folio = printed_page) AS ok FROM f GROUP BY 1),
      v AS (SELECT w.work_id, coalesce(a.n, 0) AS n, coalesce(a.ok, 0) AS ok, t.o, CASE WHEN coalesce(a.n, 0) < 8 THEN 'problem' WHEN a.ok / a.n >= 0.9 THEN 'confirmed' WHEN w.work_id IN (SELECT work_id FROM page_range) OR coalesce(s.s, 0) > 1 THEN 'problem' WHEN t.k / a.n >= 0.9 THEN 'corrected' ELSE 'problem' END AS verdict
      FROM (SELECT DISTINCT work_id FROM page) w LEFT JOIN a USING (work_id) LEFT JOIN s USING (work_id) LEFT JOIN t USING (work_id)) SELECT work_id, verdict, CASE WHEN verdict = 'corrected' THEN o END::INT AS page_offset, n AS folios, ok AS agreeing FROM v""",
    "v4_centred_vectors": f"WITH {_CENTRED} SELECT work_id, lang, round(v[1], 6) AS first, len(v)::INT AS dims FROM cv",
    "v6_pairs": f"WITH {_CENTRED} SELECT a, b, similarity FROM pr",
    "v5_neighbours": f"WITH {_CENTRED} SELECT a AS work_id, b AS neighbour, similarity, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC NULLS LAST, b) AS rank FROM (SELECT a, b, similarity FROM pr UNION ALL SELECT b, a, similarity FROM pr)) WHERE rank <= 5",
    "fmt1_uninvert": "SELECT id, CASE WHEN author IS NOT NULL THEN concat('Given ', split_part(author, ',', 1)) END AS name FROM work",
    "fmt7_isbn13": """SELECT p_partkey, concat(b, ((10 - list_sum(list_transform(range(1, 13), lambda i: substr(b, i::INT, 1)::INT * (CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END))) % 10) % 10)::INT::VARCHAR) AS isbn13
      FROM (SELECT p_partkey, concat('978', lpad((p_partkey * 7919 % 1000000000)::VARCHAR, 9, '0')) AS b FROM {part})""",
}

ORACLE_SQL = {n: duck_sql(OTHER.get(n, t)) for n, t in SQL.items()} | {n: duck_sql(t) for n, t in (_OWN | derived.ORACLE | catalogue.ORACLE | written.ORACLE | lists.ORACLE | loaded.ORACLE | requested.ORACLE | seeded.ORACLE).items()}

"""Registered queries of loads, resumed embedding and batches of drafts; their DuckDB equivalents are written apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemere.operators import drafts, embedding, loads, pages
from pagemere.plans.catalogue import sql
from pagemere.sources.shared import fresh_path, written


def _rel(spark, sf_dir, name):
    return sql(spark, sf_dir, f"SELECT * FROM {name}")


def _printed(spark, sf_dir):
    return pages.printed_pages(*(_rel(spark, sf_dir, n) for n in ("page", "work", "page_range")))


_CHAPTERS = """SELECT work_id, page_index AS place, CASE WHEN page_index % 2 = 0 THEN 1 + page_index % 3 END AS level, text AS title, page_index + CASE WHEN page_index % 27 = 10 THEN 500000 ELSE 0 END AS page,
  page_index + CASE page_index % 4 WHEN 0 THEN 8 WHEN 1 THEN -1 ELSE 500000 END AS last_page, CASE WHEN length(work_id) = 5 AND page_index % 2 = 1 THEN 'none' ELSE 'outline' END AS source FROM page WHERE page_index % 9 = 1 OR page_index % 7 = 2"""
_CHUNKS = "SELECT work_id, chunk_id, page_index AS start_page_index, page_index + chunk_id % 3 AS end_page_index, lang, text FROM page"


def snk2_sections_loaded(spark, sf_dir):
    return loads.load_sections(sql(spark, sf_dir, _CHAPTERS), _printed(spark, sf_dir))


def snk3_chunks_loaded(spark, sf_dir):
    return loads.load_chunks(sql(spark, sf_dir, _CHUNKS), _printed(spark, sf_dir), _rel(spark, sf_dir, "work"))


def _letters(texts):
    return [[len(t), t.count("e"), t.count(" ")] for t in texts]


def snk4_embedded_batches(spark, sf_dir):
    """Every page embedded by letter counts: the run is stopped after a round and goes on."""
    store = fresh_path(spark, "vectors")
    chunks = written(sql(spark, sf_dir, "SELECT chunk_id AS id, work_id, page_index, text FROM page"), "pages")
    for most in (1, None):
        embedding.embed_pending(chunks, store, _letters, "letters", 3, ["work_id", "page_index", "id"], round_batches=4 if most else embedding.ROUND_BATCHES, most_rounds=most)
    return embedding.embedded(spark, store).select("id", "batch", "model", *(F.get("embedding", F.lit(i)).cast("bigint").alias(n) for i, n in enumerate(("chars", "es", "blanks"))))


# a page's middle as a quotation, three pages a draft; every eleventh is changed, every seventeenth too short
_QUOTATIONS = """SELECT CAST(floor(chunk_id / 3) AS BIGINT) AS draft_id, CAST(chunk_id % 3 AS INT) AS n, CASE WHEN chunk_id % 101 = 7 THEN 'no-work' ELSE work_id END AS work_id,
  CASE WHEN chunk_id % 11 = 5 THEN concat('zq ', reverse(substr(text, 20, 80)), ' qz') WHEN chunk_id % 17 = 3 THEN substr(text, 20, 9) ELSE substr(text, 20, 80) END AS text, printed_page AS near
  FROM (SELECT p.chunk_id, p.work_id, p.text, q.printed_page FROM page p JOIN printed q ON q.work_id = p.work_id AND q.page_index = p.page_index WHERE length(p.text) >= 100) x"""
_DRAFTS = """SELECT id AS draft_id, CASE WHEN id % 29 = 4 THEN ' ' ELSE 'a thought' END AS body, CASE id % 5 WHEN 1 THEN 'author' WHEN 2 THEN 'other' WHEN 3 THEN CASE WHEN id % 3 = 0 THEN 'own' ELSE 'author' END END AS attribution,
  CASE WHEN id % 5 = 2 AND id % 4 > 0 THEN 'Somebody' WHEN id % 37 = 1 THEN 'Nobody' END AS attributed_to, CASE WHEN id % 2 = 0 THEN ' Title ' END AS title, CASE WHEN id % 31 = 2 THEN 'dossier' WHEN id % 2 = 1 THEN ' owls ' END AS tag
  FROM (SELECT DISTINCT CAST(floor(doc_id / 3) AS BIGINT) AS id FROM {documents} WHERE source IS NOT NULL) x"""


def tl10_drafts(spark, sf_dir):
    """Drafts of all pages' quotations: what is admitted, with pages, and why the others are refused."""
    d = sql(spark, sf_dir, _DRAFTS).withColumn("tags", F.array(F.coalesce("tag", F.lit(" ")))).drop("tag")
    new, anchors, refused = drafts.admit(d, sql(spark, sf_dir, _QUOTATIONS), _printed(spark, sf_dir), _rel(spark, sf_dir, "work"), _rel(spark, sf_dir, "note"))
    of = anchors.groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "work_id", "printed_page"))).alias("a"))
    places = F.array_join(F.transform("a", lambda x: F.concat_ws(":", x["ordinal"].cast("string"), x["work_id"], x["printed_page"].cast("string"))), " ")
    written = new.join(of, new.id == of.note_id).select("draft_id", "id", "attributed_to", "title", F.array_join("tags", ",").alias("tags"), places.alias("places"), F.lit("").alias("reasons"))
    none = F.lit(None).cast("string")
    return written.union(refused.select("draft_id", F.lit(None).cast("bigint"), none, none, none, none, F.array_join("reasons", "; ")))


QUERIES = {f.__name__: f for f in (snk2_sections_loaded, snk3_chunks_loaded, snk4_embedded_batches, tl10_drafts)}

ORACLE = {
    "snk2_sections_loaded": "WITH c AS (" + _CHAPTERS + """), f AS (SELECT c.work_id, c.place, coalesce(c.level, 1) AS level, substr(c.title, 1, 300) AS title, a.printed_page AS first_page, b.printed_page AS own, c.source FROM c JOIN printed a ON a.work_id = c.work_id AND a.page_index = c.page LEFT JOIN printed b ON b.work_id = c.work_id AND b.page_index = c.last_page WHERE c.source <> 'none' AND a.printed_page >= 1)
      SELECT work_id, row_number() OVER w::INT AS ordinal, level, title, first_page, greatest(coalesce(lead(first_page) OVER w - 1, CASE WHEN own >= first_page THEN own END), CASE WHEN coalesce(lead(first_page) OVER w - 1, CASE WHEN own >= first_page THEN own END) IS NOT NULL THEN first_page END) AS last_page, source FROM f WINDOW w AS (PARTITION BY work_id ORDER BY place)""",
    "snk3_chunks_loaded": "WITH c AS (" + _CHUNKS + """) SELECT c.*, coalesce(a.printed_page, c.start_page_index + w.page_offset)::INT AS start_page, coalesce(b.printed_page, c.end_page_index + w.page_offset)::INT AS end_page, CASE WHEN coalesce(a.printed_page, c.start_page_index + w.page_offset) < 1 THEN 'front' END AS section_type, a.printed_page IS NULL OR b.printed_page IS NULL AS unloaded
      FROM c JOIN work w ON w.id = c.work_id LEFT JOIN printed a ON a.work_id = c.work_id AND a.page_index = c.start_page_index LEFT JOIN printed b ON b.work_id = c.work_id AND b.page_index = c.end_page_index""",
    "snk4_embedded_batches": "SELECT chunk_id AS id, (row_number() OVER (ORDER BY work_id, page_index, chunk_id) - 1) // 64 AS batch, 'letters' AS model, length(text) AS chars, length(text) - length(replace(text, 'e', '')) AS es, length(text) - length(replace(text, ' ', '')) AS blanks FROM page WHERE text IS NOT NULL",
    "tl10_drafts": "WITH q AS (" + _QUOTATIONS + "), d AS (" + _DRAFTS + """), w AS (SELECT id, CASE WHEN offset_problem IS NOT NULL AND NOT accepted THEN 'page numbering unsettled: ' || offset_problem WHEN NOT offset_checked THEN 'page numbering never checked' END AS why FROM work),
      x AS (SELECT q.*, w.id IS NULL AS unknown, w.why, row_number() OVER (PARTITION BY draft_id ORDER BY n) AS ordinal FROM q LEFT JOIN w ON w.id = q.work_id),
      f AS (SELECT *, CASE WHEN unknown THEN 'no such work' WHEN why IS NOT NULL THEN why WHEN length(text) < 25 THEN 'shorter than 25 characters' WHEN text LIKE 'zq %' THEN 'not found in the page text' WHEN near < 1 THEN 'on front matter, printed page ' || near END AS fail FROM x),
      g AS (SELECT draft_id, count(*) AS asked, count(fail) AS bad, string_agg('quotation ' || n || ' (' || work_id || '): ' || fail, '; ' ORDER BY n) FILTER (fail IS NOT NULL) AS fails, string_agg(ordinal || ':' || work_id || ':' || near, ' ' ORDER BY n) AS places FROM f GROUP BY draft_id),
      r AS (SELECT d.*, coalesce(asked, 0) AS asked, fails, places, array_to_string(list_filter([CASE WHEN trim(body) = '' THEN 'the note needs a body' END, CASE WHEN asked IS NULL THEN 'a note needs at least one quotation' END, CASE WHEN attribution = 'own' THEN '''own'' is not a draft''s to assign' END, CASE WHEN attributed_to IS NOT NULL AND attribution IS DISTINCT FROM 'other' THEN 'attributed_to goes only with attribution ''other''' END,
        CASE WHEN attribution = 'other' AND attributed_to IS NULL THEN 'attribution ''other'' needs attributed_to' END, CASE WHEN tag = 'dossier' THEN 'the tag ''dossier'' is reserved' END, fails], lambda v: v IS NOT NULL), '; ') AS reasons FROM d LEFT JOIN g USING (draft_id))
      SELECT draft_id, CASE WHEN reasons = '' THEN (SELECT max(id) FROM note) + row_number() OVER (PARTITION BY reasons = '' ORDER BY draft_id) END AS id, CASE WHEN reasons = '' THEN attributed_to END AS attributed_to, CASE WHEN reasons = '' THEN trim(title) END AS title, CASE WHEN reasons = '' THEN coalesce(trim(tag), '') END AS tags, CASE WHEN reasons = '' THEN places END AS places, reasons FROM r""",
}

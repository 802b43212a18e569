"""Registered queries of a catalogue's first rows and the report on files; their DuckDB equivalents are written apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemere.operators import seed
from pagemere.plans.catalogue import sql
from pagemere.plans.lists import _FILE_WORDS, _PLAIN, _WORKS

_ENTRIES = """SELECT p_partkey AS line, concat('w', CAST(p_partkey AS VARCHAR(20))) AS id, CASE CAST(p_size AS INT) % 5 WHEN 0 THEN 'filmography' WHEN 1 THEN 'theory' WHEN 2 THEN 'teaching' WHEN 3 THEN 'dissertation' END AS list_id, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS section_id,
  CASE p_partkey % 4 WHEN 0 THEN concat(p_brand, ', ed.') WHEN 1 THEN ' ' ELSE p_brand END AS author, CASE WHEN p_partkey % 10 = 1 THEN concat('“', p_name) ELSE p_name END AS title, CASE WHEN p_partkey % 7 = 0 THEN 'n.d.' ELSE CAST(1900 + CAST(p_size AS INT) AS VARCHAR(9)) END AS year,
  CASE WHEN p_partkey % 6 = 0 THEN concat('In "', p_name, '" there') ELSE p_type END AS entry, p_partkey % 2 = 0 AS examinable, CASE WHEN p_partkey % 5 > 0 THEN concat('f', CAST(p_partkey AS VARCHAR(20))) ELSE '' END AS file, CASE p_partkey % 8 WHEN 0 THEN '.epub' WHEN 1 THEN '.zip' ELSE '.pdf' END AS ext,
  CASE WHEN p_partkey % 9 < 2 THEN 'half of it' END AS note, CASE WHEN p_partkey % 4 = 2 THEN '978' END AS isbn FROM {part}"""
_VERDICTS = """SELECT concat('f', CAST(p_partkey AS VARCHAR(20))) AS file, CASE p_partkey % 13 WHEN 0 THEN 'NOT citable' WHEN 1 THEN 'needs OCR' WHEN 2 THEN 'check by hand' WHEN 3 THEN 'probably citable' ELSE 'citable' END AS verdict, CASE WHEN p_partkey % 11 > 0 THEN CAST(p_partkey % 9 AS INT) - 4 END AS offset,
  CASE WHEN p_partkey % 3 = 0 THEN 0.5 ELSE 0.75 END AS agreement, CAST(p_size AS INT) AS folios, 100 AS pages, 'no folios' AS against FROM {part} WHERE p_partkey % 17 > 0"""
_SPLITS = "SELECT concat('w', CAST(l_partkey AS VARCHAR(20))) AS id, l_suppkey + 1 AS nth, concat('Also ', CAST(l_suppkey AS VARCHAR(20))) AS title, concat('w', CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20))) AS new_id, l_suppkey % 2 = 0 AS shares_file FROM {lineitem} WHERE l_quantity > 48 GROUP BY l_partkey, l_suppkey"
_VOLUMES = "SELECT concat('w', CAST(p_partkey AS VARCHAR(20))) AS id, concat('v-', p_brand) AS container_id, concat('Works of ', p_brand) AS title, p_brand AS author, 'edited_volume' AS kind, 1990 AS year FROM {part} WHERE p_retailprice > 1500"


def _seed(spark, sf_dir):
    e, v, s, c = (sql(spark, sf_dir, x) for x in (_ENTRIES, _VERDICTS, _SPLITS, _VOLUMES))
    return seed.catalogue(e, v.withColumn("agreement", F.col("agreement").cast("double")), s, c)


def l1_seed_works(spark, sf_dir):
    return _seed(spark, sf_dir)[0]


def l1_seed_places(spark, sf_dir):
    return _seed(spark, sf_dir)[1]


_CORPUS = """SELECT p_partkey AS file, concat(CASE p_partkey % 19 WHEN 0 THEN 'in/ACCOUNTED/' WHEN 1 THEN 'OCR/' ELSE 'in/' END, CASE WHEN p_partkey % 23 = 0 THEN '.' ELSE '' END, p_name, CASE WHEN p_partkey % 2 = 0 THEN '_ ' ELSE ' ' END, p_type, ' ', CAST(p_partkey % 331 + 1000 AS VARCHAR(9)),
  CASE WHEN p_partkey % 4 > 0 THEN concat(' -- Given de Máker', CAST(p_partkey % 9 AS VARCHAR(9)), 'son, ed. -- Press -- 0f3a') ELSE ', ' END, '.pdf') AS name FROM {part}"""
_RULES = "SELECT p_partkey AS work, concat(' ', upper(p_type), ' ', CAST(p_partkey % 331 + 1000 AS VARCHAR(9))) AS match FROM {part} WHERE p_size > 30"


def l7_status_report(spark, sf_dir):
    return seed.report(sql(spark, sf_dir, _CORPUS), sql(spark, sf_dir, _RULES), sql(spark, sf_dir, _WORKS))


QUERIES = {f.__name__: f for f in (l1_seed_works, l1_seed_places, l7_status_report)}

_BASE = "WITH e AS (" + _ENTRIES + "), v AS (" + _VERDICTS + "), s AS (" + _SPLITS + "), c AS (" + _VOLUMES + r"""),
  j AS (SELECT e.*, v.verdict, v."offset" AS o, v.agreement, v.folios, v.pages, v.against, c.container_id, e.file <> '' AS held, e.file <> '' AND e.ext = '.pdf' AS pdf FROM e LEFT JOIN v ON v.file = e.file LEFT JOIN c ON c.id = e.id),
  k AS (SELECT *, CASE WHEN pdf AND verdict LIKE '%citable' AND verdict <> 'NOT citable' AND agreement >= 0.7 AND folios >= 25 THEN o END AS sure FROM j),
  m AS (SELECT line, 0 AS nth, list_id, section_id, id, title, nullif(trim(author), '') AS author, try_cast(year AS INT) AS year, CASE WHEN container_id IS NOT NULL THEN 'essay' WHEN list_id = 'filmography' THEN 'film' WHEN title LIKE '“%' OR contains(entry, '"' || title || '"') THEN 'essay' WHEN author LIKE '%, ed.%' THEN 'edited_volume' ELSE 'monograph' END AS kind, container_id, isbn, CASE WHEN examinable THEN 'both' ELSE 'dissertation' END AS purpose,
    CASE WHEN NOT held THEN 'none' WHEN pdf AND verdict = 'NOT citable' THEN 'epub' WHEN pdf AND verdict = 'needs OCR' THEN 'none' ELSE CASE ext WHEN '.pdf' THEN 'pdf_text' WHEN '.epub' THEN 'epub' ELSE 'none' END END AS source_format, nullif(file, '') AS file, coalesce(sure, 0) AS page_offset,
    nullif(concat_ws(' | ', CASE WHEN held THEN note WHEN note IS NOT NULL THEN 'A partial copy is in the corpus but is not usable: ' || note || '. Seeded as not held so the gap stays visible.' END,
      CASE WHEN NOT pdf THEN NULL WHEN verdict = 'NOT citable' THEN 'No printed pagination: searchable, but no page a reader could follow. ' || against WHEN verdict = 'needs OCR' THEN 'Scan held (' || pages || 'pp) with no text layer. Run OCR, then re-check.' WHEN verdict = 'check by hand' THEN 'Pagination unconfirmed: ' || against
        WHEN sure > 0 THEN 'Excerpt: begins at printed page ' || (sure + 1) || '.' WHEN sure IS NULL AND o IS NOT NULL THEN 'Page offset uncertain (best guess ' || o || ', ' || agreement::DOUBLE || ' agreement across ' || folios || ' of ' || pages || ' pages). Left at zero; confirm against the PDF.' END), '') AS notes FROM k),
  x AS (SELECT m.line, s.nth, m.list_id, m.section_id, s.new_id, s.title, m.author, m.year, m.kind, m.container_id, CASE WHEN shares_file THEN m.isbn END, m.purpose, CASE WHEN shares_file THEN m.source_format ELSE 'none' END, CASE WHEN shares_file THEN m.file END, CASE WHEN shares_file THEN m.page_offset ELSE 0 END,
    'Listed together with “' || m.title || '” in a single entry.' || CASE WHEN shares_file THEN '' ELSE ' A separate volume: the file held for that entry does not contain this work.' END FROM m JOIN s ON s.id = m.id),
  a AS (SELECT * FROM m UNION ALL SELECT * FROM x)"""

ORACLE = {
    "l1_seed_works": _BASE + " SELECT id, title, author, year, kind, container_id, isbn, purpose, source_format, file, page_offset, notes FROM a UNION ALL SELECT DISTINCT container_id, title, author, year, kind, NULL, NULL, 'unassigned', 'none', NULL, 0, NULL FROM c",
    "l1_seed_places": _BASE + " SELECT list_id, id AS work_id, section_id, row_number() OVER (PARTITION BY list_id ORDER BY line, nth) AS ordinal FROM a WHERE list_id IS NOT NULL",
    "l7_status_report": "WITH f0 AS (" + _CORPUS + "), r AS (" + _RULES + "), w0 AS (" + _WORKS + r"""), f1 AS (SELECT file, regexp_replace(name, '^.*/', '') AS base FROM f0 WHERE name NOT LIKE '%ACCOUNTED/%' AND name NOT LIKE 'OCR/%'), u AS (SELECT file, regexp_replace(base, '\.pdf$', '') AS stem FROM f1 WHERE base NOT LIKE '.%' AND NOT EXISTS (SELECT 1 FROM r WHERE contains(lower(base), lower(trim(match))))),
      p AS (SELECT file, stem, list_transform(string_split(stem, ' -- '), lambda x: trim(x)) AS p FROM u), q AS (SELECT file, stem, p[1] AS title, coalesce(p[2], '') AS author FROM p), f AS (SELECT file, list_distinct(list_concat(""" + _FILE_WORDS.format("title") + ", " + _FILE_WORDS.format("author") + r""")) AS k, coalesce(list_filter(regexp_split_to_array(regexp_replace(string_split(""" + _PLAIN.format("author") + r""", ',')[1], '[^a-z\s-]', ' ', 'g'), '[\s-]+'), lambda x: x NOT IN ('', 'de'))[-1], '') AS sur FROM q),
      w AS (SELECT work, """ + _PLAIN.format("author") + " AS who, " + _FILE_WORDS.format("concat_ws(' ', author, title)") + r""" AS k FROM w0), s AS (SELECT file, work, least(1.0, round(len(list_intersect(f.k, w.k))::DOUBLE / len(w.k) + CASE WHEN sur <> '' AND contains(who, sur) THEN 0.3 ELSE 0 END, 2)) AS score FROM f, w WHERE len(list_intersect(f.k, w.k)) > 0),
      b AS (SELECT * FROM s WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY file ORDER BY score DESC, work) = 1) SELECT q.file, trim(substr(trim(regexp_replace(title, '[_\s]+', ' ', 'g')), 1, 56), ' -–—,') AS match, b.work, b.score FROM q LEFT JOIN b ON b.file = q.file""",
}

"""Registered queries of the catalogue's rules, built from ``operators.rules``; their DuckDB equivalents are written apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemere.functions import text as T
from pagemere.operators import rules
from pagemere.sources import files
from pagemere.sources.overlay import spark_sql
from pagemere.sources.shared import small_batches


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    small_batches(spark)
    return spark.sql(spark_sql(text, sf_dir))


def _rel(spark, sf_dir, name):
    return sql(spark, sf_dir, f"SELECT * FROM {name}")


def _of(rule, names):
    return rule(*(F.col(n) for n in names))


def c2_citable_reason(spark, sf_dir):
    return _rel(spark, sf_dir, "work").select("id", _of(rules.not_citable_because, ("offset_checked", "offset_problem", "accepted")).alias("reason"))


def c3_numbering_label(spark, sf_dir):
    names = ("offset_checked", "offset_problem", "accepted", "basis")
    return _rel(spark, sf_dir, "work").select("id", _of(rules.numbering, names).alias("numbering"), _of(rules.page_numbers, names).alias("page_numbers"))


def c6_list_code(spark, sf_dir):
    items = sql(spark, sf_dir, "SELECT i.work_id, i.list_id, l.list_key, l.name, s.kind, s.letter, s.title, i.ordinal FROM list_item i JOIN list l ON l.id = i.list_id LEFT JOIN list_section s ON s.id = i.section_id")
    own = ("list_key", "kind", "letter", "ordinal")
    return items.select("work_id", "list_id", _of(rules.workbench_code, own).alias("workbench"), _of(rules.exam_number, own).alias("exam_number"), _of(rules.missing_file_code, ("name", "title", "letter", "ordinal")).alias("missing_file"))


def _stages(spark, sf_dir):
    """Files of stages are told by the work's number, for the given tables have none."""
    return sql(spark, sf_dir, """SELECT w.id, w.path IS NOT NULL AS has_file, w.n % 4 < 3 AS pages_file, w.n % 5 < 2 AS chunks_file, w.n % 6 < 4 AND p.work_id IS NOT NULL AS has_pages, w.n % 10 > 6 AS has_chunks, w.n % 10 = 7 AS unembedded, w.offset_checked, w.offset_problem
      FROM work w LEFT JOIN (SELECT DISTINCT work_id FROM page) p ON p.work_id = w.id""")


def c7_stage_readiness(spark, sf_dir):
    return _stages(spark, sf_dir).select("id", *(c.alias(n) for n, c in rules.stage_ready().items()))


def c8_missing_fields(spark, sf_dir):
    return rules.imprint(_rel(spark, sf_dir, "work")).select("id", F.array_join(rules.missing_fields(), "; ").alias("missing"))


def r7_failing_citation(spark, sf_dir):
    return rules.imprint(_rel(spark, sf_dir, "work")).filter(F.size(rules.missing_fields()) > 0).select("id")


def r23_catalogue_counts(spark, sf_dir):
    why = _of(rules.not_citable_because, ("offset_checked", "offset_problem", "accepted"))
    held = F.col("path").isNotNull()
    counts = {"missing": ~held, "citable": why.isNull(), "held_not_citable": held & why.isNotNull()}
    return _rel(spark, sf_dir, "work").agg(*(F.count_if(c).alias(n) for n, c in counts.items()))


def _states(spark, sf_dir):
    w = sql(spark, sf_dir, "SELECT w.id, w.n, w.path, w.verdict, CASE WHEN w.n % 3 = 0 THEN coalesce(p.pages, 0) ELSE 0 END AS pages FROM work w LEFT JOIN (SELECT work_id, count(*) AS pages FROM page GROUP BY work_id) p ON p.work_id = w.id")
    return w.select("id", rules.register_state(F.col("path"), F.col("verdict"), F.col("pages")).alias("state"), "n")


def l8_register_state(spark, sf_dir):
    return _states(spark, sf_dir).drop("n")


def c9_works_without_file(spark, sf_dir):
    """Works of examined lists whose state is none, queued or not known; every tenth work has none."""
    known = _states(spark, sf_dir).select("id", F.when(F.col("n") % 10 != 9, F.col("state")).alias("state"))
    asked = sql(spark, sf_dir, "SELECT i.work_id AS id, i.list_id FROM list_item i JOIN list l ON l.id = i.list_id AND l.examinable")
    return asked.join(known, "id").filter(F.coalesce(F.col("state").isin("none", "queued"), F.lit(True))).select("id", "list_id", F.coalesce("state", F.lit("unknown")).alias("state"))


def c12_health_level(spark, sf_dir):
    """Characters of each source against an allowance of 3,000 a document."""
    used = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("source").agg((F.sum("n_chars") / (3000.0 * F.count("*"))).alias("share"))
    return used.select("source", rules.quota_level(F.col("share")).alias("level"))


def e9_conflicts(spark, sf_dir):
    rows = sql(spark, sf_dir, "SELECT o_custkey AS work_id, o_orderkey AS line, CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE o_orderpriority END AS pdf FROM {orders}")
    return rules.register_clashes(rows, "work_id", "line", "pdf")


def e6_title_similarity(spark, sf_dir):
    """Each part's name against its name with its type, and its year against the manufacturer's number."""
    p = sql(spark, sf_dir, "SELECT p_partkey, split(p_name, ' ') AS a, split(concat_ws(' ', p_type, substr(p_name, 1, 9)), ' ') AS b, p_size, p_size + p_partkey % 5 AS listed, p_partkey % 3 = 0 AS same FROM {part}")
    alike = rules.title_similarity(F.col("a"), F.col("b"))
    return p.select("p_partkey", F.round(alike, 6).alias("similarity"), F.round(rules.proposal_score(alike, F.col("same"), F.col("p_size"), F.col("listed")), 6).alias("score"))


def fmt9_year(spark, sf_dir):
    texts = sql(spark, sf_dir, """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN concat('Madrid, ', CAST(year(o_orderdate) AS VARCHAR(4)), ', of 1623') WHEN 1 THEN concat('no', CAST(o_orderkey AS VARCHAR(20)), ' 20191')
      WHEN 2 THEN concat('c', CAST(year(o_orderdate) AS VARCHAR(4)), '; 2035; 1499') ELSE concat('1605-', CAST(year(o_orderdate) AS VARCHAR(4)), '.') END AS text FROM {orders}""")
    return texts.select("o_orderkey", rules.year_in(F.col("text")).alias("year"))


def f9_find_works(spark, sf_dir):
    """Folded search over id, author and title; all are counted, 25 are shown."""
    w = _rel(spark, sf_dir, "work")
    hits = w.filter(T.folded(F.concat_ws(" ", "id", "author", "title"), "a").contains("author1"))
    shown = hits.select("id", "title").orderBy("id").limit(25)
    return shown.join(F.broadcast(hits.agg(F.count("*").alias("found"))), F.lit(True))


def f10_catalogue_filters(spark, sf_dir):
    """Text over author, title, container and id, and stars; asking for unrated works overrides the least stars."""
    w = sql(spark, sf_dir, "SELECT w.id, w.priority, lower(concat_ws(' ', w.author, w.title, c.title, w.id)) AS t FROM work w LEFT JOIN work c ON c.id = w.container_id")
    w = w.filter(F.col("t").contains("src1"))
    return w.filter("priority >= 3").select("id", F.lit("stars").alias("asked")).union(w.filter("priority is null").select("id", F.lit("unrated").alias("asked")))


def f12_catalogue_page(spark, sf_dir):
    w = _rel(spark, sf_dir, "work").select("id", "path", "container_id")
    asked = {"missing": "path is null", "held": "path is not null", "contained": "container_id is not null"}
    return w.select("id", F.explode(F.array_compact(F.array(*(F.when(F.expr(c), n) for n, c in asked.items())))).alias("asked"))


def f14_local_day(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", rules.local_day(F.col("ts").cast("timestamp")).alias("day"))
    first = e.agg(F.date_add(F.min("day"), 1).alias("day"))
    return e.join(F.broadcast(first), "day").select("event_id")


def t2_capped_scan(spark, sf_dir):
    """English chunks in page order, at most 3,000, the feature's own cap; capped if it is reached."""
    return capped_scan(_rel(spark, sf_dir, "chunk"))


def capped_scan(chunks: DataFrame, limit: int = 3000) -> DataFrame:
    english = chunks.filter("lang = 'en'").select("chunk_id", "start_page")
    reached = english.limit(limit).agg((F.count("*") >= limit).alias("capped"))
    return english.orderBy("start_page", "chunk_id").limit(limit).join(F.broadcast(reached), F.lit(True))


def _memberships(spark, sf_dir):
    return sql(spark, sf_dir, "SELECT p.parent_id AS axis_id, nw.work_id, p.id AS part_id, nw.role, p.kind AS part_kind FROM note p JOIN note_work nw ON nw.note_id = p.id JOIN note a ON a.id = p.parent_id AND a.kind = 'axis'")


def t4_distinct_on(spark, sf_dir):
    """For each axis of a work one membership, a ficha's if there is one."""
    return rules.preferred(_memberships(spark, sf_dir), ["axis_id", "work_id"], F.col("role") == "ficha", [F.col("part_id")])


def r11_axis_members(spark, sf_dir):
    """Works of each axis by their strongest part: a ficha beats a synthesis."""
    return rules.preferred(_memberships(spark, sf_dir).select("axis_id", "work_id", "part_kind", "part_id"), ["axis_id", "work_id"], F.col("part_kind") == "ficha", [F.col("part_kind"), F.col("part_id")])


def t7_spanish_order(spark, sf_dir):
    """Places of names within each region in Spanish order, where Ñ follows N."""
    names = sql(spark, sf_dir, "SELECT n_regionkey, n_nationkey, concat(CASE n_nationkey % 4 WHEN 0 THEN 'ñ' WHEN 1 THEN 'nz' WHEN 2 THEN 'Á' ELSE 'o' END, lower(n_name)) AS name FROM {nation}")
    nth = F.row_number().over(Window.partitionBy("n_regionkey").orderBy(F.collate("name", "es"), "n_nationkey"))
    return names.select("n_nationkey", "name", nth.alias("nth"))


def t8_in_order_of_ids(spark, sf_dir):
    return rules.in_order_of(_rel(spark, sf_dir, "work").select("id", "title"), "id", ["src9", "src2", "nowhere", "src14", "src2"]).select("place", "id", "title")


def r3_lists_and_sections(spark, sf_dir):
    return sql(spark, sf_dir, "SELECT l.id AS list_id, l.name, s.id AS section_id, s.letter, row_number() OVER (PARTITION BY l.id ORDER BY s.sort) AS nth FROM list l LEFT JOIN list_section s ON s.list_id = l.id")


def r13_revisions(spark, sf_dir):
    """Orders as revisions of their customers, the newest first."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return o.select("o_custkey", "o_orderkey", nth.alias("nth"))


def r24_blocked_works(spark, sf_dir):
    """Works with a file that stages leave alone, and those that they may take."""
    w = _rel(spark, sf_dir, "work").filter("path is not null")
    alone = w.filter("kind = 'film'").select("id")
    return w.join(alone, "id", "left_semi").select("id", F.lit("blocked").alias("part")).union(w.join(alone, "id", "left_anti").select("id", F.lit("open").alias("part")))


def w14_form_fields(spark, sf_dir):
    """Order comments and keys as a form's fields: blanks are null, numbers whole or null, ids once each."""
    o = sql(spark, sf_dir, """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '  ' WHEN 1 THEN ' 42 ' WHEN 2 THEN '4.5' WHEN 3 THEN concat('-', CAST(o_orderkey AS VARCHAR(9))) ELSE 'x' END AS field,
      concat(o_orderstatus, ', ,', o_orderstatus, ',b') AS ids FROM {orders}""")
    return o.select("o_orderkey", rules.blank(F.col("field")).alias("text"), rules.whole_number(F.col("field")).alias("number"), F.array_join(rules.id_list(F.col("ids")), "|").alias("ids"))


def snk12_works_export(spark, sf_dir):
    out = rules.works_export(_rel(spark, sf_dir, "work"), _rel(spark, sf_dir, "list_item"), _rel(spark, sf_dir, "list"))
    return out.select("id", "title", "author", "editor", "container_title", F.coalesce("lists", F.lit("")).alias("lists"), "missing")


def snk13_notes_export(spark, sf_dir):
    relations = sql(spark, sf_dir, "SELECT note_id, 'passage' AS relation, '' AS role, work_id, printed_page, quote FROM anchor UNION ALL SELECT note_id, 'work', role, work_id, CAST(NULL AS INT), CAST(NULL AS VARCHAR(99)) FROM note_work")
    return rules.notes_export(_rel(spark, sf_dir, "note"), relations, _rel(spark, sf_dir, "work"))


def x6_quotation(spark, sf_dir):
    """Documents as captured passages; each n that a blank and a letter follow is broken over a line."""
    broken = F.regexp_replace("text", "n ([a-z])", "n-\n $1")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(T.quotation(broken)).alias("digest"))


def src11_listing(spark, sf_dir):
    paths = sql(spark, sf_dir, "SELECT concat('/c/', n_regionkey, '/', CASE n_nationkey % 5 WHEN 0 THEN '.' WHEN 1 THEN ' ' ELSE '' END, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE lower(n_name) END, CASE n_nationkey % 7 WHEN 0 THEN '.txt' WHEN 1 THEN '.EPUB' ELSE '.Pdf' END) AS path FROM {nation} UNION ALL SELECT concat('/d/', lower(n_name), '.pdf') FROM {nation}")
    return files.listed(paths).select("key", F.array_join("paths", "|").alias("paths"))


_ALL = (
    x6_quotation, src11_listing,
    c2_citable_reason, c3_numbering_label, c6_list_code, c7_stage_readiness, c8_missing_fields, r7_failing_citation, r23_catalogue_counts, l8_register_state, c9_works_without_file,
    c12_health_level, e9_conflicts, e6_title_similarity, fmt9_year, f9_find_works, f10_catalogue_filters, f12_catalogue_page, f14_local_day, t2_capped_scan, t4_distinct_on,
    r11_axis_members, t7_spanish_order, t8_in_order_of_ids, r3_lists_and_sections, r13_revisions, r24_blocked_works, w14_form_fields, snk12_works_export, snk13_notes_export,
)
QUERIES = {f.__name__: f for f in _ALL}

_IMPRINT = """im AS (SELECT w.*, CASE WHEN c.id IS NULL THEN w.publisher ELSE c.publisher END AS ip, CASE WHEN c.id IS NULL THEN w.place ELSE c.place END AS ic, CASE WHEN c.id IS NULL THEN w.year ELSE c.year END AS iy,
  CASE WHEN c.id IS NULL THEN w.editor ELSE c.editor END AS ie, c.title AS container_title FROM work w LEFT JOIN work c ON c.id = w.container_id)"""
_LACKS = """array_to_string(list_filter([CASE WHEN author IS NULL AND editor IS NULL AND ie IS NULL THEN 'author' END, CASE WHEN kind <> 'film' AND ip IS NULL THEN 'publisher' END,
  CASE WHEN kind <> 'film' AND ic IS NULL THEN 'place' END, CASE WHEN CASE WHEN kind = 'film' THEN year ELSE iy END IS NULL THEN 'year' END, CASE WHEN url IS NOT NULL AND accessed IS NULL THEN 'access date' END], lambda x: x IS NOT NULL), '; ')"""
_FILED = "st AS (SELECT w.id, w.n, CASE WHEN w.path IS NULL THEN 'none' WHEN w.n % 3 = 0 AND EXISTS (SELECT 1 FROM page p WHERE p.work_id = w.id) THEN 'loaded' WHEN w.n % 7 = 3 THEN 'queued' ELSE 'ready' END AS state FROM work w)"
_PART_OF = "mem AS (SELECT p.parent_id AS axis_id, nw.work_id, p.id AS part_id, nw.role, p.kind AS part_kind FROM note p JOIN note_work nw ON nw.note_id = p.id JOIN note a ON a.id = p.parent_id WHERE a.kind = 'axis')"
_ROMAN = "[NULL, 'I', 'II', 'III'][1 + CASE WHEN i.list_id < 3 THEN i.list_id + 1 ELSE 0 END]"

ORACLE = {
    "x6_quotation": "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'n ([a-z])', 'n\\1', 'g'), '[\u2070\u00b9\u00b2\u00b3\u2074-\u2079]+', '', 'g'), '(\\pL)[-\u2010\u2011]\\s*\\n\\s*(\\pL)', '\\1\\2', 'g'), '\\s*\\n\\s*', ' ', 'g'), '[ \\t]+', ' ', 'g'))) AS digest FROM {documents}",
    "src11_listing": """SELECT lower(trim(name)) AS key, string_agg(path, '|' ORDER BY path) AS paths FROM (SELECT path, string_split(path, '/')[-1] AS name FROM (SELECT '/c/' || n_regionkey || '/' || ['.', ' ', '', '', ''][1 + (n_nationkey % 5)::INT] || CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE lower(n_name) END || CASE n_nationkey % 7 WHEN 0 THEN '.txt' WHEN 1 THEN '.EPUB' ELSE '.Pdf' END AS path FROM {nation}
      UNION ALL SELECT '/d/' || lower(n_name) || '.pdf' FROM {nation})) x WHERE name NOT LIKE '.%' AND NOT path LIKE '%.txt' GROUP BY 1""",
    "c2_citable_reason": "SELECT id, CASE WHEN offset_problem IS NULL OR accepted THEN (CASE WHEN offset_checked THEN NULL ELSE 'page numbering never checked' END) ELSE 'page numbering unsettled: ' || offset_problem END AS reason FROM work",
    "c3_numbering_label": """SELECT id, CASE (offset_problem IS NOT NULL)::INT * 2 + accepted::INT WHEN 3 THEN 'accepted (' || CASE WHEN basis = 'hand_set' THEN 'hand set' ELSE 'no printed numbers' END || ')' WHEN 2 THEN 'problem: ' || offset_problem ELSE CASE WHEN offset_checked THEN 'checked' ELSE 'unchecked' END END AS numbering,
      CASE WHEN basis = 'hand_set' THEN 'hand set' WHEN offset_problem IS NULL THEN CASE WHEN offset_checked THEN 'verified' ELSE 'unchecked' END WHEN accepted THEN 'unverified: the file''s own page, not the edition''s' ELSE 'unverified: numbering unsettled' END AS page_numbers FROM work""",
    "c6_list_code": f"""SELECT i.work_id, i.list_id, CASE WHEN i.list_id < 3 THEN CASE WHEN s.kind = 'supplementary' THEN 'Supl. ' || {_ROMAN} ELSE {_ROMAN} || '.' || coalesce(s.letter, '?') || '.' || coalesce(i.ordinal::VARCHAR, '?') END END AS workbench,
      CASE WHEN i.list_id < 3 THEN {_ROMAN} || '.' || CASE WHEN s.kind = 'supplementary' THEN 'Supl' ELSE coalesce(s.letter, '?') END || '.' || coalesce(i.ordinal::VARCHAR, '?') END AS exam_number,
      string_split(l.name, '.')[1] || '.' || CASE WHEN s.title = 'Supplementary' THEN 'Supl' ELSE coalesce(s.letter, '') END || '.' || coalesce(i.ordinal::VARCHAR, 'null') AS missing_file
      FROM list_item i JOIN list l ON l.id = i.list_id LEFT JOIN list_section s ON s.id = i.section_id""",
    "c7_stage_readiness": """SELECT id, path IS NOT NULL AND NOT pf AND NOT hp AS extract, pf AND NOT cf AND NOT hc AS chunk, pf AND NOT hp AS load_pages, hp AND NOT hc AND NOT offset_checked AS offsets, hp AND ok AND NOT hc AS load_sections, hp AND ok AND NOT hc AS load_chunks, n % 10 = 7 AND ok AS embed
      FROM (SELECT *, n % 4 <> 3 AS pf, n % 5 IN (0, 1) AS cf, n % 6 NOT IN (4, 5) AND id IN (SELECT work_id FROM page) AS hp, n % 10 IN (7, 8, 9) AS hc, offset_checked AND offset_problem IS NULL AS ok FROM work) x""",
    "c8_missing_fields": f"WITH {_IMPRINT} SELECT id, {_LACKS} AS missing FROM im",
    "r7_failing_citation": f"WITH {_IMPRINT} SELECT id FROM im WHERE NOT (coalesce(author, editor, ie) IS NOT NULL AND CASE WHEN kind = 'film' THEN year IS NOT NULL ELSE ip IS NOT NULL AND ic IS NOT NULL AND iy IS NOT NULL END AND (url IS NULL OR accessed IS NOT NULL))",
    "r23_catalogue_counts": "SELECT count(*) FILTER (path IS NULL) AS missing, count(*) FILTER (ok) AS citable, count(*) FILTER (path IS NOT NULL AND NOT ok) AS held_not_citable FROM (SELECT path, offset_checked AND (offset_problem IS NULL OR accepted) AS ok FROM work) x",
    "l8_register_state": f"WITH {_FILED} SELECT id, state FROM st",
    "c9_works_without_file": f"WITH {_FILED} SELECT s.id, i.list_id, CASE WHEN s.n % 10 = 9 THEN 'unknown' ELSE s.state END AS state FROM st s JOIN list_item i ON i.work_id = s.id WHERE i.list_id IN (SELECT id FROM list WHERE examinable) AND (s.n % 10 = 9 OR s.state NOT IN ('loaded', 'ready'))",
    "c12_health_level": "SELECT source, ['ok', 'warn', 'fail'][1 + (avg(n_chars) / 3000.0 >= 0.7)::INT + (avg(n_chars) / 3000.0 >= 0.85)::INT] AS level FROM {documents} GROUP BY source",
    "e9_conflicts": "WITH r AS (SELECT o_custkey AS work_id, o_orderpriority AS other, first_value(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS kept FROM {orders} WHERE o_orderkey % 5 <> 0) SELECT work_id, kept, other FROM r WHERE kept <> other",
    "e6_title_similarity": """WITH t AS (SELECT p_partkey, p_size, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(p_type || ' ' || substr(p_name, 1, 9), ' ')) AS b FROM {part}), s AS (SELECT *, len(list_intersect(a, b))::DOUBLE / least(len(a), len(b)) AS x FROM t)
      SELECT p_partkey, round(x, 6) AS similarity, round(x + CASE WHEN p_partkey % 3 = 0 THEN 0.35 ELSE 0 END + CASE WHEN p_partkey % 5 < 3 THEN 0.15 ELSE 0 END, 6) AS score FROM s""",
    "fmt9_year": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '1623' WHEN 3 THEN year(o_orderdate)::VARCHAR END AS year FROM {orders}",
    "f9_find_works": "SELECT id, title, (SELECT count(*) FROM work WHERE n % 6 = 1 AND n % 5 <> 4) AS found FROM work WHERE n % 6 = 1 AND n % 5 <> 4 ORDER BY id LIMIT 25",
    "f10_catalogue_filters": "SELECT w.id, CASE WHEN w.priority IS NULL THEN 'unrated' ELSE 'stars' END AS asked FROM work w LEFT JOIN work c ON c.id = w.container_id WHERE (w.priority IS NULL OR w.priority >= 3) AND (contains(w.title, 'src1') OR contains(w.id, 'src1') OR contains(c.title, 'src1'))",
    "f12_catalogue_page": "SELECT id, CASE WHEN path IS NULL THEN 'missing' ELSE 'held' END AS asked FROM work UNION ALL SELECT id, 'contained' FROM work WHERE container_id IN (SELECT id FROM work) OR container_id IS NOT NULL",
    "f14_local_day": "WITH e AS (SELECT event_id, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Denver' AS DATE) AS day FROM {events}) SELECT event_id FROM e WHERE day = (SELECT min(day) + 1 FROM e)",
    "t2_capped_scan": "SELECT chunk_id, start_page, count(*) OVER () >= 3000 AS capped FROM chunk WHERE lang = 'en' ORDER BY start_page, chunk_id LIMIT 3000",
    "t4_distinct_on": f"WITH {_PART_OF} SELECT DISTINCT ON (axis_id, work_id) axis_id, work_id, part_id, role, part_kind FROM mem ORDER BY axis_id, work_id, role = 'ficha' DESC, part_id",
    "r11_axis_members": f"WITH {_PART_OF} SELECT axis_id, work_id, part_kind, part_id FROM mem QUALIFY row_number() OVER (PARTITION BY axis_id, work_id ORDER BY part_kind = 'ficha' DESC, part_kind, part_id) = 1",
    "t7_spanish_order": "SELECT n_nationkey, name, row_number() OVER (PARTITION BY n_regionkey ORDER BY name COLLATE es, n_nationkey)::INT AS nth FROM (SELECT n_regionkey, n_nationkey, ['ñ', 'nz', 'Á', 'o'][1 + (n_nationkey % 4)::INT] || lower(n_name) AS name FROM {nation})",
    "t8_in_order_of_ids": "SELECT v.place, w.id, w.title FROM (VALUES (0, 'src9'), (1, 'src2'), (3, 'src14')) v(place, id) JOIN work w ON w.id = v.id",
    "r3_lists_and_sections": "SELECT r_regionkey::INT AS list_id, r_name AS name, n_nationkey::INT AS section_id, CASE WHEN n_nationkey % 3 > 0 THEN substr(n_name, 1, 1) END AS letter, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey)::INT AS nth FROM {region} LEFT JOIN {nation} ON n_regionkey = r_regionkey",
    "r13_revisions": "SELECT o_custkey, o_orderkey, (1 + count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT AS nth FROM {orders}",
    "r24_blocked_works": "SELECT id, CASE kind WHEN 'film' THEN 'blocked' ELSE 'open' END AS part FROM work WHERE path IS NOT NULL",
    "w14_form_fields": "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN '42' WHEN 2 THEN '4.5' WHEN 3 THEN '-' || o_orderkey WHEN 4 THEN 'x' END AS text, (CASE o_orderkey % 5 WHEN 1 THEN 42 WHEN 3 THEN -o_orderkey END)::INT AS number, o_orderstatus || '|b' AS ids FROM {orders}",
    "snk12_works_export": f"WITH {_IMPRINT} SELECT id, title, author, editor, container_title, coalesce((SELECT string_agg(DISTINCT l.name, '; ' ORDER BY l.name) FROM list_item i JOIN list l ON l.id = i.list_id WHERE i.work_id = im.id), '') AS lists, {_LACKS} AS missing FROM im",
    "snk13_notes_export": """WITH tops AS (SELECT id, CASE kind WHEN 'axis' THEN 'thesis' ELSE kind END AS kind, CASE kind WHEN 'axis' THEN title ELSE '' END AS axis, attribution, origin, reviewed FROM note WHERE parent_id IS NULL),
      parts AS (SELECT p.id, p.kind, a.title AS axis, p.attribution, p.origin, p.reviewed FROM note p JOIN note a ON a.id = p.parent_id AND a.kind = 'axis' WHERE a.parent_id IS NULL AND (p.kind = 'ficha' OR (p.kind IN ('synthesis', 'exam_move') AND p.id = (SELECT min(q.id) FROM note q WHERE q.parent_id = p.parent_id AND q.kind = p.kind)))),
      told AS (SELECT * FROM tops UNION ALL SELECT * FROM parts),
      rel AS (SELECT note_id, 'passage' AS relation, '' AS role, work_id, printed_page, quote FROM anchor UNION ALL SELECT note_id, 'work', role, work_id, NULL, NULL FROM note_work),
      named AS (SELECT rel.*, w.title, CASE WHEN printed_page IS NULL THEN '' WHEN basis = 'hand_set' THEN 'hand set' WHEN offset_problem IS NOT NULL THEN 'no' WHEN w.id IS NOT NULL THEN 'yes' ELSE 'yes' END AS verified FROM rel LEFT JOIN work w ON w.id = rel.work_id)
      SELECT t.id AS note_id, t.kind, t.axis, coalesce(r.relation, '') AS relation, coalesce(r.role, '') AS role, (SELECT count(*) FROM rel x WHERE x.note_id = t.id) AS relations_in_note,
      coalesce((SELECT string_agg(DISTINCT x.title, '; ' ORDER BY x.title) FROM named x WHERE x.note_id = t.id AND x.title IS DISTINCT FROM r.title), CASE WHEN r.note_id IS NULL THEN NULL ELSE '' END) AS also_touching,
      coalesce(r.work_id, '') AS work_id, r.printed_page, coalesce(r.verified, '') AS page_verified, r.quote, coalesce(t.attribution, 'UNCLASSIFIED') AS whose_claim,
      CASE WHEN t.origin = 'human' THEN 'written by hand' WHEN t.reviewed THEN 'found by the assistant, confirmed by a person' ELSE 'assistant proposal, UNREVIEWED' END AS provenance
      FROM told t LEFT JOIN named r ON r.note_id = t.id""",
}

"""Registered queries of writes on notes, works and projects: the tables after many requests at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemere.functions import layout
from pagemere.operators import notes, writes
from pagemere.plans.catalogue import _rel, sql


def _notes(spark, sf_dir):
    return sql(spark, sf_dir, "SELECT id, CASE WHEN kind = 'question' THEN 'note' ELSE kind END AS kind, parent_id, turn AS ordinal, rejected FROM note")


def _forms(spark, sf_dir):
    return sql(spark, sf_dir, """SELECT o_orderkey AS form_id, array(concat('src', CAST(o_orderkey % 22 AS STRING)), ' ', concat('src', CAST(o_custkey % 20 AS STRING)), concat('src', CAST(o_orderkey % 22 AS STRING))) AS work_ids, CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE o_orderstatus END AS body,
      CASE WHEN o_orderkey % 3 = 0 THEN 'question' ELSE 'axis' END AS kind, CASE WHEN o_orderkey % 4 = 0 THEN 7 END AS printed_page, CASE WHEN o_orderkey % 5 = 0 THEN 'q' ELSE '' END AS quote, CASE o_orderkey % 7 WHEN 0 THEN 'other' WHEN 1 THEN 'own' END AS attribution, o_orderpriority AS attributed_to FROM {orders}""")  # noqa: E501


def w5_form_notes(spark, sf_dir):
    asked, refused = notes.from_forms(_forms(spark, sf_dir), _rel(spark, sf_dir, "work"))
    got = asked.select("form_id", "kind", "attributed_to", F.array_join(F.transform("anchors", lambda a: F.concat(a["work_id"], F.lit(":"), F.coalesce(a["printed_page"].cast("string"), F.lit("")))), ",").alias("anchored"), F.array_join("works.work_id", ",").alias("about"), F.lit(None).cast("string").alias("why"))
    return got.union(refused.select("form_id", F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), "why"))


def _asked(spark, sf_dir):
    return sql(spark, sf_dir, """SELECT o_orderkey AS form_id, CASE o_orderkey % 3 WHEN 0 THEN 'ficha' WHEN 1 THEN 'synthesis' ELSE 'note' END AS kind, CASE WHEN o_orderkey % 3 < 2 THEN CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE n.id END END AS parent_id, o_orderpriority AS body, CASE WHEN o_orderkey % 7 < 2 THEN 'other' END AS attribution, CASE WHEN o_orderkey % 7 = 1 OR o_orderkey % 7 = 2 THEN 'x' END AS attributed_to,
      CAST(array() AS ARRAY<STRUCT<work_id: STRING, printed_page: INT, quote: STRING>>) AS anchors, CASE WHEN o_orderkey % 5 = 0 THEN CAST(array() AS ARRAY<STRUCT<work_id: STRING, role: STRING>>) ELSE array(named_struct('work_id', 'src1', 'role', 'ficha'), named_struct('work_id', 'src1', 'role', 'about')) END AS works
      FROM {orders} LEFT JOIN (SELECT min(id) AS id FROM note WHERE kind = 'axis') n ON true""")


def w4_created_notes(spark, sf_dir):
    rows, _, works, refused = notes.create(_notes(spark, sf_dir), _asked(spark, sf_dir))
    got = rows.join(works, F.col("id") == F.col("note_id"), "left").select("id", "kind", "parent_id", rows.ordinal, "attributed_to", works.work_id, works.role)
    return got.withColumn("why", F.lit(None).cast("string")).unionByName(refused.select(F.col("form_id").alias("id"), "why"), allowMissingColumns=True)


def _promotions(spark, sf_dir):
    """Every note is asked to move to the first axis but one, each tenth to a note that is no axis."""
    return sql(spark, sf_dir, "SELECT n.id AS note_id, CASE WHEN n.n % 10 = 9 THEN -5 ELSE a.id END AS axis_id FROM note n LEFT JOIN (SELECT max(id) AS id FROM note WHERE kind = 'axis') a ON true WHERE n.kind <> 'axis'")


def w9_promoted(spark, sf_dir):
    after, _, refused = notes.promote(_notes(spark, sf_dir), _rel(spark, sf_dir, "anchor"), _rel(spark, sf_dir, "note_work"), _promotions(spark, sf_dir))
    return after.select("id", "kind", "parent_id", "ordinal").join(refused.select(F.col("note_id").alias("id"), "why"), "id", "left")


def w9_demoted(spark, sf_dir):
    ids = sql(spark, sf_dir, "SELECT id AS note_id FROM note WHERE n % 2 = 1")
    after, works = notes.demote(_notes(spark, sf_dir), _rel(spark, sf_dir, "note_work"), ids)
    return works.join(after.select(F.col("id").alias("note_id"), "kind", "parent_id"), "note_id")


def w8_linked(spark, sf_dir):
    new = sql(spark, sf_dir, "SELECT id AS from_note, id - turn % 2 AS to_note, 'answers' AS kind FROM note WHERE turn > 0")
    return notes.link(_rel(spark, sf_dir, "note_link"), new, both_ways=True)


def w3_stub_works(spark, sf_dir):
    asked = sql(spark, sf_dir, "SELECT n_nationkey AS form_id, CASE WHEN n_nationkey % 6 = 5 THEN ' ' ELSE concat('Land ', CAST(n_regionkey AS STRING)) END AS title, CASE WHEN n_nationkey % 2 = 0 THEN 'Surname, G.' END AS author, 1990 AS year, CASE n_nationkey % 4 WHEN 0 THEN 'src2' WHEN 1 THEN 'nowhere' END AS container_id FROM {nation}")
    made, refused = notes.stub_works(_rel(spark, sf_dir, "work"), asked, layout.slug(F.col("author"), F.col("title"), F.col("year")))
    return made.select("id", "author", "container_id", F.lit(None).cast("bigint").alias("form_id"), F.lit(None).cast("string").alias("why")).union(refused.select(F.lit(None), F.lit(None), F.lit(None), "form_id", "why"))


def w6_next_anchors(spark, sf_dir):
    """Anchors put in by note and ordinal, and one after the last of each note."""
    a = _rel(spark, sf_dir, "anchor").select("note_id", F.col("ordinal").cast("int").alias("ordinal"), "work_id")
    more = a.groupBy("note_id").agg((F.max("ordinal") + 1).alias("ordinal")).withColumn("work_id", F.lit("src0"))
    changed = a.filter("work_id = 'src3'").withColumn("work_id", F.lit("src4"))
    return writes.upsert(a, more.unionByName(changed), ["note_id", "ordinal"])


def w13_project_deleted(spark, sf_dir):
    projects, tables = notes.project_delete(_rel(spark, sf_dir, "project"), {n: _rel(spark, sf_dir, n) for n in ("project_work", "project_note")}, 3)
    works, of = (tables[n].groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias(c)) for n, c in (("project_work", "works"), ("project_note", "notes")))
    return projects.join(works, "id", "left").join(of, "id", "left")


_ALL = (w3_stub_works, w4_created_notes, w5_form_notes, w6_next_anchors, w8_linked, w9_promoted, w9_demoted, w13_project_deleted)
QUERIES = {f.__name__: f for f in _ALL}

_KIND = "CASE kind WHEN 'question' THEN 'note' ELSE kind END"
ORACLE = {
    "w5_form_notes": """WITH f AS (SELECT o_orderkey AS k, 'src' || (o_orderkey % 22) AS a, 'src' || (o_custkey % 20) AS b, o_orderkey % 13 = 0 AS empty, o_orderkey % 4 = 0 AS paged, o_orderkey % 5 = 0 AS quoted, o_orderpriority FROM {orders}), g AS (SELECT *, CASE WHEN empty THEN 'a note needs a body' WHEN least(a NOT IN (SELECT id FROM work), true) AND (b IN (SELECT id FROM work) OR a <= b) THEN 'no work with id ' || a WHEN b NOT IN (SELECT id FROM work) THEN 'no work with id ' || b END AS why, CASE WHEN a = b THEN '' ELSE b END AS rest FROM f)
      SELECT k AS form_id, CASE WHEN why IS NULL THEN CASE WHEN k % 3 = 0 THEN 'question' ELSE 'note' END END AS kind, CASE WHEN why IS NULL AND k % 7 = 0 THEN o_orderpriority END AS attributed_to, CASE WHEN why IS NULL THEN CASE WHEN paged OR quoted THEN a || ':' || CASE WHEN paged THEN '7' ELSE '' END ELSE '' END END AS anchored,
      CASE WHEN why IS NULL THEN CASE WHEN paged OR quoted THEN rest WHEN rest = '' THEN a ELSE a || ',' || rest END END AS about, why FROM g""",
    "w4_created_notes": """WITH x AS (SELECT o_orderkey AS k, o_orderkey % 3 AS t, (SELECT max(id) FROM note) AS last, (SELECT min(id) FROM note WHERE kind = 'axis') AS axis FROM {orders}),
      y AS (SELECT *, CASE WHEN t = 0 AND k % 5 = 0 THEN 'a ficha names at least one work' WHEN k % 7 = 2 THEN 'attributed_to only means something when someone else says it' WHEN t < 2 AND (k % 11 = 0 OR axis IS NULL) AND CASE WHEN k % 11 = 0 THEN -1 ELSE axis END IS NOT NULL THEN 'the parent is not an axis' END AS why FROM x),
      z AS (SELECT *, ['ficha', 'synthesis', 'note'][1 + t::INT] AS kind, CASE WHEN t < 2 THEN axis END AS parent FROM y WHERE why IS NULL)
      SELECT z.last + 1 + z.k AS id, z.kind, z.parent AS parent_id, CASE WHEN z.parent IS NOT NULL THEN row_number() OVER (PARTITION BY z.parent, z.kind ORDER BY z.k) + coalesce((SELECT max(n.turn) FROM note n WHERE n.parent_id = z.parent AND n.kind = z.kind), 0) END::INT AS ordinal, CASE WHEN z.k % 7 = 1 THEN 'x' END AS attributed_to,
      CASE WHEN z.k % 5 <> 0 THEN 'src1' END AS work_id, CASE WHEN z.k % 5 <> 0 THEN 'ficha' END AS role, NULL AS why FROM z UNION ALL SELECT k, NULL, NULL, NULL, NULL, NULL, NULL, why FROM y WHERE why IS NOT NULL""",
    "w9_promoted": f"""WITH t AS (SELECT DISTINCT note_id FROM touch), ax AS (SELECT max(id) AS id FROM note WHERE kind = 'axis'), r AS (SELECT n.id, CASE WHEN n.kind = 'axis' THEN NULL WHEN n.id NOT IN (SELECT note_id FROM t) THEN 'the note has to touch a work first' WHEN {_KIND.replace('kind', 'n.kind')} <> 'note' OR n.rejected THEN 'only a plain note can become a ficha' WHEN n.n % 10 = 9 OR ax.id IS NULL THEN 'the parent is not an axis' END AS why, n.kind <> 'axis' AS asked, ax.id AS axis, {_KIND.replace('kind', 'n.kind')} AS kind, n.parent_id, n.turn FROM note n, ax)
      SELECT id, CASE WHEN asked AND why IS NULL THEN 'ficha' ELSE kind END AS kind, CASE WHEN asked AND why IS NULL THEN axis ELSE parent_id END AS parent_id, (CASE WHEN asked AND why IS NULL THEN count(*) FILTER (asked AND why IS NULL) OVER (ORDER BY id) + coalesce((SELECT max(turn) FROM note f WHERE f.kind = 'ficha' AND f.parent_id = axis), 0) ELSE turn END)::INT AS ordinal, why FROM r""",
    "w9_demoted": f"SELECT w.note_id, w.work_id, CASE WHEN n.kind = 'ficha' AND n.n % 2 = 1 AND w.role = 'ficha' THEN 'about' ELSE w.role END AS role, CASE WHEN n.kind = 'ficha' AND n.n % 2 = 1 THEN 'note' ELSE {_KIND.replace('kind', 'n.kind')} END AS kind, CASE WHEN n.kind = 'ficha' AND n.n % 2 = 1 THEN NULL ELSE n.parent_id END AS parent_id FROM note_work w JOIN note n ON n.id = w.note_id",
    "w8_linked": "SELECT DISTINCT a AS from_note, b AS to_note, 'answers' AS kind FROM (SELECT id AS a, id - 1 AS b FROM note WHERE turn % 2 = 1 UNION ALL SELECT id - 1, id FROM note WHERE turn % 2 = 1) x WHERE NOT EXISTS (SELECT 1 FROM note_link l WHERE l.from_note = x.a AND l.to_note = x.b AND l.kind = 'answers')",
    "w3_stub_works": """WITH a AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 6 <> 5 THEN 'land-' || n_regionkey || '-1990' ELSE '1990' END AS s, n_nationkey % 2 = 0 AS named, n_nationkey % 6 = 5 AS untitled, n_nationkey % 4 AS c FROM {nation}), b AS (SELECT *, CASE WHEN named THEN 'g-' || s ELSE s END AS id0 FROM a),
      d AS (SELECT *, regexp_replace(id0, '^g-', 'surname-') AS id FROM b), e AS (SELECT *, CASE WHEN untitled THEN 'a work needs a title' WHEN k > min(k) OVER (PARTITION BY id) THEN 'there is a work with id ' || id WHEN c = 1 THEN 'no work with id nowhere' END AS why FROM d)
      SELECT CASE WHEN why IS NULL THEN id END AS id, CASE WHEN why IS NULL AND named THEN 'Surname, G.' END AS author, CASE WHEN why IS NULL AND c = 0 THEN 'src2' END AS container_id, CASE WHEN why IS NOT NULL THEN k END AS form_id, why FROM e""",
    "w6_next_anchors": "SELECT note_id, 1 AS ordinal, CASE work_id WHEN 'src3' THEN 'src4' ELSE work_id END AS work_id FROM anchor UNION ALL SELECT DISTINCT note_id, 2, 'src0' FROM anchor",
    "w13_project_deleted": "SELECT p.id, p.name, (SELECT nullif(count(*), 0) FROM project_work w WHERE w.project_id = p.id) AS works, (SELECT nullif(count(*), 0) FROM project_note w WHERE w.project_id = p.id) AS notes FROM project p WHERE p.id <> 3",
}

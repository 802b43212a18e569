"""Registered queries of folded requests and changed lists; their DuckDB equivalents are written apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemere.operators import relist, requests
from pagemere.plans.catalogue import sql

_RECORDS = """SELECT p_partkey AS id, 'new' AS status, CAST(p_size AS INT) AS page_offset, CASE WHEN p_partkey % 3 = 0 THEN 'hand_set' END AS basis, p_brand AS author, 'Press' AS publisher, CASE WHEN p_partkey % 2 = 0 THEN 'Town' END AS place, 1900 + CAST(p_size AS INT) AS year,
  CAST(NULL AS VARCHAR(9)) AS isbn, CASE WHEN p_partkey % 5 > 0 THEN CAST(p_partkey % 5 AS INT) END AS priority, 'note' AS standing_note, 'core' AS standing FROM {part}"""
# numbers of lines repeat within an order; a number is one request here
_LINES = "(SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey, max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus, max(l_quantity) AS l_quantity FROM {lineitem} GROUP BY l_orderkey, l_linenumber)"
_ASKED = """SELECT l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_orderkey % 50 = 1 THEN -l_partkey ELSE l_partkey END AS id, CASE l_linenumber WHEN 1 THEN 'status' WHEN 2 THEN 'imprint' WHEN 3 THEN 'rating' WHEN 4 THEN 'characterization' WHEN 5 THEN 'acceptance' WHEN 6 THEN CASE WHEN l_orderkey % 2 = 0 THEN 'offset' ELSE 'other' END ELSE 'standing_note' END AS action,
  l_linestatus AS mode, l_returnflag AS flag, CAST(CAST(l_quantity AS INT) AS VARCHAR(9)) AS q, l_orderkey AS o FROM """ + _LINES + " x"


def w1_folded_setters(spark, sf_dir):
    """Every line of an order is a request on its part; refusals follow with their reasons."""
    a, c = sql(spark, sf_dir, _ASKED), F.col
    given = {
        "status": c("flag"), "author": F.when(c("flag") != "N", F.concat(F.lit("Author "), c("q"))), "publisher": F.lit(" "), "place": c("mode"), "year": F.when(c("o") % 7 == 0, F.lit("c1900")).otherwise(c("q")), "priority": F.when(c("flag") != "A", c("q")),
        "standing": F.when(c("flag") == "A", F.lit("optional")), "basis": F.when(c("flag") == "R", F.lit("none_printed")), "page_offset": c("q"), "standing_note": F.when(c("flag") == "N", c("q")),
    }
    args = F.create_map(*(x for n, v in given.items() for x in (F.lit(n), v)))
    clear = F.when((c("action") == "characterization") & (c("o") % 3 == 0), F.array(F.lit("priority")))
    after, refused = requests.fold_setters(sql(spark, sf_dir, _RECORDS), a.select("seq", "id", "action", args.alias("args"), clear.alias("clear")))
    rows = after.withColumn("why", F.lit(None).cast("string"))
    return rows.unionByName(refused.select(F.col("seq").alias("touched"), "why"), allowMissingColumns=True)


_PLACES = "SELECT p_size AS list_id, p_partkey AS work_id, p_brand AS section, CAST(p_partkey AS INT) AS ordinal FROM {part}"
_PLACES_ASKED = "SELECT l_orderkey * 10 + l_linenumber AS seq, p.p_size + l_linenumber % 2 AS list_id, l_partkey AS work_id, CASE WHEN l_returnflag = 'R' THEN 'remove' ELSE 'add' END AS op, l_linestatus AS section, CAST(l_quantity AS INT) AS ordinal FROM " + _LINES + " l JOIN {part} p ON p.p_partkey = l.l_partkey"


def w2_folded_places(spark, sf_dir):
    return requests.fold_places(sql(spark, sf_dir, _PLACES), sql(spark, sf_dir, _PLACES_ASKED), ["list_id", "work_id"])


def w7_replayed_note_works(spark, sf_dir):
    """Works of orders as of notes: every line adds its supplier, or takes it away."""
    table = sql(spark, sf_dir, "SELECT o_orderkey AS note_id, concat('s', CAST(o_custkey % 10 + 1 AS VARCHAR(9))) AS work_id, 'about' AS role, 3 AS ordinal FROM {orders}")
    asked = sql(spark, sf_dir, "SELECT l_linenumber AS seq, l_orderkey AS note_id, concat('s', CAST(l_suppkey % 10 + 1 AS VARCHAR(9))) AS work_id, CASE WHEN l_returnflag = 'N' THEN 'add' WHEN l_linenumber % 3 = 0 THEN 'remove' ELSE 'add' END AS op, l_linestatus AS role FROM " + _LINES + " x")
    return requests.replay_note_works(table, asked)


_NOW = "SELECT c_nationkey AS list_id, c_custkey AS work_id, c_custkey AS place FROM {customer} WHERE c_custkey % 11 <> 4"
_WANTED = "SELECT c_nationkey AS list_id, c_custkey AS work_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 7 = 3 THEN c_acctbal ELSE c_custkey END, c_custkey) AS place FROM {customer} WHERE c_custkey % 13 <> 5"


def l2_list_changes(spark, sf_dir):
    return relist.changes(sql(spark, sf_dir, _NOW), sql(spark, sf_dir, _WANTED))


QUERIES = {f.__name__: f for f in (w1_folded_setters, w2_folded_places, w7_replayed_note_works, l2_list_changes)}


def _last(field: str, touches: str, value: str) -> str:
    return f"arg_max({{'v': {value}}}, seq) FILTER ({touches}) AS {field}_"


_SETS = ", ".join(
    _last(f, t, v)
    for f, t, v in (
        ("status", "action = 'status'", "flag"), ("page_offset", "action = 'offset'", "q"), ("basis", "action = 'acceptance'", "CASE WHEN flag = 'R' THEN 'none_printed' END"), ("author", "action = 'imprint'", "CASE WHEN flag <> 'N' THEN 'Author ' || q END"), ("publisher", "action = 'imprint'", "NULL::VARCHAR"), ("place", "action = 'imprint'", "mode"),
        ("year", "action = 'imprint'", "q"), ("isbn", "action = 'imprint'", "NULL::VARCHAR"), ("priority", "action = 'rating' OR (action = 'characterization' AND (flag <> 'A' OR o % 3 = 0))", "CASE WHEN flag <> 'A' AND NOT (action = 'characterization' AND o % 3 = 0) THEN q END"),
        ("standing_note", "action = 'standing_note'", "CASE WHEN flag = 'N' THEN q END"), ("standing", "action = 'characterization' AND flag = 'A'", "'optional'"),
    )
)
_NAMES = ("status", "page_offset", "basis", "author", "publisher", "place", "year", "isbn", "priority", "standing_note", "standing")

ORACLE = {
    "w1_folded_setters": "WITH t AS (" + _RECORDS + "), a AS (" + _ASKED + """), r AS (SELECT *, CASE WHEN action = 'other' THEN 'no such action' WHEN id < 0 THEN 'no such id' WHEN o % 7 = 0 THEN 'not a whole number: year' END AS why FROM a),
      f AS (SELECT id AS k, max(seq) AS touched, """ + _SETS + " FROM r WHERE why IS NULL GROUP BY id) SELECT t.id, " + ", ".join(f"CASE WHEN {n}_ IS NOT NULL THEN {n}_.v{'::INT' if n in requests.NUMBERS else ''} ELSE t.{n} END AS {n}" for n in _NAMES)
    + ", touched, NULL AS why FROM t LEFT JOIN f ON f.k = t.id UNION ALL SELECT NULL, " + ", ".join("NULL" for _ in _NAMES) + ", seq, why FROM r WHERE why IS NOT NULL",
    "w2_folded_places": "WITH t AS (" + _PLACES + "), a AS (" + _PLACES_ASKED + """), l AS (SELECT *, row_number() OVER (PARTITION BY list_id, work_id ORDER BY seq DESC) AS back FROM a)
      SELECT t.* FROM t WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.list_id = t.list_id AND a.work_id = t.work_id) UNION ALL SELECT list_id, work_id, section, ordinal FROM l WHERE back = 1 AND op = 'add'""",
}

"""Registered queries of reading lists, file names and proposals; their DuckDB equivalents are written apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemere.operators import proposals, readinglist
from pagemere.plans.catalogue import sql


def _lines(spark, sf_dir):
    """Pieces of every text as lines of four long lists, some with a heading's or an item's form."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("lang IS NOT NULL")
    d = d.select("lang", "doc_id", F.posexplode(F.split("text", "[.] ")).alias("pos", "piece")).withColumn("k", F.col("doc_id") * 31 + F.col("pos"))
    letters = F.upper(F.regexp_replace("piece", "[^a-zA-Z ]", ""))
    k = F.col("k")
    text = (
        F.when(k % 97 == 0, F.concat(F.lit("II. LIST "), letters))
        .when(k % 97 == 1, F.concat(F.lit("WORKING FILMOGRAPHY: "), "piece"))
        .when(k % 97 == 2, "Supplementary")
        .when(k % 31 == 3, F.concat(F.lit("B. Part "), "piece"))
        .when(k % 50 == 9, F.concat(F.lit("Count: "), "piece"))
        .when(k % 7 < 3, F.concat((k % 150).cast("string"), F.lit(". "), "piece"))
        .otherwise(F.col("piece"))
    )
    return d.select("lang", "doc_id", "pos", text.alias("text"))


def src8_reading_list(spark, sf_dir):
    return readinglist.entries(_lines(spark, sf_dir), ["lang"], ["doc_id", "pos"])


_ENTRIES = """SELECT o.o_orderkey AS id, CASE o.o_orderkey % 7
  WHEN 0 THEN concat('Maker, ', p.p_brand, '. ', p.p_name, '. Press, ', CAST(year(o.o_orderdate) AS VARCHAR(9)), '.')
  WHEN 1 THEN concat('Doe, J. "', p.p_name, '." In The ', p.p_type, '. ', CAST(year(o.o_orderdate) AS VARCHAR(9)), ', ed. 1850.')
  WHEN 2 THEN concat('Roe, R. . “', p.p_type, '” ', p.p_name)
  WHEN 3 THEN concat(p.p_name, ' ', CAST(o.o_orderkey AS VARCHAR(20)))
  WHEN 4 THEN concat('Poe et al.. ', p.p_name, '. , ;', p.p_type, '; ')
  WHEN 5 THEN concat('"', p.p_name, '" seen in ', CAST(1300 + o.o_orderkey % 900 AS VARCHAR(9)))
  ELSE concat('. ', p.p_type, ': ', p.p_name, ' 11999 1999x 1623') END AS entry FROM {orders} o JOIN {part} p ON p.p_partkey = o.o_custkey"""


def x27_entry_parts(spark, sf_dir):
    return sql(spark, sf_dir, _ENTRIES).select("id", readinglist.entry_parts(F.col("entry")).alias("x")).select("id", "x.*")


_FILES = """SELECT p_partkey AS file, concat('in/', CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE p_name END, ' ', CASE WHEN p_partkey % 3 > 0 THEN p_type ELSE 'Ñandú' END, ' ', CAST(p_partkey % 331 + 1000 AS VARCHAR(9)),
  CASE WHEN p_partkey % 4 > 0 THEN concat(' -- Given de Máker', CAST(p_partkey % 9 AS VARCHAR(9)), 'son, ed.') ELSE '' END, CASE WHEN p_partkey % 4 > 1 THEN ' -- Press, 1999 -- 0f3a -- archive' ELSE '' END, '.pdf') AS name FROM {part}"""
_WORKS = """SELECT p_partkey AS work, concat('Maker', CAST(p_partkey % 9 AS VARCHAR(9)), 'son, Given') AS author, concat('The ', p_name, ' ', p_type, CASE WHEN p_partkey % 2 = 0 THEN concat(' ', CAST(p_partkey % 331 + 1000 AS VARCHAR(9))) ELSE '' END) AS title FROM {part}"""


def e5_file_candidates(spark, sf_dir):
    return proposals.file_candidates(sql(spark, sf_dir, _FILES), sql(spark, sf_dir, _WORKS))


_RECORDS = """SELECT p_partkey AS id, concat(p_name, ' of the ', p_type) AS title, CASE p_partkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'Press' END AS publisher, CASE WHEN p_partkey % 4 > 0 THEN 'Town' END AS place,
  CASE WHEN p_partkey % 5 > 0 THEN 1900 + p_size END AS year, CASE WHEN p_partkey % 6 = 1 THEN concat('978', CAST(1000000 + p_partkey AS VARCHAR(9))) END AS isbn, p_partkey % 7 <> 3 AS has_file FROM {part}"""
_PICKS = """SELECT l_partkey AS work_id, l_orderkey * 10 + l_linenumber AS line, concat('978', CAST(1000000 + l_partkey + l_suppkey % 2 AS VARCHAR(12))) AS isbn13,
  CASE WHEN l_returnflag = 'R' AND l_quantity > 40 THEN 'yes' ELSE '' END AS pick, CASE WHEN l_linestatus = 'O' THEN 'two editions' ELSE ' ' END AS why FROM {lineitem} WHERE l_partkey % 8 > 0"""
_KNOWN = """SELECT concat('978', CAST(1000000 + p_partkey AS VARCHAR(12))) AS isbn, CASE WHEN p_partkey % 9 < 6 THEN concat(p_name, ': a study') ELSE concat('Other ', p_brand) END AS title, CASE WHEN p_partkey % 3 > 0 THEN 'House' ELSE '' END AS publisher,
  CASE WHEN p_partkey % 11 > 2 THEN 'City' END AS place, CASE WHEN p_partkey % 13 > 0 THEN 1950 END AS year, 'catalogue' AS source FROM {part} WHERE p_partkey % 10 > 0"""


def e7_proposals(spark, sf_dir):
    picks = proposals.isbn_picks(sql(spark, sf_dir, _PICKS))
    got = proposals.catalogue_proposals(sql(spark, sf_dir, _RECORDS), picks, sql(spark, sf_dir, _KNOWN))
    lists = {"missing": "missing", "still": "still", "reasons": F.transform("reasons", lambda r: r["reason"]), "rules": F.transform("reasons", lambda r: r["rule"])}
    return got.select("id", "isbn", "isbn_from", "title_match", "accept", "title_found", "publisher_found", "place_found", "year_found", "source", *(F.array_join(c, "; ").alias(n) for n, c in lists.items()))


QUERIES = {f.__name__: f for f in (src8_reading_list, x27_entry_parts, e5_file_candidates, e7_proposals)}

_PLAIN = "replace(lower(strip_accents({0})), 'ß', 'ss')"
_FILE_WORDS = "list_distinct(list_filter(string_split(regexp_replace(" + _PLAIN + r", '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: length(w) > 2 AND w NOT IN (" + ", ".join(f"'{w}'" for w in proposals.FILE_STOP) + ")))"
_TITLE_WORDS = "list_distinct(list_filter(string_split(regexp_replace(" + _PLAIN + r", '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 2 AND w NOT IN (" + ", ".join(f"'{w}'" for w in proposals.TITLE_STOP) + ")))"

ORACLE = {
    "src8_reading_list": r"""WITH x AS (SELECT lang, doc_id, unnest(string_split(text, '. ')) AS piece, generate_subscripts(string_split(text, '. '), 1) - 1 AS pos FROM {documents} WHERE lang IS NOT NULL AND text IS NOT NULL), y AS (SELECT *, doc_id * 31 + pos AS k FROM x),
      z AS (SELECT lang, doc_id, pos, trim(regexp_replace(CASE WHEN k % 97 = 0 THEN 'II. LIST ' || upper(regexp_replace(piece, '[^a-zA-Z ]', '', 'g')) WHEN k % 97 = 1 THEN 'WORKING FILMOGRAPHY: ' || piece WHEN k % 97 = 2 THEN 'Supplementary' WHEN k % 31 = 3 THEN 'B. Part ' || piece
        WHEN k % 50 = 9 THEN 'Count: ' || piece WHEN k % 7 < 3 THEN (k % 150) || '. ' || piece ELSE piece END, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM y),
      c AS (SELECT *, CASE WHEN regexp_matches(t, '^(?i:working\s+[a-z]+|supplementary)\b') AND length(t) < 80 THEN CASE WHEN t ILIKE 'supplementary%' THEN 's' ELSE 'u' END
        WHEN regexp_matches(t, '^(I{{1,3}}|IV|V)\.\s+.{{4,}}$') AND upper(regexp_extract(t, '^[IV]+\.\s+(.*)$', 1)) = regexp_extract(t, '^[IV]+\.\s+(.*)$', 1) AND lower(regexp_extract(t, '^[IV]+\.\s+(.*)$', 1)) <> regexp_extract(t, '^[IV]+\.\s+(.*)$', 1) THEN 'l'
        WHEN regexp_matches(t, '^\d{{1,3}}\.\s+.+$') THEN 'i' WHEN regexp_matches(t, '^[A-Z]\.\s+.{{4,}}$') AND length(t) < 100 AND NOT (upper(substr(t, 4)) = substr(t, 4) AND lower(substr(t, 4)) <> substr(t, 4)) THEN 'h' ELSE 'm' END AS kind
        FROM z WHERE length(t) >= 3 AND t NOT LIKE 'Count:%' AND t NOT LIKE '%COMPREHENSIVE EXAMINATION%' AND NOT regexp_matches(t, '^(Chapter-level|Not examinable|Sixteenth|Department of|Teaching el)')),
      s AS (SELECT *, last_value(CASE kind WHEN 'l' THEN t WHEN 'u' THEN 'Working ' || upper(substr(string_split(t, ':')[1], 9, 1)) || lower(substr(string_split(t, ':')[1], 10)) END IGNORE NULLS) OVER w AS list, last_value(CASE kind WHEN 'l' THEN '' WHEN 'u' THEN '' WHEN 's' THEN 'Supplementary' WHEN 'h' THEN t END IGNORE NULLS) OVER w AS section,
        last_value(CASE kind WHEN 'l' THEN false WHEN 'u' THEN false WHEN 's' THEN true END IGNORE NULLS) OVER w AS supplementary, sum((kind IN ('s', 'u', 'l', 'h'))::INT) OVER w AS head, sum((kind = 'i')::INT) OVER w AS entry_no FROM c WINDOW w AS (PARTITION BY lang ORDER BY doc_id, pos)),
      i AS (SELECT lang, entry_no, coalesce(list, '(before any list)') AS list, coalesce(section, '') AS section, coalesce(supplementary, false) AS supplementary, row_number() OVER (PARTITION BY lang, head ORDER BY entry_no) AS ordinal, regexp_extract(t, '^(\d+)', 1)::BIGINT AS num FROM s WHERE kind = 'i'),
      e AS (SELECT lang, entry_no, string_agg(CASE kind WHEN 'i' THEN trim(regexp_replace(t, '^\d+\.\s+', '')) ELSE t END, ' ' ORDER BY doc_id, pos) AS entry FROM s WHERE kind IN ('i', 'm') AND entry_no > 0 GROUP BY lang, entry_no)
      SELECT i.lang, i.entry_no::BIGINT AS entry_no, list, section, supplementary, ordinal, CASE WHEN num > 0 THEN num ELSE ordinal END AS printed_ordinal, entry FROM i JOIN e ON e.lang = i.lang AND e.entry_no = i.entry_no""".replace("{{", "{").replace("}}", "}"),
    "x27_entry_parts": r"""WITH x AS (""" + _ENTRIES + r"""), s AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(regexp_replace(entry, '(\w)\.\.(\s)', '\1' || chr(1) || '\2', 'g'), '\.\s+', chr(2), 'g'), chr(2)), lambda p: replace(p, chr(1), '..')), lambda p: trim(p) <> '') AS p, regexp_extract(entry, '[“”"]([^“”"]{4,})[“”"]', 1) AS q FROM x),
      t AS (SELECT *, trim(trim(p[2]), ' .,;:') AS two, regexp_extract_all(entry, '\b(1[5-9]\d\d|20[0-2]\d)\b') AS ys FROM s), u AS (SELECT *, CASE WHEN len(p) >= 2 THEN CASE WHEN q <> '' AND length(two) < 4 THEN trim(q, ' .') ELSE two END WHEN q <> '' THEN trim(q, ' .') ELSE substr(entry, 1, 80) END AS title, coalesce(ys[-1], '') AS year FROM t)
      SELECT id, substr(trim(string_split(entry, '.')[1]), 1, 90) AS author, title, year, CASE WHEN title = '' THEN 0 WHEN len(p) >= 2 AND title = two THEN length(p[1]) + strpos(substr(entry, length(p[1]) + 1), title) ELSE strpos(entry, title) END::INT AS title_at,
      CASE WHEN year = '' THEN 0 ELSE length(regexp_extract(entry, '(?s)^(.*)\b(1[5-9]\d\d|20[0-2]\d)\b', 1)) + 1 END::INT AS year_at FROM u""",
    "e5_file_candidates": "WITH f0 AS (" + _FILES + "), w0 AS (" + _WORKS + r"""), f1 AS (SELECT file, list_transform(string_split(regexp_replace(regexp_replace(name, '^.*/', ''), '\.pdf$', ''), ' -- '), lambda x: trim(x)) AS p FROM f0),
      f2 AS (SELECT file, p[1] AS title, coalesce(p[2], '') AS author FROM f1), f AS (SELECT file, list_distinct(list_concat(""" + _FILE_WORDS.format("title") + ", " + _FILE_WORDS.format("author") + r""")) AS k, coalesce(list_filter(regexp_split_to_array(regexp_replace(string_split(""" + _PLAIN.format("author") + r""", ',')[1], '[^a-z\s-]', ' ', 'g'), '[\s-]+'), lambda w: w <> '' AND w NOT IN ('de', 'del', 'la', 'y', 'von'))[-1], '') AS sur FROM f2),
      w AS (SELECT work, """ + _PLAIN.format("author") + " AS who, " + _FILE_WORDS.format("concat_ws(' ', author, title)") + """ AS k FROM w0), pr AS (SELECT file, work, least(1.0, round(len(list_intersect(f.k, w.k))::DOUBLE / len(w.k) + CASE WHEN sur <> '' AND contains(who, sur) THEN 0.3 ELSE 0 END, 2)) AS score FROM f, w WHERE len(list_intersect(f.k, w.k)) > 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, work)::INT AS rank FROM pr WHERE score >= 0.6) SELECT file, work, score, rank FROM r WHERE rank <= 3""",
    "e7_proposals": "WITH r AS (" + _RECORDS + "), pk AS (" + _PICKS + "), kn AS (" + _KNOWN + r"""), y AS (SELECT work_id, arg_max(isbn13, line) FILTER (pick = 'yes') AS i, arg_max(why, line) FILTER (pick = 'yes') AS yw, arg_min(why, line) AS fw, count(*) FILTER (pick = 'yes') AS n FROM pk GROUP BY work_id),
      a AS (SELECT r.id, r.title, nullif(trim(publisher), '') AS publisher, place, year, isbn AS own, has_file, y.i, nullif(trim(CASE WHEN n > 0 THEN yw ELSE fw END), '') AS why FROM r LEFT JOIN y ON y.work_id = r.id),
      b AS (SELECT a.*, coalesce(own, i) AS isbn, CASE WHEN own IS NOT NULL THEN 'record' WHEN i IS NOT NULL THEN 'pdf' END AS isbn_from, list_filter([CASE WHEN publisher IS NULL THEN 'publisher' END, CASE WHEN place IS NULL THEN 'place' END, CASE WHEN year IS NULL THEN 'year' END], lambda x: x IS NOT NULL) AS missing FROM a),
      c AS (SELECT b.*, kn.isbn IS NOT NULL AS found, kn.title AS title_found, nullif(kn.publisher, '') AS pf, kn.place AS cf, kn.year AS yf, kn.source, """ + _TITLE_WORDS.format("b.title") + " AS ta, " + _TITLE_WORDS.format("kn.title") + r""" AS tb FROM b LEFT JOIN kn ON kn.isbn = b.isbn WHERE len(missing) > 0 OR own IS NULL),
      d AS (SELECT *, CASE WHEN found THEN round(CASE WHEN least(len(ta), len(tb)) = 0 THEN 0 ELSE len(list_intersect(ta, tb))::DOUBLE / least(len(ta), len(tb)) END, 2) END AS title_match, list_filter(missing, lambda m: CASE m WHEN 'publisher' THEN pf IS NULL WHEN 'place' THEN cf IS NULL ELSE yf IS NULL END) AS lacks FROM c),
      e AS (SELECT *, coalesce(title_match >= 0.5, false) AS accept FROM d), f AS (SELECT *, [CASE WHEN isbn IS NULL AND NOT has_file THEN ['no_file', 'no file, so no ISBN from a PDF'] END, CASE WHEN isbn IS NULL AND has_file AND why IS NOT NULL THEN ['no_isbn', 'no ISBN from the PDF (' || why || ')'] END, CASE WHEN isbn IS NULL AND has_file AND why IS NULL THEN ['not_scanned', 'PDF not scanned by isbns.py'] END,
        CASE WHEN isbn IS NOT NULL AND NOT found THEN ['unknown_isbn', 'ISBN ' || isbn || ' not in the catalogues'] END, CASE WHEN found AND len(lacks) > 0 THEN ['catalogue_lacks', source || ' has no ' || array_to_string(lacks, ', ')] END, CASE WHEN found AND NOT accept THEN ['other_title', 'the titles differ'] END] AS why_all FROM e)
      SELECT id, isbn, isbn_from, title_match, accept, title_found, pf AS publisher_found, cf AS place_found, yf::VARCHAR AS year_found, source, array_to_string(missing, '; ') AS missing, array_to_string(CASE WHEN isbn IS NULL THEN list_append(missing, 'isbn') WHEN found THEN lacks ELSE missing END, '; ') AS still,
        array_to_string(list_transform(list_filter(why_all, lambda x: x IS NOT NULL), lambda x: x[2]), '; ') AS reasons, array_to_string(list_transform(list_filter(why_all, lambda x: x IS NOT NULL), lambda x: x[1]), '; ') AS rules FROM f""",
}

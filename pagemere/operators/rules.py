"""Rules of the catalogue as columns: numbering, citability, what a citation lacks, list codes, stages, file states.

Each takes the columns it needs, so queries, tools and exports share one statement of a rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Numerals of the examined lists; shares at which a quota warns and fails; labels that tools and pages show.
NUMERALS = {"theory": "I", "dissertation": "II", "teaching": "III"}
WARN_AT, FAIL_AT = 0.7, 0.85
ACCEPTED_HAND_SET, ACCEPTED_UNNUMBERED = "accepted (hand set)", "accepted (no printed numbers)"
OWN_PAGES, UNSETTLED_PAGES = "unverified: the file's own page, not the edition's", "unverified: numbering unsettled"
PROVENANCE = ("written by hand", "found by the assistant, confirmed by a person", "assistant proposal, UNREVIEWED")
NEVER_CHECKED, UNSETTLED = "page numbering never checked", "page numbering unsettled: "


def blank(c: Column) -> Column:
    """Null for a null, empty or white text."""
    return F.nullif(F.trim(c), F.lit(""))


def _problem(problem: Column) -> Column:
    return F.coalesce(problem, F.lit("")) != ""


def _hand_set(basis: Column) -> Column:
    return basis.eqNullSafe(F.lit("hand_set"))


def numbering(checked: Column, problem: Column, accepted: Column, basis: Column) -> Column:
    """A problem decides first, and whether it was accepted; only then whether the numbering was checked."""
    settled = F.when(_hand_set(basis), ACCEPTED_HAND_SET).otherwise(ACCEPTED_UNNUMBERED)
    sound = F.when(checked, "checked").otherwise("unchecked")
    return F.when(_problem(problem), F.when(accepted, settled).otherwise(F.concat(F.lit("problem: "), problem))).otherwise(sound)


def page_numbers(checked: Column, problem: Column, accepted: Column, basis: Column) -> Column:
    loose = F.when(accepted, OWN_PAGES).otherwise(UNSETTLED_PAGES)
    return F.when(_hand_set(basis), "hand set").when(_problem(problem), loose).when(checked, "verified").otherwise("unchecked")


def not_citable_because(checked: Column, problem: Column, accepted: Column) -> Column:
    """Null if the pages can be cited; acceptance settles a problem, but not a numbering that was never checked."""
    return F.when(_problem(problem) & ~accepted, F.concat(F.lit(UNSETTLED), problem)).when(~checked, NEVER_CHECKED)


def imprint(works: DataFrame) -> DataFrame:
    """Works with im_publisher, im_place, im_year and im_editor: the container's alone where there is one, else their own."""
    names = ("publisher", "place", "year", "editor")
    c = works.select(F.col("id").alias("c_id"), *(F.col(n).alias(f"c_{n}") for n in names))
    joined = works.join(c, F.col("container_id") == F.col("c_id"), "left")
    taken = {f"im_{n}": F.when(F.col("c_id").isNotNull(), F.col(f"c_{n}")).otherwise(F.col(n)) for n in names}
    return joined.withColumns(taken).drop("c_id", *(f"c_{n}" for n in names))


def missing_fields() -> Column:
    """Over ``imprint``: names of what a full citation lacks."""
    c = F.col
    film = c("kind") == "film"
    lacks = [
        ("author", F.coalesce(blank(c("author")), blank(c("editor")), blank(c("im_editor"))).isNull()),
        ("publisher", ~film & blank(c("im_publisher")).isNull()),
        ("place", ~film & blank(c("im_place")).isNull()),
        ("year", F.when(film, c("year").isNull()).otherwise(c("im_year").isNull())),
        ("access date", blank(c("url")).isNotNull() & blank(c("accessed")).isNull()),
    ]
    return F.array_compact(F.array(*(F.when(test, name) for name, test in lacks)))


def numeral(list_key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in NUMERALS.items() for x in pair)), list_key)


def _dotted(*parts: Column) -> Column:
    return F.array_join(F.array(*parts), ".")


def workbench_code(list_key: Column, section_kind: Column, letter: Column, ordinal: Column) -> Column:
    """``I.A.3`` or ``Supl. I``; null off the examined lists."""
    n = numeral(list_key)
    plain = _dotted(n, F.coalesce(letter, F.lit("?")), F.coalesce(ordinal.cast("string"), F.lit("?")))
    return F.when(n.isNotNull(), F.when(section_kind == "supplementary", F.concat(F.lit("Supl. "), n)).otherwise(plain))


def exam_number(list_key: Column, section_kind: Column, letter: Column, ordinal: Column) -> Column:
    """``I.A.3`` or ``I.Supl.3``; null off the examined lists."""
    n = numeral(list_key)
    middle = F.when(section_kind == "supplementary", "Supl").otherwise(F.coalesce(letter, F.lit("?")))
    return F.when(n.isNotNull(), _dotted(n, middle, F.coalesce(ordinal.cast("string"), F.lit("?"))))


def missing_file_code(list_name: Column, section_title: Column, letter: Column, ordinal: Column) -> Column:
    """The list name's first part, then as ``exam_number``, but told by the section's title; a missing ordinal shows as ``null``."""
    middle = F.when(section_title == "Supplementary", "Supl").otherwise(F.coalesce(letter, F.lit("")))
    return _dotted(F.split(list_name, "\\.")[0], middle, F.coalesce(ordinal.cast("string"), F.lit("null")))


STAGES = ("extract", "chunk", "load_pages", "offsets", "load_sections", "load_chunks", "embed")


def stage_ready() -> dict[str, Column]:
    """What each stage of the pipeline waits for, over the columns named here."""
    c = F.col
    sound = c("offset_checked") & ~_problem(c("offset_problem"))
    load = c("has_pages") & sound & ~c("has_chunks")
    return {
        "extract": c("has_file") & ~c("pages_file") & ~c("has_pages"),
        "chunk": c("pages_file") & ~c("chunks_file") & ~c("has_chunks"),
        "load_pages": c("pages_file") & ~c("has_pages"),
        "offsets": c("has_pages") & ~c("has_chunks") & ~c("offset_checked"),
        "load_sections": load,
        "load_chunks": load,
        "embed": c("unembedded") & sound,
    }


def register_state(path: Column, verdict: Column, pages: Column) -> Column:
    """``queued`` means a file that waits for OCR, which is not the same as none."""
    waits = F.lower(F.coalesce(verdict, F.lit(""))).contains("ocr")
    return F.when(blank(path).isNull(), "none").when(pages > 0, "loaded").when(waits, "queued").otherwise("ready")


def register_clashes(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, kept, other) for each row whose value disagrees with the first that its key has."""
    told = rows.select(key, order, blank(F.col(value)).alias("other")).filter(F.col("other").isNotNull())
    first = told.groupBy(key).agg(F.min_by("other", order).alias("kept"))
    return told.join(first, key).filter("other <> kept").select(key, "kept", "other")


def quota_level(share: Column) -> Column:
    return F.when(share >= FAIL_AT, "fail").when(share >= WARN_AT, "warn").otherwise("ok")


def year_in(text: Column) -> Column:
    """The last number that stands alone and is a year from 1500 to 2029."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(r"\b(1[5-9]\d\d|20[0-2]\d)\b"), F.lit(1)), F.lit(-1))


def whole_number(text: Column) -> Column:
    """A form's number: null for a blank or for what is no whole number."""
    return F.when(F.trim(text).rlike(r"^[+-]?\d{1,9}$"), F.trim(text).cast("int"))


def id_list(text: Column) -> Column:
    """A form's ids, parted by commas, as they were given, once each and without blanks."""
    return F.array_distinct(F.array_compact(F.transform(F.split(F.coalesce(text, F.lit("")), ","), blank)))


def title_similarity(a: Column, b: Column) -> Column:
    """Shared words over the words of the shorter title; ``a`` and ``b`` are arrays of telling words."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def proposal_score(similarity: Column, same_surname: Column, year: Column, listed: Column) -> Column:
    bonus = F.when(F.coalesce(same_surname, F.lit(False)), 0.35).otherwise(0.0) + F.when(F.coalesce(F.abs(year - listed) <= 2, F.lit(False)), 0.15).otherwise(0.0)
    return similarity + bonus


def preferred(rows: DataFrame, keys: list[str], better: Column, ties: list[Column]) -> DataFrame:
    """One row for each key, of those for which ``better`` holds if there are any, by partial aggregation."""
    columns = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*columns), F.struct(F.when(better, 0).otherwise(1), *ties)).alias("best")
    return rows.groupBy(*keys).agg(best).select(*keys, *(F.col(f"best.{c}").alias(c) for c in columns))


def in_order_of(rows: DataFrame, id_col: str, ids: list) -> DataFrame:
    """Rows of the ids asked for, with their place in the list; ids that aren't there give none."""
    spark = rows.sparkSession
    asked = spark.createDataFrame([(i, n) for n, i in enumerate(dict.fromkeys(ids))], f"{id_col} {dict(rows.dtypes)[id_col]}, place int")
    return rows.join(F.broadcast(asked), id_col).orderBy("place")


def local_day(ts: Column, zone: str = "America/Denver") -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def notes_export(notes: DataFrame, relations: DataFrame, works: DataFrame) -> DataFrame:
    """A row for each note and each of its relations to works; axes give way to their parts; a note without relations has one row.

    notes(id, parent_id, kind, title, attribution, origin, reviewed), relations(note_id, relation, role, work_id,
    printed_page, quote), works(id, title, offset_problem, basis).  Of an axis's parts its thesis, its fichas and one
    synthesis and one exam move, the first, are told; parts of other kinds are not.
    """
    c = F.col
    top = notes.filter("parent_id is null")
    axes = top.filter("kind = 'axis'").select(c("id").alias("parent_id"), c("title").alias("axis"))
    own = top.withColumn("part", F.when(c("kind") == "axis", "thesis").otherwise(c("kind"))).withColumn("axis", F.when(c("kind") == "axis", c("title")))
    parts = notes.join(axes, "parent_id").filter(c("kind").isin("ficha", "synthesis", "exam_move"))
    once = parts.filter("kind <> 'ficha'").groupBy("parent_id", "kind").agg(F.min("id").alias("id")).select("id")
    told = parts.filter("kind = 'ficha'").unionByName(parts.join(once, "id", "left_semi")).withColumn("part", c("kind"))
    rows = own.unionByName(told.select(*own.columns))
    w = works.select(c("id").alias("work_id"), c("title").alias("work_title"), "offset_problem", "basis")
    related = relations.join(w, "work_id", "left")
    of_note = related.groupBy("note_id").agg(F.count("*").alias("relations_in_note"), F.sort_array(F.collect_set("work_title")).alias("titles"))
    out = rows.join(related, rows.id == related.note_id, "left").drop("note_id").join(of_note, rows.id == of_note.note_id, "left")
    loose = _problem(c("offset_problem")) & ~_hand_set(c("basis"))
    verified = F.when(c("printed_page").isNull(), "").when(loose, "no").when(_hand_set(c("basis")), "hand set").otherwise("yes")
    return out.select(
        c("id").alias("note_id"),
        c("part").alias("kind"),
        F.coalesce("axis", F.lit("")).alias("axis"),
        F.coalesce("relation", F.lit("")).alias("relation"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("relations_in_note", F.lit(0)).alias("relations_in_note"),
        F.array_join(F.filter("titles", lambda t: ~t.eqNullSafe(c("work_title"))), "; ").alias("also_touching"),
        F.coalesce("work_id", F.lit("")).alias("work_id"),
        "printed_page",
        F.coalesce(verified, F.lit("")).alias("page_verified"),
        "quote",
        F.coalesce("attribution", F.lit("UNCLASSIFIED")).alias("whose_claim"),
        F.when(c("origin") == "human", PROVENANCE[0]).when(c("reviewed"), PROVENANCE[1]).otherwise(PROVENANCE[2]).alias("provenance"),
    )


def works_export(works: DataFrame, items: DataFrame, lists: DataFrame) -> DataFrame:
    """Works with their container's title, the names of their lists in order, and what their citation lacks."""
    names = items.join(lists.select(F.col("id").alias("list_id"), "name", "sort"), "list_id").groupBy("work_id").agg(F.array_sort(F.collect_set(F.struct("sort", "name"))).alias("x"))
    titles = works.select(F.col("id").alias("container_id"), F.col("title").alias("container_title"))
    out = imprint(works).join(titles, "container_id", "left").join(names, F.col("id") == F.col("work_id"), "left")
    return out.withColumn("lists", F.array_join(F.transform("x", lambda s: s["name"]), "; ")).withColumn("missing", F.array_join(missing_fields(), "; ")).drop("x", "work_id", "im_publisher", "im_place", "im_year", "im_editor")

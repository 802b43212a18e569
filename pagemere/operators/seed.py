"""First rows of a catalogue from a matched reading list, and the report on files that no rule names yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemere.operators import entities, proposals
from pagemere.operators.ordered import carried

# What a file's ending says of its format; how sure an offset has to be; what a record is told.
FORMATS = {".pdf": "pdf_text", ".epub": "epub", ".azw3": "epub"}
LEAST_AGREEMENT, LEAST_FOLIO_SHARE = 0.7, 0.25
FILM_LIST, EDITORS = "filmography", r"(?i)\b(editor|editora|coordinador|recopilador)|, ed\."
ACCOUNTED = ("ACCOUNTED", "OCR")
MATCH_CHARS = 56
_PARTIAL = "A partial copy is in the corpus but is not usable: {note}. Seeded as not held so the gap stays visible."
_EXCERPT = "Excerpt: begins at printed page {page}."
_UNSURE = "Page offset uncertain (best guess {offset}, {agreement} agreement across {folios} of {pages} pages). Left at zero; confirm against the PDF."
_NO_PAGES = "No printed pagination: searchable, but no page a reader could follow. {against}"
_SCAN = "Scan held ({pages}pp) with no text layer. Run OCR, then re-check."
_UNCONFIRMED = "Pagination unconfirmed: {against}"
_TOGETHER = "Listed together with “{title}” in a single entry."
_APART = " A separate volume: the file held for that entry does not contain this work."


def _filled(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def kind(list_id: Column, title: Column, entry: Column, author: Column) -> Column:
    """film, essay (its title is quoted), edited_volume or monograph."""
    quoted = title.rlike("^[\"“]") | F.contains(entry, F.concat(F.lit('"'), title, F.lit('"'))) | F.contains(entry, F.concat(F.lit("“"), title, F.lit("”")))
    return F.when(list_id == FILM_LIST, "film").when(quoted, "essay").when(author.rlike(EDITORS), "edited_volume").otherwise("monograph")


def catalogue(entries: DataFrame, verdicts: DataFrame, splits: DataFrame, containers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(works, placements) of a matched list.

    entries(line, id, list_id, section_id, author, title, year, entry, examinable, file, ext, note, isbn), in the order of
    lines; verdicts(file, verdict, offset, agreement, folios, pages, against), a row a file; splits(id, nth, title, new_id,
    shares_file): further works an entry names; containers(id, container_id, title, author, kind, year): the volume that
    holds an essay.  A split work has the entry's file only if the file holds it; numbers within a list go on over
    splits.  An offset is kept only on strong evidence, else it is a note.
    """
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    e = entries.withColumn("file", blank("file")).withColumn("note", blank("note")).join(verdicts.withColumnRenamed("file", "v_file"), F.col("file") == F.col("v_file"), "left")
    held = F.col("file").isNotNull()
    judged = held & (F.col("ext") == ".pdf")
    is_ = {k: judged & F.col("verdict").isin(*v) for k, v in {"good": ("citable", "probably citable"), "bad": ("NOT citable",), "scan": ("needs OCR",), "open": ("check by hand",)}.items()}
    sure = (F.coalesce("agreement", F.lit(0.0)) >= LEAST_AGREEMENT) & (F.coalesce("pages", F.lit(0)) > 0) & (F.coalesce("folios", F.lit(0)) >= F.col("pages") * LEAST_FOLIO_SHARE)
    offset = F.when(F.coalesce(is_["good"] & sure, F.lit(False)), F.col("offset"))
    v = {n: F.col(n) for n in ("offset", "agreement", "folios", "pages", "against")}
    said = (
        F.when(is_["good"] & (offset > 0), _filled(_EXCERPT, page=offset + 1)).when(is_["good"] & offset.isNull() & F.col("offset").isNotNull(), _filled(_UNSURE, **{n: v[n] for n in ("offset", "agreement", "folios", "pages")}))
        .when(is_["bad"], _filled(_NO_PAGES, against=v["against"])).when(is_["scan"], _filled(_SCAN, pages=v["pages"])).when(is_["open"], _filled(_UNCONFIRMED, against=v["against"]))
    )
    own = F.when(held, F.col("note")).otherwise(F.when(F.col("note").isNotNull(), _filled(_PARTIAL, note=F.col("note"))))
    formats = F.coalesce(F.create_map(*(F.lit(x) for kv in FORMATS.items() for x in kv))[F.col("ext")], F.lit("none"))
    form = F.when(~held, "none").when(is_["bad"], "epub").when(is_["scan"], "none").otherwise(formats)
    c = containers.select(F.col("id").alias("c_id"), "container_id").dropDuplicates(["c_id"])
    e = e.join(c, F.col("id") == F.col("c_id"), "left")
    kind_ = F.when(F.col("container_id").isNotNull(), "essay").otherwise(kind(*(F.coalesce(x, F.lit("")) for x in ("list_id", "title", "entry", "author"))))
    main = e.select(
        "line", F.lit(0).alias("nth"), "list_id", "section_id", "id", "title", blank("author").alias("author"), F.when(F.col("year").rlike(r"^\d{1,9}$"), F.col("year")).cast("int").alias("year"), kind_.alias("kind"), "container_id", blank("isbn").alias("isbn"),
        F.when(F.col("examinable"), "both").otherwise("dissertation").alias("purpose"), form.alias("source_format"), "file", F.coalesce(offset, F.lit(0)).cast("int").alias("page_offset"), F.nullif(F.concat_ws(" | ", own, said), F.lit("")).alias("notes"),
    )
    s = splits.select(F.col("id").alias("of"), F.col("nth").alias("s_nth"), F.col("title").alias("s_title"), "new_id", F.coalesce("shares_file", F.lit(False)).alias("shares"))
    more = main.join(s, F.col("id") == F.col("of"))
    only = lambda c, other: F.when(F.col("shares"), F.col(c)).otherwise(other)
    replaced = {
        "nth": F.col("s_nth"), "id": F.col("new_id"), "title": F.col("s_title"), "notes": F.concat(_filled(_TOGETHER, title=F.col("title")), F.when(F.col("shares"), "").otherwise(_APART)),
        "source_format": only("source_format", F.lit("none")), "file": only("file", F.lit(None)), "isbn": only("isbn", F.lit(None)), "page_offset": only("page_offset", F.lit(0)),
    }
    every = main.unionByName(more.select(*(replaced.get(n, F.col(n)).alias(n) for n in main.columns)))
    volumes = containers.dropDuplicates(["container_id"]).select(F.col("container_id").alias("id"), "title", "author", "year", "kind", F.lit("unassigned").alias("purpose"), F.lit("none").alias("source_format"), F.lit(0).alias("page_offset"))
    works = every.drop("line", "nth", "list_id", "section_id").unionByName(volumes, allowMissingColumns=True)
    places = carried(every.filter("list_id IS NOT NULL").select("list_id", "line", "nth", "id", "section_id"), ["list_id"], ["line", "nth"], {}, {"ordinal": (F.lit(True), None)})
    return works, places.select("list_id", F.col("id").alias("work_id"), "section_id", "ordinal")


def match_string(path: Column) -> Column:
    """A rule that finds this file: the name's title, blanks made single, cut and trimmed; else the name's beginning."""
    stem = F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"(?<=.)\.[^. ]+$", "")
    title = F.trim(F.regexp_replace(F.trim(F.split(stem, " -- ")[0]), r"[_\s]+", " "))
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(title, 1, MATCH_CHARS), "^[ \\-–—,]+|[ \\-–—,]+$", ""), F.lit("")), F.substring(stem, 1, MATCH_CHARS))


def unmatched(files: DataFrame, rules: DataFrame) -> DataFrame:
    """files(file, name) that no rule of rules(work, match) finds; hidden files and folders of accounted ones aside."""
    base = F.regexp_replace("name", r"^.*/", "")
    folders = F.split("name", "/")
    named = files.filter(~base.startswith(".") & ~F.arrays_overlap(F.slice(folders, F.lit(1), F.size(folders) - 1), F.array(*map(F.lit, ACCOUNTED))))
    # that one rule finds a file is enough, whichever it is
    found = entities.needles_in_names(entities.needle(rules), named.select(base.alias("name")).distinct()).select(F.col("name").alias("found")).distinct()
    return named.join(found, base == F.col("found"), "left_anti")


def report(files: DataFrame, rules: DataFrame, works: DataFrame) -> DataFrame:
    """(file, match, work, score): each file no rule finds, with the rule to write and the best work of a good enough score."""
    left = unmatched(files, rules)
    best = proposals.file_candidates(left, works, most=1).select("file", "work", "score")
    return left.select("file", match_string(F.col("name")).alias("match")).join(best, "file", "left")

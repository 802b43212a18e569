"""Reading lists as they are typed: lines become entries under their list and section, entries become parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemere.operators.ordered import carried

# The forms of lines.  A list's numeral and a section's letter are told apart by the case of the name.
LIST_HEADING = r"^(I{1,3}|IV|V)\.\s+(.{4,})$"
SECTION_HEADING = r"^([A-Z])\.\s+(.{4,})$"
ITEM = r"^(\d{1,3})\.\s+(.+)$"
UNNUMBERED_LIST = r"(?i)^(WORKING\s+[A-Z]+|Supplementary)\b"
NO_ENTRY = r"^(Count:|Chapter-level|Not examinable|Sixteenth|Department of|Teaching el)|COMPREHENSIVE EXAMINATION"
YEAR = r"\b(1[5-9]\d\d|20[0-2]\d)\b"
NO_LIST = "(before any list)"
LEAST_LINE, UNNUMBERED_CHARS, SECTION_CHARS, AUTHOR_CHARS, TITLE_CHARS = 3, 80, 100, 90, 80


def _capitals(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


def line_kind(line: Column) -> Column:
    """supplementary, unnumbered, list, item, section, more; null for a line that is none of an entry."""
    return (
        F.when((F.length(line) < LEAST_LINE) | line.rlike(NO_ENTRY), None)
        .when(line.rlike(UNNUMBERED_LIST) & (F.length(line) < UNNUMBERED_CHARS), F.when(F.lower(line).startswith("supplementary"), "supplementary").otherwise("unnumbered"))
        .when(line.rlike(LIST_HEADING) & _capitals(F.regexp_extract(line, LIST_HEADING, 2)), "list")
        .when(line.rlike(ITEM), "item")
        .when(line.rlike(SECTION_HEADING) & ~_capitals(F.regexp_extract(line, SECTION_HEADING, 2)) & (F.length(line) < SECTION_CHARS), "section")
        .otherwise("more")
    )


def entries(lines: DataFrame, by: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """lines(by..., order..., text) to an entry a row: by..., entry_no, list, section, supplementary, ordinal, printed_ordinal, entry.

    A heading holds for the entries below it and starts their count anew; a line of no other kind goes on with the entry
    above it, also over a heading; before the first entry it is dropped.  A line that wraps is kept in order.
    """
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    # a generated row is worked out once; a filter on the kind would try all patterns twice, on a line made anew for each
    kinds = F.transform(F.array(text), lambda x: F.struct(x.alias("line"), line_kind(x).alias("kind")))
    got = lines.filter("text IS NOT NULL").select(*by, *order, F.inline(kinds)).filter("kind IS NOT NULL")
    kind, line = F.col("kind"), F.col("line")
    heads = kind.isin("supplementary", "unnumbered", "list", "section")
    last = {
        "list": F.when(kind == "list", line).when(kind == "unnumbered", F.trim(F.initcap(F.lower(F.split_part(line, F.lit(":"), F.lit(1)))))),
        "section": F.when(kind.isin("list", "unnumbered"), "").when(kind == "supplementary", "Supplementary").when(kind == "section", line),
        "supplementary": F.when(kind.isin("list", "unnumbered"), False).when(kind == "supplementary", True),
    }
    got = carried(got, by, order, last, {"ordinal": (kind == "item", heads), "entry_no": (kind == "item", None)}, ranges)
    item = kind == "item"
    body = F.when(item, F.trim(F.regexp_extract(line, ITEM, 2))).otherwise(line)
    number = F.when(item, F.regexp_extract(line, ITEM, 1).cast("int"))
    first = F.struct(F.coalesce("list", F.lit(NO_LIST)).alias("list"), F.coalesce("section", F.lit("")).alias("section"), F.coalesce("supplementary", F.lit(False)).alias("supplementary"), "ordinal", F.coalesce(F.nullif(number, F.lit(0)), F.col("ordinal")).cast("bigint").alias("printed_ordinal"))
    parts = got.filter((item | (kind == "more")) & (F.col("entry_no") > 0)).select(*by, "entry_no", item.alias("item"), first.alias("first"), F.struct(*order, body.alias("body")).alias("part"))
    one = parts.groupBy(*by, "entry_no").agg(F.max_by("first", "item").alias("first"), F.array_sort(F.collect_list("part")).alias("parts"))
    return one.select(*by, "entry_no", "first.*", F.array_join(F.transform("parts", lambda p: p["body"]), " ").alias("entry"))


def _strip(c: Column, marks: str) -> Column:
    return F.regexp_replace(c, rf"^[{marks}]+|[{marks}]+$", "")


def entry_parts(entry: Column) -> Column:
    """struct(author, title, year, title_at, year_at): the parts of a mixed entry and where they stand (from 1; 0 if nowhere).

    Sentences end at a period and blanks, unless a word's own period comes before it.  The author is what stands before
    the first period, the title the second sentence; if next to nothing stands there, or there is one sentence only,
    the first quoted piece; else the entry itself.  The year is the last one.
    """
    sentences = F.filter(F.split(entry, r"(?<!\w\.)\.\s+"), lambda s: F.trim(s) != "")
    quoted = F.nullif(F.regexp_extract(entry, '[“”"]([^“”"]{4,})[“”"]', 1), F.lit(""))
    second = _strip(F.trim(F.get(sentences, F.lit(1))), " .,;:")
    in_quotes = _strip(quoted, " .")
    title = F.when(F.size(sentences) >= 2, F.when(quoted.isNotNull() & (F.length(second) < 4), in_quotes).otherwise(second)).otherwise(F.coalesce(in_quotes, F.substring(entry, 1, TITLE_CHARS)))
    author = F.substring(F.trim(F.split_part(entry, F.lit("."), F.lit(1))), 1, AUTHOR_CHARS)
    years = F.regexp_extract_all(entry, F.lit(YEAR))
    year = F.coalesce(F.get(years, F.size(years) - 1), F.lit(""))
    from_second = F.when((F.size(sentences) >= 2) & (title == second), F.length(F.get(sentences, F.lit(0))) + 1).otherwise(1)
    title_at = F.when(title == "", 0).otherwise(F.call_function("locate", title, entry, from_second))
    year_at = F.when(year == "", 0).otherwise(F.length(F.regexp_extract(entry, rf"(?s)^(.*){YEAR}", 1)) + 1)
    return F.struct(author.alias("author"), title.alias("title"), year.alias("year"), title_at.alias("title_at"), year_at.alias("year_at"))

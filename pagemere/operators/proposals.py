"""Files and catalogue records that may belong together, and what is still missing from a record, with every reason."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemere.operators import link, rules
from pagemere.sources.shared import apart, written

# Words that say nothing of a title, and particles that are no surname.
TITLE_STOP = ("the", "a", "an", "of", "and", "in", "on", "el", "la", "los", "las", "un", "una", "de", "del", "y", "en", "que")
FILE_STOP = ("the", "a", "an", "of", "and", "in", "to", "for", "from", "on", "with", "la", "el", "los", "las", "de", "del", "y", "en", "un", "una", "al")
PARTICLES = ("de", "del", "la", "y", "von")
SURNAME_BONUS, PROPOSED, TITLE_MATCH = 0.3, 0.6, 0.5


def _latin() -> tuple[str, str]:
    """Letters with marks, and what they are without."""
    pairs = [(c, d[0]) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(d := unicodedata.normalize("NFD", c)) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _BARE = _latin()


def plain(c: Column) -> Column:
    """Lower-cased and without accents by built-in functions, for Latin letters."""
    return F.replace(F.lower(F.translate(F.regexp_replace(c, "[\u0300-\u036f]", ""), _MARKED, _BARE)), F.lit("ß"), F.lit("ss"))


def title_words(c: Column, stop: tuple[str, ...], apart: str = r"[^\p{L}\p{N}]+") -> Column:
    """Words of three letters or more, once each, without those that say nothing."""
    words = F.split(F.regexp_replace(plain(c), apart, " "), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*stop)))


def file_parts(name: Column) -> Column:
    """struct(title, author) of ``Title -- Author -- provenance ... .pdf``."""
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(?<=.)\.[^. ]+$", "")
    parts = F.transform(F.split(stem, " -- "), lambda x: F.trim(x))
    return F.struct(F.get(parts, F.lit(0)).alias("title"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("author"))


def surname(author: Column) -> Column:
    """The last word before the first comma that is no particle; empty if there is none."""
    words = F.split(F.regexp_replace(F.split_part(plain(author), F.lit(","), F.lit(1)), r"[^a-z\s-]", " "), r"[\s-]+")
    words = F.filter(words, lambda w: (w != "") & ~w.isin(*PARTICLES))
    return F.coalesce(F.get(words, F.size(words) - 1), F.lit(""))


def file_candidates(files: DataFrame, works: DataFrame, least: float = PROPOSED, most: int = 3) -> DataFrame:
    """(file, work, score, rank): the best ``most`` of works(work, author, title) for each of files(file, name).

    The score is the share of the record's words that the name's title and author hold, +0.3 if the record's author
    has the name's surname, at most 1, two digits; ties by work.  Only scores of ``least`` count.
    """
    f = files.select(F.col("file").alias("b"), file_parts(F.col("name")).alias("p"))
    f = f.select("b", F.array_union(*(title_words(F.col(f"p.{x}"), FILE_STOP) for x in ("title", "author"))).alias("tb"), surname(F.col("p.author")).alias("sur"))
    w = works.select(F.col("work").alias("a"), title_words(F.concat_ws(" ", "author", "title"), FILE_STOP).alias("ta"), plain(F.coalesce("author", F.lit(""))).alias("who"))
    # alike names and alike records are compared once; of alike records only the first ones count
    # a compressed file says little of the rows it becomes, so what follows the tables' size is never broadcast
    known = w.select(F.explode("ta").alias("t")).distinct().join(apart(f.select("b", F.explode("tb").alias("t"))), "t")
    f = f.join(apart(known.groupBy("b").agg(F.array_sort(F.collect_list("t")).alias("key"))), "b").select("b", "key", "sur")
    first = F.row_number().over(Window.partitionBy("ta", "who").orderBy("a"))
    w = written(w.filter("a IS NOT NULL").withColumn("ta", F.array_sort("ta")).withColumn("first", first).filter(F.col("first") <= most).select("a", "ta", "who"), "records")
    f = written(f, "names")
    alike = written(f.select("key", "sur").distinct().withColumn("b", F.monotonically_increasing_id()), "alike").withColumnRenamed("key", "tb")
    brief_w, brief_f = (F.size(c) <= link.SUBSET_WORDS for c in ("ta", "tb"))
    names = written(_holding(w.select("who"), alike.select("sur")), "holding")
    rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("score"), "work"))
    best, left = None, alike
    # full scores first; what has enough of them is done, the rest is compared down to the least score
    for lowest in (1.0, least):
        # two digits are kept, so half of the last one may be missing before rounding
        got = link.best_by_sets(w.filter(brief_w), left.filter(brief_f), names, lowest - 0.005, 0.995, SURNAME_BONUS, most)
        for x, y in ((w.filter(~brief_w), left), (w.filter(brief_w), left.filter(~brief_f))):
            pairs = link.covered(apart(x), apart(y), lowest - 0.005, [(None, SURNAME_BONUS)]).join(apart(w.select("a", "who")), "a").join(apart(left.select("b", "sur")), "b")
            got = got.union(pairs.select("b", "a", F.col("n").alias("k"), F.col("n_tokens").alias("h"), (F.col("sur") != "") & F.col("who").contains(F.col("sur"))))
        score = F.least(F.lit(1.0), F.round(F.col("k") / F.col("h") + F.when(F.col("named"), SURNAME_BONUS).otherwise(0.0), 2))
        scored = got.select("b", F.col("a").alias("work"), score.alias("score")).filter(F.col("score") >= lowest).groupBy("b", "work").agg(F.max("score").alias("score"))
        top = written(scored.withColumn("rank", rank).filter(F.col("rank") <= most), "best")
        if lowest > least:
            done = top.filter(F.col("rank") == most).select("b")
            best, left = top.join(apart(done), "b", "left_semi"), written(alike.join(apart(done), "b", "left_anti"), "left")
        else:
            best = top if best is None else best.union(top)
    best = best.join(apart(alike), "b").select(F.col("tb").alias("key"), "sur", "work", "score", "rank")
    return f.withColumnRenamed("b", "file").join(apart(best), ["key", "sur"]).select("file", "work", "score", "rank")


def _holding(who: DataFrame, sur: DataFrame) -> DataFrame:
    """(sur, who) of all different names where who contains sur, which isn't empty; they meet on sur's first three characters."""
    runs = F.transform(F.sequence(F.lit(1), F.length("who")), lambda i: F.substr(F.col("who"), i, F.lit(3)))
    starts = F.array_distinct(F.flatten(F.transform(runs, lambda x: F.array(x, F.substring(x, 1, 2), F.substring(x, 1, 1)))))
    left = who.distinct().filter("who <> ''").select("who", F.explode(starts).alias("g"))
    right = sur.distinct().filter("sur <> ''").select("sur", F.substring("sur", 1, 3).alias("g"))
    return left.join(apart(right), "g").filter(F.col("who").contains(F.col("sur"))).select("sur", "who").distinct()


#: (rule, holds, what it says): every rule that holds is a reason why a record is still open, the first the main one.
OPEN = (
    ("no_file", "isbn IS NULL AND NOT has_file", "'no file, so no ISBN from a PDF'"),
    ("no_isbn", "isbn IS NULL AND has_file AND why IS NOT NULL", "concat('no ISBN from the PDF (', why, ')')"),
    ("not_scanned", "isbn IS NULL AND has_file AND why IS NULL", "'PDF not scanned by isbns.py'"),
    ("unknown_isbn", "isbn IS NOT NULL AND NOT found", "concat('ISBN ', isbn, ' not in the catalogues')"),
    ("catalogue_lacks", "found AND size(lacks) > 0", "concat(source, ' has no ', array_join(lacks, ', '))"),
    ("other_title", "found AND NOT accepted", "'the titles differ'"),
)
_IMPRINT = ("publisher", "place", "year")


def isbn_picks(rows: DataFrame) -> DataFrame:
    """(work_id, pdf_isbn, why) of rows(work_id, line, isbn13, pick, why): the last line picked, else the first's reason."""
    picked = F.col("pick") == "yes"
    one = rows.groupBy("work_id").agg(F.max_by(F.when(picked, F.struct("isbn13", "why")), F.when(picked, F.col("line"))).alias("y"), F.min_by("why", "line").alias("first_why"))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return one.select("work_id", blank(F.col("y.isbn13")).alias("pdf_isbn"), blank(F.when(F.col("y").isNotNull(), F.col("y.why")).otherwise(F.col("first_why"))).alias("why"))


def catalogue_proposals(works: DataFrame, picks: DataFrame, known: DataFrame) -> DataFrame:
    """A row for each of works(id, title, publisher, place, year, isbn, has_file) that lacks something.

    ``picks`` is isbn_picks' result; known(isbn, title, publisher, place, year, source) is what catalogues say, a row an
    ISBN.  ``accept`` is true if the titles agree; ``missing`` what the record lacks, ``still`` what is left after the
    proposal; ``reasons`` every rule of ``OPEN`` that holds, in order.
    """
    blank = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    w = works.select("id", "title", *(blank(c).alias(c) for c in (*_IMPRINT, "isbn")), F.coalesce("has_file", F.lit(False)).alias("has_file"))
    w = w.join(picks.withColumnRenamed("work_id", "id"), "id", "left")
    k = known.select(F.col("isbn").alias("k_isbn"), F.col("title").alias("title_found"), *(blank(c).alias(f"{c}_found") for c in _IMPRINT), "source")
    lacking = F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in _IMPRINT)), lambda x: x.isNotNull())
    w = w.withColumn("isbn_from", F.when(F.col("isbn").isNotNull(), "record").when(F.col("pdf_isbn").isNotNull(), "pdf"))
    w = w.withColumn("missing", lacking).filter((F.size("missing") > 0) | (F.col("isbn").isNull()))
    w = w.withColumn("isbn", F.coalesce("isbn", "pdf_isbn")).join(k, F.col("isbn") == F.col("k_isbn"), "left")
    alike = F.round(rules.title_similarity(*(title_words(F.col(c), TITLE_STOP, "[^a-z0-9]+") for c in ("title", "title_found"))), 2)
    w = w.withColumn("found", F.col("k_isbn").isNotNull()).withColumn("title_match", F.when(F.col("found"), F.coalesce(alike, F.lit(0.0))))
    w = w.withColumn("accepted", F.coalesce(F.col("title_match") >= TITLE_MATCH, F.lit(False)))
    lacks = F.filter(F.array(*(F.when(F.array_contains("missing", c) & F.col(f"{c}_found").isNull(), F.lit(c)) for c in _IMPRINT)), lambda x: x.isNotNull())
    w = w.withColumn("lacks", lacks)
    reasons = F.array(*(F.when(F.expr(holds), F.struct(F.lit(rule).alias("rule"), F.expr(says).alias("reason"))) for rule, holds, says in OPEN))
    still = F.when(F.col("isbn").isNull(), F.concat("missing", F.array(F.lit("isbn")))).when(F.col("found"), F.col("lacks")).otherwise(F.col("missing"))
    found = [F.col(f"{c}_found") for c in _IMPRINT]
    return w.select("id", "isbn", "isbn_from", "title_match", F.col("accepted").alias("accept"), "title_found", *found, "source", "missing", still.alias("still"), F.filter(reasons, lambda x: x.isNotNull()).alias("reasons"))

"""Study aids: reading units, quotation and wording checks of claims, verdicts, references, and the stored aid.

The text generator that proposes claims is not part of this; claims come in as rows.
claims(work_id, claim_id, unit, claim, example) and quotes(work_id, claim_id, n, text, near).
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemere.functions.text import folded
from pagemere.sources.shared import written

# Sizes of units in pages; sizes of an aid; tags of a claim.
WINDOW_PAGES, MAX_UNIT_PAGES, LEAST_CHARS, FIRST_CITABLE = 30, 45, 50, 1
MAX_ARGUMENTS, MAX_TERMS, MAX_QUOTES, MAX_BRIDGES = 12, 12, 2, 3
PARTIAL_TAG, NAMES_TAG = "respaldo-parcial", "revisar-nombres"
_WORD = r"(\p{L}{2,}|\d+)"


def units(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """(work_id, n, title, first_page, last_page, pages): chapters of a work with two sections or more, else windows.

    pages(work_id, page_index, printed_page, text), sections(work_id, ordinal, title, first_page, last_page).  Blank
    pages and front matter are left out.  More than three pages outside every chapter are a unit of their own.
    A chapter over 45 pages, or one without a title, is read in windows of 30.
    """
    used = pages.filter((F.length("text") >= LEAST_CHARS) & (F.col("printed_page") >= FIRST_CITABLE)).select("work_id", "page_index", "printed_page")
    along = Window.partitionBy("work_id").orderBy("ordinal")
    s = sections.withColumn("many", F.count("*").over(Window.partitionBy("work_id"))).filter("many >= 2")
    s = s.select(F.col("work_id").alias("s_work"), "ordinal", "title", "first_page", F.coalesce("last_page", F.lead("first_page").over(along) - 1, F.lit(10**6)).alias("last_page"))
    placed = used.join(s, (F.col("work_id") == F.col("s_work")) & F.col("printed_page").between(F.col("first_page"), F.col("last_page")), "left").drop("first_page", "last_page")
    mapped = s.select(F.col("s_work").alias("work_id")).distinct().withColumn("mapped", F.lit(True))
    placed = placed.join(mapped, "work_id", "left").withColumn("title", F.coalesce("title", F.lit(""))).withColumn("stray", F.col("mapped").isNotNull() & F.col("ordinal").isNull())
    whole = Window.partitionBy("work_id", "ordinal")
    placed = placed.withColumn("size", F.count("*").over(whole)).filter(~F.col("stray") | (F.col("size") > 3))
    nth = F.row_number().over(whole.orderBy("page_index")) - 1
    cut = F.when(~F.col("stray") & ((F.col("size") > MAX_UNIT_PAGES) | (F.col("title") == "")) | (F.col("stray") & (F.col("size") > MAX_UNIT_PAGES)), F.floor(nth / WINDOW_PAGES)).otherwise(0)
    got = placed.withColumn("window", cut).withColumn("begins", F.min("page_index").over(whole)).withColumn("title", F.when(F.col("stray"), "pages outside the index").otherwise(F.col("title")))
    first, last = F.min_by("printed_page", "page_index"), F.max_by("printed_page", "page_index")
    out = got.groupBy("work_id", "begins", F.coalesce("ordinal", F.lit(10**6)).alias("ordinal"), "window", "title").agg(first.alias("first_page"), last.alias("last_page"), F.count("*").alias("pages"))
    n = F.row_number().over(Window.partitionBy("work_id").orderBy("begins", "ordinal", "window"))
    return out.select("work_id", n.alias("n"), "title", "first_page", "last_page", "pages")


def words(c: Column) -> Column:
    """To be exploded by an outer explode: before an inner one Spark filters by the size, which runs the pattern again."""
    return F.regexp_extract_all(c, F.lit(_WORD), 1)


def common_words(chunks: DataFrame, lang: str = "spanish", least: int = 3) -> DataFrame:
    """(word): folded words that stand in lower case at least three times in a language's chunks."""
    each = chunks.filter(F.col("lang") == lang).select(F.explode_outer(words(F.col("text"))).alias("w"))
    lower = each.filter(F.col("w").rlike(r"^\p{Ll}")).groupBy("w").agg(F.count("*").alias("n"))
    return lower.groupBy(folded(F.col("w"), "c").alias("word")).agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("word")


def vocabulary(pages: DataFrame) -> DataFrame:
    """(work_id, word): folded words of a work; distinct words are folded, not each place."""
    raw = pages.select("work_id", F.explode_outer(F.array_distinct(words(F.col("text")))).alias("w")).filter("w IS NOT NULL").distinct()
    return raw.select("work_id", folded(F.col("w"), "c").alias("word")).distinct()


def unfound(texts: DataFrame, known: DataFrame, common: DataFrame, cutoff: float = 0.8) -> DataFrame:
    """texts(work_id, id, text): (work_id, id, unfound), capitalised words and numbers that the work doesn't hold.

    Common words pass.  A word of four letters or more also passes if the work has one of the same initial that
    matches closely; only words not found as they are come to that test, each once a work.
    """
    known = written(known, "vocabulary")  # read three times
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), r"\bc\d+\b", " ")
    each = texts.select("work_id", "id", F.posexplode_outer(words(clean)).alias("at", "token")).filter(F.col("token").rlike(r"^[\p{Lu}\d]"))
    each = each.withColumn("word", folded(F.col("token"), "c"))
    each = written(each.join(common.select("word"), "word", "left_anti").join(known, ["work_id", "word"], "left_anti"), "unknown-words")
    doubtful = each.filter((F.length("word") >= 4) & ~F.col("word").rlike(r"^\d")).select("work_id", "word").distinct().withColumn("initial", F.substring("word", 1, 1))
    near = known.filter((F.length("word") >= 4) & ~F.col("word").rlike(r"^\d")).select("work_id", F.col("word").alias("other"), F.substring("word", 1, 1).alias("initial"))
    # Different words are compared once, not once a work.  A ratio of 0.8 bounds the lengths: 2 * min >= 0.8 * (a + b).
    length = F.length("word")
    lengths = F.sequence(F.ceil(length * cutoff / (2 - cutoff) - 1e-6).cast("int"), F.floor(length * (2 - cutoff) / cutoff + 1e-6).cast("int"))
    asked = doubtful.select("word", "initial").distinct().withColumn("size", F.explode(lengths))
    held = near.select("other", "initial").distinct().withColumn("size", F.length("other"))
    pairs = asked.join(held, ["initial", "size"]).filter(2 * F.least(F.length("word"), F.length("other")) >= cutoff * (F.length("word") + F.length("other")))
    # What doesn't match is deleted or inserted, so the edit distance is at most the rest of both words; a cheap test first.
    pairs = pairs.withColumn("most", F.floor((1 - cutoff) * (F.length("word") + F.length("other")) + 1e-6).cast("int")).filter("levenshtein(word, other, most) >= 0")

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            m = difflib.SequenceMatcher(None, y, x)
            m.set_seqs(x, y)  # the word is the first sequence, as in a lookup of close matches
            return m.quick_ratio() >= cutoff and m.ratio() >= cutoff

        return pd.Series([one(y, x) for x, y in zip(a, b, strict=True)])

    alike = pairs.filter(close("word", "other")).select("word", "other")
    passed = alike.join(doubtful.select("work_id", "word"), "word").join(near.select("work_id", "other"), ["work_id", "other"], "left_semi").select("work_id", "word").distinct()
    left = each.join(passed, ["work_id", "word"], "left_anti").groupBy("work_id", "id", "token").agg(F.min("at").alias("at"))
    lists = left.groupBy("work_id", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("unfound"))
    return texts.select("work_id", "id").join(lists, ["work_id", "id"], "left").select("work_id", "id", F.coalesce("unfound", F.array().cast("array<string>")).alias("unfound"))


def verified(claims: DataFrame, quotes: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): claims with a quotation found on a citable page, with what was found and what was lost.

    hits(work_id, claim_id, n, page, text): where the matcher found the quotations; a missing row is a miss.
    """
    h = hits.filter(F.col("page") >= FIRST_CITABLE).select("work_id", "claim_id", "n", "page", F.col("text").alias("found"))
    q = quotes.join(h, ["work_id", "claim_id", "n"], "left")
    good, bad = F.struct("n", "page", F.col("found").alias("text")), F.struct("n", F.col("near").alias("page"), "text")
    lists = q.groupBy("work_id", "claim_id").agg(F.array_sort(F.collect_list(F.when(F.col("page").isNotNull(), good))).alias("quotes"), F.array_sort(F.collect_list(F.when(F.col("page").isNull(), bad))).alias("lost"))
    both = claims.join(lists, ["work_id", "claim_id"], "left").withColumn("ok", F.coalesce(F.size("quotes") > 0, F.lit(False)))
    return both.filter("ok").drop("ok"), both.filter("not ok").drop("ok").withColumn("reason", F.lit("no quotation found in the book"))


def batches(claims: DataFrame, size: int = 20) -> DataFrame:
    """Claims of a work in batches of twenty, in their order."""
    return claims.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("work_id").orderBy("claim_id")) - 1) / size))


def judged(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """claims with ``verdict`` and the ``reason`` to drop each that is unsupported or has no verdict; null for the rest."""
    v = verdicts.select("work_id", "claim_id", F.col("verdict").alias("_v"), F.col("reason").alias("_r"))
    got = claims.join(v, ["work_id", "claim_id"], "left").withColumn("verdict", F.coalesce("_v", F.lit("unchecked")))
    why = F.concat(F.lit("check: "), F.coalesce(F.nullif("_r", F.lit("")), F.lit("quotations do not support it")))
    return got.withColumn("reason", F.when(F.col("verdict") == "unsupported", why).when(F.col("verdict") == "unchecked", "check returned no verdict")).drop("_v", "_r")


def body(claim: Column, example: Column) -> Column:
    e = F.trim(F.coalesce(example, F.lit("")))
    return F.concat(F.trim(claim), F.when(e != "", F.concat(F.lit("\n\nEjemplo: "), e)).otherwise(""))


def tags(verdict: Column, missing: Column) -> Column:
    return F.array_compact(F.array(F.lit("dossier"), F.when(verdict == "partial", PARTIAL_TAG), F.when(F.size(missing) > 0, NAMES_TAG)))


def checked_references(entries: DataFrame, claims: DataFrame) -> DataFrame:
    """entries(work_id, entry, claim_ids, refs array<struct<claim,n>>) with only claims that exist and quotations in range.

    claims(work_id, claim_id, n_quotes).  Order and repeats stay; at most two quotations a entry; ``reason`` says why an
    entry falls out.
    """
    c = claims.select("work_id", F.col("claim_id").alias("claim"), "n_quotes")
    key = ["work_id", "entry"]
    ids = entries.select(*key, F.posexplode("claim_ids").alias("at", "claim")).join(c, ["work_id", "claim"]).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "claim"))), lambda x: x["claim"]).alias("cited"))
    refs = entries.select(*key, F.posexplode("refs").alias("at", "r")).select(*key, "at", F.col("r.claim").alias("claim"), F.col("r.n").alias("n")).join(c, ["work_id", "claim"])
    refs = refs.filter(F.col("n").between(1, F.col("n_quotes"))).groupBy(*key).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("at", "claim", "n"))), 1, MAX_QUOTES), lambda x: F.struct(x["claim"].alias("claim"), x["n"].alias("n"))).alias("quotes"))
    got = entries.select(*key).join(ids, key, "left").join(refs, key, "left")
    reason = F.when(F.col("cited").isNull(), "no verified claim").when(F.col("quotes").isNull(), "no valid quotation reference")
    return got.select(*key, "cited", "quotes", reason.alias("reason"))


def groups_by_unit(claims: DataFrame) -> DataFrame:
    """(work_id, group, unit, claims): runs of claims of one unit in their order."""
    along = Window.partitionBy("work_id").orderBy("claim_id")
    new = F.when(F.lag("unit").over(along).eqNullSafe(F.col("unit")) & (F.row_number().over(along) > 1), 0).otherwise(1)
    run = claims.withColumn("new", new).withColumn("group", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("work_id", F.col("group").cast("int").alias("group"), "unit").agg(F.array_sort(F.collect_list("claim_id")).alias("claims"))


def without_front_matter(claims: DataFrame) -> DataFrame:
    """Quotations before page 1 go; so does a claim left with none."""
    return claims.withColumn("quotes", F.filter("quotes", lambda q: q["page"] >= FIRST_CITABLE)).filter(F.size("quotes") > 0)


def load_claims(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The next claims: reviewed or rejected ones stay; the unreviewed ones of a work with fresh ones are replaced."""
    works = fresh.select("work_id").distinct()
    decided = stored.filter(F.col("reviewed") | F.col("rejected"))
    open_ = stored.filter(~(F.col("reviewed") | F.col("rejected"))).join(works, "work_id", "left_anti")
    return decided.unionByName(open_).unionByName(fresh, allowMissingColumns=True)


_CITED = "array<struct<text:string,claims:array<string>,unfound:array<string>>>"
_QUOTE = "struct<claim:string,n:int,page:int,text:string>"
SHAPES = {
    "summary": f"struct<paragraphs:{_CITED}>",
    "argument": f"struct<key_arguments:array<struct<title:string,text:string,example:string,claims:array<string>,quotes:array<{_QUOTE}>>>>",
    "key_terms": f"struct<terms:array<struct<term:string,definition:string,claims:array<string>,quote:{_QUOTE}>>>",
    "themes": f"struct<themes:array<struct<theme:string,bridges:{_CITED}>>>",
}


def aids(sections: DataFrame) -> DataFrame:
    """sections(work_id, kind, body, reviewed): one row a work that has an argument; a body that doesn't parse is empty."""
    used = sections.filter(F.col("kind").isin(*SHAPES))
    got = used.groupBy("work_id").agg(F.bool_and("reviewed").alias("reviewed"), *(F.max(F.when(F.col("kind") == k, F.coalesce("body", F.lit("")))).alias(k) for k in SHAPES))
    field = {"summary": "paragraphs", "argument": "key_arguments", "key_terms": "terms", "themes": "themes"}

    def part(k: str) -> Column:
        v = F.from_json(k, SHAPES[k])[field[k]]
        return F.coalesce(v, F.array().cast(SHAPES[k].split(":", 1)[1][:-1])).alias(k)

    return got.filter("argument is not null").select("work_id", "reviewed", *map(part, SHAPES))

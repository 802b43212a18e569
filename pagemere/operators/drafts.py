"""Drafted notes admitted as a whole or not at all: all quotations of all drafts are searched in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemere.functions.text import normalized
from pagemere.operators import matcher
from pagemere.operators.ordered import numbered
from pagemere.operators.rules import blank, not_citable_because
from pagemere.sources.shared import written

# The tag that drafts may not have, the first page that can be cited.
RESERVED_TAG, FIRST_PAGE = "dossier", 1

#: (holds, what a draft is told): every rule that holds is a reason.
RULES = (
    ("body IS NULL", "the note needs a body"),
    ("asked = 0", "a note needs at least one quotation"),
    ("attribution = 'own'", "'own' is not a draft's to assign"),
    ("attribution NOT IN ('own', 'author', 'other')", "attribution is 'author', 'other' or empty"),
    ("attributed_to IS NOT NULL AND attribution IS DISTINCT FROM 'other'", "attributed_to goes only with attribution 'other'"),
    ("attribution = 'other' AND attributed_to IS NULL", "attribution 'other' needs attributed_to"),
    (f"array_contains(tags, '{RESERVED_TAG}')", f"the tag '{RESERVED_TAG}' is reserved"),
)


def _reasons(rules: tuple) -> Column:
    return F.filter(F.array(*(F.when(F.expr(holds), F.lit(says)) for holds, says in rules)), lambda x: x.isNotNull())


def admit(drafts: DataFrame, quotations: DataFrame, pages: DataFrame, works: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notes to add, anchors to add, refused) of drafts(draft_id, body, attribution, attributed_to, title, tags) and
    quotations(draft_id, n, work_id, text, near).

    A draft is refused with every reason if it breaks a rule or if one of its quotations isn't found on a page that can
    be cited.  What is stored is the text and the page that the book has.  Notes get ids after those of ``notes``, in the
    order of drafts.  A repeated draft_id is one draft; quotations of no draft, and without a place ``n``, are not read.
    """
    tags = F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: F.coalesce(t, F.lit("")) != "")
    own = ("body", "attribution", "attributed_to", "title")
    d = drafts.dropDuplicates(["draft_id"]).select("draft_id", *(blank(F.trim(c)).alias(c) for c in own), tags.alias("tags"))
    q = quotations.filter("n IS NOT NULL").join(d.select("draft_id"), "draft_id", "left_semi")
    w = works.select(F.col("id").alias("work_id"), not_citable_because(*(F.col(c) for c in ("offset_checked", "offset_problem", "accepted"))).alias("why"), F.lit(True).alias("known"))
    hits = matcher.find(pages, q.select("draft_id", "n", "work_id", "text", "near"), ["draft_id", "n"])
    hits = hits.select("draft_id", "n", F.col("work_id").alias("h_work"), "page", "pages", "match", F.col("text").alias("stored"))
    same = (F.col("q.draft_id") == F.col("h.draft_id")) & (F.col("q.n") == F.col("h.n")) & (F.col("q.work_id") == F.col("h.h_work"))
    q = q.join(w, "work_id", "left").alias("q").join(hits.alias("h"), same, "left").select("q.*", "page", "pages", "match", "stored")
    short = F.length(normalized(F.col("text"))) < matcher.LEAST_CHARS
    failure = (
        F.when(F.col("known").isNull(), "no such work")
        .when(F.col("why").isNotNull(), F.col("why"))
        .when(F.col("text").isNull() | short, f"shorter than {matcher.LEAST_CHARS} characters")
        .when(F.col("page").isNull(), "not found in the page text")
        .when(F.col("page") < FIRST_PAGE, F.concat(F.lit("on front matter, printed page "), F.col("page").cast("string")))
    )
    failure = F.when(failure.isNotNull(), F.concat(F.lit("quotation "), F.col("n").cast("string"), F.concat(F.lit(" ("), F.coalesce("work_id", F.lit("")), F.lit("): ")), failure))
    q = q.withColumn("failure", failure)
    place = F.struct("n", "work_id", "page", "pages", "match", "stored", "failure")
    # a draft's quotations are one row of it: what a person writes into a note
    whole = q.groupBy("draft_id").agg(F.array_sort(F.collect_list(place)).alias("quotations"))
    d = d.join(whole, "draft_id", "left").withColumn("asked", F.coalesce(F.size("quotations"), F.lit(0)))
    failures = F.filter(F.transform("quotations", lambda x: x["failure"]), lambda x: x.isNotNull())
    d = d.withColumn("reasons", F.concat(_reasons(RULES), F.coalesce(failures, F.array().cast("array<string>"))))
    d = written(d, "drafts")  # the search is run once for all three results
    refused = d.filter(F.size("reasons") > 0).select("draft_id", "reasons")
    last = notes.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    good = numbered(d.filter(F.size("reasons") == 0).drop("reasons", "asked"), ["draft_id"], "row").join(F.broadcast(last)).withColumn("id", F.col("last") + 1 + F.col("row"))
    new = good.select("id", "draft_id", F.lit("note").alias("kind"), *own, "tags", F.lit("assistant").alias("origin"), F.lit(False).alias("reviewed"))
    anchors = good.select(F.col("id").alias("note_id"), "draft_id", F.posexplode("quotations").alias("i", "x"))
    anchors = anchors.select("note_id", "draft_id", (F.col("i") + 1).alias("ordinal"), "x.work_id", F.col("x.page").alias("printed_page"), "x.pages", "x.match", F.col("x.stored").alias("quote"))
    return new, anchors, refused

"""Writes on the graph of notes, for many requests at once: what is written, and a reason for each request refused.

Every function gives next tables as DataFrames; a request that breaks a rule is refused as a whole and named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemere.operators.rules import blank

# What a refused request is told.
NO_BODY, NO_WORK, NO_OTHER = "a note needs a body", "a ficha names at least one work", "attributed_to only means something when someone else says it"
NOT_AXIS, NOT_PLAIN, TOUCHES_NONE = "the parent is not an axis", "only a plain note can become a ficha", "the note has to touch a work first"


def _size(c: str) -> Column:
    return F.coalesce(F.array_size(c), F.lit(0))


def from_forms(forms: DataFrame, works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests for ``create``, refused): forms(form_id, work_ids, body, kind, printed_page, quote, attribution, attributed_to).

    With a page or a quotation the first work is anchored and the rest are what the note is about; else all are.
    """
    ids = F.array_distinct(F.filter(F.coalesce("work_ids", F.array().cast("array<string>")), lambda x: blank(x).isNotNull()))
    f = forms.withColumn("ids", ids).withColumn("quote", blank(F.col("quote")))
    known = f.select("form_id", F.explode("ids").alias("id")).join(works.select("id"), "id", "left_anti").groupBy("form_id").agg(F.min("id").alias("unknown"))
    f = f.join(known, "form_id", "left")
    why = F.coalesce(F.when(blank(F.col("body")).isNull(), NO_BODY), F.when(F.col("unknown").isNotNull(), F.concat(F.lit("no work with id "), F.col("unknown"))))
    f = f.withColumn("why", why)
    anchored = (F.col("printed_page").isNotNull() | F.col("quote").isNotNull()) & (F.size("ids") > 0)
    anchor = F.struct(F.element_at("ids", 1).alias("work_id"), "printed_page", "quote")
    about = F.transform(F.when(anchored, F.slice("ids", 2, 1_000_000)).otherwise(F.col("ids")), lambda w: F.struct(w.alias("work_id"), F.lit("about").alias("role")))
    asked = f.filter("why is null").select(
        "form_id", F.when(F.col("kind") == "question", "question").otherwise("note").alias("kind"), F.lit(None).cast("bigint").alias("parent_id"), F.trim("body").alias("body"), "attribution",
        F.when(F.col("attribution") == "other", F.col("attributed_to")).alias("attributed_to"), F.when(anchored, F.array(anchor)).otherwise(F.array().cast("array<struct<work_id:string,printed_page:int,quote:string>>")).alias("anchors"), about.alias("works"),
    )
    return asked, f.filter("why is not null").select("form_id", "why")


def create(notes: DataFrame, asked: DataFrame, origin: str = "human") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(notes, anchors, works, refused) to append, with ids after the largest there is and ordinals after the last sibling."""
    axes = notes.filter("kind = 'axis'").select(F.col("id").alias("parent_id"), F.lit(True).alias("is_axis"))
    a = asked.join(axes, "parent_id", "left")
    why = F.coalesce(
        F.when((F.col("kind") == "ficha") & (_size("works") == 0), NO_WORK),
        F.when(F.col("attributed_to").isNotNull() & ~F.col("attribution").eqNullSafe(F.lit("other")), NO_OTHER),
        F.when(F.col("parent_id").isNotNull() & F.col("is_axis").isNull(), NOT_AXIS),
    )
    a = a.withColumn("why", why)
    good = a.filter("why is null")
    last = notes.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    siblings = notes.groupBy(F.col("parent_id").alias("p"), F.col("kind").alias("k")).agg(F.coalesce(F.max("ordinal"), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("parent_id", "kind").orderBy("form_id"))
    numbered = good.withColumn("nth", nth).join(siblings, F.col("parent_id").eqNullSafe(F.col("p")) & (F.col("kind") == F.col("k")), "left")
    ordinal = F.when((F.col("kind") == "axis") | F.col("parent_id").isNotNull(), F.coalesce("before", F.lit(0)) + F.col("nth"))
    # ids follow the requests' own, so they don't hang on the order of arrival and no task numbers all rows
    made = numbered.join(F.broadcast(last), F.lit(True)).withColumn("id", F.col("last") + 1 + F.col("form_id")).withColumn("ordinal", ordinal.cast("int"))
    rows = made.select("id", "kind", "parent_id", "ordinal", "body", "attribution", "attributed_to", F.lit(origin).alias("origin"), F.lit(origin == "human").alias("reviewed"))
    anchors = made.select(F.col("id").alias("note_id"), F.posexplode("anchors").alias("at", "x")).select("note_id", (F.col("at") + 1).alias("ordinal"), "x.*")
    works = made.select(F.col("id").alias("note_id"), F.posexplode("works").alias("at", "x")).select("note_id", "x.work_id", "x.role", (F.col("at") + 1).alias("ordinal"))
    works = works.groupBy("note_id", "work_id").agg(F.min_by("role", "ordinal").alias("role"), F.min("ordinal").alias("ordinal"))
    return rows, anchors, works, a.filter("why is not null").select("form_id", "why")


def promote(notes: DataFrame, anchors: DataFrame, works: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notes, works, refused) after plain notes became fichas of axes: asked(note_id, axis_id), once a note.

    A ficha names every work the note touches; works it was about already become its ficha's.
    """
    touched = anchors.select("note_id", "work_id").union(works.select("note_id", "work_id")).distinct()
    some = touched.groupBy("note_id").agg(F.count("*").alias("touches"))
    n = notes.select(F.col("id").alias("note_id"), "kind", "rejected")
    axes = notes.filter("kind = 'axis'").select(F.col("id").alias("axis_id"), F.lit(True).alias("is_axis"))
    a = asked.join(n, "note_id", "left").join(some, "note_id", "left").join(axes, "axis_id", "left")
    plain = (F.col("kind") == "note") & ~F.col("rejected")
    a = a.withColumn("why", F.coalesce(F.when(F.col("touches").isNull(), TOUCHES_NONE), F.when(~F.coalesce(plain, F.lit(False)), NOT_PLAIN), F.when(F.col("is_axis").isNull(), NOT_AXIS)))
    before = notes.filter("kind = 'ficha'").groupBy(F.col("parent_id").alias("axis_id")).agg(F.coalesce(F.max("ordinal"), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("axis_id").orderBy("note_id"))
    moved = a.filter("why is null").withColumn("nth", nth).join(before, "axis_id", "left").select(F.col("note_id").alias("m_id"), "axis_id", (F.coalesce("before", F.lit(0)) + F.col("nth")).cast("int").alias("m_ordinal"))
    hit = F.col("m_id").isNotNull()
    after = notes.join(moved, notes.id == moved.m_id, "left").withColumns({"kind": F.when(hit, "ficha").otherwise(F.col("kind")), "parent_id": F.when(hit, F.col("axis_id")).otherwise(F.col("parent_id")), "ordinal": F.when(hit, F.col("m_ordinal")).otherwise(F.col("ordinal"))}).select(*notes.columns)
    fichas = touched.join(moved.select(F.col("m_id").alias("note_id")), "note_id", "left_semi").withColumn("role", F.lit("ficha"))
    rest = works.select("note_id", "work_id", "role").join(fichas.select("note_id", "work_id"), ["note_id", "work_id"], "left_anti")
    return after, rest.union(fichas), a.filter("why is not null").select("note_id", "why")


def demote(notes: DataFrame, works: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fichas of ids(note_id) are plain notes again; they stay about their works."""
    gone = notes.filter("kind = 'ficha'").join(ids.select(F.col("note_id").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("g_id"))
    hit = F.col("g_id").isNotNull()
    after = notes.join(gone, notes.id == gone.g_id, "left").withColumns({"kind": F.when(hit, "note").otherwise(F.col("kind")), "parent_id": F.when(~hit, F.col("parent_id")), "ordinal": F.when(~hit, F.col("ordinal"))}).select(*notes.columns)
    of = works.join(gone, works.note_id == gone.g_id, "left").withColumn("role", F.when(hit & (F.col("role") == "ficha"), "about").otherwise(F.col("role")))
    return after, of.select(*works.columns)


def link(links: DataFrame, new: DataFrame, both_ways: bool = False) -> DataFrame:
    """Links to append: those of new(from_note, to_note, kind) that aren't there; a note is never linked with itself."""
    if both_ways:
        new = new.union(new.select(F.col("to_note"), F.col("from_note"), "kind"))
    keys = ["from_note", "to_note", "kind"]
    return new.select(*keys).filter("from_note <> to_note").distinct().join(links.select(*keys), keys, "left_anti")


def stub_works(works: DataFrame, asked: DataFrame, slug: Column) -> tuple[DataFrame, DataFrame]:
    """(works to append, refused): asked(form_id, author, title, year, container_id) under ids made by ``slug``.

    Of requests with one id the first stands; ids that are there, and containers that aren't, are refused.
    """
    a = asked.withColumn("id", slug)
    first = a.groupBy("id").agg(F.min("form_id").alias("first"))
    there = works.select("id", F.lit(True).alias("there"))
    held = works.select(F.col("id").alias("container_id"), F.lit(True).alias("held"))
    a = a.join(first, "id", "left").join(there, "id", "left").join(held, "container_id", "left")
    why = F.coalesce(
        F.when(blank(F.col("title")).isNull() | blank(F.col("id")).isNull(), "a work needs a title"),
        F.when(F.col("there") | (F.col("form_id") > F.col("first")), F.concat(F.lit("there is a work with id "), F.col("id"))),
        F.when(F.col("container_id").isNotNull() & F.col("held").isNull(), F.concat(F.lit("no work with id "), F.col("container_id"))),
    )
    a = a.withColumn("why", why)
    return a.filter("why is null").select("id", "author", "title", "year", "container_id"), a.filter("why is not null").select("form_id", "why")


def project_delete(projects: DataFrame, tables: dict[str, DataFrame], project_id: int) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The project and its rows in each table of members are gone."""
    return projects.filter(F.col("id") != project_id), {n: t.filter(F.col("project_id") != project_id) for n, t in tables.items()}

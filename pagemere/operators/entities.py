"""Catalogue and files: names read off, list items matched to files, ISBN sightings, inventory, places on lists.

Pairs meet on a shared token or an equal ISBN.  Texts that fold alike are scored once and joined back.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemere.functions.text import _column, fold, folded, isbn13
from pagemere.operators import link
from pagemere.sources.shared import written

# Words that say nothing of a title; formats from best to worst; what tells an edition's kind.
STOP = (
    "the", "a", "an", "of", "and", "in", "on", "to", "for", "from", "with", "its", "el", "la", "los", "las", "un", "una", "de", "del", "y", "e", "en", "que", "su", "sus", "al", "lo",
    "por", "o", "sobre", "essays", "stories", "poems", "novel", "new", "tales",
)
RANK = {".pdf": 0, ".epub": 1, ".azw3": 2, ".txt": 3, ".zip": 4, ".lcpdf": 5}
KINDS = (
    ("ebook", "ebook|e-book|electronic|digital|online"), ("pdf", "pdf"), ("epub", "epub"), ("paper", "paperback|pbk|paper|rústica|rustica|softcover"),
    ("cloth", "hardcover|hardback|hbk|cloth|tapa dura|encuadernado"),
)
ACCEPT, REVIEW = 70, 45
_ISBN = r"(?i)(?<![\d-])((?:97[89][\d\s-]{10,17}|[\dX][\d\s-]{8,16}))(?![\d-])"


def tokens(c: Column) -> Column:
    """Folded words of three letters or more that aren't stop words, in order, repeats kept."""
    return F.filter(F.split(F.trim(F.regexp_replace(folded(c, "a"), "[^a-z0-9 ]+", " ")), " +"), lambda w: (F.length(w) > 2) & ~w.isin(*STOP))


def surname(c: Column) -> Column:
    """Folded: before the comma, else the last word; empty for none."""
    f = F.trim(F.regexp_replace(folded(F.when(c.contains(","), F.split(c, ",")[0]).otherwise(F.element_at(F.split(F.trim(c), r"\s+"), -1))), "[^a-z0-9 ]+", " "))
    return F.coalesce(f, F.lit(""))


def file_names(files: DataFrame) -> DataFrame:
    """files(name) with title, author, isbn and ext, from ``Title -- Author -- … isbn13 N ….pdf``."""
    stem = F.regexp_replace("name", r"\.[^.\s]*$", "")
    parts = F.split(stem, r"\s+--\s+")
    isbn = F.coalesce(F.nullif(F.regexp_extract(stem, r"isbn13\s*(\d{13})", 1), F.lit("")), F.nullif(F.regexp_extract(stem, r"(?<!\d)(97[89]\d{10})(?!\d)", 1), F.lit("")))
    return files.select("*", F.trim(parts[0]).alias("title"), F.coalesce(F.trim(F.try_element_at(parts, F.lit(2))), F.lit("")).alias("author"), isbn.alias("isbn"), F.lower(F.regexp_extract("name", r"(\.[^.\s]*)$", 1)).alias("ext"))


def item_file_scores(items: DataFrame, files: DataFrame) -> DataFrame:
    """items(item, title, author, isbn), files(file, title, author, isbn): (item, file, score), scores over 0.

    An equal ISBN is 100.  Titles of one or two tokens need them all and the author (90), or a short file title (65);
    longer ones score by their opening three tokens or by overlap, and 25 more for the author.
    """
    i = items.select("item", tokens(F.col("title")).alias("it"), surname(F.col("author")).alias("isn"), F.col("isbn").alias("ii"))
    f = files.select("file", tokens(F.col("title")).alias("ft"), surname(F.col("author")).alias("fsn"), F.col("isbn").alias("fi"))
    by_token = i.select("item", F.explode(F.array_distinct("it")).alias("t")).join(f.select("file", F.explode(F.array_distinct("ft")).alias("t")), "t").select("item", "file")
    by_isbn = i.filter("ii <> ''").select("item", "ii").join(f.filter("fi <> ''").select("file", "fi"), F.col("ii") == F.col("fi")).select("item", "file")
    p = by_token.union(by_isbn).distinct().join(i, "item").join(f, "file")
    n = F.size(F.array_intersect("it", "ft"))
    ratio = n / F.least(F.size("it"), F.size("ft"))
    named = (F.col("isn") != "") & (((F.col("fsn") != "") & (F.col("fsn").contains(F.col("isn")) | F.col("isn").contains(F.col("fsn")))) | F.array_join("ft", " ").contains(F.col("isn")))
    whole = F.size(F.array_except("it", "ft")) == 0
    opening = F.array_join("ft", " ").contains(F.array_join(F.slice("it", 1, 3), " "))
    base = F.when(opening, 85).when((ratio >= 0.75) & (n >= 2), 65).when((ratio >= 0.5) & (n >= 2), 45).when(n >= 3, 40).otherwise(0)
    short = F.when(whole & named, 90).when(whole & (F.size("ft") <= 3), 65).otherwise(0)
    score = F.when((F.col("ii") == F.col("fi")) & (F.col("ii") != ""), 100).when((F.size("it") == 0) | (F.size("ft") == 0), 0).when(F.size("it") <= 2, short).otherwise(base + F.when(named, 25).otherwise(0))
    return p.select("item", "file", score.alias("score")).filter("score > 0")


def item_files(scores: DataFrame, files: DataFrame, overrides: DataFrame) -> DataFrame:
    """(item, file, score, decision) of the best file of each item: overrides(item, file) win, then score, then format."""
    rank = F.coalesce(F.create_map(*(x for k, v in RANK.items() for x in (F.lit(k), F.lit(v))))[F.col("ext")], F.lit(9))
    best = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), rank, "file"))
    top = scores.join(files.select("file", "ext"), "file").withColumn("r", best).filter("r = 1").select("item", "file", "score")
    o = overrides.select("item", F.col("file").alias("chosen"))
    got = top.join(o, "item", "full")
    decision = F.when(F.col("chosen").isNotNull(), "override").when(F.col("score") >= ACCEPT, "accept").when(F.col("score") >= REVIEW, "review").otherwise("none")
    return got.select("item", F.coalesce("chosen", "file").alias("file"), F.when(F.col("chosen").isNull(), F.col("score")).alias("score"), decision.alias("decision"))


def split_entries(entries: DataFrame, works: DataFrame, matched: DataFrame) -> DataFrame:
    """(work, entry): works nobody claimed whose title, of two words or more, lies whole in an entry that is matched.

    entries(entry, text), works(work, title), matched(entry, work).  The first such entry is taken.  A work meets only
    the entries that have its rarest word.
    """
    e = entries.join(matched.select("entry").distinct(), "entry", "left_semi").select("entry", F.array_distinct(tokens(F.col("text"))).alias("et"))
    w = works.join(matched.select("work").distinct(), "work", "left_anti").select("work", F.array_distinct(tokens(F.col("title"))).alias("wt")).filter(F.size("wt") >= 2)
    held = link.covered(w.select(F.col("work").alias("a"), F.col("wt").alias("ta")), e.select(F.col("entry").alias("b"), F.col("et").alias("tb")), 1.0, [])
    return held.filter("n = n_tokens").groupBy(F.col("a").alias("work")).agg(F.min("b").alias("entry"))


def isbn_sightings(texts: DataFrame) -> DataFrame:
    """texts(id, page, text): (id, isbn13, kind, page), the best sighting of each; a labelled one beats an unlabelled."""
    # numbers are checked before rows are made: a filter on the column would work each out twice
    found = F.transform(F.regexp_extract_all("text", F.lit(_ISBN), 1), lambda r: F.struct(r.alias("raw"), isbn13(r).alias("isbn13")))
    raw = texts.select("id", "page", "text", F.inline(F.filter(found, lambda x: x["isbn13"].isNotNull())))
    # The 70 characters before and 40 after the sighting's own place.
    at = F.instr(F.col("text"), F.col("raw"))
    context = F.lower(F.substring(F.col("text"), F.greatest(F.lit(1), at - 70), F.least(at - 1, F.lit(70)) + F.length("raw") + 40))
    kind = F.lit(None).cast("string")
    for label, words in reversed(KINDS):
        kind = F.when(context.rlike(words), label).otherwise(kind)
    each = raw.withColumn("kind", kind)
    best = F.min_by(F.struct("kind", "page"), F.struct(F.col("kind").isNull(), F.col("page"), F.coalesce("kind", F.lit(""))))
    return each.groupBy("id", "isbn13").agg(best.alias("b")).select("id", "isbn13", "b.kind", "b.page")


def isbn_pick(sightings: DataFrame) -> DataFrame:
    """(id, isbn13, why): proposed only where one print ISBN was seen."""
    printed = ~F.coalesce(F.col("kind").isin("ebook", "pdf", "epub"), F.lit(False))
    got = sightings.groupBy("id").agg(F.count_if(printed).alias("n"), F.max(F.when(printed, F.col("isbn13"))).alias("isbn13"))
    return got.select("id", F.when(F.col("n") == 1, F.col("isbn13")).alias("isbn13"), F.when(F.col("n") == 1, "one print ISBN").when(F.col("n") == 0, "only ebook ISBNs").otherwise("several").alias("why"))


def inventory(works: DataFrame, typed: DataFrame, matched: DataFrame, pages: DataFrame) -> DataFrame:
    """(work, files, state): files typed in beat those matched; loaded if pages exist, mapped if files do, else missing."""
    t = typed.groupBy("work").agg(F.array_sort(F.collect_set("file")).alias("typed"))
    m = matched.groupBy("work").agg(F.array_sort(F.collect_set("file")).alias("matched"))
    p = pages.select(F.col("work_id").alias("work")).distinct().withColumn("loaded", F.lit(True))
    got = works.select("work").join(t, "work", "left").join(m, "work", "left").join(p, "work", "left")
    files = F.coalesce("typed", "matched")
    return got.select("work", files.alias("files"), F.when(F.col("loaded"), "loaded").when(files.isNotNull(), "mapped").otherwise("missing").alias("state"))


def placements(rows: DataFrame) -> DataFrame:
    """rows(line, list_id, section, status, work_id): (list_id, work_id, section_sort, ordinal).

    Sections are numbered by first sight within their list; a split shares the number of the entry before it.
    """
    used = rows.filter("status not in ('gone', 'new') and list_id is not null")
    first = used.filter("section <> ''").groupBy("list_id", "section").agg(F.min("line").alias("seen"))
    first = first.withColumn("section_sort", F.row_number().over(Window.partitionBy("list_id").orderBy("seen"))).drop("seen")
    along = Window.partitionBy("list_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    placed = used.filter("work_id <> ''").withColumn("ordinal", F.greatest(F.lit(1), F.sum((F.col("status") != "split").cast("int")).over(along)))
    return placed.join(first, ["list_id", "section"], "left").select("list_id", "work_id", "section_sort", F.col("ordinal").cast("int").alias("ordinal"))


def _file_key(name: str) -> str:
    return unicodedata.normalize("NFC", name).strip().casefold()


def repairs(name: str) -> list[str]:
    """What a name may have been before its UTF-8 was read in another encoding; itself first."""
    out = [name]
    for encoding in ("mac_roman", "cp1252", "latin-1"):
        try:
            out.append(name.encode(encoding).decode("utf-8"))
        except UnicodeError:
            pass
    return out


def repaired(cells: DataFrame, names: DataFrame) -> DataFrame:
    """cells(id, value): pipe-parted file names as the files in names(name) spell them; a repair must name a file.

    Nothing else is changed but directories dropped and composition.
    """

    @F.pandas_udf("array<array<string>>")
    def spellings(s: pd.Series) -> pd.Series:
        def each(v):
            parts = [unicodedata.normalize("NFC", p).strip().replace("\\", "/").rsplit("/", 1)[-1].strip() for p in (v or "").split("|")]
            return [repairs(p) for p in parts if p]

        return s.map(each)

    known = names.select(_column(_file_key)(F.col("name")).alias("key")).distinct().withColumn("known", F.lit(True))
    each = cells.select("id", F.posexplode_outer(spellings("value")).alias("part", "ways")).select("id", "part", F.posexplode_outer("ways").alias("way", "spelt"))
    got = each.withColumn("key", _column(_file_key)(F.col("spelt"))).join(known, "key", "left")
    best = got.groupBy("id", "part").agg(F.min_by("spelt", F.struct(F.col("known").isNull(), "way")).alias("spelt"))
    compose = _column(lambda t: unicodedata.normalize("NFC", t))
    return best.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", compose(F.col("spelt")).alias("s")))), lambda x: x["s"]), " | ").alias("value"))


#: Most needles, with a run of three characters each, that are sent to all tasks.
BROADCAST_NEEDLES = 100_000


def _runs(c: Column, n: int) -> Column:
    """All different runs of n characters."""
    at = F.when(F.length(c) >= n, F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))))
    return F.array_distinct(F.transform(F.coalesce(at, F.array().cast("array<int>")), lambda i: F.substr(c, i, F.lit(n))))


def needle(needles: DataFrame) -> DataFrame:
    """(needle): the folded texts to look for, each once."""
    return needles.select("match").distinct().select(_column(lambda t: fold(t.strip()))(F.col("match")).alias("needle")).distinct()


def needles_in_names(needles: DataFrame, names: DataFrame) -> DataFrame:
    """(needle, name) of folded needles(needle) that the folded names(name) hold.

    A needle meets the names on that of its runs of three characters which the fewest names have; one of fewer
    characters is such a run itself.  No side is compared with all of the other.
    """
    n = needles.filter("needle <> ''").distinct()
    f = names.select("name", folded(F.col("name")).alias("hay"))
    runs = n.filter("length(needle) > 2").select("needle", F.explode(_runs(F.col("needle"), 3)).alias("g"))
    held = f.select(F.explode(_runs(F.col("hay"), 3)).alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    rarest = runs.join(held, "g", "left").groupBy("needle").agg(F.min_by("g", F.struct(F.coalesce("n", F.lit(0)), "g")).alias("g"))
    keyed = written(rarest.union(n.filter("length(needle) <= 2").select("needle", F.col("needle").alias("g"))), "needles")
    size, shortest = keyed.agg(F.count("*"), F.min(F.length("g"))).first()
    hay = F.flatten(F.array(*(_runs(F.col("hay"), k) for k in range(min(shortest or 3, 3), 4))))
    keyed = F.broadcast(keyed) if size <= BROADCAST_NEEDLES else keyed
    return f.select("name", "hay", F.explode(hay).alias("g")).join(keyed, "g").filter(F.col("hay").contains(F.col("needle"))).select("needle", "name")


def name_matches(needles: DataFrame, names: DataFrame) -> DataFrame:
    """needles(work, match), names(name): files whose folded name holds a folded needle."""
    n = needles.select("work", _column(lambda t: fold(t.strip()))(F.col("match")).alias("needle")).distinct()
    return needles_in_names(n.select("needle"), names).join(n, "needle").select("work", "name").distinct()

"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Items become windows of ``size`` consecutive words (shorter items: one window).  Tokens are word shingles of
up to three words.  Tokens are ordered by how rare they are in the documents; since a window must be contained
in full, its necessary prefix is its one rarest token.  Documents' tokens are joined with those prefixes only.
A match at document position p of a token at offset o of the window gives the one possible place p - o; the
positional and length bounds are 0 <= p - o and p - o + length <= n_words.  The words there are then compared
in full.  Covered positions come from the union of the window places.

Both sides' tokens are 64-bit hashes, so the join is on longs, and the exact comparison makes collisions
harmless.  The windows are broadcast if their measured size is within ``BROADCAST_BYTES``; else matches are
found by a shuffled join on the token and verified after a join with the documents.

Defined results: null, empty and wordless texts have n_words 0 and no hits; items without words have no
windows; repeated item rows count once by item_id; repeated document rows each get their result; rows with one
doc_id and several texts are kept apart by the text's hash; a null doc_id is a row like any other.  An empty
benchmark gives no hits.  Other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Tables, ascii_lower

#: Everything below U+0080 but digits and a-z parts words (after A-Z is lower-cased).
_SEPARATORS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TOKEN = 3


def words(text: Column) -> Column:
    t = F.btrim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(_SEPARATORS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, _SPLIT))


def _token(ws: Column, at: Column, n: int) -> Column:
    """Hash of n words from position ``at`` (from 0); null past the end."""
    return F.when(at + n <= F.size(ws), F.xxhash64(F.lit(n), *(F.get(ws, at + i) for i in range(n))))


def windows(items: DataFrame, size: int) -> DataFrame:
    """``(item_id, window)``: the windows of each item, as arrays of words, once each."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w"))
    last = F.greatest(F.lit(0), F.size("w") - size)
    return w.filter(F.size("w") > 0).select("item_id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i + 1, size))).alias("window")).distinct()


def _matched(docs: DataFrame, prefixes: DataFrame, sizes: list[int], broadcast: bool) -> DataFrame:
    """``(doc_id, h, id, start)`` with prefixes ``(token, id, off, window)`` verified in the documents."""
    parts = []
    for n in sizes:
        own = prefixes.filter(F.col("n") == n).drop("n")
        at = docs.select("doc_id", "h", "w", F.posexplode("w").alias("p", "word")).select("doc_id", "h", "w", "p", _token(F.col("w"), F.col("p"), n).alias("token"))
        start = F.col("p") - F.col("off")
        fits = (start >= 0) & (start + F.size("window") <= F.size("w"))
        exact = F.slice("w", start + 1, F.size("window")) == F.col("window")
        if broadcast:
            hit = at.join(F.broadcast(own), "token").filter(fits & exact)
        else:
            place = at.select("doc_id", "h", "p", "token").join(own, "token")
            texts = docs.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "w").dropDuplicates(["d", "g"])
            hit = place.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))).filter(fits & exact)
        parts.append(hit.select("doc_id", "h", "id", start.alias("start"), F.size("window").alias("len")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row of docs(doc_id, text), against items(item_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = docs.sparkSession
    tables = Tables(spark, "decon")
    by_item = tables.write(windows(items, size), "windows")
    unique = by_item.groupBy("window").agg(F.min("item_id")).select("window", F.xxhash64("window").alias("id"))
    n_bytes = by_item.agg(F.coalesce(F.sum(64 + 24 * F.size("window") + F.length(F.array_join("window", ""))), F.lit(0))).first()[0]
    broadcast = n_bytes * TOKEN <= broadcast_bytes

    d = docs.select(F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("h"), words(F.col("text")).alias("w"))
    d = tables.write(d.withColumn("n_words", F.size("w").cast("bigint")), "words", "lz4")  # split once, read three times
    n = F.least(F.lit(TOKEN), F.size("window"))
    spots = unique.select("id", "window", n.alias("n"), F.explode(F.sequence(F.lit(0), F.size("window") - n)).alias("off"))
    token = F.when(F.col("n") == 1, _token(F.col("window"), F.col("off"), 1)).when(F.col("n") == 2, _token(F.col("window"), F.col("off"), 2)).otherwise(_token(F.col("window"), F.col("off"), TOKEN))
    spots = tables.write(spots.select("id", "window", "n", "off", token.alias("token")), "tokens")
    sizes = sorted(r[0] for r in spots.select("n").distinct().collect())  # 1, 2 and 3 at most
    if not sizes:
        return d.select("doc_id", "n_words", F.lit(0).cast("bigint").alias("n_hit"), F.lit(0).cast("bigint").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"))

    # how often each token of the benchmark stands in the documents
    kinds = spots.select("n", "token").distinct()
    seen = None
    for k in sizes:
        own = kinds.filter(F.col("n") == k).select("token")
        at = d.select("w", F.posexplode("w").alias("p", "word")).select(_token(F.col("w"), F.col("p"), k).alias("token"))
        part = at.join(F.broadcast(own) if broadcast else own, "token").groupBy("token").agg(F.count("*").alias("seen"))
        seen = part if seen is None else seen.union(part)
    seen = tables.write(seen, "rarity")
    ranked = spots.join(seen, "token", "left").select("id", "window", "n", "off", "token", F.coalesce("seen", F.lit(0)).alias("seen"))
    rarest = Window.partitionBy("id", "window").orderBy("seen", "token", "off")
    prefixes = ranked.withColumn("r", F.row_number().over(rarest)).filter("r = 1 and seen > 0").select("id", "window", "n", "off", "token")
    prefixes = tables.write(prefixes, "prefixes")

    hits = tables.write(_matched(d, prefixes, sizes, broadcast).distinct(), "hits")
    tables.drop(spots, seen, prefixes)
    # positions covered by the union of the places; a document has no more places than words and windows' lengths
    before = Window.partitionBy("doc_id", "h").orderBy("start", "stop")
    places = hits.select("doc_id", "h", "start", (F.col("start") + F.col("len")).alias("stop")).distinct()
    reach = F.coalesce(F.max("stop").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = places.select("doc_id", "h", F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), reach)).alias("new"))
    n_hit = covered.groupBy("doc_id", "h").agg(F.sum("new").cast("bigint").alias("n_hit"))
    of = by_item.select(F.xxhash64("window").alias("id"), "item_id")
    named = hits.select("doc_id", "h", "id").distinct().join(F.broadcast(of) if broadcast else of, "id").select("doc_id", "h", "item_id").distinct()
    n_items = named.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    found = n_hit.join(n_items, (n_hit.h == n_items.h) & n_hit.doc_id.eqNullSafe(n_items.doc_id)).select(n_hit.doc_id.alias("d"), n_hit.h.alias("g"), "n_hit", "items")
    rows = d.select("doc_id", "h", "n_words")
    out = rows.join(found, rows.doc_id.eqNullSafe(F.col("d")) & (rows.h == F.col("g")), "left")
    hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )

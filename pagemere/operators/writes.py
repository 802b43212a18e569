"""Writes as functions that give the next table: upsert, fill blanks, append what is absent, keep history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _match(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    return out


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of the same key; the rest stays."""
    kept = old.alias("o").join(new.select(*keys).distinct().alias("n"), _match(keys), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def append_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Only rows of ``new`` whose key isn't there yet, one a key."""
    return new.dropDuplicates(keys).alias("o").join(old.select(*keys).distinct().alias("n"), _match(keys), "left_anti")


def fill_blanks(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Null or empty values are filled from ``new``; others are never touched."""
    n = new.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in columns))
    out = old.join(n, F.col(key) == F.col("_key"), "left")
    filled = {c: F.coalesce(F.when(F.col(c).cast("string") != "", F.col(c)), F.col(f"_{c}")) for c in columns}
    return out.select(*(filled.get(c, F.col(c)).alias(c) for c in old.columns))


def patch(old: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A null leaves a value, unless ``clear`` (an array of column names) says to empty it."""
    n = changes.select(F.col(key).alias("_key"), "clear", *(F.col(c).alias(f"_{c}") for c in columns))
    out = old.join(n, F.col(key) == F.col("_key"), "left")
    now = {c: F.when(F.coalesce(F.array_contains("clear", c), F.lit(False)), F.lit(None)).otherwise(F.coalesce(f"_{c}", c)) for c in columns}
    return out.select(*(now.get(c, F.col(c)).alias(c) for c in old.columns))


def revise(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(next table, history): a row goes to the history only if one of the columns really differs."""
    n = new.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in columns))
    both = old.join(n, F.col(key) == F.col("_key"), "left").withColumn("_hit", F.col("_key").isNotNull())
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    after = both.select(*((F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) if c in columns else F.col(c)).alias(c) for c in old.columns))
    return after, both.filter(F.col("_hit") & differs).select(*old.columns)


def delete_cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    g = gone.select(F.col(key).alias("_gone")).distinct()
    return parents.join(g, F.col(key) == F.col("_gone"), "left_anti"), children.join(g, F.col(child_key) == F.col("_gone"), "left_anti")


def retag(notes: DataFrame, ids: list[int], add: list[str], remove: list[str]) -> DataFrame:
    """Tags are added, sorted and made distinct; then the removed ones are filtered out."""
    with_new = F.array_sort(F.array_distinct(F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array(*map(F.lit, add)).cast("array<string>"))))
    now = F.filter(with_new, lambda t: ~t.isin(*remove) if remove else F.lit(True))
    return notes.withColumn("tags", F.when(F.col("id").isin(*ids), now).otherwise(F.col("tags")))


def anchors_of(notes: DataFrame, arrays: list[str]) -> DataFrame:
    """notes(note_id, arrays of equal length): one row a place, numbered from 1 in order."""
    at = notes.select("note_id", F.posexplode(F.arrays_zip(*arrays)).alias("at", "z"))
    return at.select("note_id", (F.col("at") + 1).alias("ordinal"), *(F.col(f"z.{a}").alias(a) for a in arrays))


def manifest(df: DataFrame, name: str) -> DataFrame:
    """(name, row_count, checksum) of a table; the checksum doesn't depend on the order of rows."""
    row = F.xxhash64(*df.columns)
    return df.agg(F.count("*").alias("row_count"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("checksum")).select(F.lit(name).alias("name"), "row_count", "checksum")


def changed(applied: DataFrame, now: DataFrame) -> DataFrame:
    """(name): entries of a manifest(name, checksum) whose checksum is no longer the one applied."""
    n = now.select("name", F.col("checksum").alias("_now"))
    return applied.join(n, "name").filter(~F.col("checksum").eqNullSafe(F.col("_now"))).select("name")


def served(documents: DataFrame, payload: str, most: int = 8 << 20) -> DataFrame:
    """Binary documents in base 64 (``encoded``, null over the limit) and whether each ``fits``."""
    fits = F.length(payload) <= most
    return documents.select(*documents.columns, F.when(fits, F.regexp_replace(F.base64(payload), r"\s", "")).alias("encoded"), fits.alias("fits"))

"""Near-duplicate classes: MinHash, banding, signature and full-set verification, star components.

A document's set is its distinct k-word shingles, as 64-bit hashes.  ``hashes`` universal hash functions give
a signature of minima; ``bands`` bands of it put documents into buckets.  In each bucket all members are
compared with the bucket's leader (its smallest id), which settles most buckets.  Where members of one bucket
are still in different classes, the rest is compared in blocks of bounded size: the members outside the
bucket's largest class with each other and with that class.  A task gets two blocks, compares signatures as
matrices and emits the links of a spanning forest only.  So no bucket is collected, no pairs are emitted that
are not links, and no candidate pair of a bucket between two classes stays unchecked.  A pair counts if its
signatures' agreement is not implausible for the threshold (six standard deviations) and then only if the full
sets pass.

With 48 bands of 6 rows a pair at a similarity of 0.8 is missed with a probability of 5e-7.

Defined results: a null or wordless text has an empty set and is linked with nothing; repeated rows and ties
fall into one class, as do the rows of one id with several texts (a tag of each text keeps its set and signature apart, so
an id of many texts is not multiplied with itself); texts of any length count whole; a null id keeps its row, with a null class, and is kept; an empty table gives an empty
result; other columns are left alone (only id and text are read).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, only, small
from .components import components

_WORDS_MAX = 300_000
#: So many of the minima are kept to verify candidates.
VERIFIED = 128
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) >= _WORDS_MAX:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


_CACHE = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words make one shingle; no words, none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_CACHE.__getitem__, words), np.uint64, n)
    size = min(k, n)
    out = np.full(n - size + 1, size, np.uint64) * _MIX
    for i in range(size):
        out = _mix(out * _STEP + h[i : n - size + 1 + i])
    return np.unique(out)


def coefficients(hashes: int, seed: int = 20_240_601) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**32, hashes, np.uint32) | np.uint32(1), rng.integers(0, 2**32, hashes, np.uint32)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of a*x + b mod 2**32 over the set's hashes folded to 32 bits; in slices, so memory stays small."""
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    low = np.full(len(a), 2**32 - 1, np.uint32)
    for i in range(0, len(x), 256):
        np.minimum(low, (a[:, None] * x[None, i : i + 256] + b[:, None]).min(axis=1), out=low)
    return low.astype("<u4")


def _sets(batches: Iterator[pa.RecordBatch], k: int, hashes: int, bands: int) -> Iterator[pa.RecordBatch]:
    only(_CACHE)
    a, b = coefficients(hashes)
    rows = hashes // bands
    for batch in batches:
        ids, digests, sizes, keys, sigs = [], [], [], [], []
        seen: dict[bytes, tuple] = {}
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            s = shingle_set(text.as_py(), k)
            digest = _digest(s)
            if (made := seen.get(digest)) is None:
                made = ([], b"")
                if len(s):
                    sig = signature(s, a, b)
                    parts = sig.astype(np.uint64).reshape(bands, rows)
                    key = np.arange(bands, dtype=np.uint64) * _MIX
                    for r in range(rows):
                        key = _mix(key * _STEP + parts[:, r])
                    made = (key.view(np.int64).tolist(), sig[:VERIFIED].tobytes())
                seen[digest] = made
            ids.append(doc_id)
            digests.append(digest)
            sizes.append(len(s))
            keys.append(made[0])
            sigs.append(made[1])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], ["id", "digest", "n_shingles", "bands", "sig"])


_SETS = "id bigint, digest binary, n_shingles bigint, bands array<bigint>, sig binary"


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _full(batches: Iterator[pa.RecordBatch], k: int, tagged: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(text.as_py(), k) for text in batch.column(1)]
        tags = [zlib.crc32(_digest(s)) if tagged else 0 for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tags, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "tag", "shingles"])


def _pairs_out(batch: pa.RecordBatch, keep: list[bool]) -> pa.RecordBatch:
    mask = pa.array(keep, pa.bool_())
    return pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in range(4)], ["u", "ut", "v", "vt"])


def _plausible(batches: Iterator[pa.RecordBatch], hashes: int, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u4").reshape(-1, hashes) for i in (4, 5))
            yield _pairs_out(batch, ((x == y).sum(axis=1) >= least * hashes).tolist())


def _similar(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(4), batch.column(5), strict=True):
            p, q = (np.frombuffer(z.as_buffer(), "<u8") for z in (x, y))
            both = np.concatenate((p, q))
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(100 * shared >= percent * (len(both) - shared))
        yield _pairs_out(batch, keep)


_PAIRS = "u bigint, ut bigint, v bigint, vt bigint"


def _with(pairs: DataFrame, facts: DataFrame, column: str) -> DataFrame:
    """Pairs with a column of both sides; each side is a join by id and tag that Spark can split where one is hot."""
    v = facts.select(F.col("id").alias("v"), F.col("tag").alias("vt"), F.col(column).alias("y"))
    u = facts.select(F.col("id").alias("u"), F.col("tag").alias("ut"), F.col(column).alias("x"))
    return pairs.join(v, ["v", "vt"]).join(u, ["u", "ut"]).select("u", "ut", "v", "vt", "x", "y")


def _least(percent: int, kept: int) -> float:
    t = percent / 100
    return t - 6 * (t * (1 - t) / kept) ** 0.5


def _forest(group: pa.Table, kept: int, percent: int) -> pa.Table:
    """Links between different classes within two blocks, as many as join what can be joined."""
    ids, classes = group["id"].to_numpy(), group["class"].to_pylist()
    sets = [np.frombuffer(x.as_buffer(), "<u8") for x in group["shingles"]]
    sigs = np.frombuffer(b"".join(group["sig"].to_pylist()), "<u4").reshape(-1, kept)
    sizes = np.array([len(x) for x in sets])
    root = {c: c for c in classes}

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    least, u, v = _least(percent, kept) * kept, [], []
    for i in range(len(ids) - 1):
        fits = (sigs[i + 1 :] == sigs[i]).sum(axis=1) >= least
        fits &= 100 * np.minimum(sizes[i + 1 :], sizes[i]) >= percent * np.maximum(sizes[i + 1 :], sizes[i])
        for j in (np.flatnonzero(fits) + i + 1).tolist():
            a, b = top(classes[i]), top(classes[j])
            if a != b and len(root) > 1:
                both = np.concatenate((sets[i], sets[j]))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    root[a] = b
                    u.append(int(ids[i]))
                    v.append(int(ids[j]))
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _blocks(open_: DataFrame, size: int) -> DataFrame:
    """(id, tag, class, bucket, low, high): every two members of a bucket in different classes meet in some (bucket, low, high)."""
    of_class = open_.groupBy("bucket", "class").agg(F.count("*").alias("n"))
    of_bucket = of_class.groupBy("bucket").agg(F.max(F.struct("n", "class")).alias("m"), F.sum("n").alias("total"))
    of_bucket = of_bucket.filter("total > m.n").select("bucket", F.col("m.class").alias("major"), F.col("m.n").alias("m"), "total")
    small_ = F.col("total") <= 2 * size
    n_major = F.when(small_, 0).otherwise(F.ceil(F.col("m") / size)).cast("int")
    n_other = F.when(small_, 1).otherwise(F.ceil((F.col("total") - F.col("m")) / size)).cast("int")
    rows = open_.join(of_bucket, "bucket").select("id", "tag", "class", "bucket", n_major.alias("a"), n_other.alias("b"), (F.col("class") == F.col("major")).alias("is_major"))
    mix = F.xxhash64("id", "tag")
    own = F.when(F.col("is_major") & (F.col("a") > 0), F.pmod(mix, F.greatest("a", F.lit(1)))).otherwise(F.col("a") + F.pmod(mix, F.col("b")))
    rows = rows.withColumn("own", own.cast("int"))
    other = F.explode(F.sequence(F.when(F.col("own") < F.col("a"), F.col("a")).otherwise(F.lit(0)), F.col("a") + F.col("b") - 1))
    rows = rows.withColumn("other", other)
    return rows.select("id", "tag", "class", "bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, hashes: int = 288, bands: int = 48, block: int = 512) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs``; see the module's text."""
    spark = docs.sparkSession
    tables = Tables(spark, "near")
    got = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    sets = tables.write(got.mapInArrow(lambda it: _sets(it, k, hashes, bands), _SETS), "sets", "lz4")
    groups = tables.write(sets.filter("n_shingles > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("rep")), "groups")

    # one row for each different set; an id that is repeated with other words is one node with several sets
    repeated = not sets.filter("id is not null").groupBy("id").count().filter("count > 1").isEmpty()
    tag = (F.crc32("digest") if repeated else F.lit(0).cast("bigint")).alias("tag")
    reps = sets.join(groups.select(F.col("rep").alias("id"), "digest"), ["id", "digest"], "left_semi")
    members = reps.select("id", tag, F.explode("bands").alias("bucket"))
    leaders = tables.write(members.groupBy("bucket").agg(F.min("id").alias("leader"), F.count("*").alias("n")).filter("n > 1").drop("n"), "leaders")
    live = members.join(leaders, "bucket")
    if repeated:  # of a leader's texts in the bucket one stands for it
        own = live.filter("id = leader").groupBy("bucket").agg(F.min("tag").alias("leader_tag"))
        live = live.join(own, "bucket")
    else:
        live = live.withColumn("leader_tag", F.lit(0).cast("bigint"))
    live = tables.write(live.select("bucket", "id", "tag", "leader", "leader_tag"), "buckets")
    tables.drop(leaders)
    wanted = live.select("id", "tag").union(live.select("leader", "leader_tag")).distinct()
    sigs = reps.select("id", tag, "digest", "sig").join(wanted, ["id", "tag"], "left_semi").dropDuplicates(["id", "digest"]).drop("digest")
    sigs = tables.write(sigs, "sigs")
    kept = min(VERIFIED, hashes)
    least = _least(percent, kept)

    def full(ids: DataFrame, what: str) -> DataFrame:
        texts = got.join(small(ids, 32 * ids.count()), "id", "left_semi")
        made = texts.mapInArrow(lambda it: _full(it, k, repeated), "id bigint, tag bigint, shingles binary")
        made = tables.write(made.distinct() if repeated else made, what, "lz4")
        tables.drop(ids)
        return made

    pairs = live.filter("id != leader").select(F.col("leader").alias("u"), F.col("leader_tag").alias("ut"), F.col("id").alias("v"), F.col("tag").alias("vt")).distinct()
    near = tables.write(_with(pairs, sigs, "sig").mapInArrow(lambda it: _plausible(it, kept, least), _PAIRS), "plausible")
    sets_of = full(tables.write(near.select(F.col("u").alias("id")).union(near.select(F.col("v").alias("id"))).distinct(), "ids"), "full")
    links = tables.write(_with(near, sets_of, "shingles").mapInArrow(lambda it: _similar(it, percent), _PAIRS).select("u", "v"), "links")
    tables.drop(near, sets_of)
    found = components(links, tables)
    tables.drop(links)

    rest = live.filter("id != leader").select("bucket", "id", "tag")
    rest = tables.write(rest.join(found.withColumnRenamed("u", "id"), "id", "left").select("bucket", "id", "tag", F.coalesce("v", "id").alias("class")), "rest")
    tables.drop(live)
    blocks = tables.write(_blocks(rest, block), "blocks")
    tables.drop(rest)
    if not blocks.isEmpty():
        sets_of = full(tables.write(blocks.select("id").distinct(), "ids"), "full")
        rows = blocks.join(sigs, ["id", "tag"]).join(sets_of, ["id", "tag"])
        more = rows.groupBy("bucket", "low", "high").applyInArrow(lambda t: _forest(t, kept, percent), "u bigint, v bigint")
        more, before = tables.write(more, "more"), found
        found = components(before.union(more), tables)
        tables.drop(more, before, sets_of)
    tables.drop(blocks, sigs)
    classes = groups.join(found.withColumnRenamed("u", "rep"), "rep", "left").select("digest", F.coalesce("v", "rep").alias("component"))
    out = sets.select("id", "digest", "n_shingles").join(classes, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))

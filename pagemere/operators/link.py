"""Entity matching: token coverage scored on arrays, best candidates by window, one-to-one by mutual best rounds.

Candidates meet on one of the rarest tokens of a record, as many as the least score asks for, never all with all.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemere.sources.shared import apart

# Words that say nothing of a title.
STOP = ("the", "and", "of", "for", "los", "las", "del", "una", "con", "der", "die", "das", "les", "des")


def tokens(c: Column) -> Column:
    """Lower-cased words of three letters or more, without stop words, once each."""
    words = F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP)))


def covered(records: DataFrame, needles: DataFrame, least: float, bonuses: list[tuple[str | None, float]]) -> DataFrame:
    """(a, b, n, n_tokens) of records(a, ta, ...) whose tokens needles(b, tb, ...) may cover well enough.

    The score is the share of ``ta`` in ``tb`` and the bonuses; a bonus (column, weight) is given where both sides have
    one value in the column, and (None, weight) is decided by the caller.  No pair of a score of ``least`` is missed:
    of a record of h tokens that needs m of them, one of the h - m + 1 rarest is shared.  A record is only found by
    these, so the commonest words are no meeting place unless a record has nothing else.  Where a bonus counts, less
    has to be shared, but its value has to be equal too.  Sides whose sizes can't do are left out.
    """
    words = needles.select("b", F.explode("tb").alias("t")).groupBy("t").agg(F.count("*").alias("f"))
    at = records.select("a", F.explode("ta").alias("t")).join(words, "t").groupBy("a").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("rare"))
    # what no needle has can't be shared, but counts in the record's size
    rare = records.join(at, "a").withColumn("h", F.size("ta"))
    columns, free = [c for c, _ in bonuses if c], sum(w for c, w in bonuses if not c)
    left, right = None, None
    for mask in range(1 << len(columns)):
        own = [c for i, c in enumerate(columns) if mask >> i & 1]
        given = free + sum(w for c, w in bonuses if c in own)
        need = F.greatest(F.lit(1), F.ceil(F.col("h") * F.lit(least - given) - 1e-6)).cast("int")
        # tokens that no needle has are the rarest ones of all
        take = F.greatest(F.lit(0), F.size("rare") - need + 1)
        keys = [F.col(c).cast("string") if c in own else F.lit("") for c in columns]
        l_ = rare.select("a", F.explode(F.slice("rare", F.lit(1), take)).alias("x"), F.lit(mask).alias("mask"), *(k.alias(f"k{i}") for i, k in enumerate(keys)), need.alias("need")).withColumn("t", F.col("x.t")).drop("x")
        r_ = needles.select("b", F.explode("tb").alias("t"), F.lit(mask).alias("mask"), *(k.alias(f"k{i}") for i, k in enumerate(keys)), F.size("tb").alias("size"))
        left, right = (l_, r_) if left is None else (left.union(l_), right.union(r_))
    met = left.join(right, ["mask", "t", *(f"k{i}" for i in range(len(columns)))]).filter("size >= need").select("a", "b").distinct()
    both = met.join(records.select("a", "ta"), "a").join(needles.select("b", "tb"), "b")
    return both.select("a", "b", F.size(F.array_intersect("ta", "tb")).alias("n"), F.size("ta").alias("n_tokens"), F.size("tb").alias("m_tokens"))


#: Characters of surnames and the names that hold them, with 64 a pair, that are broadcast at most.
NAMES_CHARS = 4 << 20
#: Most words of a record whose subsets are listed (255); longer ones are compared by ``covered``.
SUBSET_WORDS = 8


def _sets(c: Column) -> Column:
    """Every set of words of a sorted array but the empty one, as struct(s, k): the words and their number."""
    chosen = F.transform(F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size(c)) - 1), lambda m: F.filter(c, lambda _, i: F.call_function("shiftright", m, i.cast("int")).bitwiseAND(1) == 1))
    return F.transform(chosen, lambda x: F.struct(F.array_join(x, " ").alias("s"), F.size(x).alias("k")))


def best_by_sets(records: DataFrame, needles: DataFrame, named: DataFrame, least: float, full: float, bonus: float, most: int) -> DataFrame:
    """(b, a, k, h, named): enough of the pairs of records(a, ta, who) and needles(b, tb, sur) to find each needle's best.

    ``ta`` and ``tb`` are sorted words without blanks, at most SUBSET_WORDS; named(sur, who) are the pairs that get the
    bonus.  A pair that shares k of a record's h words scores k / h and the bonus; scores of ``full`` or more are alike.
    Records that share the same words of a needle, and are of one size and one ``who``, score as much at least as the
    words say, so only the ``most`` of the least ``a`` of each set of words can be among the needle's best, ties by
    ``a``; no other pair is made.
    """
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def need(score: float, words: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(words * F.lit(score) - 1e-6))

    def firsts(given: float, *by: str) -> DataFrame:
        # more words than a full score takes say nothing new
        got = sets.filter(F.col("k").between(need(least - given, F.col("h")), need(full - given, F.col("h"))))
        at = F.row_number().over(Window.partitionBy("s", "k", "h", *by).orderBy("a"))
        return got.select("s", "k", "h", *by, "a").withColumn("_n", at).filter(F.col("_n") <= most).drop("_n")

    # a few MB may become many rows, so they are dealt to all tasks first
    sets = records.repartition(n).select("a", "who", F.size("ta").alias("h"), F.inline(_sets(F.col("ta"))))
    fewest = records.agg(F.min(need(least - bonus, F.size("ta")))).first()[0] or 1
    of = needles.repartition(n).select("b", "sur", F.inline(_sets(F.col("tb")))).filter(F.col("k") >= fewest)
    plain = of.select("b", "s").join(apart(firsts(0.0)), "s")
    # a few surnames have all rows, so their names are broadcast where they are few
    chars = named.agg(F.sum(F.length("sur") + F.length("who") + 64)).first()[0] or 0
    with_name = of.join(F.broadcast(named) if chars <= NAMES_CHARS else apart(named), "sur").select("b", "s", "who").join(apart(firsts(bonus, "who")), ["s", "who"])
    return plain.select("b", "a", "k", "h", F.lit(False).alias("named")).union(with_name.select("b", "a", "k", "h", F.lit(True).alias("named")))


def candidates(left: DataFrame, right: DataFrame, least: float = 0.0) -> DataFrame:
    """left(id, title, surname, year), right(id, title, surname, year): pairs with a shared token and a score of ``least``.

    Coverage of the left title, +0.35 for an equal surname, +0.1 for an equal year, at most 1; jaccard breaks ties.
    """
    a = left.select(F.col("id").alias("a"), tokens(F.col("title")).alias("ta"), "surname", "year")
    b = right.select(F.col("id").alias("b"), tokens(F.col("title")).alias("tb"), "surname", "year")
    got = covered(a, b, least, [("surname", 0.35), ("year", 0.1)])
    got = got.join(a.select("a", F.col("surname").alias("sa"), F.col("year").alias("ya")), "a").join(b.select("b", F.col("surname").alias("sb"), F.col("year").alias("yb")), "b")
    score = F.col("n") / F.col("n_tokens") + F.when(F.col("sa") == F.col("sb"), 0.35).otherwise(0.0) + F.when(F.col("ya") == F.col("yb"), 0.1).otherwise(0.0)
    jaccard = F.round(F.col("n") / (F.col("n_tokens") + F.col("m_tokens") - F.col("n")), 6)
    return got.select("a", "b", F.round(F.least(F.lit(1.0), score), 6).alias("score"), jaccard.alias("jaccard")).filter(F.col("score") >= least)


def ready(scored: DataFrame, least: float = 0.6, gap: float = 0.15, drop: float = 0.35, keep: int = 4) -> DataFrame:
    """The best candidates of each left row; ready if the first is good enough and well ahead of the second."""
    w = Window.partitionBy("a").orderBy(F.desc("score"), F.desc("jaccard"), "b")
    got = scored.filter(F.col("score") >= drop).select("*", F.row_number().over(w).alias("rank"), F.lead("score").over(w).alias("second"))
    is_ready = (F.col("rank") == 1) & (F.col("score") >= least) & (F.col("score") - F.coalesce("second", F.lit(0.0)) > gap)
    return got.filter(F.col("rank") <= keep).select("a", "b", "score", "jaccard", "rank", is_ready.alias("ready"))


def one_to_one(scored: DataFrame) -> DataFrame:
    """Greedy assignment, best pair first: in each round pairs that are best for both sides are taken.

    Every round settles at least the best pair left.  What is left is checkpointed, which cuts the lineage.
    """
    sc = scored.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        put = sc.getConf().get("spark.checkpoint.dir", None)
        if not put and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(put or tempfile.mkdtemp(prefix="pagemere-"))
    order = F.struct("score", "jaccard", -F.col("a"), -F.col("b"))
    left, taken = scored.withColumn("o", order).checkpoint(), None
    while not left.isEmpty():
        best_a = left.groupBy("a").agg(F.max("o").alias("o"))
        best_b = left.groupBy("b").agg(F.max("o").alias("o"))
        top = left.join(best_a, ["a", "o"], "left_semi").join(best_b, ["b", "o"], "left_semi").select("a", "b", "score", "jaccard", "o").checkpoint()
        taken = top if taken is None else taken.unionByName(top)
        left = left.join(top.select("a"), "a", "left_anti").join(top.select("b"), "b", "left_anti").checkpoint()
    return (left if taken is None else taken).select("a", "b", "score", "jaccard")

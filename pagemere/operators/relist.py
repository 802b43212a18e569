"""The least changes that turn one set of ordered lists into another.

Of the works a list keeps, those on a longest rising run of old places stay and the others are moved, which is the
fewest moves there can be.  A list is cut wherever all that stood before also comes before: the pieces are apart, so each
is worked out alone, and a work that keeps its place between others is a piece of its own.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemere.operators.ordered import carried


def staying(places: list[int]) -> list[bool]:
    """Which of different numbers are on a longest rising run (of several, the one that ends lowest at each length)."""
    ends: list[int] = []
    at: list[int] = []
    before = [-1] * len(places)
    for i, x in enumerate(places):
        k = bisect_left(ends, x)
        before[i] = at[k - 1] if k else -1
        ends[k : k + 1], at[k : k + 1] = [x], [i]
    keep, i = [False] * len(places), at[-1] if at else -1
    while i >= 0:
        keep[i], i = True, before[i]
    return keep


def changes(now: DataFrame, wanted: DataFrame, ranges: int | None = None) -> DataFrame:
    """(list_id, work_id, op, old_place, new_place) of now and wanted(list_id, work_id, place): add, remove, move.

    A list's places are different numbers in order; a work stands once on a list.  Works that neither come, go nor move
    against the others have no row, even if their number changes.
    """
    a = now.select("list_id", "work_id", F.col("place").alias("old_place"))
    both = a.join(wanted.select("list_id", "work_id", F.col("place").alias("new_place")), ["list_id", "work_id"], "full")
    op = F.when(F.col("old_place").isNull(), "add").when(F.col("new_place").isNull(), "remove")
    come_or_go = both.withColumn("op", op).filter("op IS NOT NULL").select("list_id", "work_id", "op", "old_place", "new_place")
    kept = both.filter("old_place IS NOT NULL AND new_place IS NOT NULL")
    each = {"rank": (F.lit(True), None)}
    old = carried(kept, ["list_id"], ["old_place"], {}, each, ranges).withColumnRenamed("rank", "old_rank")
    new = carried(old, ["list_id"], ["new_place"], {}, each, ranges, tops={"top": F.col("old_rank")})
    # as many rows as the largest old rank: whatever stood before comes before, so a piece ends here
    ends = carried(new.withColumn("ends", F.col("top") == F.col("rank")), ["list_id"], ["new_place"], {}, {"pieces": (F.col("ends"), None)}, ranges)
    piece = ends.withColumn("piece", F.col("pieces") - F.col("ends").cast("int"))
    mixed = piece.filter(F.col("old_rank") != F.col("rank")).select("list_id", "piece").distinct()

    def moved(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        out = rows[[not k for k in staying(rows["old_rank"].tolist())]]
        return out.assign(op="move")[["list_id", "work_id", "op", "old_place", "new_place"]]

    kinds = dict(both.dtypes)
    schema = ", ".join(f"{c} {'string' if c == 'op' else kinds[c]}" for c in ("list_id", "work_id", "op", "old_place", "new_place"))
    moves = piece.join(mixed, ["list_id", "piece"], "left_semi").select("list_id", "piece", "work_id", "rank", "old_rank", "old_place", "new_place").groupBy("list_id", "piece").applyInPandas(moved, schema)
    return come_or_go.unionByName(moves)

"""Many requests in order, folded to what they come to, so that each row is written once.

A catalogue's setters are folded field by field: of all requests that set or clear a field the last one counts.
List places are folded by key: what the last request says.  Works of a note get places that hang on what is there when
they are added, so those requests are replayed as a sorted stream with the note's works as its state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (fields, whether a field that isn't given or blank is cleared): what a request of a name touches.
ACTIONS: dict[str, tuple[tuple[str, ...], bool]] = {
    "status": (("status",), False),
    "offset": (("page_offset",), False),
    "acceptance": (("basis",), True),
    "imprint": (("author", "publisher", "place", "year", "isbn"), True),
    "rating": (("priority",), True),
    "standing_note": (("standing_note",), True),
    "characterization": (("purpose", "standing", "priority"), False),
}
#: Fields that have to be whole numbers.
NUMBERS = ("page_offset", "year", "priority")
FIELDS = tuple(dict.fromkeys(f for fields, _ in ACTIONS.values() for f in fields))
_NOTE_WORKS = ["note_id", "work_id", "role", "ordinal"]
UNKNOWN_ACTION, UNKNOWN_ID, NOT_A_NUMBER = "no such action", "no such id", "not a whole number: "


def fold_setters(table: DataFrame, asked: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(next table, refused) of asked(seq, id, action, args map<string, string>, clear array<string>).

    ``seq`` orders requests and tells them apart.  A blank argument is one that isn't given; ``clear`` names fields to
    empty, whatever the action says of fields that aren't given.  A request of an unknown action or id, or with a number
    that is none, does nothing and is named.  Fields the table doesn't have are left aside; ``touched`` is the last
    request that a row was touched by.
    """
    given = {f: F.trim(F.col("args")[f]) for f in FIELDS}
    r = asked.select("seq", "id", "action", "clear", *(F.when(x != "", x).alias(f"_a_{f}") for f, x in given.items()))
    arg = {f: F.col(f"_a_{f}") for f in FIELDS}
    bad = F.coalesce(*(F.when(arg[f].isNotNull() & ~arg[f].rlike(r"^-?\d{1,9}$"), F.lit(f)) for f in NUMBERS))
    known = table.select(F.col(key).alias("_id")).distinct()
    r = r.join(known, F.col("id") == F.col("_id"), "left")
    why = F.when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), UNKNOWN_ACTION).when(F.col("_id").isNull(), UNKNOWN_ID).when(bad.isNotNull(), F.concat(F.lit(NOT_A_NUMBER), bad))
    r = r.withColumn("why", why)
    here = [f for f in FIELDS if f in table.columns]

    def put(f: str) -> Column:
        named = F.array_contains(F.coalesce("clear", F.array().cast("array<string>")), f)
        of = [a for a, (fields, _) in ACTIONS.items() if f in fields]
        emptied = F.col("action").isin(*(a for a in of if ACTIONS[a][1])) & arg[f].isNull()
        touches = F.col("action").isin(*of) & (arg[f].isNotNull() | emptied | named)
        return F.when(touches, F.struct(F.when(~named, arg[f]).alias("v"))).alias(f"_{f}")

    # a request is cut down to what it puts before requests are sorted by id, so a task doesn't sort their arguments
    puts = r.filter("why IS NULL").select(F.col("id").alias("_key"), "seq", *(put(f) for f in here)).repartition("_key")
    folded = puts.groupBy("_key").agg(*(F.max_by(f"_{f}", F.when(F.col(f"_{f}").isNotNull(), F.col("seq"))).alias(f"_{f}") for f in here), F.max("seq").alias("_touched"))
    out = table.join(folded, F.col(key) == F.col("_key"), "left")
    types = dict(table.dtypes)
    now = {f: F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.v").try_cast(types[f])).otherwise(F.col(f)) for f in here}
    return out.select(*(now.get(c, F.col(c)).alias(c) for c in table.columns), F.col("_touched").alias("touched")), r.filter("why IS NOT NULL").select("seq", "why")


def fold_places(table: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """table(keys..., columns...) after asked(seq, keys..., op, columns...): ``add`` puts or replaces a row, ``remove`` takes it.

    Requests without one of the keys, or of another op, do nothing.
    """
    values = [c for c in table.columns if c not in keys]
    ok = F.col("op").isin("add", "remove")
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    last = asked.filter(ok).groupBy(*keys).agg(F.max_by(F.struct("op", *values), "seq").alias("r"))
    untouched = table.join(last.select(*keys), keys, "left_anti")
    return untouched.unionByName(last.filter("r.op = 'add'").select(*keys, *(F.col(f"r.{c}").alias(c) for c in values)))


def _replayed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The works of each note of sorted requests; a note is a few rows, so what a batch completes goes out together."""
    note, state = None, {}

    def rows() -> list[tuple]:
        return [(note, w, role, at) for w, (role, at) in state.items()]

    for frame in frames:
        out = []
        for note_id, work_id, op, role, ordinal in zip(*(frame[c].tolist() for c in ("note_id", "work_id", "op", "role", "ordinal")), strict=True):
            if note_id != note:
                out += rows()
                note, state = note_id, {}
            if op == "remove":
                state.pop(work_id, None)
            elif op == "had":
                state[work_id] = (role, int(ordinal))
            else:
                at = state[work_id][1] if work_id in state else max((x for _, x in state.values()), default=0) + 1
                state[work_id] = (role, at)
        yield pd.DataFrame(out, columns=_NOTE_WORKS)
    yield pd.DataFrame(rows(), columns=_NOTE_WORKS)


def replay_note_works(table: DataFrame, asked: DataFrame) -> DataFrame:
    """table(note_id, work_id, role, ordinal) after asked(seq, note_id, work_id, op, role).

    A work that is added to a note it isn't on gets the place after the note's last one at that time; one that is there
    only changes its role.  A note's requests pass as a stream, sorted by ``seq``; its works are what is held.
    """
    kinds = {f.name: f.dataType for f in table.schema}
    had = table.select("note_id", F.lit(None).cast("bigint").alias("seq"), "work_id", F.lit("had").alias("op"), "role", F.col("ordinal").cast("bigint").alias("ordinal"))
    new = asked.filter("op IN ('add', 'remove') AND work_id IS NOT NULL AND note_id IS NOT NULL").select("note_id", F.col("seq").cast("bigint").alias("seq"), "work_id", "op", "role", F.lit(None).cast("bigint").alias("ordinal"))
    n = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = had.unionByName(new).repartition(n, "note_id").sortWithinPartitions("note_id", F.col("seq").asc_nulls_first(), "work_id")
    out = ordered.mapInPandas(_replayed, "note_id bigint, work_id string, role string, ordinal bigint")
    return out.select(*(F.col(c).cast(kinds[c]).alias(c) for c in table.columns))

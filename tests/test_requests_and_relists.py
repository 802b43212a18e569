"""Folded requests equal a one-by-one replay; the changes of a list are right and the fewest."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagemere.operators import relist, requests


FIELDS = "id int, status string, page_offset int, basis string, author string, publisher string, place string, year int, isbn string, priority int, standing_note string, purpose string, standing string"


def test_setters_equal_a_replay(spark):
    rng = random.Random(9)
    names = [f.split()[0] for f in FIELDS.split(", ")]
    table = {i: dict(zip(names, [i, "new", 0, None, "A", "P", None, 1900, None, 3, None, "x", "y"])) for i in range(12)}
    asked = []
    for seq in range(900):
        action = rng.choice([*requests.ACTIONS, "no action"] + [None] * (seq % 50 == 0))
        args = {f: rng.choice([None, " ", "7", "12", "c1900", " 5 "]) for f in rng.sample(requests.FIELDS, 4)}
        asked.append((seq, rng.choice([*range(12), 99, None]), action, args, rng.choice([None, [], ["priority"], ["status", "year"]])))
    old = spark.createDataFrame([tuple(r.values()) for r in table.values()], FIELDS)
    why = {}
    for seq, id_, action, args, clear in asked:
        args = {k: v.strip() for k, v in args.items() if v and v.strip()}
        bad = next((f for f in requests.NUMBERS if f in args and not args[f].isdigit()), None)
        if action not in requests.ACTIONS:
            why[seq] = requests.UNKNOWN_ACTION
        elif id_ not in table:
            why[seq] = requests.UNKNOWN_ID
        elif bad:
            why[seq] = requests.NOT_A_NUMBER + bad
        else:
            fields, empties = requests.ACTIONS[action]
            for f in fields:
                if f in (clear or ()):
                    table[id_][f] = None
                elif f in args:
                    table[id_][f] = int(args[f]) if f in requests.NUMBERS else args[f]
                elif empties:
                    table[id_][f] = None
            table[id_]["touched"] = seq
    df = spark.createDataFrame(asked, "seq int, id int, action string, args map<string,string>, clear array<string>").repartition(5)
    after, refused = requests.fold_setters(old, df)
    assert {r.seq: r.why for r in refused.collect()} == why
    assert {r.id: r.asDict() for r in after.collect()} == {i: {"touched": None} | r for i, r in table.items()}
    assert requests.fold_setters(old, df.limit(0))[0].drop("touched").exceptAll(old).isEmpty()
    # what is sorted by id is what a request puts, without its arguments
    plan = after._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, x in enumerate(plan) if "Aggregate [_key" in x)
    assert "RepartitionByExpression [_key" in plan[at + 1] and re.match(r"[\s:+-]*Project \[", plan[at + 2]) and "args" not in plan[at + 2].split("[", 1)[1].split(",")
    assert not {"args", "clear", "action"} & {c.name for c in after.schema}


def test_places_and_note_works_equal_a_replay(spark):
    rng = random.Random(4)
    places = {(i % 3, f"w{i}"): (f"s{i}", i) for i in range(9)}
    works = {(n, w): ("about", o) for n in range(4) for o, w in enumerate("ab", 1)}
    p0 = spark.createDataFrame([(*k, *v) for k, v in places.items()], "list_id int, work_id string, section string, ordinal int")
    w0 = spark.createDataFrame([(*k, *v) for k, v in works.items()], "note_id int, work_id string, role string, ordinal int")
    pa, wa = [], []
    for seq in range(500):
        op = rng.choice(["add", "remove", "add", "look"])
        k, v = (rng.randrange(4), rng.choice([f"w{i}" for i in range(6)])), (rng.choice(["x", None]), rng.randrange(5))
        pa.append((seq, *k, op, *v))
        n, role = (rng.randrange(5), rng.choice("abcdef")), rng.choice(["ficha", "about"])
        wa.append((seq, *n, op, role))
        if op == "add":
            places[k] = v
            works[n] = (role, works[n][1] if n in works else max((o for (m, _), (_, o) in works.items() if m == n[0]), default=0) + 1)
        elif op == "remove":
            places.pop(k, None)
            works.pop(n, None)
    pa.append((900, None, "w0", "remove", None, None))
    got = requests.fold_places(p0, spark.createDataFrame(pa, "seq int, list_id int, work_id string, op string, section string, ordinal int").repartition(4), ["list_id", "work_id"])
    assert {(r.list_id, r.work_id): (r.section, r.ordinal) for r in got.collect()} == places
    got = requests.replay_note_works(w0, spark.createDataFrame(wa, "seq int, note_id int, work_id string, op string, role string").repartition(4))
    assert {(r.note_id, r.work_id): (r.role, r.ordinal) for r in got.collect()} == works and got.dtypes == w0.dtypes


def test_notes_that_a_batch_completes_go_out_together():
    frame = pd.DataFrame([(n, None, "w", "had", "about", 3.0) for n in range(500)], columns=["note_id", "seq", "work_id", "op", "role", "ordinal"])
    got = list(requests._replayed(iter([frame[:300], frame[300:]])))
    assert len(got) <= 3 and pd.concat(got).values.tolist() == [[n, "w", "about", 3] for n in range(500)]


def longest(places):
    best = []
    for i, x in enumerate(places):
        best.append(1 + max((best[j] for j in range(i) if places[j] < x), default=0))
    return max(best, default=0)


@pytest.mark.parametrize("ranges", [1, 6])
def test_list_changes_are_right_and_fewest(spark, ranges):
    rng = random.Random(7)
    now, wanted, least = [], [], 0
    for ls in range(14):
        old = rng.sample(range(100), rng.choice((0, 1, 9, 25)))
        new = [w for w in old if rng.random() < 0.8] + rng.sample(range(100, 130), rng.randrange(5))
        for _ in range(rng.randrange(6)):
            if new:
                new.insert(rng.randrange(len(new)), new.pop(rng.randrange(len(new))))
        if ls == 3:
            new.reverse()
        now += [(ls, w, 2 * i + 1) for i, w in enumerate(old)]
        wanted += [(ls, w, i + 1) for i, w in enumerate(new)]
        kept = [old.index(w) for w in new if w in old]
        least += len(kept) - longest(kept)
    schema = "list_id int, work_id int, place int"
    ops = relist.changes(spark.createDataFrame(now, schema), spark.createDataFrame(wanted, schema), ranges).collect()
    assert sum(r.op == "move" for r in ops) == least > 0
    for ls in range(14):
        mine = {r.work_id: r for r in ops if r.list_id == ls}
        # what stays keeps its order; everything else is put where its row says
        stays = [w for _, w, _ in sorted((x for x in now if x[0] == ls), key=lambda x: x[2]) if w not in mine]
        put = {r.new_place: w for w, r in mine.items() if r.op != "remove"}
        rest, out = iter(stays), []
        for place in range(1, len(stays) + len(put) + 1):
            out.append(put[place] if place in put else next(rest))
        assert out == [w for n, w, _ in sorted((x for x in wanted if x[0] == ls), key=lambda x: x[2])]

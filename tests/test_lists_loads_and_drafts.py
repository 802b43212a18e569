"""Carried state, reading lists, proposals, loads, resumed embedding, drafts and the book store."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pagemere.functions.text import fold
from pagemere.operators import bookstore, drafts, embedding, entities, link, loads, matcher, ordered, proposals, readinglist
from pagemere.plans import derived
from pagemere.sources.shared import fresh_path, written
from tests.oracle import SF


def test_state_is_carried_over_ranges_as_in_one(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab") if i % 5 else None, i, rng.choice(["head", "item", "more", "more"])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i int, kind string")
    want, state = {}, {}
    for g, i, kind in rows:
        head, since, n = state.get(g, (None, 0, 0))
        head, since = (i, 0) if kind == "head" else (head, since + (kind == "item"))
        state[g] = head, since, n + (kind == "item")
        want[i] = state[g]
    for ranges in (1, 7, 60):
        got = ordered.carried(df, ["g"], ["i"], {"head": F.when(F.col("kind") == "head", F.col("i"))}, {"since": (F.col("kind") == "item", F.col("kind") == "head"), "n": (F.col("kind") == "item", None)}, ranges)
        assert {r.i: (r["head"], r.since, r.n) for r in got.collect()} == want
        assert {r.i: r.row for r in ordered.numbered(df, ["i"], "row", ranges).collect()} == {i: i for i in range(400)}


def test_reading_list_lines(spark):
    lines = [
        "stray line", "12. Early, A. Before any list. 1999.", "I. THEORY", "A. Ghosts", "1. Doe, J. First", "book.  Press,", "2001.", "Count: 7 books", "2. Roe. Second.", "B. NOT A SECTION", "II. Not a list", "x",
        "Supplementary", "0. Poe. Third.", "working filmography: HAUNTING", "3. Film, A. 1950.", "IV. DISSERTATION", "7. Last.",
    ]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(lines)] + [("d", 99, None), ("e", 1, "no entry here")], "d string, i int, text string")
    for ranges in (1, 5):
        got = sorted(tuple(r)[1:] for r in readinglist.entries(df, ["d"], ["i"], ranges).collect())
        assert got == [
            (1, "(before any list)", "", False, 1, 12, "Early, A. Before any list. 1999."),
            (2, "I. THEORY", "A. Ghosts", False, 1, 1, "Doe, J. First book. Press, 2001."),
            (3, "I. THEORY", "A. Ghosts", False, 2, 2, "Roe. Second. B. NOT A SECTION II. Not a list"),
            (4, "I. THEORY", "Supplementary", True, 1, 1, "Poe. Third."),
            (5, "Working Filmography", "", False, 1, 3, "Film, A. 1950."),
            (6, "IV. DISSERTATION", "", False, 1, 7, "Last."),
        ]


def test_entry_parts(spark):
    rows = [
        ("Doe, J. The Book. Press, 1850, 1999.", ("Doe, J", "The Book", "1999", 9, 32)),
        ('Roe. . "A Long Essay." In X, 20191', ("Roe", '"A Long Essay." In X, 20191', "", 8, 0)),
        ('Roe. Ed. "A Long Essay" in X', ("Roe", "A Long Essay", "", 11, 0)),
        ("Only a line", ("Only a line", "Only a line", "", 1, 0)),
        ("", ("", "", "", 0, 0)),
    ]
    got = spark.createDataFrame([(t,) for t, _ in rows], "t string").select(readinglist.entry_parts(F.col("t")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in got] == [want for _, want in rows]


def test_covered_misses_no_pair_and_meets_on_rare_words(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    pick = lambda n: sorted({rng.choice(words[: rng.choice((3, 40))]) for _ in range(n)})
    records = [(i, pick(rng.randrange(1, 7)), rng.choice("xyz"), rng.randrange(3)) for i in range(120)] + [(500, ["never"], "x", 1), (501, [], "x", 1)]
    needles = [(i, pick(rng.randrange(1, 10)), rng.choice("xyz"), rng.randrange(3)) for i in range(120)]
    a, b = spark.createDataFrame(records, "a int, ta array<string>, s string, y int"), spark.createDataFrame(needles, "b int, tb array<string>, s string, y int")
    for least in (0.0, 0.35, 0.5, 0.8, 1.0):
        want = {(i, j) for i, t, s, y in records for j, u, s2, y2 in needles if (n := len({*t} & {*u})) and n / len(t) + 0.35 * (s == s2) + 0.1 * (y == y2) >= least - 1e-9}
        got = {(r.a, r.b) for r in link.covered(a, b, least, [("s", 0.35), ("y", 0.1)]).select("a", "b").collect()}
        assert want <= got, least
    titles = spark.createDataFrame([(i, "common words rare" + str(i), "s", 1) for i in range(50)], "id int, title string, surname string, year int")
    assert link.candidates(titles, titles.withColumn("surname", F.lit("t")).withColumn("year", F.lit(2)), least=0.7).count() == 50


def test_file_names(spark):
    names = ["in/Cartucho -- Nellie Campobello, ed. -- Press, 1931 -- faccd0 -- x.pdf", "The Ñandú.pdf", "a.pdf", ""]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(proposals.file_parts(F.col("n")).alias("p")).select("p.*", proposals.surname(F.col("p.author")).alias("s"), proposals.title_words(F.col("p.title"), proposals.FILE_STOP).alias("w")).collect()
    assert [tuple(r) for r in got] == [("Cartucho", "Nellie Campobello, ed.", "campobello", ["cartucho"]), ("The Ñandú", "", "", ["nandu"]), ("a", "", "", []), ("", "", "", [])]


def test_proposals_give_every_reason(spark):
    works = spark.createDataFrame([(1, "A Book of Owls", None, "Town", 1900, None, False), (2, "A Book of Owls", None, None, None, "9781", True), (3, "Owls", "P", "T", 1, "9789", True), (4, "Owls", None, "T", 1, None, True)], "id int, title string, publisher string, place string, year int, isbn string, has_file boolean")
    picks = proposals.isbn_picks(spark.createDataFrame([(4, 1, "x", "", "two editions"), (4, 2, "y", "", "other")], "work_id int, line int, isbn13 string, pick string, why string"))
    known = spark.createDataFrame([("9781", "Quite Another", "House", "", None, "cat")], "isbn string, title string, publisher string, place string, year int, source string")
    got = {r.id: ([x.rule for x in r.reasons], r.still, r.accept) for r in proposals.catalogue_proposals(works, picks, known).collect()}
    assert got == {1: (["no_file"], ["publisher", "isbn"], False), 2: (["catalogue_lacks", "other_title"], ["place", "year"], False), 4: (["no_isbn"], ["publisher", "isbn"], False)}


def test_page_intervals_are_few(spark):
    rows = [("a", i, i + (2 if 5 <= i < 9 else -1)) for i in range(1, 20) if i != 15]
    p = spark.createDataFrame(rows, "work_id string, page_index int, printed_page int")
    assert sorted(tuple(r) for r in loads.page_intervals(p).collect()) == [("a", 1, 4, -1), ("a", 5, 8, 2), ("a", 9, 14, -1), ("a", 16, 19, -1)]
    c = spark.createDataFrame([("a", 1, 1, "front", 1, 3, "x"), ("a", 2, None, "one", 2, 4, "x"), ("a", 3, 2, "two", 6, 2, "x"), ("a", 4, 1, "gone", 15, 16, "x"), ("a", 5, 1, "end", 17, 99, "x")], "work_id string, place int, level int, title string, page int, last_page int, source string")
    assert sorted(tuple(r)[1:6] for r in loads.load_sections(c, p).collect()) == [(1, 1, "one", 1, 7), (2, 2, "two", 8, 15), (3, 1, "end", 16, None)]


def _vectors(texts):
    return [[float(len(t)), float(t.count("a"))] for t in texts]


def test_stopped_embedding_goes_on(spark):
    chunks = spark.createDataFrame([(i, f"w{i % 3}", "a" * i) for i in range(333)] + [(None, "w", "x"), (900, "w", None)], "id bigint, work string, text string")
    one, two = fresh_path(spark, "store"), fresh_path(spark, "store")
    run = lambda store, texts=_vectors, model="m", dim=2, **k: embedding.embed_pending(chunks, store, texts, model, dim, ["work", "id"], batch=10, **k)
    assert run(one) == 1 and run(one) == 0

    def fails_later(texts):
        if any(len(t) == 300 for t in texts):
            raise RuntimeError("stopped")
        return _vectors(texts)

    assert run(two, round_batches=4, most_rounds=2) == 2
    with pytest.raises(Exception, match="stopped"):
        run(two, fails_later, round_batches=4)
    done = embedding.log(spark, two).agg(F.sum("rows")).first()[0]
    assert 80 <= done < 333 and embedding.embedded(spark, two).count() == done
    run(two, round_batches=4)
    rows = lambda s: sorted((r.id, r.batch, tuple(r.embedding)) for r in embedding.embedded(spark, s).collect())
    assert rows(one) == rows(two) and len(rows(one)) == 333
    assert embedding.log(spark, two).agg(F.sum("rows")).first()[0] == 333
    with pytest.raises(ValueError, match="dimensions"):
        run(two, dim=3)
    with pytest.raises(Exception, match="texts"):
        run(two, lambda t: _vectors(t)[1:], model="other", replace=True)
    assert run(two, lambda t: [[1.0, 2.0] for _ in t], model="other", replace=True) == 1
    assert {(r.model, tuple(r.embedding)) for r in embedding.embedded(spark, two).collect()} == {("other", (1.0, 2.0))}


def test_a_stopped_run_moves_the_texts_of_its_rounds_only(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, "w", f"text {i}") for i in range(50)], "id bigint, work string, text string")
    moved = []
    monkeypatch.setattr(embedding, "written", lambda df, name: moved.append(written(df, name)) or moved[-1])
    run = lambda most: embedding.embed_pending(chunks, store, lambda t: [[1.0]] * len(t), "m", 1, ["work", "id"], batch=5, round_batches=2, most_rounds=most)
    store = fresh_path(spark, "store")
    assert (run(1), run(None)) == (1, 4)
    assert [x.count() for x in moved] == [10, 40] and embedding.embedded(spark, store).count() == 50


def test_drafts_are_admitted_whole(spark):
    text = "the grey owl flies by night over the old town and nobody sees it"
    pages = spark.createDataFrame([("a", 1, 1, text), ("a", 2, 2, "nothing of the kind stands on this page at all"), ("f", 1, 0, text)], "work_id string, page_index int, printed_page int, text string")
    works = spark.createDataFrame([("a", True, None, False), ("f", True, None, False), ("n", False, None, False)], "id string, offset_checked boolean, offset_problem string, accepted boolean")
    d = spark.createDataFrame([(1, "b", None, None, None, None), (2, "b", "other", "X", " t ", [" x ", "", None]), (3, " ", "own", None, None, ["dossier"]), (4, "b", None, None, None, None), (5, "b", "nobody", None, None, None)], "draft_id int, body string, attribution string, attributed_to string, title string, tags array<string>")
    q = spark.createDataFrame([(1, 1, "a", "The  grey owl\nflies by night over", None), (2, 1, "a", text, 1), (2, 2, "a", "stands on this page at all", 2), (4, 1, "a", text, 1), (4, 2, "f", text, None), (4, 3, "n", text, None), (4, 4, "zz", text, None), (4, 5, "a", "short", None), (4, 6, "a", "words that stand in no book at all, surely", None), (9, 1, "a", text, 1)], "draft_id int, n int, work_id string, text string, near int")
    notes = spark.createDataFrame([(70,)], "id bigint")
    new, anchors, refused = drafts.admit(d, q, pages, works, notes)
    assert sorted((r.id, r.draft_id, r.title, r.tags) for r in new.collect()) == [(71, 1, None, []), (72, 2, "t", ["x"])]
    assert sorted((r.note_id, r.ordinal, r.printed_page, r.quote) for r in anchors.collect()) == [(71, 1, 1, text[:32]), (72, 1, 1, text), (72, 2, 2, "stands on this page at all")]
    why = {r.draft_id: r.reasons for r in refused.collect()}
    assert sorted(why) == [3, 4, 5] and len(why[3]) == 4 and len(why[5]) == 2
    assert [x.split(": ")[-1] for x in why[4]] == ["on front matter, printed page 0", "page numbering never checked", "no such work", "shorter than 25 characters", "not found in the page text"]
    assert all(df.isEmpty() for df in drafts.admit(d.limit(0), q, pages, works, notes))


def test_the_book_store_is_pruned_and_searches_alike(spark):
    path = fresh_path(spark, "books")
    printed = derived._printed(spark, SF)
    bookstore.build(printed, path, buckets=16)
    some = bookstore.book(spark, path, ["src3"], buckets=16)
    plan = some._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "PushedFilters: [In(work_id" in plan or "EqualTo(work_id" in plan
    assert {r[0] for r in some.select("work_id").distinct().collect()} == {"src3"}
    quotes = printed.filter("length(text) > 80").select(F.col("chunk_id").alias("item_id"), F.substring("text", 30, 40).alias("quote"))
    rows = lambda p: sorted(map(tuple, matcher.find_exact(p, quotes).select("item_id", "work_id", "page_index", "match", "text", "alone").collect()))
    assert rows(printed) == rows(bookstore.book(spark, path))


def test_file_candidates_equal_all_pairs_and_make_few(spark, monkeypatch):
    """Many records alike in a maker: all pairs of one maker are good, only the first of each set of words are made."""
    rng = random.Random(5)
    words = ["owl", "river", "stone", "night", "tower", "bridge", "winter", "garden"]
    works = [(i, f"Maker{i % 2}son, Given", " ".join(rng.sample(words, rng.randrange(1, 4)) + ([f"{1000 + i % 7}"] if i % 3 else []) + (["seven", "more", "words", "than", "others", "have"] if i % 29 == 0 else []))) for i in range(300)]
    files = [(i, "in/" + " ".join(rng.sample(words, 3)) + f" {1000 + i % 9}" + rng.choice(["", f" -- Given de Maker{i % 3}son", " -- words others have than seven more, on", " -- Son"]) + ".pdf") for i in range(200)]
    made = []
    best_by_sets = link.best_by_sets
    monkeypatch.setattr(link, "best_by_sets", lambda *a: made.append(best_by_sets(*a)) or made[-1])
    f, w = spark.createDataFrame(files, "file int, name string"), spark.createDataFrame(works, "work int, author string, title string")
    got = {(r.file, r["rank"]): (r.work, r.score) for r in proposals.file_candidates(f, w).collect()}
    parts = f.select("file", proposals.file_parts(F.col("name")).alias("p")).select("file", F.array_union(*(proposals.title_words(F.col(f"p.{x}"), proposals.FILE_STOP) for x in ("title", "author"))).alias("t"), proposals.surname(F.col("p.author")).alias("sur")).collect()
    recs = w.select("work", proposals.title_words(F.concat_ws(" ", "author", "title"), proposals.FILE_STOP).alias("t"), proposals.plain(F.col("author")).alias("who")).collect()
    want = {}
    for x in parts:
        scored = []
        for r in recs:
            n = len(set(x.t) & set(r.t))
            s = min(1.0, round(n / len(r.t) + (0.3 if x.sur and x.sur in r.who else 0.0) + 1e-9, 2))
            if n and s >= 0.6:
                scored.append((-s, r.work))
        want |= {(x.file, i + 1): (b, -s) for i, (s, b) in enumerate(sorted(scored)[:3])}
    assert got == want and sum(m.select("b", "a").distinct().count() for m in made) < 0.6 * 200 * 300


def test_needles_meet_names_on_their_rarest_run(spark):
    names = [f"large {i:04d} of all.pdf" for i in range(60)] + ["", "x", "éa", "Zebra"]
    needles = [("w", f"LARGE {i:04d}") for i in range(0, 60, 7)] + [("u", "b"), ("v", "ea"), ("v", " "), ("t", "zebras"), ("s", "all.pdf"), ("r", "LARGE 0007")]
    n, f = spark.createDataFrame(needles, "work string, match string"), spark.createDataFrame([(x,) for x in names], "name string")
    got = {tuple(r) for r in entities.name_matches(n, f).collect()}
    assert got == {(w, x) for w, m in needles for x in names if fold(m.strip()) and fold(m.strip()) in fold(x)}


def test_file_candidates_broadcast_nothing_that_follows_the_tables(spark, monkeypatch):
    """Compressed files look small to Spark; only the few surnames' names are broadcast, after they were measured."""
    f = spark.createDataFrame([(i, f"in/Owl {i % 3} River 10{i % 7}2 -- Given Maker{i % 2}son.pdf") for i in range(40)], "file int, name string")
    w = spark.createDataFrame([(i, f"Maker{i % 2}son, Given", f"Owl River 10{i % 9}2") for i in range(40)], "work int, author string, title string")
    plans = []
    monkeypatch.setattr(proposals, "written", lambda df, name: plans.append((name, df._jdf.queryExecution().sparkPlan().toString())) or written(df, name))
    plans.append(("result", proposals.file_candidates(f, w)._jdf.queryExecution().sparkPlan().toString()))
    assert {n: p.count("BroadcastHashJoin") + p.count("BroadcastNestedLoopJoin") for n, p in plans if "Broadcast" in p} == {"best": 1}

import json

from pyspark.sql import functions as F

from pagemere.operators import citations, link, writes
from pagemere.sources import files
from pagemere.streaming import pending


def test_writes(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "", "x"), (None, "n", "n")], "id int, p string, q string")
    new = spark.createDataFrame([(2, "b", "y"), (3, "c", "z"), (3, "c", "z")], "id int, p string, q string")
    assert {tuple(r) for r in writes.upsert(old, new, ["id"]).collect()} == {(1, "a", None), (None, "n", "n"), (2, "b", "y"), (3, "c", "z")}
    assert [tuple(r) for r in writes.append_absent(old, new, ["id"]).collect()] == [(3, "c", "z")]
    assert {tuple(r) for r in writes.fill_blanks(old, new.dropDuplicates(), "id", ["p", "q"]).collect()} == {(1, "a", None), (2, "b", "x"), (None, "n", "n")}
    after, history = writes.revise(old, spark.createDataFrame([(1, "a", None), (2, "", "w")], "id int, p string, q string"), "id", ["p", "q"])
    assert {tuple(r) for r in after.collect()} == {(1, "a", None), (2, "", "w"), (None, "n", "n")} and [tuple(r) for r in history.collect()] == [(2, "", "x")]
    changes = spark.createDataFrame([(1, ["p"], None, "new"), (2, None, None, None)], "id int, clear array<string>, p string, q string")
    assert {tuple(r) for r in writes.patch(old, changes, "id", ["p", "q"]).collect()} == {(1, None, "new"), (2, "", "x"), (None, "n", "n")}
    parents, children = writes.delete_cascade(old, spark.createDataFrame([(1,), (2,)], "note int"), old.filter("id = 1"), "id", "note")
    assert parents.count() == 2 and [r[0] for r in children.collect()] == [2]


def test_retag(spark):
    notes = spark.createDataFrame([(1, ["b", "a"]), (2, None), (3, ["z"])], "id int, tags array<string>")
    assert {r.id: r.tags for r in writes.retag(notes, [1, 2], ["c"], ["a"]).collect()} == {1: ["b", "c"], 2: ["c"], 3: ["z"]}


def test_one_to_one_is_greedy(spark):
    rows = [(1, 1, 0.9, 0.1), (1, 2, 0.8, 0.1), (2, 1, 0.85, 0.1), (2, 2, 0.2, 0.1), (3, 2, 0.2, 0.1)]
    got = link.one_to_one(spark.createDataFrame(rows, "a int, b int, score double, jaccard double"))
    assert {(r.a, r.b) for r in got.collect()} == {(1, 1), (2, 2)}


def test_citations(spark):
    cols = "id string, author string, title string, publisher string, place string, year int, kind string, container_id string, first_page int, url string, accessed string"
    rows = [("m", "Doe, Jane", "On Owls", "Press", "Town", 1999, "monograph", None, None, None, None), ("e", "Roe, R.", "Why?", None, None, None, "essay", "m", 12, None, None), ("x", None, "Bare", None, None, None, "monograph", None, None, "http://a", "2024")]
    w = citations.with_container(spark.createDataFrame(rows, cols))
    got = {r[0]: r[1] for r in w.select("id", citations.bibliography("chicago")).collect()}
    assert got["m"] == "Doe, Jane. *On Owls*. Town: Press, 1999."
    assert got["e"] == 'Roe, R. "Why?." In *On Owls*, 12. Town: Press, 1999.'
    assert got["x"] == "*Bare*. Accessed 2024. http://a."
    note = {r[0]: (r[1], r[2]) for r in w.select("id", citations.footnote(F.lit(7)), citations.mark_page(citations.footnote(F.lit(7)), F.lit(7))).collect()}
    assert note["m"] == ("Jane Doe, *On Owls*, (Town: Press, 1999), 7.", "Jane Doe, *On Owls*, (Town: Press, 1999), 7*.")
    assert note["e"][0] == 'R. Roe, "Why?," in *On Owls*, (Town: Press, 1999), 7.'


def test_citations_of_every_field(spark):
    cols = "id string, author string, editor string, translator string, title string, subtitle string, edition string, volume string, series string, publisher string, place string, year int, original_year int, kind string, container_id string, first_page int, last_page int, url string, accessed string"
    rows = [
        ("v", None, "Ed, Ann", "Tra, Bo", "Owls", "a Reader", "2.ª ed.", "2 vols.", "Night", "Press", "Town", 2001, None, "edited", None, None, None, None, None),
        ("c", "Doe, Jane", None, None, "Wings", None, None, None, None, "Own", "Own", 1900, 1899, "chapter", "v", 12, 30, None, None),
        ("t", "Doe, Jane", "Ed, Ann", "Tra, Bo", "Nights", None, "3rd ed", None, "Dark", " ", None, 1950, None, "monograph", None, None, None, "http://a", None),
        ("f", "Kubrick, S.", None, None, "Film", None, None, None, None, "Studio", "City", 1980, None, "film", None, None, None, "http://b", "today"),
    ]
    w = citations.with_container(spark.createDataFrame(rows, cols))
    got = {r.id: r for r in w.select("id", *(citations.bibliography(s).alias(s) for s in ("chicago", "chicago18", "mla")), citations.footnote(F.lit(None)).alias("note"), citations.short_note(F.lit(5)).alias("short")).collect()}
    assert got["v"].chicago == "Ed, Ann, ed. *Owls: a Reader*. Translated by Bo Tra. 2.ª ed. 2 vols. Night. Town: Press, 2001."
    assert got["v"].chicago18 == "Ed, Ann, ed. *Owls: a Reader*. Translated by Bo Tra. 2.ª ed. 2 vols. Night. Press, 2001."
    assert got["v"].mla == "Ed, Ann, editor. *Owls: a Reader*. Translated by Bo Tra, 2.ª ed., 2 vols., Press, 2001."
    assert got["c"].chicago == 'Doe, Jane. "Wings." 1899. In *Owls: a Reader*, edited by Ann Ed, translated by Bo Tra, 12–30. 2 vols. Town: Press, 2001.'
    assert got["c"].mla == 'Doe, Jane. "Wings." *Owls: a Reader*, edited by Ann Ed, translated by Bo Tra, 2.ª ed., 2 vols., Press, 2001, pp. 12–30.'
    assert got["c"].note == 'Jane Doe, "Wings," in *Owls: a Reader*, trans. Bo Tra, (Town: Press, 2001).'
    assert got["t"].chicago == "Doe, Jane. *Nights*. Translated by Bo Tra. Edited by Ann Ed. 3rd ed. Dark. 1950. http://a."
    assert got["t"].mla == "Doe, Jane. *Nights*. Translated by Bo Tra, edited by Ann Ed, 3rd ed, 1950. http://a."
    assert (got["f"].chicago, got["f"].mla) == ("Kubrick, S., dir. *Film*. 1980.", "*Film*. Directed by S. Kubrick, 1980.")
    assert (got["v"].short, got["c"].short) == ("Ed, *Owls*, 5.", 'Doe, "Wings", 5.')


def test_short_titles(spark):
    want = {"Transculturación narrativa en América Latina": "Transculturación narrativa", "The Polemics of Possession in Spanish American Narrative": "Polemics of Possession", "La ciudad letrada": "ciudad letrada", "One Two Three Four Five": "One Two Three Four", "El": "El", "A B of C D E": "B of C D"}
    got = spark.createDataFrame([(t,) for t in want], "t string").select("t", citations.short_title(F.col("t"))).collect()
    assert {r[0]: r[1] for r in got} == want


def _doc(work, texts):
    return json.dumps({"work_id": work, "page_offset": 1, "pages": [{"page": i, "printed_page": i + 1, "folio": None, "chars": len(t), "text": t} for i, t in enumerate(texts, 1)]}, indent=1)


def test_documents_and_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.json").write_text(_doc("a", ["one", "two"]))
    assert files.read_pages(spark, str(inbox)).count() == 2
    for more in ({}, {"b.json": _doc("b", ["x"])}, {"a2.json": _doc("a", ["only"])}):
        for name, text in more.items():
            (inbox / name).write_text(text)
        pending.run(spark, str(inbox), str(tmp_path / "pages"), str(tmp_path / "check"))
    assert {(r.work_id, r.text) for r in spark.read.parquet(str(tmp_path / "pages")).collect()} == {("a", "only"), ("b", "x")}


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", twice', ["a", "b"]), (2, None, None)], "id int, t string, tags array<string>")
    assert [r[0] for r in files.csv_lines(df).orderBy("value").collect()] == ['1,"say ""hi"", twice",a; b', "2,,"]
    (tmp_path / "x.csv").write_bytes("﻿id,name\r\n1,\"a \"\"b\"\"\"\r\n".encode())
    assert files.read_csv(spark, str(tmp_path / "x.csv")).collect()[0].asDict() == {"id": "1", "name": 'a "b"'}


def test_every_note_but_questions_is_of_a_work(spark):
    """No source is left out of the works of notes, which axes' works and writes on notes are read from."""
    from pagemere.plans.registry import relation
    from tests.oracle import SF

    notes = relation(spark, SF, "note").filter("kind <> 'question'").select(F.col("id").alias("note_id"), F.concat(F.lit("src"), F.col("n").cast("string")).alias("work_id"))
    got = relation(spark, SF, "note_work").select("note_id", "work_id")
    assert got.exceptAll(notes).isEmpty() and notes.exceptAll(got).isEmpty()

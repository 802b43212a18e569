"""First rows of a catalogue and the report on files."""

from pyspark.sql import functions as F

from pagemere.operators import seed


def test_kinds_and_rules(spark):
    rows = [("filmography", "A", "", ""), ("theory", "“A", "", ""), ("theory", "A", 'in "A" by', ""), ("theory", "A", "", "Doe, ed."), ("theory", "A", "", "Doe"), ("theory", "A", "", "")]
    got = spark.createDataFrame(rows, "l string, t string, e string, a string").select(seed.kind(*(F.coalesce(c, F.lit("")) for c in "ltea")).alias("k")).collect()
    assert [r.k for r in got] == ["film", "essay", "essay", "edited_volume", "monograph", "monograph"]
    names = ["in/A_ Title  of -- B -- c.pdf", " -- x.pdf", "no ending", "a" * 80 + ".pdf", "Ends, - -- y.pdf"]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(seed.match_string(F.col("n"))).collect()] == ["A Title of", " -- x", "no ending", "a" * 56, "Ends"]


def test_a_split_shares_the_file_only_if_it_holds_it(spark):
    e = spark.createDataFrame([(1, "w1", "theory", None, "A", "One", "1950", "One", True, "f", ".pdf", None, "978"), (2, "w2", "theory", None, "A", "Two", "n.d.", "Two", False, None, "", "torn", None)], "line int, id string, list_id string, section_id string, author string, title string, year string, entry string, examinable boolean, file string, ext string, note string, isbn string")
    v = spark.createDataFrame([("f", "citable", 3, 0.9, 50, 100, "")], "file string, verdict string, offset int, agreement double, folios int, pages int, against string")
    s = spark.createDataFrame([("w1", 1, "Also", "w1-a", True), ("w1", 2, "Apart", "w1-b", False), ("zz", 1, "None", "zz-a", True)], "id string, nth int, title string, new_id string, shares_file boolean")
    c = spark.createDataFrame([("w2", "vol", "Works", "A", "edited_volume", 1990)], "id string, container_id string, title string, author string, kind string, year int")
    works, places = seed.catalogue(e, v, s, c)
    got = {r.id: (r.kind, r.source_format, r.file, r.page_offset, r.year) for r in works.collect()}
    assert got == {"w1": ("monograph", "pdf_text", "f", 3, 1950), "w1-a": ("monograph", "pdf_text", "f", 3, 1950), "w1-b": ("monograph", "none", None, 0, 1950), "w2": ("essay", "none", None, 0, None), "vol": ("edited_volume", "none", None, 0, 1990)}
    assert [(r.work_id, r.ordinal) for r in places.orderBy("ordinal").collect()] == [("w1", 1), ("w1-a", 2), ("w1-b", 3), ("w2", 4)]
    assert all(df.isEmpty() for df in seed.catalogue(e.limit(0), v, s, c.limit(0)))

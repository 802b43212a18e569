import difflib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from pagemere.functions import layout, text
from pagemere.library import ToolError
from pagemere.operators import entities, extraction, matcher, motif, pages, studyaid, writes
from pagemere.plans import catalogue, derived
from tests.oracle import SF

PAGE = "work_id string, page_index int, text string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_clean_page(spark):
    def clean(text, *maps):
        return spark.createDataFrame([(text,)], "t string").select(layout.cleaned(F.col("t"), *maps)).first()[0]

    got = clean("o√ered ofﬁce\nsome-\nthing Franco-\nMexican\n\nNew  line a­b√ end.√2", {"√": "ff"})
    assert got == "offered office something Franco- Mexican\n\nNew line abff end.√2"
    assert clean("end.∞≤ x∞", None, {"∞": "1", "≤": "2"}) == "end.¹² x∞"
    assert clean("end.∞≤∞≤ a.¹∞", None, {"∞": "1", "≤": "2"}) == "end.¹²¹≤ a.¹∞"
    assert clean("\0ab") == "ab" and clean("") == "" and clean(None) is None
    assert clean("e\u0301te\u0301 \x1c \n \n\n\n x\u2003\n\u2003aˇc bˉd \xa0 y  ") == "\xe9t\xe9\n\n x\u2003 \u2003a\u010d b\u0304d y"


def test_blocks():
    long = "This is a line of about seventy characters in length, which is no heading"
    text = f"A heading\n\n{long}\n{long}\nshort end.\n{long}\n{long}"
    assert [k for k, _ in layout.blocks(text)] == ["heading", "text", "text"]
    assert layout.blocks("one line only") == [("text", "one line only")]
    assert layout.blocks("") == [] and layout.blocks("a-\nb.") == [("heading", "a-"), ("text", "b.")]


def test_wrap_and_labels():
    assert layout.wrap("one two three four five six seven eight nine ten eleven twelve thirteen fourteen")[-1].endswith("…")
    assert layout.wrap("short") == ["short"] and layout.wrap("") == []


def book(texts):
    return [("w", i, t) for i, t in enumerate(texts, 1)]


def test_furniture_folios_and_chapters(spark):
    texts = [f"{'Alpha' if i <= 10 else 'Beta' if i <= 20 else 'Gamma'} {i + 4}\nbody number words {'x' * i}.\nstamp text here\nmore body {'y' * i}." for i in range(1, 31)]
    p = spark.createDataFrame([*book(texts), ("w", 31, ""), ("w", 32, None), ("v", 1, "12")], PAGE)
    heads = pages.running_heads(p)
    assert {r[1]: r[2] for r in heads.collect()} == {"Alpha #": 10, "Beta #": 10, "Gamma #": 10}
    lines = extraction.boilerplate(p)
    assert rows(lines) == [("w", "stamp text here", 30)]
    assert {r.page_index: r.folio for r in extraction.folios(p, heads).filter("work_id = 'w'").collect()} == {**{i: i + 4 for i in range(1, 31)}, 31: None, 32: None}
    assert extraction.folios(p, heads).filter("work_id = 'v'").first().folio == 12
    assert [tuple(r)[2:] for r in extraction.chapters(p, heads).orderBy("ordinal").collect()] == [("Alpha", 1, 10), ("Beta", 11, 20), ("Gamma", 21, 32)]
    out = {r.page_index: r.text for r in extraction.stripped(p, heads, lines).filter("work_id = 'w'").collect()}
    assert out[3] == f"body number words {'x' * 3}.\nmore body {'y' * 3}." and out[31] == ""
    assert extraction.heads_on_pages(p, heads).count() == 30


def test_glyphs_damage_and_verdicts(spark):
    p = spark.createDataFrame([("a", 1, "o√er jjwq the su≈x. o√er"), ("a", 2, None), ("b", 1, "plain words here")], PAGE)
    assert {(r.glyph, r.n, tuple(r.examples)) for r in extraction.glyphs(p).collect()} == {("√", 2, ("o√er",)), ("≈", 1, ("su≈x",))}
    d = {r.work_id: (r.tokens, r.bad) for r in extraction.damage(p).collect()}
    assert d == {"a": (5, 4), "b": (3, 0)}
    body = "some printed words of an ordinary page, quite long enough to count as a text layer"
    whole = [f"{body}\n{i - 4 if i > 4 else 'x'}" for i in range(1, 81)]
    whole[1] += "\nISBN"
    whole[79] = "index\n" + whole[79]
    p = spark.createDataFrame(book(whole), PAGE)
    files = spark.createDataFrame([("w", "calibre", 0.0)], "work_id string, producer string, scan_share double")
    assert extraction.citability(p, files, pages.running_heads(p)).first()[1:4] == ("citable", -4, 76)
    works = spark.createDataFrame([("w", "a book.pdf")], "id string, path string")
    assert extraction.viability(p, works).first().verdict == "looks complete"
    assert extraction.viability(p.filter("page_index < 30"), works).first().reasons == "no index or bibliography; only 29 pages"


def score(item, f):
    """By the rule, in plain Python."""
    if item[2] and item[2] == f[2]:
        return 100

    def words(s):
        return [w for w in re.sub("[^a-z0-9 ]+", " ", s.lower()).split() if len(w) > 2 and w not in entities.STOP]

    it, ft = words(item[0]), words(f[0])
    if not it or not ft:
        return 0
    n = len(set(it) & set(ft))
    a, b = item[1].split(",")[0].lower(), f[1].split(",")[0].lower()
    author = bool(a) and (bool(b) and (a in b or b in a) or a in " ".join(ft))
    if len(it) <= 2:
        return 90 if set(it) <= set(ft) and author else 65 if set(it) <= set(ft) and len(ft) <= 3 else 0
    r = n / min(len(it), len(ft))
    base = 85 if " ".join(it[:3]) in " ".join(ft) else 65 if r >= 0.75 and n >= 2 else 45 if r >= 0.5 and n >= 2 else 40 if n >= 3 else 0
    return base + 25 * author


def test_item_files(spark):
    items = [("The Long Night of Stone", "Doe, J", ""), ("Cartucho", "Campobello, N", ""), ("Other Thing Entirely New Words", "", "9780306406157"), ("", "", "")]
    files = [("the long night of stone and more", "Doe, Jane", ""), ("cartucho", "", ""), ("cartucho campobello relatos mexico", "", ""), ("unrelated", "", "9780306406157"), ("stone night", "", "")]
    a = spark.createDataFrame([(i, *x) for i, x in enumerate(items)], "item int, title string, author string, isbn string")
    b = spark.createDataFrame([(i, *x, ".pdf") for i, x in enumerate(files)], "file int, title string, author string, isbn string, ext string")
    got = entities.item_file_scores(a, b)
    assert rows(got) == sorted((i, j, s) for i, x in enumerate(items) for j, y in enumerate(files) if (s := score(x, y)))
    chosen = spark.createDataFrame([(0, 4)], "item int, file int")
    assert rows(entities.item_files(got, b, chosen).filter("item < 3")) == [(0, 4, None, "override"), (1, 2, 90, "accept"), (2, 3, 100, "accept")]
    e = spark.createDataFrame([(1, "Pedro Páramo ; y El llano en llamas"), (2, "else")], "entry int, text string")
    w = spark.createDataFrame([("llano", "El llano en llamas"), ("pedro", "Pedro Páramo"), ("x", "Nothing here")], "work string, title string")
    assert rows(entities.split_entries(e, w, spark.createDataFrame([(1, "pedro")], "entry int, work string"))) == [("llano", 1)]


def test_isbn_names_and_repairs(spark):
    t = spark.createDataFrame([("a", 1, "ISBN 978-0-306-40615-7 (ebook)"), ("a", 2, "0-306-40615-2 and 9780804429573 paperback"), ("b", 1, None)], "id string, page int, text string")
    seen = entities.isbn_sightings(t)
    assert {(r.isbn13, r.kind) for r in seen.collect()} == {("9780306406157", "ebook"), ("9780804429573", "paper")}
    assert rows(entities.isbn_pick(seen)) == [("a", "9780804429573", "one print ISBN")]
    names = spark.createDataFrame([("Así fue.pdf",), ("b.pdf",)], "name string")
    bad = "Así fue.pdf".encode().decode("mac_roman")
    cells = spark.createDataFrame([(1, f"dir\\{bad} | b.pdf"), (2, "unknowné.pdf"), (3, None)], "id int, value string")
    assert rows(entities.repaired(cells, names)) == [(1, "Así fue.pdf | b.pdf"), (2, "unknowné.pdf"), (3, "")]
    assert rows(entities.name_matches(spark.createDataFrame([("w", "ASI F"), ("v", "b."), ("u", "zzz")], "work string, match string"), names)) == [("v", "b.pdf"), ("w", "Así fue.pdf")]


def test_units(spark):
    long = "x" * 60
    p = spark.createDataFrame([("w", i, i - 2, long) for i in range(1, 101)] + [("v", i, i, long) for i in range(1, 62)], "work_id string, page_index int, printed_page int, text string")
    s = spark.createDataFrame([("w", 1, "One", 1, 20), ("w", 2, "Two", 21, 80)], "work_id string, ordinal int, title string, first_page int, last_page int")
    got = [tuple(r)[2:] for r in studyaid.units(p, s).filter("work_id = 'w'").orderBy("n").collect()]
    assert got == [("One", 1, 20, 20), ("Two", 21, 50, 30), ("Two", 51, 80, 30), ("pages outside the index", 81, 98, 18)]
    assert [r.pages for r in studyaid.units(p, s).filter("work_id = 'v'").orderBy("n").collect()] == [30, 30, 1]


def test_unfound(spark):
    known = studyaid.vocabulary(spark.createDataFrame([("w", 1, "Bajtín wrote in Inglaterra in 1929 about Dostoievski")], PAGE))
    chunks = spark.createDataFrame([("según según según otra", "spanish")], "text string, lang string")
    texts = spark.createDataFrame([("w", 1, "Según Bajtin, Dostoyevski and Napoleon in 1929, 1930 c12"), ("w", 2, None)], "work_id string, id int, text string")
    got = {r.id: r.unfound for r in studyaid.unfound(texts, known, studyaid.common_words(chunks)).collect()}
    close = difflib.get_close_matches("dostoyevski", ["dostoievski"], cutoff=0.8)
    assert close and got == {1: ["Napoleon", "1930"], 2: []}


def test_aids_and_claims(spark):
    arg = json.dumps({"key_arguments": [{"title": "t", "claims": ["c1"]}]})
    s = spark.createDataFrame([("a", "argument", arg, True), ("a", "summary", "{broken", False), ("b", "summary", "{}", True)], "work_id string, kind string, body string, reviewed boolean")
    (r,) = studyaid.aids(s).collect()
    assert (r.work_id, r.reviewed, len(r.argument), r.summary, r.themes) == ("a", False, 1, [], [])
    stored = spark.createDataFrame([(1, "a", True, False), (2, "a", False, False), (3, "b", False, False), (4, "a", False, True)], "id int, work_id string, reviewed boolean, rejected boolean")
    fresh = spark.createDataFrame([(9, "a", False, False)], "id int, work_id string, reviewed boolean, rejected boolean")
    assert [r[0] for r in rows(studyaid.load_claims(stored, fresh))] == [1, 3, 4, 9]


def test_axis_map_rows_keep_their_distance(spark):
    axes = spark.createDataFrame([(i, f"axis {i}") for i in range(3)], "axis_id int, title string")
    edges = spark.createDataFrame([(a, w, w) for w, on in {"p": (0, 1), "q": (0, 1), "r": (1, 2), "s": (0,), "t": (0,)}.items() for a in on], "axis_id int, work_id string, label string")
    got = {r.work_id: (r.shared, r.x, r.row) for r in motif.axis_map(axes, edges).collect()}
    assert got == {"p": (True, 210.0, 0), "q": (True, 210.0, 1), "r": (True, 400.0, 0), "s": (False, 42.0, 0), "t": (False, 42.0, 1)}


def test_manifest_and_payload(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, t string")
    before, after = writes.manifest(a, "a"), writes.manifest(a.orderBy("id", ascending=False), "a")
    assert writes.changed(before, after).isEmpty()
    assert rows(writes.changed(before, writes.manifest(a.filter("id = 1"), "a"))) == [("a",)]
    d = spark.createDataFrame([(1, bytearray(b"x" * 100)), (2, bytearray(b"x" * 300))], "id int, body binary")
    assert [(r.id, r.fits, r.encoded is None) for r in writes.served(d, "body", most=200).orderBy("id").collect()] == [(1, True, False), (2, False, True)]


def test_library(spark):
    lib = derived.library(spark, SF)
    for call in (lambda: lib.work("sr"), lambda: lib.find_works(" "), lambda: lib.list_notes(), lambda: lib.read_pages("src3", 5, 4), lambda: lib.read_pages("src3", 1, 11), lambda: lib.find_quotation("src3", "too short"), lambda: lib.find_works(project=99), lambda: lib.search(" ")):
        with pytest.raises(ToolError):
            call()
    assert lib.find_works("SRC1").first().found == 11 and lib.find_works("no such work").isEmpty()
    citable = lib.relation("work").filter("offset_checked and (offset_problem is null or accepted)").select("id").first().id
    page = lib.relation("printed_text").filter(f"work_id = '{citable}' and printed_page > 0 and length(text) between 100 and 5000").first()
    text = " ".join(page.text.split())[:90]
    note, anchors = lib.draft_note("a thought", [(citable, text, page.printed_page)])
    assert anchors.first().work_id == citable and anchors.first().note_id == note.first().id
    with pytest.raises(ToolError, match="nothing written"):
        lib.draft_note("a thought", [(citable, text, None), (citable, "words that stand in no book at all, surely", None)])


def test_quotations_are_searched_in_the_pages_of_their_own_work(spark):
    rows = [("a", i, i, f"page {i} of the first book says the {w} owl flies by night over the old town") for i, w in enumerate(("grey", "white", "brown"), 1)] + [("b", 1, 1, "another book altogether, with nothing about birds in it")]
    pages_ = spark.createDataFrame(rows, "work_id string, page_index int, printed_page int, text string")
    asked = [
        ("a", 1, 1, "the white owl flies by night over", 3), ("a", 2, 1, "the purple cow walks by day under a bridge", 2), ("b", 3, 1, "the white owl flies by night over", 1),
        ("a", 4, 1, "owl flies by night over the old town", 2), ("a", 5, 1, "says the white owl flies by nigth over the old town", 2), ("a", 6, 1, "the white owl", 2), ("a", 7, 1, "the grey owl flies by night over", None),
    ]
    quotes = spark.createDataFrame(asked, "work_id string, claim_id long, n int, text string, near int")
    for at_once in (150_000, 1):
        got = {r.claim_id: r.page for r in matcher.find(pages_, quotes, ["work_id", "claim_id", "n"], at_once).collect()}
        exact = {c: [p for w, _, p, t in rows if w == work and q in t and len(q) >= 25] for work, c, _, q, _ in asked}
        assert set(got) == {c for c, places in exact.items() if places} | {5}
        assert got[1] == 2 and got[4] == 2 and got[5] == 2 and got[7] == 1


def test_word_search_has_all_languages_and_folds(spark):
    rows = [(1, "The other, the", "en"), (2, "Thérèse", "fr"), (3, "lathe éthe", None), (4, "búho y lechuza", "es"), (5, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id: r.hits for r in derived.word_search(docs, "the").collect()} == {1: 2, 2: 1}
    assert {r.doc_id: r.hits for r in derived.word_search(docs, "the, Buho").collect()} == {1: 2, 2: 1, 4: 1}


def test_scan_is_capped_at_three_thousand(spark):
    for n in (301, 2999, 3000, 3001):
        chunks = spark.range(n).selectExpr("id as chunk_id", "cast(id as int) as start_page", "'en' as lang")
        got = catalogue.capped_scan(chunks).collect()
        assert len(got) == min(n, 3000) and {r.capped for r in got} == {n >= 3000}


def test_places_come_in_the_order_of_passes(spark):
    import random

    from pagemere.functions.text import key, normalize

    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("owl", "moon", "night", "river", "stone") for b in ("", "s", "light", "less")]
    books = {w: [" ".join(rng.choice(words) for _ in range(12)) for _ in range(14)] for w in "ab"}
    books["a"][9] = books["a"][2]
    books["b"][5] = f"{books['b'][1][:40]} {books['b'][8]}"
    printed = {w: [p - 2 if p < 9 else p - 3 for p in range(1, 15)] for w in books}  # one number stands twice
    rows = [(w, i + 1, printed[w][i], t) for w, ts in books.items() for i, t in enumerate(ts)]
    asked = []
    for i in range(150):
        w = rng.choice("ab")
        p = rng.randrange(14)
        text = books[w][p]
        if rng.random() < 0.4 and p < 13:
            cut = rng.randrange(10, 40)
            text = f"{text[-cut:]} {books[w][p + 1][: 60 - cut]}"
        else:
            start = rng.randrange(0, 20)
            text = text[start : start + rng.randrange(20, 60)]
        asked.append((i, w, text, rng.choice([None, *range(-1, 14)]), rng.choice([None, [], [p + 1, 3], [5, 6, 7, 8]])))

    def place(w, text, near, unit):
        norm = [normalize(t) for t in books[w]]
        q = normalize(text).strip(" \"'“”«»")
        if len(q) < 25:
            return None
        spots = []
        if near is not None and near in printed[w]:
            c = printed[w].index(near)
            spots = [n for n in (c, c - 1, c + 1, c - 2, c + 2) if 0 <= n < 14]
        for positions in (spots, spots + [u - 1 for u in unit or [] if u - 1 not in spots], range(14)):
            for n in positions:
                if key(q) in key(norm[n]):
                    return printed[w][n]
            for n in positions:
                if n < 13:
                    one, split = matcher.joined(norm[n], norm[n + 1])
                    at = key(one).find(key(q))
                    if at >= 0:
                        return printed[w][n if at < split else n + 1]
        return None

    pages_ = spark.createDataFrame(rows, "work_id string, page_index int, printed_page int, text string")
    quotes = spark.createDataFrame(asked, "claim_id int, work_id string, text string, near int, unit array<int>")
    got = {r.claim_id: r.page for r in matcher.find(pages_, quotes, ["claim_id"]).collect() if r.match == "exact"}
    assert got == {i: p for i, w, t, near, unit in asked if (p := place(w, t, near, unit)) is not None} and len(got) > 100


def test_unfound_words_equal_all_pairs_of_each_work(spark):
    """Words compared once for all works pass only in works that hold the close word."""
    rng = random.Random(4)
    word = lambda: rng.choice("AB") + "".join(rng.choice("abé") for _ in range(rng.randrange(1, 11)))
    known = {(f"w{i % 3}", text.fold(word(), "c")) for i in range(150)}
    rows = [(f"w{i % 3}", i, " ".join(word() for _ in range(12))) for i in range(45)]
    common = {"ab"}

    def found(w, x):
        long = len(x) >= 4 and any(v == w and len(o) >= 4 and o[0] == x[0] and difflib.SequenceMatcher(None, o, x).ratio() >= 0.8 for v, o in known)
        return x in common or (w, x) in known or long

    want = {i: [t for t in dict.fromkeys(x.split()) if not found(w, text.fold(t, "c"))] for w, i, x in rows}
    made = spark.createDataFrame(rows, "work_id string, id int, text string"), spark.createDataFrame(sorted(known), "work_id string, word string"), spark.createDataFrame([("ab",)], "word string")
    got = {r.id: r.unfound for r in studyaid.unfound(*made).collect()}
    assert got == want and any(want.values())


def test_batches_of_texts_are_bounded(spark):
    """What a Python worker is sent at once doesn't grow with a partition."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    text.folded(F.lit("x"))
    assert int(spark.conf.get(name)) <= 512
    spark.conf.set(name, before)


def test_pages_of_one_work_are_numbered_without_meeting_in_one_task(spark, tmp_path):
    """Also where a doc_id is missing or there twice; page numbers have no gaps and rise with doc_id."""
    docs = [(i, f"text {i}", "en", "src3") for i in range(400)] + [(7, "again", "en", "src3"), (None, "none", "en", "src3"), (5, "other", "es", "src4"), (6, "nowhere", "es", None)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = derived.sql(spark, str(tmp_path), "SELECT work_id, page_index, chunk_id, text FROM page").withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sorted((r.chunk_id is not None, r.chunk_id or 0, r.text, r.work_id) for r in got) == sorted((d is not None, d or 0, t, s) for d, t, _, s in docs if s)
    ids = [r.chunk_id for r in sorted(got, key=lambda r: r.page_index) if r.work_id == "src3"]
    assert ids[0] is None and ids[1:] == sorted([*range(400), 7]) and sorted(r.page_index for r in got if r.work_id == "src3") == list(range(1, 403))
    assert len({r.part for r in got if r.work_id == "src3"}) > 1


def test_a_vocabulary_runs_its_pattern_once_and_needs_no_page_numbers(spark, monkeypatch):
    seen = []
    vocabulary = studyaid.vocabulary
    monkeypatch.setattr(studyaid, "vocabulary", lambda p: seen.append((p, vocabulary(p))) or seen[-1][1])
    derived.x31_unfound(spark, SF)
    (texts, got), whole = seen[0], vocabulary(derived._pages(spark, SF))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1 and "Window" not in texts._jdf.queryExecution().optimizedPlan().toString()
    assert got.exceptAll(whole).isEmpty() and whole.exceptAll(got).isEmpty()


def test_a_passage_that_reads_alike_backwards_is_close_by_the_rule_of_the_reference():
    page, quote = " ".join(["Reer"] * 24) + " ouer this", "zq " + " ".join(["reeR"] * 16) + "  qz"
    ratio, position, found = matcher.closest(matcher.quote_key(quote), [(1, page, None)])
    assert ratio >= 0.92 and position == 1 and set(found.split()) == {"Reer"}

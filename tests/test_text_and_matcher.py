import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemere.functions import text as T
from pagemere.operators import chunks, matcher, pages, similar
from pagemere.plans import registry
from pagemere.sources.shared import BATCH_ROWS

NORMAL = [
    ("auto­bus", "autobus"), ("word¹² next", "word next"), ("some-\nthing", "something"), ("some‐\r\nthing", "something"), ("12-\n13", "12- 13"),
    ("éa", "éa"), ("a  b\t c d", "a b c d"), (" x \n y ", "x y"), ("", ""),
]


@pytest.mark.parametrize("raw,want", NORMAL)
def test_normalize(raw, want):
    assert T.normalize(raw) == want


@pytest.mark.parametrize("raw,want", [("“A”", '"a"'), ("x—y", "x-y"), ("İ", "İ"), ("É", "é"), ("Σ", "σ"), ("K", "k")])
def test_key_keeps_length(raw, want):
    assert T.key(raw) == want and len(T.key(raw)) == len(raw)


def test_folds_differ():
    assert [T.fold("Straße É!", m) for m in "abcdef"] == ["strasse e!", "straße e!", "straße e!", "straße e!", "strasse e ", "strasse-e"]


def test_word_forms():
    assert T.word_forms("Owl,  owl s, x, owl") == [r"(?<![\p{L}\p{N}_])owl", r"(?<![\p{L}\p{N}_])owl\s+s"]


def test_isbn(spark):
    got = spark.createDataFrame([("0-306-40615-2",), ("080442957X",), ("9780306406157",), ("9780306406158",), ("08044X2957",), (None,)], "s string")
    assert [r[0] for r in got.select(T.isbn13(F.col("s"))).collect()] == ["9780306406157", "9780804429573", "9780306406157", None, None, None]


BOOK = [
    (1, "The quick night heron watched the river until the lamps went out."),
    (2, "Nobody in the valley could remember who had built the long stone bridge ac-"),
    (3, "ross the water, and nobody wished to ask about it either."),
    (4, "A very plain sentence ends this page without any mark at all"),
    (5, "and it goes on here for a good while before it stops."),
]


def _book(spark):
    return spark.createDataFrame([("w", i, i - 1, t) for i, t in BOOK], "work_id string, page_index int, printed_page int, text string")


def test_exact_and_joined(spark):
    quotes = spark.createDataFrame([(1, "“the quick NIGHT heron watched the river”"), (2, "the long stone bridge across the water, and nobody"), (3, "without any mark at all and it goes on here"), (4, "too short"), (5, None), (6, "never said anywhere in this book at all")], "item_id bigint, quote string")
    got = {(r.item_id, r.pages, r.alone, r.text) for r in matcher.find_exact(_book(spark), quotes).collect()}
    assert got == {(1, "0", True, "The quick night heron watched the river"), (2, "1–2", False, "the long stone bridge across the water, and nobody"), (3, "3–4", False, "without any mark at all and it goes on here")}


def test_close(spark):
    quotes = spark.createDataFrame([(1, "The quick night heron watched the rivers until the lamps went out", "w", 1), (2, "Something that is not in the book, not even nearly so", "w", 1)], "item_id bigint, quote string, work_id string, near int")
    got = matcher.find_close(_book(spark), quotes).collect()
    assert [(r.item_id, r.printed_page) for r in got] == [(1, 0)] and got[0].match.startswith("close (9")


def test_empty_quotes(spark):
    assert matcher.find_exact(_book(spark), spark.createDataFrame([], "item_id bigint, quote string")).count() == 0


def test_chunker_limits():
    text = " ".join(f"Sentence number {i} is here to fill the page with words of the book." for i in range(200))
    made = list(chunks.chunk_pages([(1, text), (2, "x"), (3, text)]))
    assert [m[0] for m in made] == list(range(1, len(made) + 1)) and made[0][3] == "english"
    assert all(m[4] <= chunks.CEILING + chunks.OVERLAP + 2 for m in made) and made[-1][2] == 3


def test_language():
    assert chunks.language("the of and to in " * 5) == "english" and chunks.language("el la los de que " * 5) == "spanish" and chunks.language("the of") is None


def test_offset_verdicts(spark):
    def work(w, shift, n, bad=()):
        return [(w, i, i, None if i % 4 == 0 else i + (9 if i in bad else shift)) for i in range(1, n + 1)]

    rows = work("right", 0, 40) + work("moved", 4, 40) + work("few", 0, 6) + [("two", i, i, i + (2 if i <= 20 else 5)) for i in range(1, 41)]
    p = spark.createDataFrame(rows, "work_id string, page_index int, printed_page int, folio int")
    none = spark.createDataFrame([], "work_id string")
    got = {r.work_id: (r.verdict, r.page_offset) for r in pages.offset_verdicts(p, none).collect()}
    assert got == {"right": ("confirmed", None), "moved": ("corrected", 4), "few": ("problem", None), "two": ("problem", None)}


def test_mds_keeps_order():
    at = np.array([[0, 0], [1, 0], [0, 3.0]]) / 10
    s = 1 - np.linalg.norm(at[:, None] - at[None], axis=2)
    got = similar.mds(s)
    assert got.shape == (3, 2) and got.min() == 0 and got.max() == 1 and len(similar.mds(s[:2, :2])) == 0


def test_chunks_of_languages_and_streams(spark):
    es, en = "El perro de la casa y el gato que no es un animal con más de una vida. " * 30, "The dog of the house and the cat that was not in a hat for his own life. " * 30
    made = list(chunks.chunk_pages([(1, en), (2, es), (3, es), (4, "x" * 5000), (5, en)]))
    assert [m[3] for m in made][0] == "english" and "spanish" in [m[3] for m in made] and [m[0] for m in made] == list(range(1, len(made) + 1))
    change = next(i for i, m in enumerate(made) if m[3] == "spanish")
    assert made[change][5].startswith("El perro")  # no overlap over a change of language
    for a, b in zip(made, made[1:], strict=False):
        if a[3] == b[3] and a[2] == b[1]:
            assert len(b[5].split("\n\n")[0]) <= chunks.OVERLAP or b[5].startswith("x") or a[5].endswith("x" * 100)
    rows = [("w", 1, en), ("w", 2, es), ("v", 1, None), ("v", 2, en), ("w", 3, es), (None, 1, en)]
    got = sorted((r.work_id, r.ordinal, r.text) for r in chunks.chunk(spark.createDataFrame(rows, "work_id string, page_index int, text string")).collect())
    want = sorted((w, c[0], c[5]) for w, p in (("w", [(1, en), (2, es), (3, es)]), ("v", [(1, ""), (2, en)])) for c in chunks.chunk_pages(p))
    assert got == want
    assert chunks.chunk(spark.createDataFrame([], "work_id string, page_index int, text string")).count() == 0


def test_many_quotations_meet_on_seeds_as_few_do_by_automaton(spark):
    """Both ways give the same places: alone and over a seam, glued words, odd letters, copies, and pages without text."""
    rng = random.Random(5)
    words = ["owl", "River", "naïve", "stones", "ΣΑΣ", "İstanbul", "n-ight", "the", "𝒳yz", "of", "“so”"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice((0, 3, 8, 60, 400)))) for _ in range(60)]
    texts[7], texts[20], texts[21], texts[40] = None, "the end of it is bro-", "ken over two pages and goes on", texts[5]
    rows = [(f"w{i % 3}", i // 3 + 1, i // 3 - 1, t) for i, t in enumerate(texts)]
    pages_ = spark.createDataFrame(rows, "work_id string, page_index int, printed_page int, text string")
    quotes = [(0, "x" * 30), (1, None), (2, "short"), (3, "it is broken over two pages")]
    for i in range(300):
        a, b = texts[rng.randrange(60)] or "", texts[rng.randrange(60)] or ""
        at, size = rng.randrange(0, max(1, len(a))), rng.choice((20, 25, 26, 40, 300))
        quotes.append((i + 4, rng.choice((a[at : at + size], f"{a[-size // 2:]} {b[: size // 2]}", a[at : at + size].upper()))))
    for i in range(0, 57, 2):
        quotes.append((400 + i, f"{(texts[i] or '')[-30:]} {(texts[i + 3] or '')[:30]}"))
    q = spark.createDataFrame(quotes, "item_id bigint, quote string")
    few, many = (sorted(map(tuple, matcher.find_exact(pages_, q, at_once).collect())) for at_once in (10**6, 0))
    assert few == many and {h[7] for h in few} == {True, False} and len(few) > 100


def test_every_seed_of_a_part_is_a_seed_of_the_whole():
    rng = random.Random(2)
    whole = "".join(rng.choice("abÉ 𝒳") for _ in range(500))
    for _ in range(200):
        at = rng.randrange(475)
        part = whole[at : at + rng.randrange(25, 120)]
        got = set(matcher.seeds(part).tolist())
        assert (got or len(part) < matcher.LEAST_CHARS) and got <= set(matcher.seeds(whole).tolist())


def test_no_close_match_is_left_out_unseen():
    """The cheap test lets every match through that the likeness finds, and few others."""
    rng = random.Random(9)
    words = "the night heron watched rivers until lamps went out over stones and owls of a town".split()
    passed = 0
    for i in range(400):
        page = " ".join(rng.choice(words) for _ in range(120))
        at = rng.randrange(len(page) - 90)
        q = list(page[at : at + rng.randrange(26, 90)])
        for _ in range(rng.randrange(0, 7)):
            j = rng.randrange(len(q))
            q[j : j + 1] = rng.choice(([], ["x"], [q[j], "y"], [" "]))
        q = T.key("".join(q))
        ratio, start, end = matcher._likeness(q, page)
        close = round(ratio, 12) >= matcher.CLOSE and 0.85 * len(q) <= end - start <= 1.2 * len(q)
        assert matcher.may_be_close(q, T.key(page)) or not close
        passed += close
    assert passed > 50
    page = " ".join(rng.choice(words) for _ in range(2000))
    assert sum(matcher.may_be_close("".join(rng.choice("etaoin shr") for _ in range(60)), page) for _ in range(50)) == 0


def test_batches_are_bounded_in_any_session_and_thread(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for query in ("x1_fold", "v8_motif_rows", "v10_marks"):
        for run in (lambda f: f(), lambda f: ThreadPoolExecutor(1).submit(f).result()):
            other = spark.newSession()
            other.conf.set(name, "10000")
            assert int(other.conf.get(name)) > BATCH_ROWS
            run(lambda other=other, query=query: registry.QUERIES[query](other, "/root/testdata/sf0.001"))
            assert int(other.conf.get(name)) == BATCH_ROWS

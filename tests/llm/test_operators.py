"""Each operator against a brute-force version or an exact round trip, and on awkward rows."""

import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from pagemere.llm import components, decontaminate, labelled, language_model, licenses, media, minhash, order, packing, quality, queries, tokens, toxicity, warc
from pagemere.llm.common import Tables
from tests.oracle import SF, same

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, label int"
LABELS = "doc_id bigint, quality int, toxic int"
BPE = public_tokenizers.path("word_bpe_49k.json")


def awkward(spark):
    rng = random.Random(5)
    long = " ".join(rng.choice("alpha beta gamma delta omega".split()) + str(rng.randrange(999)) for _ in range(9000))
    texts = [None, "", "   ", "one", "One", "a b c", long, long, long + " end", "café 你好 Σ mixed", "the <|endoftext|> tag", "line\nline\nline", "GNU General Public License, CC-BY"]
    rows = [(i, t, "en", "s", None, 1.0, 3) for i, t in enumerate(texts)] + [(None, "no id here", None, None, None, None, None), (6, long, "en", "s", 1, None, 1)]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, 9)] + [(None, 1, 1), (3, None, None)], LABELS)


def brute_components(texts, k, percent):
    sets = {i: ({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if (w := (t or "").lower().split()) else set()) for i, t in texts.items()}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((top(i), top(j)))
                    root[b] = a
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_near_duplicates_brute_force(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(60)}" for _ in range(80)]
    texts = {}
    for i in range(150):
        w = list(base) if i % 3 else [f"v{rng.randrange(300)}" for _ in range(rng.randrange(1, 60))]
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(w)
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id bigint, text string")
    for block in (512, 8):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, k=4, block=block).collect()}
        assert got == brute_components(texts, 4, 80)


def test_near_duplicates_awkward(spark):
    got = minhash.near_duplicates(awkward(spark), k=5).collect()
    assert len(got) == 15 and minhash.near_duplicates(empty(spark)).count() == 0
    of = {r.doc_id: r for r in got if r.doc_id is not None}
    assert of[0].n_shingles == of[1].n_shingles == of[2].n_shingles == 0 and of[0].kept and of[1].kept
    assert of[4].component_id == 3 and {of[7].component_id, of[8].component_id} == {6}
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500)]
    got = {r.u: r.v for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint"), Tables(spark, "t")).collect()}
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((top(u), top(v)))
        root[b] = a
    assert got == {x: top(x) for x in root if top(x) != x}


def brute_contamination(text, items):
    word = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = word(text), set(), set()
    for i, t in items:
        x = word(t)
        n = min(10, len(x))
        for win in {tuple(x[j : j + n]) for j in range(len(x) - n + 1)} if x else ():
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) == win:
                    hit |= set(range(p, p + n))
                    found.add(str(i))
    return len(w), len(hit), len(found)


@pytest.mark.parametrize("limit", [1 << 25, 0])
def test_contamination(spark, limit):
    rng = random.Random(3)
    items = [(1, " ".join(f"b{i}" for i in range(25))), (2, "Tiny Item"), (3, "single"), (4, None), (5, ""), (2, "Tiny Item"), (6, " ".join(f"b{i}" for i in range(9, 20))), (7, "aa aa aa aa aa aa aa aa aa aa aa")]
    texts = [" ".join([f"z{rng.randrange(50)}" for _ in range(20)] + [f"b{i}" for i in range(a, a + n)] + ["tiny-item"] * (a % 2)) for a in range(6) for n in (5, 12, 19)]
    texts += [None, "", "SINGLE!", "aa " * 30, "b9 b10"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "single"), (0, texts[0]), (0, "other single")], "doc_id bigint, text string")
    got = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id bigint, text string"), broadcast_bytes=limit).collect()
    want = sorted((str(i), *brute_contamination(t, items)) for i, t in docs.collect())
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items) for r in got) == want
    assert all(r.contaminated == (r.n_hit > 0) for r in got)


def test_contamination_awkward(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(awkward(spark), none).filter("contaminated").count() == 0
    assert decontaminate.contamination(empty(spark), spark.createDataFrame([(1, "x y")], "item_id bigint, text string")).count() == 0


def test_word_ids_equal_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    rng = random.Random(4)
    made = ["".join(rng.choice("abcXYZ'stre lvdm09.,!éÉß½ª \u0085\n\t\x1c你́İ-") for _ in range(60)) for _ in range(400)]
    for text in [*made, "<|endoftext|> a", "", "don't we'll I'M µ ×"]:
        assert np.frombuffer(tokens.WordIds.ids(tokens.word_ids(BPE), text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def sequential_best_fit(lengths, capacity):
    import bisect

    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, x)
        left = rooms.pop(i) - x if i < len(rooms) else capacity - x
        n += left == capacity - x and i >= len(rooms) + 0 and True
        bisect.insort(rooms, left)
    return len(rooms)


def test_packing_equals_sequential_best_fit(spark):
    rng = random.Random(6)
    lengths = [rng.randrange(1, 101) for _ in range(700)] + [40] * 300
    rows = spark.createDataFrame([(i // 2, i % 2, n) for i, n in enumerate(lengths)] + [(None, 0, 5), (1, 9, None), (1, 8, 0), (1, 7, 101)], "doc_id bigint, piece int, length bigint")
    got = packing.pack(rows, 100, partitions=7).collect()
    placed = {}
    for r in got:
        if r.sequence_id is not None:
            placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in placed.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 100
    assert sum(map(len, placed.values())) == 1001 and len(got) == 1004
    assert len(placed) == sequential_best_fit([*lengths, 5], 100)


def test_pack_documents_round_trip(spark):
    docs = awkward(spark)
    cut, places = packing.pack_documents(docs, BPE, 64)
    ids = {}
    for r in cut.filter("doc_id is not null and doc_id != 6").collect():
        ids.setdefault(r.doc_id, {})[r.piece] = r.ids
    for r in docs.filter("doc_id is not null and doc_id != 6").collect():
        assert b"".join(ids[r.doc_id][p] for p in sorted(ids[r.doc_id])) == tokens.word_ids(BPE).whole(r.text or "") + bytes(4)
    assert places.count() == cut.count() and packing.pack_documents(empty(spark), BPE)[1].count() == 0


def test_media_round_trip(spark):
    got = media.read(media.store(awkward(spark))).collect()
    of = {r.doc_id: r.text for r in awkward(spark).filter("doc_id is not null").collect()}
    assert len(got) == 15 and media.store(empty(spark)).count() == 0
    for r in got:
        assert len(r.payload) % 192 == 0 and len(r.payload) > 0 and len(r.times) == len(r.codes)
        if r.doc_id is not None:
            raw = (of[r.doc_id] or "").encode()
            assert r.n_bytes == len(raw) and r.payload == raw.ljust(len(r.payload), b" ") and len(r.payload) - len(raw) <= 192


def test_media_finds_tones():
    n = np.arange(192 * 20)
    _, codes = media.peaks((128 + 60 * np.sin(2 * np.pi * 40 / 384 * n)).astype(np.uint8).tobytes())
    assert np.bincount(codes & 511).argmax() == 40


def test_license_scan(spark):
    notice = "Permission is hereby grunted, free of charge, to any person obtaning a copy"
    rows = [(1, "MIT License mit license"), (2, f"x y {notice} z"), (3, "apache licenses"), (4, None), (5, "cc by cc by GNU General Public License")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].starts == [0, 2] and got[1].score == 1 and got[3].starts == [] and got[4].n_words == 0
    assert [(f.label, f.first, f.last, f.edits) for f in got[2].found] == [("mit", 2, 14, 2)] and got[2].score == 0.5
    assert sorted(got[5].starts) == [0, 2, 4]
    assert licenses.scan(awkward(spark)).count() == 15 and licenses.scan(empty(spark)).count() == 0


def test_license_names_and_borders():
    def found(text):
        return [(label, n) for label, _, _, n in licenses.notices((b" " + b" ".join(licenses.words(text)) + b" ").decode("latin-1"))]

    for other in ("bsd", "isc", "gnu", "mitt", "nit"):
        assert found(f"released under the {other} license") == []
    assert found("small rights reserved") == found("licensed under the apache license version 3 0") == []
    assert found("released under the mit licence") == [("mit", 1)]
    assert found("Licensed under the Apache lisense, version 2.0") == [("apache", 1)]
    assert found("all rights reservd, all right reserved") == [("all-rights-reserved", 1)] * 2
    assert found("released under the mit license " * 3) == [("mit", 0)] * 3


def test_license_notices_brute_force():
    rng = random.Random(12)
    for _ in range(150):
        notice = rng.choice(list(licenses.NOTICES))
        e = licenses._edits(notice, licenses.EDITS)
        text = list(notice)
        for _ in range(rng.randrange(0, 5)):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice((["q"], [], [text[at], "z"]))
        text = " ".join(f"{rng.choice(['', 'under the', 'all'])} {''.join(text)} the".split())
        ws = text.split()
        want = set()
        for n, label in licenses.NOTICES.items():
            most = licenses._edits(n, licenses.EDITS)
            tell = [w for w in n.split() if w in licenses.TELLING]
            spans = [ws[i:j] for i in range(len(ws)) for j in range(i + 1, min(len(ws), i + len(n.split()) + 4) + 1)]
            fits = [edit_distance(n, " ".join(s)) for s in spans if abs(len(" ".join(s)) - len(n)) <= most and [w for w in s if w in tell] == tell]
            if fits and min(fits) <= most:
                want.add((label, min(fits)))
        got = licenses.notices(f" {text} ")
        assert e >= 1 and {x for x, _ in want} == {x[0] for x in got}, text
        for label in {x for x, _ in want}:
            assert min(n for x, n in want if x == label) == min(x[3] for x in got if x[0] == label), text


@pytest.mark.parametrize("text", ["all rights reserve ", "released under the mit licens ", "mit license "])
def test_license_time_grows_with_the_text(spark, text):
    import time

    docs = spark.createDataFrame([(1, text * (1_000_000 // len(text)), "x")], "doc_id bigint, text string, score string")
    licenses.scan(docs.limit(0)).collect()
    start = time.time()
    assert licenses.scan(docs).select(F.size("found") + F.size("starts")).first()[0] >= 1_000_000 // len(text)
    assert time.time() - start < 5


def test_license_base_brute_force(spark):
    got = {r.doc_id: r for r in queries.op7_license_scan(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or ""))
        at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.base_labels) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (g.first_word, g.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))


def test_warc_salvage():
    raw = [warc.record(i, f"http://x/{i}", f"<p>{i}</p>".encode() * 20) for i in range(6)]
    packed = [warc.pack(r) for r in raw]
    data = b"".join([packed[0], b"garbage\x1f\x8b\x08junk", packed[1], packed[2][:-20], packed[3], raw[4], raw[5][:40], raw[5]])
    got = list(warc.salvage(data))
    assert [f.head["warc-record-id"] for f in got if f.head] == [f"<urn:page:{i}>" for i in (0, 1, 3, 4, 5)]
    gaps = [(f.begin, f.end) for f in got if f.head is None]
    assert len(gaps) == 3 and gaps[0] == (len(packed[0]), len(packed[0]) + len(b"garbage\x1f\x8b\x08junk"))


def page_ids(data):
    return [f.head["warc-record-id"][10:-1] if f.head else None for f in warc.salvage(data)]


def test_warc_salvages_within_members():
    noise = random.Random(8)
    raw = [warc.record(i, "u", noise.randbytes(3000)) for i in range(6)]
    wrong = raw[1][:-9] + b"?" + raw[1][-8:]
    assert page_ids(warc.pack(raw[0] + wrong + raw[2])) == ["0", None, "2"]
    whole = warc.pack(b"".join(raw))
    assert page_ids(whole) == list("012345")
    assert page_ids(whole[:-4000] + warc.pack(raw[5])) == ["0", "1", "2", "3", None, "5"]
    broken = bytearray(whole)
    broken[9000] ^= 255
    got = page_ids(bytes(broken) + warc.pack(raw[3]))
    assert got[:2] == ["0", "1"] and got[-2:] == [None, "3"] and "2" not in got
    plain = zlib.compressobj(0, zlib.DEFLATED, 31)  # its bytes stand in the member as they are
    stored = bytearray(plain.compress(raw[0] + raw[1]) + plain.flush())
    stored[-6] ^= 1
    assert page_ids(bytes(stored) + raw[2]) == ["0", "1", None, "2"]


def test_warc_salvage_is_linear_on_damage():
    import time

    good = warc.record(7, "u", b"x" * 500)

    def seconds(damage, n):
        data = damage * (n // len(damage)) + good
        began = time.process_time()
        assert page_ids(data) == [None, "7"]
        return time.process_time() - began

    for damage in (b"WARC/1.0\r\n", b"junk WARC/1.0\r\n", b"WARC/1.0\r\nA: b\r\n", b"WARC/1.1\r\nContent-Length: x\r\n\r\n"):
        small = min(seconds(damage, 1 << 19) for _ in range(2))
        assert seconds(damage, 1 << 22) < 2.5**3 * small + 0.5, damage


def test_warc_long_pages(spark):
    html = "<p>long</p>" * 400_000
    pages = spark.createDataFrame([(1, "u", html), (2, "u", html), (3, "u", "s")], "page_id bigint, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.read(warc.write(pages)).collect()}
    assert got == {1: (len(html), "response", None), 2: (len(html), "revisit", 1), 3: (1, "response", None)}


def test_warc_of_other_writers(spark):
    def made(version, fields, body):
        return f"WARC/{version}\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(body))]).encode() + b"\r\n" + body + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>x</p>"
    sha = warc.digest(b"abc")
    records = [
        made("1.0", [("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:uuid:1>")], b"software: x"),
        made("1.0", [("WARC-Type", "request"), ("WARC-Target-URI", "http://x/"), ("Content-Type", "application/http; msgtype=request")], b"GET / HTTP/1.1\r\n\r\n"),
        made("1.1", [("WARC-Type", "response"), ("WARC-Target-URI", "http://x/\r\n folded"), ("Content-Type", "application/http; msgtype=response")], http),
        made("1.0", [("WARC-Type", "revisit"), ("WARC-Payload-Digest", f"sha1:{sha}")], b""),
        made("1.0", [("WARC-Type", "revisit")], b""),
        made("0.18", [], b"no type"),
        made("1.1", [("WARC-Type", "resource"), ("WARC-Block-Digest", "sha1:" + __import__("hashlib").sha1(b"abc").hexdigest())], b"abc"),
        made("1.1", [("WARC-Type", "resource"), ("WARC-Block-Digest", "md5:" + "0" * 32)], b"abc"),
        made("1.1", [("WARC-Type", "metadata"), ("WARC-Block-Digest", "tiger:xyz")], b"abc"),
    ]
    rows = [("plain", bytearray(b"".join(records))), ("packed", bytearray(b"".join(map(warc.pack, records)))), ("none", None)]
    got = warc.read(spark.createDataFrame(rows, "archive string, data binary")).collect()
    for archive in ("plain", "packed"):
        r = [(x.record_type, x.payload_bytes, x.url, x.page_id) for x in sorted(got, key=lambda x: (x.begin, x.inner or 0)) if x.archive == archive]
        assert [x[0] for x in r] == ["warcinfo", "request", "response", "revisit", "revisit", "unknown", "resource", "quarantine", "metadata"]
        assert [x[1] for x in r] == [11, 0, 8, None, None, 7, 3, None, 3] and r[2][2] == "http://x/ folded" and {x[3] for x in r} == {None}
    assert {x.payload_digest for x in got if x.record_type == "revisit"} == {sha, None}


def test_warc_table(spark):
    rows = [(3, "u", "<a>"), (1, "u", "<a>"), (2, None, None), (5, "u", ""), (None, "u", "<b>"), (1, "u", "<a>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = warc.read(warc.write(pages)).collect()
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in got) == [("1", "response", "None"), ("1", "response", "None"), ("2", "response", "None"), ("3", "revisit", "1"), ("5", "revisit", "2"), ("None", "response", "None")]
    assert warc.read(warc.write(pages.limit(0))).count() == 0
    long = spark.createDataFrame([(1, "u" * 70_000, "é" * 3_000_000, "x"), (2, "u", "é" * 3_000_000, "y")], "page_id bigint, url string, html string, record_type string")
    got = sorted(warc.read(warc.write(long, archive_bytes=1)).collect())
    assert {(r.page_id, r.payload_bytes, r.record_type, len(r.payload)) for r in got} == {(1, 6_000_000, "response", 6_000_000), (2, 6_000_000, "revisit", 0)}


@pytest.mark.parametrize("name", ["op4_benchmark_decontamination", "op9_warc_salvage"])
def test_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1024, 1025])
def test_permutation(n):
    assert sorted(order.permute(np.arange(n), n, 9).tolist()) == list(range(n))


def test_training_order(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    shards = order.materialise(awkward(spark), path, key=4, length=32, per_shard=8)
    got = order.read(shards, length=32).collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    texts = {}
    for r in got:
        if r.doc_id not in (None, 6):
            texts.setdefault(r.doc_id, {})[r.piece] = r.ids
    for r in awkward(spark).filter("doc_id != 6").collect():
        ids = np.frombuffer(b"".join(texts[r.doc_id][p] for p in sorted(texts[r.doc_id])), "<u2").tolist()
        assert ids == [*tokens.byte_ids(path).encode_ordinary(r.text or ""), 50_256]
    again = {(r.slot, r.doc_id, r.piece) for r in order.read(shards, length=32, start=13).collect()}
    assert again == {(r.slot, r.doc_id, r.piece) for r in got if r.slot >= 13}
    assert order.materialise(empty(spark), path, key=4).count() == 0


def test_quality_learns(spark):
    got = queries.op1_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.selected == (r.quality == 1) for r in got) >= 0.95 * len(got)
    assert quality.grade_documents(awkward(spark), labels(spark), F.col("quality")).count() == 15
    assert quality.grade_documents(awkward(spark), labels(spark).limit(0), F.col("quality")).filter("not selected").count() == 0
    assert quality.grade_documents(empty(spark), labels(spark), F.col("quality")).count() == 0


def test_ordinal_probabilities_are_ordered():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 300).tolist()
    m = quality.fit([np.array([k, 5], np.int32) for k in y], [np.array([1.0, rng.random()], np.float32) for _ in y], y)
    assert (np.diff(m.thresholds) > 0).all() and m.weights[0] < m.weights[1] < m.weights[2]
    assert np.allclose(m.probabilities(np.array([-1.0, 0.0, 3.0])).sum(axis=1), 1)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(now[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def test_automaton_brute_force():
    rng = random.Random(7)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 7))) for _ in range(2))
        for n in (1, 2):
            m = toxicity.Automaton(a, n)
            state = m.start()
            for c in b:
                state = m.step(state, c)
            assert m.accepts(state) == (edit_distance(a, b) <= n), (a, b, n)


def swapped_distance(a, b):
    """Edits where two neighbours in the wrong order are one."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_automaton_with_swaps_brute_force():
    rng = random.Random(17)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 7))) for _ in range(2))
        for n in (1, 2):
            m = toxicity.Automaton(a, n, swaps=True)
            state = m.start()
            for c in b:
                state = m.step(state, c)
            want = swapped_distance(a, b)
            assert m.accepts(state) == (want <= n) and (want > n or m.distance(state) == want), (a, b, n)


def test_near_terms_brute_force():
    terms = ["scum", "idiot", "moron", "bastard", "worthless", "disgusting"]
    lexicon = toxicity.Lexicon(terms)
    rng = random.Random(19)
    for _ in range(6000):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(w))
            w[at : at + 2] = rng.choice(([*w[at : at + 2]][::-1], [], [rng.choice("abcdest"), *w[at + 1 : at + 2]], [rng.choice("abcdest"), *w[at : at + 2]]))
            if not w:
                break
        w = "".join(w)
        d = {t: swapped_distance(t, w) for t in terms}
        one = any(n <= 1 for t, n in d.items() if len(t) > 4) or d["scum"] <= 1 and len(w) >= 4 and w[0] == "s"
        two = any(n <= 2 and any(p in w for p in (t[: len(t) // 3], t[len(t) // 3 : 2 * len(t) // 3], t[2 * len(t) // 3 :])) for t, n in d.items() if len(t) >= 9)
        if one or two or min(d.values()) > 2:
            assert lexicon.near(w) == (one or two), w


def test_misspellings_and_quotations():
    lexicon = toxicity.Lexicon(["idiot", "scum", "scum*", "moron", "x" * 60], ["idiom"])
    kinds = {w: lexicon.kind(w) for w in "idiot idoit iidot id1ot idiooooot idiom scumbags skum scumm scam sum kscum scu m0ron".split()}
    assert kinds == {"idiot": 1, "idoit": 2, "iidot": 2, "id1ot": 2, "idiooooot": 2, "idiom": 0, "scumbags": 1, "skum": 2, "scumm": 1, "scam": 2, "sum": 0, "kscum": 0, "scu": 0, "m0ron": 2}
    assert lexicon.kind("x" * 60) == 1 and lexicon.kind("y" + "x" * 59) == 2 and lexicon.kind("z" * 1_000_000) == 0

    def quoted(text):
        got = lexicon.hits(text).tolist()
        assert sum(got) == 1, text
        return got[2] == 1

    for text in ('"you are an idiot"', "“you idiot”", "„du idiot“ rief er", "« un idiot » cria-t-il", "»du idiot«", "‘you idiot’ she shouted", 'so: ("idiot")', "they called me an idiot"):
        assert quoted(text), text
    for text in ("you’re an idiot, aren’t you", "the dogs’ idiot, isn’t it", '"hello" you idiot, "bye"', "you idiot", '"a b c d e f g h" idiot', "rock ’n’ roll idiot"):
        assert not quoted(text), text


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i // 40}", "z") for i in range(120)], "doc_id bigint, text string, y string")
    known = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] * 2 + [(3, 9, 9)], LABELS)
    got = [labelled.training_rows(d, known, F.col("quality"), 10, Tables(spark, "t")).collect() for d in (docs, docs.repartition(7), docs.union(docs))]
    assert len(got[0]) == 10 and {r.text for r in got[0]} == {"text 0"} and len({r.doc_id for r in got[0]}) == 10
    assert set(got[0]) == set(got[1]) == set(got[2])


def test_empty_and_tied_toxicity(spark):
    docs = awkward(spark)
    assert toxicity.score(docs.limit(0), labels(spark)).count() == toxicity.score(docs.limit(0), labels(spark).limit(0)).count() == 0
    of = {}
    for r in toxicity.score(docs.union(docs), labels(spark)).collect():
        of.setdefault((r.doc_id, r.exact_abuse), set()).add(r.score)
    assert all(len(v) == 1 for v in of.values())


def test_toxicity(spark):
    lexicon = toxicity.Lexicon(["moron", "worthless", "lowe*"])
    assert lexicon.hits("You moron, m0ron and moronn! lowest lowe").tolist() == [2, 2, 0, 0]
    assert lexicon.hits('he said "moron" once').tolist() == [0, 0, 1, 0] and lexicon.hits("wortless x").tolist() == [0, 1, 0, 0]
    got = queries.op2_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.93 * len(got)
    got = queries.op2_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out").collect()
    toxic, clean = [r for r in got if r.toxic == 1], [r for r in got if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic) and sum(r.predicted for r in clean) <= 0.01 * len(clean)
    assert toxicity.score(awkward(spark), labels(spark)).count() == 15 and toxicity.score(awkward(spark), labels(spark).limit(0)).count() == 15
    assert toxicity.score(empty(spark), labels(spark)).count() == 0


def test_language_model(spark):
    p = language_model.unflat(language_model.flat(language_model.initial()))
    ids = np.array([language_model.SIZE] * 3 + [5, 6, 7] + [language_model.SIZE] * 3, np.int32)
    total = 0.0
    for i in range(language_model.SIZE):
        ids[4] = i
        total += np.exp(language_model.log_probabilities(p, ids, np.array([4])))[0]
    assert abs(total - 1) < 1e-3
    got = {r.doc_id: r for r in language_model.score(awkward(spark)).collect()}
    assert len(got) == 14 and got[0].n_tokens == 0 and got[0].mean_log_probability is None and got[6].mean_log_probability < 0
    assert language_model.score(empty(spark)).count() == 0


def test_language_model_gives_probabilities_of_words(spark):
    words = [f"w{i}" for i in range(5000)]
    rows = [(i, w, None, None, None, None, None) for i, w in enumerate(words)] + [(5000 + i, words[i % 50], None, None, None, None, None) for i in range(700)]
    docs = spark.createDataFrame(rows, DOCS)
    for bases in (language_model.BASES, (16,)):  # all words have ids; at most 3,641 of them have
        got = {r.doc_id: r.pseudo_log_likelihood for r in language_model.score(docs, bases=bases).collect()}
        assert abs(sum(np.exp(got[i]) for i in range(5000)) - 1) < 1e-3
    counts = language_model.counted(docs.select("text"), language_model.Tables(spark, "words"))
    base, own, n = language_model.vocabulary(counts, (16,))
    rest = {r.word: r for r in language_model.sharing(counts, base, len(own), n[-1]).collect()}
    assert own and set(own) | set(rest) == set(words) and not set(own) & set(rest)
    assert all(r.id == language_model.shared_id(w, len(own), base**3) for w, r in rest.items())
    assert language_model.vocabulary(counts)[0] == 32 and len(language_model.vocabulary(counts)[1]) == 5000


def test_every_place_is_learned_from_once():
    texts = [[], [1], [2, 3], list(range(4, 4 + 501)), [7]]
    codes = pa.array([np.array(t, np.int32).tobytes() for t in texts], pa.binary())
    for rounds in (1, 2, 3):
        for part in (slice(0, 5), slice(2, 5)):  # batches do not matter
            got, sizes = language_model._joined(codes[part], language_model.SIZE)
            took = [language_model.masked(pa.array([None, 1, 2, 3, 9])[part], sizes, r, rounds) for r in range(rounds)]
            assert np.array_equal(np.sort(np.concatenate(took)), np.flatnonzero(got != language_model.SIZE))
            last = next(r for r in range(rounds) if np.isin(len(got) - 4, took[r]))
            assert last == 9 % rounds


def test_a_round_fetches_little_beside_its_places():
    rng = np.random.default_rng(6)
    codes = pa.array([rng.integers(0, language_model.SIZE, n).astype(np.int32).tobytes() for n in (700, 0, 3, 1500, 64, 65)], pa.binary())
    got, sizes = language_model._joined(codes, language_model.SIZE)
    for r in range(2):
        at = language_model.masked(pa.array([1, 2, 3, 4, None, 6]), sizes, r, 2)
        assert np.mean(np.diff(at) == 1) > 0.95
        ids, mine = language_model._around(got, at)
        assert len(ids) < 1.2 * len(at) and np.array_equal(ids[mine], got[at])
        p, q = language_model.initial(), language_model.initial()
        for x, words, places in ((p, got, at), (q, ids, mine)):
            square = {k: np.full(s, 0.1, np.float32) for k, s in language_model.SHAPES.items()}
            for i in range(0, len(at), 300):
                language_model.learn(x, square, words, places[i : i + 300])
        assert all(np.allclose(p[k], q[k], atol=1e-5) for k in p) and not np.allclose(p["E"], language_model.initial()["E"], atol=1e-2)


def test_words_are_counted_and_have_ids_as_python_splits_them():
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    texts = [f"A{c}B" for c in every[:0x3100]] + [every, every.upper(), None, "", " \n", "  \u03a3\u0391\u03a3 \u0130x\x1f\x85 b "]
    words = [(t or "").lower().split() for t in texts]
    flat = [w for x in words for w in x]
    got, sizes = language_model._words(pa.array(texts))
    assert got.to_pylist() == flat and sizes.tolist() == [len(x) for x in words]
    rows = pa.array(range(len(texts)), pa.int64())
    batches = [pa.RecordBatch.from_arrays([rows, rows, pa.array(texts)], ["row", "doc_id", "text"])[i : i + 5000] for i in range(0, len(texts), 5000)]
    counts = Counter()
    for b in language_model._count(b.select(["text"]) for b in batches):
        counts.update(dict(zip(b["word"].to_pylist(), b["n"].to_pylist(), strict=True)))
    assert counts == Counter(flat)
    for own in ([w for w, _ in counts.most_common(3000)], []):
        place = {w: i for i, w in enumerate(own)}
        out = pa.Table.from_batches(language_model._encode(iter(batches), SimpleNamespace(value=own), language_model.SIZE)).to_pylist()
        for r, x in zip(out, words, strict=True):
            assert np.frombuffer(r["ids"], np.int32).tolist() == [place.get(w, language_model.shared_id(w, len(own), language_model.SIZE)) for w in x]
            assert r["rare"] == [w for w in x if w not in place]


def test_changes_of_many_partitions_add_up_in_small_batches():
    rng = np.random.default_rng(5)
    base, n = 64, sum(int(np.prod(x)) for x in language_model.shapes(64).values()) // language_model.DIM
    sent, w, x = [], np.zeros(n), np.zeros((n, language_model.DIM))
    for _ in range(2):
        k = np.sort(rng.choice(n, n // 2, replace=False)).astype(np.int32)
        some = rng.integers(1, 9, len(k)).astype(np.float64), rng.normal(size=(len(k), language_model.DIM)).astype(np.float32)
        w[k] += some[0]
        x[k] += some[1]
        sent += language_model._sliced(k, *some)
    rows = sum(b.num_rows for b in sent)
    assert sum(b.nbytes for b in sent) / rows * 512 < 16 << 20  # an Arrow batch has up to 512 rows, one from each of many partitions
    got_w, got_x = np.zeros(n), np.zeros((n, language_model.DIM))
    for b in language_model._sum(iter(sent), base):
        for r in b.to_pylist():
            k = np.frombuffer(r["k"], np.int32)
            got_w[k] += np.frombuffer(r["w"])
            got_x[k] += np.frombuffer(r["x"], np.float32).reshape(-1, language_model.DIM)
    assert np.array_equal(got_w, w) and np.allclose(got_x, x, atol=1e-5)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(3)
    body = np.tile(np.array([10, 20, 30, 40], np.int32), 400)
    ids = np.r_[[language_model.SIZE] * 3, body, [language_model.SIZE] * 3].astype(np.int32)
    p = language_model.initial()
    square = {k: np.full(s, 0.1, np.float32) for k, s in language_model.SHAPES.items()}
    at = np.arange(3, 3 + len(body))
    before = language_model.log_probabilities(p, ids, at).mean()
    for _ in range(30):
        language_model.learn(p, square, ids, rng.choice(at, 256))
    assert language_model.log_probabilities(p, ids, at).mean() > before + 2


def test_tail_crc():
    assert media.tail_crc(b"x" * 40) == zlib.crc32(b"x" * 16)


def test_near_duplicates_of_repeated_ids(spark):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(words)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((i % 7, " ".join(w)))
    rows += [(50, "other words of one document that stands alone here"), (50, "and another text of it"), (51, "and another text of it")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), k=4, block=8).collect()
    # one node an id: links of any of its texts are its links
    sets = {}
    for i, t in rows:
        w = t.split()
        sets.setdefault(i, []).append({tuple(w[j : j + 4]) for j in range(len(w) - 3)})
    root = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if any(100 * len(x & y) >= 80 * len(x | y) for x in sets[i] for y in sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    assert len(got) == len(rows) and all(r.component_id == root[r.doc_id] for r in got)


def test_near_duplicates_equal_brute_force_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op3_minhash_near_dedup(spark, "/root/testdata/sf0.01").collect()}
    texts = {r.doc_id: re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "") for r in docs.collect()}
    sets, of = {}, {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[i] = {hash(tuple(w[j : j + 4])) for j in range(max(1, len(w) - 3))} if w else set()
        for x in sets[i]:
            of.setdefault(x, []).append(i)
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, mine in sets.items():
        shared = {}
        for x in mine:
            for j in of[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= 80 * (len(mine) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    assert got == {i: (len(s), top(i)) for i, s in sets.items()}


def test_training_order_hangs_on_key_and_rows_only(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = awkward(spark).union(awkward(spark)).union(spark.createDataFrame([(9, "again and again", None, None, None, None, None)] * 700, DOCS))
    once = {}
    for n in (1, 5):
        got = order.read(order.materialise(docs.repartition(n), path, key=4, length=32, per_shard=8), length=32).collect()
        once[n] = sorted((r.slot, str(r.doc_id), r.piece, bytes(r.ids)) for r in got)
    assert once[1] == once[5] and [x[0] for x in once[1]] == list(range(len(once[1])))
    other = order.read(order.materialise(docs, path, key=5, length=32, per_shard=8), length=32).collect()
    assert sum((r.slot, str(r.doc_id), r.piece, bytes(r.ids)) in set(once[1]) for r in other) < 0.6 * len(other)


def test_training_order_query_decodes(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = order.read(order.materialise(docs, path, key=20_240_601)).collect()
    of = {}
    for r in got:
        of.setdefault(r.doc_id, {})[r.piece] = np.frombuffer(r.ids, "<u2").tolist()
    t: tiktoken.Encoding = tokens.byte_ids(path)
    for r in docs.collect():
        ids = [x for p in sorted(of[r.doc_id]) for x in of[r.doc_id][p]]
        assert ids[-1] == 50_256 and t.decode(ids[:-1]) == (r.text or "")
    q = {(r.doc_id, r.piece): r for r in queries.op10_training_order(spark, SF).collect()}
    assert len(q) == len(got) and all(q[r.doc_id, r.piece].slot == r.slot and q[r.doc_id, r.piece].ids_crc32 == zlib.crc32(r.ids) for r in got)


def test_packing_query_contract(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    got = {}
    for r in queries.op5_best_fit_packing(spark, SF).collect():
        got.setdefault(r.doc_id, {})[r.piece] = r
    lengths, placed = [], {}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = [*t.encode(d.text or "", add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), 2048)):
            r, part = got[d.doc_id].pop(p), ids[at : at + 2048]
            assert (r.start, r.length, r.ids_crc32) == (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
            lengths.append(len(part))
            placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert not any(got.values())
    for s in placed.values():
        assert [o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 2048
    assert len(placed) == sequential_best_fit(lengths, 2048)


def test_packing_keeps_clashing_columns_and_splits_equal_rows(spark):
    rows = spark.createDataFrame([(None, None, 3, "p", i, "s") for i in range(4000)], "doc_id bigint, piece int, length bigint, part string, nth int, sequence_id string")
    got = packing.pack(rows, 9, partitions=8)
    assert sorted(r.nth for r in got.collect()) == list(range(4000)) and got.filter("part = 'p'").count() == 4000
    assert got.select("sequence_id").distinct().count() == 1334


def test_media_query_contract(spark):
    import hashlib

    got = {r.doc_id: r for r in queries.op6_media_columns(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        raw = (d.text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = got[d.doc_id]
        wav = media.encode(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest())


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from pagemere.llm import common

    sc = SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda *_: None), master="spark://x:7077", applicationId="x")
    with pytest.raises(RuntimeError):
        common.shared_dir(SimpleNamespace(sparkContext=sc))


def test_quality_query_equals_its_model(spark):
    docs, known = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    m = quality.train(docs, known, quality.ratings())
    got = {r.doc_id: r for r in queries.op1_quality_classifier(spark, SF).collect()}
    for d in docs.collect():
        idx, val = quality.features(d.text)
        s = sum(float(v) * m.weights[i] for i, v in zip(idx, val, strict=True))
        below = [0.0, *(1 / (1 + np.exp(-(t - s))) for t in m.thresholds), 1.0]
        p = np.diff(below)
        r = got[d.doc_id]
        assert abs(r.expected_grade - sum(g * x for g, x in zip(m.grades, p, strict=True))) < 1e-4
        assert abs(r.tail_probability - sum(x for g, x in zip(m.grades, p, strict=True) if g >= 1)) < 1e-4 and r.selected == (r.tail_probability >= 0.5)
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0)


def test_toxicity_query_equals_brute_force(spark):
    docs, known = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.train(docs, known)
    words, stems, ordinary = [t for t in m.terms if not t.endswith("*")], [t[:-1] for t in m.terms if t.endswith("*")], set(m.ordinary)
    seen = {}

    def kind(w):
        def exact(x):
            return x in words or any(x.startswith(s) and len(x) > len(s) for s in stems)

        def near(x):
            for t in words:
                most = 0 if len(t) < 4 or len(x) < 4 or abs(len(t) - len(x)) > 2 else 1 if len(t) < 9 else 2
                if most and (len(t) > 4 or x[0] == t[0]) and (n := swapped_distance(t, x)) <= most and (n < 2 or any(p in x for p in (t[: len(t) // 3], t[len(t) // 3 : 2 * len(t) // 3], t[2 * len(t) // 3 :]))):
                    return True
            return False

        if w not in seen:
            forms = {w.translate(toxicity._LEET), re.sub(r"(.)\1{2,}", r"\1", w.translate(toxicity._LEET))}
            seen[w] = 1 if exact(w) else 0 if len(w) < 4 or w in ordinary else 2 if any(f != w and exact(f) or near(f) for f in forms) else 0
        return seen[w]

    got = {r.doc_id: r for r in queries.op2_toxicity(spark, SF).collect()}
    for d in docs.filter("length(text) < 3000").collect():
        kinds = [kind(w) for w in re.findall(r"[\w@$]+", (d.text or "").lower())]
        r = got[d.doc_id]
        assert (r.exact_abuse + r.exact_quoted, r.near_abuse + r.near_quoted) == (kinds.count(1), kinds.count(2)), d.doc_id
        z = m.weights[0] + sum(w * np.log1p(n) for w, n in zip(m.weights[1:], (r.exact_abuse, r.near_abuse, r.exact_quoted, r.near_quoted), strict=True))
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9 and r.predicted == (r.score >= 0.5)


def test_pseudo_likelihood_equals_a_slow_loop(spark):
    rng = random.Random(31)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["owl", "moon", "night", "river", "a", "b"]) for _ in range(rng.randrange(0, 9)))) for i in range(40)], "doc_id bigint, text string")
    encoded, _, base, shared, params = language_model.train(docs)
    p = language_model.unflat(params.value, base)
    rows = encoded.select("row", "doc_id", "ids").toArrow()
    got = {i: x for b in rows.to_batches() for out in language_model._score(iter([b]), params, shared, base) for i, x in zip(out["doc_id"].to_pylist(), out["by_id"].to_pylist(), strict=True)}

    def soft(z):
        e = np.exp(z - z.max())
        return e / e.sum()

    for i, raw in zip(rows["doc_id"].to_pylist(), rows["ids"].to_pylist(), strict=True):
        ids, total = np.frombuffer(raw, np.int32).tolist(), 0.0
        for n, w in enumerate(ids):
            h = p["c"].astype(float).copy()
            for k, o in enumerate(language_model.OFFSETS):
                h += p["d"][k] * p["E"][ids[n + o] if 0 <= n + o < len(ids) else base**3]
            h = np.tanh(h)
            a, b, c = w // base**2, w // base % base, w % base
            total += np.log(soft(h @ p["A"] + p["a"])[a] * soft(h @ p["B"] + p["b"][a])[b] * soft(h @ p["G"] + p["g"][a * base + b])[c]) - shared.value[w]
        assert abs(total - got[i]) < 1e-3 * max(1, len(ids)), i


def test_model_beats_a_unigram(spark):
    rng = random.Random(33)
    after = {w: rng.sample(range(60), 4) for w in range(60)}  # each word has four that follow it

    def text():
        w = [rng.randrange(60)]
        while len(w) < 120:
            w.append(rng.choice(after[w[-1]]))
        return " ".join(f"w{x}" for x in w)

    docs = spark.createDataFrame([(i, text()) for i in range(400)], "doc_id bigint, text string")
    counts = dict(docs.select(F.explode(F.split("text", " ")).alias("w")).groupBy("w").count().collect())
    n = sum(counts.values())
    unigram = sum(c * np.log(c / n) for c in counts.values()) / n
    got = language_model.score(docs).agg(F.sum("pseudo_log_likelihood") / F.sum("n_tokens")).first()[0]
    assert got > unigram + 0.2

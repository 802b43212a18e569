"""Spelling variants, tokenizer alignment and chat formatting against brute force, and on awkward rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from pagemere.llm import alignment, chat, queries, spelling
from tests.oracle import SF

DOCS = "doc_id bigint, text string, word string, n bigint, chunk int, key string"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def awkward(spark):
    rng = random.Random(3)
    long = " ".join(rng.choice("harbour harbor harbours lantern lanterns lanternn".split()) for _ in range(60_000))
    texts = [None, "", "   ", "harbour", "Harbour harbour HARBOUR", long, long, long + " end", "café 你好 Σ mixed <|endoftext|> <s> ½ﬁ", "a▁b", "tab\tnew\nline\r\n  two  blanks ", "ÀÉÎ÷× ÿÿÿÿÿÿ", " lead", "\x1c\x1d odd \x85 \xa0"]
    return spark.createDataFrame([(i, t, "w", 1, 2, "k") for i, t in enumerate(texts)] + [(None, "harbor " * 9, None, None, None, None), (5, long, "w", 1, 1, "k")], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def brute_variants(rows, length=6, times=5, ratio=5):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= length and n >= times}
    letters = sorted({c for w in words for c in w})
    near = {}
    for w in words:
        cut = {w[:i] + w[i + 1 :] for i in range(len(w))}
        put = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        new = {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        near[w] = (cut | put | new) & words.keys() - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def as_words(df):
    got = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len({r[0] for r in got})
    return {r[0]: r[1:] for r in got}


def test_spelling_query_equals_brute_force(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
        want = brute_variants(rows)
        assert as_words(queries.op11_spelling_variants(spark, sf)) == want
    assert any(v[0] for v in want.values())


def test_spelling_made_up_words(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        w = "".join(rng.choice("aaabé") for _ in range(rng.randrange(5, 9)))
        rows.append((i, " ".join([w.upper()] * rng.choice((1, 5, 30, 200)))))
    got = as_words(spelling.variants(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert got == brute_variants(rows)
    assert any(v[0] and v[1] != v[0] for v in got.values()), "some form has a form"


def test_spelling_damage_that_gives_another_damaged_run(spark):
    """What is left of one damaged run is itself a run of the document that is damaged: each loses one character."""
    pairs = ((f"{'lantern'}{a}{b}", f"{'lantern'}{b}") for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz")
    crc = lambda i, r: zlib.crc32(f"{i}:{r}".encode())
    i, one, two = next((i, a, b) for a, b in pairs for i in range(60_000) if crc(i, a) % 199 == 0 and crc(i, b) % 199 == 0 and crc(i, a) % len(a) == 7)
    rows = [(i, " ".join([one] * 6 + [two] * 40)), (None, " ".join([two] * 5))]
    got = as_words(spelling.variants(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert got == brute_variants(rows)
    assert got[two][2] == 11


def test_spelling_awkward(spark):
    docs = awkward(spark)
    assert as_words(spelling.variants(docs)) == brute_variants([(r.doc_id, r.text) for r in docs.collect()])
    assert spelling.variants(empty(spark)).collect() == []


def test_deletion_keys_are_the_hashes_of_the_deletions():
    rng = random.Random(2)
    for size in (1, 2, 7, 40):
        same = ["".join(rng.choice("abÿé") for _ in range(size)) for _ in range(50)]
        keys = spelling.deletion_keys(same)
        for w, k in zip(same, keys):
            assert k[0] == spelling.deletion_keys([w])[0, 0]
            for i in range(size):
                if size > 1:
                    assert k[i + 1] == spelling.deletion_keys([w[:i] + w[i + 1 :]])[0, 0]


def test_colliding_keys_are_no_links():
    out = []
    spelling._run([(0, "xabcdef", 9), (0, "yabcdef", 3), (2, "another", 5), (-1, "abcdef", 7)], out)
    assert sorted(out) == sorted([("xabcdef", 1, 3, "yabcdef"), ("yabcdef", 1, 9, "xabcdef"), ("abcdef", 2, 9, "xabcdef"), ("xabcdef", 1, 7, "abcdef"), ("yabcdef", 1, 7, "abcdef")])


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    t, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    ranks = {}
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        for x, i in map(bytes.split, f):
            ranks[int(i)] = base64.b64decode(x)

    def bytes_b(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    docs, links, holds = [], [], Counter()
    for doc_id, text in rows:
        a = b = []
        if text:
            raw = (" " + text).encode()
            a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            if b"".join(ranks[i] for i in a) != raw or b"".join(map(bytes_b, b)) != raw:
                a = b = []
        spans = []
        for ids, of in ((a, ranks.__getitem__), (b, bytes_b)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(of(i)), i))
                at = own[-1][1]
            spans.append(own)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, own = [], [iter(x) for x in spans]
        for e in ends:
            sides = []
            for it in own:
                ids = []
                for _, stop, i in it:
                    ids.append(str(i))
                    if stop == e:
                        break
                sides.append(",".join(ids))
            groups.append("|".join(sides))
        here, j = [], 0
        for s, e, i in spans[0]:
            while j and spans[1][j][0] > s:
                j -= 1
            while j < len(spans[1]) and spans[1][j][0] < e:
                if spans[1][j][1] > s:
                    here.append((i, spans[1][j][2]))
                j += 1
            j = max(0, j - 1)
        holds.update(set(here))
        links.append(here)
        docs.append((doc_id, len(a), len(b), len(groups), len(here), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    top = defaultdict(int)
    for (i, _), n in holds.items():
        top[i] = max(top[i], n)
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted(((*d[:5], sum(holds[x] == top[x[0]] for x in here), sum(holds[x] for x in here), d[5]) for d, here in zip(docs, links)), key=key)


def as_alignment(df):
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=key)


def test_alignment_query_equals_brute_force(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
        want = brute_alignment(rows)
        assert as_alignment(queries.op12_tokenizer_alignment(spark, sf)) == want
    assert sum(r[5] for r in want) > 0


def test_alignment_awkward_broadcast_or_not(spark, monkeypatch):
    docs = awkward(spark)
    want = brute_alignment([(r.doc_id, r.text) for r in docs.collect()])
    assert as_alignment(alignment.linked(docs, A, B)) == want
    assert as_alignment(alignment.linked(docs, A, B, limit=0)) == want
    zero = {r[0] for r in want if not r[1]}
    assert {0, 1, 9} <= zero
    for limit in (0, 1 << 20):
        assert alignment.linked(empty(spark), A, B, limit=limit).collect() == []


def test_cached_pieces_equal_whole_texts(monkeypatch):
    rng = random.Random(4)
    a, b = alignment.ByteLevel(A), alignment.Pieces(B)
    letters = "aab  \n\t.,'s1²é÷\xa0\x85<|endoftext|></s>I'll "
    monkeypatch.setattr(alignment, "KEPT", 500)
    for _ in range(60):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))) for _ in range(50)]
        for e in (a, b):
            for text, got, whole in zip(texts, e(texts), e.encode([" " + t for t in texts])):
                assert got is not None and got.tolist() == whole, repr(text)
    assert [x is None for x in b(["a▁b", "plain", "▁", "x"])] == [True, False, True, False]


def test_windows_equal_one_window():
    rng = np.random.default_rng(0)
    total = 5000
    for _ in range(20):
        la, lb = (np.diff(np.concatenate(([0], np.sort(rng.choice(np.arange(1, total), size=n, replace=False)), [total]))) for n in (900, 700))
        for x, y in zip(alignment.align(la, lb, span=100), alignment.align(la, lb, span=total)):
            assert x.tolist() == y.tolist()


def brute_chat(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda r: r[:3])
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        learned = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def as_chat(df):
    got = df.collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got}


HARD = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def test_chat_query_equals_brute_force(spark, monkeypatch):
    for sf in (SF, "/root/testdata/sf0.01"):
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        assert as_chat(queries.op13_chat_format(spark, sf)) == brute_chat(rows + HARD)


def chats(spark):
    rng = random.Random(6)
    bits = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<|", "|>", "<|/|>", "\\", "<", "[", "|", "/", " ", "\n", "ok", "é你", "INST]", "s>"]
    rows = [(1, None, None, None), (1, 0, "user", ""), (2, 3, "assistant", None), (None, 1, "user", "no id"), (None, 0, "assistant", "x" * 3_000_000), (7, 1, "tool|>", "<|tool|>"), (7, 2, "", "<|/|>"), (7, 2, "a", "tie"), (7, 2, "a", "tie")]
    rows += [(10 + i % 90, i, rng.choice(["user", "assistant", "system", "tool", "</s>", "\\"]), "".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for i in range(4000)]
    rows += [(500, i, "assistant" if i % 2 else "user", f"hot {i} </s>" * 20) for i in range(6000)]
    return spark.createDataFrame([(*r, "p") for r in rows], "conv_id bigint, turn bigint, role string, text string, part string")


def test_chat_awkward_and_hot(spark, monkeypatch):
    c = chats(spark)
    rows = [tuple(r)[:4] for r in c.collect()]
    formatted = chat.format_conversations(c)
    assert as_chat(chat.read(formatted)) == brute_chat(rows)
    assert formatted.filter("conv_id = 500").count() > 1
    sizes = {r.conv_id: r.n for r in formatted.groupBy("conv_id").agg(F.sum(F.length("formatted")).alias("n")).collect()}
    assert sizes == {r.conv_id: r.formatted_chars for r in chat.read(formatted).collect()}
    assert chat.read(chat.format_conversations(c.limit(0))).collect() == []


def test_turns_come_back_with_as_little_escaped_as_does_it():
    t = chat.LLAMA
    rng = random.Random(1)
    assert t.render("user", "plain [text] <b>")[0] == "[INST] plain [text] <b> [/INST]"
    assert t.render("user", "</s>")[0] == "[INST] <\\/s> [/INST]"
    assert t.render("assistant", "<\\/s>")[0] == "<s> <\\\\/s> </s>"
    many = [(rng.choice(["user", "assistant", "system", "x|>", "<|"]), "".join(rng.choice("<[|\\/s>INST] \n") for _ in range(rng.randrange(9)))) for _ in range(3000)]
    text = "".join(t.render(*x)[0] for x in many)
    assert [x[:2] for x in t.parse(text)] == many
    bare = chat.Template(roles={"user": ("<u>", "</u>"), "assistant": ("<a>", "</a>")}, other=("<(", ")>", "</>"))
    assert [x[:2] for x in bare.parse("".join(bare.render(*x)[0] for x in many))] == many


def test_the_parser_refuses_what_it_did_not_write():
    for bad in ("x", "[INST] a", "[INST] a </s>", "<s> a [INST] b </s>", "<|user|> a <|/|>", "<|x", "[INST] a[/INST]"):
        with pytest.raises(ValueError):
            chat.LLAMA.parse(bad)
    with pytest.raises(ValueError):
        chat.Template(roles={"user": ("\\", "x")})

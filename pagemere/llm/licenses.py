"""License scan: exact phrases, and short notices with a few edits.

Words are compared as lower-cased UTF-8, one blank between them.  Base labels come from places where a phrase's
words stand consecutively.  Notices are searched with up to ``edits`` errors: each is cut into edits + 1 pieces,
one of which must stand unchanged (pigeonhole); pieces are found by one automaton over the text.  Each piece found
implies one small window, whose bounded-error matching by the regex library verifies the place and gives its span and
number of edits; equal windows are matched once, so the time grows with the text's length.  A match begins and ends
at a word, and the words that tell one license from another (``TELLING``) must stand unchanged.  Of matches of one
notice that overlap the one with the fewest edits stands, then the first, then the longest.  Notices add the labels
of their kind.

The score is 1 where a base phrase stands; else 1 - edits / (edits allowed + 1) of the best notice; else 0.

Defined results: null, empty and wordless texts have no labels and a score of 0; repeated places count each, and
notices that match at one place (ties) are all given; repeated rows are rows of their own; texts of any length are
read whole; columns other than doc_id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_workers

#: Base phrases with their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Short notices, in the words' normal form, with the label each adds.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this work is licensed under the creative commons attribution": "cc-by",
    "subject to the terms of the mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "under the terms of the gnu general public license": "gpl",
    "released under the mit license": "mit",
    "licensed under the gnu general public license": "gpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
#: Names and version numbers; an edit in one makes another license of it.
TELLING = frozenset("mit gnu bsd isc apache mozilla creative commons public domain 2 0".split())
EDITS = 3

_BLANKS = bytes(c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_BLANKS).split()


def _edits(notice: str, edits: int) -> int:
    """Short notices allow fewer: one for each ten letters."""
    return max(1, min(edits, len(notice) // 10))


def _rule(notice: str, edits: int) -> str:
    """The notice between two blanks: runs of common words with errors, telling words without."""
    runs: list[tuple[bool, list[str]]] = []
    for w in notice.split():
        exact = w in TELLING
        if not runs or runs[-1][0] != exact:
            runs.append((exact, []))
        runs[-1][1].append(w)
    out = [" ".join(ws) if exact else f"(?:{' '.join(ws)}){{e<={edits}}}" for exact, ws in runs]
    return "(?<= )" + " ".join(out) + "(?= )"


@cache
def _search(edits: int):
    import ahocorasick
    import regex

    seeds: dict[str, list[tuple[int, int]]] = {}
    rules = []
    for k, (notice, label) in enumerate(NOTICES.items()):
        e = _edits(notice, edits)
        size = len(notice)
        cuts = [size * i // (e + 1) for i in range(e + 2)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            seeds.setdefault(notice[a:b], []).append((k, a))
        rules.append((label, size, e, regex.compile(_rule(notice, e), regex.BESTMATCH)))
    find = ahocorasick.Automaton()
    for s, spots in seeds.items():
        find.add_word(s, (len(s), spots))
    find.make_automaton()
    return find, rules


def notices(joined: str, edits: int = EDITS) -> list[tuple[str, int, int, int]]:
    """(label, start, end, edits) of each verified place in a normal form with one character a byte and a blank at either end."""
    find, rules = _search(edits)
    spots: dict[int, set[int]] = {}
    for end, (size, of) in find.iter(joined):
        for k, at in of:
            spots.setdefault(k, set()).add(end + 1 - size - at)
    out = []
    for k, starts in spots.items():
        label, size, e, rule = rules[k]
        seen: dict[str, list[tuple[int, int, int]]] = {}
        found: set[tuple[int, int, int]] = set()
        for start in starts:  # edits before the piece move the start, those after it the end
            low = max(0, start - e - 1)
            window = joined[low : start + size + e + 1]
            if (got := seen.get(window)) is None:
                got = seen[window] = [(sum(m.fuzzy_counts), m.start(), m.end()) for m in rule.finditer(window, overlapped=True) if sum(m.fuzzy_counts) <= e]
                if len(seen) > 4096:
                    seen = {}
            found.update((n, low + a, low + b) for n, a, b in got)
        out += [(label, a, b, n) for n, a, b in _best(sorted(found, key=lambda f: (f[1], f[2])))]
    return sorted(set(out))


def _best(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of spans in the order of their starts those that no better one overlaps: the best of all stands, then the best of the rest."""
    out, i = [], 0
    while i < len(found):  # a chain of spans that overlap
        chain, stop = [found[i]], found[i][2]
        i += 1
        while i < len(found) and found[i][1] < stop:
            chain.append(found[i])
            stop = max(stop, found[i][2])
            i += 1
        taken: list[tuple[int, int]] = []
        for n, a, b in sorted(chain, key=lambda f: (f[0], f[1], -f[2])):
            at = bisect_left(taken, (a, b))
            if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or taken[at][0] >= b):
                taken.insert(at, (a, b))
                out.append((n, a, b))
    return sorted(out, key=lambda f: f[1])


_SCHEMA = "doc_id bigint, n_words bigint, starts array<bigint>, base array<string>, found array<struct<label: string, first: bigint, last: bigint, edits: int>>, score double"
_FOUND = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("edits", pa.int32())]))


def _scan(batches: Iterator[pa.RecordBatch], edits: int) -> Iterator[pa.RecordBatch]:
    phrases = [(f" {p} ", label) for p, label in PHRASES.items()]
    for batch in batches:
        cols: tuple[list, ...] = ([], [], [], [], [])
        for text in batch.column(1):
            ws = words(text.as_py())
            raw = b" " + b" ".join(ws) + b" "
            joined = raw.decode("latin-1")
            ends: list[np.ndarray] = []  # places of blanks, once they are asked for

            def nth(at: int) -> int:
                """Blanks before a place."""
                if not ends:
                    ends.append(np.flatnonzero(np.frombuffer(raw, np.uint8) == 32))
                return int(np.searchsorted(ends[0], at))

            starts, base = [], []
            for p, label in phrases:
                at = joined.find(p)
                while at >= 0:
                    starts.append(nth(at))
                    base.append(label)
                    at = joined.find(p, at + 1)
            found, score = [], 1.0 if starts else 0.0
            for label, a, b, e in notices(joined, edits):
                found.append({"label": label, "first": nth(a) - 1, "last": nth(b) - 1, "edits": e})
                score = max(score, 1 - e / (edits + 1))
            for c, v in zip(cols, (len(ws), starts, base, found, score), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), _FOUND, pa.float64()), strict=True))], ["doc_id", "n_words", "starts", "base", "found", "score"])


def scan(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """docs(doc_id, text): the word places of phrases (starts, base) and of notices (found, with word spans and edits)."""
    on_workers(docs.sparkSession)
    got = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return got.mapInArrow(lambda it: _scan(it, edits), _SCHEMA)

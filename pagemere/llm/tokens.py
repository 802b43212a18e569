"""Tokens of public tokenizers, whose files are parameters; nothing is trained.

``WordIds`` gives the ids of a word-level BPE file in the ``tokenizers`` format whose pre-tokenizer cuts a text
into pieces that are encoded apart.  For texts of Latin-1 characters the pieces are cut here and each piece's
ids are remembered, which is several times faster; any other text, and one holding a special token's string,
goes to the library as a whole.
"""

from __future__ import annotations

import base64
import re
from functools import cache

import numpy as np

#: The Latin-1 letters (lower-cased), numbers and blanks, as the tokenizer file's classes have them.
_L, _N, _S = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", r"\s\x85\xa0"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
_ODD = re.compile(r"[\x1c-\x1f]")
#: Words whose ids a Python worker remembers; some 200 bytes each.
KEPT = 300_000


class WordIds:
    def __init__(self, path: str, most: int = KEPT):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        vocab = self.t.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for w, i in vocab.items():
            self.ends[i] = w.endswith("</w>")
        self.special = [x.content for x in self.t.get_added_tokens_decoder().values()]
        self.most = most
        self.kept: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        """Encodes new pieces in one call, a blank between them, and cuts the ids at the words' ends."""
        for i in range(0, len(new), 200):
            part = new[i : i + 200]
            ids = np.array(self.t.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):
                self.kept.update((w, self.whole(w)) for w in part)
                continue
            raw, at = ids.tobytes(), 0
            for w, stop in zip(part, (stops * 4).tolist(), strict=True):
                self.kept[w] = raw[at:stop]
                at = stop

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole(text)
        if any(x in text for x in self.special) or _ODD.search(text):
            return self.whole(text)
        pieces = _PIECE.findall(text.lower())
        used = set(pieces)
        if new := used.difference(self.kept):
            if len(self.kept) + len(new) > self.most:
                self.kept.clear()
                new = used
            self._learn(list(new))
        return b"".join(map(self.kept.__getitem__, pieces))


@cache
def word_ids(path: str, most: int = KEPT) -> WordIds:
    return WordIds(path, most)


@cache
def byte_ids(path: str):
    """A byte-level BPE from a file of ranks; special tokens' strings are ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

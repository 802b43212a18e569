r"""Chat formatting with a grammar that gives every turn back, and the mask of what is learned.

A template has an opening and a closing string for each role; any other role is written out between ``<|`` and
``|>``.  ``parse`` is a deterministic parser of that grammar.  A turn is rendered, parsed again and compared to its
source.  If it doesn't come back identical, conflicting content is escaped: first the control strings in it, then every
character that a control string begins with.  An escape is a backslash behind such a character; where the text has
backslashes there, one is added, so reading takes one away, whatever was escaped.

Rows are sorted by conversation and turn through ranges, so a conversation of any size is dealt to many tasks, and
written as parts of about ``PART`` characters, cut between turns.  Reading back parses each part where it lies.  Only
conversations of several parts are brought together for their digests, as a sorted stream of parts, never as a group.

Defined results: null texts and roles are empty; rows without a conv_id are one conversation without id; rows without a
turn come first; rows of one turn (ties) are ordered by role, then by hash of the text, then by text, and repeated rows
stay; very long texts are one turn of one part; columns other than conv_id, turn, role and text are not read, so clashing
names do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, small

#: Characters of a part, and bytes of rows that a range of the sort holds on average at most.
PART, RANGE = 1 << 20, 64 << 20
ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Opening and closing strings by role, of two characters at least, without the escape; none begins with a letter."""

    roles: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>")})
    other: tuple[str, str, str] = ("<|", "|> ", " <|/|>")
    learned: str = "assistant"

    def __post_init__(self):
        own = [x for pair in self.roles.values() for x in pair] + [self.other[0], self.other[1], self.other[2]]
        names = sorted({x.strip() for x in own}, key=lambda x: (-len(x), x))
        if any(len(x) < 2 for x in names) or any(ESCAPE in x or x[0].isalnum() for x in names) or len({a for a, _ in self.roles.values()}) < len(self.roles):
            raise ValueError("a template's strings must be distinct, of two characters at least and without the escape")
        first = "".join(sorted({re.escape(x[0]) for x in names}))
        put = lambda **x: [object.__setattr__(self, k, v) for k, v in x.items()]
        tails = "|".join(rf"(?<={re.escape(x[0])}){re.escape(x[1:])}" for x in names)
        put(
            control=re.compile("|".join(map(re.escape, names))),
            opening=sorted(((a, role) for role, (a, _) in self.roles.items()), key=lambda x: (-len(x[0]), x)),
            escaped=re.compile(rf"([{first}]){re.escape(ESCAPE)}({re.escape(ESCAPE)}*)"),
            levels=(None, re.compile(rf"([{first}])(?=\\|{tails})"), re.compile(rf"([{first}])")),
        )

    def unescape(self, content: str) -> str:
        return self.escaped.sub(r"\1\2", content) if ESCAPE in content else content

    def _put(self, content: str, level: int) -> str:
        return self.levels[level].sub(r"\1\\", content) if level else content

    def write(self, role: str, text: str, level: int) -> tuple[str, int, int]:
        """(turn, where its content begins and ends)."""
        if role in self.roles:
            head, tail = self.roles[role]
        else:
            head, tail = f"{self.other[0]}{self._put(role, 2)}{self.other[1]}", self.other[2]
        body = self._put(text, level)
        return head + body + tail, len(head), len(head) + len(body)

    def render(self, role: str, text: str) -> tuple[str, int, int]:
        """A turn that the parser gives back: as it is if it can be, else with as little escaped as does it."""
        for level in range(len(self.levels)):
            turn, start, end = self.write(role, text, level)
            try:
                if self.parse(turn) == [(role, text, start, end)]:
                    return turn, start, end
            except ValueError:
                continue
        raise ValueError("the template's strings can't be told apart from escaped text")

    def parse(self, rendered: str) -> list[tuple[str, str, int, int]]:
        """(role, text, content's start and end) of each turn; raises ValueError on anything else."""
        turns, at = [], 0
        while at < len(rendered):
            for head, name in self.opening:
                if rendered.startswith(head, at):
                    role, start, close = name, at + len(head), self.roles[name][1]
                    break
            else:
                if not rendered.startswith(self.other[0], at):
                    raise ValueError(f"no turn begins at {at}")
                at += len(self.other[0])
                if not (m := self.control.search(rendered, at)) or not rendered.startswith(self.other[1], m.start()):
                    raise ValueError(f"no role ends after {at}")
                role, start, close = self.unescape(rendered[at : m.start()]), m.start() + len(self.other[1]), self.other[2]
                if role in self.roles:
                    raise ValueError(f"a role of the template is written out at {at}")
            m = self.control.search(rendered, start)
            end = m.start() - (len(close) - len(close.lstrip())) if m else -1
            if end < start or not rendered.startswith(close, end):
                raise ValueError(f"the turn at {at} has no end")
            turns.append((role, self.unescape(rendered[start:end]), start, end))
            at = end + len(close)
        return turns


LLAMA = Template()


def _render(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[pa.RecordBatch]:
    """Sorted rows to parts; a part belongs to one conversation and one task."""
    task, n = TaskContext.get().partitionId() << 32, 0
    conv, texts, starts, ends, size = None, [], [], [], 0

    def part() -> pa.RecordBatch:
        nonlocal n, texts, starts, ends, size
        out = pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([task + n], pa.int64()), pa.array(["".join(texts)], pa.string()), pa.array([starts], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64()))], ["conv_id", "part", "formatted", "loss_starts", "loss_ends"])
        n, texts, starts, ends, size = n + 1, [], [], [], 0
        return out

    for b in batches:
        for c, role, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if texts and (c != conv or size >= PART):
                yield part()
            conv = c
            turn, start, end = template.render(role, text.as_py())
            if role == template.learned:
                starts.append(size + start)
                ends.append(size + end)
            texts.append(turn)
            size += len(turn)
    if texts:
        yield part()


_PARTS = "conv_id bigint, part bigint, formatted string, loss_starts array<bigint>, loss_ends array<bigint>"


def format_conversations(conversations: DataFrame, template: Template = LLAMA) -> DataFrame:
    """conversations(conv_id, turn, role, text) to the written table (conv_id, part, formatted, loss_starts, loss_ends).

    A conversation is its parts in order; the mask of what is learned has places in the part, in code points.
    """
    tables = Tables(conversations.sparkSession, "chat")
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    n = max(int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // RANGE + 1)
    dealt = rows.repartitionByRange(n, "conv_id", "turn", "role", "h").sortWithinPartitions("conv_id", "turn", "role", "h", "text")
    return tables.write(dealt.select("conv_id", "role", "text").mapInArrow(lambda it: _render(it, template), _PARTS), "formatted", product=True)


def _digests(conv_id: int | None, parts: Iterator[tuple[str, list[int], list[int]]], template: Template) -> dict:
    """Of one conversation, its parts in order."""
    turns, loss, n, learned, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
    for formatted, starts, ends in parts:
        for role, text, _, _ in template.parse(formatted):
            turns.update(f"{role}\n".encode("utf-8", "surrogatepass"))
            turns.update(text.encode("utf-8", "surrogatepass"))
            turns.update(b"\n")
            n += 1
        for a, b in zip(starts, ends, strict=True):
            text = template.unescape(formatted[a:b])
            learned += len(text)
            loss.update(text.encode("utf-8", "surrogatepass"))
        size += len(formatted)
    return {"conv_id": conv_id, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": learned, "loss_sha256": loss.hexdigest(), "formatted_chars": size}


_READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
_READ_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[pa.RecordBatch]:
    """Sorted parts to a row a conversation; a part at a time is held."""
    ahead: list[tuple] = []

    def parts() -> Iterator[tuple]:
        for b in batches:
            for i in range(b.num_rows):
                yield tuple(b.column(c)[i].as_py() for c in range(4))

    rest = parts()

    def of(conv_id: int | None) -> Iterator[tuple]:
        while True:
            if not ahead and (x := next(rest, None)) is not None:
                ahead.append(x)
            if not ahead or ahead[0][0] != conv_id:
                return
            yield ahead.pop()[1:]

    while True:
        if not ahead:
            if (x := next(rest, None)) is None:
                return
            ahead.append(x)
        conv_id = ahead[0][0]
        yield pa.RecordBatch.from_pylist([_digests(conv_id, of(conv_id), template)], _READ_ARROW)


def read(formatted: DataFrame, template: Template = LLAMA) -> DataFrame:
    """The written table read back: a row a conversation with its turns, digests and sizes."""
    cols = ["conv_id", "formatted", "loss_starts", "loss_ends"]
    count = formatted.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("split"))
    count = Tables(formatted.sparkSession, "chat").write(count, "split")
    count = small(count, 16 * count.count())  # else every part would be shuffled to find the few that are not alone
    split = F.col("conv_id").eqNullSafe(F.col("split"))
    alone = formatted.join(count, split, "left_anti").select(cols)
    n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    several = formatted.join(count, split, "left_semi").repartition(n, "conv_id").sortWithinPartitions("conv_id", "part").select(cols)
    return alone.mapInArrow(lambda it: _read(it, template), _READ).union(several.mapInArrow(lambda it: _read(it, template), _READ))

"""Quality classifier: ordinal cumulative-link regression on hashed text.

Grades are whole numbers, rising with quality.  One weight vector serves all grades; ordered thresholds cut the
latent score s: P(grade <= k) = logistic(t_k - s).  The expected grade and the tail probability
P(grade >= least) follow.  Features are the shares of hashed words and of hashed word shapes, and the shares of
words equal to the one before, of repeated lines and of upper-case words.

The model is fitted on at most ``bound`` labelled ids, held-out ones left aside; every document is scored over
its whole text.  Defined results: null and empty texts get the score of no features; words and texts may have any
length; without labels, or with one grade only, every document gets that grade and is selected; repeated rows and
ties get equal scores; columns other than doc_id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, only
from .labelled import held_out, training_rows

WORD_SLOTS, SHAPE_SLOTS, DENSE = 4096, 2048, 4
SLOTS = WORD_SLOTS + SHAPE_SLOTS + DENSE
BOUND = 6000
_RUN = re.compile(r"(.)\1+")
_KEPT = 200_000


def _slots(word: str) -> tuple[int, int]:
    shape = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return xxhash.xxh32_intdigest(word.lower()) % WORD_SLOTS, WORD_SLOTS + xxhash.xxh32_intdigest(_RUN.sub(r"\1", shape)) % SHAPE_SLOTS


def _dense(text: str, words: list[str]) -> tuple[float, ...]:
    n = len(words)
    if not n:
        return 0.0, 0.0, 0.0, 0.0
    lines = text.split("\n")
    return sum(map(eq, words, words[1:])) / n, 1 - len(set(lines)) / len(lines), sum(map(str.isupper, words)) / n, 1.0


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    text = text or ""
    words = text.split()
    got: Counter[int] = Counter()
    for w, n in Counter(words).items():
        for s in _slots(w):
            got[s] += n
    n = max(1, len(words))
    dense = _dense(text, words)
    idx = [*got, *range(SLOTS - DENSE, SLOTS)]
    return np.array(idx, np.int32), np.array([*(4 * v / n for v in got.values()), *(4 * v for v in dense)], np.float32)


class Model:
    def __init__(self, grades: list[int], weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.thresholds = grades, weights, thresholds

    def probabilities(self, s: np.ndarray) -> np.ndarray:
        """P(grade = k) for each grade."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - s[:, None], -50, 50)))
        edge = np.zeros((len(s), 1))
        return np.diff(np.concatenate((edge, below, edge + 1), axis=1), axis=1)


def fit(idx: list[np.ndarray], val: list[np.ndarray], y: list[int], ridge: float = 3e-4, steps: int = 250) -> Model:
    grades = sorted(set(y))
    if len(grades) < 2:
        return Model(grades or [0], np.zeros(SLOTS), np.empty(0))
    k = np.searchsorted(grades, y)
    n, cuts = len(y), len(grades) - 1
    rows = np.repeat(np.arange(n), [len(i) for i in idx])
    cols, vals = np.concatenate(idx), np.concatenate(val).astype(np.float64)
    share = np.cumsum(np.bincount(k, minlength=cuts + 1))[:-1] / n
    first = np.log(share / (1 - share))
    p = np.concatenate((np.zeros(SLOTS), first[:1], np.log(np.maximum(np.diff(first), 1e-3))))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        gaps = np.exp(p[SLOTS + 1 :])
        t = p[SLOTS] + np.concatenate(([0.0], np.cumsum(gaps)))
        s = np.bincount(rows, vals * p[cols], n)
        z = np.concatenate((np.full((n, 1), -40.0), t[None, :] - s[:, None], np.full((n, 1), 40.0)), axis=1)
        c = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        at = np.arange(n)
        high, low = c[at, k + 1], c[at, k]
        inside = np.maximum(high - low, 1e-12)
        up, down = high * (1 - high) / inside / n, low * (1 - low) / inside / n
        g = np.zeros_like(p)
        g[:SLOTS] = np.bincount(cols, vals * (up - down)[rows], SLOTS) + ridge * p[:SLOTS]
        gt = np.bincount(k + 1, -up, cuts + 2)[1:-1] + np.bincount(k, down, cuts + 2)[1:-1]
        g[SLOTS] = gt.sum()
        g[SLOTS + 1 :] = gaps * (gt.sum() - np.cumsum(gt)[:-1])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p -= 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Model(grades, p[:SLOTS], p[SLOTS] + np.concatenate(([0.0], np.cumsum(np.exp(p[SLOTS + 1 :])))))


class _Weights(dict):
    """A word's summed weight, remembered."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.w = weights.tolist()

    def __missing__(self, word: str) -> float:
        if len(self) >= _KEPT:
            self.clear()
        a, b = _slots(word)
        x = self[word] = self.w[a] + self.w[b]
        return x


def _score(batches: Iterator[pa.RecordBatch], shared, least: int) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    of = _Weights(model.weights)
    only(of)
    dense = model.weights[SLOTS - DENSE :]
    grades = np.array(model.grades, np.float64)
    for b in batches:
        s = np.zeros(b.num_rows)
        for i, text in enumerate(b.column(1)):
            t = text.as_py() or ""
            words = t.split()
            s[i] = 4 * (sum(map(of.__getitem__, words)) / max(1, len(words)) + float(np.dot(dense, _dense(t, words))))
        p = model.probabilities(s)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p @ grades), pa.array(p[:, grades >= least].sum(axis=1) if len(grades) > 1 else np.ones(len(s)))], ["doc_id", "expected_grade", "tail_probability"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [features(t.as_py()) for t in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in made], pa.list_(pa.int32())), pa.array([x for _, x in made], pa.list_(pa.float32()))], ["doc_id", "y", "idx", "val"])


def train(docs: DataFrame, labels: DataFrame, grade, bound: int = BOUND) -> Model:
    """``grade``: a column over ``labels``.  At most ``bound`` rows of features come to the driver."""
    tables = Tables(docs.sparkSession, "quality")
    rows = training_rows(docs, labels, grade, bound, tables)
    got = rows.select("doc_id", "y", "text").mapInArrow(_features, "doc_id bigint, y int, idx array<int>, val array<float>").toArrow().sort_by("doc_id")
    tables.drop(rows)
    return fit([np.array(x, np.int32) for x in got["idx"].to_pylist()], [np.array(x, np.float32) for x in got["val"].to_pylist()], got["y"].to_pylist())


def grade_documents(docs: DataFrame, labels: DataFrame, grade, least: int = 1, bound: int = BOUND) -> DataFrame:
    """Per document: doc_id, held_out, expected_grade, tail_probability of ``least`` or better, selected (at least 0.5)."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, grade, bound))
    got = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = got.mapInArrow(lambda it: _score(it, model, least), "doc_id bigint, expected_grade double, tail_probability double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= 0.5).alias("selected"))


def scorer(docs: DataFrame, labels: DataFrame, grade, least: int = 1, bound: int = BOUND) -> Callable[[Column], Column]:
    """Learns from ``docs``; gives the tail probability of a column of texts as a column, so no name is taken."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, grade, bound))

    @F.pandas_udf("double")
    def tail(texts):
        import pandas as pd

        batch = pa.RecordBatch.from_arrays([pa.nulls(len(texts), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
        return pd.Series(next(_score(iter([batch]), model, least)).column(2).to_numpy())

    return lambda text: tail(text.cast("string"))


#: Ratings of the labels table: 0 rejected, 1 usable, 2 usable and not toxic.
def ratings():
    return F.col("quality") + F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)

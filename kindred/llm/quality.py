"""Document quality by Bradley-Terry pairwise ranking.

A document's score is linear in features of its text. Preference pairs, one row labelled 1 and one labelled 0, teach
the weights: logistic loss on the differences of their features, by Newton's method. The threshold is the quantile of
the training rows' scores at the share of label 0, and the score is the logistic function of the distance from it,
placed so that the threshold comes to ``CUT``.

All labelled rows that are not held out teach, by all their pairs. The pairs are not listed: the loss, its slope and
its bend depend on a pair by a smooth function of the difference of two scores. Within a cell of ``WIDTH`` such a
function is a polynomial of ``DEGREE`` terms to some 1e-13, so sums over pairs are sums over pairs of cells, of moments
of the rows within them. At most ``PARTS`` partitions give moments, whose size depends on the range of the scores only.

Defined cases: null counts as the empty text, whose features are 0; without rows of both labels every score is 0.5;
several labels of a document count as the highest; unlabelled and null labels teach nothing; a null doc_id is not held
out; an empty table gives no rows; the three new columns take the place of columns of the same names, and ``columns``
gives others.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from numpy.polynomial.chebyshev import chebpts1, chebvander
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from kindred.llm._common import discard, shared_table

RIDGE, CUT = 1e-3, 0.3
#: Not a bound of the fit, which takes all pairs: so many of them a test draws.
PAIRS = 200_000
#: Cells of scores, and the terms of the polynomials in them.
WIDTH, DEGREE = 2.0, 16
#: Partitions that give sums to the driver, at most.
PARTS = 200
_UPPER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_SYMBOL = b"#$%&*|!^~<>{}[]=_\\/@+"


def features(text: str | None) -> list[float]:
    """Numbers that describe the form of a text; all 0 for an empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * 14
    n, w = len(raw), len(words)
    seen = Counter(words)
    without = lambda chars: (n - len(raw.translate(None, chars))) / n
    return [
        math.log1p(w),
        min(n / w, 40.0),
        without(_UPPER),
        without(_DIGIT),
        without(_SYMBOL),
        math.log1p(len(seen)) / math.log1p(w),
        max(seen.values()) / w,
        sum(c for x, c in seen.items() if len(x) <= 3) / w,
        min(raw.count(b"\n") / w, 1.0),
        min((raw.count(b".") + raw.count(b",")) / w, 2.0),
        min(raw.count(b"|") / w, 1.0),
        min(raw.count(b"!") / w, 2.0),
        min(len(zlib.compress(raw, 1)) / n, 1.2),
        1.0,
    ]


def _basis(x: np.ndarray) -> np.ndarray:
    """The features and their squares."""
    return np.concatenate([x, x[:, :-1] ** 2], 1)


class Model:
    """Weights of standardised features, and the threshold of their sum. Without weights every score is 0.5."""

    weights: np.ndarray | None = None
    mean: np.ndarray
    scale: np.ndarray
    threshold: float

    def standard(self, x: np.ndarray) -> np.ndarray:
        return (_basis(x) - self.mean) / self.scale

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _weighted(self.standard(x), self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or not len(x):
            return np.full(len(x), 0.5)
        return 1 / (1 + (1 - CUT) / CUT * np.exp(np.clip(self.threshold - self.raw(x), -500, 500)))


def _weighted(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The scores; unlike those of a matrix product, the same bits wherever a row stands."""
    return (z * w).sum(1) + 0.0


def _rounded(v: np.ndarray) -> np.ndarray:
    """To eleven digits, so that the order in which partitions are summed does not show."""
    return np.array([float(f"{a:.11g}") for a in v])


Batches = Iterator[tuple[np.ndarray, np.ndarray]]


def _of_partitions(rows: DataFrame, work: Callable[[Batches], Any]) -> list[Any]:
    """What ``work`` makes of the features and labels of each partition."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = ((p.column("x").flatten().to_numpy().reshape(-1, 14), p.column("label").to_numpy()) for p in parts if p.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(work(batches))], pa.binary())], ["got"])

    return [pickle.loads(r.got) for r in rows.mapInArrow(run, "got binary").collect()]


def _merge(a: tuple, b: tuple) -> tuple:
    """Counts of both labels, means and squared deviations of two sets of rows, as those of one."""
    n, m = a[0].sum(), b[0].sum()
    if not n or not m:
        return a if n else b
    apart = b[1] - a[1]
    return a[0] + b[0], a[1] + apart * (m / (n + m)), a[2] + b[2] + apart**2 * (n * m / (n + m))


_NOTHING = np.zeros(2), np.zeros(27), np.zeros(27)


def _moments(batches: Batches) -> tuple:
    total = _NOTHING
    for x, label in batches:
        b = _basis(x)
        mean = b.mean(0)
        total = _merge(total, (np.bincount(label, minlength=2).astype(float), mean, ((b - mean) ** 2).sum(0)))
    return total


def _placed(z: np.ndarray, w: np.ndarray, label: np.ndarray) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray]]:
    """For each label and cell: the polynomials' terms at the scores in it, and the features."""
    s = _weighted(z, w) / WIDTH
    cell = np.floor(s).astype(np.int64)
    terms = chebvander(2 * (s - cell) - 1, DEGREE - 1)
    for own in (0, 1):
        for c in np.unique(cell[label == own]):
            at = (label == own) & (cell == c)
            yield (own, int(c)), terms[at], z[at]


#: Points of a cell, from -1 to 1, and what turns sums of terms into weights of the points.
_POINTS = chebpts1(DEGREE)
_TO_POINTS = chebvander(_POINTS, DEGREE - 1) * np.where(np.arange(DEGREE), 2, 1) / DEGREE


class _Sums:
    """Loss, slope and bend at weights ``w``, over all pairs of ``rows``."""

    def __init__(self, rows: DataFrame, model: Model, counts: np.ndarray, w: np.ndarray):
        self.rows, self.model, self.counts, self.w = rows, model, counts, w

        def moments(batches: Batches) -> dict:
            found = {}
            for x, label in batches:
                for key, terms, z in _placed(model.standard(x), w, label):
                    found[key] = found.get(key, 0) + terms.T @ np.concatenate([np.ones((len(z), 1)), z], 1)
            return found

        total: dict = {}
        for part in _of_partitions(rows, moments):
            for key, m in part.items():
                total[key] = total.get(key, 0) + m
        self.cells = {own: sorted(c for label, c in total if label == own) for own in (0, 1)}
        # shares of all rows of a label: so sums over pairs are means
        at = {own: np.concatenate([(c + (_POINTS + 1) / 2) * WIDTH for c in self.cells[own]]) for own in (0, 1)}
        bad, good = (np.concatenate([_TO_POINTS @ total[own, c] / counts[own] for c in self.cells[own]]) for own in (0, 1))
        self.loss, self.slope, self.cross = RIDGE / 2 * (w @ w), -RIDGE * w, np.zeros((len(w), len(w)))
        self.bends = {0: np.zeros(len(bad)), 1: np.zeros(len(good))}
        for i in range(0, len(good), DEGREE):  # one cell of good rows against all of bad ones
            here = slice(i, i + DEGREE)
            by = at[0][None, :] - at[1][here, None]
            wrong = 1 / (1 + np.exp(np.clip(-by, -500, 500)))  # the chance of the wrong order
            bend = wrong * (1 / (1 + np.exp(np.clip(by, -500, 500))))
            self.loss += good[here, 0] @ np.logaddexp(0, by) @ bad[:, 0]
            self.slope = self.slope + (wrong @ bad[:, 0]) @ good[here, 1:] - (good[here, 0] @ wrong) @ bad[:, 1:]
            self.cross += good[here, 1:].T @ (bend @ bad[:, 1:])
            self.bends[1][here] = bend @ bad[:, 0]
            self.bends[0] += good[here, 0] @ bend

    def step(self) -> np.ndarray:
        """Newton's step. What a row's own features add to the bend takes a second look at the rows."""
        model, counts, w = self.model, self.counts, self.w
        curves = {(own, c): _TO_POINTS.T @ self.bends[own][i * DEGREE : (i + 1) * DEGREE] for own in (0, 1) for i, c in enumerate(self.cells[own])}

        def squares(batches: Batches) -> np.ndarray:
            found = np.zeros((len(w), len(w)))
            for x, label in batches:
                for key, terms, z in _placed(model.standard(x), w, label):
                    found += (z * (terms @ curves[key] / counts[key[0]])[:, None]).T @ z
            return found

        own = sum(_of_partitions(self.rows, squares))
        return np.linalg.solve(own - self.cross - self.cross.T + RIDGE * np.eye(len(w)), self.slope)


def _weights(rows: DataFrame, model: Model, counts: np.ndarray) -> np.ndarray:
    here = _Sums(rows, model, counts, np.zeros(len(model.mean)))
    for _ in range(100):
        step = here.step()
        while np.abs(step).max() >= 1e-6:
            there = _Sums(rows, model, counts, here.w + step)
            if there.loss <= here.loss * (1 + 1e-12):
                break
            step = step / 2
        else:
            return here.w + step
        here = there
    return here.w


def _in_order(s: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the scores, by their bits."""
    bits = s.view(np.int64)
    return (bits ^ ((bits >> 63) & 0x7FFFFFFFFFFFFFFF)).view(np.uint64) ^ np.uint64(1 << 63)


def _between(rows: DataFrame, model: Model, rank: int) -> float:
    """The middle of the scores at ``rank - 1`` and ``rank`` of all, found by sixteen bits at a time."""
    known, before = 0, 0
    for shift in (48, 32, 16, 0):

        def counts(batches: Batches, known: int = known, shift: int = shift) -> Counter:
            found: Counter = Counter()
            for x, _ in batches:
                bits = _in_order(model.raw(x)) >> np.uint64(shift)
                next_bits = (bits & np.uint64(0xFFFF))[bits >> np.uint64(16) == known]
                found.update(dict(zip(*(a.tolist() for a in np.unique(next_bits, return_counts=True)), strict=True)))
            return found

        found = sum(_of_partitions(rows, counts), Counter())
        for digit in sorted(found):
            if before + found[digit] >= rank:
                break
            before += found[digit]
        known = known << 16 | digit
    bits = np.array([known], np.uint64) ^ np.uint64(1 << 63)
    low = (bits.view(np.int64) ^ ((bits.view(np.int64) >> 63) & 0x7FFFFFFFFFFFFFFF)).view(np.float64)[0]
    if before + found[digit] > rank:
        return float(low)
    above = lambda batches: min((s[s > low].min(initial=np.inf) for s in (model.raw(x) for x, _ in batches)), default=np.inf)
    return float((low + min(_of_partitions(rows, above))) / 2)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from all labelled rows that are not held out."""
    taught = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    known = labels.where(F.col("quality").isin(0, 1) & taught).groupBy(F.col("doc_id").alias("__id")).agg(F.max("quality").cast("int").alias("label"))

    def described(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = [features(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    texts = docs.where(taught).select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    schema = StructType([texts.schema["doc_id"], StructField("x", ArrayType(DoubleType()))])
    # features travel, not texts; repeated rows of an id: the least features
    found = texts.mapInArrow(described, schema).groupBy("doc_id").agg(F.min("x").alias("x"))
    table = shared_table(found.join(known, F.col("doc_id") == F.col("__id")).select("label", "x"))
    rows, model = table.coalesce(PARTS), Model()
    counts, mean, squares = reduce(_merge, _of_partitions(rows, _moments), _NOTHING)
    if counts.all():
        scale = np.sqrt(squares / counts.sum())
        scale[scale < 1e-9] = np.inf
        model.mean, model.scale = _rounded(mean), _rounded(scale)
        model.weights = np.round(_weights(rows, model, counts), 8)
        model.threshold = _between(rows, model, min(int(counts[0]), int(counts.sum()) - 1))
    discard(table)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, columns: tuple[str, str, str] = ("held_out", "score", "predicted")) -> DataFrame:
    """``docs`` with three columns: whether the row is held out, its score, and the prediction."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    names = [c for c in docs.columns if c.lower() not in {x.lower() for x in columns}]
    rows = docs.select(*names)
    apart, score, predicted = columns
    schema = StructType([*rows.schema.fields, StructField(score, DoubleType())])

    def scored(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = np.array([features(t) for t in part.column("text").to_pylist()]).reshape(part.num_rows, 14)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.value.score(x))], [*names, score])

    return rows.mapInArrow(scored, schema).select(*names, held_out(F.col("doc_id")).alias(apart), score, (F.col(score) >= CUT).cast("int").alias(predicted))

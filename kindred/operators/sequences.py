"""Operators over sequences: runs, neighbours, mass midpoints, majorities and peaks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.ints import SCALE, chance_correct, clamp, idiv, run_class
from kindred.operators import tiles


def run_lengths(rows: DataFrame, by: str, order: Sequence[str], value: str) -> DataFrame:
    """``by, bin, n``: runs of equal values in each sequence, by the class of their length."""
    w = Window.partitionBy(by).orderBy(*order)
    starts = rows.withColumn("__new", F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    runs = starts.withColumn("__run", F.sum("__new").over(w)).groupBy(by, "__run").agg(F.count("*").alias("__len"))
    return runs.groupBy(by, run_class(F.col("__len")).alias("bin")).agg(F.count("*").alias("n"))


def run_histogram(runs: DataFrame, by: str, bins: int = 16, scale: int = 255) -> DataFrame:
    """``by, hist``: the classes' shares of ``scale``."""
    counts = runs.groupBy(by).agg(*(F.coalesce(F.sum(F.when(F.col("bin") == i, F.col("n"))), F.lit(0)).alias(f"b{i}") for i in range(bins)), F.sum("n").alias("__n"))
    return counts.select(by, F.array(*(idiv(F.col(f"b{i}") * scale, F.col("__n")) for i in range(bins))).alias("hist"))


def runs_channel(pairs: DataFrame, scale: int = 255) -> DataFrame:
    """Texture of runs of pairs with ``ha`` and ``hb``: ``raw``, the control by rotation, ``value`` and ``measurable``.

    A side whose runs are nearly all of one class has no texture, and the channel abstains.
    """
    ha, hb = F.col("ha"), F.col("hb")

    def alike(turn: int):
        turned = F.concat(F.slice(hb, turn + 1, 16), F.slice(hb, 1, turn)) if turn else hb
        gap = F.aggregate(F.zip_with(ha, turned, lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda acc, d: acc + d)
        return clamp(SCALE - idiv(gap * SCALE, 2 * scale), 0, SCALE)

    flat = lambda h: F.array_max(h) * 100 >= F.aggregate(h, F.lit(0).cast("long"), lambda acc, v: acc + v) * 95
    measurable = ~(flat(ha) | flat(hb))
    scored = pairs.withColumn("raw", alike(0)).withColumn("control", F.least(F.lit(SCALE).cast("long"), alike(4), alike(8), alike(12)))
    return scored.withColumn("measurable", measurable).withColumn("value", F.when(F.col("measurable"), chance_correct(F.col("raw"), F.col("control"))).otherwise(0))


#: Sides, rows of the right one, that are compared at once.
BESIDE = 1 << 14


def runs_of_all(left: DataFrame, right: DataFrame, scale: int = 255, size: int = tiles.GRID) -> DataFrame:
    """``a, b, raw, control, measurable, value``: ``runs_channel`` of every row of ``left`` with every other of ``right``, both (id, hist of 16 classes)."""

    def compared(ours: pa.Table, theirs: pa.Table, _: pa.Table) -> Iterator[list[np.ndarray]]:
        a, b = (tiles.whole(t["id"]) for t in (ours, theirs))
        x, y = (tiles.matrix(t["hist"])[0] for t in (ours, theirs))
        flat_x, flat_y = (h.max(1) * 100 >= h.sum(1) * 95 for h in (x, y))
        most = int(x.sum(1).max() + y.sum(1).max())
        alike = np.clip(SCALE - np.arange(most + 1) * SCALE // (2 * scale), 0, SCALE).astype(np.int16)  # by the gap
        narrow = np.int16 if most < 1 << 15 else np.int32
        x, y = x.astype(narrow), np.ascontiguousarray(y.T.astype(narrow))
        for at in range(0, len(b), BESIDE):
            beside, texture = b[at : at + BESIDE], ~flat_y[at : at + BESIDE]
            turned = [np.ascontiguousarray(np.roll(y[:, at : at + BESIDE], -turn, axis=0)) for turn in (0, 4, 8, 12)]
            for k in range(len(a)):
                gaps = [np.abs(h - x[k, :, None]).sum(0, dtype=narrow) for h in turned]
                raw = alike[gaps[0]]
                control = alike[np.maximum(np.maximum(gaps[1], gaps[2]), gaps[3])].astype(np.int32)  # the least alike has the greatest gap
                measurable = texture & ~flat_x[k]
                value = np.where(measurable & (control < SCALE), np.maximum((raw - control) * SCALE // np.maximum(SCALE - control, 1), 0), 0)
                other = beside != a[k]
                yield [np.full(int(other.sum()), a[k]), beside[other], raw[other], control[other], measurable[other], value[other]]

    schema = [("a", np.int64), ("b", np.int64), ("raw", np.int64), ("control", np.int64), ("measurable", np.bool_), ("value", np.int64)]
    sides = [df.select("id", F.col("hist").cast("array<bigint>").alias("hist")) for df in (left, right)]
    return tiles.meet(*sides, lambda *cell: tiles.batched(compared(*cell), schema), "a long, b long, raw long, control long, measurable boolean, value long", size)


def mass_midpoints(rows: DataFrame, by: Sequence[str], level: str, top: int = 255) -> DataFrame:
    """For each level of each group the quantile, 0 to ``top``, of the middle of its mass, and its band of eight.

    Levels are counted first, so the ordered windows see distinct levels only.
    """
    counts = rows.groupBy(*by, level).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    below = F.coalesce(F.sum("n").over(w.orderBy(level).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(w)
    quantile = clamp(idiv((2 * below + F.col("n")) * top + total, 2 * total), 0, top)
    placed = counts.withColumn("rank", F.row_number().over(w.orderBy(level)) - 1).withColumn("quantile", quantile)
    return placed.withColumn("band", F.shiftright("quantile", 5).cast("int"))


def rank_normalised(rows: DataFrame, by: str, order: Sequence[str], top: int = 255) -> DataFrame:
    """``place``: a row's place in its group, spread over 0 to ``top``."""
    w = Window.partitionBy(by)
    return rows.withColumn("place", idiv((F.row_number().over(w.orderBy(*order)) - 1) * top, F.count("*").over(w) - 1))


def adjacency(rows: DataFrame, by: str, order: Sequence[str], value: str, top: int = 48, scale: int = 65535) -> DataFrame:
    """Unordered pairs of unequal neighbours in the sequences, the ``top`` most frequent, with their share of ``scale``."""
    w = Window.partitionBy(by).orderBy(*order)
    near = rows.withColumn("__next", F.lead(value).over(w)).where(F.col(value) != F.col("__next"))
    counts = near.groupBy(F.least(value, "__next").alias("lo"), F.greatest(value, "__next").alias("hi")).agg(F.count("*").alias("n"))
    kept = counts.orderBy(F.desc("n"), "lo", "hi").limit(top)  # a report of bounded size by definition
    total = counts.agg(F.sum("n").alias("total"))
    return kept.join(F.broadcast(total)).select("lo", "hi", "n", idiv(F.col("n") * scale, F.col("total")).alias("share"))


def majority(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each group, the greatest of equals, and its count."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.max(F.struct("n", value)).alias("m")).select(*by, F.col(f"m.{value}").alias(value), F.col("m.n").alias("n"))


def sliding_peaks(rows: DataFrame, by: str, order: Sequence[str], value: str, radius: int = 2) -> DataFrame:
    """Rows whose value is the greatest within ``radius`` rows on both sides, the earliest of equals."""
    w = Window.partitionBy(by).orderBy(*order)
    before, after = F.max(value).over(w.rowsBetween(-radius, -1)), F.max(value).over(w.rowsBetween(1, radius))
    peak = (F.col(value) > F.coalesce(before, F.lit(float("-inf")))) & (F.col(value) >= F.coalesce(after, F.lit(float("-inf"))))
    return rows.withColumn("__peak", peak).where("__peak").drop("__peak")

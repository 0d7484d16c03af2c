"""Mixers of 64 and 32 bits: multiplications that wrap, which the engine's own arithmetic refuses, so Arrow kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The increment and factors of the 64-bit mixer, the mask of seeded streams, and the 32-bit mixer's masks and factors.
STEP, FIRST, SECOND, STREAM = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x5851F42D4C957F2D
HIGH, LOW, FACTORS = 0x9E3779B9, 0x85EBCA6B, (0x7FEB352D, 0x846CA68B, 0xC2B2AE35)


def mix64(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(STEP)
    for shift, factor in ((30, FIRST), (27, SECOND)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(31)


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` values of a seeded stream."""
    return mix64((np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64)) ^ np.uint64(STREAM))


def mix32(word: np.ndarray) -> np.ndarray:
    """A key of 32 bits of a word's two halves, by which a bounded number of codes is chosen."""
    high, low = ((word.astype(np.uint64) >> np.uint64(s)).astype(np.uint32) for s in (32, 0))
    a, b = high ^ np.uint32(HIGH), low ^ np.uint32(LOW)
    a = (a ^ a >> np.uint32(16)) * np.uint32(FACTORS[0])
    a ^= (b ^ b >> np.uint32(15)) * np.uint32(FACTORS[1])
    a = (a ^ a >> np.uint32(13)) * np.uint32(FACTORS[2])
    return a ^ a >> np.uint32(16)


def with_mixes(rows: DataFrame, word: str) -> DataFrame:
    """``word, mixed, key``: the 64-bit mix (as a signed number) and the 32-bit key of a column of longs."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = np.asarray(part.column(0)).view(np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(mix64(x).view(np.int64)), pa.array(mix32(x).astype(np.int64))], [word, "mixed", "key"])

    return rows.select(F.col(word).cast("long")).where(F.col(word).isNotNull()).mapInArrow(batches, f"{word} long, mixed long, key long")

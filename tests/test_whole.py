"""Queries against brute force, beside their SQL."""

from __future__ import annotations

from collections import Counter

import pytest

from compare import tables
from kindred.operators import nomination
from kindred.plans import catalogue
from kindred.plans.catalogue import QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return tables(sf)


def test_chunk_join_by_bytes_and_by_grid(spark):
    codes = spark.createDataFrame([(0, 0), (1, 0x7F), (2, 0x0101010101010101), (3, -1)], "id long, code long")
    near = lambda most: sorted(map(tuple, nomination.chunk_join(codes, codes.where("id = 0"), most).collect()))
    assert near(7) == [(0, 1, 7)]
    assert near(8) == [(0, 1, 7), (0, 2, 8)]
    assert near(64) == [(0, 1, 7), (0, 2, 8), (0, 3, 64)]


def test_support_over_the_whole_table_of_projections(spark, sf, con):
    """By brute force: the parts of works that share a key, and how many of 24 codes of 12 bits they share."""
    parts = {}
    for work, part, d in con.execute(f"WITH {catalogue._DESC} SELECT work, part, d FROM parts").fetchall():
        word = sum((w & (1 << 64) - 1) << 64 * k for k, w in enumerate(d))
        parts.setdefault(work, {})[part] = [tuple(word >> p & 1 for p in [(37 * t + (2 * t + 11) * i) % 256 for i in range(12)]) for t in range(24)]
    cool = {w: [Counter(codes[p] for codes in of.values()) for p in range(24)] for w, of in parts.items()}
    want = set()
    for a, b in con.execute(f"WITH {catalogue._MET} SELECT a, b FROM met").fetchall():
        for i, x in parts[a].items():
            for j, y in parts[b].items():
                n = sum(x[p] == y[p] and cool[a][p][x[p]] <= 16 and cool[b][p][x[p]] <= 16 for p in range(24))
                if n >= 2:
                    want.add((a, b, i, j, n))
    assert {tuple(r) for r in QUERIES["lsh_support_join"](spark, sf).select("a", "b", "i", "j", "support").collect()} == want
    assert len(want) > 0

"""Integer and bit functions on values with known results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kindred.functions import bits, ints
from kindred.functions.verdict import CHANNELS, CURRENT, FORMER, verdict
from kindred.operators import matching, screening, store


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_division_truncates_and_zero_gives_zero(spark):
    got = values(spark, [(-7, 2), (7, -2), (7, 0), (9, 3)], "a long, b long", ints.idiv(F.col("a"), F.col("b")))
    assert got == [(-3,), (-3,), (0,), (3,)]


def test_isqrt(spark):
    ns = [0, 1, 2, 3, 4, 10**6 - 1, 10**6, (1 << 52) - 1, 1 << 52, (3_037_000_499) ** 2 - 1, 3_037_000_499**2, (1 << 63) - 1, -5]
    import math

    got = values(spark, [(n,) for n in ns], "n long", ints.isqrt(F.col("n")))
    assert got == [(math.isqrt(max(n, 0)),) for n in ns]


def test_lut(spark):
    points = [(0, 0), (2000, 8000), (10000, 10000)]
    xs = [0, 1, 1000, 1999, 2000, 6000, 9999, 10000, 20000, -3]
    got = values(spark, [(x,) for x in xs], "x long", ints.lut(F.col("x"), points))
    assert [g for (g,) in got] == [0, 4, 4000, 7996, 8000, 9000, 9999, 10000, 10000, 0]


def test_confidence_and_strength(spark):
    got = values(spark, [(0, 999), (1, 2), (10, 20), (40, 88), (5, 5)], "a long, b long", ints.confidence(F.col("a"), F.col("b")))
    assert [g for (g,) in got] == [64, 32, 32, 35, 1]
    got = values(spark, [(1, 1), (100, 75), (100, 50), (1000, 1), (0, 500)], "a long, b long", ints.strength_compat(F.col("a"), F.col("b")))
    assert [g for (g,) in got] == [64, 48, 32, 32, 32]


def test_rotations_and_reversal(spark):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    code = 0x123456789ABCDEF0
    cols = [bits.rotate(F.col("c"), k) for k in (16, 32, 48)] + [bits.reverse(F.col("c"))]
    (got,) = values(spark, [(signed(code),)], "c long", *cols)
    assert got == tuple(map(signed, (0x56789ABCDEF01234, 0x9ABCDEF012345678, 0xDEF0123456789ABC, 0x0F7B3D591E6A2C48)))


def test_unsigned_order(spark):
    rows = spark.createDataFrame([(-1,), (0,), (5,), (-(1 << 63),)], "x long").orderBy(bits.unsigned_order(F.col("x"))).collect()
    assert [r.x for r in rows] == [0, 5, -(1 << 63), -1]


def test_shift_offsets(spark):
    got = values(spark, [(2,), (6,), (12,), (50,), (128,)], "n long", matching.shifts_of(F.col("n")))
    assert [list(g) for (g,) in got] == [[1], [3, 2, 1, 4], [6, 4, 2, 8], [25, 16, 10, 33], [64, 42, 25, 85]]


def test_coverage_of_an_l_shape(spark):
    points = spark.createDataFrame([(1, 8192, 8192), (1, 8192, 24576), (1, 24576, 24576)], "w int, x long, y long")
    (row,) = matching.grid_coverage(points, "w", 4).collect()
    assert (row.occupied, row.coverage, row.bbox_cells, row.concentration) == (3, 1875, 4, 10000)


def judged(spark, value=6000, measured=True, identical=False, geo=6000, inliers=20, topo=2, diversity=8000, cover=8000, c=CURRENT):
    values_ = {n: (F.lit(value), F.lit(measured)) for n in CHANNELS}
    v = verdict(values_, identical=F.lit(identical), geo_measurable=F.lit(geo is not None), geo_evidence=F.lit(geo or 0), inliers=F.lit(inliers), topology_class=F.lit(topo), diversity=F.lit(diversity), coverage=F.lit(cover), mirrored=F.lit(False), c=c)
    return spark.range(1).select(v.alias("v")).first().v


@pytest.mark.parametrize(
    "case, state, basis",
    [
        ({}, "Copy", ["structural", "geometric"]),
        ({"identical": True}, "Identical", ["bytes"]),
        ({"geo": None}, "Copy", ["structural"]),
        ({"geo": None, "cover": 100}, "Suspected", ["structural", "R4:support"]),
        ({"geo": None, "diversity": 100}, "Suspected", ["structural", "R2:repetition"]),
        ({"value": 0, "topo": 1}, "Suspected", ["geometric", "R3:scatter"]),
        ({"value": 0, "topo": 3}, "Copy", ["geometric"]),
        ({"value": 0, "inliers": 3}, "Suspected", ["geometric"]),
        ({"value": 1500, "geo": None}, "Related", []),
        ({"value": 100, "geo": None}, "Unrelated", []),
        ({"measured": False, "geo": None}, "Unrelated", []),
        ({"value": 3000, "geo": None}, "Related", []),
        ({"value": 3000, "geo": None, "c": FORMER}, "Suspected", ["structural"]),
    ],
)
def test_verdicts(spark, case, state, basis):
    v = judged(spark, **case)
    assert (v.state, list(v.basis)) == (state, basis)


def test_screening_through_keys_is_what_the_definition_says(spark):
    import random

    pick = random.Random(5)
    works = spark.createDataFrame([(i, pick.randrange(12), [pick.randrange(5) for _ in range(6)]) for i in range(120)], "id long, cell int, bands array<int>")
    queries = works.where("id < 10")
    probes = queries.select(F.col("id").alias("query"), F.explode(F.array(F.struct(F.col("cell").alias("cell"), F.lit(1).alias("rank")), F.struct(((F.col("cell") + 1) % 12).alias("cell"), F.lit(2).alias("rank")))).alias("p")).select("query", "p.cell", "p.rank")
    for threshold, budget in ((-100, 50), (10, 7), (200, 5), (-5, 0)):
        a = screening.score(probes, queries, works, threshold=threshold, budget=budget).collect()
        b = screening.score_by_definition(queries, probes, works, threshold=threshold, budget=budget).collect()
        assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_replacing_matches_takes_both_orders_and_the_last_verdict(spark):
    stored = spark.createDataFrame([(1, 2, 3, 10), (5, 4, 2, 10), (7, 8, 1, 10)], "a long, b long, state int, computed long")
    examined = spark.createDataFrame([(2, 1), (4, 5)], "a long, b long")
    found = spark.createDataFrame([(1, 2, 4, 20), (1, 2, 2, 30)], "a long, b long, state int, computed long")
    got = sorted(map(tuple, store.replace_matches(stored, examined, found).collect()))
    assert got == [(1, 2, 2, 30), (7, 8, 1, 10)]


def test_frequencies_come_back_after_adding_and_removing(spark):
    keys = spark.createDataFrame([(1, 0, 5), (2, 0, 5), (3, 1, 9)], "id long, kind int, key long")
    from kindred.operators.nomination import document_frequencies

    before = document_frequencies(keys)
    extra = spark.createDataFrame([(9, 0, 5), (9, 1, 7)], "id long, kind int, key long")
    after = store.frequency_change(store.frequency_change(before, extra, extra.limit(0)), extra.limit(0), extra)
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, before.collect()))

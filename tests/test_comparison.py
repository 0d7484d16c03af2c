"""Pictures compared: records, channels, geometry, verdicts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions.verdict import FORMER
from kindred.operators import comparison, images


def busy(seed, w=288, h=200):
    """Lines and spots of many colours on two backgrounds, so that no backdrop is folded."""
    pick = np.random.default_rng(seed)
    px = np.full((h, w, 4), 255, np.uint8)
    px[:, : w // 2, :3], px[:, w // 2 :, :3] = pick.integers(0, 256, 3), pick.integers(0, 256, 3)
    for _ in range(160):
        y, x = pick.integers(0, h), pick.integers(0, w)
        px[y : y + pick.integers(3, 26), x : x + pick.integers(3, 26), :3] = pick.integers(0, 256, 3)
    dots = pick.integers(0, [h, w], (900, 2))
    px[dots[:, 0], dots[:, 1], :3] = pick.integers(0, 256, (900, 3))
    return px


def record(px):
    return comparison.record(px.shape[1], px.shape[0], np.ascontiguousarray(px).tobytes())


BASE = busy(1)


@pytest.fixture(scope="module")
def base():
    return record(BASE)


def test_canonical_codes_of_many_windows():
    cells = np.random.default_rng(0).integers(0, 500, (60, 8, 8))
    assert [int(x) for x in comparison.canonical_codes(cells)] == [images.canonical_code(c) for c in cells]


def test_codes_are_those_of_turned_and_inverted_windows():
    cell = np.random.default_rng(1).permutation(64).reshape(1, 8, 8)
    same = {int(comparison.canonical_codes(x)[0]) for x in (cell, cell[:, ::-1], cell[:, :, ::-1], cell.transpose(0, 2, 1), 100 - cell)}
    assert len(same) == 1


def test_a_part_keeps_its_codes(base):
    part = record(BASE[24:176, 40:240])
    assert len(set(part["codes"]) & set(base["codes"])) > 10


def test_boundaries_do_not_know_the_order_of_the_palette():
    px = BASE.copy()
    a = comparison.boundaries(images.Indexed(px))
    assert a == comparison.boundaries(images.Indexed(px[:, ::-1])) and a[0][4] == 65535 and len(a) == 48


def test_channels_of_copies_and_others(base):
    mirror, other, inverted = record(BASE[:, ::-1]), record(busy(2)), record(np.concatenate([255 - BASE[..., :3], BASE[..., 3:]], -1))
    for channel in (comparison.dct_channel, comparison.topology_channel, comparison.runs_channel, comparison.palette_channel):
        own, far = channel(base, base), channel(base, other)
        assert own == (10000, True), channel.__name__
        assert far[0] < 9000, channel.__name__
    assert comparison.dct_channel(base, mirror)[0] > 9000 and comparison.dct_channel(base, inverted)[0] > 9000
    assert comparison.palette_channel(base, inverted)[0] > 8000 and comparison.topology_channel(base, mirror)[0] > 9000


def test_what_cannot_be_measured_is_not(base):
    plain = record(np.full((60, 60, 4), 255, np.uint8))
    assert [f(base, plain)[1] for f in (comparison.dct_channel, comparison.topology_channel, comparison.runs_channel, comparison.palette_channel)] == [False] * 4
    assert not comparison.geometry(base, plain)["geo_measurable"]


def test_geometry_of_mirror_part_and_paste(base):
    mirror = comparison.geometry(base, record(BASE[:, ::-1]))
    assert mirror["inliers"] >= 11 and mirror["mirrored"] and mirror["geo_margin"] > 5000
    part = comparison.geometry(base, record(BASE[20:180, 30:250]))
    assert part["inliers"] >= 11 and not part["mirrored"] and part["topology"] in (2, 3, 4)
    other = comparison.geometry(base, record(busy(3)))
    assert (other["inliers"], other["models"]) == (0, 0)


def test_both_ways_alike(base):
    other = record(BASE[10:190, 20:260])
    assert comparison.measure(base, other) == comparison.measure(other, base)


def test_verdicts_from_pixels(spark):
    big = BASE.repeat(2, 0).repeat(2, 1)
    shown = [BASE, BASE[:, ::-1], big, BASE[20:180, 30:250], busy(2), busy(5)]
    rows = [(i, p.shape[1], p.shape[0], np.ascontiguousarray(p).tobytes()) for i, p in enumerate(shown)] + [(9, 5, 5, b"no")]
    pictures = spark.createDataFrame(rows, "work_id long, w int, h int, px binary")
    records = comparison.picture_records(pictures).cache()
    pairs = spark.createDataFrame([(0, k) for k in (1, 2, 3, 4, 5, 9)], "a long, b long")
    got = {r.b: r for r in comparison.compare(pairs, records).collect()}
    assert got[2].state == "Identical" and got[1].state == "Copy" and got[3].state in ("Copy", "Suspected")
    assert got[4].state in ("Related", "Unrelated") and got[5].state in ("Related", "Unrelated")
    assert (got[9].state, got[9].code, got[9]["class"]) == ("Indeterminate", 5, "damaged")
    # from end to end: the copies are found by their codes, without being told which to compare
    found = {(r.a, r.b) for r in comparison.copies(records).collect()}
    assert {(0, 1), (0, 2), (1, 2)} <= found and not {b for p in found for b in p} & {4, 5, 9}
    # the same evidence under another calibration
    old = comparison.judged(comparison.compare(pairs, records).drop("state", "code", "class", "basis", "structural", "certifiable"), FORMER)
    assert old.where(F.col("b") == 1).first().state == "Copy"


# ---- regions ----
def test_rays_outline_and_holes_of_plain_shapes():
    from kindred.operators import regions

    ring = np.ones((9, 9), bool)
    ring[3:6, 3:6] = False
    assert regions.holes(ring) == 1 and regions.holes(np.ones((4, 4), bool)) == 0
    assert regions.outline(np.ones((5, 5), bool)) == 16
    square = regions.rays(np.ones((9, 9), bool))
    assert square[0] == square[8] == square[16] == square[24] == 4  # up to, not on, the border
    shape = np.zeros((12, 9), bool)
    shape[1:11, 2:5], shape[8:11, 2:8] = True, True
    p = regions.canonical_profile(regions.profile(regions.rays(shape)))
    assert all(regions.canonical_profile(regions.profile(regions.rays(t))) == p for z in (shape, shape.T) for t in (np.rot90(z, k) for k in range(4)))


def test_regions_silhouettes_and_families_do_not_know_turns():
    from kindred.operators import regions

    px = BASE[:96, :96].copy()
    px[:20, :, 3], px[:, 80:, 3] = 0, 0
    seen = []
    for t in (px, px[:, ::-1], px[::-1], px.transpose(1, 0, 2)):
        im = images.Indexed(np.ascontiguousarray(t))
        r, s = regions.regions(im), regions.silhouette(im)
        seen.append(([(x["area"], x["outline"], x["holes"], max(x["w"], x["h"])) for x in r], sorted(s["spread"]), s["fill"], s["outline"]))
    assert all(x == seen[0] for x in seen) and len(seen[0][0]) == 8
    a, b = (record(t) for t in (px, px[:, ::-1]))
    import json

    fa, fb = json.loads(a["families"]), json.loads(b["families"])
    assert [len(fa[k]) for k in ("runs", "tone", "pal", "shape", "kpgeo")] == [16, 28, 24, 41, 23] if fa["kpgeo"] else True
    assert all(fa[k] == fb[k] for k in ("runs", "tone", "pal", "shape"))
    assert a["words"][1:] == b["words"][1:]


def test_shape_and_silhouette_channels():
    from kindred.operators import regions

    im, other = images.Indexed(BASE), images.Indexed(busy(7))
    a, b = regions.regions(im), regions.regions(other)
    assert regions.shape_channel(a, a) == (10000, True) and regions.shape_channel(a, b)[0] < 9000
    assert regions.shape_channel(a[:1], a) == (0, False) and regions.silhouette_channel(None, None) == (0, False)
    px = BASE[:90, :90].copy()
    px[:30, :50, 3] = 0
    s = regions.silhouette(images.Indexed(px))
    assert regions.silhouette_channel(s, s) == (10000, True)

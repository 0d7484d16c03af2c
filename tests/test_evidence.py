"""Key points, assignment, votes and mixers against known values and brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import mixers
from kindred.operators import evidence, images, keypoints, signatures

# Expected results of the reference for small cases: costs by rows (-1: no edge), and the pairs assigned.
ASSIGNED = [
    ([[1, 2], [2, -1]], [(0, 1), (1, 0)]),
    ([[3, 3, 3], [3, 3, 3]], [(0, 0), (1, 1)]),
    ([[1, -1], [5, 2], [-1, 1]], [(0, 0), (2, 1)]),
    ([[-1, -1, -1], [-1, -1, -1], [-1, -1, -1]], []),
    ([[7, 2, -1, 3], [2, 7, 3, -1], [-1, 3, 7, 2], [3, -1, 2, 7]], [(0, 1), (1, 0), (2, 3), (3, 2)]),
    ([[1, -1, 1, -1], [-1, 1, 1, -1]], [(0, 0), (1, 1)]),
]
# Numbers of the key points that the reference selects by quality among forty made ones.
SELECTED = {4: [0, 1, 2, 4], 8: [0, 1, 2, 4, 6, 8, 10, 12], 16: [0, 1, 2, 4, 6, 8, 10, 12, 14, 3, 5, 7, 9, 16, 11, 18]}
# Cells that the reference lets one correspondence vote for, with scale bins beside its own and without.
CELLS = [788640, 788639, 788576, 788575, 850080, 850079, 850016, 850015]
SOFT = [723104, 723103, 723040, 723039, 784544, 784543, 784480, 784479, 854176, 854175, 854112, 854111, 915616, 915615, 915552, 915551]


@pytest.mark.parametrize("cost, pairs", ASSIGNED)
def test_assignment_of_known_cases(cost, pairs):
    assert evidence.assign(np.array(cost)) == pairs


def test_assignment_is_the_best_there_is():
    pick = random.Random(1)
    for _ in range(200):
        n, m = pick.randrange(1, 5), pick.randrange(1, 6)
        cost = np.array([[pick.choice((-1, -1, pick.randrange(6))) for _ in range(m)] for _ in range(n)])
        every = (list(zip(r, c, strict=True)) for k in range(min(n, m) + 1) for r in itertools.combinations(range(n), k) for c in itertools.permutations(range(m), k))
        best = max((len(p), -sum(int(cost[e]) for e in p)) for p in every if all(cost[e] >= 0 for e in p))
        got = evidence.assign(cost)
        assert (len(got), -sum(int(cost[e]) for e in got)) == best


def test_local_channel_of_repetition_and_of_itself():
    """Lifts of a bag with itself, and of a wall of equal tiles."""
    own = np.random.default_rng(3).integers(0, 1 << 63, 8).astype(np.uint64)
    wall = np.full(8, 0xDEADBEEF01234567, np.uint64)
    a, b = evidence.local_channel(own, own), evidence.local_channel(wall, wall)
    assert (a["matches"], a["w"], a["lift_raw"], a["margin"], a["diversity"]) == (8, 80000, 4444, 4444, 10000)
    assert (b["matches"], b["w"], b["lift_raw"], b["margin"], b["diversity"]) == (8, 10000, 2500, 2500, 1250)
    assert not evidence.local_channel(own[:3], own)["measurable"]


def test_controls_keep_distances():
    x = np.random.default_rng(1).integers(0, 1 << 63, 20).astype(np.uint64)
    d = evidence.distances(x, x)
    assert all((evidence.distances(y, y) == d).all() for y in evidence.controls(x))
    assert int(evidence.reversed_bits(np.array([1, 6], np.uint64))[1]) == 0x6 << 60


def test_coherence_of_moved_places():
    at = np.random.default_rng(2).integers(0, 60000, (12, 2))
    moved = evidence.coherence(at, at + 700)
    assert (moved["measurable"], moved["value"], moved["inliers"], moved["scale"]) == (True, 10000, 12, 256)
    assert not evidence.coherence(at[:3], at[:3])["measurable"]


def test_votes_of_a_known_correspondence(spark):
    row = spark.createDataFrame([(1, 10000, 10000, 0, 256, 20000, 10000, 0, 256, 10, 1)], "s int, ax int, ay int, a_sector int, a_side int, bx int, by int, b_sector int, b_side int, weight int, conf int")
    got = {(r.cell, r.share) for r in evidence.vote_cells(row).collect()}
    assert got == {(c, 64) for c in CELLS} | {(c, 24) for c in SOFT}
    assert {r.cell for r in evidence.vote_cells(row, soft=False).collect()} == set(CELLS)


def test_a_moved_picture_is_found_again(spark):
    """Correspondences of one transformation, and some that have none."""
    pick = random.Random(4)
    rows = []
    for k in range(30):
        x, y = pick.randrange(4000, 50000), pick.randrange(4000, 50000)
        bx, by = (x + 3200, y + 1600) if k < 20 else (pick.randrange(65536), pick.randrange(65536))
        rows.append((1, k, k, x, y, 5, 400, bx, by, 5, 400, 64 * 64, 64))
    df = spark.createDataFrame(rows, "s int, i int, j int, ax int, ay int, a_sector int, a_side int, bx int, by int, b_sector int, b_side int, weight int, conf int")
    votes = evidence.vote_cells(df)
    (m,) = evidence.verified(votes, evidence.vote_peaks(votes, ["s"]), ["s"]).collect()
    assert 20 <= m.inliers <= 21 and abs(m.r00 - 65536) < 300 and abs(m.r10) < 300 and m.error <= 4


def _lcg(seed):
    out = []
    for _ in range(8):
        seed = (seed * 1664525 + 1013904223) & 0xFFFFFFFF
        out.append(seed)
    return out


def test_selection_by_quality_of_known_points():
    words = [_lcg(0xABCD0000 + i) if i % 2 == 0 else _lcg(0x5EED1234) for i in range(40)]
    desc = np.array(words, np.uint32).view(np.uint64)
    i = np.arange(40)
    for want, picked in SELECTED.items():
        assert keypoints.select_by_quality(desc, i % 4 * 16000 + 4000, i // 4 % 4 * 16000 + 4000, i % 3, 65535 - i * 700, want) == picked


def _busy(seed, w=288, h=200):
    pick = np.random.default_rng(seed)
    px = np.full((h, w, 4), 255, np.uint8)
    for _ in range(120):
        y, x = pick.integers(0, h), pick.integers(0, w)
        px[y : y + pick.integers(3, 30), x : x + pick.integers(3, 30), :3] = pick.integers(0, 256, 3)
    return px


def test_key_points_of_a_mirrored_picture_are_mirrored():
    px = _busy(1)
    k, m = (keypoints.keypoints(images.Indexed(x)) for x in (px, px[:, ::-1]))
    own = lambda k, turn: {(tuple(d[2:] + d[:2]) if turn else tuple(d), y) for d, y, lv in zip(k["desc"].tolist(), k["y"].tolist(), k["level"].tolist(), strict=True) if lv == 0}
    a, b = own(k, False), own(m, True)
    assert len(a) > 20 and len(a & b) > 0.6 * len(a)  # the first level has no blocks, so only suppression differs


def test_pattern_and_ladder():
    p = keypoints.pattern()
    assert p.shape == (256, 4) and np.abs(p).max() <= 15 and (p[128:] == p[:128] * [1, -1, 1, -1]).all()
    assert keypoints.ladder(288)[:3] == [288, 222, 171] and keypoints.ladder(40) == [40]
    assert [keypoints.level_side(288, i) for i in range(3)] == [288, 222, 171]


def test_levels_and_boxes_by_definition():
    pick = np.random.default_rng(5)
    luma, opaque = pick.integers(0, 256, (23, 31)), pick.random((23, 31)) < 0.8
    got, whole = keypoints.level(luma, opaque, 7, 9, 13)
    for j in range(9):
        for i in range(13):
            y0, y1, x0, x1 = j * 23 // 9, (j + 1) * 23 // 9, i * 31 // 13, (i + 1) * 31 // 13
            block, o = luma[y0:y1, x0:x1], opaque[y0:y1, x0:x1]
            assert got[j, i] == (block[o].sum() // o.sum() if o.any() else 7) and whole[j, i] == (4 * o.sum() >= 3 * o.size)
    assert keypoints.box_sums(luma, 2)[5, 6] == luma[3:8, 4:9].sum()


def test_no_two_kept_corners_are_near():
    found = np.random.default_rng(6).integers(0, 60, (300, 3))
    kept = keypoints.suppress(found)
    d = ((kept[:, None, :2] - kept[None, :, :2]) ** 2).sum(-1)
    assert (d[~np.eye(len(kept), dtype=bool)] > 16).all()
    assert all(((kept[:, :2] - f[:2]) ** 2).sum(1).min() <= 16 for f in found)


def test_damaged_pictures_have_reasons(spark):
    rows = [(1, 4, 4, b"short"), (2, None, 4, b""), (3, 96, 72, images.synthetic_image(3)), (4, 1, 1, bytes(4))]
    got = {r.work_id: r for r in keypoints.image_keypoints(spark.createDataFrame(rows, "work_id long, w int, h int, px binary")).collect()}
    assert (got[1].reason, got[2].reason, got[3].reason) == ("damaged", "damaged", None)
    assert got[4].points == [] and len(got[3].points) == len({(p.x, p.y, p.level) for p in got[3].points})


def test_streams_and_mixes():
    """Fixed value: the first draw of the public 64-bit mixer from 0."""
    assert int(mixers.mix64(np.array([0], np.uint64))[0]) == 0xE220A8397B1DCDAF
    assert len(set(mixers.stream(7, 1000).tolist())) == 1000 and (mixers.stream(7, 5) == mixers.stream(7, 9)[:5]).all()


def test_compaction_drops_only_what_is_dead(spark):
    sig = spark.createDataFrame([(i, 3, [i, i + 1, 0, 0, 0, 0], [0] * 8, [0] * 8) for i in range(8)], "id long, present int, cells array<int>, local array<int>, band array<int>")
    postings = signatures.add(None, sig, 1)
    gone = signatures.remove(None, sig.where("id < 4"), 1)
    kept, none = signatures.compacted(postings, gone)
    assert kept.count() == 8 and none.count() == 0
    same, still = signatures.compacted(postings, signatures.remove(None, sig.where("id = 1"), 1))
    assert same.count() == 16 and still.count() == 1 and signatures.live(same, still).count() == 14
    assert signatures.posting_keys(sig.where("id = 2")).where(F.col("k") == (1 << 24) + 3).count() == 1

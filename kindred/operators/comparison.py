"""Two pictures compared: records from pixels, the channels over them, geometry under controls, and the verdict.

A picture's record is made once and is bounded (128 local codes, 512 key points). A pair is one row of two records and
one call of a kernel, which measures everything; the rules that judge it are a column expression (``functions.verdict``).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import ints
from kindred.functions.mixers import mix32
from kindred.functions.verdict import CURRENT, Calibration, verdict
from kindred.operators import evidence, images, keypoints, regions
from kindred.operators.images import ADJACENT, Indexed

SCALE = 10_000
#: Windows of local codes, the radius in which a peak is the highest, and the most codes kept.
WINDOWS, PEAK, CODES = (8, 16), 5, 128
#: Shifts of tones that make a control, how far tones may differ, and the bounds of a correspondence.
SHIFTS, TONE, PALETTE_REACH = (85, 128, 171), 16, 96
HAMMING, LOWE, MARGIN, MODELS, INLIERS, PEAK_MEMBERS, ENOUGH, SURE = 88, (82, 100), 6, 4, 6, 3, 8, 16


# ---- records ----
def local_codes(im: Indexed, windows: tuple[int, ...] = WINDOWS, most: int = CODES) -> tuple[np.ndarray, np.ndarray]:
    """Codes of windows about the peaks of content, and their middles; the ``most`` whose mixed keys are least.

    What is kept depends on a window's own content only, so that a part of a picture keeps the codes it has alone.
    """
    h, w = im.index.shape
    tone = np.where(im.index >= 0, im.quantile[np.maximum(im.index, 0)], -1) if len(im.quantile) else np.full((h, w), -1)
    none = np.empty(0, np.uint64), np.empty((0, 2), np.int64)
    if min(h, w) <= 2 * PEAK:
        return none
    near = sliding_window_view(tone, (3, 3)).reshape(h - 2, w - 2, 9)
    gap = np.where(near < 0, 64, np.abs(near - near[..., 4:5]))
    energy = gap.sum(-1)
    tie = np.zeros(energy.shape, np.uint32)
    for k in range(9):
        tie = tie * np.uint32(31) + gap[..., k].astype(np.uint32)
    rank = energy.astype(np.uint64) << np.uint64(32) | mix32(tie.astype(np.uint64) << np.uint64(32) | energy.astype(np.uint64))
    height = np.zeros((h, w), np.uint64)
    height[1:-1, 1:-1] = np.where((near[..., 4] >= 0) & (energy > 0), rank, 0)
    padded = np.pad(height, PEAK)
    top = sliding_window_view(sliding_window_view(padded, 2 * PEAK + 1, axis=0).max(-1), 2 * PEAK + 1, axis=1).max(-1)
    inner = np.zeros((h, w), bool)
    inner[PEAK : h - PEAK, PEAK : w - PEAK] = True
    y, x = np.nonzero(inner & (height > 0) & (height == top))
    value = np.where(tone < 0, 257, 2 * (tone + 1))
    codes, places = [], []
    for win in dict.fromkeys(windows):
        if min(h, w) < win or not len(x):
            continue
        spots = set()
        for px, py in zip(x.tolist(), y.tolist(), strict=True):
            # a window of an even side has two middles along each axis
            spots |= {(min(max(a, 0), w - win), min(max(b, 0), h - win)) for a in {(2 * px + 1 - win) >> 1, (2 * px + 2 - win) >> 1} for b in {(2 * py + 1 - win) >> 1, (2 * py + 2 - win) >> 1}}
        at = np.array(sorted(spots, key=lambda s: (s[1], s[0])), np.int64)
        views = sliding_window_view(value, (win, win))[at[:, 1], at[:, 0]]
        solid = ((views != 257).sum((1, 2)) * 4 >= win * win * 3)
        at, views, q = at[solid], views[solid], win // 8
        cells = np.sort(views.reshape(-1, 8, q, 8, q).transpose(0, 1, 3, 2, 4).reshape(-1, 8, 8, q * q), axis=-1)[..., (q * q) >> 1]
        codes.append(canonical_codes(cells))
        places.append(at + (win >> 1))
    if not codes:
        return none
    code, place = np.concatenate(codes), np.concatenate(places)
    set_bits = np.bitwise_count(code)
    use = (set_bits >= 6) & (set_bits <= 58)
    code, place = code[use], place[use]
    code, first = np.unique(code, return_index=True)
    place = place[first]
    kept = np.sort(np.lexsort((code, mix32(code)))[:most])
    return code[kept], np.clip(place[kept] * 65535 // max(h, w), 0, 65535)


def canonical_codes(cells: np.ndarray) -> np.ndarray:
    """``images.canonical_code`` of many windows at once."""
    if not len(cells):
        return np.empty(0, np.uint64)
    above = cells > np.sort(cells.reshape(-1, 64), axis=1)[:, 31][:, None, None]
    words = [np.packbits(np.rot90(x, k, (1, 2)).reshape(-1, 64), axis=1).view(">u8").reshape(-1).astype(np.uint64) for x in (above, above.transpose(0, 2, 1)) for k in range(4)]
    least = np.minimum.reduce(words)
    return np.minimum(least, ~np.maximum.reduce(words))


def boundaries(im: Indexed) -> list[list[int]]:
    """The most frequent pairs of neighbouring tones: quantiles and ranks, low and high, and the share of 65535 of the most frequent.

    Entries of the palette that have the same tones count together, so equal pictures with palettes in another order agree.
    """
    last = max(1, len(im.n) - 1)
    rank = im.rank * 255 // last
    counts: dict[tuple[int, ...], int] = {}
    a = np.concatenate([im.index[:, :-1].reshape(-1), im.index[:-1].reshape(-1)])
    b = np.concatenate([im.index[:, 1:].reshape(-1), im.index[1:].reshape(-1)])
    keep = (a >= 0) & (b >= 0) & (a != b)
    pairs, n = np.unique(np.minimum(a, b)[keep] * 256 + np.maximum(a, b)[keep], return_counts=True)
    for p, k in zip(pairs.tolist(), n.tolist(), strict=True):
        i, j = p >> 8, p & 255
        q, r = sorted((int(im.quantile[i]), int(im.quantile[j]))), sorted((int(rank[i]), int(rank[j])))
        counts[(*q, *r)] = counts.get((*q, *r), 0) + k
    top = sorted(counts.items(), key=lambda e: (-e[1], e[0]))[:ADJACENT]
    return [[*key, k * 65535 // top[0][1]] for key, k in top]


def colour_digest(im: Indexed, most: int = 16) -> list[list[int]]:
    """Colours and populations of the most frequent entries, for reports only."""
    return [[*map(int, im.colour[i]), min(255, int(im.n[i]) * 255 // int(im.n[0]))] for i in range(min(most, len(im.n)))]


RECORD = "work_id long, reason string, identity string, width int, height int, flat boolean, dct array<int>, palette array<array<int>>, edges array<array<int>>, runs array<array<int>>, codes array<bigint>, code_x array<int>, code_y array<int>, kp array<array<bigint>>, kp_x array<int>, kp_y array<int>, kp_level array<int>, kp_sector array<int>, kp_strength array<int>, colours array<array<int>>, shapes string, silhouette string, families string, words array<bigint>"


def _schema(ddl: str) -> pa.Schema:
    plain = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}

    def kind(name: str) -> pa.DataType:
        return pa.list_(kind(name[6:-1])) if name.startswith("array<") else plain[name]

    return pa.schema([(c.split()[0], kind(c.split()[1])) for c in ddl.split(", ")])


def record(w: int | None, h: int | None, px: bytes | None) -> dict:
    reason, im = images.indexed(w, h, px)
    names = [c.split()[0] for c in RECORD.split(", ")[1:]]
    if im is None:
        return dict.fromkeys(names) | {"reason": reason}
    thumb = images.thumbnail(im)
    code, at = local_codes(im)
    k = keypoints.keypoints(im)
    body = {
        "flat": bool(len(np.unique(thumb)) < 2), "dct": images.frequency_codes(thumb), "palette": images.palette_record(im), "edges": boundaries(im), "runs": images.run_histograms(im),
        "codes": code.view(np.int64).tolist(), "code_x": at[:, 0].tolist(), "code_y": at[:, 1].tolist(), "kp": k["desc"].view(np.int64).tolist(),
        **{f"kp_{c}": k[c].tolist() for c in ("x", "y", "level", "sector", "strength")}, "colours": colour_digest(im),
    }
    shapes, outline = regions.regions(im), regions.silhouette(im)
    whole = body | {"shapes": shapes, "silhouette": outline, "brightness": images.brightness(thumb), "width": im.index.shape[1], "height": im.index.shape[0]}
    body |= {"shapes": json.dumps(shapes), "silhouette": json.dumps(outline), "families": json.dumps(regions.families(whole)), "words": regions.route_words(whole)}
    return {"reason": None, "identity": hashlib.sha256(repr(sorted(body.items())).encode()).hexdigest(), "width": im.index.shape[1], "height": im.index.shape[0], **body}


def picture_records(pictures: DataFrame) -> DataFrame:
    """``RECORD`` of pictures ``work_id, w, h, px``; a damaged or oversized one has a reason and nothing else."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(RECORD)
        for part in parts:
            for i in range(part.num_rows):
                work, w, h, px = (part.column(c)[i].as_py() for c in ("work_id", "w", "h", "px"))
                yield pa.RecordBatch.from_pylist([{"work_id": work, **record(w, h, px)}], schema=schema)

    return pictures.select("work_id", "w", "h", "px").mapInArrow(batches, RECORD)


# ---- channels: (value, measurable) each, a value of 0 where the control explains all ----
def corrected(raw: int, control: int) -> int:
    return 0 if control >= SCALE else max(0, min(SCALE, (raw - control) * SCALE // (SCALE - control)))


def _blocks(codes: list[int]) -> list[list[tuple[np.ndarray, np.ndarray, int]]]:
    """The three levels of frequency blocks: signs, magnitude codes and bits."""
    out, at = [], 0
    for size, n, bits in ((16, 1, 2), (8, 4, 2), (4, 16, 4)):
        level = []
        for _ in range(n):
            x = np.array(codes[at : at + size * size], np.int64).reshape(size, size)
            level.append((x >> (bits - 1), x & ((1 << (bits - 1)) - 1), bits))
            at += size * size
        out.append(level)
    return out


def dct_channel(a: dict, b: dict) -> tuple[int, bool]:
    """Layout at three scales: the best of sixteen symmetries against their median. Flips and inversion only change signs."""
    if a["flat"] or b["flat"]:
        return 0, False
    one, two = _blocks(a["dct"]), _blocks(b["dct"])
    seen = []
    for inverted in (0, 1):
        for turned in (False, True):
            for across in (0, 1):
                for down in (0, 1):
                    means = []
                    for level, other in zip(one, two, strict=True):
                        g = int(len(level) ** 0.5)
                        total = 0
                        for k, (sign, size, bits) in enumerate(level):
                            n = len(sign)
                            odd = np.arange(n) & 1
                            s, m = (sign.T, size.T) if turned else (sign, size)
                            s = s ^ (across * odd)[None, :] ^ (down * odd)[:, None] ^ inverted
                            gx, gy = (k // g, k % g) if turned else (k % g, k // g)
                            gx, gy = g - 1 - gx if across else gx, g - 1 - gy if down else gy
                            to_sign, to_size, _ = other[gy * g + gx]
                            unlike = ((s ^ to_sign) + np.bitwise_count(m ^ to_size)).reshape(-1)[1:].sum()
                            total += max(0, SCALE - 2 * int(unlike) * SCALE // ((n * n - 1) * bits))
                        means.append(total // len(level))
                    seen.append((2 * means[0] + 2 * means[1] + means[2]) // 5)
    return corrected(max(seen), sorted(seen)[8]), True


def _greedy(cost: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """Each row in order with its nearest free column within reach, the first of equals."""
    free, out = np.ones(cost.shape[1], bool), []
    for i, row in enumerate(cost):
        if not free.any():
            break
        j = int(np.where(free, row, np.iinfo(np.int64).max).argmin())
        if row[j] <= reach:
            free[j] = False
            out.append((i, j))
    return out


def topology_channel(a: dict, b: dict, ranks: bool = False) -> tuple[int, bool]:
    """Shared boundaries between tones, against the same with the other's tones shifted."""
    x, y = (np.array(r["edges"], np.int64).reshape(-1, 5) for r in (a, b))
    if min(len(x), len(y)) < 3:
        return 0, False
    ends = slice(2, 4) if ranks else slice(0, 2)

    def shared(shift: int) -> int:
        to = np.sort(y[:, ends] + shift & 255, axis=1)
        both = sum(int(min(x[i, 4], y[j, 4])) for i, j in _greedy(np.abs(x[:, None, ends] - to[None]).sum(-1), 2 * TONE))
        either = int(x[:, 4].sum() + y[:, 4].sum()) - both
        return max(0, min(SCALE, both * SCALE // either)) if either > 0 else 0

    return corrected(shared(0), min(map(shared, SHIFTS))), True


def runs_channel(a: dict, b: dict) -> tuple[int, bool]:
    """Histograms of runs along three axes, against the nearest of the same turned by a quarter, half and three quarters."""
    x, y = (np.array(r["runs"], np.int64) for r in (a, b))
    flat = lambda h: all(int(axis.max()) * 100 >= int(axis.sum()) * 95 for axis in h if axis.sum())
    if flat(x) or flat(y):
        return 0, False
    alike = lambda k: max(0, SCALE - int(np.abs(x - np.roll(y, -k, axis=1)).sum()) * SCALE // 1530)
    return corrected(alike(0), min(SCALE, *map(alike, (4, 8, 12)))), True


def palette_channel(a: dict, b: dict) -> tuple[int, bool]:
    """The share of one palette that the other explains, tones as they are or all inverted, whichever beats its own control by more."""
    x, y = (np.array(r["palette"], np.int64).reshape(-1, 4) for r in (a, b))
    if min(len(x), len(y)) < 2:
        return 0, False

    def explained(x: np.ndarray, y: np.ndarray, shift: int) -> int:
        far = np.abs(x[:, None, 3] - (y[None, :, 3] + shift & 255)) * 2 + np.abs(x[:, None, 1] - y[None, :, 1])
        total = int(x[:, 1].sum())
        return sum(int(x[i, 1]) for i, _ in _greedy(far, PALETTE_REACH)) * SCALE // total if total else 0

    best = 0
    for z in (y, np.column_stack([y[:, :2], 255 - y[:, 2:]])):
        both = lambda shift, z=z: min(explained(x, z, shift), explained(z, x, shift))
        best = max(best, corrected(both(0), min(map(both, SHIFTS))))
    return best, True


# ---- geometry ----
def _side(r: dict) -> dict[str, np.ndarray]:
    longest = max(r["width"], r["height"])
    level = np.array(r["kp_level"], np.int64)
    sizes = np.array([keypoints.level_side(longest, k) for k in range(int(level.max(initial=0)) + 1)], np.int64)
    return {"desc": np.array(r["kp"], np.int64).reshape(-1, 4).view(np.uint64), "side": sizes[level], **{c: np.array(r[f"kp_{c}"], np.int64) for c in ("x", "y", "sector", "strength")}}


def mirrored(s: dict[str, np.ndarray], width: int, longest: int) -> dict[str, np.ndarray]:
    """A side as its mirror image has it: descriptors with their halves swapped, places and directions reflected."""
    most = min(65535, max(0, (width - 1) * 65535 // longest))
    return s | {"desc": s["desc"][:, [2, 3, 0, 1]], "x": most - s["x"], "sector": 32 - s["sector"] & 63}


def correspondences(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    """Rows ``(i, j, confidence, weight)`` of key points that are each other's nearest, clearly."""
    if min(len(a["x"]), len(b["x"])) < 2:
        return np.empty((0, 4), np.int64)
    d = np.zeros((len(a["x"]), len(b["x"])), np.int64)
    for k in range(4):
        d += np.bitwise_count(a["desc"][:, k][:, None] ^ b["desc"][:, k][None, :])
    j = d.argmin(1)
    i = np.arange(len(d))
    first = d[i, j]
    second_a, second_b = np.partition(d, 1, axis=1)[:, 1], np.partition(d, 1, axis=0)[1][j]
    second = np.minimum(second_a, second_b)
    good = (d.argmin(0)[j] == i) & (first <= HAMMING) & (first * LOWE[1] < LOWE[0] * second) & (second - first >= MARGIN)
    i, j, first, second = i[good], j[good], first[good], second[good]
    sure = 1 + (second - first) * 63 // np.maximum(second, 1)
    s, t = np.maximum(a["strength"][i], 1), np.maximum(b["strength"][j], 1)
    return np.stack([i, j, sure, sure * np.clip(np.minimum(s, t) * 64 // np.maximum(s, t), 32, 64)], 1)


def _cells(a: dict[str, np.ndarray], b: dict[str, np.ndarray], c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Votes of correspondences: their numbers, cells and shares; ``evidence.vote_cells`` in arrays."""
    i, j = c[:, 0], c[:, 1]
    q = np.clip(a["side"][i] * 65536 // np.maximum(b["side"][j], 1), 1, 1 << 24)
    inside = (q >= evidence.STEPS[0] >> 1) & (q <= evidence.STEPS[-1] << 1)
    scale = np.abs(q[:, None] - evidence.STEPS).argmin(1)
    turn = b["sector"][j] - a["sector"][i] & 63
    cos, sin = keypoints.COS10[turn], keypoints.SIN10[turn]
    ten = lambda v: np.sign(v) * (np.abs(v) + 512 >> 10)
    options = [[(scale, evidence.OWN, inside), (scale - 1, evidence.BESIDE, inside & (scale > 0)), (scale + 1, evidence.BESIDE, inside & (scale < 24))]]
    options.append([(turn >> 2, 1, inside), (np.where(turn & 3 >= 2, (turn >> 2) + 1, (turn >> 2) + 15) & 15, 1, inside)])
    for to, moved in ((b["x"][j], a["x"][i] * cos - a["y"][i] * sin), (b["y"][j], a["x"][i] * sin + a["y"][i] * cos)):
        v = to - (q * ten(moved) >> 16) + evidence.OFFSET
        own = np.clip(v // evidence.PLACE, 0, evidence.PLACES - 1)
        beside = np.where((v - own * evidence.PLACE) * 2 >= evidence.PLACE, own + 1, own - 1)
        options.append([(own, 1, inside), (beside, 1, inside & (beside >= 0) & (beside < evidence.PLACES))])
    rows, cells, shares = [], [], []
    for s, sw, so in options[0]:
        for r, _, _ in options[1]:
            for x, _, xo in options[2]:
                for y, _, yo in options[3]:
                    ok = np.flatnonzero(so & xo & yo)
                    rows.append(ok)
                    cells.append((((s * 16 + r) * evidence.PLACES + x) * evidence.PLACES + y)[ok])
                    shares.append(np.full(len(ok), sw))
    return np.concatenate(rows), np.concatenate(cells), np.concatenate(shares)


def _fit(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> tuple[int, int, int, int] | None:
    if len(ax) < 2:
        return None
    zero = lambda s, n: abs(s) // n * (1 if s >= 0 else -1)
    mid = [zero(int(v.sum()), len(v)) for v in (ax, ay, bx, by)]
    x, y, u, v = (p - m for p, m in zip((ax, ay, bx, by), mid, strict=True))
    size = int((x * x + y * y).sum())
    if not size:
        return None
    r, s = zero(int((x * u + y * v).sum()) * 65536, size), zero(int((x * v - y * u).sum()) * 65536, size)
    return r, s, mid[2] - (r * mid[0] - s * mid[1] >> 16), mid[3] - (s * mid[0] + r * mid[1] >> 16)


def hough(a: dict[str, np.ndarray], b: dict[str, np.ndarray], c: np.ndarray, tolerance: int = 100) -> np.ndarray:
    """Which correspondences agree with the transformation that most of them vote for, fitted twice."""
    none = np.zeros(len(c), bool)
    if len(c) < ENOUGH:
        return none
    row, cell, share = _cells(a, b, c)
    if not len(row):
        return none
    keys, at = np.unique(cell, return_inverse=True)
    mass = np.bincount(at, c[row, 3] * share // evidence.OWN)
    members, sure = np.bincount(at), np.bincount(at, c[row, 2])
    best = np.lexsort((keys, -sure, -members, -mass))[0]
    chosen = np.unique(row[at == best])
    if len(chosen) < PEAK_MEMBERS:
        return none
    p = [v >> 4 for v in (a["x"][c[:, 0]], a["y"][c[:, 0]], b["x"][c[:, 1]], b["y"][c[:, 1]])]
    model = _fit(*(v[chosen] for v in p))
    for close in (tolerance**2 * 9 // 4, tolerance**2):
        if model is None:
            return none
        r, s, tx, ty = model
        error = ((r * p[0] - s * p[1] >> 16) + tx - p[2]) ** 2 + ((s * p[0] + r * p[1] >> 16) + ty - p[3]) ** 2
        agree = error <= close
        if close != tolerance**2 and agree.sum() >= 2:
            model = _fit(*(v[agree] for v in p)) or model
    return agree


def models(a: dict[str, np.ndarray], am: dict[str, np.ndarray], b: dict[str, np.ndarray], direct: np.ndarray, mirror: np.ndarray) -> list[tuple[bool, np.ndarray]]:
    """Transformations found one after the other, of the picture or its mirror image; what one explains is used up.

    A key point whose place an earlier model covers does not count again, so a second model is a second place.
    """
    pools = [direct, mirror]
    found: list[tuple[bool, np.ndarray]] = []
    while len(found) < MODELS:
        tried = [hough(side, b, pool) for side, pool in zip((a, am), pools, strict=True)]
        best = int(tried[1].sum() > tried[0].sum())
        if tried[best].sum() < INLIERS:
            break
        used = pools[best][tried[best]]
        found.append((bool(best), used))
        reach = np.minimum(65535, 65535 * keypoints.PATCH // np.maximum(b["side"][used[:, 1]], 1))
        for k, pool in enumerate(pools):
            dx = b["x"][pool[:, 1]][:, None] - b["x"][used[:, 1]][None]
            dy = b["y"][pool[:, 1]][:, None] - b["y"][used[:, 1]][None]
            pools[k] = pool[~((dx * dx + dy * dy <= reach[None] ** 2).any(1) | np.isin(pool[:, 0], used[:, 0]))]
    return found


def geometry(a: dict, b: dict) -> dict:
    """Inliers of all models, the most that any control gives, and what the models look like together.

    The controls deal the second side's key points out anew, shifted or reversed, and go the same way to the end.
    """
    x, y = _side(a), _side(b)
    xm = mirrored(x, a["width"], max(a["width"], a["height"]))
    direct, mirror = correspondences(x, y), correspondences(xm, y)
    found = models(x, xm, y, direct, mirror)
    inliers = sum(len(m) for _, m in found)
    control = 0
    for turn in ("2", "3", "5", "3/2", "reverse"):
        def dealt(c: np.ndarray, turn: str = turn) -> np.ndarray:
            n = len(c)
            if turn == "reverse":
                return np.column_stack([c[:, 0], c[::-1, 1], c[:, 2:]])
            shift = 2 * n // 3 if turn == "3/2" else n // int(turn)
            return np.column_stack([c[:, 0], np.roll(c[:, 1], -shift), c[:, 2:]]) if shift else c[:0]

        control = max(control, sum(len(m) for _, m in models(x, xm, y, dealt(direct), dealt(mirror))))
    share = lambda n: min(SCALE, n * SCALE // SURE)
    held = np.concatenate([m for _, m in found]) if found else np.empty((0, 4), np.int64)
    cx, cy = (np.minimum(3, y[c][held[:, 1]] * 4 >> 16) for c in ("x", "y"))
    box = int((cx.max() - cx.min() + 1) * (cy.max() - cy.min() + 1)) * SCALE // 16 if len(held) else 0
    topology = 3 if len(found) >= 2 else (4 if box >= 6000 else 2) if found else int(max(len(direct), len(mirror)) >= ENOUGH)
    return {
        "geo_measurable": min(len(x["x"]), len(y["x"])) >= ENOUGH, "inliers": inliers, "geo_control": control, "geo_margin": corrected(share(inliers), share(control)),
        "models": len(found), "topology": topology, "mirrored": any(m for m, _ in found), "geo_diversity": diversity(y, found),
    }


def diversity(b: dict[str, np.ndarray], found: list[tuple[bool, np.ndarray]]) -> int:
    """How independent the inliers are: shares of distinct places (40), scales (25), models (20) and looks (15)."""
    if not found:
        return 0
    j = np.unique(np.concatenate([m[:, 1] for _, m in found]))
    n = len(j)
    places = len(np.unique((b["y"][j] * 8 >> 16) * 8 + (b["x"][j] * 8 >> 16)))
    scales = len(np.unique(b["side"][j]))
    looks = 0
    for k in range(n):
        d = np.bitwise_count(b["desc"][j[:k]] ^ b["desc"][j[k]]).sum(1) if k else np.array([256])
        looks += int(d.min() >= keypoints.NEW_AT)
    part = lambda v, of: min(SCALE, v * SCALE // max(1, of))
    return (40 * part(places, min(n, 16)) + 25 * part(scales, min(n, 3)) + 20 * part(len(found), 2) + 15 * part(looks, n)) // 100


# ---- the comparator ----
MEASURED = (
    "a long, b long, reason string, identical boolean, local long, local_m boolean, dct long, dct_m boolean, topology_value long, topology_m boolean, runs long, runs_m boolean, palette long, palette_m boolean, shape long, shape_m boolean, silhouette long, silhouette_m boolean, "
    "coverage long, diversity long, geo_measurable boolean, inliers long, geo_control long, geo_margin long, models long, topology long, mirrored boolean, geo_diversity long"
)


def _coverage(x: list[int], y: list[int]) -> int:
    return len({(v * 4 >> 16) * 4 + (u * 4 >> 16) for u, v in zip(x, y, strict=True)}) * SCALE // 16


def measure(a: dict, b: dict) -> dict:
    """All evidence of a pair; the sides are taken in the order of their identities, so it is the same both ways."""
    if a["reason"] or b["reason"]:
        return {"reason": a["reason"] or b["reason"]}
    if a["identity"] > b["identity"]:
        a, b = b, a
    codes = [np.array(r["codes"], np.int64).view(np.uint64) for r in (a, b)]
    local = evidence.local_channel(*codes)
    covers = [_coverage([r["code_x"][p[k]] for p in local["pairs"]], [r["code_y"][p[k]] for p in local["pairs"]]) for k, r in enumerate((a, b))]
    out = {"reason": None, "identical": a["identity"] == b["identity"], "local": local["margin"], "local_m": local["measurable"], "coverage": min(covers), "diversity": local["diversity"], **geometry(a, b)}
    for name, (value, measurable) in (("dct", dct_channel(a, b)), ("topology_value", topology_channel(a, b)), ("runs", runs_channel(a, b)), ("palette", palette_channel(a, b)), ("shape", regions.shape_channel(*(json.loads(r["shapes"]) for r in (a, b)))), ("silhouette", regions.silhouette_channel(*(json.loads(r["silhouette"]) for r in (a, b))))):
        out |= {name: value, f"{name.removesuffix('_value')}_m": measurable}
    return out


def compare(pairs: DataFrame, records: DataFrame, c: Calibration = CURRENT) -> DataFrame:
    """``pairs`` (a, b) of ``records`` with their evidence and the verdict: ``state, code, class, basis, structural, certifiable``.

    A side that was refused makes the pair Indeterminate, with the reason; what cannot be measured has no part in the mean.
    """
    side = lambda n: records.select(F.col("work_id").alias(n), F.struct(*(k for k in records.columns if k != "work_id")).alias(f"r{n}"))
    names = [x.split()[0] for x in MEASURED.split(", ")]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(MEASURED)
        for part in parts:
            for i in range(part.num_rows):
                a, b, ra, rb = (part.column(k)[i].as_py() for k in ("a", "b", "ra", "rb"))
                row = dict.fromkeys(names) | measure(ra, rb) | {"a": a, "b": b}
                yield pa.RecordBatch.from_pylist([{k: row[k] for k in names}], schema=schema)

    rows = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "ra", "rb").mapInArrow(batches, MEASURED)
    return judged(rows, c)


def judged(rows: DataFrame, c: Calibration = CURRENT) -> DataFrame:
    """Measured pairs with their verdict under a calibration; the evidence need not be measured anew for another."""
    lut = lambda name, x: ints.lut(x, c.luts[name]) if name in c.luts else x
    of = lambda name, column: (lut(name, F.coalesce(F.col(column), F.lit(0).cast("long"))), F.coalesce(F.col(f"{name}_m"), F.lit(False)))
    values = {"local": of("local", "local"), "shape": of("shape", "shape"), "topology": of("topology", "topology_value"), "runs": of("runs", "runs"), "dct": of("dct", "dct"), "palette": of("palette", "palette"), "silhouette": of("silhouette", "silhouette")}
    some = lambda name: F.coalesce(F.col(name), F.lit(0).cast("long"))
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    geo = ints.clamp(ints.idiv(lut("geometry", some("geo_margin")) * lut("geo_diversity", some("geo_diversity")), SCALE), 0, SCALE)
    v = verdict(values, identical=yes("identical"), geo_measurable=yes("geo_measurable"), geo_evidence=geo, inliers=some("inliers"), topology_class=some("topology"), diversity=some("diversity"), coverage=some("coverage"), mirrored=yes("mirrored"), c=c)
    out = rows.withColumn("__v", v).select(*rows.columns, "__v.*")
    refused = F.col("reason").isNotNull()
    return out.withColumn("state", F.when(refused, "Indeterminate").otherwise(F.col("state"))).withColumn("code", F.when(refused, 5).otherwise(F.col("code"))).withColumn("class", F.when(refused, F.col("reason")).otherwise(F.col("class")))


def nominated(records: DataFrame, cap: int = 256, most: int = 32) -> DataFrame:
    """``a, b, weight``: pairs of works by shared local codes, rare codes weighing more; the ``most`` best of each work."""
    from kindred.operators import nomination, signatures

    keys = signatures.code_keys(records.where("reason IS NULL").select(F.col("work_id").alias("id"), F.explode("codes").alias("code")))
    found = nomination.nominate(keys, keys, cap=cap, k=most).where("query <> id")
    return found.groupBy(F.least("query", "id").alias("a"), F.greatest("query", "id").alias("b")).agg(F.max("codes").alias("weight"))


def copies(records: DataFrame, least: int = 3, c: Calibration = CURRENT) -> DataFrame:
    """From records to verdicts: nominated pairs compared, those of at least a state (3: copies) kept, the strongest first."""
    return compare(nominated(records), records, c).where(F.col("code").between(least, 4)).orderBy(F.desc("code"), F.desc("structural"), "a", "b")

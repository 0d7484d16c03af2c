"""Key points of a picture: a pyramid of scales, corners, orientations and binary descriptors, as an Arrow-batched kernel.

A mirrored picture has the mirrored key points: every step is exact in whole numbers and even or odd about the middle,
and orientations that are not unique are refused. All steps work on whole levels at once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame

from kindred.operators import images

#: The patch's and the margin's size, the corner's contrast, the radius of suppression and its circle.
PATCH, MARGIN, CONTRAST, RADIUS, MOST = 15, 24, 18, 4, 512
LEAST_LEVEL = 2 * MARGIN + 4
CIRCLE = ((0, -3), (1, -3), (2, -2), (3, -1), (3, 0), (3, 1), (2, 2), (1, 3), (0, 3), (-1, 3), (-2, 2), (-3, 1), (-3, 0), (-3, -1), (-2, -2), (-1, -3))
#: Shares of the four parts of a key point's quality, and the distance at which a descriptor counts as new.
STRENGTH, SPREAD, SCALES, NOVEL, NEW_AT = 40, 25, 20, 15, 16
_TURN = 2 * np.pi * np.arange(64) / 64
COS, SIN = np.rint(32768 * np.cos(_TURN)).astype(np.int64), np.rint(32768 * np.sin(_TURN)).astype(np.int64)
COS10, SIN10 = np.rint(1024 * np.cos(_TURN)).astype(np.int64), np.rint(1024 * np.sin(_TURN)).astype(np.int64)
POINTS = "work_id long, reason string, max_dim int, points array<struct<desc:array<bigint>,x:int,y:int,level:int,sector:int,strength:int>>, sketch array<int>"


def ladder(longest: int) -> list[int]:
    """The longer sides of the levels: each ten thirteenths of the last, rounded, while a level has room for the margin."""
    out = [longest]
    while (side := (out[-1] * 10 + 6) // 13) >= LEAST_LEVEL:
        out.append(side)
    return out


def level_side(longest: int, k: int) -> int:
    for _ in range(k):
        longest = (longest * 10 + 6) // 13
    return max(1, longest)


def _sums(x: np.ndarray) -> np.ndarray:
    return np.pad(x.astype(np.int64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))


def _boxes(sums: np.ndarray, y0: np.ndarray, y1: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    return sums[np.ix_(y1, x1)] - sums[np.ix_(y0, x1)] - sums[np.ix_(y1, x0)] + sums[np.ix_(y0, x0)]


def level(luma: np.ndarray, opaque: np.ndarray, fill: int, h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """A level's mean opaque luminance by block, and whether three quarters of the block are opaque."""
    cuts = []
    for size, n in ((luma.shape[0], h), (luma.shape[1], w)):
        lo = np.arange(n) * size // n
        cuts += [lo, np.minimum(np.maximum((np.arange(n) + 1) * size // n, lo + 1), size)]
    total, count = _boxes(_sums(np.where(opaque, luma, 0)), *cuts), _boxes(_sums(opaque), *cuts)
    area = (cuts[1] - cuts[0])[:, None] * (cuts[3] - cuts[2])[None, :]
    return np.where(count > 0, total // np.maximum(count, 1), fill), count * 4 >= area * 3


def box_sums(x: np.ndarray, r: int) -> np.ndarray:
    """Sums of the squares of side 2r + 1 about each place where one fits, 0 elsewhere."""
    k, out = 2 * r + 1, np.zeros(x.shape, np.int64)
    if min(x.shape) >= k:
        s = _sums(x)
        out[r : x.shape[0] - r, r : x.shape[1] - r] = s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]
    return out


def corners(luma: np.ndarray, opaque: np.ndarray) -> np.ndarray:
    """Rows ``(x, y, score)``: places with nine points of the circle in a row that are all brighter, or all darker, by more than the contrast."""
    h, w = luma.shape
    if h - 1 - MARGIN <= MARGIN or w - 1 - MARGIN <= MARGIN:
        return np.empty((0, 3), np.int64)
    inner = (slice(MARGIN, h - MARGIN), slice(MARGIN, w - MARGIN))
    centre = luma[inner]
    ring = np.stack([luma[MARGIN + dy : h - MARGIN + dy, MARGIN + dx : w - MARGIN + dx] for dx, dy in CIRCLE]) - centre
    found = np.zeros(centre.shape, bool)
    for side in (ring > CONTRAST, ring < -CONTRAST):
        nine = sliding_window_view(np.concatenate([side, side[:8]]), 9, axis=0).all(-1).any(0)
        found |= nine & (side[::4].sum(0) >= 3)
    found &= box_sums(opaque, PATCH)[inner] * 4 >= (2 * PATCH + 1) ** 2 * 3
    y, x = np.nonzero(found)
    return np.stack([x + MARGIN, y + MARGIN, np.abs(ring).sum(0)[y, x]], 1).astype(np.int64)


def suppress(found: np.ndarray, radius: int = RADIUS, most: int = MOST) -> np.ndarray:
    """Corners without a stronger kept one within the radius, the strongest first; of equals the upper, then the left one."""
    found = found[np.lexsort((found[:, 0], found[:, 1], -found[:, 2]))]
    kept: list[np.ndarray] = []
    alive = np.ones(len(found), bool)
    while len(kept) < most and alive.any():
        best = int(alive.argmax())
        kept.append(found[best])
        alive &= ((found[:, :2] - found[best, :2]) ** 2).sum(1) > radius * radius
    return np.array(kept, np.int64).reshape(-1, 3)


_DISC = np.array([(dx, dy) for dy in range(-7, 8) for dx in range(-7, 8) if dx * dx + dy * dy <= 49])


def sectors(threes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The direction of the mass about each place, of 64; -1 where it is not unique."""
    v = threes[y[:, None] + _DISC[:, 1], x[:, None] + _DISC[:, 0]]
    along = (v @ _DISC[:, 0])[:, None] * COS + (v @ _DISC[:, 1])[:, None] * SIN
    best = along.max(1)
    return np.where((along == best[:, None]).sum(1) == 1, along.argmax(1), -1)


def pattern() -> np.ndarray:
    """256 pairs of places ``(ax, ay, bx, by)``: 128 from a fixed generator, about normal, and their mirror images.

    Fixed values: the generator's factor, increment and start, and the sum of three draws less one and a half of their
    range, which wraps as 32-bit numbers do.
    """
    range_, state = 0x7FFFFFFF, 0x1234567
    half = ((3 * range_ + (1 << 31)) % (1 << 32) - (1 << 31)) >> 1
    draws = []
    for _ in range(128 * 4):
        total = -half
        for _ in range(3):
            state = (state * 1103515245 + 12345) & range_
            total += state
        size = (abs(total) * 21 + range_) // (2 * range_)
        draws.append(max(-PATCH, min(PATCH, size if total >= 0 else -size)))
    first = np.array(draws, np.int64).reshape(128, 4)
    return np.concatenate([first, first * np.array([1, -1, 1, -1])])


def _rounded(v: np.ndarray) -> np.ndarray:
    return np.sign(v) * ((np.abs(v) + 512) >> 10)


def descriptors(fives: np.ndarray, x: np.ndarray, y: np.ndarray, sector: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Four words of 64 comparisons of box sums at the pairs, turned by the orientation."""
    c, s = COS10[sector][:, None], SIN10[sector][:, None]
    at = []
    for px, py in ((pairs[:, 0], pairs[:, 1]), (pairs[:, 2], pairs[:, 3])):
        at.append(fives[y[:, None] + _rounded(px * s + py * c), x[:, None] + _rounded(px * c - py * s)])
    less = at[0] < at[1]
    return np.packbits(less, axis=1, bitorder="little").view(np.uint64)


def select_by_quality(desc: np.ndarray, x: np.ndarray, y: np.ndarray, scale: np.ndarray, strength: np.ndarray, want: int) -> list[int]:
    """Places of the ``want`` key points that are strong and new in place, scale and looks, one after the other.

    Scores only fall as others are taken, so an old score bounds the present one and only the first of the queue is scored anew.
    """
    n = min(len(x), 4 * want)
    power = np.clip(strength[:n].astype(np.int64) * 10_000 // max(1, int(strength[:n].max(initial=1))), 0, 10_000)
    cell = (y[:n].astype(np.int64) * 8 >> 16) * 8 + (x[:n].astype(np.int64) * 8 >> 16)
    in_cell, in_scale, nearest = np.zeros(64, np.int64), np.zeros(256, np.int64), np.full(n, 256)

    def score(i: int) -> int:
        new = min(10_000, int(nearest[i]) * (10_000 // NEW_AT))
        return int(STRENGTH * power[i] + SPREAD * (10_000 // (1 + in_cell[cell[i]])) + SCALES * (10_000 // (1 + in_scale[scale[i]])) + NOVEL * new) // 100

    queue = [(-score(i), i) for i in range(n)]
    heapq.heapify(queue)
    picked: list[int] = []
    while queue and len(picked) < want:
        old, i = queue[0]
        now = -score(i)
        if now != old:
            heapq.heapreplace(queue, (now, i))
            continue
        heapq.heappop(queue)
        picked.append(i)
        in_cell[cell[i]] += 1
        in_scale[scale[i]] += 1
        nearest = np.minimum(nearest, np.bitwise_count(desc[:n] ^ desc[i]).sum(1, dtype=np.int64))
    return picked


_PAIRS = pattern()


def keypoints(im: images.Indexed, want: int = MOST) -> dict[str, np.ndarray]:
    """Columns of the key points: ``desc, x, y, level, sector, strength``, in the order of their contents."""
    opaque = im.index >= 0
    luma = np.where(opaque, im.luma[np.maximum(im.index, 0)], 0) if len(im.luma) else np.zeros(im.index.shape, np.int64)
    seen = np.sort(luma[opaque])
    fill = int(seen[len(seen) >> 1]) if len(seen) else 128
    luma = np.where(opaque, luma, fill)
    h, w = luma.shape
    longest = max(h, w)
    found = []
    for k, side in enumerate(ladder(longest)):
        lw, lh = max(1, w * side // longest), max(1, h * side // longest)
        if min(lw, lh) < LEAST_LEVEL:
            continue
        small, whole = level(luma, opaque, fill, lh, lw)
        kept = suppress(corners(small, whole))
        if not len(kept):
            continue
        middle = max(1, int(np.sort(kept[:, 2])[len(kept) >> 1]))  # strengths are of their level, whose contrast falls as it shrinks
        x, y, s = kept.T
        sector = sectors(box_sums(small, 1), x, y)
        x, y, s, sector = (v[sector >= 0] for v in (x, y, s, sector))
        desc = descriptors(box_sums(small, 2), x, y, sector, _PAIRS)
        found.append((desc, np.clip(x * w // lw * 65535 // longest, 0, 65535), np.clip(y * h // lh * 65535 // longest, 0, 65535), np.full(len(x), k), sector, np.clip(s * 1024 // middle, 0, 65535)))
    if not found:
        return dict(zip(("desc", "x", "y", "level", "sector", "strength"), (np.empty((0, 4), np.uint64), *(np.empty(0, np.int64),) * 5), strict=True))
    desc, x, y, scale, sector, strength = (np.concatenate(v) for v in zip(*found, strict=True))
    order = np.lexsort((x, y, scale, -strength))
    if len(order) > want:
        picked = select_by_quality(desc[order], x[order], y[order], scale[order], strength[order], want)
        order = order[picked]
    halves = desc[order].view(np.uint32).reshape(-1, 8)
    order = order[np.lexsort((scale[order], y[order], x[order], halves[:, 1], halves[:, 0]))]
    return {"desc": desc[order], "x": x[order], "y": y[order], "level": scale[order], "sector": sector[order], "strength": strength[order]}


def sketch(k: dict[str, np.ndarray], want: int = 32) -> np.ndarray:
    """Places of the strongest, in the order of their contents: what a search works with where the rest is not at hand."""
    best = np.lexsort((k["y"], k["x"], -k["strength"]))[:want]
    first = np.ascontiguousarray(k["desc"][best]).view(np.uint32).reshape(-1, 8)[:, 0]
    return best[np.lexsort((k["y"][best], k["x"][best], first))]


def image_keypoints(pictures: DataFrame, want: int = MOST) -> DataFrame:
    """``work_id, reason, max_dim, points, sketch`` of pictures ``work_id, w, h, px``; a damaged or oversized one has a reason and no points."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        point = pa.struct([("desc", pa.list_(pa.int64())), ("x", pa.int32()), ("y", pa.int32()), ("level", pa.int32()), ("sector", pa.int32()), ("strength", pa.int32())])
        schema = pa.schema([("work_id", pa.int64()), ("reason", pa.string()), ("max_dim", pa.int32()), ("points", pa.list_(point)), ("sketch", pa.list_(pa.int32()))])
        for part in parts:
            for i in range(part.num_rows):
                work, w, h, px = (part.column(c)[i].as_py() for c in ("work_id", "w", "h", "px"))
                reason, im = images.indexed(w, h, px)
                row = {"work_id": work, "reason": reason, "max_dim": None, "points": None, "sketch": None}
                if im is not None:
                    k = keypoints(im, want)
                    words = k["desc"].view(np.int64).tolist()
                    rest = (k[c].tolist() for c in ("x", "y", "level", "sector", "strength"))
                    points = [dict(zip(("desc", "x", "y", "level", "sector", "strength"), v, strict=True)) for v in zip(words, *rest, strict=True)]
                    row |= {"max_dim": max(im.index.shape), "points": points, "sketch": sketch(k).tolist()}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return pictures.select("work_id", "w", "h", "px").mapInArrow(batches, POINTS)

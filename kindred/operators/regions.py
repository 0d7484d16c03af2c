"""Regions of a picture's tones, its silhouette, and the vectors by which the screening index places a picture.

All measures are whole numbers and come out alike for a picture's turns and flips: a region's rays are followed from its
exact middle, and orders end in what a turn does not change.
"""

from __future__ import annotations

import numpy as np

from kindred.operators.images import Indexed, components

SCALE = 10_000
#: Cells along the longer side at most, bands of tone, regions kept, and the bounds of the classes of roundness and elongation.
GRID, BANDS, REGIONS = 128, 8, 8
ROUND, LONG = (512, 1024, 2048, 4096, 8192, 16384, 32768), (320, 410, 512, 768, 1280, 2048, 4096)
_ANGLE = 2 * np.pi * np.arange(32) / 32
RAY_X, RAY_Y = np.rint(1024 * np.cos(_ANGLE)).astype(np.int64), np.rint(1024 * np.sin(_ANGLE)).astype(np.int64)
#: Where the eight turns and flips of a square send each ray.
TURNS = np.array([(sign * np.arange(32) + quarter) % 32 for sign in (1, -1) for quarter in (0, 8, 16, 24)])


def band_map(im: Indexed) -> np.ndarray:
    """The most frequent band of tone of each cell, the brightest of equals; -1 where most is transparent."""
    h, w = im.index.shape
    band = np.where(im.index >= 0, im.quantile[np.maximum(im.index, 0)] * BANDS >> 8, -1) if len(im.quantile) else np.full((h, w), -1)
    cell = max(1, -(-max(h, w) // GRID))
    if cell == 1:
        return band
    rows, cols = max(4, -(-h // cell)), max(4, -(-w // cell))
    at = (np.arange(h) // cell)[:, None] * cols + (np.arange(w) // cell)[None]
    n = np.bincount((at * (BANDS + 1) + band + 1).reshape(-1), minlength=rows * cols * (BANDS + 1)).reshape(rows, cols, BANDS + 1)
    return BANDS - 1 - n[..., ::-1].argmax(-1)


def outline(mask: np.ndarray) -> int:
    """Cells of a region with a side that is not the region's."""
    p = np.pad(mask, 1)
    inner = p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
    return int((mask & ~inner).sum())


def holes(mask: np.ndarray) -> int:
    """Parts of the box that the region closes in on all sides."""
    parts = components(np.where(mask, -1, 0))
    edge = np.unique(np.concatenate([parts[0], parts[-1], parts[:, 0], parts[:, -1]]))
    return int(parts.max()) + 1 - int((edge >= 0).sum()) if (parts >= 0).any() else 0


def rays(mask: np.ndarray) -> np.ndarray:
    """The furthest step along each of 32 directions from the exact middle at which the region is still there.

    A step that falls on a border between cells needs the cells on both sides.
    """
    y, x = np.nonzero(mask)
    area = len(x)
    unit, steps = 2048 * area, np.arange(1, sum(mask.shape) + 1)
    out = np.zeros(32, np.int64)
    padded = np.pad(mask, 1)
    h, w = mask.shape
    for k in range(32):
        inside = np.ones(len(steps), bool)
        cells = []
        for total, ray, size in ((int(x.sum()), RAY_X[k], w), (int(y.sum()), RAY_Y[k], h)):
            at = 2048 * total + 1024 * area + steps * (2 * area * int(ray))
            upper = at // unit
            cells.append((np.clip(upper - (at % unit == 0), -1, size) + 1, np.clip(upper, -1, size) + 1))
        for cx in cells[0]:
            for cy in cells[1]:
                inside &= padded[cy, cx]
        out[k] = steps[inside].max(initial=0)
    return out


def profile(extents: np.ndarray) -> np.ndarray:
    """Rays as shares of 255 of the longest."""
    return extents * 255 // max(1, int(extents.max()))


def canonical_profile(p: np.ndarray) -> tuple[int, ...]:
    return min(tuple(p[t].tolist()) for t in TURNS)


def regions(im: Indexed, most: int = REGIONS) -> list[dict]:
    """The largest regions of one band: area, outline, box, holes and profile."""
    bands = band_map(im)
    label = components(bands)
    if label.max(initial=-1) < 0:
        return []
    area = np.bincount(label[label >= 0])
    least = np.sort(area)[::-1][: most][-1]
    found = []
    for k in np.flatnonzero(area >= least).tolist():
        y, x = np.nonzero(label == k)
        box = slice(y.min(), y.max() + 1), slice(x.min(), x.max() + 1)
        mask = label[box] == k
        p, band = profile(rays(mask)), int(bands[y[0], x[0]])
        r = {"area": int(area[k]), "outline": outline(mask), "w": mask.shape[1], "h": mask.shape[0], "holes": holes(mask), "profile": p.tolist(), "band": band}
        found.append(((-r["area"], -r["outline"], -r["holes"], -max(mask.shape), -min(mask.shape), canonical_profile(p), min(band, BANDS - 1 - band), k), r))
    return [r for _, r in sorted(found, key=lambda f: f[0])[:most]]


def silhouette(im: Indexed) -> dict | None:
    """The largest opaque part: profile, spread along the axes, filling, elongation, holes, and an 8 x 8 map of where it is.

    A picture without transparency has none.
    """
    opaque = im.index >= 0
    if opaque.all() or not opaque.any():
        return None
    label = components(np.where(opaque, 0, -1))
    area = np.bincount(label[label >= 0])
    y, x = np.nonzero(label == int(area.argmax()))
    mask = label[y.min() : y.max() + 1, x.min() : x.max() + 1] == int(area.argmax())
    y, x = np.nonzero(mask)
    h, w = mask.shape
    n, size = len(x), max(h, w)
    spread = [int(n * (v * v).sum() - int(v.sum()) ** 2) * 3060 // (n * n * size * size) for v in (x, y)]
    filled = np.zeros((8, 8), bool)
    for j in range(8):
        for i in range(8):
            part = mask[j * h // 8 : max((j + 1) * h // 8, j * h // 8 + 1), i * w // 8 : max((i + 1) * w // 8, i * w // 8 + 1)]
            filled[j, i] = 2 * part.sum() >= part.size
    return {"profile": profile(rays(mask)).tolist(), "spread": [min(255, s) for s in spread], "fill": n * 255 // (h * w), "w": w, "h": h, "holes": min(255, holes(mask)), "map": filled.reshape(-1).astype(int).tolist(), "outline": outline(mask)}


# ---- channels ----
def _alignments(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Agreement of two profiles under all 64 alignments: 32 turns, plain and flipped."""
    places = (np.arange(32)[None] + np.arange(32)[:, None]) % 32
    both = np.concatenate([q[places], q[(-places) % 32]])
    return SCALE - np.abs(p[None] - both).sum(1) * SCALE // (32 * 255)


def _corrected(raw: int, control: int) -> int:
    return 0 if control >= SCALE else max(0, min(SCALE, (raw - control) * SCALE // (SCALE - control)))


def shape_channel(a: list[dict], b: list[dict]) -> tuple[int, bool]:
    """Regions paired one to one by how well their profiles align, against the middle alignment, weighted by area."""
    if min(len(a), len(b)) < 2:
        return 0, False
    pairs = []
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            s = np.sort(_alignments(np.array(x["profile"]), np.array(y["profile"])))
            like = min(x["area"], y["area"]) * SCALE // max(x["area"], y["area"])
            pairs.append((-int(s[-1]) * like // SCALE, i, j, int(s[-1]), int(s[32]), like))
    used_a, used_b, raw, control = set(), set(), 0, 0
    for _, i, j, best, middle, like in sorted(pairs):
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            weight = min(a[i]["area"], b[j]["area"])
            raw, control = raw + weight * (best * like // SCALE), control + weight * (middle * like // SCALE)
    total = max(sum(r["area"] for r in a), sum(r["area"] for r in b))
    return _corrected(raw // total, control // total), True


def silhouette_channel(a: dict | None, b: dict | None) -> tuple[int, bool]:
    """The better of the eight turns of the map, against the middle one, together with the profiles."""
    if a is None or b is None:
        return 0, False
    x, y = (np.array(s["map"]).reshape(8, 8) for s in (a, b))
    same = sorted(int((x == t).sum()) * SCALE // 64 for z in (y, y.T) for t in (np.rot90(z, k) for k in range(4)))
    rays_ = np.sort(_alignments(np.array(a["profile"]), np.array(b["profile"])))
    raw, control = (same[-1] + int(rays_[-1])) // 2, (same[3] + int(rays_[32])) // 2
    return _corrected(raw, control), True


# ---- family vectors ----
def _shares(values: np.ndarray, weights: np.ndarray, bins: int) -> list[int]:
    n = np.bincount(values, weights, bins).astype(np.int64)[:bins] if len(values) else np.zeros(bins, np.int64)
    return (n * 255 // max(1, int(n.sum()))).tolist()


def _class(value: int, bounds: tuple[int, ...]) -> int:
    return int(np.searchsorted(bounds, value, side="right"))


def _long(w: int, h: int) -> int:
    return max(w, h) * 256 // max(1, min(w, h))


def families(r: dict) -> dict[str, list[int] | None]:
    """The six vectors of a record; a family that cannot be told is null.

    Each is blind to turns and flips: sums over axes, gaps and middles of tones, sorted rays, directions folded.
    """
    runs = np.array(r["runs"], np.int64)
    edges, palette = np.array(r["edges"], np.int64).reshape(-1, 5), np.array(r["palette"], np.int64).reshape(-1, 4)
    gap, level = edges[:, 1] - edges[:, 0], np.minimum(edges[:, 0], 255 - edges[:, 1])
    bright = r["brightness"]
    tone = [*_shares(gap >> 5, edges[:, 4], 8), *_shares(np.minimum(np.maximum(level, 0) >> 5, 3), edges[:, 4], 4), *_shares(edges[:, 3] - edges[:, 2] >> 5, edges[:, 4], 8)]
    tone += [bright[6], max(0, bright[4] - bright[2]), abs(bright[3] - 128) * 2, len(edges) * 5]
    eighth = palette[:, 3] >> 5
    tone += _shares(np.minimum(eighth, 7 - eighth), palette[:, 1], 4)
    pal = [*palette[1:24, 1].tolist(), *[0] * (24 - len(palette))][:23] + [len(palette) * 10]
    shapes, out = r["shapes"], {"runs": (runs[0] + runs[1]).tolist(), "tone": tone, "pal": pal}
    first = shapes[0]["area"] if shapes else 1
    v = [s["area"] * 255 // max(1, first) for s in shapes[1:]]
    v += [0] * (7 - len(v))
    for k in range(8):
        s = shapes[k] if k < len(shapes) else None
        v += [0, 0, 0] if s is None else [_class(s["outline"] ** 2 * 256 // s["area"], ROUND) * 36, _class(_long(s["w"], s["h"]), LONG) * 36, min(3, s["holes"]) * 85]
    cell = max(1, -(-max(r["width"], r["height"]) // GRID))
    whole = max(4, -(-r["width"] // cell)) * max(4, -(-r["height"] // cell))
    v += [len(shapes) * 32, min(255, (first if shapes else 0) * 255 // whole), *(sorted(shapes[0]["profile"])[2::4] if shapes else [0] * 8)]
    out["shape"] = v
    s = r["silhouette"]
    out["sil"] = None if s is None else [*sorted(s["profile"])[2::4], *sorted(s["spread"]), s["fill"], _class(_long(s["w"], s["h"]), LONG) * 36, s["holes"], *(255 * x for x in s["map"])]
    x, y = (np.array(r[f"kp_{c}"], np.int64) for c in ("x", "y"))
    if len(x) < 8:
        return out | {"kpgeo": None}
    n = len(x)
    dx, dy = x - int(x.sum()) // n, y - int(y.sum()) // n
    a, b, c = (int((p * q).sum()) // n for p, q in ((dx, dx), (dx, dy), (dy, dy)))
    root = lambda v: int(np.sqrt(float(v)))
    far = np.minimum(7, np.sqrt((dx * dx + dy * dy).astype(float)).astype(np.int64) * 4 // max(1, root(a + c)))
    bend = root((a - c) ** 2 + 4 * b * b)
    turn = np.array(r["kp_sector"], np.int64) & 15
    one = np.ones(n)
    out["kpgeo"] = [*_shares(far, one, 8), max(0, a + c - bend) * 255 // max(1, a + c + bend), *_shares(np.minimum(3, r["kp_level"]), one, 4), *_shares(np.minimum(turn, 16 - turn), one, 9), (n - 1).bit_length() * 25]
    return out


# ---- routes ----
def route_words(r: dict) -> list[int]:
    """Four words that screen a pair before anything is compared: frequencies, runs, boundaries, regions."""
    word = [0, 0, 0, 0]
    if not r["flat"]:
        low = np.array(r["dct"][:256]).reshape(16, 16) & 1
        places = [(s - u, u) for s in range(1, 31) for u in range(s // 2 + 1) if s - u < 16][:64]
        word[0] = sum(int(low[v, u] | low[u, v]) << k for k, (v, u) in enumerate(places))
    two = lambda v: int(np.searchsorted((1, 16, 64), v, side="right"))
    for i, (h, v) in enumerate(zip(r["runs"][0], r["runs"][1], strict=True)):
        word[1] |= two((h + v) // 2) << 2 * i | two(abs(h - v)) << 32 + 2 * i
    for q0, q1, _, _, _ in sorted(r["edges"], key=lambda e: -e[4])[:24]:
        word[2] |= 1 << (q1 - q0 >> 5) * 8 + (min(q0, 255 - q1) >> 5)
    codes = sorted((_class(s["outline"] ** 2 * 256 // s["area"], ROUND) | _class(_long(s["w"], s["h"]), LONG) << 3 | min(3, s["holes"]) << 6 for s in r["shapes"][:8]), reverse=True)
    word[3] = sum(c << 8 * i for i, c in enumerate(codes))
    return [w - (1 << 64) if w >> 63 else w for w in word]

"""The image front end: from pixels to an indexed picture and its records, as Arrow-batched kernels.

Images are rows ``work_id, w, h, px`` (RGBA bytes). A kernel reads each once and gives all records in one struct, so
pixels never travel. Damaged or oversized rows get a ``reason`` instead of records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kindred.functions.ints import RUN_LADDER

#: Limits of a picture, palette entries, and sizes of the records.
MAX_SIDE, MAX_PIXELS, MAX_COLOURS = 16384, 1 << 24, 255
PALETTE, ADJACENT, THUMB = 24, 48, 16
RECORDS = "work_id long, reason string, scale int, matte boolean, colours int, brightness array<int>, palette array<array<int>>, adjacency array<array<long>>, runs array<array<int>>, thumb array<int>"


def luma(rgb: np.ndarray) -> np.ndarray:
    return (rgb.astype(np.int64) @ np.array([77, 150, 29]) + 128) >> 8


def upscale_factor(px: np.ndarray) -> int:
    """The greatest factor by which the picture is a plain enlargement: it divides the sides and every place of change."""
    h, w = px.shape[:2]
    rows = np.flatnonzero((px[1:] != px[:-1]).any((1, 2))) + 1
    cols = np.flatnonzero((px[:, 1:] != px[:, :-1]).any((0, 2))) + 1
    return int(np.gcd.reduce(np.concatenate([[w, h], rows, cols])))


def fold_matte(px: np.ndarray, tolerance: int = 6) -> np.ndarray | None:
    """The picture with its flat backdrop made transparent, or None where there is no backdrop.

    The backdrop's colour is the border's most frequent one (sixteen levels a channel) if half the border has it; it is
    what connects to the border within the tolerance, and counts between 2 and 90 hundredths of the picture.
    """
    h, w = px.shape[:2]
    if w < 8 or h < 8 or (px[..., 3] > 8).mean() < 0.98:
        return None
    border = np.zeros((h, w), bool)
    border[[0, -1]] = border[:, [0, -1]] = True
    ring = px[border][:, :3].astype(np.int64)
    level = (ring >> 4) @ np.array([256, 16, 1])
    values, counts = np.unique(level, return_counts=True)
    if 2 * counts.max() < len(ring):
        return None
    colour = ring[level == values[counts.argmax()]].sum(0) // counts.max()
    near = (np.abs(px[..., :3].astype(np.int64) - colour) <= tolerance).all(-1)
    seen = near & border
    while True:  # grow by one step in each direction until nothing is added
        grown = seen.copy()
        grown[1:] |= seen[:-1]
        grown[:-1] |= seen[1:]
        grown[:, 1:] |= seen[:, :-1]
        grown[:, :-1] |= seen[:, 1:]
        grown &= near
        if (grown == seen).all():
            break
        seen = grown
    if not 0.02 <= seen.mean() <= 0.90:
        return None
    out = px.copy()
    out[..., 3][seen] = 0
    return out


class Indexed:
    """Palette index by pixel (-1 transparent), and the palette by population, the lesser key first of equals."""

    def __init__(self, px: np.ndarray):
        opaque = px[..., 3] >= 128
        rgb = px[..., :3].astype(np.int64)
        key = (rgb[..., 0] >> 3 << 11) | (rgb[..., 1] >> 3 << 6) | (rgb[..., 2] >> 3 << 1) | 1
        keys, place, n = np.unique(key[opaque], return_inverse=True, return_counts=True)
        order = np.lexsort((keys, -n))[:MAX_COLOURS]
        total = np.stack([np.bincount(place, rgb[..., c][opaque], len(keys)) for c in range(3)], 1).astype(np.int64) if len(keys) else np.zeros((0, 3), np.int64)
        self.colour = total[order] // n[order][:, None] if len(order) else np.zeros((0, 3), np.int64)
        slot = np.full(len(keys), -1)
        slot[order] = np.arange(len(order))
        for k in np.flatnonzero(slot < 0):  # colours beyond the palette go to the nearest
            part = np.array([keys[k] >> 11 & 31, keys[k] >> 6 & 31, keys[k] >> 1 & 31])
            slot[k] = int((((self.colour >> 3) - part) ** 2).sum(1).argmin())
        self.index = np.full(px.shape[:2], -1)
        self.index[opaque] = slot[place]
        self.key = keys[order]
        self.n = np.bincount(slot[place], minlength=len(order)) if len(order) else np.zeros(0, np.int64)
        self.luma = luma(self.colour)
        by_luma = np.lexsort((self.key, self.luma))
        self.rank = np.empty(len(order), np.int64)
        self.rank[by_luma] = np.arange(len(order))
        mass = self.n[by_luma]
        all_ = max(1, int(mass.sum()))
        self.quantile = np.empty(len(order), np.int64)
        self.quantile[by_luma] = np.clip(((2 * (np.cumsum(mass) - mass) + mass) * 255 + all_) // (2 * all_), 0, 255)


def cell_edges(size: int, cells: int) -> list[tuple[int, int]]:
    """Cells that touch: each from the floor of its beginning to the ceiling of its end."""
    return [(i * size // cells, max(-(-(i + 1) * size // cells), i * size // cells + 1)) for i in range(cells)]


def area_majority(im: Indexed, cells: int) -> np.ndarray:
    """The most frequent index of each cell, the brightest of equals, -1 below all."""
    h, w = im.index.shape
    rank = np.concatenate([[-1], im.rank])
    out = np.empty((cells, cells), np.int64)
    for j, (y0, y1) in enumerate(cell_edges(h, cells)):
        for i, (x0, x1) in enumerate(cell_edges(w, cells)):
            n = np.bincount(im.index[y0:y1, x0:x1].reshape(-1) + 1, minlength=len(rank))
            out[j, i] = np.lexsort((rank, n))[-1] - 1
    return out


def thumbnail(im: Indexed) -> np.ndarray:
    fill = int(np.sort(im.luma)[len(im.luma) >> 1]) if len(im.luma) else 128
    m = area_majority(im, THUMB)
    return np.where(m < 0, fill, im.luma[np.maximum(m, 0)] if len(im.luma) else fill)


def brightness(thumb: np.ndarray) -> list[int]:
    """Mean, five order statistics, their spread, and by quadrant whether it is above the mean and the first quartile."""
    flat = np.sort(thumb.reshape(-1))
    mean, (q5, q25, q50, q75, q95) = int(flat.sum()) // 256, (int(flat[i]) for i in (12, 64, 128, 192, 243))
    bits = 0
    for qy in (0, 8):
        for qx in (0, 8):
            m = int(thumb[qy : qy + 8, qx : qx + 8].sum()) // 64
            bits = bits << 2 | (m > mean) << 1 | (m > q25)
    return [mean, q5, q25, q50, q75, q95, q95 - q5, bits]


def palette_record(im: Indexed) -> list[list[int]]:
    top = int(im.n[0]) if len(im.n) else 1
    last = max(1, len(im.n) - 1)
    return [[i, min(255, (int(im.n[i]) * 255 + (top >> 1)) // top), int(im.rank[i]) * 255 // last, int(im.quantile[i])] for i in range(min(PALETTE, len(im.n)))]


def adjacency_record(im: Indexed) -> list[list[int]]:
    """The most frequent pairs of unequal neighbours: indices, and the share of 65535 of the most frequent."""
    a = np.concatenate([im.index[:, :-1].reshape(-1), im.index[:-1].reshape(-1)])
    b = np.concatenate([im.index[:, 1:].reshape(-1), im.index[1:].reshape(-1)])
    keep = (a >= 0) & (b >= 0) & (a != b)
    lo, hi = np.minimum(a, b)[keep], np.maximum(a, b)[keep]
    pairs, n = np.unique(lo * 256 + hi, return_counts=True)
    order = np.lexsort((pairs, -n))[:ADJACENT]
    return [[int(pairs[k] >> 8), int(pairs[k] & 255), int(n[k]) * 65535 // int(n[order[0]])] for k in order]


def _runs_of(line: np.ndarray) -> np.ndarray:
    edges = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1], [True]]))
    return np.diff(edges)


def run_histograms(im: Indexed) -> list[list[int]]:
    """Shares of 255 of the classes of runs along rows, columns and diagonals of two pixels or more."""
    h, w = im.index.shape
    lines = ([*im.index], [*im.index.T], [d for k in range(-h + 1, w) if len(d := im.index.diagonal(k)) >= 2])
    out = []
    for group in lines:
        runs = np.concatenate([_runs_of(x) for x in group]) if group else np.empty(0, np.int64)
        n = np.bincount(np.searchsorted(RUN_LADDER, runs), minlength=16)
        out.append([int(v) * 255 // max(1, int(n.sum())) for v in n])
    return out


def indexed(w: int | None, h: int | None, px: bytes | None) -> tuple[str | None, Indexed | None]:
    """Why a picture is refused, or its indexed form: backdrop folded, enlargement undone."""
    reason, im, _, _ = _normalised(w, h, px)
    return reason, im


def _normalised(w: int | None, h: int | None, px: bytes | None) -> tuple[str | None, Indexed | None, int, bool]:
    if w is None or h is None or px is None or w < 1 or h < 1 or len(px) != 4 * w * h:
        return "damaged", None, 1, False
    if w > MAX_SIDE or h > MAX_SIDE or w * h > MAX_PIXELS:
        return "limit", None, 1, False
    image = np.frombuffer(px, np.uint8).reshape(h, w, 4)
    folded = fold_matte(image)
    image = image if folded is None else folded
    k = upscale_factor(image)
    return None, Indexed(image[::k, ::k]), k, folded is not None


def records(w: int | None, h: int | None, px: bytes | None) -> tuple:
    """The columns of ``RECORDS`` after work_id."""
    reason, im, k, matte = _normalised(w, h, px)
    if im is None:
        return (reason, *(None,) * 8)
    thumb = thumbnail(im)
    return (None, k, matte, len(im.n), brightness(thumb), palette_record(im), adjacency_record(im), run_histograms(im), thumb.reshape(-1).tolist())


def image_records(images: DataFrame) -> DataFrame:
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for part in parts:
            for i in range(part.num_rows):
                row = {c: part.column(c)[i].as_py() for c in ("work_id", "w", "h", "px")}
                made = dict(zip(("reason", "scale", "matte", "colours", "brightness", "palette", "adjacency", "runs", "thumb"), records(row["w"], row["h"], row["px"]), strict=True))
                if schema is None:
                    ints, lists = pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))
                    schema = pa.schema([("work_id", pa.int64()), ("reason", pa.string()), ("scale", pa.int32()), ("matte", pa.bool_()), ("colours", pa.int32()), ("brightness", ints), ("palette", lists), ("adjacency", pa.list_(pa.list_(pa.int64()))), ("runs", lists), ("thumb", ints)])
                yield pa.RecordBatch.from_pylist([{"work_id": row["work_id"], **made}], schema=schema)

    return images.select("work_id", "w", "h", "px").mapInArrow(batches, RECORDS)


def synthetic_image(seed: int, w: int = 96, h: int = 72) -> bytes:
    """A picture of flat areas, lines and dots on a backdrop, the same for the same seed."""
    pick = np.random.default_rng(seed)
    colours = pick.integers(0, 256, (2 + seed % 14, 3))
    px = np.empty((h, w, 4), np.uint8)
    px[..., :3], px[..., 3] = colours[0], 255
    for _ in range(4 + seed % 9):
        x, y, c = int(pick.integers(0, w)), int(pick.integers(0, h)), colours[int(pick.integers(1, len(colours)))]
        px[y : y + int(pick.integers(2, h // 2)), x : x + int(pick.integers(2, w // 2)), :3] = c
    dots = pick.integers(0, [h, w], (40, 2))
    px[dots[:, 0], dots[:, 1], :3] = colours[-1]
    return px.tobytes()


def synthetic_images(spark: SparkSession, n: int) -> DataFrame:
    """``n`` pictures, of each four a plain one, its mirror, its threefold enlargement and a damaged one."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[list] = [[], [], [], []]
            for i in part.column("id").to_pylist():
                base = np.frombuffer(synthetic_image(i // 4), np.uint8).reshape(72, 96, 4)
                image = (base, base[:, ::-1], base.repeat(3, 0).repeat(3, 1), base[:10])[i % 4]
                for column, x in zip(out, (i, image.shape[1], 72 if i % 4 == 3 else image.shape[0], np.ascontiguousarray(image).tobytes()), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], ["work_id", "w", "h", "px"])

    return spark.range(n).mapInArrow(batches, "work_id long, w int, h int, px binary")


# ---- frequency blocks and symmetric codes ----
ONE = 1 << 14


def cosines(n: int) -> np.ndarray:
    """Rounded cosines, odd or even about the middle exactly."""
    u, i = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.rint(ONE * np.cos((2 * i + 1) * u * np.pi / (2 * n))).astype(np.int64)


def frequencies(block: np.ndarray) -> np.ndarray:
    """The transform of a square block, its exact double sum rounded once and alike for both signs, so that flips only change signs."""
    t = cosines(len(block))
    total = t @ block.astype(np.int64) @ t.T
    size = (np.abs(total) + (ONE * ONE >> 1)) >> 28
    return np.where(total < 0, -size, size)


def sign_and_magnitude(coefficients: np.ndarray, bits: int) -> list[int]:
    """For each coefficient its sign and the Gray code of its magnitude's class among the block's own; the first one, the mean, is left out."""
    flat = coefficients.reshape(-1)
    size = np.sort(np.abs(flat[1:]))
    levels = 1 << (bits - 1)
    cuts = [size[min(i * len(size) // levels, len(size) - 1)] for i in range(1, levels)]
    # the classes are counted in order up to the first cut that is not reached; the cuts rise, so a search says the same
    level = np.searchsorted(cuts, np.abs(flat), side="right")
    code = ((flat < 0).astype(np.int64) << (bits - 1)) | (level ^ level >> 1)
    code[0] = 0
    return code.tolist()


def frequency_codes(thumb: np.ndarray) -> list[int]:
    """The codes of one block of 16, four of 8 (2 bits each) and sixteen of 4 (4 bits each), one after the other."""
    out = sign_and_magnitude(frequencies(thumb), 2)
    for size, bits in ((8, 2), (4, 4)):
        for y in range(0, THUMB, size):
            for x in range(0, THUMB, size):
                out += sign_and_magnitude(frequencies(thumb[y : y + size, x : x + size]), bits)
    return out


def symmetries(cell: np.ndarray) -> list[np.ndarray]:
    """The eight turns and flips of a square."""
    return [np.rot90(x, k) for x in (cell, cell.T) for k in range(4)]


def canonical_code(cell: np.ndarray, fold_inverse: bool = True) -> int:
    """64 cells as one code: which lie above the median, the least over all turns and flips, and over the complement."""
    low = np.sort(cell.reshape(-1))[31]
    words = [int("".join("1" if b else "0" for b in (x > low).reshape(-1)), 2) for x in symmetries(cell)]
    if fold_inverse:
        words += [w ^ ((1 << 64) - 1) for w in words]
    return min(words)


def components(labels: np.ndarray) -> np.ndarray:
    """Regions of equal labels that touch at sides, numbered in the order of their first pixel; -1 where the label is negative."""
    h, w = labels.shape
    place = np.arange(h * w).reshape(h, w)
    place[labels < 0] = -1
    while True:  # the least place spreads within a region, by whole rows and columns at a time
        before = place.copy()
        for axis in (0, 1):
            for flip in (False, True):
                p, lab = (np.flip(place, axis), np.flip(labels, axis)) if flip else (place, labels)
                p, lab = (p, lab) if axis == 0 else (p.T, lab.T)
                for k in range(1, len(p)):
                    same = (lab[k] == lab[k - 1]) & (lab[k] >= 0)
                    np.minimum(p[k], p[k - 1], out=p[k], where=same)
        if (place == before).all():
            break
    out = np.full(labels.shape, -1)
    roots, numbered = np.unique(place[place >= 0], return_inverse=True)
    out[place >= 0] = numbered
    return out

"""Calibration artefacts: their bytes, and the identity that verdicts are stored beside.

An artefact is its head, whole numbers and tables of breakpoints. Its identity is the SHA-256 of its bytes; an artefact
that was tampered with, or that is out of range, is refused.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass, field, fields

from kindred.functions.ints import SCALE

Points = tuple[tuple[int, int], ...]
IDENTITY: Points = ((0, 0), (SCALE, SCALE))
NEUTRAL: Points = ((0, SCALE), (SCALE, SCALE))
#: The artefact's mark; tables by kind of container, in their order.
MARK = b"PCAL"
TABLES = ("local", "geometry", "diversity", "dct", "shape", "topology", "runs", "palette", "silhouette", "geo_diversity")
COMPARATORS = {1: (4, 3), 2: (41, 9), 3: (42, 10)}
_HEAD = "<4sHH16s4B10i9i7i3i"


def _n(value: int, low: int, high: int) -> int:
    return field(default=value, metadata={"range": (low, high)})


@dataclass(frozen=True)
class Profile:
    """All parameters of a comparator. The defaults are fixed values of the calibration CAL-004-PROPOSED."""

    name: str = "CAL-004-PROPOSED"
    container: int = 3
    evidence_rule: int = _n(0, 0, 0)
    scoring_rule: int = _n(1, 1, 1)
    endpoint_rule: int = _n(1, 1, 1)
    grid: int = _n(4, 2, 16)
    hamming: int = _n(8, 0, 128)
    confidence_at: int = _n(16, 1, 1 << 30)
    geo_confidence_at: int = _n(16, 1, 1 << 30)
    geo_tolerance: int = _n(1600, 0, 1 << 30)
    geo_correspondences: int = _n(8, 2, 64)
    model_inliers: int = _n(6, 2, 64)
    models: int = _n(4, 1, 8)
    repetition: int = _n(1500, 0, SCALE)
    coverage_floor: int = _n(2500, 0, SCALE)
    secondaries: int = _n(3, 0, 6)
    thresholds: tuple[int, ...] = (8000, 4000, 2400, 1000, 6000, 3500, 1200, 11, 6000)
    weights: tuple[int, ...] = (35, 25, 15, 10, 10, 5, 10)
    limits: tuple[int, ...] = (16384, 16384, 16_777_216)
    lowe_num: int = _n(82, 1, 1000)
    lowe_den: int = _n(100, 1, 1000)
    lowe_margin: int = _n(6, 0, 64)
    ham_max: int = _n(88, 0, 256)
    peak_members: int = _n(3, 2, 64)
    exclusion: int = _n(100, 0, 1000)
    select_quality: int = _n(1, 0, 1)
    soft_scale: int = _n(1, 0, 1)
    tables: tuple[Points, ...] = (
        ((0, 0), (5000, 1000), (8800, 4200), (9400, 8800), (10000, 10000)),
        ((0, 0), (1900, 1100), (3000, 3000), (10000, 10000)),
        NEUTRAL,
        IDENTITY,
        IDENTITY,
        IDENTITY,
        ((0, 0), (9100, 900), (9700, 4500), (10000, 10000)),
        ((0, 0), (3000, 800), (6500, 4000), (10000, 10000)),
        IDENTITY,
        ((0, 6000), (2000, 8000), (4000, 10000), (10000, 10000)),
    )

    def table(self, name: str) -> Points:
        return self.tables[TABLES.index(name)]

    def identity(self) -> str:
        return hashlib.sha256(encode(self)).hexdigest()


_PLAIN = [f.name for f in fields(Profile) if "range" in f.metadata]
_RULES, _SCALARS, _MATCHING = _PLAIN[:4], _PLAIN[4:14], _PLAIN[14:]


def check(p: Profile) -> None:
    """Raise ValueError for what no comparator could mean."""
    for f in fields(Profile):
        if "range" in f.metadata and not f.metadata["range"][0] <= getattr(p, f.name) <= f.metadata["range"][1]:
            raise ValueError(f"{f.name} out of range")
    if p.container not in COMPARATORS or len(p.tables) != COMPARATORS[p.container][1]:
        raise ValueError("tables of another container")
    if p.lowe_num > p.lowe_den or len(p.thresholds) != 9 or len(p.weights) != 7 or len(p.limits) != 3:
        raise ValueError("parameters do not fit")
    if any(not 0 <= t <= (512 if i == 7 else SCALE) for i, t in enumerate(p.thresholds)) or any(not 0 <= w <= SCALE for w in p.weights):
        raise ValueError("threshold or weight out of range")
    if any(v < 1 for v in p.limits) or max(p.limits[:2]) > 65535:
        raise ValueError("limit out of range")
    for points in p.tables:
        xs, ys = [x for x, _ in points], [y for _, y in points]
        if len(points) < 2 or xs[0] != 0 or xs[-1] != SCALE or sorted(set(xs)) != xs or sorted(ys) != ys or ys[0] < 0 or ys[-1] > SCALE:
            raise ValueError("a table must rise from 0 to the scale's end")


def encode(p: Profile) -> bytes:
    check(p)
    values = [getattr(p, n) for n in _RULES + _SCALARS]
    out = [struct.pack(_HEAD, MARK, p.container, COMPARATORS[p.container][0], p.name.encode(), *values, *p.thresholds, *p.weights, *p.limits)]
    if p.container == 3:
        out.append(struct.pack("<8i", *(getattr(p, n) for n in _MATCHING)))
    for points in p.tables:
        out.append(struct.pack(f"<H{2 * len(points)}H", len(points), *(v for xy in points for v in xy)))
    return b"".join(out)


def decode(data: bytes) -> Profile:
    """The profile of an artefact; ValueError if it is none."""
    try:
        mark, container, comparator, name, *rest = struct.unpack_from(_HEAD, data)
        if mark != MARK or container not in COMPARATORS or COMPARATORS[container][0] != comparator:
            raise ValueError("not an artefact of this kind")
        at = struct.calcsize(_HEAD)
        given = dict(zip(_RULES + _SCALARS, rest, strict=False)) | {"thresholds": tuple(rest[14:23]), "weights": tuple(rest[23:30]), "limits": tuple(rest[30:33])}
        # older containers have no matching block: what they meant by it
        matching = (82, 100, 0, 88, 3, 0, 0, 0)
        if container == 3:
            matching = struct.unpack_from("<8i", data, at)
            at += 32
        tables = []
        for _ in range(COMPARATORS[container][1]):
            (n,) = struct.unpack_from("<H", data, at)
            flat = struct.unpack_from(f"<{2 * n}H", data, at + 2)
            tables.append(tuple(zip(flat[::2], flat[1::2], strict=True)))
            at += 2 + 4 * n
        if at != len(data):
            raise ValueError("bytes after the last table")
        p = Profile(name=name.rstrip(b"\0").decode(), container=container, **given, **dict(zip(_MATCHING, matching, strict=True)), tables=tuple(tables))
    except (struct.error, UnicodeDecodeError) as error:
        raise ValueError("a damaged artefact") from error
    check(p)
    return p

"""Containers of key points: a head, a record for each point, and a checksum; damaged ones get a reason, not an exception.

Fixed values, together: the mark ``PAP2``, a head of 32 bytes (mark, version, level, count, checksum of the picture's
first record, longest side, reach of the mirror image, how the points were chosen, eleven bytes of nothing, checksum of
the records), and records of 40 bytes (four words of descriptor, x, y, level, sector with a mark, strength).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK, VERSION, KIND, MOST = b"PAP2", 4, 2, 512
HEAD = struct.Struct("<4sBBHIHHB11sI")
RECORD = np.dtype([("desc", "<u8", 4), ("x", "<u2"), ("y", "<u2"), ("level", "u1"), ("sector", "u1"), ("strength", "<u2")])
_POINT = pa.struct([("desc", pa.list_(pa.int64())), *((c, pa.int32()) for c in ("x", "y", "level", "sector", "strength"))])


def write(points: list[dict], longest: int, reach: int = 65535, first_crc: int = 0, chosen: int = 1) -> bytes:
    """The container of at most 512 points, in the order given."""
    points = points[:MOST]
    rows = np.zeros(len(points), RECORD)
    for i, p in enumerate(points):
        rows[i] = (np.array(p["desc"], np.int64).view(np.uint64), p["x"], p["y"], p["level"], p["sector"] & 63 | 64, p["strength"])
    body = rows.tobytes()
    return HEAD.pack(MARK, VERSION, KIND, len(rows), first_crc, longest, reach, chosen, bytes(11), zlib.crc32(body)) + body


def read(data: bytes | None) -> tuple[str | None, dict | None]:
    """Why a container is refused, or what it holds."""
    if data is None or len(data) < HEAD.size:
        return "too short", None
    mark, version, _, n, first_crc, longest, reach, chosen, _, crc = HEAD.unpack_from(data)
    body = data[HEAD.size :]
    if mark != MARK:
        return "not a container", None
    if len(body) != n * RECORD.itemsize:
        return "length and count differ", None
    if zlib.crc32(body) != crc:
        return "checksum", None
    rows = np.frombuffer(body, RECORD)
    words = rows["desc"].copy().view(np.int64).tolist()
    rest = (rows[c].tolist() for c in ("x", "y", "level"))
    points = [dict(zip(("desc", "x", "y", "level", "sector", "strength"), v, strict=True)) for v in zip(words, *rest, (rows["sector"] & 63).tolist(), rows["strength"].tolist(), strict=True)]
    return None, {"version": version, "first_crc": first_crc, "longest": longest, "reach": reach, "chosen": chosen, "points": points}


def write_containers(works: DataFrame) -> DataFrame:
    """``work_id, container`` of works ``work_id, max_dim, points``; null where there are no points."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            made = [None if p is None else write(p, m) for p, m in zip(part.column("points").to_pylist(), part.column("max_dim").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("work_id"), pa.array(made, pa.binary())], ["work_id", "container"])

    return works.select("work_id", "max_dim", "points").mapInArrow(batches, "work_id long, container binary")


def read_containers(rows: DataFrame, same_version: int = VERSION) -> DataFrame:
    """``work_id, reason, longest, points`` of rows ``work_id, container``. One of another version is refused: versions do not compare."""
    schema = "work_id long, reason string, longest int, points array<struct<desc:array<bigint>,x:int,y:int,level:int,sector:int,strength:int>>"

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            got = [read(d) for d in part.column("container").to_pylist()]
            got = [("version", None) if held and held["version"] != same_version else (reason, held) for reason, held in got]
            longest = pa.array([held and held["longest"] for _, held in got], pa.int32())
            points = pa.array([held and held["points"] for _, held in got], pa.list_(_POINT))
            yield pa.RecordBatch.from_arrays([part.column("work_id"), pa.array([reason for reason, _ in got], pa.string()), longest, points], ["work_id", "reason", "longest", "points"])

    return rows.select("work_id", "container").mapInArrow(batches, schema)

"""Sources and sinks: raw pictures, tab-separated snapshots, reports and derived tables that are kept."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_PICTURE = "path string, w int, h int, px binary, reason string"


def decode_picture(data: bytes) -> tuple[int, int, bytes]:
    """A PNG of 8 bits a channel, not interlaced, or a dump: two little-endian sizes and RGBA bytes."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        w, h = struct.unpack_from("<II", data)
        if len(data) != 8 + 4 * w * h:
            raise ValueError("neither a picture nor a dump")
        return w, h, data[8:]
    at, packed, palette, alpha, head = 8, [], b"", b"", None
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = body
        elif kind == b"tRNS":
            alpha = body
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    w, h, depth, colour, _, _, interlaced = head
    if depth != 8 or interlaced:
        raise ValueError("a kind of picture that is not read")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h, w * channels), np.int64)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        up = out[y - 1] if y else np.zeros(w * channels, np.int64)
        if kind == 2:
            out[y] = line + up & 255
        elif kind == 0:
            out[y] = line
        else:
            row = out[y]
            for i in range(w * channels):
                a = row[i - channels] if i >= channels else 0
                if kind == 1:
                    guess = a
                elif kind == 3:
                    guess = (a + up[i]) // 2
                else:
                    c = up[i - channels] if i >= channels else 0
                    guess = min((abs(up[i] - c), 0, a), (abs(a - c), 1, up[i]), (abs(a + up[i] - 2 * c), 2, c))[2]
                row[i] = line[i] + guess & 255
    px = out.reshape(h, w, channels).astype(np.uint8)
    rgba = np.full((h, w, 4), 255, np.uint8)
    if colour == 3:
        table = np.full((256, 4), 255, np.uint8)
        rgb = np.frombuffer(palette, np.uint8).reshape(-1, 3)
        table[: len(rgb), :3] = rgb
        table[: len(alpha), 3] = np.frombuffer(alpha, np.uint8)
        rgba = table[px[..., 0]]
    elif colour in (0, 4):
        rgba[..., :3] = px[..., :1]
        rgba[..., 3] = px[..., 1] if colour == 4 else 255
    else:
        rgba[..., :channels] = px
    return w, h, rgba.tobytes()


def read_pictures(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Pictures of a folder; what cannot be read has a ``reason`` and no pixels."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, data in zip(part.column("path").to_pylist(), part.column("content"), strict=True):
                try:
                    row = (path, *decode_picture(data.as_py()), None)
                except (ValueError, KeyError, TypeError, IndexError, struct.error, zlib.error) as error:
                    row = (path, None, None, None, str(error) or type(error).__name__)
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["path", "w", "h", "px", "reason"])

    return files.mapInArrow(batches, _PICTURE)


def read_snapshot(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A tab-separated table with a header; the schema is given, never guessed."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema, mode="FAILFAST")


def write_snapshot(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", header=True)


def as_reports(df: DataFrame, key: str) -> DataFrame:
    """``key`` and the whole row as JSON."""
    return df.select(key, F.to_json(F.struct(*df.columns)).alias("report"))


def cached_or_derived(works: DataFrame, cached: DataFrame, key: list[str], derive, columns: list[str]) -> DataFrame:
    """Derived columns from the kept table where its key matches, from ``derive`` for the others only."""
    kept = works.join(cached.select(*key, *columns), key)
    missing = works.join(cached.select(*key), key, "left_anti")
    return kept.unionByName(derive(missing).select(*kept.columns))

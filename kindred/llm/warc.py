"""WARC archives compressed record by record with a Zstandard dictionary of their own.

An archive begins with a skippable frame that holds the dictionary, built from the archive's own records; each record
is then a frame by itself. Pages with equal payloads of at least ``min_revisit`` bytes are stored once: the one with
the least page_id is the response, the others are revisit records that refer to it.

Archives are the rows of a table that Spark writes, one row a file, so they reach whatever store the session writes
to; ``export_files`` puts them into ``.warc.zst`` files. An archive closes at ``ARCHIVE_BYTES`` of payload, so
memory is bounded by that and the longest page.

Defined cases: a null page has the empty payload; a null page_id comes after all others and is read back as null;
rows that repeat the response's page_id and payload are responses too; missing urls are written empty, and control
characters in them are percent-encoded; other columns are not archived.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm._common import shared_table

ARCHIVE_BYTES, DICTIONARY_BYTES = 4 << 20, 32 << 10
#: Fixed values of the format: the magic number of the dictionary's frame, and the profile of revisits by equal payload.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'page {page_id}'.encode()).digest()[:16], version=4)}>"


def _url(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def write_record(page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": date,
        "WARC-Target-URI": _url(url),
        "WARC-Payload-Digest": f"sha256:{hashlib.sha256(payload).hexdigest()}",
        "Content-Type": "application/http; msgtype=response",
        "X-Page-Id": "" if page_id is None else str(page_id),
    }
    if revisit:
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(refers_to), "X-Refers-To-Page-Id": "" if refers_to is None else str(refers_to)}
    head["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def write_archive(records: list[bytes]) -> bytes:
    try:
        words = zstandard.train_dictionary(DICTIONARY_BYTES, records)
    except zstandard.ZstdError:  # too few or too short to train on: the beginning of the first is a dictionary as well
        words = zstandard.ZstdCompressionDict(records[0][:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=3, dict_data=words, write_content_size=True, write_checksum=True)
    data = words.as_bytes()
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(data)), data, *map(packer.compress, records)])


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive."""
    magic, n = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive does not begin with a dictionary")
    # a dictionary that was not trained has no header; the library tells them apart
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + n]))
    at, view = 8 + n, memoryview(data)
    while at < len(data):
        frame, out, step = opener.decompressobj(), [], 1 << 14
        while not frame.eof and at < len(data):
            out.append(frame.decompress(view[at : at + step]))
            at += min(step, len(data) - at)
        at -= len(frame.unused_data)
        yield b"".join(out)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def write_warc(pages: DataFrame, min_revisit: int = 100, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """The archives of ``pages`` (page_id, url, html): rows ``archive`` (a name) and ``data``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    sized = rows.select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("size")).where(F.col("size") >= min_revisit)
    # first, the least id of each payload held more than once; then of such payloads' rows, who refers to whom; html stays out of this
    first = sized.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id")).alias("least")).where("n > 1").select("digest", F.col("least.page_id").alias("refers_to"))
    told = sized.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), "refers_to").distinct()
    # by page_id, so that equal pages are spread over all partitions
    placed = rows.withColumn("digest", F.sha2("html", 256)).join(told, F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left")
    placed = placed.select("page_id", "url", "html", F.col("__digest").isNotNull().alias("revisit"), "refers_to")

    def archives(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            name = hashlib.sha256(records[0] + records[-1]).hexdigest()[:32]
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([write_archive(records)], pa.binary())], ["archive", "data"])

        for part in parts:
            for page_id, url, html, revisit, refers_to in zip(*(c.to_pylist() for c in part.columns), strict=True):
                payload = html.encode("utf-8", "surrogatepass")
                records.append(write_record(page_id, url, payload, revisit, refers_to, date))
                size += len(records[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    records, size = [], 0
        if records:
            yield close()

    return placed.mapInArrow(archives, "archive string, data binary")


def read_warc(archives: DataFrame) -> DataFrame:
    """What the records say: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` and ``payload`` (null for revisits).

    The digest of a response is computed anew from its payload, and must be the one in its header.
    """

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        number = lambda x: int(x) if x else None
        for part in parts:
            for data in part.column("data"):
                out: list[list] = [[] for _ in names]
                for record in read_archive(data.as_py()):
                    fields, block = parse_record(record)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
                    digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"] == "revisit"
                    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
                    got = (number(fields["X-Page-Id"]), fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], number(fields.get("X-Refers-To-Page-Id")), None if revisit else payload)
                    for column, x in zip(out, got, strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

    return archives.select("data").mapInArrow(rows, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive_pages(pages: DataFrame, min_revisit: int = 100) -> DataFrame:
    """Write ``pages`` and give the written archives."""
    return shared_table(write_warc(pages, min_revisit))


def export_files(archives: DataFrame, folder: str) -> int:
    """Write each archive to ``folder``/name.warc.zst by way of the driver, one at a time; the number written."""
    n = 0
    for row in archives.toLocalIterator():
        with open(f"{folder}/{row.archive}.warc.zst", "wb") as file:
            file.write(row.data)
        n += 1
    return n

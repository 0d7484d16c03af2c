"""N-gram Jaccard self-join by token-combination prefixes, and the components of its links.

A document's set holds the hashes of its five-word shingles (its tokens). Two sets link at Jaccard 0.75.

Sets are named by 64 bits of a hash of their tokens, so exact copies are one set from the start (two different sets
of one name are to be expected from some six billion sets on).

Global order: tokens by the number of sets that hold them, rare ones first. Let y be the smaller of two linked sets, or
either of equal ones: they share at least o = ceil(6/7 |y|) tokens, and x shares ceil(3/4 |x|) with any smaller partner.
So linked sets share a token among the first n - o + 1 of each, and m + 1 tokens among the first n - o + 1 + m: the
prefix extended by m. A set is indexed by its prefix as x, and marked where that lies in its shorter prefix as y; a key
without a mark brings nobody together. A rare token of the prefix is a key by itself. Frequent tokens of the extended
prefix fall into m classes, by hash, and only pairs of one class are keys. If the first token that linked sets share is
rare, they meet at it; if not, they share m + 1 frequent tokens of the extended prefix, two of these are of one class,
and they meet at that pair. With m in proportion to the prefix the pairs are in proportion to it too. m depends on the
smaller size's power of two; a set is indexed under those of all the sizes that its smaller partner may have.

Passages shared by many texts come last in the order: texts of which such a passage makes less than six sevenths do
not meet at it. What one text alone holds comes first and needs no index.

Components need no more than one verified chain of links, so no pairs within a key are made. Each set is tried with the
few leaders, of its keys' marked sets, that most of its keys name: linear in the keys. What keys still hold of several
components is then split into families, sets connected by such keys, and these into blocks of bounded size; a task
compares two blocks, all sets of one with all of the other, and gives a link for each two components that it finds
joined. No link between components is lost. This last step takes rows in proportion to the family's size times its blocks.

Tokens travel as sorted, compressed blobs, one for each batch of documents and range of tokens. Tokens that a
documented sample shows in one text of a hundred do not travel to be counted: they are the end of the order. The
sample steers that order only; any order gives the same result.

Defined cases: null, empty or blank texts have the empty set, and link with nothing; with fewer than five words the
whole sequence is the one shingle; equal sets link; rows that repeat a doc_id are each a row of the result; a
component of rows without any doc_id has none; other columns of the input do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm._common import discard, free_name, plain_scan, release, shared_table

SHINGLE = 5
#: Sets that hold a token, up to which it is rare.
RARE = 16
#: Counts above this are equal in the order.
MOST = 1 << 16
#: Rows of the sample for tokens that very many texts hold, and the share of its rows that makes one.
SAMPLE_DOCS, HEAVY_SHARE, HEAVY_LEAST = 4_000, 0.01, 40
#: Leaders of a key, and of a set; sets in a block of what is left after them; edges that make another partition.
LEADERS, BLOCK_SETS, EDGES = 4, 256, 50_000
#: Tokens gathered in a task before they are sent on, and characters of text whose tokens make one range.
FLUSH, RANGE_CHARS = 1_000_000, 5_000_000
#: Odd multipliers of the words' hashes in a shingle, by place.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_BLOB = "key int, kind string, a binary, b binary, c binary"


class _Hashes(dict):
    """word -> 64-bit hash, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, hashes: dict[bytes, int]) -> np.ndarray:
    """The sorted set of shingle hashes of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(h) < SHINGLE:
        return np.array([np.uint64(len(h)) + (h * MIX[: len(h)]).sum(dtype=np.uint64)], np.uint64)
    m = len(h) - SHINGLE + 1
    out = h[:m] * MIX[0]
    for i in range(1, SHINGLE):
        out += h[i : i + m] * MIX[i]
    out ^= out >> np.uint64(32)
    return np.unique(out * MIX[1])


def _pack(x: np.ndarray, delta: bool = False) -> bytes:
    """Compressed bytes of an array; planes of equal significance lie together."""
    if delta and len(x):
        x = np.concatenate([x[:1], np.diff(x)])
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 1)


def _unpack(blob: bytes, kind: type, delta: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    size = np.dtype(kind).itemsize
    x = np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)
    return np.cumsum(x, dtype=kind) if delta else x


def _heavy_tokens(rows: DataFrame, n_rows: int) -> np.ndarray:
    """Tokens that the sample shows in very many texts: at most 1 / HEAVY_SHARE times the mean size of a set."""
    sample = rows.where(F.pmod(F.xxhash64("doc", "uid"), F.lit(max(1, n_rows // SAMPLE_DOCS))) == 0)
    least = max(HEAVY_LEAST, int(HEAVY_SHARE * min(n_rows, SAMPLE_DOCS)))

    def sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for part in parts:
            for text in part.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text, hashes).view(np.int64))], ["token"])

    counted = sample.select("text").mapInArrow(sets, "token long").groupBy("token").count().where(F.col("count") >= least)
    return np.sort(np.array([r.token for r in counted.select("token").collect()], np.int64).view(np.uint64))


def _classes(n: int) -> int:
    """Classes of frequent tokens for sets of about ``n`` tokens: an eighth of the power of two not above n, which is half of the prefix or more."""
    return max(1, (1 << n.bit_length() - 1) // 8) if n else 1


def _home(sid: np.ndarray, ranges: int) -> np.ndarray:
    return ((sid.view(np.uint64) * MIX[0]) >> np.uint64(33)) % np.uint64(ranges)


def _new(*sorted_by: np.ndarray) -> np.ndarray:
    """Where any of the columns differs from the row before."""
    out = np.ones(len(sorted_by[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_by])
    return out


def _prefix_table(docs: DataFrame) -> DataFrame:
    """Two kinds of rows. For each document, with ``uid``: ``uid, doc_id, sid, n``. For each set that can have partners,
    ``uid`` null: ``sid, n, shared`` (its tokens that other sets hold too), the x-prefix's ``tokens`` with its extension
    and their ``counts``; ``single`` and ``marked`` are how many of these the plain prefixes as x and as y hold."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc"), F.col("text").alias("text"))
    n_rows, chars = docs.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    # ranges follow the volume, whatever the number of partitions: blobs for all ranges of all ranges stay few beside the tokens
    ranges = max(12, chars // RANGE_CHARS)
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ranges // 16)
    heavy = spark.sparkContext.broadcast(_heavy_tokens(rows, n_rows))

    def send(key: int, kind: str, a: bytes, b: bytes, c: bytes | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([kind]), *(pa.array([x], pa.binary()) for x in (a, b, c))], ["key", "kind", "a", "b", "c"])

    def send_tokens(key: int, kind: str, t: np.ndarray, u: np.ndarray) -> pa.RecordBatch:
        """Tokens in order with the sets that hold them: the names of the blob's sets once, and a short number for each token."""
        names, at = np.unique(u, return_inverse=True)
        return send(key, kind, _pack(t, True), _pack(names, True), _pack(at.astype(np.uint16 if len(names) < 1 << 16 else np.uint32)) + bytes([len(names) < 1 << 16]))

    def tokens_of(a: bytes, b: bytes, c: bytes) -> tuple[np.ndarray, np.ndarray]:
        return _unpack(a, np.uint64, True), _unpack(b, np.int64, True)[_unpack(c[:-1], np.uint16 if c[-1] else np.uint32)]

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _Hashes(), set()
        common = heavy.value
        tokens: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        about: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal tokens, owners, about
            if not about:
                return
            # what is known of the documents goes to some range
            info = np.array([x[:4] for x in about], np.int64)
            some = int(info[0, 0] % ranges)
            yield send(some, "docs", _pack(info.reshape(-1)), _pack(np.array([x[4] for x in about], np.uint8)))
            if tokens:
                t, u = np.concatenate(tokens), np.concatenate(owners)
                order = np.argsort(t, kind="stable")
                t, u = t[order], u[order]
                if len(common):
                    at = np.minimum(np.searchsorted(common, t), len(common) - 1)
                    hot = common[at] == t
                    if hot.any():
                        yield send_tokens(some, "heavy", t[hot], u[hot])
                        t, u = t[~hot], u[~hot]
                edges = np.searchsorted(t, (np.arange(1, ranges, dtype=np.float64) * (2.0**64 / ranges)).astype(np.uint64))
                for k, (x, y) in enumerate(zip(np.split(t, edges), np.split(u, edges), strict=True)):
                    if len(x):
                        yield send_tokens(k, "tokens", x, y)
            tokens, owners, about = [], [], []

        gathered = 0
        for part in (p.slice(i, 500) for p in parts for i in range(0, p.num_rows, 500)):
            for uid, doc, text in zip(*(part.column(c).to_pylist() for c in ("uid", "doc", "text")), strict=True):
                s = shingles(text, hashes)
                sid = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
                full = len(s) > 0 and sid not in seen
                if full:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(sid)
                    tokens.append(s)
                    owners.append(np.full(len(s), sid, np.int64))
                    gathered += len(s)
                about.append((uid, doc or 0, sid, len(s), (doc is None) + 2 * full))
                if gathered > FLUSH or len(about) > 50_000:
                    yield from flush()
                    gathered = 0
        yield from flush()

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens of a range with the sets that hold them: those of one set go; the others travel on by set, after its size."""
        held: dict[int, list[tuple[bytes, bytes, bytes]]] = {}
        for part in parts:
            for key, kind, *blobs in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
                if kind == "docs":
                    info, flags = _unpack(blobs[0], np.int64).reshape(-1, 4), _unpack(blobs[1], np.uint8)
                    yield send(key, kind, *blobs)
                    full = info[flags >= 2]
                    yield from by_set(np.ascontiguousarray(full[:, 2]), np.zeros(len(full), np.uint64), (-full[:, 3]).astype(np.int32))
                elif kind == "heavy":
                    t, u = tokens_of(*blobs)
                    yield from by_set(u, t, np.full(len(u), MOST, np.int32))
                else:
                    held.setdefault(key, []).append(tuple(blobs))
        for key in list(held):  # range by range; what waits is compressed
            t, u = (np.concatenate(x) for x in zip(*(tokens_of(*x) for x in held.pop(key)), strict=True))
            order = np.argsort(t, kind="stable")
            t, u = t[order], u[order]
            for again in (False, True):  # copies met in several tasks give their tokens several times
                first = np.flatnonzero(_new(t))
                n = np.diff(np.append(first, len(t)))
                df = np.repeat(n, n)
                t, u, df = t[df > 1], u[df > 1], df[df > 1]
                if not again:
                    order = np.lexsort((u, t))
                    t, u = t[order], u[order]
                    one = _new(t, u)
                    t, u = t[one], u[one]
            yield from by_set(u, t, np.minimum(df, MOST - 1).astype(np.int32))

    def by_set(u: np.ndarray, t: np.ndarray, df: np.ndarray) -> Iterator[pa.RecordBatch]:
        home = _home(u, ranges)
        order = np.lexsort((u, home))  # by set, so that the ids compress
        u, t, df, home = u[order], t[order], df[order], home[order]
        edges = np.searchsorted(home, np.arange(1, ranges, dtype=np.uint64))
        for k, (x, y, z) in enumerate(zip(*(np.split(v, edges) for v in (u, t, df)), strict=True)):
            if len(x):
                yield send(k, "sets", _pack(x, True), _pack(y), _pack(z))

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.int32())
    names = ["uid", "doc_id", "sid", "n", "shared", "tokens", "counts", "single", "marked"]

    def prefixes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[bytes, bytes, bytes]]] = {}
        for part in parts:
            for key, kind, *blobs in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
                if kind == "docs":
                    info, flags = _unpack(blobs[0], np.int64).reshape(-1, 4), _unpack(blobs[1], np.uint8)
                    doc = pa.array(info[:, 1], mask=flags % 2 == 1)
                    yield pa.RecordBatch.from_arrays([pa.array(info[:, 0]), doc, pa.array(info[:, 2]), pa.array(info[:, 3]), *(pa.nulls(len(info), k) for k in kinds[4:])], names)
                else:
                    held.setdefault(key, []).append(tuple(blobs))
        for key in list(held):
            yield from prefixes_of(held.pop(key))

    def prefixes_of(blobs: list[tuple[bytes, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        u, t, df = (np.concatenate([_unpack(x[i], kind, i == 0) for x in blobs]) for i, kind in enumerate((np.int64, np.int64, np.int32)))
        order = np.lexsort((t, df, u))  # a set's size comes first, as a count below 0
        u, t, df = u[order], t[order], df[order]
        one = _new(u, t, df)
        u, t, df = u[one], t[one], df[one]
        at = np.flatnonzero(_new(u))
        for i in range(0, len(at), 2000):
            out: list[list] = [[] for _ in names]
            for a, b in zip(at[i : i + 2000].tolist(), np.append(at, len(u))[i + 1 : i + 2001].tolist(), strict=True):
                n, a = -int(df[a]), a + 1
                alone = n - (b - a)
                single = min(n - -(-3 * n // 4) + 1 - alone, b - a)  # tokens of the prefix that others hold
                if single <= 0:
                    continue
                marked = max(0, n - -(-6 * n // 7) + 1 - alone)
                more = min(single + _classes(n), b - a)
                for column, x in zip(out, (None, None, u[a], n, t[a:b], t[a : a + more], df[a : a + more], single, marked), strict=True):
                    column.append(x)
            if out[2]:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

    counted = rows.mapInArrow(read, _BLOB).repartition(width, "key").mapInArrow(count, _BLOB)
    schema = "uid long, doc_id long, sid long, n long, shared array<long>, tokens array<long>, counts array<int>, single int, marked int"
    table = shared_table(counted.repartition(width, "key").mapInArrow(prefixes, schema))
    heavy.destroy()
    return table


def _index(sets: DataFrame) -> DataFrame:
    """``key, sid, y``: rare tokens of the plain prefix, and pairs within a class of frequent tokens of the extended
    one. ``y``: the key lies in the set's shorter prefix too."""

    def keys(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for sid, n, tokens, counts, single, marked in zip(*(part.column(c) for c in ("sid", "n", "tokens", "counts", "single", "marked")), strict=True):
                t = np.asarray(tokens.values).view(np.uint64)
                frequent = np.asarray(counts.values) > RARE
                n, single, marked = n.as_py(), single.as_py(), marked.as_py()
                found, marks = [t[:single][~frequent[:single]]], [np.flatnonzero(~frequent[:single]) < marked]
                if frequent[:single].any():
                    own = _classes(n)
                    for m in {own, _classes(-(-3 * n // 4))}:
                        place = np.flatnonzero(frequent[: single + m])
                        x = t[place]
                        of = (x * MIX[2] >> np.uint64(33)) % np.uint64(m)
                        order = np.lexsort((x, of))
                        x, of, place = x[order], of[order], place[order]
                        # as y, only where the first of the prefix as y that others hold is frequent, and under its own size
                        inside = (place < marked + m) & (m == own) & bool(frequent[:marked].any())
                        for step in range(1, len(x)):
                            same = of[step:] == of[:-step]
                            if not same.any():
                                break
                            pair = (x[:-step] * MIX[3] + x[step:] * MIX[4] + np.uint64(m)) * MIX[0]
                            found.append(pair[same])
                            marks.append((inside[step:] & inside[:-step])[same])
                key = np.concatenate(found)
                if len(key):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), sid.as_py(), np.int64)), pa.array(np.concatenate(marks))], ["key", "sid", "y"])

    return sets.select("sid", "n", "tokens", "counts", "single", "marked").mapInArrow(keys, "key long, sid long, y boolean")


def _held(index: DataFrame) -> DataFrame:
    """``key, sid, leaders``: the rows of keys that bring several sets together, with a few of the key's marked sets."""
    turned = [F.lit((j - 4) << 61) for j in range(LEADERS)]  # the least under several orders
    lead = index.groupBy("key").agg(*(F.min(F.when(F.col("y"), F.col("sid").bitwiseXOR(c))).alias(f"l{j}") for j, c in enumerate(turned)), F.count("*").alias("c")).where("c > 1 AND l0 IS NOT NULL")
    lead = lead.select("key", F.array_distinct(F.array(*(F.col(f"l{j}").bitwiseXOR(c) for j, c in enumerate(turned)))).alias("leaders"))
    # a table of its own: then the join reads two plain shuffles, and a key of very many sets can be split
    return index.select("key", "sid").join(shared_table(lead), "key")


def _tries(held: DataFrame, width: int) -> DataFrame:
    """Pairs ``(a, b)``: for each set those of its keys' leaders that most of its keys name."""

    def most(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(np.asarray(p.column("a")), np.asarray(p.column("b"))) for p in parts]
        if not got:
            return
        a, b = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        at = np.flatnonzero(_new(a, b))
        n = np.diff(np.append(at, len(a)))
        a, b = a[at], b[at]
        order = np.lexsort((b, -n, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(_new(a))
        keep = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a)))) < LEADERS
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    named = held.select(F.col("sid").alias("a"), F.explode("leaders").alias("b")).where("a <> b")
    return named.repartition(width, "a").mapInArrow(most, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs ``(a, b)`` those that link: an exact count of the tokens that both hold."""
    a = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    b = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(b, "b").join(a, "a").where((4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb")) & (100 * both >= 75 * (F.col("na") + F.col("nb") - both))).select("a", "b")


def _contract(u: np.ndarray, v: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges and, of each, one node of its component: the first in an order that ``salt`` gives."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    mixed = (nodes.view(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * MIX[1]
    by_rank = np.argsort(mixed ^ mixed >> np.uint64(29), kind="stable")
    rank = np.empty(len(nodes), np.int64)
    rank[by_rank] = np.arange(len(nodes))
    a, b = rank[at[: len(u)]], rank[at[len(u) :]]
    up = np.arange(len(nodes))
    while len(a):
        x, y = up[a], up[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (above := up[up]).tobytes() != up.tobytes():
            up = above
    return nodes, nodes[by_rank[up[rank]]]


def components(edges: DataFrame) -> DataFrame:
    """``node, comp``: the connected components of ``edges`` (u, v), for every node of an edge.

    In each layer, each task contracts the edges that it happens to hold and sends a row for each node, its root here;
    a node's task takes one of its roots as the label and contracts the edges between its roots, which are the next
    layer's edges. What travels is at most one row for each node and task, however many edges a node has. Labels of the
    layers are put one after the other in the end. Few edges take one partition, many more.
    """

    def columns(parts: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        got = [(np.asarray(p.column(0)), np.asarray(p.column(1))) for p in parts]
        return tuple(np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.empty(0, np.int64),) * 2

    def layer(salt: int):
        def roots(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            node, root = _contract(*columns(parts), salt)
            for i in range(0, len(node), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(node[i : i + 100_000]), pa.array(root[i : i + 100_000])], ["node", "root"])

        def labels(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            node, root = columns(parts)
            order = np.lexsort((root, node))
            node, root = node[order], root[order]
            at = np.flatnonzero(_new(node))
            label = np.repeat(root[at], np.diff(np.append(at, len(node))))
            other = root != label
            u, v = _contract(root[other], label[other], salt + 1)
            u, v = u[u != v], v[u != v]
            for x, y, edge in ((node[at], root[at], False), (u, v, True)):
                for i in range(0, len(x), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]), pa.array(y[i : i + 100_000]), pa.array(np.full(len(x[i : i + 100_000]), edge))], ["node", "root", "edge"])

        return roots, labels

    layers, salt = [], 1
    edges = shared_table(edges)
    while left := edges.count():
        roots, labels = layer(salt)
        table = shared_table(edges.mapInArrow(roots, "node long, root long").repartition(1 + left // EDGES, "node").mapInArrow(labels, "node long, root long, edge boolean"))
        layers.append(table.where("NOT edge").select("node", "root"))
        edges, salt = table.where("edge").select("node", "root"), salt + 2
    if not layers:
        return edges.select(F.col(edges.columns[0]).alias("node"), F.col(edges.columns[1]).alias("comp"))
    out = layers.pop().withColumnRenamed("root", "comp")
    while layers:
        out = layers.pop().join(out.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("comp", "root").alias("comp"))
    return out


def _joined(group: pa.Table) -> pa.Table:
    """The components of two blocks that link, two by two: all sets of one against all of the other."""
    first, second = group.column("p")[0].as_py(), group.column("q")[0].as_py()
    n, comp = (group.column(c).to_numpy() for c in ("n", "comp"))
    blk = np.array(group.column("blk").to_pylist())
    shared = group.column("shared").combine_chunks()
    size = np.diff(shared.offsets.to_numpy())
    token = np.unique(np.asarray(shared.values)[shared.offsets[0].as_py() : shared.offsets[-1].as_py()], return_inverse=True)[1]
    row = np.repeat(np.arange(len(n)), size)
    a, b = np.flatnonzero(blk == first), np.flatnonzero(blk == second)
    overlap = np.zeros((len(a), len(b)), np.float32)
    place_a, place_b = np.full(len(n), -1), np.full(len(n), -1)
    place_a[a], place_b[b] = np.arange(len(a)), np.arange(len(b))
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    step = 4096
    for at in range(0, int(token[-1]) + 1 if len(token) else 0, step):
        x, y = np.searchsorted(token, (at, at + step))
        t, r = token[x:y] - at, row[x:y]
        ones = []
        for place in (place_a, place_b):
            m = np.zeros((int(place.max()) + 1, step), np.float32)
            inside = place[r] >= 0
            m[place[r[inside]], t[inside]] = 1
            ones.append(m)
        overlap += ones[0] @ ones[1].T
    union = n[a][:, None] + n[b][None, :] - overlap
    i, j = np.nonzero((100 * overlap >= 75 * union) & (comp[a][:, None] != comp[b][None, :]))
    pairs = np.unique(np.stack([np.minimum(comp[a][i], comp[b][j]), np.maximum(comp[a][i], comp[b][j])]), axis=1)
    return pa.table([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def _across(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the components that the keys of ``rest`` (sid, comp, least) hold, block by block; ``least`` is a set of the row's key."""
    family = components(rest.where("sid <> least").select("sid", "least"))
    members = shared_table(rest.select("sid", "comp").distinct().join(family.select(F.col("node").alias("sid"), F.col("comp").alias("fam")), "sid"))
    # a large component has blocks of its own, which need not meet each other; small ones share blocks
    big = F.col("c") >= BLOCK_SETS
    sizes = shared_table(members.groupBy("fam", "comp").agg(F.count("*").alias("c")).withColumn("grp", F.when(big, F.col("comp")).otherwise(-1)))
    totals = sizes.groupBy("fam", "grp").agg(F.ceil(F.sum("c") / BLOCK_SETS).cast("int").alias("blocks"))
    plan = shared_table(sizes.join(totals, ["fam", "grp"]).select("fam", "comp", "grp", "blocks"))
    placed = members.join(plan, ["fam", "comp"]).select("sid", "fam", "comp", "grp", F.concat_ws(":", F.col("grp").cast("string"), F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("string")).alias("blk"))
    blocks = plan.select("fam", "grp", "blocks").distinct().select("fam", F.col("grp").alias("g2"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i")).select("fam", "g2", F.concat_ws(":", F.col("g2").cast("string"), F.col("i").cast("string")).alias("blk2"))
    met = placed.join(blocks, "fam").where("grp = -1 OR grp <> g2").select("sid", "fam", "comp", "blk", F.least("blk", "blk2").alias("p"), F.greatest("blk", "blk2").alias("q"))
    return met.join(sets.select("sid", "n", "shared"), "sid").groupBy("fam", "p", "q").applyInArrow(_joined, "a long, b long")


def _classified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``uid, doc_id, sid, n`` of each document, and of each set that is not empty ``sid, comp, first``: its component
    and that component's first document, a struct of ``none`` (no doc_id), ``doc_id`` and ``uid``."""
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = _prefix_table(docs)
    release(spark)
    rows, sets = table.where("uid IS NOT NULL").select("uid", "doc_id", "sid", "n"), table.where("uid IS NULL")
    index = shared_table(_index(sets))
    named = shared_table(_held(index))
    discard(index)
    near = shared_table(components(_verified(_tries(named, width), sets)))
    release(spark)
    held = shared_table(named.select("key", "sid").join(near.withColumnRenamed("node", "sid"), "sid", "left").select("key", "sid", F.coalesce("comp", "sid").alias("comp")))
    discard(named)
    mixed = shared_table(held.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("sid").alias("least")).where("lo <> hi").select("key", "least"))
    rest = shared_table(held.join(mixed, "key").select("sid", "comp", "least").distinct())
    discard(held, mixed)
    joined = components(_across(rest, sets))
    release(spark)

    found = rows.where("n > 0").groupBy("sid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first"))
    found = found.join(near.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "first", F.coalesce("comp", "sid").alias("near"))
    found = shared_table(found.join(joined.withColumnRenamed("node", "near"), "near", "left").select("sid", "first", F.coalesce("comp", "near").alias("comp")))
    least = shared_table(found.groupBy("comp").agg(F.min("first").alias("first")))
    return rows, shared_table(found.select("sid", "comp").join(least, "comp"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``; ``uid`` (its place in ``docs``) and ``comp`` (the component's name) tell rows apart that doc_id does not."""
    rows, found = _classified(docs)
    empty = F.col("n") == 0
    whole = rows.where(~empty).join(found, "sid").select("doc_id", "n", F.col("first.doc_id").alias("component_id"), "uid", "comp")
    alone = rows.where(empty).select("doc_id", "n", F.col("doc_id").alias("component_id"), "uid", (-1 - F.col("uid")).alias("comp"))
    return whole.unionByName(alone).withColumnRenamed("n", "n_shingles")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id, null last; of rows alike, the first one read.

    Rows are told apart by their place. Only of files read again is that sure to be the same, so anything else is written to a table first.
    """
    docs = docs if plain_scan(docs) else shared_table(docs)
    rows, found = _classified(docs)
    place = free_name("place", docs)
    kept = found.select(F.col("first.uid").alias(place)).distinct().unionByName(rows.where("n = 0").select(F.col("uid").alias(place)))
    return docs.withColumn(place, F.monotonically_increasing_id()).join(kept, place, "left_semi").select(*docs.columns)

"""Exact keys, postings, document frequencies and the nomination of candidates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.ints import idiv
from kindred.operators import tiles

try:
    from _md5 import md5  # without the checks of a general library, a third faster on short texts
except ImportError:
    from hashlib import md5

#: Kinds of keys, and the limits of nomination: works that a key may be found in, and nominees of each kind.
CODE, BAND = 0, 1
DF_CAP, NOMINEES = 256, 32
#: Bits up to which codes share a byte; rows and columns of the grid in which all meet beyond that.
EXACT, GRID = 7, 16
#: Keys that a worker holds before it sends them.
KEYS = 1 << 16
#: The weight of a key that one work alone holds; of more, its share. Whole numbers add up alike in any order.
UNIT = 1 << 32


def text_keys(works: DataFrame, id: str, text: str = "text", code_words: int = 3, band_words: int = 2) -> DataFrame:
    """``id, kind, key``: distinct keys of the runs of three (codes) and two words (bands) of a text, as ``bits.text_key`` gives them.

    Texts are read as bytes: a run of words is a piece between two spaces, and equal pieces of a text are hashed once.
    """
    kinds, name = ((CODE, code_words), (BAND, band_words)), dict(works.dtypes)[id]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found, n = [], [], 0
            for row, data in enumerate(batch.column(1)):
                data = data.as_py()
                if data is None:
                    continue
                spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32).tolist()
                starts, ends = [0, *(at + 1 for at in spaces)], [*spaces, len(data)]
                for kind, words in kinds:
                    runs = {data[s:e] for s, e in zip(starts, ends[words - 1 :], strict=False)}
                    key = np.unique(np.frombuffer(b"".join([md5(run).digest() for run in runs]), ">u8")[::2] >> 12)  # 13 digits of 4 bits
                    rows.append((row, kind, len(key)))
                    found.append(key.astype(np.int64))
                    n += len(key)
                if n >= KEYS:
                    yield _keys_of(batch.column(0), rows, found)
                    rows, found, n = [], [], 0
            if n:
                yield _keys_of(batch.column(0), rows, found)

    return works.select(F.col(id).alias("id"), F.col(text).cast("binary").alias("text")).mapInArrow(keys, f"id {name}, kind int, key long")


def _keys_of(ids: pa.Array, rows: list[tuple[int, int, int]], found: list[np.ndarray]) -> pa.RecordBatch:
    row, kind, n = (np.array(x) for x in zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(row, n))), pa.array(np.repeat(kind, n).astype(np.int32)), pa.array(np.concatenate(found))], ["id", "kind", "key"])


def document_frequencies(postings: DataFrame) -> DataFrame:
    """``kind, key, n``: works by key. Postings hold each (id, kind, key) once."""
    return postings.groupBy("kind", "key").agg(F.count("*").alias("n"))


def key_statistics(postings: DataFrame) -> DataFrame:
    """Distinct keys and postings of each kind, and the most common key's works."""
    df = document_frequencies(postings)
    return df.groupBy("kind").agg(F.count("*").alias("distinct_keys"), F.sum("n").alias("postings"), F.max("n").alias("most"))


def nominate(queries: DataFrame, postings: DataFrame, excluded: DataFrame | None = None, cap: int = DF_CAP, k: int = NOMINEES) -> DataFrame:
    """Candidates of each query by shared keys, rare ones weighing more.

    ``queries`` and ``postings`` are (id, kind, key). Keys of more than ``cap`` works are dropped before the join, so
    no key can bring more than ``cap`` rows for each query that holds it. The works of keys no query holds are not
    counted at all. Gives ``query, id, codes, bands, rc, rb``: weights and ranks by kind.
    """
    asked = queries.select(F.col("id").alias("query"), "kind", "key")
    # what is left is placed by key once; the counts and the join both read that
    held = postings.join(asked.select("kind", "key").distinct(), ["kind", "key"], "left_semi").repartition("kind", "key")
    live = document_frequencies(held).where(F.col("n") <= cap)
    if excluded is not None:
        held = held.join(excluded.select("id"), "id", "left_anti")
    weight = idiv(F.lit(UNIT), F.col("n"))
    hits = (
        asked.join(live, ["kind", "key"])
        .join(held, ["kind", "key"])
        .groupBy("query", "id")
        .agg(
            F.coalesce(F.sum(F.when(F.col("kind") == CODE, weight)), F.lit(0)).cast("long").alias("codes"),
            F.coalesce(F.sum(F.when(F.col("kind") == BAND, weight)), F.lit(0)).cast("long").alias("bands"),
        )
    )
    rank = lambda by: F.row_number().over(Window.partitionBy("query").orderBy(F.desc(by), "id"))
    ranked = hits.withColumn("rc", rank("codes")).withColumn("rb", rank("bands"))
    return ranked.where(((F.col("codes") > 0) & (F.col("rc") <= k)) | ((F.col("bands") > 0) & (F.col("rb") <= k)))


def best_rank(codes: str = "codes", bands: str = "bands") -> Column:
    """A nominee's better rank of the kinds in which it has any weight."""
    return F.least(F.when(F.col(codes) > 0, F.col("rc")), F.when(F.col(bands) > 0, F.col("rb")))


def candidate_union(**channels: DataFrame) -> DataFrame:
    """Candidates ``(query, id, score)`` of several channels, once each: ``via`` says which, ``score`` is the best."""
    tagged = None
    for name, found in channels.items():
        rows = found.select("query", "id", F.col("score").cast("long").alias("score"), F.lit(name).alias("via"))
        tagged = rows if tagged is None else tagged.unionByName(rows)
    return tagged.groupBy("query", "id").agg(F.array_join(F.array_sort(F.collect_set("via")), ",").alias("via"), F.max("score").alias("score"))


def chunk_join(codes: DataFrame, queries: DataFrame, most: int = 7) -> DataFrame:
    """All pairs of 64-bit codes within ``most`` bits.

    Up to 7 bits one at least of eight bytes is equal, and codes meet by their bytes. Of more bits no piece long enough
    to tell codes apart need be equal: then every query meets every code, in the cells of a grid.
    ``codes`` and ``queries`` are (id, code). Gives ``query, id, distance``.
    """
    from kindred.functions.bits import bytes_of, hamming

    asked, pieces = queries.select(F.col("id").alias("query"), F.col("code").alias("asked")), codes.select("id", "code")
    if most <= EXACT:
        by = ["idx", "val"]
        pieces = pieces.select("id", "code", F.explode(bytes_of(F.col("code"))).alias("c")).select("id", "code", "c.*")
        asked = asked.select("query", "asked", F.explode(bytes_of(F.col("asked"))).alias("c")).select("query", "asked", "c.*")
    else:
        by = ["row", "column"]
        every = F.explode(F.sequence(F.lit(0), F.lit(GRID - 1)))
        place = lambda id: F.pmod(F.xxhash64(id), F.lit(GRID)).cast("int")
        pieces = pieces.select("id", "code", every.alias("row"), place("id").alias("column"))
        asked = asked.select("query", "asked", place("query").alias("row"), every.alias("column"))
    distance = hamming(F.col("asked"), F.col("code"))
    near = asked.join(pieces, by).where((F.col("query") != F.col("id")) & (distance <= most)).select("query", "id", distance.cast("int").alias("distance"))
    return near.distinct() if most <= EXACT else near


#: Queries and works whose products are held at once.
ASKED, BESIDE = 256, 2048


def nearest(vectors: DataFrame, k: int, size: int = tiles.GRID) -> DataFrame:
    """``query, id, score, rank``: the ``k`` greatest inner products of each of ``vectors`` (id, v: whole numbers) with the others.

    Every vector meets every other in a cell of a grid, as products of matrices; a cell gives the ``k`` best of its own.
    What is null or missing in a vector adds nothing, and two vectors that share no place have no score.
    """
    found = tiles.meet(vectors, vectors, partial(_best_products, k=k), "query long, id long, score long", size)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _exact_kind(left: np.ndarray, right: np.ndarray) -> type:
    """The fastest type in which all inner products, and all their partial sums, are exact."""
    norm = lambda m: float((m.astype(np.float64) ** 2).sum(1).max(initial=0)) ** 0.5
    most = norm(left) * norm(right) * (1 + 1e-6)  # bounds every partial sum
    widest = float(max(np.abs(m.astype(np.float64)).max(initial=0) for m in (left, right)))
    for kind, limit in ((np.float32, 2.0**24), (np.float64, 2.0**53), (np.int64, 2.0**63)):
        if most < limit and widest < limit:
            return kind
    raise OverflowError("inner products beyond 64 bits")


def _best_products(asked: pa.Table, works: pa.Table, _: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    queries, (q, q_known) = tiles.whole(asked["id"]), tiles.matrix(asked["v"])
    ids, (w, w_known) = tiles.whole(works["id"]), tiles.matrix(works["v"], q.shape[1])
    if q.shape[1] < w.shape[1]:
        q, q_known = (np.pad(m, ((0, 0), (0, w.shape[1] - m.shape[1]))) for m in (q, q_known))
    order = np.argsort(ids, kind="stable")  # so that of equal scores the first met stays
    ids, kind, holes = ids[order], _exact_kind(q, w), not (q_known.all() and w_known.all())
    w, w_known = (np.ascontiguousarray(m[order].T) for m in (w.astype(kind), w_known.astype(np.float32)))
    least = np.iinfo(kind).min if kind is np.int64 else -np.inf  # no candidate; a candidate without a score is just above
    null = np.iinfo(kind).min + 1 if kind is np.int64 else np.finfo(kind).min
    for at in range(0, len(queries), ASKED):
        own, part, mask = queries[at : at + ASKED], q[at : at + ASKED].astype(kind), q_known[at : at + ASKED].astype(np.float32)
        best = tiles.Best(len(own), k, least, kind)
        for to in tiles.spans(len(ids), k, BESIDE):
            s = part @ w[:, to]
            if holes:
                s[mask @ w_known[:, to] == 0] = null
            first, last = (np.searchsorted(ids[to], own, end) for end in ("left", "right"))
            for r in np.flatnonzero(last > first):
                s[r, first[r] : last[r]] = least
            best.add(s, ids[to])
        r, who, score = best.found()
        out = pa.array(np.where(score == null, 0, score).astype(np.int64), mask=score == null)
        yield pa.RecordBatch.from_arrays([pa.array(own[r]), pa.array(who), out], ["query", "id", "score"])


def recall(found: DataFrame, truth: DataFrame, at: tuple[int, ...] = (1, 5, 32)) -> DataFrame:
    """``k, hits, total``: of the pairs ``truth`` (query, id) those that ``found`` (query, id, rank) has by rank k."""
    ranks = truth.join(found.select("query", "id", "rank"), ["query", "id"], "left")
    row = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.coalesce(F.col("rank") <= k, F.lit(False)).alias("hit")) for k in at))).alias("r")
    return ranks.select(row).groupBy("r.k").agg(F.count_if("r.hit").alias("hits"), F.count("*").alias("total"))


def percentiles(rows: DataFrame, column: str, at: tuple[int, ...] = (50, 90, 95, 99)) -> DataFrame:
    """``percent, value``: values by place in order, not interpolated. Values are counted first, so equal ones cost one row."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    total = counts.agg(F.sum("c").alias("n"))
    placed = counts.withColumn("upto", upto).join(F.broadcast(total))  # one row
    percent = F.explode(F.array(*map(F.lit, at))).alias("percent")
    return placed.select("value", "upto", "n", percent).where(F.col("upto") * 100 >= F.col("n") * F.col("percent")).groupBy("percent").agg(F.min("value").alias("value"))

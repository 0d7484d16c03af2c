"""Exact top-k by inner product with a KD-tree in each shard.

Vectors become integers, floor(scale * x). A shard's tree splits at medians of the widest dimension and keeps tight
bounding boxes. A query goes through a tree best first: by the greatest inner product that a box allows, until that
is below the k-th score known. The k-th score is carried on: every query first meets one shard, and takes its k-th
best score along to all others, where it prunes from the start.

A task holds one shard and one block of queries. Every vector is sent once for each block and every query once for each
shard, so both are as large as memory allows: ``SHARD_BYTES`` and ``BLOCK_BYTES`` of components on average, whatever the
vectors' length. Tables of less than that are cut into shards of ``LEAST`` vectors, to keep the tasks of a shuffle busy.

Defined cases: vectors that are null or hold nulls or components that are not finite take no part, nor do null ids;
vectors are compared with those of their own length; equal rows (id and vector) count once, and a query's candidates
are all rows of another id; scores beyond 64 bits are held at its limits; ties go to the smaller id.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm._common import shared_table

LEAF = 128
SHARD_BYTES, BLOCK_BYTES, LEAST = 32 << 20, 8 << 20, 8192
#: Queries whose bounds for all nodes are held at once.
STEP = 512
_FOUND = "query_id long, vec_id long, score long"


class Tree:
    """Median splits with the bounding box of each node's points."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        self.ids, self.points = ids, points
        self.lo: list[np.ndarray] = []
        self.hi: list[np.ndarray] = []
        self.kids: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray] = []
        stack = [(self._node(np.arange(len(points))))] if len(points) else []
        while stack:
            node = stack.pop()
            rows = self.rows[node]
            if len(rows) <= LEAF:
                continue
            axis = int(np.argmax(self.hi[node] - self.lo[node])) if self.points.shape[1] else 0
            half = len(rows) // 2
            order = rows[np.argpartition(self.points[rows, axis], half)] if self.points.shape[1] else rows
            self.kids[node] = (self._node(order[:half]), self._node(order[half:]))
            self.rows[node] = rows[:0]
            stack += self.kids[node]

    def _node(self, rows: np.ndarray) -> int:
        self.lo.append(self.points[rows].min(0))
        self.hi.append(self.points[rows].max(0))
        self.kids.append(None)
        self.rows.append(rows)
        return len(self.rows) - 1

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The greatest inner product that each node's box allows for each query."""
        return np.maximum(queries, 0) @ np.array(self.hi).T + np.minimum(queries, 0) @ np.array(self.lo).T

    def search(self, query: np.ndarray, own: int, bound: np.ndarray, k: int, floor) -> list[tuple]:
        """Up to k best (score, -id) of scores >= ``floor``; ``own`` is left out."""
        best: list[tuple] = []  # a heap, the worst first
        todo = [(-bound[0], 0)] if len(self.rows) else []
        while todo:
            most, node = heapq.heappop(todo)
            if floor is not None and -most < floor or len(best) == k and -most < best[0][0]:
                break
            if self.kids[node] is not None:
                for kid in self.kids[node]:
                    heapq.heappush(todo, (-bound[kid], kid))
                continue
            rows = self.rows[node]
            scores = self.points[rows] @ query
            least = best[0][0] if len(best) == k else floor
            for i in np.flatnonzero(scores >= least) if least is not None else range(len(rows)):
                found = (scores[i], -int(self.ids[rows[i]]))
                if -found[1] == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
        return best


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.chunked_array([c.flatten() for c in flat.chunks])
    return np.asarray(flat.to_numpy(zero_copy_only=False)).reshape(-1, dim) if dim else np.zeros((len(column), 0), np.int64)


def _search(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """One shard against one block of queries."""
    found: tuple[list, list, list] = ([], [], [])
    if left.num_rows and right.num_rows:
        dim = right.column("dim")[0].as_py()
        points, queries = _matrix(left.column("v"), dim), _matrix(right.column("q"), dim)
        reach = max(1, dim) * int(max(abs(int(points.max(initial=0))), abs(int(points.min(initial=0))))) * int(max(abs(int(queries.max(initial=0))), abs(int(queries.min(initial=0)))))
        exact = np.float64 if reach < 2**52 else object  # doubles hold these integers exactly, or Python's integers do
        points, queries = points.astype(exact), queries.astype(exact)
        tree = Tree(points, left.column("vec_id").to_numpy())
        for i, (own, floor) in enumerate(zip(right.column("query_id").to_pylist(), right.column("floor").to_pylist(), strict=True)):
            if i % STEP == 0:
                bounds = tree.bounds(queries[i : i + STEP])
            for score, other in tree.search(queries[i], own, bounds[i % STEP], k, floor):
                for column, x in zip(found, (own, -other, max(-(2**63), min(2**63 - 1, int(score)))), strict=True):
                    column.append(x)
    return pa.table([pa.array(x, pa.int64()) for x in found], ["query_id", "vec_id", "score"])


def whole_vector(v: Column, scale: int) -> Column:
    """floor(scale * x) of each component, or null where the vector takes no part."""
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(sound, F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors`` (vec_id, embedding) that ``queries`` picks."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole_vector(F.col("embedding"), scale).alias("v"), queries.alias("asks"))
    v = shared_table(v.where("v IS NOT NULL AND vec_id IS NOT NULL").dropDuplicates(["vec_id", "v"]).withColumn("dim", F.size("v")))
    long = F.lit(8) * (F.col("dim") + 1)  # bytes of a vector and its id
    n, size, asking = v.agg(F.count("*"), F.coalesce(F.sum(long), F.lit(0)), F.coalesce(F.sum(F.when(F.col("asks"), long)), F.lit(0))).first()
    width = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-size // SHARD_BYTES), min(width, -(-n // LEAST)))
    blocks = max(1, -(-asking // BLOCK_BYTES))
    points = v.select("vec_id", "v", "dim", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"))
    asked = v.where("asks").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("dim").alias("dim"), F.pmod(F.xxhash64("v", "vec_id"), F.lit(blocks)).cast("int").alias("block"))

    def meet(pairs: DataFrame) -> DataFrame:
        """``pairs``: the queries with their shard and floor."""
        every = points.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        by = ["dim", "shard", "block"]
        return every.groupBy(*by).cogroup(pairs.groupBy(*by)).applyInArrow(lambda a, b: _search(a, b, k), _FOUND)

    no_floor = F.lit(None).cast("long").alias("floor")
    first = shared_table(meet(asked.select("*", F.pmod("block", F.lit(shards)).cast("int").alias("shard"), no_floor)))
    floors = first.groupBy(F.col("query_id").alias("asker")).agg(F.min("score").alias("least"), F.count("*").alias("n")).select("asker", F.when(F.col("n") >= k, F.col("least")).alias("floor"))
    rest = asked.join(floors, asked["query_id"] == floors["asker"], "left").drop("asker").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("shard") != F.pmod("block", F.lit(shards)))
    return _best(first.unionByName(meet(rest)), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

"""Keys of works for exact search, and the screening index as tables: postings, plans, and maintenance.

A signature is ``id, present, cells, local, band``: which of eight families a work has, a cell for each of six, and keys
of its bands. A posting key is the family's number above 24 bits of lane and value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.ints import idiv
from kindred.operators import tiles

CODE_BITS, BANDS, FAMILIES, LOCAL, BAND = 53, 10, 6, 6, 7
#: Bits that a code of use has at least and at most; the band that all-equal bits give.
FEWEST, LARGEST, FULL = 6, 58, 0xFFFFFF


def bit(mask: Column, place: Column | int) -> Column:
    """One bit of a mask, as 0 or 1."""
    return F.call_function("shiftright", mask, F.lit(place) if isinstance(place, int) else place).bitwiseAND(1)


def code_keys(works: DataFrame) -> DataFrame:
    """``id, kind, key`` of ``works`` (id, code): 53 bits of the codes with neither too few nor too many bits set, once each."""
    usable = F.bit_count("code").between(FEWEST, LARGEST)
    return works.where(usable).select("id", F.lit(0).alias("kind"), F.col("code").bitwiseAND(F.lit((1 << CODE_BITS) - 1)).alias("key")).distinct()


def band_keys(works: DataFrame) -> DataFrame:
    """``id, kind, key`` of ``works`` (id, desc: four words): ten bands of 24 bits, without those of equal bits only, once each."""
    byte = lambda i: F.shiftrightunsigned(F.element_at("desc", i // 8 + 1), 8 * (i % 8)).bitwiseAND(F.lit(255).cast("long"))
    bands = F.array(*(F.struct(F.lit(j).cast("long").alias("j"), (byte(3 * j) * 65536 + byte(3 * j + 1) * 256 + byte(3 * j + 2)).alias("v")) for j in range(BANDS)))
    rows = works.select("id", F.explode(bands).alias("b")).where(~F.col("b.v").isin(0, FULL))
    return rows.select("id", F.lit(1).alias("kind"), (F.col("b.j") * (1 << 24) + F.col("b.v")).alias("key")).distinct()


def posting_keys(signatures: DataFrame) -> DataFrame:
    """``id, k`` of every family that a signature has."""
    has = lambda f: bit(F.col("present"), f) == 1
    cells = [F.when(has(f), F.array(F.lit(f << 24) + F.col("cells")[f])).otherwise(F.array().cast("array<int>")) for f in range(FAMILIES)]
    lane = lambda f: lambda v, j: F.lit(f << 24) + F.call_function("shiftleft", j, F.lit(16)) + v
    lanes = [F.when(has(f), F.transform(c, lane(f))).otherwise(F.array().cast("array<int>")) for f, c in ((LOCAL, "local"), (BAND, "band"))]
    return signatures.select("id", F.explode(F.concat(*cells, *lanes)).alias("k"))


def plans(signatures: DataFrame, near: Column, own: tuple[int, int, int], bands: tuple[int, int, int, int]) -> DataFrame:
    """The rows that a query looks up: ``query, k, fam, w`` (above the level of no match), and ``base`` by query apart.

    ``near`` is an array of cells to probe besides a family's own, given its cell as ``cell``; weights are by level.
    """
    rows = posting_keys(signatures).select(F.col("id").alias("query"), "k", F.shiftright("k", 24).alias("fam"))
    exact = rows.select("query", "k", "fam", F.when(F.col("fam") < FAMILIES, own[2] - own[0]).otherwise(0).alias("w"))
    beside = rows.where(F.col("fam") < FAMILIES).withColumn("cell", F.col("k").bitwiseAND(FULL)).select("query", F.explode(near).alias("cell"), "fam")
    return exact.unionByName(beside.select("query", (F.shiftleft("fam", 24) + F.col("cell")).alias("k"), "fam", F.lit(own[1] - own[0]).alias("w")))


def search(probes: DataFrame, postings: DataFrame, works: DataFrame, asked: DataFrame, own: tuple[int, int, int], bands: tuple[int, int, int, int], threshold: int, budget: int, size: int = tiles.GRID) -> DataFrame:
    """``query, id, score, rank``: what the probes touch, scored over the families that both sides have.

    ``works`` and ``asked`` are (id, present). Probes and postings meet in the cells of a grid: a query's probes add up
    over the postings of a cell's works, and a cell gives no more than the budget for each query. The base of each pair
    of masks follows from the bits that both have.
    """
    level = [0, bands[1] - bands[0], bands[2] - bands[0], bands[2] - bands[0], bands[3] - bands[0]]
    base = np.array([sum(own[0] if f < FAMILIES else bands[0] for f in range(BAND + 1) if m >> f & 1) for m in range(1 << BAND + 1)])

    def found(ours: pa.Table, theirs: pa.Table, _: pa.Table) -> Iterator[list[np.ndarray]]:
        ids = tiles.whole(theirs["id"])
        order = np.argsort(ids, kind="stable")
        ids, present = ids[order], tiles.whole(theirs["present"])[order]
        posted, there = (m[order] for m in tiles.matrix(theirs["keys"]))
        at, _lane = np.nonzero(there)
        keys = posted[there]
        by = np.argsort(keys, kind="stable")
        keys, at = keys[by], at[by]
        (probe, some), (weight, _) = tiles.matrix(ours["keys"]), tiles.matrix(ours["w"])
        lo, hi = np.searchsorted(keys, probe), np.searchsorted(keys, probe, "right")
        for row, (query, mine) in enumerate(zip(tiles.whole(ours["id"]).tolist(), tiles.whole(ours["present"]).tolist(), strict=True)):
            ex, lanes, touched = np.zeros(len(ids), np.int64), np.zeros((2, len(ids)), np.int64), np.zeros(len(ids), bool)
            for p in np.flatnonzero(some[row] & (hi[row] > lo[row])):
                hit, family = at[lo[row, p] : hi[row, p]], int(probe[row, p]) >> 24
                touched[hit] = True
                if family < FAMILIES:
                    np.add.at(ex, hit, weight[row, p])
                else:
                    np.add.at(lanes[family - LOCAL], hit, 1)
            hit = np.flatnonzero(touched & (ids != query))
            score = ex[hit] + np.take(level, np.minimum(lanes[0, hit], 4)) + np.take(level, np.minimum(lanes[1, hit], 4)) + base[present[hit] & mine & (len(base) - 1)]
            hit, score = hit[score >= threshold], score[score >= threshold]
            best = np.lexsort([hit, -score])[:budget] if len(hit) <= budget else np.argpartition(hit - score * len(ids), budget)[:budget]
            yield [np.full(len(best), query), ids[hit[best]], score[best]]

    listed = probes.groupBy(F.col("query").alias("id")).agg(F.collect_list(F.struct(F.col("k").cast("long").alias("k"), F.col("w").cast("long").alias("w"))).alias("p"))
    held = postings.groupBy("id").agg(F.collect_list(F.col("k").cast("long")).alias("keys"))
    mask = F.col("present").cast("long").alias("present")
    left = asked.select("id", mask).join(listed.select("id", F.col("p.k").alias("keys"), F.col("p.w").alias("w")), "id")
    right = works.select("id", mask).join(held, "id").withColumn("w", F.lit(None).cast("array<bigint>"))
    schema = [("query", np.int64), ("id", np.int64), ("score", np.int32)]
    scored = tiles.meet(left, right, lambda *cell: tiles.batched(found(*cell), schema), "query long, id long, score int", size)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= budget)


# ---- maintenance: postings carry the generation that added them, removals the one up to which they hold ----
def add(postings: DataFrame | None, signatures: DataFrame, generation: int) -> DataFrame:
    rows = posting_keys(signatures).withColumn("generation", F.lit(generation))
    return rows if postings is None else postings.unionByName(rows)


def remove(tombstones: DataFrame | None, works: DataFrame, generation: int) -> DataFrame:
    """``id, upto``: postings of these works of this generation or before are dead."""
    rows = works.select("id").distinct().withColumn("upto", F.lit(generation))
    return rows if tombstones is None else tombstones.unionByName(rows)


def live(postings: DataFrame, tombstones: DataFrame) -> DataFrame:
    last = tombstones.groupBy(F.col("id").alias("__id")).agg(F.max("upto").alias("upto"))
    return postings.join(last, (F.col("id") == F.col("__id")) & (F.col("generation") <= F.col("upto")), "left_anti")


def compacted(postings: DataFrame, tombstones: DataFrame, share: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """Postings and tombstones, rewritten if more than ``share`` of the postings are dead."""
    kept = live(postings, tombstones)
    if kept.count() >= (1 - share) * postings.count():
        return postings, tombstones
    return kept, tombstones.limit(0)


def select_grid(points: DataFrame, work: str, x: str, y: str, order: list[str], want: int, cells: int = 8) -> DataFrame:
    """``points`` with ``place``: round by round the next of each cell of a grid, ``want`` of each work."""
    cell = F.shiftright(F.col(y).cast("long") * cells, 16) * cells + F.shiftright(F.col(x).cast("long") * cells, 16)
    rounds = points.withColumn("__cell", cell).withColumn("__round", F.row_number().over(Window.partitionBy(work, "__cell").orderBy(*order)))
    place = F.row_number().over(Window.partitionBy(work).orderBy("__round", "__cell"))
    return rounds.withColumn("place", place).where(F.col("place") <= want).drop("__cell", "__round")


def in_byte_order(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs with the side first whose bytes come first, without a sign; ``swapped`` tells which were turned."""
    swapped = F.col(b) < F.col(a)
    return pairs.withColumn("swapped", swapped).withColumn("first", F.when(swapped, F.col(b)).otherwise(F.col(a))).withColumn("second", F.when(swapped, F.col(a)).otherwise(F.col(b)))


def by_ids(works: DataFrame, ids_json: Column, id: str) -> DataFrame:
    """The works of a JSON list of ids; the list is one parameter, exploded to rows."""
    spark = works.sparkSession
    listed = spark.range(1).select(F.explode(F.from_json(ids_json, "array<bigint>")).alias(id)).distinct()
    return works.join(listed, id, "left_semi")


def elongation(w: Column, h: Column) -> Column:
    """256 times the longer side by the shorter, rounded down."""
    return idiv(F.greatest(w, h).cast("long") * 256, F.greatest(F.least(w, h), F.lit(1)))


def footprint(side: Column, percent: int, patch: int = 15) -> Column:
    """The radius that a key point of a level of this size covers, in 65535ths of the picture, times a percentage."""
    return F.least(F.lit(65535), F.greatest(F.lit(0), idiv(F.lit(65535 * patch * percent).cast("long"), F.greatest(side, F.lit(1)) * 100)))

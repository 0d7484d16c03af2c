"""Bottom-k sketches, MinHash lanes, routes and their class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.ints import idiv, minhash_level

#: Bars of the route screen by family, equal lanes (or a score) that certify, and below which nothing is there.
BARS = {"local": (7, 6), "band": (5, 3), "global": (203, 190)}


def bottom_k(elements: DataFrame, by: str, key: str, k: int = 16) -> DataFrame:
    """The ``k`` least distinct keys of each group, as an array.

    Distinct keys are ranked by a window; Spark keeps no more than ``k`` rows of a group before the shuffle.
    """
    from pyspark.sql import Window

    distinct = elements.select(by, key).distinct()
    ranked = distinct.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(key))).where(F.col("__r") <= k)
    return ranked.groupBy(by).agg(F.array_sort(F.collect_list(key)).alias("sketch"))


def minhash_lanes(elements: DataFrame, by: str, element: str, lanes: int = 32) -> DataFrame:
    """``by, lanes``: for each lane the low byte of the least salted hash of the elements, partial minima before the shuffle."""
    hashes = [F.min(F.conv(F.substring(F.md5(F.concat(F.lit(f"{lane}:"), F.col(element))), 1, 13), 16, 10).cast("long")).alias(f"l{lane}") for lane in range(lanes)]
    return elements.groupBy(by).agg(*hashes).select(by, F.array(*(F.col(f"l{i}").bitwiseAND(F.lit(255).cast("long")).cast("int") for i in range(lanes))).alias("lanes"))


def equal_lanes(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def band_keys(lanes: Column) -> Column:
    """Two neighbouring lanes make one key of 16 bits."""
    return F.transform(F.sequence(F.lit(1), F.size(lanes), F.lit(2)), lambda i: F.element_at(lanes, i) * 256 + F.element_at(lanes, i + 1))


def agreement_level(a: Column, b: Column) -> Column:
    return minhash_level(equal_lanes(band_keys(a), band_keys(b)))


def jaccard_bits(a: Column, b: Column) -> Column:
    """Common bits of all bits, of 64; two empty words agree wholly."""
    both, any_ = F.bit_count(a.bitwiseAND(b)), F.bit_count(a.bitwiseOR(b))
    return F.when(any_ == 0, F.lit(64).cast("long")).otherwise(idiv(64 * both, any_))


def equal_symbols(a: Column, b: Column) -> Column:
    """Equal symbols of two bits, of 32, times two."""
    x = a.bitwiseXOR(b)
    pair = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555).cast("long"))
    return (2 * (32 - F.bit_count(pair))).cast("long")


def global_similarity(a: Column, b: Column) -> Column:
    """0 to 256 for four words: sets of bits, symbols, sets, and eight triples of fields."""
    w = lambda i: (F.element_at(a, i), F.element_at(b, i))
    x = w(4)[0].bitwiseXOR(w(4)[1])
    field = lambda shift, mask: F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(mask).cast("long"))
    some = lambda v: F.bit_count(v.bitwiseOR(F.shiftrightunsigned(v, 1)).bitwiseOR(F.shiftrightunsigned(v, 2)).bitwiseAND(F.lit(0x0101010101010101).cast("long")))
    unequal = some(field(0, 0x0707070707070707)) + some(field(3, 0x0707070707070707)) + some(field(6, 0x0303030303030303))
    return jaccard_bits(*w(1)) + equal_symbols(*w(2)) + jaccard_bits(*w(3)) + idiv((24 - unequal) * 64, 24)


def route_class(scores: dict[str, tuple[Column, Column]], bars: dict[str, tuple[int, int]] = BARS) -> Column:
    """``absent, fast, reject`` or ``defer`` of the families' (score, measurable)."""
    any_of = lambda xs: F.array_contains(F.array(*xs), True)
    measured = any_of([m for _, m in scores.values()])
    certain = any_of([m & (s >= bars[k][0]) for k, (s, m) in scores.items()])
    something = any_of([m & (s >= bars[k][1]) for k, (s, m) in scores.items()])
    return F.when(~measured, "absent").when(certain, "fast").when(something, "defer").otherwise("reject")

"""64-bit words as signed longs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Masks of the halves that a reversal swaps, and their distance.
_SWAPS = ((0x5555555555555555, 1), (0x3333333333333333, 2), (0x0F0F0F0F0F0F0F0F, 4), (0x00FF00FF00FF00FF, 8), (0x0000FFFF0000FFFF, 16))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it stands in it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_words(a: Column, b: Column) -> Column:
    """Distance of two descriptors, arrays of words."""
    return F.aggregate(F.zip_with(a, b, hamming), F.lit(0), lambda acc, d: acc + d)


def rotate(x: Column, k: int) -> Column:
    k %= 64
    return x if k == 0 else F.shiftleft(x, k).bitwiseOR(F.shiftrightunsigned(x, 64 - k))


def reverse(x: Column) -> Column:
    for mask, k in _SWAPS:
        m = F.lit(mask).cast("long")
        x = F.shiftleft(x.bitwiseAND(m), k).bitwiseOR(F.shiftrightunsigned(x, k).bitwiseAND(m))
    return rotate(x, 32)


def unsigned_order(x: Column) -> Column:
    """A long that sorts as ``x`` does without a sign."""
    return x.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def mirror(descriptor: Column) -> Column:
    """A descriptor of four words with its halves swapped."""
    return F.concat(F.slice(descriptor, 3, 2), F.slice(descriptor, 1, 2))


def word_of(bits: Column) -> Column:
    """64 booleans, the lowest bit first, as a word."""
    at = F.transform(bits, lambda b, i: F.when(b, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(at, F.lit(0).cast("long"), lambda acc, w: acc.bitwiseOR(w))


def sign_code(vector: Column) -> Column:
    """One bit for each of the first 64 components: whether it is negative."""
    return word_of(F.transform(F.slice(vector, 1, 64), lambda x: x < 0))


def shifted_descriptor(vector: Column, shifts: Sequence[int] = (1, 7, 19, 31)) -> Column:
    """A descriptor of comparisons: bit i of word w tells whether component i is less than the one ``shifts[w]`` further."""
    return let(vector, lambda v: F.array(*(word_of(F.zip_with(v, F.concat(F.slice(v, s + 1, 64), F.slice(v, 1, s)), lambda a, b: a < b)) for s in shifts)))


def project(descriptor: Column, places: Sequence[int]) -> Column:
    """The code of some of a descriptor's bits: bit i of the code is the bit at ``places[i]``."""
    out = F.lit(0).cast("long")
    for i, p in enumerate(places):
        bit = F.shiftrightunsigned(F.element_at(descriptor, p // 64 + 1), p % 64).bitwiseAND(F.lit(1).cast("long"))
        out = out + F.shiftleft(bit, i)
    return out.cast("int")


def bytes_of(word: Column) -> Column:
    """The eight bytes of a word, the lowest first, with their place."""
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct(i.alias("idx"), F.call_function("shiftrightunsigned", word, i * 8).bitwiseAND(F.lit(255).cast("long")).cast("int").alias("val")))


def text_key(text: Column) -> Column:
    """A key of 52 bits of any text, which other engines can compute as well."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")

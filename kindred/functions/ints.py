"""Integer arithmetic as columns: decisions are made in whole numbers from 0 to ``SCALE``, so every engine agrees.

Division truncates toward zero and a division by zero gives 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 10_000
#: The upper ends of the classes of run lengths; longer runs are in the last class.
RUN_LADDER = (1, 2, 3, 4, 5, 6, 8, 10, 13, 16, 22, 30, 42, 60, 90)


def _long(x: Column | int) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def idiv(a: Column | int, b: Column | int) -> Column:
    a, b = _long(a), _long(b)
    return F.when(b == 0, F.lit(0).cast("long")).otherwise(_div(a, F.when(b == 0, 1).otherwise(b)))


def _div(a: Column, b: Column) -> Column:
    """SQL's ``a div b``, which the functions module lacks."""
    return F.call_function("div", a, b)


def clamp(x: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(x, _long(low)), _long(high))


def isqrt(n: Column) -> Column:
    """The largest r with r * r <= n; 0 for what is not positive."""
    n = _long(n)
    guess = F.least(F.floor(F.sqrt(F.greatest(n, F.lit(0)).cast("double"))).cast("long"), _long(3_037_000_499))
    high = F.when(guess * guess > n, guess - 1).otherwise(guess)
    up = high + 1
    return F.when(n <= 0, 0).when((up <= 3_037_000_499) & (F.least(up, _long(3_037_000_499)) * F.least(up, _long(3_037_000_499)) <= n), up).otherwise(high).cast("long")


def chance_correct(raw: Column, control: Column) -> Column:
    """``raw`` less what chance reaches, on the scale of what is left."""
    return F.when(control >= SCALE, F.lit(0).cast("long")).otherwise(clamp(idiv((raw - control) * SCALE, SCALE - control), 0, SCALE))


def lut(x: Column, points: Sequence[tuple[int, int]]) -> Column:
    """A piecewise linear function through ``points``, in whole numbers, held beyond its ends."""
    x = clamp(_long(x), 0, SCALE)
    out = F.when(x >= points[-1][0], _long(points[-1][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when(x <= x1, y0 + idiv((y1 - y0) * (x - x0), x1 - x0))
    return out


def confidence(best: Column, second: Column) -> Column:
    """1 to 64: by how much the best distance is better than the second."""
    return 1 + idiv((_long(second) - _long(best)) * 63, F.greatest(_long(second), _long(1)))


def strength_compat(a: Column, b: Column) -> Column:
    """32 to 64: how alike two strengths are."""
    low, high = F.greatest(F.least(_long(a), _long(b)), _long(1)), F.greatest(_long(a), _long(b), _long(1))
    return clamp(idiv(low * 64, high), 32, 64)


def run_class(n: Column) -> Column:
    """The class, 0 to 15, of a run's length."""
    out = F
    for i, top in enumerate(RUN_LADDER):
        out = out.when(n <= top, i)
    return out.otherwise(len(RUN_LADDER))


def minhash_level(equal: Column) -> Column:
    """0, 1, 2 or 3 for none, one, two or three, and more equal keys."""
    return F.when(equal <= 1, equal.cast("int")).when(equal <= 3, 2).otherwise(3)


def grid_cell(x: Column, g: int) -> Column:
    """The cell, of ``g``, of a coordinate from 0 to 65535."""
    return F.shiftright(clamp(_long(x), 0, 65535) * g, 16).cast("int")


def round_up(x: Column, step: int) -> Column:
    """The next multiple of ``step`` above ``x``."""
    return (idiv(x, step) + 1) * step

"""Rounding that agrees with the exact binary value of a double.

Spark's ``round``/``bround`` look at the shortest decimal form of a double, so
``bround(0.35, 1)`` is 0.4 although the stored value lies below 0.35. Scores here are
rounded half-even on the stored value instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 2 * 10^digits as a sum of powers of two: each product with a power of two is exact,
# so is each difference taken in this order, and with them the sign of the distance
# between the value and the midpoint.
def powers(digits: int) -> list[float]:
    twice = 2 * 10**digits
    return [float(1 << bit) for bit in range(twice.bit_length() - 1, -1, -1) if twice >> bit & 1]


def _floor_and_gap(value: Column, digits: int) -> tuple[Column, Column]:
    floor = F.floor(value * float(10**digits))
    gap = (floor * 2 + 1).cast("double")
    for power in powers(digits):
        gap = gap - value * F.lit(power)
    return floor, gap


def round_binary(value: Column, digits: int = 1) -> Column:
    """Half-even rounding of a non-negative double (below 2^30) to a few digits."""
    if digits == 0:
        return F.rint(value)
    floor, gap = _floor_and_gap(value, digits)
    whole = F.when(gap < 0, floor + 1).when(gap > 0, floor).otherwise(floor + floor % 2)
    return whole.cast("double") / F.lit(float(10**digits))


def fixed_text(value: Column, digits: int) -> Column:
    """Fixed-point text of a non-negative double, exact ties rounded up."""
    floor, gap = _floor_and_gap(value, digits)
    whole = F.when(gap <= 0, floor + 1).otherwise(floor)
    scale = 10**digits
    fraction = F.lpad((whole % scale).cast("string"), digits, "0")
    return F.concat(F.floor(whole / scale).cast("string"), F.lit("."), fraction)


def tenths(value: Column) -> Column:
    """A one-digit double as whole tenths."""
    return F.rint(value * 10.0).cast("bigint")


def mean_of_tenths(value: Column) -> Column:
    """Mean of one-digit doubles, summed as whole tenths so row order cannot matter."""
    return (F.sum(tenths(value)).cast("double") / F.lit(10.0)) / F.count(value)

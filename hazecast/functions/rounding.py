"""Rounding that agrees with binary half-even rounding.

``F.bround(x, d)`` rounds the *decimal text* of a double, so for d > 0 it can
disagree with rounding the binary value (Python ``round`` and SQL engines that
scale in binary).  Scaling first and rounding at 0 digits removes the
difference: a double whose fraction is exactly .5 is printed as ``.5``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(col: Column, digits: int = 0) -> Column:
    if digits == 0:
        return F.bround(col, 0)
    scale = float(10 ** digits)
    return F.bround(col * F.lit(scale), 0) / F.lit(scale)


#: decimals that hold a double's digits; magnitudes whose sums fit
DIGITS, LARGEST = 18, 1e17


def as_decimal(col: Column) -> Column:
    """The double as a decimal with 18 places; null for NaN and for what a decimal does not hold."""
    x = col.cast("double")
    return F.when(F.abs(x) < F.lit(LARGEST), x.cast(f"decimal(38,{DIGITS})"))


def exact_mean(col: Column) -> Column:
    """Mean with an exact decimal sum, one division in double; NaN counts as null.

    Order-free, so every engine and partitioning gives identical bits.  Where a value of the group is
    too large for the decimal (1e17, infinity), the mean is that of the doubles.
    """
    x = F.when(~F.isnan(col.cast("double")), col.cast("double"))
    dec = as_decimal(x)
    exact = F.try_sum(dec).cast("double") / F.nullif(F.count(x), F.lit(0))
    return F.when(F.count(dec) == F.count(x), exact).otherwise(F.avg(x))

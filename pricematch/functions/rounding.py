"""Rounding of binary floats on their exact value."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Splits a 53-bit significand into two halves whose products are exact.
_SPLIT = 134217729.0


def round_half_even(x: Column, digits: int = 2) -> Column:
    """Round a double half-to-even, judging ties on its exact binary value.

    ``round`` and ``bround`` look at the shortest decimal text instead, so they
    send 2.675 (really 2.67499...) up. Scaling rounds as well: only where that
    gives a tie does the error of the product tell which side the value was on.
    """
    x = x.cast("double")
    scale = F.lit(float(10**digits))
    scaled = x * scale
    nearest = F.rint(scaled)

    wide = x * F.lit(_SPLIT)
    high = wide - (wide - x)
    error = (high * scale - scaled) + (x - high) * scale
    beside = F.when(error > 0, scaled + 0.5).when(error < 0, scaled - 0.5).otherwise(nearest)
    return F.when(F.abs(scaled - nearest) == 0.5, beside).otherwise(nearest) / scale

"""Return percentages of a set of complementary prices."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pricematch.functions.rounding import round_half_even


def rtp_hedge(first: Column, second: Column, third: Column | None = None) -> Column:
    """Return of the first leg after the other legs are covered from it.

    Not symmetric in its legs. Above 100 the combination pays whatever happens;
    null where a price is zero.
    """
    one = F.lit(1.0)
    covered = one - F.try_divide(one, second.cast("double"))
    if third is not None:
        covered = covered - F.try_divide(one, third.cast("double"))
    return round_half_even(first.cast("double") * covered * F.lit(100.0))


def rtp_harmonic(first: Column, second: Column, third: Column | None = None) -> Column:
    """Return of stakes spread so that every outcome pays the same."""
    a, b = first.cast("double"), second.cast("double")
    if third is None:
        return round_half_even(F.try_divide(a * b, a + b) * F.lit(100.0))
    c = third.cast("double")
    return round_half_even(F.try_divide(a * b * c, a * b + b * c + a * c) * F.lit(100.0))


RTP = {"hedge": rtp_hedge, "harmonic": rtp_harmonic}

"""Prices: from feed text to two-decimal numbers."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, functions as F

from pricematch.functions.rounding import round_half_even

PRICE = "decimal(10,2)"
HUNDREDTH = Decimal("0.01")


def _plain(text: Column) -> Column:
    """Whether the text is a price as it stands: nothing to round, and it fits."""
    return text.rlike(r"^[0-9]{1,7}(\.[0-9]{1,2})?\z")


def _apart(odd: Column, rule: Callable[[Column], Column]) -> Column:
    """``rule`` for the odd price that is not plain, kept out of the code that is generated for all: with it, that
    would be too long for the JVM to compile."""
    return F.transform(F.array(odd), rule)[0]


def normalise_odds(odd: Column) -> Column:
    """Price text to a two-decimal price; null where the text is no price.

    Decimal text is rounded half-even. ``n/d`` is the profit per unit, so the
    price is that plus the stake. ``Evens`` is 1/1. A missing price is 1.
    """
    # Of short whole numbers a quotient in hundredths is as near to a tie as the true one only where it is one.
    small = odd.rlike(r"^[0-9]{1,6}/[1-9][0-9]{0,3}\z")
    at = F.instr(odd, "/")
    n, d = F.left(odd, at - 1).try_cast("double"), F.substr(odd, at + 1).try_cast("double")
    cents = F.rint(F.try_divide(F.lit(100.0) * n, d)).cast("bigint") + 100
    return (
        F.when(odd.isNull(), F.lit(1).cast(PRICE))
        .when(_plain(odd), odd.try_cast(PRICE))
        .when(small, odds_from_cents(cents))
        .otherwise(_apart(odd, _any_odds))
    )


def _any_odds(odd: Column) -> Column:
    # A failed cast costs far more than a look at the text, so each form of a
    # price is only cast as what it looks like.
    text = F.when(odd == "Evens", F.lit("1/1")).otherwise(odd)
    is_fraction = F.contains(text, F.lit("/"))
    parts = F.split(text, "/")
    profit = F.try_divide(
        F.get(parts, 0).try_cast("decimal(18,8)"), F.get(parts, 1).try_cast("decimal(18,8)")
    )
    fraction = F.when(F.size(parts) == 2, F.bround(profit, 2) + 1)
    plain = F.bround(text.try_cast("decimal(38,28)"), 2)
    return F.when(is_fraction, fraction.try_cast(PRICE)).otherwise(plain.try_cast(PRICE))


def normalise_numeric_odds(odd: Column) -> Column:
    """As ``normalise_odds`` for a price that arrived as a JSON number.

    A number is a binary float, and ties are judged on that float.
    """
    rounded, text = lambda x: round_half_even(x.try_cast("double")).try_cast(PRICE), odd.cast("string")
    return (
        F.when(odd.isNull(), F.lit(1).cast(PRICE))
        .when(_plain(text), text.try_cast(PRICE))
        .otherwise(_apart(odd, rounded))
    )


def odds_from_cents(cents: Column) -> Column:
    """A price in hundredths to a two-decimal price."""
    return (cents.cast("decimal(18,0)") * F.lit(HUNDREDTH)).try_cast(PRICE)

"""Raw quotes to the quotes table's form."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from pricematch.fixed_values import ALLOWED_LABELS, QUOTE_KEYS, QUOTE_WIDTHS
from pricematch.functions.odds import normalise_numeric_odds, normalise_odds
from pricematch.operators.filters import allowed_only

REASON = "reason"

#: Every reason a feed or the normalisation gives.
REASONS = [
    "unreadable page", "event not listed or started", "not a match", "no label", "no date", "no event id",
    "unknown market or line", "price", "no price", *(f"no {key}" for key in QUOTE_KEYS),
]


def normalise_label(df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Replace labels the bookmaker's dictionary knows; keep the others."""
    entries = dictionary.select(
        F.col("bookmaker").alias("__bookmaker"),
        F.col("original").alias("__original"),
        F.nullif(F.col("canonical"), F.lit("")).alias("__canonical"),
    )
    return (
        df.join(
            entries,
            (F.col("bookmaker") == F.col("__bookmaker")) & (F.col("bet") == F.col("__original")),
            "left",
        )
        .withColumn("bet", F.coalesce("__canonical", "bet"))
        .select(df.columns)
    )


def truncate_to_width(df: DataFrame, widths: dict[str, int] = QUOTE_WIDTHS) -> DataFrame:
    """Cut text to its column's width. Text of no more bytes than that is not looked at."""
    cut = lambda c, n: F.when(F.octet_length(c) <= n, F.col(c)).otherwise(F.left(F.col(c), F.lit(n)))
    return df.withColumns({c: cut(c, n) for c, n in widths.items() if c in df.columns})


def reject(df: DataFrame, reason: str, when: Column) -> DataFrame:
    """Mark rows for quarantine; the first reason a row meets stays."""
    seen = F.col(REASON) if REASON in df.columns else F.lit(None).cast("string")
    return df.withColumn(REASON, F.coalesce(seen, F.when(when, F.lit(reason))))


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.col(REASON).isNull()).drop(REASON)


def rejected(df: DataFrame) -> DataFrame:
    return df.where(F.col(REASON).isNotNull())


def normalise_quotes(
    raw: DataFrame,
    dictionary: DataFrame,
    allowed: Iterable[str] | DataFrame = tuple(ALLOWED_LABELS),
    keep_rejects: bool = False,
) -> DataFrame:
    """Labels, allow-list, prices and widths, with a ``reason`` on bad rows.

    ``betOdd`` is text; where ``odd_is_number`` is true it was a JSON number.
    The steps are narrow but for the dictionary join, which is broadcast.
    Rows that already have a reason come without an allowed label; ``keep_rejects`` lets them through with it.
    The list must then be given as labels.
    """
    known = normalise_label(raw, dictionary)
    if not keep_rejects:
        known = allowed_only(known, allowed)
    elif isinstance(allowed, DataFrame):
        raise ValueError("with keep_rejects the allowed labels are a list")
    else:
        known = known.where(F.col(REASON).isNotNull() | F.col("bet").isin(*allowed))
    is_number = F.col("odd_is_number") if "odd_is_number" in raw.columns else F.lit(False)
    odd = F.col("betOdd").cast("string")
    priced = known.withColumn(
        "betOdd",
        F.when(is_number, normalise_numeric_odds(odd)).otherwise(normalise_odds(odd)),
    ).drop("odd_is_number")
    priced = truncate_to_width(priced, {c: n for c, n in QUOTE_WIDTHS.items() if c != "betOdd"})
    priced = reject(priced, "price", F.col("betOdd").isNull())
    for key in QUOTE_KEYS:
        priced = reject(priced, f"no {key}", F.col(key).isNull())
    return priced

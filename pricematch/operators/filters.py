"""Row filters."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pricematch.fixed_values import EXCLUDED_TYPE_WORDS, NO_ID
from pricematch.functions.dates import naive_timestamp


def bets_in(df: DataFrame, bets: Iterable[str] | DataFrame, column: str = "bet") -> DataFrame:
    """Rows whose bet is listed. A Python list is pushed down to the scan."""
    if isinstance(bets, DataFrame):
        listed = bets.select(F.col(bets.columns[0]).alias(column)).distinct()
        return df.join(listed, column, "left_semi").select(df.columns)
    return df.where(F.col(column).isin(list(bets)))


def allowed_only(df: DataFrame, allowed: Iterable[str] | DataFrame, column: str = "bet") -> DataFrame:
    """Rows whose canonical label is on the allow-list."""
    return bets_in(df, allowed, column)


def has_excluded_word(kind: Column, words: Iterable[str] = EXCLUDED_TYPE_WORDS) -> Column:
    """Whether a market type holds one of the words; case matters."""
    return F.coalesce(kind.rlike("|".join(re.escape(w) for w in words)), F.lit(False))


def exclude_types(df: DataFrame, column: str, words: Iterable[str] = EXCLUDED_TYPE_WORDS) -> DataFrame:
    return df.where(~has_excluded_word(F.col(column), words))


def future_only(
    df: DataFrame, run_ts: datetime | Column, inclusive: bool, column: str = "date"
) -> DataFrame:
    """Events that have not started. Feeds differ on an event starting right now."""
    now = naive_timestamp(run_ts)
    return df.where(F.col(column) >= now if inclusive else F.col(column) > now)


def min_events(df: DataFrame, more_than: int, column: str) -> DataFrame:
    """Tournaments with more events than the bound; unknown counts are dropped."""
    return df.where(F.col(column) > more_than)


def not_like_any(df: DataFrame, column: str, patterns: Iterable[str]) -> DataFrame:
    """Rows that match none of the LIKE patterns, whatever the case."""
    return df.where(reduce(lambda a, b: a & b, [~F.col(column).ilike(p) for p in patterns]))


def eq_filter(df: DataFrame, **values: str) -> DataFrame:
    """Rows equal to every given value."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c) == v for c, v in values.items()]))


def not_null(df: DataFrame, column: str = "betRadarID") -> DataFrame:
    return df.where(F.col(column).isNotNull())


def rtp_above(df: DataFrame, threshold: float) -> DataFrame:
    return df.where(F.col("RTP") > threshold)


def is_tournament_link(href: Column) -> Column:
    """Football links down to a tournament; the outright pages hold results."""
    slashes = F.length(href) - F.length(F.replace(href, F.lit("/"), F.lit("")))
    return F.contains(href, F.lit("Football")) & (slashes >= 4) & ~F.contains(href, F.lit("Outright"))


def link_filter(df: DataFrame, league: str | None = None, column: str = "href") -> DataFrame:
    keep = is_tournament_link(F.col(column))
    if league:
        keep = keep & F.contains(F.col(column), F.lit(league))
    return df.where(keep)


def drop_unresolved(df: DataFrame, column: str = "betRadarID") -> DataFrame:
    """Drop rows that still have no shared id."""
    return df.where(~F.col(column).eqNullSafe(F.lit(NO_ID)))

"""Dates in feeds. All results are wall-clock times without a zone."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

from pricematch.fixed_values import ITALIAN_MONTHS


def naive_timestamp(value: datetime | Column) -> Column:
    """A run time given as a datetime or a column, as a zone-less timestamp."""
    if isinstance(value, datetime):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return value.cast("timestamp_ntz")


def parse_epoch_date(text: Column, zone: str = "UTC") -> Column:
    """``/Date(ms+hhmm)/`` to the wall clock of ``zone``; the offset is ignored."""
    millis = F.nullif(F.regexp_extract(text, r"\((-?[0-9]+)\+", 1), F.lit("")).cast("bigint")
    seconds = F.make_dt_interval(secs=(millis / 1000).cast("decimal(18,6)"))
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + seconds
    if zone == "UTC":
        return utc
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def parse_iso_date(text: Column, tz_mode: str = "fixed_plus_2") -> Column:
    """ISO UTC text to local time.

    ``fixed_plus_2`` adds two hours all year round; any other mode is the name
    of a zone, whose own summer time applies.
    """
    utc = F.replace(text, F.lit("Z"), F.lit("")).try_cast("timestamp_ntz")
    if tz_mode == "fixed_plus_2":
        return utc + F.expr("INTERVAL 2 HOURS")
    return F.convert_timezone(F.lit("UTC"), F.lit(tz_mode), utc)


def parse_italian_date(text: Column, run_ts: datetime | Column) -> Column:
    """``27 Apr 2021 12:00``, ``28 Apr 10:00`` or ``23:00``.

    The length tells the form. Missing parts come from the run time.
    """
    now = naive_timestamp(run_ts)
    parts = F.split(text, " ")
    clock = F.split(F.element_at(parts, -1), ":")
    months = F.create_map(
        *[F.lit(v) for i, m in enumerate(ITALIAN_MONTHS, 1) for v in (m, i)]
    )
    month = F.try_element_at(months, F.initcap(F.get(parts, 1)))
    day = F.get(parts, 0).try_cast("int")
    size = F.length(text)

    def at(year: Column, month: Column, day: Column) -> Column:
        return F.try_make_timestamp_ntz(
            years=year,
            months=month,
            days=day,
            hours=F.get(clock, 0).try_cast("int"),
            mins=F.get(clock, 1).try_cast("int"),
            secs=F.lit(0).cast("decimal(16,6)"),
        )

    return (
        F.when(size == 17, at(F.get(parts, 2).try_cast("int"), month, day))
        .when(size == 12, at(F.year(now), month, day))
        .when(size == 5, at(F.year(now), F.month(now), F.dayofmonth(now)))
    )

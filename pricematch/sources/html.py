"""Prices and links in raw HTML.

Real pages are rarely well-formed XML, so they are read with patterns instead of
XPath. Patterns run over the whole page.
"""

from __future__ import annotations

from datetime import datetime
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, functions as F

from pricematch.fixed_values import EVENT_SPLITTERS, NO_ID
from pricematch.functions.dates import parse_italian_date
from pricematch.functions.names import normalise_split_event
from pricematch.operators.normalise import REASON
from pricematch.sources.feeds import each

_ROW = r"""<div\b[^>]*\bclass\s*=\s*(?:"(?:[^">]*\s)?coupon-row(?:\s[^">]*)?"|'(?:[^'>]*\s)?coupon-row(?:\s[^'>]*)?')"""
# In the following the quote is group 1, so that the other kind can be in a value.
_PRICE = r"""(?s)<span\b[^>]*\bdata-selection-key\s*=\s*(["'])(.*?)\1[^>]*>([^<]*)<"""
_NAME = r"""(?s)^<div\b[^>]*\bdata-event-name\s*=\s*(["'])(.*?)\1"""
_DATE = r"""<td\b[^>]*\bclass\s*=\s*(["'])(?:(?!\1)[^>])*date(?:(?!\1)[^>])*\1[^>]*>\s*([^<]*?)\s*<"""
_HIDDEN = r"""(?s)<div\b[^>]*\bclass\s*=\s*(["'])(?:[^"'>]*\s)?hidden-links(?:\s[^"'>]*)?\1[^>]*>(.*?)</div>"""
_HREF = r"""(?s)\bhref\s*=\s*(["'])(.*?)\1"""
_REFERENCE = r"&(?:#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);"
#: Characters of the named references.
_NAMED = {f"&{name};": chr(code) for name, code in name2codepoint.items()} | {"&apos;": "'"}


def _referenced(piece: Column) -> Column:
    """The character of a reference; a name that is not known, or a number of no character, stays as it is."""
    digits = F.regexp_extract(piece, r"^&#[xX]?([0-9a-fA-F]+);$", 1)
    code = F.when(piece.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("long")
    known = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    named = F.create_map(*(F.lit(x) for pair in _NAMED.items() for x in pair))
    return F.coalesce(F.when(piece.startswith("&#") & known, char), F.try_element_at(named, piece), piece)


def unescape(text: Column) -> Column:
    """Named and numeric character references as characters, each once: ``&amp;lt;`` is ``&lt;``."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s){_REFERENCE}|[^&]+|&"), 0)
    read = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(f"^{_REFERENCE}$"), _referenced(p)).otherwise(p)), "")
    return F.when(F.contains(text, F.lit("&")), read).otherwise(text)


def extract_html_quotes(
    df: DataFrame, run_ts: datetime | Column, splitter: str = EVENT_SPLITTERS["MarathonBet"],
    column: str = "html",
) -> DataFrame:
    """Coupon rows to raw quotes, without a shared id.

    A price's cell names its selection; the row names its event and date. A row without a price that reads
    gives one reject.
    """
    kept = [c for c in df.columns if c != column]
    # A zero-width cut before each row leaves whole rows, and the page's start.
    blocks = each(df, kept, F.split(column, f"(?={_ROW})"), "row", at="i")
    blocks = blocks.where(F.col("row").rlike(f"^{_ROW}"))
    rows = blocks.select(
        *kept, "i",
        normalise_split_event(unescape(F.regexp_extract("row", _NAME, 2)), splitter).alias("event"),
        parse_italian_date(F.regexp_extract("row", _DATE, 2), run_ts).alias("date"),
        F.arrays_zip(
            F.regexp_extract_all("row", F.lit(_PRICE), 2).alias("bet"),
            F.regexp_extract_all("row", F.lit(_PRICE), 3).alias("odd"),
        ).alias("prices"),
    )
    none = F.array(F.struct(F.lit(None).cast("string").alias("bet"), F.lit(None).cast("string").alias("odd")))
    prices = F.when(F.size("prices") > 0, F.col("prices")).otherwise(none)
    return each(rows, [*kept, "i", "event", "date"], prices, "o", at="j").select(
        *kept,
        F.lit(NO_ID).cast("bigint").alias("betRadarID"),
        "event",
        "date",
        unescape(F.col("o.bet")).alias("bet"),
        F.trim("o.odd").alias("betOdd"),
        F.lit(False).alias("odd_is_number"),
        F.array("i", "j").alias("position"),
        F.when(F.col("event").isNull(), "not a match").when(F.col("o.bet").isNull(), "no price").alias(REASON),
    )


def extract_links(df: DataFrame, column: str = "html", hidden_only: bool = True) -> DataFrame:
    """Link targets of a page, by default those of its hidden list alone."""
    kept = [c for c in df.columns if c != column]
    if hidden_only:
        scope = F.array_join(F.regexp_extract_all(column, F.lit(_HIDDEN), 2), "\n")
    else:
        scope = F.col(column)
    links = each(df, kept, F.regexp_extract_all(scope, F.lit(_HREF), 2), "href")
    return links.withColumn("href", unescape(F.col("href")))

"""Complementary prices for one event at different bookmakers.

A match is a self-join. Its legs meet on (event, market), where the market is
named after the seed's selection: a partner is first relabelled with the markets
it completes, by a dictionary small enough for Catalyst to broadcast by itself.
All joins of a match share one partitioning, that of the event id alone, so the
pairs of a three-way match are not shuffled again, and an upsert by id neither.

Input quotes hold one row per (bookmaker, id, event, bet), the key of the quotes
table. Then a market has at most one leg a bookmaker and role, however many raw
rows an event had, and its fan-out is bounded by the number of bookmakers.
Use ``dedupe`` on raw quotes first: it drops copies before its shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from pricematch.fixed_values import NO_ID
from pricematch.functions.dates import naive_timestamp
from pricematch.functions.labels import strip_label_type
from pricematch.functions.scoring import RTP

PRICE = "decimal(10,2)"


def lookup_counter(quotes: DataFrame, counters: DataFrame) -> DataFrame:
    """Quotes with their counter selection(s); quotes without one are dropped."""
    return quotes.join(counters, "bet").select(*quotes.columns, *counters.columns[1:])


def tag_bookmaker(df: DataFrame, name: str) -> DataFrame:
    """Tag every row with the feed it came from."""
    return df.withColumn("bookmaker", F.lit(name))


def stamp_run(df: DataFrame, run_ts: datetime | Column) -> DataFrame:
    """One time for the whole run."""
    return df.withColumn("insertingdate", naive_timestamp(run_ts))


def with_id(quotes: DataFrame) -> DataFrame:
    """Quotes whose event has an id. -1 and null say that it is unknown: such rows share no event."""
    return quotes.where(F.col("betRadarID").isNotNull() & (F.col("betRadarID") != NO_ID))


def _by_event(quotes: DataFrame) -> DataFrame:
    """Quotes with an id, all of an event in one task: the joins of a match keep to that, and so may what follows."""
    return with_id(quotes).repartition("betRadarID")


def _seeds(quotes: DataFrame, counters: DataFrame) -> DataFrame:
    """Quotes on selections the dictionary has a market for."""
    return quotes.join(counters.select("bet"), "bet", "left_semi").withColumn(
        "__market", F.col("bet")
    )


def _partners(quotes: DataFrame, counters: DataFrame, counter: str, n: int) -> DataFrame:
    """Quotes as leg ``n`` of the markets in which ``counter`` names them."""
    markets = counters.select(F.col("bet").alias("__market"), F.col(counter).alias(f"bet{n}"))
    return (
        quotes.withColumnsRenamed(
            {"bookmaker": f"bookmaker{n}", "bet": f"bet{n}", "betOdd": f"betOdd{n}"}
        )
        .join(markets, f"bet{n}")
    )


def _meet(seeds: DataFrame, partners: DataFrame, n: int) -> DataFrame:
    """Join leg ``n`` on (event id, market).

    The market is asked for by two bounds, not as a key: a join on two keys would shuffle both sides again by both.
    What an event's task compares more for it is bounded by the selections of the dictionary. Legs are as many as the
    quotes, whatever their files' compressed size makes of them, so they are merged and never broadcast.
    """
    partners = partners.withColumnsRenamed({"betRadarID": "__id", "__market": f"__market{n}"})
    same = (F.col("__market") <= F.col(f"__market{n}")) & (F.col("__market") >= F.col(f"__market{n}"))
    return seeds.join(partners.hint("merge"), (F.col("betRadarID") == F.col("__id")) & same).drop("__id", f"__market{n}")


def project_leg(df: DataFrame, legs: int, rtp: str, strip: bool) -> DataFrame:
    """Output columns: the first leg names the event, each leg its own price."""
    prices = [F.col("betOdd")] + [F.col(f"betOdd{n}") for n in range(2, legs + 1)]
    names = [("bookmaker", "bet", "betOdd")]
    names += [(f"bookmaker{n}", f"bet{n}", f"betOdd{n}") for n in range(2, legs + 1)]
    out = [RTP[rtp](*prices).try_cast(PRICE).alias("RTP")]
    out += [F.col(c) for c in ("tournament", "betRadarID", "event", "date") if c in df.columns]
    for n, (bookmaker, bet, odd) in enumerate(names, 1):
        label = strip_label_type(F.col(bet)) if strip else F.col(bet)
        out += [
            F.col(bookmaker).alias(f"bookmaker{n}"),
            label.alias(f"bet{n}"),
            F.col(odd).alias(f"betOdd{n}"),
        ]
    return df.select(out)


def _columns(quotes: DataFrame, *wanted: str) -> DataFrame:
    return quotes.select([c for c in wanted if c in quotes.columns])


def match_two_way(
    quotes: DataFrame, counters: DataFrame, rtp: str = "hedge", strip: bool = True
) -> DataFrame:
    """Pairs (selection, complement) of one id at two bookmakers, both ways round.

    The hedge return differs by direction, so (A, B) and (B, A) are both kept. Quotes
    without an id match nothing.
    """
    seeds = _seeds(_by_event(quotes), counters)
    partners = _partners(
        _columns(seeds, "betRadarID", "bookmaker", "bet", "betOdd"), counters, "counter", 2
    )
    pairs = _meet(seeds, partners, 2).where(F.col("bookmaker") != F.col("bookmaker2"))
    return project_leg(pairs, 2, rtp, strip)


def match_three_way(
    quotes: DataFrame, counters: DataFrame, rtp: str = "hedge", strip: bool = True
) -> DataFrame:
    """Triples of complementary selections of one id at three bookmakers.

    Every selection seeds its own triples, as the hedge return depends on it.
    """
    seeds = _seeds(_by_event(quotes), counters)
    legs = _columns(seeds, "betRadarID", "bookmaker", "bet", "betOdd")
    pairs = _meet(seeds, _partners(legs, counters, "counter1", 2), 2).where(F.col("bookmaker") != F.col("bookmaker2"))
    triples = _meet(pairs, _partners(legs, counters, "counter2", 3), 3).where(
        (F.col("bookmaker") != F.col("bookmaker3")) & (F.col("bookmaker2") != F.col("bookmaker3"))
    )
    return project_leg(triples, 3, rtp, strip)


def _id_link(ident: Column) -> Column:
    """Null for rows without a shared id, which then cannot meet on it."""
    return F.when(ident != NO_ID, F.concat(F.lit("I"), ident.cast("string")))


def _event_link(event: Column, date: Column) -> Column:
    return F.concat(F.lit("E"), date.cast("string"), F.lit("|"), event)


def _linked(df: DataFrame, *links: Column) -> DataFrame:
    """One row per link; rows can meet wherever they share one."""
    return df.withColumn("__link", F.explode(F.array(*links))).where(F.col("__link").isNotNull())


def _same_id(left: str, right: str) -> Column:
    """Ids that already bring two rows together, so their event link must not."""
    return F.coalesce((F.col(left) == F.col(right)) & (F.col(left) != NO_ID), F.lit(False))


def _fuzzy_legs(quotes: DataFrame, counters: DataFrame, counter: str, n: int) -> DataFrame:
    legs = _partners(
        _columns(quotes, "betRadarID", "event", "date", "bookmaker", "bet", "betOdd"),
        counters, counter, n,
    )
    return _linked(
        legs, _id_link(F.col("betRadarID")), _event_link(F.col("event"), F.col("date"))
    ).select(
        "__link", "__market", F.col("betRadarID").alias(f"__id{n}"),
        f"bookmaker{n}", f"bet{n}", f"betOdd{n}",
    )


def _fuzzy_pairs(quotes: DataFrame, counters: DataFrame, counter: str) -> DataFrame:
    seeds = _linked(
        _seeds(quotes, counters),
        _id_link(F.col("betRadarID")),
        _event_link(F.col("event"), F.col("date")),
    )
    by_event = F.col("__link").startswith("E")
    return (
        seeds.join(_fuzzy_legs(quotes, counters, counter, 2), ["__link", "__market"])
        .where(F.col("bookmaker") != F.col("bookmaker2"))
        .where(~(by_event & _same_id("betRadarID", "__id2")))
    )


def match_two_way_fuzzy(
    quotes: DataFrame, counters: DataFrame, rtp: str = "harmonic", strip: bool = False
) -> DataFrame:
    """Two-way pairs that share an id, or else event name and date.

    An OR between join keys would plan as a nested loop. Each row is instead
    exploded to its links and joined on them; a pair that shares both links is
    taken on the id alone, so no distinct is needed.
    """
    return project_leg(_fuzzy_pairs(quotes, counters, "counter"), 2, rtp, strip)


def match_three_way_fuzzy(
    quotes: DataFrame, counters: DataFrame, rtp: str = "harmonic", strip: bool = False
) -> DataFrame:
    """Three-way triples on shared ids, or else event name and date.

    The third leg may also share the id of the second: a seed without an id
    borrows the one its partner has.
    """
    pairs = _fuzzy_pairs(quotes, counters, "counter1").drop("__link")
    borrowed = F.when(~_same_id("betRadarID", "__id2"), _id_link(F.col("__id2")))
    pairs = _linked(
        pairs, _id_link(F.col("betRadarID")), borrowed, _event_link(F.col("event"), F.col("date"))
    )
    by_event = F.col("__link").startswith("E")
    triples = (
        pairs.join(_fuzzy_legs(quotes, counters, "counter2", 3), ["__link", "__market"])
        .where(
            (F.col("bookmaker") != F.col("bookmaker3"))
            & (F.col("bookmaker2") != F.col("bookmaker3"))
        )
        .where(~(by_event & (_same_id("betRadarID", "__id3") | _same_id("__id2", "__id3"))))
    )
    return project_leg(triples, 3, rtp, strip)


def same_selection_pairs(quotes: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """For each seed, the same selection of the same id at another bookmaker.

    ``seeds`` limits the left side, for instance to ``head(quotes, 1000, ...)``. Rows with id
    -1 or null have no known event and pair with nothing.
    """
    left = with_id(quotes if seeds is None else seeds)
    right = with_id(quotes).select(
        "betRadarID", "bet", F.col("bookmaker").alias("bookmaker2"), F.col("betOdd").alias("betOdd2")
    )
    return left.join(right, ["betRadarID", "bet"]).where(F.col("bookmaker") != F.col("bookmaker2"))


def exists_elsewhere(
    quotes: DataFrame, bets: Iterable[str], id_column: str = "betRadarID"
) -> DataFrame:
    """Quotes on listed bets that another bookmaker has for the same id.

    Another bookmaker exists when the smallest and the largest name differ. That
    is an aggregate with a map-side part, so the join back sees one row per
    (id, bet) where an EXISTS would probe every row of the group.
    """
    listed = quotes.where(F.col("bet").isin(list(bets)) & F.col("bookmaker").isNotNull())
    shared = (
        listed.groupBy(id_column, "bet")
        .agg(F.min("bookmaker").alias("__low"), F.max("bookmaker").alias("__high"))
        .where(F.col("__low") != F.col("__high"))
        .select(id_column, "bet")
    )
    return listed.join(shared, [id_column, "bet"], "left_semi").select(quotes.columns)


def join_on_event(quotes: DataFrame, other: DataFrame) -> DataFrame:
    """Distinct (bookmaker, event) of rows with an id whose event the other has.

    Only the left side is kept, so a semi-join does it without the fan-out. Both
    sides are made distinct before they are shuffled on the event.
    """
    return (
        quotes.where(F.col("betRadarID").isNotNull())
        .select("bookmaker", "event")
        .distinct()
        .join(other.select("event").distinct(), "event", "left_semi")
        .select("bookmaker", "event")
    )

"""Matches between bookmakers."""

from __future__ import annotations

from catalogue.views import (
    COUNTERS2_SQL, COUNTERS3_SQL, LOOSE_SQL, QUOTES_SQL, days_after, doubles, loose_quotes, quotes,
    sql_round2, sql_strip, table,
)
from pricematch.operators import filters, match, shape
from pricematch.operators.identity import backfill_ids, identity_groups, unify_ids
from pricematch.session import scratch_path
from pricematch.sinks.tables import write_version
from pricematch.sources.dictionaries import three_way_counters, two_way_counters
from pyspark.sql import DataFrame, SparkSession, functions as F

PRICES2 = ("RTP", "betOdd1", "betOdd2")
PRICES3 = (*PRICES2, "betOdd3")


def two_way_hedge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(match.match_two_way(quotes(spark, sf_dir), two_way_counters(spark)), *PRICES2)


def two_way_harmonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = match.match_two_way(quotes(spark, sf_dir), two_way_counters(spark), "harmonic", strip=False)
    return doubles(pairs, *PRICES2)


def three_way_hedge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(match.match_three_way(quotes(spark, sf_dir), three_way_counters(spark)), *PRICES3)


def three_way_harmonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    triples = match.match_three_way(quotes(spark, sf_dir), three_way_counters(spark), "harmonic", strip=False)
    return doubles(triples, *PRICES3)


def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(match.match_two_way_fuzzy(loose_quotes(spark, sf_dir), two_way_counters(spark)), *PRICES2)


def fuzzy_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    triples = match.match_three_way_fuzzy(loose_quotes(spark, sf_dir), three_way_counters(spark))
    return doubles(triples, *PRICES3)


def top_rtp(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = match.match_two_way(quotes(spark, sf_dir), two_way_counters(spark))
    return doubles(shape.top_rtp(pairs, 50, 95), *PRICES2)


def rtp_over_95(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = match.match_two_way(quotes(spark, sf_dir), two_way_counters(spark))
    best = filters.rtp_above(pairs, 95)
    return shape.order_by(doubles(best, *PRICES2), F.col("RTP").desc())


def lookup_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(match.lookup_counter(quotes(spark, sf_dir), two_way_counters(spark)), "betOdd")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quotes as a run stores them: the back-fill reads them twice."""
    base = scratch_path(spark, "loose-quotes")
    return spark.read.parquet(write_version(loose_quotes(spark, sf_dir), base, 0))


def backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = filters.drop_unresolved(backfill_ids(_stored(spark, sf_dir)))
    return doubles(resolved, "betOdd")


def loose_two_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes that lack an id match nothing."""
    found = match.match_two_way(loose_quotes(spark, sf_dir), two_way_counters(spark))
    return doubles(found, *PRICES2)


def backfilled_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = filters.drop_unresolved(backfill_ids(_stored(spark, sf_dir)))
    return doubles(match.match_two_way(resolved, two_way_counters(spark)), *PRICES2)


def _crossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as quotes of events that several ids share: three ids in a row have one name, and some names of two feeds
    go on from one such row to the next. Every seventh has no id, and a third of the others has one name."""
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(key.alias("k"), (F.col("o_custkey") % 4).alias("c"))
    name = lambda feed, k: F.concat(F.lit(f"{feed} "), F.floor(k).cast("string"))
    both = orders.select("k", F.explode(F.array(
        F.struct(F.lit("A").alias("bookmaker"), name("A", F.col("k") / 3).alias("event")),
        F.struct(F.lit("B").alias("bookmaker"), F.when(F.col("c") == 0, name("B", F.col("k") / 4)).otherwise(F.lit("HOT")).alias("event")),
    )).alias("e"), "c").where("e.bookmaker = 'A' OR c < 2")
    known = F.when(F.col("k") % 7 == 0, F.lit(-1).cast("bigint")).when(F.col("c") == 1, F.lit(1).cast("bigint")).otherwise(F.col("k") * 10)
    rows = both.select("e.bookmaker", "e.event", days_after("2021-03-01", F.col("k") * 0).alias("date"), known.alias("betRadarID"), F.col("k").alias("quote"))
    return spark.read.parquet(write_version(rows, scratch_path(spark, "crossed"), 0))


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity_groups(_crossed(spark, sf_dir))


def unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify_ids(_crossed(spark, sf_dir))


def same_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(match.same_selection_pairs(quotes(spark, sf_dir)), "betOdd", "betOdd2")


def same_selection_first_1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quotes(spark, sf_dir)
    first = shape.head(q, 1000, "betRadarID", "bet", "bookmaker")
    return doubles(match.same_selection_pairs(q, first), "betOdd", "betOdd2")


ELSEWHERE = ["1X2 <> 1", "1X2 <> X"]


def exists_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(match.exists_elsewhere(quotes(spark, sf_dir), ELSEWHERE), "betOdd")


def join_on_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_quotes = loose_quotes(spark, sf_dir)
    joined = match.join_on_event(all_quotes, filters.eq_filter(all_quotes, bookmaker="B0"))
    return shape.order_by(joined, "event", "bookmaker")


def distinct_bookmakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.distinct_values(quotes(spark, sf_dir), "bookmaker")


def distinct_bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = filters.eq_filter(quotes(spark, sf_dir), bookmaker="B3")
    return shape.order_by(shape.distinct_values(one, "bet"), "bet")


def events_with_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = loose_quotes(spark, sf_dir).withColumn("betRadarID", F.nullif(F.col("betRadarID"), F.lit(-1)))
    listed = shape.distinct_values(filters.not_null(known), "bookmaker", "event")
    return shape.order_by(listed, "event", "bookmaker")


QUERIES = {
    "two_way_hedge": two_way_hedge,
    "two_way_harmonic": two_way_harmonic,
    "three_way_hedge": three_way_hedge,
    "three_way_harmonic": three_way_harmonic,
    "fuzzy_match": fuzzy_match,
    "fuzzy_three_way": fuzzy_three_way,
    "top_rtp": top_rtp,
    "rtp_over_95": rtp_over_95,
    "lookup_counter": lookup_counter,
    "loose_two_way": loose_two_way,
    "backfill_ids": backfilled,
    "backfilled_matches": backfilled_matches,
    "identity_groups": identities,
    "unify_ids": unified,
    "same_selection": same_selection,
    "same_selection_first_1000": same_selection_first_1000,
    "exists_elsewhere": exists_elsewhere,
    "join_on_event": join_on_event,
    "distinct_bookmakers": distinct_bookmakers,
    "distinct_bets": distinct_bets,
    "events_with_id": events_with_id,
}

_HEDGE2 = 'a."betOdd"::DOUBLE * (1::DOUBLE - 1::DOUBLE / b."betOdd"::DOUBLE) * 100::DOUBLE'
_HARMONIC2 = (
    '(a."betOdd"::DOUBLE * b."betOdd"::DOUBLE)'
    ' / (a."betOdd"::DOUBLE + b."betOdd"::DOUBLE) * 100::DOUBLE'
)
_HEDGE3 = (
    'a."betOdd"::DOUBLE * (1::DOUBLE - 1::DOUBLE / b."betOdd"::DOUBLE'
    ' - 1::DOUBLE / c."betOdd"::DOUBLE) * 100::DOUBLE'
)
_HARMONIC3 = (
    '(a."betOdd"::DOUBLE * b."betOdd"::DOUBLE * c."betOdd"::DOUBLE)'
    ' / (a."betOdd"::DOUBLE * b."betOdd"::DOUBLE + b."betOdd"::DOUBLE * c."betOdd"::DOUBLE'
    ' + a."betOdd"::DOUBLE * c."betOdd"::DOUBLE) * 100::DOUBLE'
)


def _legs(n: int, raw: str, source: str, strip: bool = True) -> str:
    """The scored legs of a join with aliases a, b (and c)."""
    legs = ", ".join(
        f'{t}.bookmaker AS bookmaker{i}, {sql_strip(t + ".bet") if strip else t + ".bet"} AS bet{i}, '
        f'{t}."betOdd"::DOUBLE AS "betOdd{i}"'
        for i, t in enumerate("abc"[:n], 1)
    )
    return (
        f'SELECT {sql_round2("raw")} AS "RTP", * EXCLUDE (raw) FROM ('
        f'SELECT {raw} AS raw, a.tournament, a."betRadarID", a.event, a.date, {legs} {source})'
    )


_JOIN2 = """FROM q a JOIN c2 ON c2.bet = a.bet
  JOIN q b ON b."betRadarID" = a."betRadarID" AND b.bet = c2.counter AND b.bookmaker <> a.bookmaker"""
_JOIN3 = """FROM q a JOIN c3 ON c3.bet = a.bet
  JOIN q b ON b."betRadarID" = a."betRadarID" AND b.bet = c3.counter1 AND b.bookmaker <> a.bookmaker
  JOIN q c ON c."betRadarID" = a."betRadarID" AND c.bet = c3.counter2
    AND c.bookmaker <> a.bookmaker AND c.bookmaker <> b.bookmaker"""
_WITH2 = f"WITH {QUOTES_SQL}, {COUNTERS2_SQL} "
_WITH3 = f"WITH {QUOTES_SQL}, {COUNTERS3_SQL} "
_BACKFILL = """,
found AS (SELECT event, date, min("betRadarID") AS id FROM e WHERE "betRadarID" <> -1 GROUP BY event, date),
r AS (SELECT bookmaker, tournament,
  CASE WHEN "betRadarID" = -1 THEN coalesce(id, -1) ELSE "betRadarID" END AS "betRadarID",
  event, date, bet, "betOdd" FROM e LEFT JOIN found USING (event, date))"""
_SAME = """SELECT a."betRadarID", a.bet, a.bookmaker, a.tournament, a.event, a.date,
  a."betOdd"::DOUBLE AS "betOdd", b.bookmaker AS bookmaker2, b."betOdd"::DOUBLE AS "betOdd2" """

# The link in full, id OR (name AND date), as the two joins it is made of.
_ID, _NAME = '(b."betRadarID" <> -1 AND b."betRadarID" = a."betRadarID")', "(b.event = a.event AND b.date = a.date)"
_PAIR = "FROM e a JOIN c2 ON c2.bet = a.bet JOIN e b ON b.bet = c2.counter AND b.bookmaker <> a.bookmaker"
_LINKED = f"SELECT a, b {_PAIR} AND {_ID} UNION ALL SELECT a, b {_PAIR} AND {_NAME} AND NOT {_ID}"
_PAIR3 = _PAIR.replace("c2.counter", "c3.counter1").replace("c2", "c3")
_ID_A, _ID_B = '(c."betRadarID" <> -1 AND c."betRadarID" = p.a."betRadarID")', '(c."betRadarID" <> -1 AND c."betRadarID" = p.b."betRadarID")'
_NAME_A = "(c.event = p.a.event AND c.date = p.a.date)"
_THIRD = "SELECT p.a AS a, p.b AS b, c FROM p JOIN e c ON c.bet = p.k AND c.bookmaker <> p.a.bookmaker AND c.bookmaker <> p.b.bookmaker"
_LINKED3 = f"""p AS (SELECT a, b, c3.counter2 AS k {_PAIR3} AND {_ID} UNION ALL SELECT a, b, c3.counter2 {_PAIR3} AND {_NAME} AND NOT {_ID}),
t AS ({_THIRD} AND {_ID_A} UNION ALL {_THIRD} AND {_ID_B} AND NOT {_ID_A} UNION ALL {_THIRD} AND {_NAME_A} AND NOT {_ID_A} AND NOT {_ID_B}) """

_CROSSED = """WITH RECURSIVE o AS (SELECT o_orderkey AS k, o_custkey % 4 AS c FROM orders),
x AS (SELECT bookmaker, event, TIMESTAMP '2021-03-01' AS date, k AS quote,
    CASE WHEN k % 7 = 0 THEN -1 WHEN c = 1 THEN 1 ELSE k * 10 END AS "betRadarID" FROM (
  SELECT k, c, 'A' AS bookmaker, 'A ' || (k // 3) AS event FROM o
  UNION ALL SELECT k, c, 'B', CASE WHEN c = 0 THEN 'B ' || (k // 4) ELSE 'HOT' END FROM o WHERE c < 2)),
l AS (SELECT DISTINCT "betRadarID" AS id, event FROM x WHERE "betRadarID" <> -1),
low AS (SELECT event, min(id) AS lo FROM l GROUP BY event),
e AS (SELECT DISTINCT id AS a, lo AS b FROM l JOIN low USING (event) WHERE id <> lo),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
walk(id, root) AS (SELECT DISTINCT id, id FROM l UNION SELECT n.b, w.root FROM walk w JOIN both_ways n ON n.a = w.id WHERE w.root < n.b),
g AS (SELECT id, min(root) AS identity FROM walk GROUP BY id)
"""

SQL = {
    "identity_groups": _CROSSED + 'SELECT id AS "betRadarID", identity FROM g',
    "unify_ids": _CROSSED + """SELECT bookmaker, event, date, quote, coalesce(g.identity, f."betRadarID") AS "betRadarID" FROM (
    SELECT * REPLACE (CASE WHEN "betRadarID" = -1 THEN coalesce(lo, -1) ELSE "betRadarID" END AS "betRadarID")
    FROM x LEFT JOIN low USING (event)) f LEFT JOIN g ON g.id = f."betRadarID"
""",
    "two_way_hedge": _WITH2 + _legs(2, _HEDGE2, _JOIN2),
    "two_way_harmonic": _WITH2 + _legs(2, _HARMONIC2, _JOIN2, strip=False),
    "three_way_hedge": _WITH3 + _legs(3, _HEDGE3, _JOIN3),
    "three_way_harmonic": _WITH3 + _legs(3, _HARMONIC3, _JOIN3, strip=False),
    "fuzzy_match": f"WITH {LOOSE_SQL}, {COUNTERS2_SQL} " + _legs(2, _HARMONIC2, f"FROM ({_LINKED}) p", strip=False),
    "fuzzy_three_way": f"WITH {LOOSE_SQL}, {COUNTERS3_SQL}, " + _LINKED3 + _legs(3, _HARMONIC3, "FROM t", strip=False),
    "top_rtp": _WITH2 + 'SELECT * FROM (' + _legs(2, _HEDGE2, _JOIN2) + """) WHERE "RTP" > 95
  ORDER BY "RTP" DESC, tournament, "betRadarID", event, date, bookmaker1, bet1, "betOdd1",
    bookmaker2, bet2, "betOdd2" LIMIT 50""",
    "rtp_over_95": _WITH2 + 'SELECT * FROM (' + _legs(2, _HEDGE2, _JOIN2) + ') WHERE "RTP" > 95',
    "lookup_counter": _WITH2 + """SELECT bookmaker, tournament, "betRadarID", event, date, q.bet,
  "betOdd"::DOUBLE AS "betOdd", counter FROM q JOIN c2 ON c2.bet = q.bet""",
    "loose_two_way": f"WITH {LOOSE_SQL}, {COUNTERS2_SQL} " + _legs(
        2, _HEDGE2, f"FROM (SELECT a, b {_PAIR} AND {_ID}) p"),
    "backfill_ids": f"WITH {LOOSE_SQL}{_BACKFILL} " + """SELECT bookmaker, tournament, "betRadarID",
  event, date, bet, "betOdd"::DOUBLE AS "betOdd" FROM r WHERE "betRadarID" <> -1""",
    "backfilled_matches": f"WITH {LOOSE_SQL}{_BACKFILL}, {COUNTERS2_SQL} " + _legs(
        2, _HEDGE2,
        """FROM r a JOIN c2 ON c2.bet = a.bet
  JOIN r b ON b."betRadarID" = a."betRadarID" AND b.bet = c2.counter AND b.bookmaker <> a.bookmaker
  WHERE a."betRadarID" <> -1"""),
    "same_selection": f"WITH {QUOTES_SQL} {_SAME}" + """FROM q a JOIN q b
  ON a."betRadarID" = b."betRadarID" AND a.bet = b.bet AND a.bookmaker <> b.bookmaker""",
    "same_selection_first_1000": f"WITH {QUOTES_SQL}, " + """
h AS (SELECT * FROM q ORDER BY "betRadarID", bet, bookmaker LIMIT 1000) """ + _SAME + """FROM h a JOIN q b
  ON a."betRadarID" = b."betRadarID" AND a.bet = b.bet AND a.bookmaker <> b.bookmaker""",
    "exists_elsewhere": f"WITH {QUOTES_SQL} " + """SELECT bookmaker, tournament, "betRadarID", event, date,
  bet, "betOdd"::DOUBLE AS "betOdd" FROM q o
  WHERE bet IN ('1X2 <> 1', '1X2 <> X') AND EXISTS (SELECT 1 FROM q i
    WHERE i."betRadarID" = o."betRadarID" AND i.bet = o.bet AND i.bookmaker <> o.bookmaker)""",
    "join_on_event": f"WITH {LOOSE_SQL} " + """SELECT DISTINCT t.bookmaker, t.event FROM e t
  JOIN (SELECT * FROM e WHERE bookmaker = 'B0') s ON t.event = s.event
  WHERE t."betRadarID" IS NOT NULL ORDER BY t.event, t.bookmaker""",
    "distinct_bookmakers": "SELECT DISTINCT 'B' || (l_suppkey % 7) AS bookmaker FROM lineitem",
    "distinct_bets": f"WITH {QUOTES_SQL} SELECT DISTINCT bet FROM q WHERE bookmaker = 'B3' ORDER BY bet",
    "events_with_id": f"WITH {LOOSE_SQL} " + """SELECT DISTINCT bookmaker, event FROM e
  WHERE nullif("betRadarID", -1) IS NOT NULL ORDER BY event, bookmaker""",
}

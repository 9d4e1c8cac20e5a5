"""Matches against row-by-row brute force."""
import random
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pricematch.fixed_values import THREE_WAY_COUNTERS, TWO_WAY_COUNTERS
from pricematch.operators import filters, match, shape
from pricematch.operators.identity import backfill_ids
from pricematch.sources.dictionaries import three_way_counters, two_way_counters

COLUMNS = ["bookmaker", "tournament", "betRadarID", "event", "date", "bet", "betOdd"]
SCHEMA = "bookmaker string, tournament string, betRadarID bigint, event string, date timestamp_ntz, bet string, betOdd decimal(10,2)"
BETS = ["1X2 <> 1", "1X2 <> X", "1X2 <> 2", "DOPPIA CHANCE IN <> 1X", "DOPPIA CHANCE IN/OUT <> 12",
        "DOPPIA CHANCE OUT <> X2", "U/O 2.5 <> OVER 2.5", "U/O 2.5 <> OVER", "U/O 2.5 <> UNDER", "OTHER"]


def make_quotes(seed=1, n=400, ids=12, hot=0.33):
    """Quotes unique on their key; a third are on one event."""
    rng, rows = random.Random(seed), {}
    for _ in range(n):
        i = 0 if rng.random() < hot else rng.randrange(ids)
        bookmaker, bet = f"B{rng.randrange(7)}", rng.choice(BETS)
        ident = -1 if bookmaker == "B0" else (None if i == 5 else i)
        event = None if i == 6 else f"EV{i}" + ("x" if bookmaker == "B1" else "")
        row = (bookmaker, f"T{i % 3}", ident, event, datetime(2021, 3, 1 + i), bet, Decimal(rng.randrange(101, 400)) / 100)
        rows.setdefault((bookmaker, ident, event, bet), row)
    return list(rows.values())


@pytest.fixture(scope="module")
def data():
    return make_quotes()


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(4).persist()


def hedge(*p):
    a, *rest = map(float, p)
    covered = 1.0
    for o in rest:
        covered = covered - 1.0 / o
    return round((a * covered) * 100, 2)


def harmonic(*p):
    a, b, *c = map(float, p)
    if not c:
        return round((a * b) / (a + b) * 100, 2)
    c = c[0]
    return round((a * b * c) / (a * b + b * c + a * c) * 100, 2)


def brute(rows, counters, meets, rtp, staged=True):
    """One loop per leg, as a row-by-row program would do it."""
    table = {c[0]: c[1:] for c in counters}
    pool = [r for r in rows if r[5] in table] if staged else rows
    out = []
    for a in [r for r in rows if r[5] in table]:
        found = [(a,)]
        for k, counter in enumerate(table[a[5]]):
            found = [legs + (b,) for legs in found for b in pool
                     if b[5] == counter and b[0] not in {l[0] for l in legs} and meets(legs, b)]
        for legs in found:
            out.append((str(a[2]), str(a[3])) + tuple(v for l in legs for v in (l[0], l[5])) + (rtp(*[l[6] for l in legs]),))
    return sorted(out)


def same_id(legs, b):
    return legs[0][2] is not None and legs[0][2] == b[2]


def same_event(a, b):
    return a[3] is not None and a[3] == b[3] and a[4] == b[4]


def linked(legs, b):
    return (b[2] is not None and b[2] != -1 and any(l[2] == b[2] for l in legs)) or same_event(legs[0], b)


def legs_of(df, n):
    cols = [v for i in range(1, n + 1) for v in (f"bookmaker{i}", f"bet{i}")]
    return sorted((str(r["betRadarID"]), str(r["event"])) + tuple(r[c] for c in cols) + (float(r["RTP"]),) for r in df.collect())


def test_two_way(data, frame, spark):
    got = legs_of(match.match_two_way(frame, two_way_counters(spark), strip=False), 2)
    assert got == brute(data, TWO_WAY_COUNTERS, same_id, hedge)
    assert any("U/O 2.5 <> OVER" in r for r in got) and not any("U/O 2.5 <> OVER 2.5" in r for r in got)


def test_two_way_both_directions(frame, spark):
    got = legs_of(match.match_two_way(frame, two_way_counters(spark)), 2)
    flipped = {(r[0], r[4], r[5], r[2], r[3]) for r in got}
    assert {(r[0], *r[2:6]) for r in got} == flipped


def test_three_way(data, frame, spark):
    got = legs_of(match.match_three_way(frame, three_way_counters(spark), strip=False), 3)
    assert got == brute(data, THREE_WAY_COUNTERS, same_id, hedge)
    assert got and all(len({r[2], r[4], r[6]}) == 3 for r in got)


def test_two_way_fuzzy(data, frame, spark):
    got = legs_of(match.match_two_way_fuzzy(frame, two_way_counters(spark)), 2)
    assert got == brute(data, TWO_WAY_COUNTERS, linked, harmonic, staged=False)


def test_three_way_fuzzy(data, frame, spark):
    got = legs_of(match.match_three_way_fuzzy(frame, three_way_counters(spark)), 3)

    def meets(legs, b):
        # The third leg may share the id of the first or of the second.
        return linked(legs, b)

    assert got == brute(data, THREE_WAY_COUNTERS, meets, harmonic, staged=False)


@pytest.mark.parametrize("seed", range(3))
def test_fuzzy_equals_or_join(spark, seed):
    rows = make_quotes(seed + 10, n=250, ids=5)
    frame = spark.createDataFrame(rows, SCHEMA)
    a, b = frame.alias("a"), frame.alias("b")
    c = two_way_counters(spark).alias("c")
    wanted = (
        a.join(c, F.col("a.bet") == F.col("c.bet"))
        .join(b, (F.col("b.bet") == F.col("counter")) & (F.col("a.bookmaker") != F.col("b.bookmaker")) & (
            ((F.col("b.betRadarID") != -1) & (F.col("a.betRadarID") == F.col("b.betRadarID")))
            | ((F.col("a.event") == F.col("b.event")) & (F.col("a.date") == F.col("b.date")))))
        .count()
    )
    assert match.match_two_way_fuzzy(frame, two_way_counters(spark)).count() == wanted


def test_output_columns(frame, spark):
    out = match.stamp_run(match.match_two_way(frame, two_way_counters(spark)), datetime(2021, 1, 1))
    assert out.columns == ["RTP", "tournament", "betRadarID", "event", "date", "bookmaker1", "bet1", "betOdd1",
                           "bookmaker2", "bet2", "betOdd2", "insertingdate"]
    assert dict(out.dtypes)["RTP"] == "decimal(10,2)"


def test_hot_raw_event_is_bounded(spark):
    """Copies of one event's quotes leave one row a bookmaker and selection."""
    copies = spark.range(60_000).select(
        F.concat(F.lit("B"), F.col("id") % 3).alias("bookmaker"), F.lit("T").alias("tournament"),
        F.lit(7).cast("bigint").alias("betRadarID"), F.lit("E").alias("event"),
        F.lit("2021-03-01 00:00:00").cast("timestamp_ntz").alias("date"),
        F.when(F.col("id") % 2 == 0, "1X2 <> 1").otherwise("DOPPIA CHANCE OUT <> X2").alias("bet"),
        F.lit(2).cast("decimal(10,2)").alias("betOdd"), F.col("id").alias("ingest_seq"))
    keys = ["bookmaker", "betRadarID", "event", "bet"]
    kept = shape.dedupe(copies, keys, ["ingest_seq"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")
    assert match.match_two_way(kept, two_way_counters(spark)).count() == 12


def test_backfill(spark):
    d = datetime(2021, 3, 1)
    rows = [("a", "T", -1, "E", d, "x", None), ("b", "T", 9, "E", d, "x", None), ("c", "T", 4, "E", d, "x", None),
            ("d", "T", -1, "F", d, "x", None), ("e", "T", None, "E", d, "x", None), ("f", "T", -1, "E", datetime(2021, 3, 2), "x", None)]
    out = backfill_ids(spark.createDataFrame(rows, SCHEMA))
    assert {r.bookmaker: r.betRadarID for r in out.collect()} == {"a": 4, "b": 9, "c": 4, "d": -1, "e": None, "f": -1}
    assert {r.bookmaker for r in filters.drop_unresolved(out).collect()} == {"a", "b", "c", "e"}


def test_same_selection_and_exists(data, frame):
    wanted = sorted((a[0], b[0], a[2], a[5]) for a in data for b in data
                    if a[2] is not None and a[2] == b[2] and a[5] == b[5] and a[0] != b[0])
    got = match.same_selection_pairs(frame)
    assert sorted((r.bookmaker, r.bookmaker2, r.betRadarID, r.bet) for r in got.collect()) == wanted
    bets = ["1X2 <> 1", "OTHER"]
    rows = match.exists_elsewhere(frame, bets).collect()
    assert sorted((r.bookmaker, r.betRadarID, r.bet) for r in rows) == sorted(
        {(a, i, bet) for a, _, i, bet in wanted if bet in bets})


def test_join_on_event(data, frame):
    other = filters.eq_filter(frame, bookmaker="B0")
    names = {r[3] for r in data if r[0] == "B0" and r[3]}
    got = {tuple(r) for r in match.join_on_event(frame, other).collect()}
    assert got == {(r[0], r[3]) for r in data if r[2] is not None and r[3] in names}


def test_top_rtp_is_stable(frame, spark):
    pairs = match.match_two_way(frame, two_way_counters(spark))
    once = shape.top_rtp(pairs, 5, 95).collect()
    assert once == shape.top_rtp(pairs.repartition(7), 5, 95).collect()
    assert [r.RTP for r in once] == sorted((r.RTP for r in filters.rtp_above(pairs, 95).collect()), reverse=True)[:5]

"""What travels and what does not: runs whose rows lie together already, or share no key, are not shuffled again."""
import re
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pricematch.operators.filters import drop_unresolved
from pricematch.operators.identity import backfill_ids
from pricematch.operators.shape import dedupe, dedupe_stored
from pricematch.plans.runs import match_run, refresh_matches, resolve_quotes
from pricematch.schemas import MATCHES2, MATCHES3
from pricematch.sinks import merge
from pricematch.sources.dictionaries import three_way_counters, two_way_counters

RUN = datetime(2021, 3, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("legs", [2, 3])
def test_a_refresh_moves_quotes_and_old_rows_by_event_only(spark, legs):
    quotes = spark.createDataFrame(
        [(f"B{b}", "T", i, f"E{i}", RUN, bet, Decimal(2)) for i in range(3) for b in range(4) for bet in ("1X2 <> 1", "1X2 <> X", "1X2 <> 2", "DOPPIA CHANCE OUT <> X2")],
        "bookmaker string, tournament string, betRadarID bigint, event string, date timestamp_ntz, bet string, betOdd decimal(10,2)")
    found = match_run(quotes, two_way_counters(spark), three_way_counters(spark), RUN)[legs - 2]
    leg = ("B9", "X", Decimal(2))
    old = spark.createDataFrame([(Decimal(1), "T", i, "E", RUN, *leg * legs, RUN) for i in (1, 99)], MATCHES2 if legs == 2 else MATCHES3)
    out = refresh_matches(old, found, RUN, legs)
    moved = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(out))
    # quotes once for each leg, old rows, and those of them without a whole key
    assert len(moved) == legs + 2 and all(re.fullmatch(r"(betRadarID|__id)#\d+L, \d+", m) for m in moved)
    assert out.count() == 2 + 3 * (4 * 3 * 2 if legs == 2 else 4 * 3 * 2 * 3)


@pytest.mark.parametrize("copies", [0, 3, 400])
def test_stored_rows_are_deduplicated_alike(spark, tmp_path, copies):
    data = [(f"k{i}" if i % 50 else None, i % 3, i) for i in range(400)] + [(f"k{i}", i % 3, 1000 - i) for i in range(copies)]
    spark.createDataFrame(data, "k string, part int, seq int").repartition(4).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    for keep in ("first", "last"):
        got = dedupe_stored(df, ["k", "part"], ["seq"], str(tmp_path / keep), keep)
        assert rows(got) == rows(dedupe(df, ["k", "part"], ["seq"], keep))
        assert "Exchange hashpartitioning" not in plan(got) and "Window" not in plan(got)


def test_keys_are_counted_by_more_tasks_the_more_rows_there_are(spark, tmp_path):
    spark.range(400).select("id", (F.col("id") % 390).alias("k")).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    got = dedupe_stored(df, ["k"], ["id"], str(tmp_path / "few"), a_task=2)
    assert sorted(r.id for r in got.collect()) == list(range(390))
    twice = spark.read.parquet(str(tmp_path / "few" / "twice"))
    assert twice.count() == 10 and twice.select(F.input_file_name()).distinct().count() > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_rows_whose_key_is_theirs_alone_do_not_travel(spark):
    df = spark.createDataFrame([(i if i else None, "x", i) for i in range(90)] + [(None, "x", 90), (7, "x", 91)], "k int, b string, v int").repartition(3)
    good, bad = merge.assert_unique(df, ["k", "b"])
    assert {r.v for r in bad.collect()} == {0, 90, 7, 91} and good.count() == 88
    assert "hashpartitioning" not in plan(good) + plan(bad)


def test_upsert_as_an_aggregate(spark):
    old = spark.createDataFrame(
        [(1, "a", 1.0, "o1"), (1, "a", 2.0, "o2"), (2, None, 3.0, "o3"), (None, "a", 4.0, None), (None, "a", 4.0, None), (3, "b", None, None)],
        "k int, b string, RTP double, event string")
    new = spark.createDataFrame(
        [(1, "a", None, "n1", 5), (1, "a", 9.0, "n2", 4), (2, None, 8.0, "n3", 1), (2, None, 7.0, "n4", 2), (3, "b", 6.0, "n5", 1), (4, "b", 5.0, None, None), (4, "b", 4.0, "n6", 0)],
        "k int, b string, RTP double, event string, seq int")
    for update in (["RTP"], ["event", "RTP"], []):
        args = (old, new, ["k", "b"], update, ["seq"])
        assert rows(merge.upsert_grouped(*args)) == rows(merge.upsert_matches(*args))
    assert rows(merge.upsert_grouped(old, new.limit(0), ["k", "b"], ["RTP"], ["seq"])) == rows(old)


def test_collected_pages_are_written_unsorted_and_copies_found_without_a_window(spark, tmp_path):
    from catalogue.feeds import broken_feeds
    from pricematch.plans import runs

    quotes, bad, counts = runs.collect_once(spark, str(tmp_path / "c"), *broken_feeds(spark, "/root/testdata/sf0.001"))
    assert "Window" not in plan(quotes) and "hashpartitioning" not in plan(quotes)
    assert bad.count() == counts["rejects"] and quotes.count() == counts["rows"] - counts["rejects"]


def clashing(spark):
    """Quotes with and without ids, of which some share a staged key, one id's by many names, and some have no key."""
    data = [(f"B{b}", "T", i if b else -1, f"E{i}", RUN, bet, Decimal(2)) for i in range(6) for b in range(4) for bet in ("1X2 <> 1", "1X2 <> X", "1X2 <> 2", "DOPPIA CHANCE OUT <> X2")]
    data += [("B1", "T", 2, f"F{n}", RUN, "1X2 <> 1", Decimal(3)) for n in range(40)]
    data += [("B1", "T", 3, "F", RUN, "1X2 <> X", Decimal(3)), ("B1", "T", -1, "lone", RUN, "1X2 <> X", Decimal(3))]
    data += [(None, "T", 4, f"N{n}", RUN, "1X2 <> X", Decimal(4)) for n in range(2)]
    return spark.createDataFrame(data, "bookmaker string, tournament string, betRadarID bigint, event string, date timestamp_ntz, bet string, betOdd decimal(10,2)")


@pytest.mark.parametrize("most_rows", [0, 20, 10_000])
def test_resolved_quotes_are_those_of_joins(spark, tmp_path, most_rows):
    quotes = clashing(spark)
    staged, clashes = resolve_quotes(quotes, str(tmp_path / "staged"), most_rows)
    want, bad = merge.assert_unique(drop_unresolved(backfill_ids(quotes)), ["bookmaker", "betRadarID", "bet"])
    assert rows(staged) == rows(want) and rows(clashes) == rows(bad) and staged.schema == want.schema
    assert clashes.count() == 41 + 2 + 2 and staged.columns == clashes.columns == quotes.columns


def test_resolved_quotes_are_matched_where_they_lie(spark, tmp_path):
    staged, _ = resolve_quotes(clashing(spark), str(tmp_path / "staged"))
    counters = two_way_counters(spark), three_way_counters(spark)
    plain = spark.createDataFrame(staged.collect(), staged.schema)
    for found, want in zip(match_run(staged, *counters, RUN), match_run(plain, *counters, RUN)):
        assert "Exchange hashpartitioning" not in plan(found) and rows(found) == rows(want) and rows(want)


def test_renamed_pages_are_not_parsed_before_they_are_dealt(spark):
    from catalogue.feeds import _renamed
    from pricematch.sources import feeds

    pages = spark.range(9).select(F.col("id").alias("ingest_seq"), F.lit("T").alias("tournament"), F.concat(F.lit('{"x":'), "id").alias("payload")).repartition(4, "ingest_seq")
    shown = plan(_renamed(feeds.parse_map_feed(pages, RUN)))
    assert "from_json(" in shown and shown.rindex("from_json(") < shown.index("Exchange")


def test_a_refresh_gathers_no_rows_in_aggregates(spark):
    old = spark.createDataFrame([(k % 5, "a", 1.0, f"o{k}") for k in range(9)], "k int, b string, RTP double, event string")
    new = spark.createDataFrame([(k % 7, "a", float(k), f"n{k}", k) for k in range(30)], "k int, b string, RTP double, event string, seq int")
    args = (old, new, ["k", "b"], ["RTP"], ["seq"])
    got = merge.upsert_grouped(*args)
    assert "Aggregate" not in plan(got) and "SortMergeJoin [k#" in plan(got)
    assert rows(got) == rows(merge.upsert_matches(*args))
    bare = old.select("k", "b"), new.select("k", "b"), ["k", "b"], []
    assert rows(merge.upsert_grouped(*bare)) == rows(merge.upsert_matches(*bare))


def test_pages_are_made_apart_from_their_parsing(spark):
    from catalogue import payloads
    from pricematch.sources import feeds

    orders = spark.range(9).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit(RUN).cast("timestamp_ntz").alias("o_orderdate"))
    for feed, build in (("flat", payloads.flat), ("nested", payloads.nested), ("offer", payloads.offer), ("map", payloads.mapped)):
        shown = [line for line in plan(feeds._page(build(orders), feeds.PAGES[feed])).splitlines() if "from_json(" in line]
        assert len(shown) == 1 and "invoke(StructsToJson" not in shown[0]


def test_pages_of_a_cycle_are_parsed_once_a_feed(spark, monkeypatch):
    from catalogue import feeds as queries

    seen = []
    monkeypatch.setattr(queries, "run_cycle", lambda spark, base, parsed, *rest: seen.extend(parsed))
    queries._cycle(spark, "/root/testdata/sf0.001")
    assert sum(plan(df).count("from_json(") for df in seen) == 4
    fourth = queries._parsed(spark, "/root/testdata/sf0.001", "map")
    assert rows(seen[3]) == rows(fourth.unionByName(queries._renamed(fourth)))

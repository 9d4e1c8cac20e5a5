"""Streams over several micro-batches against the batch result."""
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pricematch.sources.dictionaries import three_way_counters, two_way_counters
from pricematch.streaming import cycle

SCHEMA = "bookmaker string, betRadarID bigint, event string, bet string, betOdd decimal(10,2), seen timestamp, ingest_seq bigint"


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """Three files, one after the other in time, with keys that come again."""
    path = str(tmp_path_factory.mktemp("landed") / "in")
    base = F.lit("2021-03-01 00:00:00").cast("timestamp")
    bets = F.when(F.col("id") % 2 == 0, "1X2 <> 1").otherwise("DOPPIA CHANCE OUT <> X2")
    rows = spark.range(300).select(
        F.concat(F.lit("B"), F.floor(F.col("id") / 2) % 3).alias("bookmaker"),
        (F.floor(F.col("id") / 6) % 5).alias("betRadarID"), F.lit("E").alias("event"), bets.alias("bet"),
        (F.lit(1.5) + F.col("id") % 7 / 10).cast("decimal(10,2)").alias("betOdd"),
        (base + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("seen"), F.col("id").alias("ingest_seq"))
    for i in range(3):
        rows.where((F.col("ingest_seq") >= 100 * i) & (F.col("ingest_seq") < 100 * i + 100)).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, landed):
    return cycle.quotes_stream(spark, landed, SCHEMA, max_files=1)


def test_dedupe_over_batches(spark, landed):
    keys = ["bookmaker", "betRadarID", "event", "bet"]
    for spread in (None, "ingest_seq"):
        out = cycle.run_to_files(cycle.stream_dedupe(stream(spark, landed), "seen", "10 days", spread_by=spread), "t")
        assert out.count() == out.select(keys).distinct().count() == 30


def test_merge_first_wins_over_batches(spark, landed, tmp_path):
    path, check = str(tmp_path / "out"), str(tmp_path / "check")
    cycle.stream_merge(stream(spark, landed), path, SCHEMA, check).awaitTermination()
    got = {r.ingest_seq for r in cycle.merged_quotes(spark, path, SCHEMA).collect()}
    assert got == set(range(30))
    cycle.stream_merge(stream(spark, landed), path, SCHEMA, str(tmp_path / "again")).awaitTermination()
    assert cycle.merged_quotes(spark, path, SCHEMA).count() == 30


def test_match_equals_batch(spark, landed):
    """Quotes a few minutes apart meet wherever they lie, in one batch or over two, and none waits at the end."""
    out = cycle.run_to_files(
        cycle.stream_match(stream(spark, landed + "/"), two_way_counters(spark), "seen", "10 minutes", "7 minutes"), "t")
    got = sorted((r.betRadarID, r.bookmaker1, r.bet1, r.seen1, r.bookmaker2, r.bet2, r.seen2, float(r.RTP)) for r in out.collect())
    rows = spark.read.parquet(landed).collect()
    other = {"1X2 <> 1": "DOPPIA CHANCE OUT <> X2", "DOPPIA CHANCE OUT <> X2": "1X2 <> 1"}
    want = sorted(
        (a.betRadarID, a.bookmaker, a.bet, a.seen, b.bookmaker, b.bet, b.seen, round((float(a.betOdd) * (1.0 - 1.0 / float(b.betOdd))) * 100, 2))
        for a in rows for b in rows
        if a.betRadarID == b.betRadarID and a.bookmaker != b.bookmaker and b.bet == other[a.bet] and abs(a.seen - b.seen) <= timedelta(minutes=7))
    assert got == want and got
    second = datetime(2021, 3, 1) + timedelta(minutes=100)  # where the second file, and so batch, begins
    assert any((x[3] < second) != (x[6] < second) for x in got)


def test_late_uses_the_clock(spark, landed):
    out = cycle.run_to_files(cycle.stream_late(stream(spark, landed).withColumn("date", F.col("seen").cast("timestamp_ntz"))), "t")
    assert out.count() == 0
    out = cycle.run_to_files(
        cycle.stream_late(stream(spark, landed).withColumn("date", F.col("seen").cast("timestamp_ntz")), datetime(2021, 3, 1, 4)), "t")
    assert out.count() == 60


def test_upsert_over_batches(spark, landed, tmp_path):
    base, check = str(tmp_path / "state"), str(tmp_path / "check")
    schema = "betRadarID bigint, RTP double, event string, insertingdate timestamp_ntz"
    run = datetime(2021, 3, 2)
    matches = stream(spark, landed).where("ingest_seq % 100 = betRadarID").select(
        "betRadarID", F.col("ingest_seq").cast("double").alias("RTP"), F.col("ingest_seq").cast("string").alias("event"),
        F.lit(run.isoformat(sep=" ")).cast("timestamp_ntz").alias("insertingdate"))
    keys = ["betRadarID"]
    query = cycle.stream_upsert(matches, base, schema, check, keys, ["RTP", "insertingdate"], buckets=4)
    query.awaitTermination()
    versions = query.lastProgress["batchId"] + 1
    assert versions == 3
    state = {r.betRadarID: (r.RTP, r.event) for r in cycle.finish_cycle(spark, base, schema, keys, versions, run, 4).collect()}
    # The event keeps its first value, the return is the latest.
    first = {}
    last = {}
    for r in sorted(spark.read.parquet(landed).collect(), key=lambda r: r.ingest_seq):
        if r.ingest_seq % 100 == r.betRadarID:
            first.setdefault(r.betRadarID, str(r.ingest_seq))
            last[r.betRadarID] = float(r.ingest_seq)
    assert state == {k: (last[k], first[k]) for k in first}


def test_a_run_of_many_flushes_keeps_them_all(spark, landed, tmp_path):
    """Each batch brings ten new keys and has a clock of its own; the purge comes once, at the end."""
    base, schema, keys = str(tmp_path / "state"), "k bigint, RTP double, insertingdate timestamp_ntz", ["k"]
    start = spark.createDataFrame([(-1, 1.0, datetime(2021, 2, 1)), (3, 1.0, datetime(2021, 2, 1))], schema)
    matches = stream(spark, landed).where("ingest_seq % 10 = 0").select(
        F.col("ingest_seq").alias("k"), F.lit(2.0).alias("RTP"), (F.floor(F.col("ingest_seq") / 100) * 10).alias("step"))
    late = F.lit("2021-03-02 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("step").cast("int"))
    matches = matches.withColumn("insertingdate", late).drop("step")
    query = cycle.stream_upsert(matches, base, schema, str(tmp_path / "check"), keys, ["RTP", "insertingdate"], start, buckets=8)
    query.awaitTermination()
    held = cycle.finish_cycle(spark, base, schema, keys, query.lastProgress["batchId"] + 1, datetime(2021, 3, 2), 8)
    assert sorted(r.k for r in held.collect()) == list(range(0, 300, 10))
    kept = [p.name for p in (tmp_path / "state").iterdir() if p.name.startswith("places")]
    assert len(kept) == 2


def test_three_legs_over_batches(spark, tmp_path):
    """Legs that come in three batches meet; those too far apart, or of one bookmaker, do not; state is dropped."""
    from pricematch.sources.dictionaries import three_way_counters

    path, start = str(tmp_path / "in"), datetime(2021, 3, 1)
    bets = ["1X2 <> 1", "1X2 <> X", "1X2 <> 2"]
    rows = []
    for i in range(240):  # an event each ten minutes, whose legs come 0 to 4 minutes apart, or 40
        minute = (i // 3) * 10 + (i % 3) * (i // 3 % 5 * 2 if i // 3 % 7 else 40)
        rows.append((f"B{(i // 3 % 4 and i) % 3}", i // 3 % 20, "E", bets[i % 3], 2.0 + i % 5, start + timedelta(minutes=minute), i))
    rows.append(("B0", -1, "E", bets[0], 2.0, start, 1000))
    rows.append(("B1", None, "E", bets[1], 2.0, start, 1001))
    rows.sort(key=lambda r: r[5])
    for k in range(3):
        part = spark.createDataFrame(rows[81 * k: 81 * k + 81], SCHEMA.replace("betOdd decimal(10,2)", "betOdd double"))
        part.withColumn("betOdd", F.col("betOdd").cast("decimal(10,2)")).coalesce(1).write.mode("append").parquet(path)
    found = cycle.stream_match_three(stream(spark, path), three_way_counters(spark), "seen", "5 minutes", "8 minutes")
    out = cycle.run_to_files(found, "three")
    counters = {r.bet: (r.counter1, r.counter2) for r in three_way_counters(spark).collect()}
    legs = spark.read.parquet(path).where("betRadarID >= 0").collect()
    near = lambda *xs: max(x.seen for x in xs) - min(x.seen for x in xs) <= timedelta(minutes=8)
    want = sorted(
        (a.ingest_seq, b.ingest_seq, c.ingest_seq) for a in legs for b in legs
        if b.betRadarID == a.betRadarID and b.bookmaker != a.bookmaker and b.bet == counters[a.bet][0] and near(a, b)
        for c in legs if c.betRadarID == a.betRadarID and c.bet == counters[a.bet][1] and c.bookmaker not in (a.bookmaker, b.bookmaker) and near(a, b, c))
    place = {(r.bookmaker, r.betRadarID, r.bet, r.seen): r.ingest_seq for r in legs}
    got = sorted(tuple(place[r[f"bookmaker{n}"], r.betRadarID, r[f"bet{n}"], r[f"seen{n}"]] for n in (1, 2, 3)) for r in out.collect())
    assert got == want and len(got) > 30


def test_three_legs_drop_state(spark, tmp_path):
    """Once the watermark is past, neither join holds quotes or pairs."""
    from pricematch.sources.dictionaries import three_way_counters

    path = str(tmp_path / "in")
    quotes = spark.range(60).select(
        F.concat(F.lit("B"), F.col("id") % 3).alias("bookmaker"), F.lit(1).cast("bigint").alias("betRadarID"), F.lit("E").alias("event"),
        F.element_at(F.array(*[F.lit(f"1X2 <> {x}") for x in "1X2"]), (F.col("id") % 3 + 1).cast("int")).alias("bet"),
        F.lit(2).cast("decimal(10,2)").alias("betOdd"),
        (F.lit("2021-03-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=F.col("id").cast("int") * 30)).alias("seen"), F.col("id").alias("ingest_seq"))
    for k in range(6):
        quotes.where(F.floor(F.col("id") / 10) == k).coalesce(1).write.mode("append").parquet(path)
    found = cycle.stream_match_three(stream(spark, path), three_way_counters(spark), "seen", "1 minute", "70 minutes")
    query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    held = [[s["numRowsTotal"] for s in p["stateOperators"]] for p in query.recentProgress if p["numInputRows"]]
    # Six batches alike in time: what is held after the second one does not grow with the batches that follow.
    assert len(held) == 6 and all(len(h) == 2 for h in held)
    assert [max(h[i] for h in held[2:]) <= held[1][i] for i in (0, 1)] == [True, True], held


def test_legs_that_complete_no_market_are_not_kept_and_state_can_be_on_disk(spark, tmp_path):
    rows = [(f"B{b}", 1, datetime(2024, 1, 1, 0, b), bet, Decimal(3)) for b in range(3) for bet in ("1X2 <> 1", "1X2 <> X", "1X2 <> 2", "no market")]
    path = str(tmp_path / "landed")
    spark.createDataFrame(rows, "bookmaker string, betRadarID bigint, seen timestamp, bet string, betOdd decimal(10,2)").write.parquet(path)
    counters = three_way_counters(spark)
    found = {}
    for on_disk in (False, True):
        quotes = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
        matched = cycle.stream_match_three(quotes, counters, "seen", "1 hour", "1 hour")
        found[on_disk] = sorted(map(tuple, cycle.run_to_files(matched, "state", on_disk).collect()))
        assert not spark.streams.active
    assert found[True] == found[False] and len(found[True]) == 3 * 2 * 3
    assert all(spark.conf.get(k, None) != v for k, v in cycle.STATE_ON_DISK.items())
    shown = cycle.stream_match_three(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path), counters, "seen", "1 hour", "1 hour")._jdf.queryExecution().analyzed().toString()
    assert shown.count("Join LeftSemi") == 2

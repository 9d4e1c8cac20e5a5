"""Streaming queries: each runs over what is there now and ends."""

from __future__ import annotations

from datetime import datetime

from catalogue.views import COUNTERS2_SQL, COUNTERS3_SQL, SELECTIONS, choose, clock_instant, clock_time, doubles, sql_round2, table
from pricematch.fixed_values import QUOTE_KEYS
from pricematch.session import scratch_path
from pricematch.sinks.growing import GrowingState
from pricematch.sources.dictionaries import three_way_counters, two_way_counters
from pricematch.streaming import cycle
from pyspark.sql import DataFrame, SparkSession, functions as F

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
ORDERS = (
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string"
)
# Longer than the data's whole span, so that no row of a replay is late.
SPAN = "3650 days"


def as_quotes(events: DataFrame) -> DataFrame:
    """Events as quotes on users. Watermarks need a time with a zone."""
    bet = choose(
        F.col("event_id") % 6, [(i, F.lit(s)) for i, s in enumerate(SELECTIONS[:5])], F.lit(SELECTIONS[5])
    )
    return events.select(
        F.concat(F.lit("B"), F.floor(F.col("event_id") / 6) % 3).alias("bookmaker"),
        F.col("user_id").alias("betRadarID"),
        F.concat(F.lit("EVENT "), F.col("user_id")).alias("event"),
        clock_instant(F.col("ts")).alias("seen"),
        F.col("ts").alias("date"),
        bet.alias("bet"),
        (F.lit(1.01) + (F.col("event_id") % 200) / 100).cast("decimal(10,2)").alias("betOdd"),
        F.col("event_id").alias("ingest_seq"),
    )


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_quotes(cycle.quotes_stream(spark, f"{sf_dir}/events.parquet", EVENTS))


def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    firsts = cycle.stream_dedupe(_stream(spark, sf_dir), "seen", SPAN, spread_by="ingest_seq")
    return cycle.run_to_files(firsts.select(QUOTE_KEYS), "stream-dedupe")


def stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_path(spark, "stream-merge")
    quotes = _stream(spark, sf_dir).drop("seen")
    schema = "bookmaker string, betRadarID bigint, event string, date timestamp_ntz, bet string, betOdd decimal(10,2), ingest_seq bigint"
    cycle.stream_merge(quotes, f"{base}/out", schema, f"{base}/checkpoint").awaitTermination()
    return doubles(cycle.merged_quotes(spark, f"{base}/out", schema), "betOdd")


LANDED = "bookmaker string, betRadarID bigint, event string, bet string, betOdd decimal(10,2), ingest_seq bigint"
BATCHES, LEAF_ROWS = 10, 2_000
LANDED_COLUMNS = [c.split()[0] for c in LANDED.split(", ")]


def _returning(lines: DataFrame) -> DataFrame:
    """Lines as quotes of ten batches by their part; one in 997 comes again in the next batch, at another price."""
    line = lines.select(
        F.concat(F.lit("B"), F.col("l_suppkey") % 7).alias("bookmaker"), F.col("l_partkey").alias("betRadarID"),
        F.concat(F.lit("EVENT "), F.col("l_partkey")).alias("event"), F.concat(F.lit("LINE "), F.col("l_linenumber")).alias("bet"),
        (F.lit(1.0) + F.col("l_quantity") / 25).cast("decimal(10,2)").alias("betOdd"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ingest_seq"), (F.col("l_partkey") % BATCHES).cast("int").alias("batch"),
    ).groupBy("bookmaker", "betRadarID", "event", "bet", "ingest_seq", "batch").agg(F.min("betOdd").alias("betOdd"))
    again = line.where(F.col("ingest_seq") % 997 == 5).withColumns({"batch": F.col("batch") + 1, "betOdd": (F.col("betOdd") + 1).cast("decimal(10,2)"), "ingest_seq": F.col("ingest_seq") + 1_000_000_000_000})
    return line.unionByName(again)


def stream_merge_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of eleven batches brought and inserted, and whether it read a part of the table only."""
    base = scratch_path(spark, "stream-merge-batches")
    _returning(table(spark, sf_dir, "lineitem")).write.partitionBy("batch").parquet(f"{base}/rows")
    rows = spark.read.schema(f"{LANDED}, batch int").parquet(f"{base}/rows")
    told = []
    for k in range(BATCHES + 1):
        rows.where(F.col("batch") == k).drop("batch").select(LANDED_COLUMNS).write.mode("append").parquet(f"{base}/landed")
        quotes = cycle.quotes_stream(spark, f"{base}/landed", LANDED)
        cycle.stream_merge(quotes, f"{base}/out", LANDED, f"{base}/checkpoint", most_rows=LEAF_ROWS, told=lambda *numbers: told.append(numbers)).awaitTermination()
    numbers = spark.createDataFrame(told, "batch long, leaves long, leaves_read long, inserted long")
    # leaves that may hold a returning key are read: one for each at most, but for keys the filters take for known
    return numbers.select("batch", "inserted", (F.col("leaves_read") <= F.greatest(F.lit(1), F.col("leaves"))).alias("in_leaves"),
                          ((F.col("leaves") < 8) | (F.col("leaves_read") < F.col("leaves"))).alias("part_only"))


def stream_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cycle.stream_match(_stream(spark, sf_dir), two_way_counters(spark), "seen", "1 hour", "6 hours")
    found = found.withColumns({c: clock_time(F.col(c)) for c in ("seen1", "seen2")})
    return doubles(cycle.run_to_files(found, "stream-match"), "betOdd1", "betOdd2")


def stream_match_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cycle.stream_match_three(_stream(spark, sf_dir), three_way_counters(spark), "seen", "1 hour", "48 hours")
    found = found.withColumns({c: clock_time(F.col(c)) for c in ("seen1", "seen2", "seen3")})
    return doubles(cycle.run_to_files(found, "stream-match-three", state_on_disk=True), "betOdd1", "betOdd2", "betOdd3")


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = cycle.stream_late(_stream(spark, sf_dir), datetime(2024, 1, 15, 12))
    return doubles(cycle.run_to_files(kept.drop("seen"), "stream-late"), "betOdd")


RUN_TIME = "1999-06-01 00:00:00"
RESULTS = "betRadarID bigint, RTP double, event string, insertingdate timestamp_ntz"


PARTS = 4


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of several flushes into an earlier run's results, and its one purge.

    Each part lands with as many files as it has and is one batch of the stream, which goes on where it
    stopped. A customer comes several times within a batch and over batches, and each batch has a time of its own.
    """
    return _upserted(spark, sf_dir)[0]


def stream_upsert_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state's leaves after such a run: none above the bound, each key in one, no row lost."""
    _, state, version = _upserted(spark, sf_dir)
    leaves = spark.createDataFrame([(x.depth, x.prefix, x.rows) for x in state.leaves(version)], "depth int, prefix long, rows long")
    whole = leaves.agg(F.sum("rows").alias("rows"), F.max("rows").alias("most"), F.sum(F.pow(F.lit(0.5), F.col("depth"))).alias("space"), F.count("*").alias("leaves"))
    return whole.select("rows", (F.col("most") <= UPSERT_ROWS).alias("bounded"), (F.col("space") == 1).alias("covers"), (F.col("leaves") >= F.col("rows") / UPSERT_ROWS).alias("grown"))


UPSERT_ROWS = 200


def _upserted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, GrowingState, int]:
    base = scratch_path(spark, "stream-upsert")
    orders = table(spark, sf_dir, "orders")
    part = (F.col("o_orderkey") % PARTS).cast("int")
    new = orders.select(
        F.col("o_custkey").alias("betRadarID"), F.col("o_totalprice").alias("RTP"),
        F.concat(F.lit("NEW "), F.col("o_orderkey")).alias("event"),
        (F.lit(RUN_TIME).cast("timestamp_ntz") + F.make_dt_interval(mins=part)).alias("insertingdate"),
        F.col("o_orderkey").alias("seq"), part.alias("part"),
    )
    old = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("betRadarID"), F.col("c_acctbal").alias("RTP"),
        F.concat(F.lit("OLD "), F.col("c_custkey")).alias("event"),
        F.lit("1999-05-01 00:00:00").cast("timestamp_ntz").alias("insertingdate"),
    )
    keys = ["betRadarID"]
    for k in range(PARTS):
        new.where(F.col("part") == k).drop("part").write.mode("append").parquet(f"{base}/landed")
        cycle.stream_upsert(
            cycle.quotes_stream(spark, f"{base}/landed", f"{RESULTS}, seq bigint"),
            f"{base}/state", RESULTS, f"{base}/checkpoint", keys, ["RTP", "insertingdate"], old, ["seq"], most_rows=UPSERT_ROWS,
        ).awaitTermination()
    state = GrowingState(spark, f"{base}/state", RESULTS, keys)
    version = state.newest()
    return cycle.finish_cycle(spark, f"{base}/state", RESULTS, keys, version, datetime.fromisoformat(RUN_TIME)), state, version


QUERIES = {
    "stream_dedupe": stream_dedupe,
    "stream_merge": stream_merge,
    "stream_merge_batches": stream_merge_batches,
    "stream_match": stream_match,
    "stream_match_three": stream_match_three,
    "stream_late": stream_late,
    "stream_upsert": stream_upsert,
    "stream_upsert_leaves": stream_upsert_leaves,
}

_CASES = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SELECTIONS[:5]))
STREAM_SQL = f"""s AS (SELECT 'B' || ((event_id // 6) % 3) AS bookmaker, user_id AS "betRadarID",
  'EVENT ' || user_id AS event, ts AS date,
  CASE event_id % 6 {_CASES} ELSE '{SELECTIONS[5]}' END AS bet,
  CAST(1.01 + (event_id % 200) / 100 AS DECIMAL(10,2)) AS "betOdd", event_id AS ingest_seq FROM events)"""

SQL = {
    "stream_dedupe": f'WITH {STREAM_SQL} SELECT DISTINCT bookmaker, "betRadarID", event, bet FROM s',
    "stream_merge": f"""WITH {STREAM_SQL} SELECT bookmaker, "betRadarID", event, date, bet,
  "betOdd"::DOUBLE AS "betOdd", ingest_seq FROM s
  QUALIFY row_number() OVER (PARTITION BY bookmaker, "betRadarID", event, bet ORDER BY ingest_seq) = 1""",
    "stream_match": f"""WITH {STREAM_SQL}, {COUNTERS2_SQL}
  SELECT {sql_round2("raw")} AS "RTP", * EXCLUDE (raw) FROM (
    SELECT a."betOdd"::DOUBLE * (1::DOUBLE - 1::DOUBLE / b."betOdd"::DOUBLE) * 100::DOUBLE AS raw,
      a."betRadarID", a.bookmaker AS bookmaker1, a.bet AS bet1, a."betOdd"::DOUBLE AS "betOdd1", a.date AS seen1,
      b.bookmaker AS bookmaker2, b.bet AS bet2, b."betOdd"::DOUBLE AS "betOdd2", b.date AS seen2
    FROM s a JOIN c2 ON c2.bet = a.bet JOIN s b ON b."betRadarID" = a."betRadarID"
      AND b.bet = c2.counter AND b.bookmaker <> a.bookmaker
      AND b.date BETWEEN a.date - INTERVAL 6 HOURS AND a.date + INTERVAL 6 HOURS)""",
    "stream_match_three": f"""WITH {STREAM_SQL}, {COUNTERS3_SQL}
  SELECT {sql_round2("raw")} AS "RTP", * EXCLUDE (raw) FROM (
    SELECT a."betOdd"::DOUBLE * (1::DOUBLE - 1::DOUBLE / b."betOdd"::DOUBLE - 1::DOUBLE / c."betOdd"::DOUBLE) * 100::DOUBLE AS raw,
      a."betRadarID", a.bookmaker AS bookmaker1, a.bet AS bet1, a."betOdd"::DOUBLE AS "betOdd1", a.date AS seen1,
      b.bookmaker AS bookmaker2, b.bet AS bet2, b."betOdd"::DOUBLE AS "betOdd2", b.date AS seen2,
      c.bookmaker AS bookmaker3, c.bet AS bet3, c."betOdd"::DOUBLE AS "betOdd3", c.date AS seen3
    FROM s a JOIN c3 ON c3.bet = a.bet
    JOIN s b ON b."betRadarID" = a."betRadarID" AND b.bet = c3.counter1 AND b.bookmaker <> a.bookmaker
      AND b.date BETWEEN a.date - INTERVAL 48 HOURS AND a.date + INTERVAL 48 HOURS
    JOIN s c ON c."betRadarID" = a."betRadarID" AND c.bet = c3.counter2 AND c.bookmaker <> a.bookmaker AND c.bookmaker <> b.bookmaker
      AND c.date BETWEEN a.date - INTERVAL 48 HOURS AND a.date + INTERVAL 48 HOURS
      AND c.date BETWEEN b.date - INTERVAL 48 HOURS AND b.date + INTERVAL 48 HOURS)""",
    "stream_late": f"""WITH {STREAM_SQL} SELECT bookmaker, "betRadarID", event, date, bet,
  "betOdd"::DOUBLE AS "betOdd", ingest_seq FROM s WHERE date >= TIMESTAMP '2024-01-15 12:00:00'""",
    "stream_upsert": f"""WITH n AS (SELECT *, o_orderkey % {PARTS} AS part FROM orders)
  SELECT o_custkey AS "betRadarID", arg_max(o_totalprice, part * 1e12 + o_orderkey) AS "RTP",
    CASE WHEN o_custkey % 2 = 0 AND o_custkey IN (SELECT c_custkey FROM customer) THEN 'OLD ' || o_custkey
      ELSE 'NEW ' || arg_min(o_orderkey, part * 1e12 + o_orderkey) END AS event,
    TIMESTAMP '{RUN_TIME}' + to_minutes(CAST(max(part) AS INTEGER)) AS insertingdate
  FROM n GROUP BY o_custkey""",
    "stream_merge_batches": f"""WITH l AS (SELECT 'B' || (l_suppkey % 7) AS bookmaker, l_partkey AS id, l_linenumber AS line,
    l_orderkey * 10 + l_linenumber AS seq, l_partkey % {BATCHES} AS batch FROM lineitem),
  a AS (SELECT bookmaker, id, line, seq, batch FROM l UNION SELECT bookmaker, id, line, seq + 1000000000000, batch + 1 FROM l WHERE seq % 997 = 5),
  f AS (SELECT bookmaker, id, line, min(batch) AS batch FROM a GROUP BY ALL)
  SELECT b.batch::BIGINT AS batch, count(f.batch)::BIGINT AS inserted, true AS in_leaves, true AS part_only
  FROM (SELECT unnest(range({BATCHES + 1})) AS batch) b LEFT JOIN f USING (batch) GROUP BY b.batch""",
    "stream_upsert_leaves": """SELECT count(*)::BIGINT AS rows, true AS bounded, true AS covers, true AS grown FROM (
    SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)""",
}

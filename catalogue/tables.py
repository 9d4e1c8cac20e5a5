"""Merges, snapshots and quarantine."""

from __future__ import annotations

from datetime import datetime

from catalogue.views import COUNTERS2_SQL, QUOTES_SQL, doubles, quotes, sql_round2, sql_strip, table
from pricematch.operators.match import stamp_run, tag_bookmaker
from pricematch.operators.shape import dedupe, union_feeds
from pricematch.plans.runs import match_run, register_views
from pricematch.session import scratch_path
from pricematch.sinks import merge, tables
from pricematch.sinks.versions import Conflict, TableLog
from pricematch.sources.dictionaries import read_dictionary, three_way_counters, two_way_counters
from pricematch.sources.quotes import read_quotes
from pyspark.sql import DataFrame, SparkSession, functions as F

RUN = datetime(1999, 6, 1)


def _customer_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as quotes on customers; a quote is keyed by customer and priority."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("betRadarID"), F.col("o_orderpriority").alias("bet"),
        F.col("o_totalprice").alias("betOdd"), F.col("o_orderkey").alias("ingest_seq"),
    )


KEYS = ["betRadarID", "bet"]


def _merged(spark: SparkSession, sf_dir: str, how) -> DataFrame:
    arrived = _customer_quotes(spark, sf_dir)
    target = dedupe(arrived.where("ingest_seq % 4 = 0"), KEYS, ["ingest_seq"])
    return how(target, arrived.where("ingest_seq % 4 <> 0"), KEYS)


def merge_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, merge.merge_insert_only)


def merge_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, merge.merge_replace)


def upsert_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    old = orders.where("o_orderkey % 3 <> 0").select(
        F.col("o_orderkey").alias("betRadarID"), F.col("o_totalprice").alias("RTP"),
        F.col("o_orderstatus").alias("event"), F.col("o_orderdate").alias("insertingdate"),
    )
    new = stamp_run(orders.where("o_orderkey % 2 = 0"), RUN).select(
        F.col("o_orderkey").alias("betRadarID"), (F.col("o_totalprice") + 1).alias("RTP"),
        F.col("o_orderpriority").alias("event"), "insertingdate",
    )
    state = merge.upsert_matches(old, new, ["betRadarID"], ["RTP", "insertingdate"])
    return merge.purge_stale(state, RUN)


def upsert_odds_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant that leaves the return as it was, and purges nothing."""
    parts = table(spark, sf_dir, "part")
    old = parts.where("p_partkey % 3 > 0").select(
        F.col("p_partkey").alias("betRadarID"), F.lit(1.0).alias("RTP"), F.col("p_retailprice").alias("betOdd1")
    )
    new = parts.where("p_partkey % 2 = 0").select(
        F.col("p_partkey").alias("betRadarID"), F.lit(2.0).alias("RTP"), F.col("p_size").cast("double").alias("betOdd1")
    )
    return merge.upsert_matches(old, new, ["betRadarID"], ["betOdd1"])


def union_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("event"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("event"), F.col("s_suppkey").alias("id"))
    return union_feeds(tag_bookmaker(customers, "customer"), tag_bookmaker(suppliers, "supplier"))


def snapshot_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copy the quotes, then read back two selections; the list reaches the scan."""
    base = scratch_path(spark, "snapshot")
    tables.write_version(quotes(spark, sf_dir), base, 0)
    copied = read_quotes(spark, f"{base}/version=000000000000", ["1X2 <> 1", "1X2 <> X"])
    return doubles(copied, "betOdd")


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose key is not theirs alone, kept in files by reason."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    _, shared = merge.assert_unique(lines, ["l_orderkey", "l_linenumber"])
    path = scratch_path(spark, "quarantine")
    tables.write_quarantine(
        shared.withColumn("reason", F.concat(F.lit("key not unique, flag "), "l_returnflag")).drop("l_returnflag"), path
    )
    return spark.read.schema("l_orderkey bigint, l_linenumber int, l_partkey bigint, reason string").parquet(path)


def table_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cycle of a table: made, filled, copied in buckets of its key, emptied."""
    path = scratch_path(spark, "cycle")
    name = "cycle_" + path[-8:]
    tables.ensure_table(spark, name, "betRadarID bigint, bet string, betOdd double, ingest_seq bigint", f"{path}/table")
    _customer_quotes(spark, sf_dir).write.insertInto(name)
    copied = tables.snapshot(spark.table(name), f"{name}_copy", ["betRadarID"], 16, f"{path}/copy")
    tables.reset_table(spark, name)
    return copied.withColumn("source", F.lit("copy")).unionByName(
        spark.table(name).withColumn("source", F.lit("emptied"))
    )


HISTORY = "betRadarID bigint, bet string, betOdd double, ingest_seq bigint"


def _log(spark: SparkSession, sf_dir: str) -> TableLog:
    """Appended twice, changed by an update, emptied, filled again."""
    log = TableLog(spark, scratch_path(spark, "history"), HISTORY)
    rows = _customer_quotes(spark, sf_dir)
    first = log.append(rows.where("betRadarID % 2 = 0"), None)
    second = log.append(rows.where("betRadarID % 2 = 1"), first)
    third = log.update(lambda old: old.where("betRadarID % 3 = 0").withColumn("betOdd", F.col("betOdd") + 1))
    try:
        log.replace(rows, second)  # a writer that has not seen the update
    except Conflict:
        log.append(rows.where("betRadarID % 7 = 0"), log.reset(third))
    return log


def table_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as of each of its versions."""
    log = _log(spark, sf_dir)
    return union_feeds(*[log.read(v).withColumn("version", F.lit(v)) for v in log.versions()])


def table_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its history, with the rows of each version."""
    log = _log(spark, sf_dir)
    sizes = [log.read(v).agg(F.lit(v).cast("bigint").alias("version"), F.count("*").alias("rows")) for v in log.versions()]
    return log.history().join(union_feeds(*sizes), "version")


def dictionary_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary file as long as the parts table, with commas in its labels."""
    path = scratch_path(spark, "dictionary")
    entries = table(spark, sf_dir, "part").select(
        F.concat(F.lit('U/O "'), "p_partkey", F.lit('",5 <> '), "p_type").alias("original"),
        F.concat_ws(", ", "p_brand", "p_name").alias("canonical"),
    )
    entries.write.option("escape", '"').csv(path)
    return read_dictionary(spark, path, "labels")


def adhoc_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables by name, in SQL."""
    staged = quotes(spark, sf_dir)
    two, three = match_run(staged, two_way_counters(spark), three_way_counters(spark), RUN)
    register_views(staged, two, three)
    return spark.sql("""
        SELECT m.betRadarID, m.event, CAST(m.RTP AS DOUBLE) AS RTP, m.bookmaker1, m.bet1, m.bookmaker2, m.bet2
        FROM bet_matches_two_outcomes m
        WHERE m.RTP > 95 AND EXISTS (
            SELECT 1 FROM quotes o WHERE o.betRadarID = m.betRadarID AND o.bet = 'OTHER')
        ORDER BY RTP DESC""")


QUERIES = {
    "table_cycle": table_cycle,
    "table_history": table_history,
    "table_log": table_log,
    "dictionary_read": dictionary_read,
    "adhoc_sql": adhoc_sql,
    "merge_first": merge_first,
    "merge_last": merge_last,
    "upsert_purge": upsert_purge,
    "upsert_odds_only": upsert_odds_only,
    "union_feeds": union_vendors,
    "snapshot_read": snapshot_read,
    "quarantine": quarantine,
}

_CUSTOMER_SQL = """c AS (SELECT o_custkey AS "betRadarID", o_orderpriority AS bet, o_totalprice AS "betOdd",
  o_orderkey AS ingest_seq FROM orders)"""
_FIRST = 'PARTITION BY "betRadarID", bet ORDER BY ingest_seq'

_RAW = 'a."betOdd"::DOUBLE * (1::DOUBLE - 1::DOUBLE / b."betOdd"::DOUBLE) * 100::DOUBLE'

SQL = {
    "table_cycle": f"WITH {_CUSTOMER_SQL} SELECT *, 'copy' AS source FROM c",
    "table_history": f"""WITH {_CUSTOMER_SQL} SELECT *, 0 AS version FROM c WHERE "betRadarID" % 2 = 0
      UNION ALL SELECT *, 1 FROM c
      UNION ALL SELECT * REPLACE ("betOdd" + 1 AS "betOdd"), 2 FROM c WHERE "betRadarID" % 3 = 0
      UNION ALL SELECT *, 4 FROM c WHERE "betRadarID" % 7 = 0""",
    "table_log": f"""WITH {_CUSTOMER_SQL}
      SELECT 0 AS version, 'append' AS action, 1 AS folders, count(*) FILTER ("betRadarID" % 2 = 0) AS rows FROM c
      UNION ALL SELECT 1, 'append', 2, count(*) FROM c
      UNION ALL SELECT 2, 'replace', 1, count(*) FILTER ("betRadarID" % 3 = 0) FROM c
      UNION ALL SELECT 3, 'reset', 0, 0
      UNION ALL SELECT 4, 'append', 1, count(*) FILTER ("betRadarID" % 7 = 0) FROM c""",
    "dictionary_read": """SELECT 'U/O "' || p_partkey || '",5 <> ' || p_type AS original,
      p_brand || ', ' || p_name AS canonical FROM part""",
    "adhoc_sql": f"""WITH {QUOTES_SQL}, {COUNTERS2_SQL},
      m AS (SELECT a."betRadarID", a.event, {_RAW} AS raw, a.bookmaker AS bookmaker1, {sql_strip("a.bet")} AS bet1,
        b.bookmaker AS bookmaker2, {sql_strip("b.bet")} AS bet2 FROM q a JOIN c2 ON c2.bet = a.bet
        JOIN q b ON b."betRadarID" = a."betRadarID" AND b.bet = c2.counter AND b.bookmaker <> a.bookmaker)
      SELECT "betRadarID", event, {sql_round2("raw")} AS "RTP", bookmaker1, bet1, bookmaker2, bet2 FROM m
      WHERE {sql_round2("raw")} > 95 AND "betRadarID" IN (SELECT "betRadarID" FROM q WHERE bet = 'OTHER')""",
    # A key of the target keeps its row; of the others the first comes in.
    "merge_first": f"""WITH {_CUSTOMER_SQL} SELECT * FROM c QUALIFY row_number() OVER (
      PARTITION BY "betRadarID", bet ORDER BY (ingest_seq % 4 = 0) DESC, ingest_seq) = 1""",
    "merge_last": f"""WITH {_CUSTOMER_SQL},
      t AS (SELECT * FROM c WHERE ingest_seq % 4 = 0 QUALIFY row_number() OVER ({_FIRST}) = 1),
      n AS (SELECT * FROM c WHERE ingest_seq % 4 <> 0 QUALIFY row_number() OVER ({_FIRST} DESC) = 1)
      SELECT * FROM n UNION ALL SELECT * FROM t WHERE NOT EXISTS (
        SELECT 1 FROM n WHERE n."betRadarID" = t."betRadarID" AND n.bet = t.bet)""",
    "upsert_purge": """WITH o AS (SELECT o_orderkey AS id, o_totalprice AS rtp, o_orderstatus AS event,
        o_orderdate AS d FROM orders WHERE o_orderkey % 3 <> 0),
      n AS (SELECT o_orderkey AS id, o_totalprice + 1 AS rtp, o_orderpriority AS event,
        TIMESTAMP '1999-06-01' AS d FROM orders WHERE o_orderkey % 2 = 0)
      SELECT coalesce(o.id, n.id) AS "betRadarID", coalesce(n.rtp, o.rtp) AS "RTP",
        coalesce(o.event, n.event) AS event, coalesce(n.d, o.d) AS insertingdate
      FROM o FULL JOIN n ON o.id = n.id
      WHERE coalesce(n.d, o.d) >= TIMESTAMP '1999-06-01' - INTERVAL 2 SECONDS""",
    "upsert_odds_only": """SELECT p_partkey AS "betRadarID",
        CASE WHEN p_partkey % 3 > 0 THEN 1::DOUBLE ELSE 2::DOUBLE END AS "RTP",
        CASE WHEN p_partkey % 2 = 0 THEN p_size::DOUBLE ELSE p_retailprice END AS "betOdd1"
      FROM part WHERE p_partkey % 3 > 0 OR p_partkey % 2 = 0""",
    "union_feeds": """SELECT c_custkey AS id, c_name AS event, 'customer' AS bookmaker FROM customer
      UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier""",
    "snapshot_read": f"WITH {QUOTES_SQL}" + """ SELECT bookmaker, tournament, "betRadarID", event, date, bet,
      "betOdd"::DOUBLE AS "betOdd" FROM q WHERE bet IN ('1X2 <> 1', '1X2 <> X')""",
    "quarantine": """SELECT l_orderkey, l_linenumber, l_partkey, 'key not unique, flag ' || l_returnflag AS reason
      FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1""",
}

"""Streams of quotes.

Parsers, label and price functions are narrow, so the batch ones serve streams as
they are. This module adds what needs state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pricematch.fixed_values import NO_ID, QUOTE_KEYS
from pricematch.functions.scoring import RTP
from pricematch.operators.filters import future_only
from pricematch.session import scratch_path
from pricematch.sinks.growing import GrowingState
from pricematch.sinks.merge import purge_stale, upsert_matches


def quotes_stream(
    spark: SparkSession, path: str, schema: str, max_files: int | None = None, format: str = "parquet"
) -> DataFrame:
    """New files under ``path`` as they land; ``max_files`` bounds a micro-batch."""
    reader = spark.readStream.format(format).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # A pattern, as the source does not take the name of a single file.
    path = path.rstrip("/")
    return reader.load(f"{path[:-1]}[{path[-1]}]")


def stream_dedupe(
    quotes: DataFrame, event_time: str, delay: str, keys: Sequence[str] = tuple(QUOTE_KEYS),
    spread_by: str | None = None, salts: int = 32,
) -> DataFrame:
    """The first quote of a key within the delay; state is dropped after it.

    A stream has no combine before the shuffle of this operator, so all copies of
    a hot key would meet in one task. ``spread_by`` names a column that differs
    between copies: copies are first thinned within each of its ``salts`` parts.
    The salt is a hash of the row, so that a task run again salts alike.
    """
    timed = quotes.withWatermark(event_time, delay)
    if spread_by:
        timed = (
            timed.withColumn("__salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
            .dropDuplicatesWithinWatermark([*keys, "__salt"])
            .drop("__salt")
        )
    return timed.dropDuplicatesWithinWatermark(list(keys))


def stream_late(quotes: DataFrame, run_ts: datetime | Column | None = None, inclusive: bool = True) -> DataFrame:
    """Leave out events that have started, by the clock of each micro-batch."""
    return future_only(quotes, F.localtimestamp() if run_ts is None else run_ts, inclusive)


def stream_match(
    quotes: DataFrame, counters: DataFrame, event_time: str, delay: str, within: str, rtp: str = "hedge"
) -> DataFrame:
    """Two-way matches as quotes arrive: every pair of complementary quotes of one id at two
    bookmakers whose times are at most ``within`` apart, sent out when the later one arrives.

    No quote is thinned out, and no window has an edge to fall on either side of. The bound
    lets the join drop a quote from its state ``within`` and ``delay`` after its time; only a
    quote later than ``delay`` is too late. Rows without an id meet nothing.
    """
    known = quotes.where(F.col("betRadarID").isNotNull() & (F.col("betRadarID") != NO_ID))
    seeds = known.withWatermark(event_time, delay).join(counters, "bet").select(
        "betRadarID", F.col("bookmaker").alias("bookmaker1"), F.col("bet").alias("bet1"),
        F.col("betOdd").alias("betOdd1"), F.col(event_time).alias("seen1"), F.col("counter").alias("__want"),
    )
    partners = known.withWatermark(event_time, delay).select(
        F.col("betRadarID").alias("__id"), F.col("bookmaker").alias("bookmaker2"), F.col("bet").alias("bet2"),
        F.col("betOdd").alias("betOdd2"), F.col(event_time).alias("seen2"),
    )
    span = F.expr(f"INTERVAL {within}")
    pairs = seeds.join(
        partners,
        (F.col("betRadarID") == F.col("__id")) & (F.col("__want") == F.col("bet2"))
        & (F.col("bookmaker1") != F.col("bookmaker2"))
        & (F.col("seen2") >= F.col("seen1") - span) & (F.col("seen2") <= F.col("seen1") + span),
    )
    return pairs.select(
        RTP[rtp](F.col("betOdd1"), F.col("betOdd2")).alias("RTP"),
        "betRadarID", "bookmaker1", "bet1", "betOdd1", "seen1", "bookmaker2", "bet2", "betOdd2", "seen2",
    )


def stream_match_three(
    quotes: DataFrame, counters: DataFrame, event_time: str, delay: str, within: str, rtp: str = "hedge"
) -> DataFrame:
    """Three-way matches as quotes arrive: every triple of complementary quotes of one id at three bookmakers whose
    times are pairwise at most ``within`` apart, sent out when the last of them arrives. Every selection seeds its own.

    Two joins in a chain. The first one's pairs come up to ``within`` after their seed's time, and Spark holds the
    second join's watermark back by as much, so no pair is late there. The pair keeps the seed's time as its event
    time, and the third leg is bound to that: both joins drop their state. Rows without an id meet nothing.
    """
    known = quotes.where(F.col("betRadarID").isNotNull() & (F.col("betRadarID") != NO_ID)).withWatermark(event_time, delay)
    span = F.expr(f"INTERVAL {within}")
    near = lambda a, b: (F.col(a) >= F.col(b) - span) & (F.col(a) <= F.col(b) + span)

    def leg(n: int) -> DataFrame:
        """Quotes as leg ``n``; of legs two and three only those that complete some market, as others would wait in the state for nothing."""
        wanted = None if n == 1 else counters.select(F.col(f"counter{n - 1}").alias("bet")).distinct()
        quoted = known if wanted is None else known.join(wanted, "bet", "left_semi")
        return quoted.select(
            F.col("betRadarID").alias(f"__id{n}"), F.col("bookmaker").alias(f"bookmaker{n}"), F.col("bet").alias(f"bet{n}"),
            F.col("betOdd").alias(f"betOdd{n}"), F.col(event_time).alias(f"seen{n}"),
        )

    seeds = leg(1).join(counters.withColumnRenamed("bet", "bet1"), "bet1")
    pairs = seeds.join(
        leg(2),
        (F.col("__id1") == F.col("__id2")) & (F.col("counter1") == F.col("bet2"))
        & (F.col("bookmaker1") != F.col("bookmaker2")) & near("seen2", "seen1"),
    )
    # One event time goes on: an expression does not carry the other's watermark.
    pairs = pairs.withColumn("seen2", F.col("seen2") + F.expr("INTERVAL 0 SECONDS")).drop("__id2", "counter1")
    triples = pairs.join(
        leg(3),
        (F.col("__id1") == F.col("__id3")) & (F.col("counter2") == F.col("bet3")) & (F.col("bookmaker1") != F.col("bookmaker3"))
        & (F.col("bookmaker2") != F.col("bookmaker3")) & near("seen3", "seen1") & near("seen3", "seen2"),
    )
    sides = [f"{c}{n}" for n in (1, 2, 3) for c in ("bookmaker", "bet", "betOdd", "seen")]
    prices = [F.col(f"betOdd{n}") for n in (1, 2, 3)]
    return triples.select(RTP[rtp](*prices).alias("RTP"), F.col("__id1").alias("betRadarID"), *sides)


def stream_merge(
    quotes: DataFrame, base: str, schema: str, checkpoint: str,
    keys: Sequence[str] = tuple(QUOTE_KEYS), order: Sequence[str] = ("ingest_seq",),
    most_rows: int = 1_000_000, told: Callable[[int, int, int, int], None] | None = None,
) -> StreamingQuery:
    """Insert-if-absent into a stored table, exact over any span of time.

    The table, a ``GrowingState`` at ``base``, is the state. A batch asks the Bloom filters of the leaves its keys
    fall into, and reads only leaves that may hold one of them. One that is run again writes the same version.
    ``told`` hears the batch, and the leaves, leaves read and rows inserted.
    """
    state = GrowingState(quotes.sparkSession, base, schema, keys, most_rows)
    if state.newest() is None:
        state.create(quotes.sparkSession.createDataFrame([], schema))

    def merge(batch: DataFrame, batch_id: int) -> None:
        numbers = state.insert_absent(batch, order, f"{checkpoint}#{batch_id}")
        if told:
            told(batch_id, *numbers)

    return (
        quotes.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def merged_quotes(spark: SparkSession, base: str, schema: str, keys: Sequence[str] = tuple(QUOTE_KEYS)) -> DataFrame:
    """The table that ``stream_merge`` keeps at ``base``, as its last batch left it."""
    state = GrowingState(spark, base, schema, keys)
    return state.read(state.newest())


def stream_upsert(
    matches: DataFrame, base: str, schema: str, checkpoint: str, keys: Sequence[str],
    update: Sequence[str], start: DataFrame | None = None, order: Sequence[str] | None = None,
    buckets: int = 1, most_rows: int = 1_000_000,
) -> StreamingQuery:
    """Upsert each micro-batch's matches into a state in leaves of the key's hash.

    A batch reads the leaves it touches in one version and writes them in the next, so that one
    run again writes the same and a small batch costs a small part of the table. Leaves split as they pass ``most_rows``, from the ``buckets`` that are there at first. Version 0 is
    the table to start on, by default an empty one, and is written if there is none yet.
    Nothing is purged here: a run flushes many batches and ends with one ``finish_cycle``.
    """
    spark = matches.sparkSession
    state = GrowingState(spark, base, schema, keys, most_rows, buckets)
    if state.newest() is None:
        state.create(spark.createDataFrame([], schema) if start is None else start)

    def refresh(batch: DataFrame, batch_id: int) -> None:
        # Micro-batches have a session of their own, the state's reads need that of the stream.
        batch.persist()
        try:
            state.replace(batch, lambda old: upsert_matches(old, batch, keys, update, order), f"{checkpoint}#{batch_id}")
        finally:
            batch.unpersist()

    return (
        matches.writeStream.foreachBatch(refresh)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def finish_cycle(
    spark: SparkSession, base: str, schema: str, keys: Sequence[str], version: int,
    run_ts: datetime | Column, buckets: int = 1,
) -> DataFrame:
    """What a run leaves: the state of ``version`` without rows older than the run's start, ``run_ts``."""
    return purge_stale(GrowingState(spark, base, schema, keys, start=buckets).read(version), run_ts)


STATE_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for a while; a stream takes those it starts with."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_to_files(stream: DataFrame, name: str, state_on_disk: bool = False) -> DataFrame:
    """Run an append stream over what is there now, and read what it wrote.

    State is in the executors' heap by default, which is faster while it is small; ``state_on_disk`` is for one that grows
    with the input, as that of joins whose bound spans much of it.
    """
    spark = stream.sparkSession
    base = scratch_path(spark, name)
    with _settings(spark, STATE_ON_DISK if state_on_disk else {}):
        query = (
            stream.writeStream.format("parquet")
            .option("path", f"{base}/out")
            .option("checkpointLocation", f"{base}/checkpoint")
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")

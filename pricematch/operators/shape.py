"""Distinct, dedupe, carry-forward, order, union."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window as W, functions as F

from pricematch.session import scratch_path


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def dedupe(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "first"
) -> DataFrame:
    """The first or the last row of each key in the given order.

    Spark keeps one row per key and map task before the shuffle (its window
    group limit), so copies of a hot key do not travel. ``order`` must be total
    within a key for reruns to agree.
    """
    by = [F.col(c).asc() if keep == "first" else F.col(c).desc() for c in order]
    w = W.partitionBy(*keys).orderBy(*by)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def dedupe_stored(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], path: str, keep: str = "first", most_shared: float = 0.05,
    a_task: int = 1_000_000,
) -> DataFrame:
    """As ``dedupe``, for stored rows of which few share their key: the others neither travel nor are sorted.

    Hashes of keys are counted first, about ``a_task`` rows in a task however many there are, as nearly all are counted
    once and would fill what is kept of them before a shuffle; copies of a hot key go by as numbers. Only rows whose hash
    comes twice are deduplicated, which a hash that two keys share does not change. Where more than ``most_shared`` of the hashes come twice, all rows are. What is found is
    written under ``path``, so that the result may be read several times; ``df`` must stay where it is as long.
    """
    def kept(found: DataFrame, name: str) -> DataFrame:
        found.write.mode("overwrite").parquet(f"{path}/{name}")
        return found.sparkSession.read.schema(found.schema).parquet(f"{path}/{name}")

    key = F.xxhash64(*keys)
    seen = Observation()
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // a_task + 1)
    hashes = df.select(key.alias("__key")).repartition(parts, "__key")
    counted = hashes.groupBy("__key").agg(F.count(F.lit(1)).alias("n")).observe(seen, F.count(F.lit(1)).alias("all"))
    twice = kept(counted.where("n > 1").select("__key"), "twice")
    if twice.count() > most_shared * seen.get["all"]:
        return kept(dedupe(df, keys, order, keep), "firsts")
    same = key == F.col("__key")
    firsts = kept(dedupe(df.join(twice, same, "left_semi"), keys, order, keep), "firsts")
    return df.join(twice, same, "left_anti").unionByName(firsts)


def sum_map_values(counts: Column) -> Column:
    """Sum of a map's values; null for a null map."""
    return F.aggregate(F.map_values(counts), F.lit(0).cast("bigint"), lambda a, b: a + b)


def carry_forward_label(
    df: DataFrame,
    partition: Sequence[str],
    order: Sequence[str],
    value: str,
    chunk: Column | None = None,
    out: str | None = None,
) -> DataFrame:
    """Fill nulls with the last value seen before them in the partition.

    A partition may be far larger than a task should sort. ``chunk`` cuts it into
    stretches of its order (a day of a timestamp, ``position div n``): it must
    never fall as the order rises. Each stretch is then filled on its own, and
    takes what the stretches before it left off from a table of one row each.

    Without ``chunk`` the stretches are slices of the whole table in the order of
    (partition, order), of about the same number of rows each, so that a partition
    has as many as its size asks for. Slices are dealt by a sample of the rows, which
    need not come out the same twice, so they are written to the shared folder here.
    """
    out = out or value
    partition, order = list(partition), list(order)
    if chunk is None:
        path = scratch_path(df.sparkSession, "slices")
        slices = df.repartitionByRange(*partition, *order).withColumn("__slice", F.spark_partition_id())
        slices.write.parquet(path)
        stored = df.sparkSession.read.schema(slices.schema).parquet(path)
        return carry_forward_label(stored, partition, order, value, F.col("__slice"), out).drop("__slice")

    # A struct equals another also where fields are null, so that one key serves
    # the join and the window, and the rows are shuffled once.
    group = F.struct(*partition, chunk.alias("__chunk"))
    cut = df.withColumn("__group", group)
    position = F.struct(*order)
    ends = cut.groupBy("__group").agg(
        F.max(F.when(F.col(value).isNotNull(), F.struct(position, F.col(value)))).alias("__end")
    )
    before = (
        W.partitionBy(*[F.col("__group").getField(p) for p in partition])
        .orderBy(F.col("__group").getField("__chunk"))
        .rowsBetween(W.unboundedPreceding, -1)
    )
    carried = ends.select(
        "__group", F.last("__end", ignorenulls=True).over(before).getField(value).alias("__carry")
    )
    inside = W.partitionBy("__group").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = F.last(value, ignorenulls=True).over(inside)
    kept = [c for c in df.columns if c != out]
    return cut.join(carried, "__group", "left").select(*kept, F.coalesce(local, "__carry").alias(out))


def order_by(df: DataFrame, *columns: str | Column) -> DataFrame:
    return df.orderBy(*columns)


def head(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first rows in a total order; without one "first" means nothing."""
    return df.orderBy(*order).limit(n)


def top_rtp(matches: DataFrame, n: int, threshold: float | None = None) -> DataFrame:
    """The best returns. The other columns break ties, so the list is stable."""
    if threshold is not None:
        matches = matches.where(F.col("RTP") > threshold)
    ties = [c for c in matches.columns if c != "RTP"]
    return matches.orderBy(F.col("RTP").desc(), *ties).limit(n)


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """All feeds in one table, by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)

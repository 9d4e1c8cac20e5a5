"""Tables and files that hold state between runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def ensure_table(spark: SparkSession, name: str, schema: str, path: str | None = None) -> DataFrame:
    """Create the table if it is absent, in the warehouse or at a path."""
    location = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet{location}")
    return spark.table(name)


def reset_table(spark: SparkSession, name: str, drop: bool = False) -> None:
    """Empty the table between cycles, or drop it.

    Emptied by an overwrite, as TRUNCATE is refused for a table at a path.
    """
    if drop:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    else:
        spark.createDataFrame([], spark.table(name).schema).write.insertInto(name, overwrite=True)


def snapshot(
    df: DataFrame, name: str, bucket_by: Sequence[str] = (), buckets: int = 200,
    path: str | None = None,
) -> DataFrame:
    """A copy as a table. Bucketed by its keys, later joins on them skip a shuffle."""
    writer = df.write.mode("overwrite").format("parquet")
    if path:
        writer = writer.option("path", path)
    if bucket_by:
        writer = writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def write_quarantine(df: DataFrame, path: str) -> None:
    """Rejected rows, by reason."""
    df.write.mode("append").partitionBy("reason").parquet(path)


def write_version(df: DataFrame, base: str, version: int) -> str:
    """Write a whole new state next to the one it was computed from.

    A state cannot be overwritten while it is read. Writing a version again, as a
    retried batch does, replaces that version alone.
    """
    path = f"{base}/version={version:012d}"
    df.write.mode("overwrite").parquet(path)
    return path


def read_version(spark: SparkSession, base: str, version: int | None, schema: str) -> DataFrame:
    """A written state; with no version, an empty one."""
    if version is None:
        return spark.createDataFrame([], StructType.fromDDL(schema))
    return spark.read.schema(schema).parquet(f"{base}/version={version:012d}")


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system its path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class BucketedState:
    """A table in hash buckets of its key, of which a new version rewrites only those it touches.

    Version n writes its buckets under ``state-n`` and a small table that says for each bucket
    which version holds it. A version written again, as a retried batch does, replaces itself.
    Files that neither the newest nor the version before it needs are deleted.
    """

    def __init__(self, spark: SparkSession, base: str, schema: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.base, self.schema, self.buckets = spark, base.rstrip("/"), schema, buckets
        self.keys = list(keys)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _where(self, version: int) -> dict[int, int]:
        """Bucket to the version that holds it: at most as many rows as there are buckets."""
        rows = self.spark.read.schema("bucket int, version long").parquet(f"{self.base}/places-{version:012d}").collect()
        return {r.bucket: r.version for r in rows}

    def read(self, version: int, only: Sequence[int] | None = None) -> DataFrame:
        paths = [
            f"{self.base}/state-{v:012d}/__bucket={b}"
            for b, v in sorted(self._where(version).items()) if only is None or b in only
        ]
        if not paths:
            return self.spark.createDataFrame([], StructType.fromDDL(self.schema))
        return self.spark.read.schema(self.schema).parquet(*paths)

    def write(self, state: DataFrame, version: int, before: int | None = None) -> None:
        """Make ``state`` the content of its buckets; the others stay as in version ``before``."""
        folder = f"{self.base}/state-{version:012d}"
        state.withColumn("__bucket", self.bucket()).write.mode("overwrite").partitionBy("__bucket").parquet(folder)
        old = {} if before is None else self._where(before)
        written = self.spark.read.schema(f"{self.schema}, __bucket int").parquet(folder).select("__bucket").distinct().collect()
        now = old | {r[0]: version for r in written}
        places = self.spark.createDataFrame(sorted(now.items()), "bucket int, version long")
        places.coalesce(1).write.mode("overwrite").parquet(f"{self.base}/places-{version:012d}")
        if before is not None and before > 0:
            self._forget(before - 1, old, now)

    def _forget(self, version: int, *needed: dict[int, int]) -> None:
        keep = {v for places in needed for v in places.values()}
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/places-{version:012d}")
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return  # forgotten by an earlier try of this batch
        for v in set(self._where(version).values()) - keep:
            drop_folder(self.spark, f"{self.base}/state-{v:012d}")
        drop_folder(self.spark, f"{self.base}/places-{version:012d}")

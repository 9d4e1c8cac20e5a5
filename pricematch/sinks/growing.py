"""A keyed table that grows by splitting: an extendible hash directory of leaves, each with a Bloom filter.

A leaf is the rows whose key hash ends in the ``depth`` bits ``prefix``. The directory of a version, one row for
each leaf, says which versions hold its rows and its filter. A version writes only the leaves it changes; one
that would pass ``most_rows`` is split by as many further bits as it takes, and the others stay as they are. Files
hold many leaves each, sorted by their names, so that a version has as many files as its rows ask for. A
version written again, as a retried batch does, replaces itself, and files that neither the newest directory nor
the one before it needs are deleted. One writer at a time is assumed, as a stream's checkpoint gives. Lists of leaves go through the driver, as lists of files do; rows do not.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from pricematch.operators.shape import dedupe
from pricematch.sinks.tables import drop_folder

_DIRECTORY = "depth int, prefix long, versions array<long>, filter long, rows long, source string"
_BLOCK_BITS = 1 << 15  # of Spark's bitmaps
_PROBES = 7  # bits of a key in its block
_BITS_PER_KEY = 10
_LISTED = 200  # leaves that a scan is asked for by name
_SENT = 500_000  # keys that are sent to all tasks which read leaves


class Leaf(NamedTuple):
    depth: int
    prefix: int
    versions: tuple[int, ...] = ()
    filter: int | None = None
    rows: int = 0

    @property
    def name(self) -> str:
        return f"{self.depth}-{self.prefix}"


class GrowingState:
    """``keys`` identify a row of ``schema``; ``start`` leaves (a power of two, or the next one) are there at first."""

    def __init__(self, spark: SparkSession, base: str, schema: str, keys: Sequence[str], most_rows: int = 1_000_000, start: int = 1):
        self.spark, self.base, self.schema, self.keys = spark, base.rstrip("/"), schema, list(keys)
        self.most_rows, self.start = most_rows, start
        self.blocks = max(1, math.ceil(most_rows * _BITS_PER_KEY / _BLOCK_BITS))

    # The directory

    def _places(self, version: int) -> str:
        return f"{self.base}/places-{version:012d}"

    def newest(self) -> int | None:
        """The newest version with a directory, none for a table that is not there."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(place):
            return None
        names = [s.getPath().getName() for s in files.listStatus(place)]
        done = [n for n in names if n.startswith("places-") and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{n}/_SUCCESS"))]
        return max((int(re.sub(r"\D", "", n)) for n in done), default=None)

    def leaves(self, version: int) -> list[Leaf]:
        rows = self.spark.read.schema(_DIRECTORY).parquet(self._places(version)).collect()
        return [Leaf(r.depth, r.prefix, tuple(r.versions), r["filter"], r.rows) for r in rows]

    def _first_leaves(self) -> list[Leaf]:
        depth = max(0, math.ceil(math.log2(self.start)))
        return [Leaf(depth, p) for p in range(1 << depth)]

    def before(self, source: str | None) -> int:
        """The version to go on from. A batch of the same ``source`` as the newest version is that one tried again."""
        version = self.newest()
        if source is not None and self.spark.read.schema(_DIRECTORY).parquet(self._places(version)).first().source == source:
            return version - 1
        return version

    def _publish(self, leaves: list[Leaf], version: int, before: int | None, source: str | None = None) -> None:
        kinds = [("depth", pa.int32()), ("prefix", pa.int64()), ("versions", pa.list_(pa.int64())), ("filter", pa.int64()), ("rows", pa.int64()), ("source", pa.string())]
        rows = self._listed(kinds, [(x.depth, x.prefix, list(x.versions), x.filter, x.rows, source) for x in leaves])
        rows.coalesce(1).write.mode("overwrite").parquet(self._places(version))
        if before:
            self._forget(before - 1, before, version)

    def _forget(self, version: int, *kept: int) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self._places(version))
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return  # forgotten by an earlier try of this batch
        used = lambda v: {u for x in self.leaves(v) for u in (*x.versions, x.filter)}
        for v in used(version).difference(*map(used, kept)) - {None}:
            drop_folder(self.spark, f"{self.base}/state-{v:012d}")
            drop_folder(self.spark, f"{self.base}/filter-{v:012d}")
        drop_folder(self.spark, self._places(version))

    # Rows and their leaves

    def _listed(self, kinds: list[tuple[str, pa.DataType]], rows: Iterable[tuple]) -> DataFrame:
        """A list of the driver's as a table whose size Spark knows."""
        columns = list(zip(*rows)) or [()] * len(kinds)
        return self.spark.createDataFrame(pa.table({name: pa.array(c, kind) for (name, kind), c in zip(kinds, columns)}))

    def _hash(self) -> Column:
        return F.xxhash64(*self.keys)

    @staticmethod
    def _ending(value: Column, depth: Column) -> Column:
        return value.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), depth) - 1)

    def _placed(self, rows: DataFrame, leaves: list[Leaf], deeper: dict[Leaf, int] | None = None) -> DataFrame:
        """``rows`` with the name of their leaf, ``__leaf``; with ``deeper``, that of the part it is split into.

        A row tries the ending of its hash at each depth that leaves have; one of them is a leaf's.
        """
        kinds = [("__depth", pa.int32()), ("__prefix", pa.int64()), ("__to", pa.int32())]
        named = F.broadcast(self._listed(kinds, [(x.depth, x.prefix, x.depth + (deeper or {}).get(x, 0)) for x in leaves]))
        depths = F.array(*[F.lit(d) for d in sorted({x.depth for x in leaves})])
        tried = rows.withColumn("__hash", self._hash()).withColumn("__depth", F.explode(depths))
        tried = tried.withColumn("__prefix", self._ending(F.col("__hash"), F.col("__depth"))).join(named, ["__depth", "__prefix"])
        leaf = F.concat_ws("-", F.col("__to"), self._ending(F.col("__hash"), F.col("__to")))
        return tried.withColumn("__leaf", leaf).drop("__depth", "__prefix", "__to", "__hash")

    def _stored(self, kind: str, schema: str, places: Sequence[tuple[int, str]]) -> DataFrame:
        """The rows that folders of ``kind`` hold at these places, a version and a leaf's name each, with ``__leaf``."""
        names, folders = sorted({n for _, n in places}), sorted({f"{self.base}/{kind}-{v:012d}" for v, _ in places})
        if not places:
            return self.spark.createDataFrame([], StructType.fromDDL(f"{schema}, __leaf string"))
        rows = self.spark.read.schema(f"{schema}, __leaf string").parquet(*folders)
        if len(names) <= _LISTED:
            rows = rows.where(F.col("__leaf").isin(names))
        folder = F.substring_index(F.substring_index(F.col("_metadata.file_path"), "/", -2), "/", 1)
        version = F.substring_index(folder, "-", -1).cast("long")
        there = F.broadcast(self._listed([("__version", pa.int64()), ("__leaf", pa.string())], places))
        return rows.withColumn("__version", version).join(there, ["__version", "__leaf"], "left_semi").drop("__version")

    def _content(self, leaves: Sequence[Leaf]) -> DataFrame:
        return self._stored("state", self.schema, [(v, x.name) for x in leaves for v in x.versions]).drop("__leaf")

    def read(self, version: int) -> DataFrame:
        return self._content(self.leaves(version))

    def _write(self, placed: DataFrame, folder: str) -> dict[str, int]:
        """Write rows by leaf, the rows of one in one file; the rows each leaf got."""
        placed.repartition("__leaf").sortWithinPartitions("__leaf").write.mode("overwrite").parquet(folder)
        back = self.spark.read.schema(placed.schema).parquet(folder)
        return {r["__leaf"]: r["count"] for r in back.groupBy("__leaf").count().collect()}

    def _bits_more(self, rows: int) -> int:
        return max(0, math.ceil(math.log2(rows / self.most_rows))) if rows > self.most_rows else 0

    @staticmethod
    def _parts(leaf: Leaf, more: int) -> list[tuple[int, int]]:
        return [(leaf.depth + more, leaf.prefix + (k << leaf.depth)) for k in range(1 << more)]

    def create(self, rows: DataFrame, version: int = 0) -> None:
        """Version ``version`` holds these rows, in as many leaves as they need."""
        first = self._first_leaves()
        counts = {r["__leaf"]: r["count"] for r in self._placed(rows, first).groupBy("__leaf").count().collect()}
        more = {x: self._bits_more(counts.get(x.name, 0)) for x in first}
        self._publish(self._written(rows, first, more, version), version, None)

    def _written(self, rows: DataFrame, leaves: list[Leaf], more: dict[Leaf, int], version: int) -> list[Leaf]:
        got = self._write(self._placed(rows, leaves, more), f"{self.base}/state-{version:012d}")
        parts = [part for x in leaves for part in self._parts(x, more[x])]
        return [Leaf(d, p, (version,) if got.get(f"{d}-{p}") else (), None, got.get(f"{d}-{p}", 0)) for d, p in parts]

    def replace(self, batch: DataFrame, merge: Callable[[DataFrame], DataFrame], source: str | None = None) -> int:
        """``merge(old)`` is the new content of the leaves that the keys of ``batch`` fall into, and the next version's.

        Returns how many leaves were read. A leaf is split when its rows and those of the batch might pass the bound.
        ``source`` names the batch, so that one tried again does not count twice.
        """
        before = self.before(source)
        leaves = self.leaves(before)
        arrived = {r["__leaf"]: r["count"] for r in self._placed(batch, leaves).groupBy("__leaf").count().collect()}
        touched = [x for x in leaves if x.name in arrived]
        rest = [x for x in leaves if x.name not in arrived]
        if touched:
            more = {x: self._bits_more(x.rows + arrived[x.name]) for x in touched}
            rest += self._written(merge(self._content(touched)), touched, more, before + 1)
        self._publish(rest, before + 1, before, source)
        return len(touched)

    # Inserts of absent keys

    def _probes(self, rows: DataFrame) -> DataFrame:
        """``__block`` and the ``__bits`` of a key in that block of its leaf's filter.

        Bits are written out one by one: a lambda would hash the key again for each of them.
        """
        one, two = F.xxhash64(F.lit(1), *self.keys), F.xxhash64(F.lit(2), *self.keys)
        step = F.pmod(two, F.lit(_BLOCK_BITS // 2)) * 2 + 1
        bits = F.array(*[F.pmod(F.pmod(one, F.lit(_BLOCK_BITS)) + i * step, F.lit(_BLOCK_BITS)) for i in range(_PROBES)])
        return rows.withColumn("__block", F.pmod(F.shiftright(one, 20), F.lit(self.blocks)).cast("int")).withColumn("__bits", bits)

    def _filters(self, leaves: Sequence[Leaf]) -> DataFrame:
        return self._stored("filter", "__block int, filter binary", [(x.filter, x.name) for x in leaves if x.filter is not None])

    def _filter_of(self, placed: DataFrame) -> DataFrame:
        bits = self._probes(placed).select("__leaf", "__block", F.explode_outer("__bits").alias("__bit"))
        return bits.groupBy("__leaf", "__block").agg(F.bitmap_construct_agg("__bit").alias("filter"))

    def insert_absent(self, batch: DataFrame, order: Sequence[str], source: str | None = None) -> tuple[int, int, int]:
        """Insert the rows of ``batch`` whose key the table lacks, the first in ``order`` of each, as the next version.

        A key that its leaf's filter does not know is new. Only leaves with keys that it may know are read, and only
        their keys; the keys in question are few as a rule, and then go to where the leaves lie. Returns the numbers of
        leaves, of leaves read, and of rows inserted. ``source`` as in ``replace``.
        """
        before = self.before(source)
        after, leaves = before + 1, self.leaves(before)
        by_name = {x.name: x for x in leaves}
        placed = self._probes(self._placed(dedupe(batch, self.keys, order, "first"), leaves))
        asked = placed.join(self._filters(leaves), ["__leaf", "__block"], "left")
        has = F.expr("forall(__bits, b -> shiftright(cast(conv(hex(substring(filter, cast(b div 8 as int) + 1, 1)), 16, 10) as int), cast(b % 8 as int)) % 2 = 1)")
        asked = asked.withColumn("__maybe", F.coalesce(F.col("filter").isNotNull() & has, F.lit(False))).drop("filter", "__bits", "__block").persist()
        try:
            maybe = asked.where("__maybe")
            asked_of = {r["__leaf"]: r["count"] for r in maybe.groupBy("__leaf").count().collect()}
            read = [by_name[n] for n in asked_of]
            held = self._content(read).select(self.keys)
            if sum(asked_of.values()) <= _SENT:
                held = held.join(F.broadcast(maybe.select(self.keys)), self.keys, "left_semi")
            fresh = asked.where("NOT __maybe").unionByName(maybe.join(held, self.keys, "left_anti")).drop("__maybe").persist()
            got = {r["__leaf"]: r["count"] for r in fresh.groupBy("__leaf").count().collect()}
            grown = [by_name[n] for n in got]
            more = {x: self._bits_more(x.rows + got[x.name]) for x in grown}
            kept, split = [x for x in grown if not more[x]], [x for x in grown if more[x]]
            # a leaf that splits is written whole, in its parts, so that no task gets more than a part of it
            rows = fresh.drop("__leaf").unionByName(self._content(split), allowMissingColumns=True)
            written = self._write(self._placed(rows, leaves, more), f"{self.base}/state-{after:012d}")
            fresh.unpersist()
        finally:
            asked.unpersist()
        new = [x for x in leaves if x.name not in got]
        new += [Leaf(x.depth, x.prefix, (*x.versions, after), after, x.rows + got[x.name]) for x in kept]
        parts = [Leaf(d, p) for x in split for d, p in self._parts(x, more[x])]
        new += [x._replace(versions=(after,), filter=after, rows=written[x.name]) if written.get(x.name) else x for x in parts]
        if grown:
            added = self.spark.read.schema(f"{self.schema}, __leaf string").parquet(f"{self.base}/state-{after:012d}")
            filters = self._filter_of(added).unionByName(self._filters(kept))
            whole = filters.groupBy("__leaf", "__block").agg(F.bitmap_or_agg("filter").alias("filter"))
            whole.repartition("__leaf").sortWithinPartitions("__leaf").write.mode("overwrite").parquet(f"{self.base}/filter-{after:012d}")
        self._publish(new, after, before, source)
        return len(leaves), len(read), sum(got.values())

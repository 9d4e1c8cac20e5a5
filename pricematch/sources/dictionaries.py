"""Label, allow-list and counter dictionaries as DataFrames.

None carries a broadcast hint. The shipped ones are local relations and those
read from CSV have a file size, so Catalyst knows what they weigh and broadcasts
them only below its threshold; a dictionary that outgrew it would be shuffled.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pricematch import fixed_values as fixed

COLUMNS = {
    "labels": ["original", "canonical"],
    "allowed": ["bet"],
    "two_way": ["bet", "counter"],
    "three_way": ["bet", "counter1", "counter2"],
}


def _local(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    return spark.createDataFrame(
        pa.table({c: pa.array([r[i] for r in rows], pa.string()) for i, c in enumerate(columns)})
    )


def label_dictionary(spark: SparkSession) -> DataFrame:
    """(bookmaker, original, canonical) of every feed."""
    rows = [(b, o, c) for b, entries in fixed.LABELS.items() for o, c in entries]
    return _local(spark, rows, ["bookmaker", *COLUMNS["labels"]])


def allowed_labels(spark: SparkSession) -> DataFrame:
    return _local(spark, [(b,) for b in fixed.ALLOWED_LABELS], COLUMNS["allowed"])


def two_way_rows(edition: str) -> list[tuple[str, str]]:
    rows = list(fixed.TWO_WAY_COUNTERS)
    if edition == "corrected":
        rows = [r for r in rows if not r[0].startswith("U/O")]
        for line in fixed.CORRECTED_LINES:
            over, under = f"U/O {line} <> OVER {line}", f"U/O {line} <> UNDER {line}"
            rows += [(over, under), (under, over)]
    elif edition != "reference":
        raise ValueError(f"no edition {edition!r}")
    return rows


def two_way_counters(spark: SparkSession, edition: str = "reference") -> DataFrame:
    """(bet, counter).

    The ``reference`` edition's over/under keys lack the line that canonical
    labels end in, so they never match. ``corrected`` has live ones.
    """
    return _local(spark, two_way_rows(edition), COLUMNS["two_way"])


def three_way_counters(spark: SparkSession) -> DataFrame:
    """(bet, counter1, counter2)."""
    return _local(spark, fixed.THREE_WAY_COUNTERS, COLUMNS["three_way"])


def read_dictionary(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A headerless CSV dictionary; the last line of a repeated key wins, files by their path.

    A quote inside a quoted field is doubled.
    """
    columns = COLUMNS[kind]
    lines = spark.read.csv(path, schema=", ".join(f"{c} string" for c in columns), escape='"')
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    lines = lines.select(*columns, place.alias("line")).where(F.col(columns[0]).isNotNull())
    if kind == "allowed":
        return lines.select(*columns).distinct()
    entry = F.struct("line", *columns[1:])
    last = lines.select(columns[0], entry.alias("entry")).groupBy(columns[0]).agg(F.max("entry").alias("entry"))
    return last.select(columns[0], *[F.col(f"entry.{c}").alias(c) for c in columns[1:]])

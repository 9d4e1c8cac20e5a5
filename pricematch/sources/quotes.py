"""Stored quotes and landed feed files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pricematch.operators.filters import bets_in


def read_quotes(spark: SparkSession, path: str, bets: Iterable[str] | None = None) -> DataFrame:
    """The quotes table; a bet list is pushed down to the Parquet scan."""
    quotes = spark.read.parquet(path)
    return quotes if bets is None else bets_in(quotes, bets)


def jdbc_options(
    url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int | None = None,
    fetch: int = 10_000, **options: str,
) -> dict[str, str]:
    """Options of a database read: one task, or ``parts`` ranges of ``column`` between ``bounds``, a task each.

    Rows outside the bounds, or without a value, are in the first and the last range, so none is left out.
    """
    given = {"url": url, "dbtable": table, "fetchsize": str(fetch)} | options
    if column is None:
        return given
    if not bounds or not parts or bounds[0] > bounds[1]:
        raise ValueError("a partition column needs its bounds, in order, and a number of parts")
    return given | {"partitionColumn": column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(parts)}


def read_quotes_jdbc(
    spark: SparkSession, url: str, table: str, bets: Iterable[str] | None = None, **options
) -> DataFrame:
    """The quotes table in a database; the bet list becomes its WHERE clause. ``options`` as in ``jdbc_options``."""
    quotes = spark.read.format("jdbc").options(**jdbc_options(url, table, **options)).load()
    return quotes if bets is None else bets_in(quotes, bets)


def read_feed(spark: SparkSession, path: str, bookmaker: str, whole_file: bool = True) -> DataFrame:
    """Landed payloads as (bookmaker, source, ingest_seq, payload).

    ``ingest_seq`` (file path, place of the split in the file, row in the split) orders
    payloads as they lie in the files, files by their path.

    One document per file, or per line where ``whole_file`` is false: many small
    files cost more to list than to read, and lines can be split between tasks.
    """
    text = spark.read.text(path, wholetext=whole_file)
    return text.select(
        F.lit(bookmaker).alias("bookmaker"),
        F.col("_metadata.file_path").alias("source"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("ingest_seq"),
        F.col("value").alias("payload"),
    )


def name_tournaments(
    pages: DataFrame, tournaments: DataFrame, pattern: str, id_column: str = "tournament_id"
) -> DataFrame:
    """Give pages the tournament their file is named after.

    ``pattern`` finds the id in the page's ``source``; ``tournaments`` is what
    ``flatten_schedule`` gives, one row per id. A page of an unlisted tournament
    was never asked for, and is dropped. Of several names of an id the first by spelling is taken.
    """
    names = tournaments.select(F.col(id_column).cast("string").alias("__id"), "tournament")
    return (
        pages.withColumn("__id", F.regexp_extract("source", pattern, 1))
        .join(names.groupBy("__id").agg(F.min("tournament").alias("tournament")), "__id")
        .drop("__id")
    )

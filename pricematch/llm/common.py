"""Helpers the operators of this package share."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text: runs of anything but these six ASCII blanks.
BLANKS = r"[\x20\x09-\x0D]+"


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that driver and executors share.

    That is ``spark.checkpoint.dir``. Only a local session without the setting uses a
    temporary folder, as all its tasks run on this machine.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = os.path.join(tempfile.gettempdir(), f"pricematch-{spark.sparkContext.applicationId}")
    return f"{root.rstrip('/')}/llm/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: short lineage, and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where the cluster's search path does not have it."""
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or any("pricematch-package" in f for f in context.listFiles):
        return
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "pricematch-package"), "zip", root, "pricematch")
    context.addPyFile(made)


_HELD: dict[str, object] = {}


def held(name: str, make):
    """What ``make()`` gives, kept for later tasks of this worker process under ``name``.

    Only one operator's tables are kept at a time, so that stages that follow each other on the same
    workers do not add up their memory.
    """
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str = "text") -> Column:
    """The UTF-8 bytes of a text; a null one is empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def let(value: Column, body) -> Column:
    """``body(value)`` where ``value`` is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]

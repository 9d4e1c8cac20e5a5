"""Multi-party dialogues from each participant's side, with loss masks; built-in expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width

#: How a turn begins and ends.
OPEN, CLOSE, SYSTEM, NOBODY = "<|im_start|>", "<|im_end|>", "system", "unknown"


def header(speaker: Column, perspective: Column) -> Column:
    """The assistant is the perspective, the system stays itself, all others are users with a name."""
    said_by = F.when(speaker == perspective, "assistant").when(speaker == SYSTEM, SYSTEM).otherwise(F.concat(F.lit("user name="), speaker))
    return F.concat(F.lit(OPEN), said_by, F.lit("\n"))


def perspectives(turns: DataFrame) -> DataFrame:
    """For every participant of a conversation, the whole dialogue with that speaker as the assistant.

    ``conv_id, perspective, turn, speaker, segment, start, mask_start, mask_end``: a row for each turn and
    perspective. The rendered dialogue is the segments in order of ``start`` (code points); the loss mask is
    the union of the ranges [mask_start, mask_end), which cover text and end mark of the perspective's own
    turns and are null elsewhere. So a dialogue of any length is never gathered in one row.

    Rows are sorted over the whole cluster by conversation, perspective and turn; each slice of that order
    sums its own lengths, and a table with one row per slice and dialogue carries the sums over. A conversation
    with a third of all turns spreads over many slices.

    Participants are the distinct roles but ``system``. Null role: the speaker ``unknown``. Null text: empty.
    Null conversation: one more conversation. Null turns come first; turns with one number are ordered by
    speaker, then text; repeated rows all stay. A conversation without participants, or no rows: no rows. Other columns are
    not read.
    """
    said = turns.select(
        F.col("conv_id"), F.col("turn"), F.coalesce(F.col("role"), F.lit(NOBODY)).alias("speaker"), F.coalesce(F.col("text"), F.lit("")).alias("body"),
    )
    sides = said.filter(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("side_id"), F.col("speaker").alias("perspective")).distinct()
    seen = said.join(sides, said["conv_id"].eqNullSafe(sides["side_id"])).drop("side_id")
    order = ["conv_id", "perspective", "turn", "speaker", "body"]
    seen = seen.repartitionByRange(shuffle_width(turns.sparkSession), *order).withColumn("slice", F.spark_partition_id())
    head = header(F.col("speaker"), F.col("perspective"))
    seen = seen.withColumn("head", F.char_length(head)).withColumn("segment", F.concat(head, "body", F.lit(CLOSE + "\n")))
    size = F.char_length("segment").cast("long")
    by_slice = Window.partitionBy("slice", "conv_id", "perspective")
    here = F.sum(size).over(by_slice.orderBy("turn", "speaker", "body").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size
    seen = seen.withColumn("here", here)
    totals = seen.groupBy("conv_id", "perspective", "slice").agg(F.sum(size).alias("total"))
    before = F.sum("total").over(Window.partitionBy("conv_id", "perspective").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    # only dialogues of several slices have anything to carry over
    carried = totals.select(F.col("conv_id").alias("c_id"), F.col("perspective").alias("c_side"), F.col("slice").alias("c_slice"), before.alias("before")).filter("before > 0")
    on = seen["conv_id"].eqNullSafe(F.col("c_id")) & (seen["perspective"] == F.col("c_side")) & (seen["slice"] == F.col("c_slice"))
    out = seen.join(carried, on, "left").withColumn("start", F.col("here") + F.coalesce("before", F.lit(0).cast("long")))
    own = F.col("speaker") == F.col("perspective")
    return out.select(
        "conv_id", "perspective", "turn", "speaker", "segment", "start",
        F.when(own, F.col("start") + F.col("head")).alias("mask_start"),
        F.when(own, F.col("start") + size - 1).alias("mask_end"),
    )


PERSPECTIVES_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '{NOBODY}') AS speaker, coalesce(text, '') AS body FROM conversations
), sides AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> '{SYSTEM}'
), seen AS (
  SELECT said.*, perspective,
    '{OPEN}' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = '{SYSTEM}' THEN '{SYSTEM}' ELSE 'user name=' || speaker END || chr(10) AS head
  FROM said JOIN sides ON said.conv_id IS NOT DISTINCT FROM sides.conv_id
), built AS (
  SELECT *, head || body || '{CLOSE}' || chr(10) AS segment FROM seen
), placed AS (
  SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body ROWS UNBOUNDED PRECEDING) - length(segment) AS BIGINT) AS start
  FROM built
)
SELECT conv_id, perspective, turn, speaker, segment, start,
  CASE WHEN speaker = perspective THEN start + length(head) END AS mask_start,
  CASE WHEN speaker = perspective THEN start + length(segment) - 1 END AS mask_end
FROM placed
"""

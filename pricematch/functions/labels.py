"""Market labels: ``type [spread] <> outcome``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pricematch.fixed_values import LABEL_SEPARATOR
from pricematch.functions.rounding import round_half_even


def compose_label(kind: Column, outcome: Column, spread: Column | None = None) -> Column:
    """Null when type or outcome is missing; a null spread is left out."""
    if spread is not None:
        kind = F.when(spread.isNull(), kind).otherwise(F.concat(kind, F.lit(" "), spread))
    return F.concat(kind, F.lit(LABEL_SEPARATOR), outcome)


def strip_label_type(label: Column) -> Column:
    """The outcome alone; a label without a separator is left as it is."""
    at = F.instr(label, LABEL_SEPARATOR)
    first_line = ~F.contains(F.left(label, at - 1), F.lit("\n"))
    return F.when((at > 0) & first_line, F.substr(label, at + len(LABEL_SEPARATOR))).otherwise(label)


def line_suffix(line: Column) -> Column:
    """A line in thousandths as text with one decimal: 2500 gives ``2.5``."""
    return round_half_even(line.cast("double") / F.lit(1000.0), 1).cast("string")

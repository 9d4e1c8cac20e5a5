"""Statistics of whole texts as SQL expressions alone: nothing is exploded or shuffled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import BLANKS, let

SYMBOLS = "#*$%&|<>"
_BLANK_CHARS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Runs of anything but the six ASCII blanks; none for a blank text."""
    inner = F.regexp_replace(text, f"^{BLANKS}|{BLANKS}$", "")
    return F.when(inner != "", F.split(inner, BLANKS)).otherwise(F.array().cast("array<string>"))


def chars_of(text: Column, chars: str) -> Column:
    """How many characters of the text are among ``chars``."""
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.regexp_replace(line, BLANKS, "") != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def repeated_words(hashes: Column, said: Column, window: int = 3) -> Column:
    """How many words lie in a window of ``window`` words found twice or more in the text.

    ``hashes`` are the 64-bit hashes of the words ``said``. A window's hash, shortened by as many bits as positions
    need, is put before its position in one long. Sorted as plain longs, equal windows are neighbours; those with
    an equal neighbour give back their positions. Of these the windows themselves are sorted and compared, so that
    windows that share a hash only do not count. The words the others cover are counted once.
    """
    n = F.size(hashes)
    left = lambda x, bits: F.call_function("shiftleft", x, bits)
    key = lambda x, bits: F.call_function("shiftright", x, bits)

    def packed(h: Column, bits: Column) -> Column:
        at = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)])
        return F.transform(F.slice(h, 1, F.size(h) - (window - 1)), lambda _, i: left(at(i), bits).bitwiseOR(i.cast("long")))

    def repeats(rows: Column, bits: Column) -> Column:
        like = lambda x, i: F.coalesce(key(x, bits) == key(F.get(rows, i), bits), F.lit(False))
        found = F.filter(rows, lambda x, i: like(x, i + 1) | like(x, i - 1))
        return F.transform(found, lambda x: x - left(key(x, bits), bits))

    def equal(at: Column) -> Column:
        parts = [f"w{k}" for k in range(window)]
        spelled = F.transform(at, lambda x: F.struct(
            *[F.get(said, (x + k).cast("int")).alias(p) for k, p in enumerate(parts)], x.alias("at")))
        like = lambda x, y: F.coalesce(reduce(lambda a, b: a & b, [x[p] == y[p] for p in parts]), F.lit(False))
        same = lambda rows: F.filter(rows, lambda x, i: like(x, F.get(rows, i + 1)) | like(x, F.get(rows, i - 1)))
        return F.transform(let(F.sort_array(spelled), same), lambda x: x["at"])

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
        add = lambda s, x: F.struct((s["n"] + (x + window) - F.greatest(s["end"], x)).alias("n"), (x + window).alias("end"))
        return F.aggregate(F.sort_array(at), start, add, lambda s: s["n"])

    bits = F.coalesce(F.ceil(F.log2(n.cast("double") + 1)).cast("int"), F.lit(0))
    counted = let(bits, lambda b: let(F.sort_array(packed(hashes, b)), lambda rows: covered(equal(repeats(rows, b)))))
    return F.when(n > window, counted).otherwise(F.lit(0).cast("long"))

"""Event names."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# A word character is a letter or digit of any script, or an underscore.
_WORD = r"[\p{L}\p{N}_]"
_SHORT_WORD = rf"(?<!{_WORD}){_WORD}{{1,2}}(?!{_WORD})"
# The same in ASCII text: a long word is taken whole and put back, so that the rest only meets whole short ones.
_SHORT_ASCII_WORD = r"(\w{3,}+)|\w{1,2}"
_PUNCTUATION = r"[.()\[\]?!]"


def clean_name(name: Column) -> Column:
    """Remove ``.()[]?!``, then every word of one or two characters."""
    bare = F.regexp_replace(name, _PUNCTUATION, "")
    is_ascii = F.octet_length(name) == F.char_length(name)
    return F.when(is_ascii, F.regexp_replace(bare, _SHORT_ASCII_WORD, "$1")).otherwise(F.regexp_replace(bare, _SHORT_WORD, ""))


def _tidy(name: Column) -> Column:
    """Trimmed, single-spaced, upper case."""
    trimmed = F.regexp_replace(name, r"(?U)^\s+|\s+$", "")
    return F.upper(F.regexp_replace(trimmed, " +", " "))


def normalise_event(name: Column, splitter: str) -> Column:
    """Comparable event name ``HOME - AWAY``; null where the splitter is missing.

    Words go before the split, as the splitter may sit next to a short word. The cleaned name is an item of its own:
    used twice, it is computed once, inside a lambda too.
    """
    def parted(clean: Column) -> Column:
        at = F.instr(clean, splitter)
        first, second = F.left(clean, at - 1), F.substr(clean, at + len(splitter))
        return clean if splitter == " - " else F.concat(first, F.lit(" - "), second)

    known = lambda clean: F.when(F.contains(clean, F.lit(splitter)), _tidy(parted(clean)))
    return F.transform(F.array(clean_name(name)), known)[0]


def normalise_split_event(name: Column, splitter: str) -> Column:
    """As ``normalise_event``, splitting first and cleaning each side after."""
    sides = F.split(name, re.escape(splitter), 2)
    joined = F.concat(clean_name(F.get(sides, 0)), F.lit(" - "), clean_name(F.get(sides, 1)))
    return _tidy(joined)

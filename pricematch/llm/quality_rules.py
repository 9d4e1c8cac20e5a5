"""Quality rules: text statistics, and a decision list that is learned on them and runs as SQL expressions."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, let
from .text_stats import SYMBOLS, chars_of, duplicate_lines, repeated_words, words

FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "capital_share", "digit_share", "mark_share")
_CAPITALS, _DIGITS, _MARKS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!?"


def with_stats(docs: DataFrame, text: Column) -> DataFrame:
    """The rows with a column ``__s`` of counts over the whole text."""
    text = F.coalesce(text.cast("string"), F.lit(""))

    def stats(text: Column) -> Column:
        bare = F.regexp_replace(text, BLANKS, "")
        counts = lambda w, h, b: F.struct(
            F.size(h).cast("long").alias("n_words"), F.char_length(b).cast("long").alias("word_chars"),
            chars_of(b, SYMBOLS).cast("long").alias("n_symbols"), duplicate_lines(text).cast("long").alias("n_dup_lines"),
            repeated_words(h, w).alias("n_repeat_words"), (F.size(F.split(text, "\n"))).cast("long").alias("n_lines"),
            chars_of(b, _CAPITALS).cast("long").alias("n_capitals"), chars_of(b, _DIGITS).cast("long").alias("n_digits"), chars_of(b, _MARKS).cast("long").alias("n_marks"),
        )
        hashes = lambda w: F.transform(w, lambda x: F.xxhash64(x))
        return let(words(text), lambda w: let(hashes(w), lambda h: let(bare, lambda b: counts(w, h, b))))

    return docs.withColumn("__s", let(text, stats))


def features(s: Column) -> dict[str, Column]:
    """Shares and means, 0 where there is nothing to divide by."""
    share = lambda a, b: F.coalesce(F.try_divide(s[a].cast("double"), s[b].cast("double")), F.lit(0.0))
    columns = (
        s["n_words"].cast("double"), share("word_chars", "n_words"), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"), share("n_capitals", "word_chars"), share("n_digits", "word_chars"), share("n_marks", "word_chars"),
    )
    return dict(zip(FEATURES, columns, strict=True))


@dataclass
class Rule:
    """A conjunction of (feature, at least or below, threshold)."""

    tests: list[tuple[str, str, float]]
    good: int = 0
    bad: int = 0

    def holds(self, row: dict[str, float]) -> bool:
        return all(row[f] >= x if op == ">=" else row[f] < x for f, op, x in self.tests)

    def column(self, of: dict[str, Column]) -> Column:
        out = F.lit(True)
        for f, op, x in self.tests:
            out = out & (of[f] >= F.lit(x) if op == ">=" else of[f] < F.lit(x))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{f} {op} {x:.6g}" for f, op, x in self.tests)


@dataclass
class DecisionList:
    """Rules in order; the first that holds rejects the text, else it is kept."""

    rules: list[Rule] = field(default_factory=list)

    def rejecting_rule(self, of: dict[str, Column]) -> Column:
        """The number, from 1, of the first rule that holds; null if none does."""
        out = None
        for k, rule in enumerate(self.rules, 1):
            out = F.when(rule.column(of), k) if out is None else out.when(rule.column(of), k)
        return F.lit(None).cast("int") if out is None else out


def _tests(rows: list[dict], thresholds: int) -> list[tuple[str, str, float]]:
    """Candidate tests: cuts between neighbouring quantiles of each feature."""
    out = []
    for f in FEATURES:
        values = sorted({r[f] for r in rows})
        step = max(1, len(values) // thresholds)
        out += [(f, op, (a + b) / 2) for a, b in zip(values[::step], values[step::step]) for op in (">=", "<")]
    return out


def learn(rows: list[dict], bad: list[bool], precision: float = 0.95, least: int = 4, longest: int = 3, most: int = 12, thresholds: int = 48) -> DecisionList:
    """Sequential covering. Two thirds of the rows grow a rule, a test at a time by information gain, until
    it covers bad texts alone or has ``longest`` tests; the last third prunes tests from its end while that
    does not lower (bad - good) / covered. A rule is accepted if it covers ``least`` bad texts and is
    ``precision`` right on all rows and on the pruning third; its texts leave, and the next is grown. The
    first rule that fails ends the list. Rows are taken in the given order, so the list is the same each time.
    """
    out = DecisionList()
    left = list(range(len(rows)))
    while len(out.rules) < most:
        grow, prune = [i for i in left if i % 3], [i for i in left if i % 3 == 0]
        rule, covered = Rule([]), grow
        for _ in range(longest):
            p0 = sum(bad[i] for i in covered)
            if not p0 or p0 == len(covered):
                break
            best, gain = None, 1e-9
            for test in _tests([rows[i] for i in covered], thresholds):
                f, op, x = test
                p = n = 0
                for i in covered:
                    if (rows[i][f] >= x) == (op == ">="):
                        p, n = p + bad[i], n + (not bad[i])
                if p and (now := p * (log2(p / (p + n)) - log2(p0 / len(covered)))) > gain:
                    best, gain = test, now
            if best is None:
                break
            rule.tests.append(best)
            covered = [i for i in covered if Rule([best]).holds(rows[i])]
        if not rule.tests:
            break

        def worth(tests: list) -> tuple[float, int]:
            hit = [bad[i] for i in prune if Rule(tests).holds(rows[i])]
            return ((2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0, -len(tests))

        rule.tests = max((rule.tests[:k] for k in range(len(rule.tests), 0, -1)), key=worth)
        hit, held = [i for i in left if rule.holds(rows[i])], [i for i in prune if rule.holds(rows[i])]
        rule.bad = sum(bad[i] for i in hit)
        rule.good = len(hit) - rule.bad
        if rule.bad < least or rule.bad < precision * len(hit) or sum(bad[i] for i in held) < precision * len(held):
            break
        out.rules.append(rule)
        left = [i for i in left if not rule.holds(rows[i])]
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> DecisionList:
    """Learn from at most ``sample`` labelled documents (``quality`` 0 or 1), by the order of a hash of the id.

    Documents with two different labels, and null ids or labels, teach nothing. No labels: an empty list.
    """
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("__q"), F.max("quality").alias("__top"))
    known = known.filter("__q = __top").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("__id"), "__q")
    chosen = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).join(F.broadcast(known), "__id")
    chosen = with_stats(chosen, F.col("__t"))
    found = chosen.select("__id", "__q", *(c.alias(f) for f, c in features(F.col("__s")).items()))
    found = found.orderBy(F.xxhash64("__id"), "__id", *FEATURES).limit(sample).collect()
    return learn([r.asDict() for r in found], [r["__q"] == 0 for r in found])


def judged(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """The rows with ``__s`` (counts), ``__base`` (base rules fail) and ``__rule`` (first learned rule that rejects)."""
    out = with_stats(docs, F.col(text_col))
    s = F.col("__s")
    out = out.withColumn("__base", (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"]))
    return out.withColumn("__rule", rules.rejecting_rule(features(s)))


def score(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the counts, ``base_failed, rule, kept`` for each row; a narrow plan of built-in expressions.

    Base rules reject under 50 words, or more than half of the words in repeated 3-word windows; the learned
    list rejects by its first rule that holds.

    Null or blank text: all counts 0, base rules fail. Null and repeated ids: a row each. Very long texts are
    counted whole. No rows: none. Other columns are not read.
    """
    rows = judged(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__t")), rules, "__t")
    counts = [F.col("__s")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return rows.select("doc_id", *counts, F.col("__base").alias("base_failed"), F.col("__rule").alias("rule"), (~F.col("__base") & F.col("__rule").isNull()).alias("kept"))


def keep_good(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """The rows, with their own columns, that neither base rules nor the list reject."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("__t"))
    return judged(rows, rules, "__t").filter(~F.col("__base") & F.col("__rule").isNull()).select("row.*")

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pricematch.functions import dates, labels, names, odds, scoring
from pricematch.functions.rounding import round_half_even


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def each(spark, values, ddl, fn):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {ddl}")
    return [r["v"] for r in frame.select("i", fn(F.col("x")).alias("v")).orderBy("i").collect()]


def test_odds_text(spark):
    given = ["1.85", "1.855", "1.865", "5/2", "10/11", "1/8", "Evens", None, " 1.85 ",
             "abc", "", "5/0", "1/2/3", "evens", "1.01499999999999", "1.016"]
    want = ["1.85", "1.86", "1.86", "3.50", "1.91", "1.12", "2.00", "1.00", "1.85",
            None, None, None, None, None, "1.01", "1.02"]
    got = each(spark, given, "string", odds.normalise_odds)
    assert got == [None if w is None else Decimal(w) for w in want]


def test_half_up_rounding_would_differ(spark):
    got = one(spark, F.round(F.lit("0.125").cast("decimal(20,10)"), 2) + 1)
    assert got == Decimal("1.13")


def test_every_small_fraction(spark):
    pairs = [(n, d) for n in range(1, 60) for d in range(1, 60)]
    got = each(spark, [f"{n}/{d}" for n, d in pairs], "string", odds.normalise_odds)
    assert got == [round(Decimal(n) / Decimal(d), 2) + 1 for n, d in pairs]


def test_numeric_odds(spark):
    given = [1.855, 1.865, 2.0, 2.675, None]
    got = each(spark, given, "double", odds.normalise_numeric_odds)
    assert got == [Decimal(v) for v in ("1.85", "1.86", "2.00", "2.67", "1.00")]


def test_cents(spark):
    assert each(spark, [185, 1855, 100], "bigint", odds.odds_from_cents) == [
        Decimal("1.85"), Decimal("18.55"), Decimal("1.00")]


def test_rounding_matches_python(spark):
    values = [i / 1000 for i in range(-3000, 3000)] + [i / 8 for i in range(-400, 400)]
    values += [2.675, 1.005, 1e13 + 0.125, 5e14 + 0.125, 0.0]
    got = each(spark, values, "double", round_half_even)
    assert got[:-2] == [round(v, 2) for v in values[:-2]]


NAMES = [
    ("AC Milan - Inter", " - ", "MILAN - INTER"),
    ("Juventus FC - AC Milan", " - ", "JUVENTUS - MILAN"),
    ("Juventus-Napoli", "-", "JUVENTUS - NAPOLI"),
    ("Schalke 04 - 1. FC Köln", " - ", "SCHALKE - KÖLN"),
    ("København - Malmö FF", " - ", "KØBENHAVN - MALMÖ"),
    ("Ås IL - Straße (U19)", " - ", "- STRASSE U19"),
    ("U.S. Lecce-F.C. Bari", "-", "LECCE - BARI"),
    ("Paris Saint-Germain-Lyon", "-", "PARIS SAINT - GERMAIN-LYON"),
    ("AC - Roma", " - ", "- ROMA"),
    ("Vincente Serie A", " - ", None),
]


@pytest.mark.parametrize("name,splitter,want", NAMES)
def test_event_names(spark, name, splitter, want):
    assert one(spark, names.normalise_event(F.lit(name), splitter)) == want


def test_html_event_name_splits_first(spark):
    assert one(spark, names.normalise_split_event(F.lit("AC Milan vs FC Inter"), " vs ")) == "MILAN - INTER"
    # Cleaning first would eat the two-letter splitter.
    assert one(spark, names.normalise_event(F.lit("AC Milan vs FC Inter"), " vs ")) is None


def test_labels(spark):
    given = ["1X2 <> 1", "GOAL/NOGOAL <> NOGOAL", "U/O 2.5 <> OVER 2.5", "NoSep", "A <> B <> C"]
    assert each(spark, given, "string", labels.strip_label_type) == [
        "1", "NOGOAL", "OVER 2.5", "NoSep", "B <> C"]
    assert one(spark, labels.compose_label(F.lit("U/O"), F.lit("OVER"), F.lit("2.5"))) == "U/O 2.5 <> OVER"
    assert one(spark, labels.compose_label(F.lit("1X2"), F.lit("X"), F.lit(None).cast("string"))) == "1X2 <> X"
    assert one(spark, labels.compose_label(F.lit("1X2"), F.lit(None).cast("string"))) is None
    assert each(spark, [2500, 10000, 250, 2250], "bigint", labels.line_suffix) == [
        str(round(v / 1000, 1)) for v in (2500, 10000, 250, 2250)]


def test_dates(spark):
    assert one(spark, dates.parse_epoch_date(F.lit("/Date(1616360400000+0100)/"))) == datetime(2021, 3, 21, 21)
    assert one(spark, dates.parse_epoch_date(F.lit("/Date(1616360400000+0100)/"), "Europe/Rome")) == datetime(2021, 3, 21, 22)
    assert one(spark, dates.parse_epoch_date(F.lit("junk"))) is None
    assert one(spark, dates.parse_iso_date(F.lit("2021-03-21T19:45:00Z"))) == datetime(2021, 3, 21, 21, 45)
    assert one(spark, dates.parse_iso_date(F.lit("2021-01-21T19:45:00Z"), "Europe/Rome")) == datetime(2021, 1, 21, 20, 45)
    assert one(spark, dates.parse_iso_date(F.lit("junk"))) is None


def test_italian_dates(spark):
    run = datetime(2021, 5, 6, 7, 8, 9)
    given = ["27 Apr 2021 12:00", "28 ago 10:05", "23:00", "31 Feb 2021 12:00", "nonsense"]
    got = each(spark, given, "string", lambda c: dates.parse_italian_date(c, run))
    assert got == [datetime(2021, 4, 27, 12), datetime(2021, 8, 28, 10, 5), datetime(2021, 5, 6, 23), None, None]


RTP = [
    ((2.0, 2.0), 100.0, 100.0),
    ((3.0, 1.5), 100.0, 100.0),
    ((1.5, 3.0), 100.0, 100.0),
    ((2.1, 2.1), 105.0, 110.0),
    ((3.2, 1.4), 97.39, 91.43),
    ((1.01, 1.0), 50.25, 0.0),
    ((3.0, 3.0, 3.0), 100.0, 100.0),
    ((2.5, 3.4, 3.1), 98.36, 95.83),
    ((2.0, 4.0, 4.0), 100.0, 100.0),
]


@pytest.mark.parametrize("prices,harmonic,hedge", RTP)
def test_rtp(spark, prices, harmonic, hedge):
    cols = [F.lit(p) for p in prices]
    assert one(spark, scoring.rtp_harmonic(*cols)) == harmonic
    assert one(spark, scoring.rtp_hedge(*cols)) == hedge


def test_rtp_grid_matches_python(spark):
    grid = [1 + i * 0.07 for i in range(57)]
    frame = spark.createDataFrame([(a, b) for a in grid for b in grid], "a double, b double")
    rows = frame.select("a", "b", scoring.rtp_hedge(F.col("a"), F.col("b")).alias("h"),
                        scoring.rtp_harmonic(F.col("a"), F.col("b")).alias("m")).collect()
    assert [r["h"] for r in rows] == [round((r["a"] * (1.0 - 1.0 / r["b"])) * 100, 2) for r in rows]
    assert [r["m"] for r in rows] == [round((r["a"] * r["b"]) / (r["a"] + r["b"]) * 100, 2) for r in rows]


def test_rtp_zero_price_is_null(spark):
    assert one(spark, scoring.rtp_hedge(F.lit(2.0), F.lit(0.0))) is None


def test_plain_prices_and_small_fractions_are_as_any_other(spark):
    texts = [f"{a}{b}" for a in ("", "-", "+", " ", "0", "7", "1234567", "12345678", "123456789") for b in ("", ".", ".5", ".05", ".005", ".015", "/", "/0", "/8", "/16", "/9999", "/10000", "/-2", "\n", "e1", "E-1", "/1/2")]
    assert each(spark, texts, "string", odds.normalise_odds) == each(spark, texts, "string", odds._any_odds)
    numbers = each(spark, texts, "string", lambda x: round_half_even(x.try_cast("double")).try_cast("decimal(10,2)"))
    assert each(spark, texts, "string", odds.normalise_numeric_odds) == numbers


def test_names_and_labels_take_few_patterns(spark):
    frame = spark.createDataFrame([("FC Home1 - A. Away2",)], "x string")
    shown = frame.select(names.normalise_event(F.col("x"), " - ").alias("n"), labels.strip_label_type(F.col("x")).alias("l"))._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("regexp_replace(") == 6  # two ways to clean, in ASCII and not, and two to tidy


def test_clean_name_in_any_script(spark):
    given = ["ab c def", "a.b.c d", "é è été", "中 中国 中国人", "x_1 _ __ ___", "𝒳1 ab", "", None, "a", "abc?"]
    plain = each(spark, given, "string", lambda x: F.regexp_replace(F.regexp_replace(x, names._PUNCTUATION, ""), names._SHORT_WORD, ""))
    assert each(spark, given, "string", names.clean_name) == plain


def test_label_without_its_type(spark):
    given = ["A <> B", "A <> B <> C", "A", " <> B", "A\nB <> C", "A <> B\n", "A\rB <> C", "", None]
    assert each(spark, given, "string", labels.strip_label_type) == ["B", "B <> C", "A", "B", "A\nB <> C", "B\n", "C", "", None]

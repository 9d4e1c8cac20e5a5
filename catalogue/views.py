"""The given tables seen as quotes, and the same views as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pricematch.fixed_values import THREE_WAY_COUNTERS, TWO_WAY_COUNTERS

# Line numbers stand for selections; line 7 is one that no market has.
SELECTIONS = [
    "1X2 <> 1",
    "1X2 <> X",
    "1X2 <> 2",
    "DOPPIA CHANCE IN <> 1X",
    "DOPPIA CHANCE IN/OUT <> 12",
    "DOPPIA CHANCE OUT <> X2",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")



def spread(df: DataFrame, key: str) -> DataFrame:
    """Give heavy work per row to all cores.

    Rows are dealt by their key to as many tasks as shuffles have, whatever the
    files are like.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def days_after(day: str, days: Column) -> Column:
    """Midnight a number of days after a day."""
    return F.date_add(F.lit(day).cast("date"), days.cast("int")).cast("timestamp_ntz")


def choose(key: Column, values: list, other: Column) -> Column:
    out = None
    for k, v in values:
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(other)


def sql_values(rows: list[tuple]) -> str:
    text = lambda v: "'" + str(v).replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(text(v) for v in r) + ")" for r in rows)


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as quotes on parts: one row per (bookmaker, id, bet), at its lowest price.

    However many lines a part has, the aggregate keeps a row per bookmaker and
    selection of it, and does so before its shuffle. Numbers are what it shuffles;
    names are put on after.
    """
    line = F.col("l_linenumber")
    lowest = (
        table(spark, sf_dir, "lineitem")
        .select(
            (F.col("l_suppkey") % 7).alias("vendor"),
            F.col("l_partkey").alias("part"),
            F.when(line.between(1, len(SELECTIONS)), line).otherwise(0).alias("line"),
            (F.lit(1.0) + F.col("l_quantity") / 25).cast("decimal(10,2)").alias("odd"),
        )
        .groupBy("vendor", "part", "line")
        .agg(F.min("odd").alias("betOdd"))
    )
    bet = choose(F.col("line"), [(i, F.lit(s)) for i, s in enumerate(SELECTIONS, 1)], F.lit("OTHER"))
    return lowest.select(
        F.concat(F.lit("B"), F.col("vendor")).alias("bookmaker"),
        F.concat(F.lit("T"), F.col("part") % 50).alias("tournament"),
        F.col("part").alias("betRadarID"),
        F.concat(F.lit("EVENT "), F.col("part")).alias("event"),
        days_after("2021-03-01", F.col("part") % 365).alias("date"),
        bet.alias("bet"),
        "betOdd",
    )


_LINE_SQL = """
SELECT 'B' || (l_suppkey % 7) AS bookmaker, l_partkey AS part,
  CASE l_linenumber {cases} ELSE 'OTHER' END AS bet,
  CAST(1 + l_quantity / 25 AS DECIMAL(10,2)) AS odd
FROM lineitem""".format(
    cases=" ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SELECTIONS, 1))
)

QUOTES_SQL = f"""
q AS (SELECT bookmaker, 'T' || (part % 50) AS tournament, part AS "betRadarID",
  'EVENT ' || part AS event,
  CAST(DATE '2021-03-01' + CAST(part % 365 AS INTEGER) AS TIMESTAMP) AS date,
  bet, min(odd) AS "betOdd"
  FROM ({_LINE_SQL}) GROUP BY bookmaker, part, bet)"""


def loose_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``quotes``, but B0 has no ids, B1 names its events in its own way, and B2 has them a day later."""
    mine = F.col("bookmaker")
    return quotes(spark, sf_dir).withColumns(
        {
            "betRadarID": F.when(mine == "B0", F.lit(-1).cast("bigint")).otherwise(F.col("betRadarID")),
            "date": F.when(mine == "B2", F.col("date") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("date")),
            "event": F.when(mine == "B1", F.concat(F.lit("B1 "), F.col("event"))).otherwise(F.col("event")),
        }
    )


LOOSE_SQL = QUOTES_SQL + """,
e AS (SELECT bookmaker, tournament,
  CASE WHEN bookmaker = 'B0' THEN -1 ELSE "betRadarID" END AS "betRadarID",
  CASE WHEN bookmaker = 'B1' THEN 'B1 ' || event ELSE event END AS event,
  CASE WHEN bookmaker = 'B2' THEN date + INTERVAL 1 DAY ELSE date END AS date, bet, "betOdd" FROM q)"""

COUNTERS2_SQL = f"c2(bet, counter) AS ({sql_values(TWO_WAY_COUNTERS)})"
COUNTERS3_SQL = f"c3(bet, counter1, counter2) AS ({sql_values(THREE_WAY_COUNTERS)})"


def sql_strip(column: str) -> str:
    """Text after the first separator, or all of it."""
    return (
        f"CASE WHEN strpos({column}, ' <> ') > 0 "
        f"THEN substr({column}, strpos({column}, ' <> ') + 4) ELSE {column} END"
    )


def sql_round2(x: str) -> str:
    """Half-even rounding of a double column on its exact value, to two decimals."""
    t = f"({x} * 200::DOUBLE)"
    wide = f"({x} * 134217729::DOUBLE)"
    high = f"({wide} - ({wide} - {x}))"
    err = f"(({high} * 200::DOUBLE - {t}) + ({x} - {high}) * 200::DOUBLE)"
    steps = f"(floor({t}) - CASE WHEN {t} = floor({t}) AND {err} < 0 THEN 1 ELSE 0 END)"
    half = f"floor({steps} / 2::DOUBLE)"
    return (
        f"(({half} + CASE WHEN {steps} - 2 * {half} = 0 THEN 0 "
        f"WHEN {t} = {steps} AND {err} = 0 THEN {half} - 2 * floor({half} / 2::DOUBLE) "
        f"ELSE 1 END) / 100::DOUBLE)"
    )


def sql_rounded(source: str, raw: str = "raw", out: str = '"RTP"') -> str:
    """The rows of a table or subquery with ``sql_round2`` of a column as ``out``, step by step: each part of the
    rounding is worked out once."""
    steps = f"SELECT *, {raw} * 200::DOUBLE AS t_, {raw} * 134217729::DOUBLE AS wide_ FROM {source}"
    steps = f"SELECT *, wide_ - (wide_ - {raw}) AS high_ FROM ({steps})"
    steps = f"SELECT *, (high_ * 200::DOUBLE - t_) + ({raw} - high_) * 200::DOUBLE AS err_, floor(t_) AS low_ FROM ({steps})"
    steps = f"SELECT *, low_ - CASE WHEN t_ = low_ AND err_ < 0 THEN 1 ELSE 0 END AS steps_ FROM ({steps})"
    steps = f"SELECT *, floor(steps_ / 2::DOUBLE) AS half_ FROM ({steps})"
    up = ("CASE WHEN steps_ - 2 * half_ = 0 THEN 0 WHEN t_ = steps_ AND err_ = 0 "
          "THEN half_ - 2 * floor(half_ / 2::DOUBLE) ELSE 1 END")
    return f"SELECT * EXCLUDE (t_, wide_, high_, err_, low_, steps_, half_), (half_ + {up}) / 100::DOUBLE AS {out} FROM ({steps})"


def doubles(df: DataFrame, *columns: str) -> DataFrame:
    """Decimals as doubles, the form in which results are compared."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def naive_millis(ts: Column) -> Column:
    """Milliseconds since 1970 on the clock of a zone-less time."""
    seconds = F.extract(F.lit("SECONDS"), ts)
    return (
        F.unix_date(F.to_date(ts)).cast("bigint") * 86_400_000
        + F.hour(ts) * 3_600_000
        + F.minute(ts) * 60_000
        + F.floor(seconds * 1000).cast("bigint")
    )


def clock_instant(ts: Column) -> Column:
    """The instant at which a clock on UTC shows a zone-less time."""
    micros = F.floor(F.extract(F.lit("SECONDS"), ts) * 1_000_000).cast("bigint") % 1_000
    return F.timestamp_micros(naive_millis(ts) * 1_000 + micros)


def clock_time(instant: Column) -> Column:
    """What a clock on UTC shows at an instant."""
    seconds = (F.unix_micros(instant).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def iso_text(ts: Column) -> Column:
    return F.concat(F.replace(ts.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))

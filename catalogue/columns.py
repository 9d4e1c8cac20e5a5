"""Scalar functions and filters over whole tables."""

from __future__ import annotations

from datetime import datetime

from catalogue.views import choose, iso_text, naive_millis, spread, sql_strip, sql_values, table
from pricematch.fixed_values import (
    ALLOWED_LABELS, EXCLUDED_TYPE_WORDS, ITALIAN_MONTHS, LABELS, NOISE_PATTERNS,
)
from pricematch.functions import dates, labels, names, odds
from pricematch.operators import filters, normalise, shape
from pricematch.sinks.merge import assert_unique, duplicate_keys
from pricematch.sources.dictionaries import allowed_labels, label_dictionary
from pricematch.sources.html import extract_links
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

RUN = datetime(2024, 1, 15, 12)


def _odds_text() -> Column:
    n, d = F.col("event_id") % 97 + 1, F.col("user_id") % 41
    mils = F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0")
    return choose(
        F.col("event_id") % 6,
        [
            (0, F.concat(n.cast("string"), F.lit("/"), (d + 1).cast("string"))),
            (1, F.lit("Evens")),
            (2, F.lit(None).cast("string")),
            (3, F.concat((F.col("event_id") % 9 + 1).cast("string"), F.lit("."), mils)),
            (4, F.concat(n.cast("string"), F.lit("/"), d.cast("string"))),
        ],
        F.concat(F.lit("odd "), n.cast("string")),
    )


def odds_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", _odds_text().alias("odd"))
    return events.withColumn("price", odds.normalise_odds(F.col("odd")).cast("double"))


def odds_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", odds.normalise_numeric_odds(F.col("p_retailprice")).cast("double").alias("price"))


def cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    hundredths = F.round(F.col("p_retailprice") * 100).cast("bigint")
    return table(spark, sf_dir, "part").select(
        "p_partkey", odds.odds_from_cents(hundredths).cast("double").alias("price")
    )


def name_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(
        F.col("p_name"), F.lit(" FC"), F.when(F.col("p_size") % 5 > 0, " - AC ").otherwise(" AC "),
        F.col("p_type"), F.lit(" [U.19] "), F.col("p_brand"),
    )
    return table(spark, sf_dir, "part").select("p_partkey", names.normalise_event(raw, " - ").alias("event"))


def name_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name cleaning on whole documents, in all their languages."""
    text = names.clean_name(F.col("text"))
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return documents.select("doc_id", F.md5(text.cast("binary")).alias("cleaned"))


def name_normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event names out of whole conversation turns, split at their first comma."""
    turns = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id")
    event = names.normalise_split_event(F.col("text"), ", ")
    return turns.select("conv_id", "turn", F.length(event).cast("bigint").alias("n_chars"),
                        F.md5(event.cast("binary")).alias("event"))


def line_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = (F.col("l_quantity") * 250).cast("bigint")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        labels.compose_label(F.lit("U/O"), F.col("l_returnflag"), labels.line_suffix(line)).alias("bet"),
    )


def strip_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    bet = F.when(F.col("p_size") % 4 == 0, F.col("p_name")).otherwise(
        F.concat_ws(" <> ", "p_type", "p_name", "p_brand")
    )
    return parts.select("p_partkey", labels.strip_label_type(bet).alias("selection"))


def epoch_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("/Date("), naive_millis(F.col("ts")), F.lit("+0100)/"))
    return table(spark, sf_dir, "events").select("event_id", dates.parse_epoch_date(text).alias("date"))


def iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", dates.parse_iso_date(iso_text(F.col("ts"))).alias("date")
    )


def _two(column: Column) -> Column:
    return F.lpad(column.cast("string"), 2, "0")


def _italian_text(ts: Column, key: Column) -> Column:
    months = F.array(*[F.lit(m) for m in ITALIAN_MONTHS])
    month = F.element_at(months, F.month(ts))
    clock = F.concat(_two(F.hour(ts)), F.lit(":"), _two(F.minute(ts)))
    day = _two(F.dayofmonth(ts))
    return choose(
        key % 4,
        [
            (0, F.concat_ws(" ", day, month, F.year(ts).cast("string"), clock)),
            (1, F.concat_ws(" ", day, F.lower(month), clock)),
            (2, clock),
        ],
        F.concat(day, month),
    )


def italian_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _italian_text(F.col("ts"), F.col("event_id"))
    return table(spark, sf_dir, "events").select(
        "event_id", text.alias("shown"), dates.parse_italian_date(text, datetime(2020, 2, 29, 18)).alias("date")
    )


def future_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").select("event_id", F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("date"))
    strict = filters.future_only(days, RUN, inclusive=False).withColumn("rule", F.lit("strict"))
    inclusive = filters.future_only(days, RUN, inclusive=True).withColumn("rule", F.lit("inclusive"))
    return shape.union_feeds(strict, inclusive)


BOOKMAKERS = sorted(LABELS)
KINDS = ["1X2 Finale", "Esito Finale 1X2", "1X2 ESITO FINALE", "GG/NG", "MARCATORE", "Doppia Chance", "DOPPIA CHANCE", "1X2"]
OUTCOMES = ["1", "X", "2", "Goal", "No goal", "1X", "12", "X2"]


def _raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, key: F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        pick(BOOKMAKERS, F.col("p_partkey")).alias("bookmaker"),
        pick(KINDS, F.floor(F.col("p_partkey") / 6)).alias("kind"),
        labels.compose_label(
            pick(KINDS, F.floor(F.col("p_partkey") / 6)), pick(OUTCOMES, F.floor(F.col("p_partkey") / 48))
        ).alias("bet"),
    )


def label_allow(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = filters.exclude_types(_raw_labels(spark, sf_dir), "kind", EXCLUDED_TYPE_WORDS)
    known = filters.allowed_only(normalise.normalise_label(raw, label_dictionary(spark)), ALLOWED_LABELS)
    return known.select("p_partkey", "bookmaker", "bet", labels.strip_label_type(F.col("bet")).alias("selection"))


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The allow-list as a table instead of a list."""
    known = normalise.normalise_label(_raw_labels(spark, sf_dir), label_dictionary(spark))
    return filters.allowed_only(known, allowed_labels(spark)).groupBy("bet").agg(F.count(F.lit(1)).alias("n"))


PATTERNS = [*NOISE_PATTERNS, "%RING%", "%small wid%", "green%"]


def not_like_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    bets = filters.not_like_any(table(spark, sf_dir, "part"), "p_name", PATTERNS)
    return shape.order_by(shape.distinct_values(bets, "p_name"), "p_name")


def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.from_json("props", "struct<k:bigint>")
    return table(spark, sf_dir, "events").select("event_id", props["k"].alias("k"))


def map_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = F.from_json(
        F.to_json(F.create_map(F.lit("a"), F.col("event_id") % 4, F.lit("b"), F.col("user_id") % 3, F.lit("c"), F.lit(0))),
        "map<string,bigint>",
    )
    summed = table(spark, sf_dir, "events").select("event_id", shape.sum_map_values(counts).alias("events"))
    return filters.min_events(summed, 1, "events")


def link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    links = extract_links(pages, hidden_only=False)
    return links.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("links"),
        F.count_if(filters.is_tournament_link(F.col("href"))).alias("tournaments"),
        F.count_if(F.col("href").startswith("/")).alias("local"),
    )


def tournament_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a hidden list on each page, some of them to tournaments."""
    link = lambda path: F.concat(F.lit('<a href="/it/betting/'), F.lit(path), F.col("page_id"), F.lit('"></a>'))
    hidden = F.concat(
        F.lit('<div class="hidden-links">'), link("Football/Italy/Serie+A/"), link("Football"),
        link("Tennis/Italy/Rome/"), link("Football/Italy/Outright/"), link("Football/Spain/Liga/"), F.lit("</div>"),
    )
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat("html", hidden).alias("html"))
    return filters.link_filter(extract_links(pages))


def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last label seen, within very few and so very large partitions."""
    events = table(spark, sf_dir, "events").select(
        "event_id", "ts", "event_type", F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("line")
    )
    filled = shape.carry_forward_label(
        events, ["event_type"], ["ts", "event_id"], "line", F.date_trunc("HOUR", "ts")
    )
    return filled.select("event_id", "line")


def carry_forward_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without given stretches; one partition holds a third of the rows and more."""
    kind = F.when(F.col("event_id") % 5 < 2, "hot").otherwise(F.concat("event_type", F.col("user_id") % 50))
    events = table(spark, sf_dir, "events").select(
        "event_id", "ts", kind.alias("kind"), F.when(F.col("event_id") % 7 == 0, F.col("user_id")).alias("line")
    )
    return shape.carry_forward_label(events, ["kind"], ["ts", "event_id"], "line").select("event_id", "kind", "line")


def dup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def unique_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line, marked by whether its key is its own."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    own, shared = assert_unique(lines, ["l_orderkey", "l_linenumber"])
    return shape.union_feeds(own.withColumn("reason", F.lit(None).cast("string")),
                             shared.withColumn("reason", F.lit("key not unique")))


def truncate_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("event"), F.col("lang").alias("bookmaker"))
    return normalise.truncate_to_width(docs)


QUERIES = {
    "odds_normalise": odds_normalise,
    "odds_numeric": odds_numeric,
    "cents": cents,
    "name_normalise": name_normalise,
    "name_clean_text": name_clean_text,
    "name_normalise_text": name_normalise_text,
    "line_suffix": line_suffix,
    "strip_label": strip_label,
    "epoch_dates": epoch_dates,
    "iso_dates": iso_dates,
    "italian_dates": italian_dates,
    "future_only": future_only,
    "label_allow": label_allow,
    "label_counts": label_counts,
    "not_like_any": not_like_any,
    "json_extract": json_extract,
    "map_sum": map_sum,
    "link_counts": link_counts,
    "tournament_links": tournament_links,
    "carry_forward": carry_forward,
    "carry_forward_slices": carry_forward_slices,
    "dup_keys": dup_keys,
    "unique_rows": unique_rows,
    "truncate_width": truncate_width,
}

# 100 n / d, rounded half-even in whole numbers, plus the stake.
_HALF_EVEN = """(CASE WHEN 2 * (100 * n % d) < d THEN 100 * n // d
  WHEN 2 * (100 * n % d) > d THEN 100 * n // d + 1
  ELSE 100 * n // d + (100 * n // d) % 2 END)"""
_WORDS = r"regexp_extract_all({t}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+')"
_PUNCTUATION = r"regexp_replace({t}, '[.()\[\]?!]', '', 'g')"


def sql_clean(text: str) -> str:
    words = _WORDS.format(t=_PUNCTUATION.format(t=text))
    return rf"array_to_string(list_filter({words}, lambda w: NOT regexp_full_match(w, '[\p{{L}}\p{{N}}_]{{1,2}}')), '')"


def _pick(values: list[str], key: str) -> str:
    return f"([{', '.join(chr(39) + v + chr(39) for v in values)}])[CAST({key} % {len(values)} + 1 AS INTEGER)]"


_RAW_LABELS = f"""raw AS (SELECT p_partkey, {_pick(BOOKMAKERS, 'p_partkey')} AS bookmaker,
  {_pick(KINDS, 'p_partkey // 6')} AS kind,
  {_pick(KINDS, 'p_partkey // 6')} || ' <> ' || {_pick(OUTCOMES, 'p_partkey // 48')} AS bet FROM part),
d(bookmaker, original, canonical) AS ({sql_values([(b, o, c) for b in BOOKMAKERS for o, c in LABELS[b]])}),
known AS (SELECT p_partkey, raw.bookmaker, kind, coalesce(nullif(canonical, ''), bet) AS bet
  FROM raw LEFT JOIN d ON d.bookmaker = raw.bookmaker AND d.original = raw.bet)"""
_ALLOWED = "(" + ", ".join(f"'{b}'" for b in ALLOWED_LABELS) + ")"
_LIKES = " AND ".join(f"p_name NOT ILIKE '{p}'" for p in PATTERNS)
_HREFS = "regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)"

SQL = {
    "odds_normalise": f"""SELECT event_id, odd, CASE event_id % 6
      WHEN 0 THEN ({_HALF_EVEN} + 100) / 100::DOUBLE
      WHEN 1 THEN 2 WHEN 2 THEN 1
      WHEN 3 THEN (100 * whole + CASE WHEN mils % 10 < 5 THEN mils // 10 WHEN mils % 10 > 5 THEN mils // 10 + 1
        ELSE mils // 10 + (mils // 10) % 2 END) / 100::DOUBLE
      WHEN 4 THEN CASE WHEN user_id % 41 > 0 THEN ({_HALF_EVEN} + 100) / 100::DOUBLE END END AS price
    FROM (SELECT *, event_id % 97 + 1 AS n, event_id % 9 + 1 AS whole, event_id % 1000 AS mils,
      CASE event_id % 6 WHEN 0 THEN user_id % 41 + 1 ELSE greatest(user_id % 41, 1) END AS d,
      CASE event_id % 6 WHEN 0 THEN (event_id % 97 + 1) || '/' || (user_id % 41 + 1) WHEN 1 THEN 'Evens'
        WHEN 2 THEN NULL WHEN 3 THEN (event_id % 9 + 1) || '.' || lpad((event_id % 1000)::VARCHAR, 3, '0')
        WHEN 4 THEN (event_id % 97 + 1) || '/' || (user_id % 41)
        ELSE 'odd ' || (event_id % 97 + 1) END AS odd FROM events)""",
    "odds_numeric": "SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS DOUBLE) AS price FROM part",
    "cents": "SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) / 100 AS price FROM part",
    "name_normalise": rf"""SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN
      upper(regexp_replace(trim({sql_clean("p_name || ' FC - AC ' || p_type || ' [U.19] ' || p_brand")}), ' +', ' ', 'g'))
      END AS event FROM part""",
    "name_clean_text": f"SELECT doc_id, md5({sql_clean('text')}) AS cleaned FROM documents",
    "name_normalise_text": rf"""SELECT conv_id, turn, length(event) AS n_chars, md5(event) AS event FROM (
      SELECT conv_id, turn, CASE WHEN cut > 0 THEN upper(replace(
        regexp_replace(regexp_replace({sql_clean("substr(text, 1, cut - 1)")} || ' - ' || {sql_clean("substr(text, cut + 2)")},
          '^\s+|\s+$', '', 'g'), ' +', ' ', 'g'), 'ß', 'ss')) END AS event
      FROM (SELECT *, strpos(text, ', ') AS cut FROM conversations))""",
    # Quarters are exact in binary, so a tie is a true one and goes to even.
    "line_suffix": """SELECT l_orderkey, l_linenumber, 'U/O ' || (tenths // 10) || '.' || (tenths % 10) || ' <> '
      || l_returnflag AS bet FROM (SELECT *, CASE WHEN line % 100 < 50 THEN line // 100
        WHEN line % 100 > 50 THEN line // 100 + 1 ELSE line // 100 + (line // 100) % 2 END AS tenths
      FROM (SELECT *, CAST(l_quantity * 250 AS BIGINT) AS line FROM lineitem))""",
    "strip_label": f"""SELECT p_partkey, {sql_strip('bet')} AS selection FROM (SELECT p_partkey,
      CASE WHEN p_size % 4 = 0 THEN p_name ELSE p_type || ' <> ' || p_name || ' <> ' || p_brand END AS bet FROM part)""",
    "epoch_dates": "SELECT event_id, make_timestamp(epoch_us(ts) // 1000 * 1000) AS date FROM events",
    "iso_dates": "SELECT event_id, ts + INTERVAL 2 HOURS AS date FROM events",
    "italian_dates": f"""SELECT event_id, CASE event_id % 4
        WHEN 0 THEN strftime(ts, '%d ') || m || strftime(ts, ' %Y %H:%M')
        WHEN 1 THEN strftime(ts, '%d ') || lower(m) || strftime(ts, ' %H:%M')
        WHEN 2 THEN strftime(ts, '%H:%M') ELSE strftime(ts, '%d') || m END AS shown,
      CASE event_id % 4 WHEN 0 THEN date_trunc('minute', ts)
        WHEN 1 THEN make_timestamp(2020, month(ts), day(ts), hour(ts), minute(ts), 0)
        WHEN 2 THEN make_timestamp(2020, 2, 29, hour(ts), minute(ts), 0) END AS date
      FROM (SELECT *, {_pick(ITALIAN_MONTHS, '(month(ts) - 1)')} AS m FROM events)""",
    "future_only": """WITH d AS (SELECT event_id, date_trunc('hour', ts)::TIMESTAMP AS date FROM events)
      SELECT *, 'strict' AS rule FROM d WHERE date > TIMESTAMP '2024-01-15 12:00:00'
      UNION ALL SELECT *, 'inclusive' AS rule FROM d WHERE date >= TIMESTAMP '2024-01-15 12:00:00'""",
    "label_allow": f"""WITH {_RAW_LABELS} SELECT p_partkey, bookmaker, bet, {sql_strip('bet')} AS selection
      FROM known WHERE bet IN {_ALLOWED}
      AND NOT ({' OR '.join(f"contains(kind, '{w}')" for w in EXCLUDED_TYPE_WORDS)})""",
    "label_counts": f"WITH {_RAW_LABELS} SELECT bet, count(*) AS n FROM known WHERE bet IN {_ALLOWED} GROUP BY bet",
    "not_like_any": f"SELECT DISTINCT p_name FROM part WHERE {_LIKES} ORDER BY p_name",
    "json_extract": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "map_sum": """SELECT event_id, event_id % 4 + user_id % 3 AS events FROM events
      WHERE event_id % 4 + user_id % 3 > 1""",
    "link_counts": f"""SELECT page_id, count(*) AS links,
      count(*) FILTER (WHERE contains(href, 'Football') AND NOT contains(href, 'Outright')
        AND length(href) - length(replace(href, '/', '')) >= 4) AS tournaments,
      count(*) FILTER (WHERE starts_with(href, '/')) AS local
      FROM (SELECT page_id, replace(unnest({_HREFS}), '&amp;', '&') AS href FROM pages) GROUP BY page_id""",
    "tournament_links": """SELECT page_id, '/it/betting/Football/' || league || page_id AS href
      FROM pages CROSS JOIN (VALUES ('Italy/Serie+A/'), ('Spain/Liga/')) AS t(league)""",
    "carry_forward": """SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN user_id END IGNORE NULLS) OVER (
      PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS line FROM events""",
    "carry_forward_slices": """SELECT event_id, kind, last_value(CASE WHEN event_id % 7 = 0 THEN user_id END IGNORE NULLS) OVER (
      PARTITION BY kind ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS line FROM (
      SELECT *, CASE WHEN event_id % 5 < 2 THEN 'hot' ELSE event_type || (user_id % 50) END AS kind FROM events)""",
    "dup_keys": """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
      GROUP BY ALL HAVING count(*) > 1""",
    "unique_rows": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN
      count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 THEN 'key not unique' END AS reason FROM lineitem""",
    "truncate_width": "SELECT doc_id, left(text, 120) AS event, left(lang, 20) AS bookmaker FROM documents",
}

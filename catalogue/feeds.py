"""Feed parsers over pages derived from the orders, and the whole run."""

from __future__ import annotations

from datetime import datetime

from catalogue import payloads
from catalogue.views import COUNTERS3_SQL, doubles, spread, sql_rounded, sql_strip, sql_values, table
from pricematch.operators.match import tag_bookmaker
from pricematch.operators.normalise import accepted, normalise_quotes, rejected
from pricematch.operators.shape import union_feeds
from pricematch.plans.runs import Cycle, collect_once, collect_quotes, match_run, refresh_matches, resolve_quotes, run_cycle
from pricematch.schemas import MATCHES2, MATCHES3
from pricematch.session import scratch_path
from pricematch.sinks.tables import read_version, write_quarantine
from pricematch.sources import feeds, html
from pricematch.sources.dictionaries import label_dictionary, three_way_counters, two_way_counters, two_way_rows
from pricematch.sources.quotes import name_tournaments, read_feed
from pricematch.streaming import cycle
from pyspark.sql import DataFrame, SparkSession, functions as F

RUN = datetime(1997, 1, 1)
HTML_RUN = datetime(2021, 5, 6, 7)


def _parsed(spark: SparkSession, sf_dir: str, feed: str) -> DataFrame:
    build, parse, bookmaker = {
        "flat": (payloads.flat, feeds.parse_flat_feed, "SportPesa"),
        "nested": (payloads.nested, feeds.parse_nested_feed, "AdmiralYes"),
        "offer": (payloads.offer, feeds.parse_offer_feed, "888Sport"),
        "map": (payloads.mapped, feeds.parse_map_feed, "Sisal"),
    }[feed]
    pages = build(payloads.orders(spark, sf_dir))
    return tag_bookmaker(parse(pages, RUN), bookmaker)


def _feed(feed: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        good = accepted(_parsed(spark, sf_dir, feed))
        quotes = accepted(normalise_quotes(good, label_dictionary(spark)))
        return doubles(quotes.drop("position"), "betOdd")

    return query


def feed_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the feeds got wrong, by feed and reason."""
    bad = union_feeds(*[rejected(_parsed(spark, sf_dir, f)) for f in ("flat", "nested", "offer", "map")])
    return bad.groupBy("bookmaker", "reason").agg(F.count(F.lit(1)).alias("n"))


def _broken(pages: DataFrame) -> DataFrame:
    broken = F.when(F.col("ingest_seq") % 5 == 0, F.replace("payload", F.lit(":"), F.lit(";")))
    broken = broken.when(F.col("ingest_seq") % 5 == 1, F.lit("<html>busy</html>")).otherwise(F.col("payload"))
    return pages.withColumn("payload", broken)


def unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of four feeds, some of them broken on the way."""
    found = []
    for feed, build in (("flat", payloads.flat), ("nested", payloads.nested), ("offer", payloads.offer), ("map", payloads.mapped)):
        bad = feeds.unreadable_pages(_broken(build(payloads.orders(spark, sf_dir))), feed)
        found.append(bad.select("ingest_seq", F.lit(feed).alias("feed"), "reason"))
    return union_feeds(*found)


def html_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    found = html.extract_html_quotes(payloads.html(pages), HTML_RUN)
    return found.select("page_id", "event", "date", "bet", "betOdd", "reason")


def _schedule(feed: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return feeds.flatten_schedule(payloads.schedule(payloads.orders(spark, sf_dir), feed), feed)

    return query


def list_events_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.list_events(payloads.event_list(payloads.orders(spark, sf_dir), "nested"), "nested", skip_live=True)


def list_events_offer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.list_events(payloads.event_list(payloads.orders(spark, sf_dir), "offer"), "offer")


def landed_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land the pages as text, a page per line, and parse what is read back."""
    path = scratch_path(spark, "landed")
    payloads.mapped(payloads.orders(spark, sf_dir)).select("payload").write.text(path)
    pages = read_feed(spark, path, "Sisal", whole_file=False).withColumn("tournament", F.lit("Cup"))
    quotes, _ = collect_quotes(spark, feeds.parse_map_feed(pages, RUN))
    return doubles(quotes, "betOdd")


CUPS = 40


def landed_tournaments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedule and pages as they land: each folder of pages takes the name its id has in the schedule."""
    path = scratch_path(spark, "landed-tournaments")
    orders = payloads.orders(spark, sf_dir)
    payloads.schedule(orders, "flat").select("payload").write.text(f"{path}/schedule")
    listed = feeds.flatten_schedule(read_feed(spark, f"{path}/schedule", "Sisal", whole_file=False), "flat")
    pages = payloads.mapped(orders).select("payload", (F.col("ingest_seq") % CUPS * 3).alias("odds"))
    pages.repartition("odds").write.partitionBy("odds").text(f"{path}/pages")
    named = name_tournaments(read_feed(spark, f"{path}/pages", "Sisal", whole_file=False), listed, r"odds=([0-9]+)")
    quotes, _ = collect_quotes(spark, feeds.parse_map_feed(named, RUN))
    return doubles(quotes, "betOdd")


def _landed_quotes(spark: SparkSession, pages: DataFrame) -> DataFrame:
    parsed = feeds.parse_map_feed(pages.withColumn("tournament", F.lit("Cup")), RUN)
    quotes = accepted(normalise_quotes(accepted(parsed), label_dictionary(spark)))
    return doubles(quotes.drop("position"), "betOdd")


def quotes_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages as they land, through the same functions."""
    path = scratch_path(spark, "landed-stream")
    payloads.mapped(payloads.orders(spark, sf_dir)).select("payload").write.text(path)
    lines = cycle.quotes_stream(spark, path, "value string", format="text")
    pages = tag_bookmaker(lines.withColumnRenamed("value", "payload"), "Sisal")
    return cycle.run_to_files(_landed_quotes(spark, pages), "quotes-stream")


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of four feeds, collected, then resolved.

    What is read more than once is written first: so no page is parsed twice, and a lost executor costs a re-read.
    """
    parsed = [_parsed(spark, sf_dir, f) for f in ("flat", "nested", "offer", "map")]
    base = scratch_path(spark, "run")
    quotes, _, _ = collect_once(spark, base, *parsed)
    return resolve_quotes(quotes, f"{base}/staged")[0]


def _run(legs: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        counters2 = two_way_counters(spark, "corrected")
        two, three = match_run(_staged(spark, sf_dir), counters2, three_way_counters(spark), RUN)
        new, schema = (two, MATCHES2) if legs == 2 else (three, MATCHES3)
        empty = read_version(spark, "", None, schema)
        prices = [f"betOdd{i}" for i in range(1, legs + 1)]
        return doubles(refresh_matches(empty, new, RUN, legs), "RTP", *prices)

    return query


OLD_RUN = "1996-12-01 00:00:00"


def _earlier(spark: SparkSession, sf_dir: str, legs: int) -> DataFrame:
    """Results of an earlier run: a match of every third order. Those of orders that are over are stale by now."""
    key = F.col("o_orderkey")
    sides = [("SportPesa", "1"), ("888Sport", "X2")] if legs == 2 else [("SportPesa", "1"), ("AdmiralYes", "X"), ("Sisal", "2")]
    price = F.lit("1.50").cast("decimal(10,2)")
    leg = [c for i, (b, bet) in enumerate(sides, 1) for c in (F.lit(b).alias(f"bookmaker{i}"), F.lit(bet).alias(f"bet{i}"), price.alias(f"betOdd{i}"))]
    return table(spark, sf_dir, "orders").where(key % 3 == 0).select(
        F.lit("1.00").cast("decimal(10,2)").alias("RTP"), F.lit("OLD CUP").alias("tournament"), (key + 1).alias("betRadarID"),
        F.concat(F.lit("OLD EVENT "), key).alias("event"), F.lit("1996-06-01 00:00:00").cast("timestamp_ntz").alias("date"), *leg,
        F.lit(OLD_RUN).cast("timestamp_ntz").alias("insertingdate"),
    )


def _renamed(quotes: DataFrame, beside: bool = False) -> DataFrame:
    """Quotes of some events under other names, as of later pages; with ``beside``, next to the feed's own, parsed once for both.

    Of a plain comparison a filter for nulls would follow that parses the pages once more, before they are dealt to all tasks.
    """
    some, other = F.coalesce(F.col("betRadarID") % 11 == 0, F.lit(False)), F.col("__other")
    if beside:
        copies = F.when(some, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
        rows = quotes.withColumn("__other", F.explode_outer(copies))
    else:
        rows = quotes.where(some).withColumn("__other", F.lit(True))
    names = {"event": F.when(other, F.concat(F.lit("X "), F.col("event"))).otherwise(F.col("event")),
             "ingest_seq": F.when(other, F.col("ingest_seq") + 1_000_000_000).otherwise(F.col("ingest_seq"))}
    return rows.withColumns(names).drop("__other")


def _cycle(spark: SparkSession, sf_dir: str) -> Cycle:
    """A cycle over four feeds and a fifth that has other names for some of the fourth's events."""
    *parsed, fourth = [_parsed(spark, sf_dir, f) for f in ("flat", "nested", "offer", "map")]
    return run_cycle(
        spark, scratch_path(spark, "cycle"), [*parsed, _renamed(fourth, beside=True)], _earlier(spark, sf_dir, 2), _earlier(spark, sf_dir, 3),
        two_way_counters(spark, "corrected"), three_way_counters(spark), RUN,
    )


def _refreshed(legs: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The results table after a run into an earlier one's."""
        counters2 = two_way_counters(spark, "corrected")
        two, three = match_run(_staged(spark, sf_dir), counters2, three_way_counters(spark), RUN)
        prices = [f"betOdd{i}" for i in range(1, legs + 1)]
        return doubles(refresh_matches(_earlier(spark, sf_dir, legs), two if legs == 2 else three, RUN, legs), "RTP", *prices)

    return query


def cycle_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cycle left where: quotes, rejects and clashes by reason, results that are new or retained."""
    left = _cycle(spark, sf_dir)
    count = lambda df, part, kind: df.groupBy(F.lit(part).alias("part"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    age = F.when(F.col("tournament") == "OLD CUP", "retained").otherwise("new")
    return union_feeds(
        count(left.quotes, "quotes", F.col("bookmaker")), count(left.quarantine, "quarantine", F.col("reason")),
        count(left.matches2, "matches2", age), count(left.matches3, "matches3", age),
    )


def resolved_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(_staged(spark, sf_dir), "betOdd")


def broken_feeds(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Four feeds of partly broken pages, unreadable ones included."""
    return [
        tag_bookmaker(parse(_broken(build(payloads.orders(spark, sf_dir))), RUN, unreadable=True), bookmaker)
        for build, parse, bookmaker in (
            (payloads.flat, feeds.parse_flat_feed, "SportPesa"), (payloads.nested, feeds.parse_nested_feed, "AdmiralYes"),
            (payloads.offer, feeds.parse_offer_feed, "888Sport"), (payloads.mapped, feeds.parse_map_feed, "Sisal"),
        )
    ]


def run_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run over partly broken pages rejects, written to the quarantine and counted there."""
    _, bad, _ = collect_once(spark, scratch_path(spark, "collected"), *broken_feeds(spark, sf_dir))
    path = scratch_path(spark, "quarantine")
    write_quarantine(bad.select("bookmaker", "ingest_seq", "reason"), path)
    return spark.read.parquet(path).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same run's counts as observed on the way, beside those of what it wrote."""
    quotes, bad, seen = collect_once(spark, scratch_path(spark, "observed"), *broken_feeds(spark, sf_dir))
    rows = [(name, n) for name, n in seen.items() if name not in ("rows", "rejects")]
    observed = spark.createDataFrame(rows, "reason string, observed bigint")
    written = bad.groupBy("reason").agg(F.count(F.lit(1)).alias("written"))
    good = quotes.agg(F.lit("none").alias("reason"), F.lit(seen["rows"] - seen["rejects"]).alias("observed"), F.count(F.lit(1)).alias("written"))
    return observed.join(written, "reason", "full").unionByName(good)


def schedule_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedules of one to four levels, in three feeds' forms."""
    out = []
    for feed in ("flat", "nested", "offer"):
        pages = payloads.deep_schedule(payloads.orders(spark, sf_dir), feed)
        found = feeds.flatten_schedule_deep(pages, feed)
        out.append(found.select(F.lit(feed).alias("feed"), "page", F.array_join("path", ">", "-").alias("path"), "level", "tournament", "reason"))
    return union_feeds(*out)


QUERIES = {
    "flat_feed": _feed("flat"),
    "nested_feed": _feed("nested"),
    "offer_feed": _feed("offer"),
    "map_feed": _feed("map"),
    "feed_rejects": feed_rejects,
    "unreadable_pages": unreadable,
    "html_quotes": html_quotes,
    "schedule_flat": _schedule("flat"),
    "schedule_nested": _schedule("nested"),
    "schedule_offer": _schedule("offer"),
    "schedule_map": _schedule("map"),
    "list_events_nested": list_events_nested,
    "list_events_offer": list_events_offer,
    "landed_feed": landed_feed,
    "landed_tournaments": landed_tournaments,
    "quotes_stream": quotes_stream,
    "resolved_quotes": resolved_quotes,
    "run_quarantine": run_quarantine,
    "run_counts": run_counts,
    "schedule_deep": schedule_deep,
    "match_run_two_way": _run(2),
    "match_run_three_way": _run(3),
    "match_refresh_two_way": _refreshed(2),
    "match_refresh_three_way": _refreshed(3),
    "cycle_tables": cycle_tables,
}


def _price(step: int) -> str:
    return f"(110 + (o_custkey * {step}) % 300) / 100::DOUBLE"


def _fraction(n: str, d: str) -> str:
    """Stake plus profit, the profit rounded half-even in whole numbers."""
    q, r = f"(100 * ({n}) // ({d}))", f"(100 * ({n}) % ({d}))"
    return (
        f"(100 + CASE WHEN 2 * {r} < ({d}) THEN {q} WHEN 2 * {r} > ({d}) THEN {q} + 1 "
        f"ELSE {q} + {q} % 2 END) / 100::DOUBLE"
    )


_N, _D = "(o_custkey % 30 + 1)", "(o_orderkey % 16 + 1)"


def _quotes(bookmaker: str, ident: str, strict: bool, *prices: tuple[str, str]) -> str:
    """The quotes a feed's pages come to, straight from the orders."""
    after = ">" if strict else ">="
    return " UNION ALL ".join(
        f"""SELECT o_orderkey AS ingest_seq, '{bookmaker}' AS bookmaker, 'Cup ' || (o_orderkey % 10) AS tournament,
  CAST({ident} AS BIGINT) AS "betRadarID", 'HOME' || o_custkey || ' - AWAY' || o_orderkey AS event,
  o_orderdate AS date, '{bet}' AS bet, {odd} AS "betOdd" FROM orders
  WHERE o_orderdate {after} TIMESTAMP '1997-01-01'"""
        for bet, odd in prices
    )


_FEEDS = [
    ("SportPesa", "o_orderkey + 1", True, ("1X2 <> 1", _price(1)), ("U/O 2.5 <> OVER 2.5", _price(2))),
    ("AdmiralYes", "o_orderkey + 1", False, ("1X2 <> X", _price(5)), ("U/O 2.5 <> UNDER 2.5", _price(7)), ("U/O 2.5 <> OVER 2.5", _price(8))),
    ("888Sport", "-1", False,
     ("DOPPIA CHANCE OUT <> X2", _fraction(_N, _D)), ("DOPPIA CHANCE IN/OUT <> 12", _fraction(f"{_N} + 1", _D)),
     ("U/O 2.5 <> OVER 2.5", _fraction(_N, f"{_D} + 1")), ("U/O 2.5 <> UNDER 2.5", _fraction(f"{_N} + 2", _D)),
     ("U/O 3.5 <> OVER 3.5", _fraction(f"{_N} + 3", _D)), ("U/O 3.5 <> UNDER 3.5", _fraction(f"{_N} + 4", _D))),
    ("Sisal", "o_orderkey + 1", True, ("1X2 <> 1", _price(3)), ("1X2 <> X", _price(4)), ("1X2 <> 2", _price(5))),
]
_FLAT, _NESTED, _OFFER, _MAP = (_quotes(*f) for f in _FEEDS)

# Rows without an id take the one their event has elsewhere, or are dropped.
_RESOLVED = f"""u AS ({_FLAT} UNION ALL {_NESTED} UNION ALL {_OFFER} UNION ALL {_MAP}),
found AS (SELECT event, date, min("betRadarID") AS id FROM u WHERE "betRadarID" <> -1 GROUP BY event, date),
r AS MATERIALIZED (SELECT bookmaker, tournament, CASE WHEN "betRadarID" = -1 THEN id ELSE "betRadarID" END AS "betRadarID",
  event, date, bet, "betOdd" FROM u LEFT JOIN found USING (event, date)
  WHERE "betRadarID" <> -1 OR id IS NOT NULL)"""
_LIVE2 = "c2(bet, counter) AS (" + sql_values(two_way_rows("corrected")) + ")"


def _lean(bookmaker: str, ident: str, strict: bool, *prices: tuple[str, str]) -> str:
    """A feed's quotes by order, without the text that follows from it."""
    return " UNION ALL ".join(
        f"SELECT o_orderkey AS k, o_custkey AS c, '{bookmaker}' AS bookmaker, {ident} AS id, '{bet}' AS bet, {odd} AS odd, "
        f"o_orderdate AS date FROM orders WHERE o_orderdate {'>' if strict else '>='} TIMESTAMP '1997-01-01'"
        for bet, odd in prices
    )


# An order's quotes are one event in every feed, so an id that lacks is that of another quote of the order.
_QUOTES = f"""u AS ({" UNION ALL ".join(_lean(*f) for f in _FEEDS)}),
known AS (SELECT k, min(id) AS known FROM u WHERE id <> -1 GROUP BY k),
q AS (SELECT u.k, c, bookmaker, CASE WHEN id = -1 THEN known ELSE id END AS id, bet, odd, date
  FROM u LEFT JOIN known ON known.k = u.k WHERE id <> -1 OR known IS NOT NULL)"""
_PAIRS = f"""WITH {_QUOTES}, {_LIVE2},
s AS (SELECT q.*, counter FROM q JOIN c2 ON c2.bet = q.bet),
m AS (SELECT a.k, a.c, a.id, a.date, a.bookmaker AS bookmaker1, a.bet AS bet1, a.odd AS odd1, b.bookmaker AS bookmaker2,
    b.bet AS bet2, b.odd AS odd2, a.odd * (1::DOUBLE - 1::DOUBLE / b.odd) * 100::DOUBLE AS raw
  FROM s a JOIN q b ON b.id = a.id AND b.bet = a.counter AND b.bookmaker <> a.bookmaker)"""
_TRIPLES = f"""WITH {_QUOTES}, {COUNTERS3_SQL},
s AS (SELECT q.*, counter1, counter2 FROM q JOIN c3 ON c3.bet = q.bet),
p AS (SELECT a.*, b.bookmaker AS bookmaker2, b.bet AS bet2, b.odd AS odd2
  FROM s a JOIN q b ON b.id = a.id AND b.bet = a.counter1 AND b.bookmaker <> a.bookmaker),
m AS (SELECT p.k, p.c, p.id, p.date, p.bookmaker AS bookmaker1, p.bet AS bet1, p.odd AS odd1, bookmaker2, bet2, odd2,
    c.bookmaker AS bookmaker3, c.bet AS bet3, c.odd AS odd3,
    p.odd * (1::DOUBLE - 1::DOUBLE / odd2 - 1::DOUBLE / c.odd) * 100::DOUBLE AS raw
  FROM p JOIN q c ON c.id = p.id AND c.bet = p.counter2 AND c.bookmaker <> p.bookmaker AND c.bookmaker <> p.bookmaker2)"""
#: Of Sisal's quotes that come under two names, neither is staged.
_CLASHING = "u AS (SELECT * FROM u0 WHERE NOT (bookmaker = 'Sisal' AND (k + 1) % 11 = 0)), "
_OLD = {2: "('SportPesa', '1'), ('888Sport', 'X2')", 3: "('SportPesa', '1'), ('AdmiralYes', 'X'), ('Sisal', '2')"}


def _known(legs: int) -> str:
    """Whether a match is among the earlier results."""
    sides = [side.split("', '") for side in _OLD[legs].strip("()").split("), (")]
    return "k % 3 = 0 AND " + " AND ".join(
        f"bookmaker{i} = {b}' AND {sql_strip(f'bet{i}')} = '{bet}" for i, (b, bet) in enumerate(sides, 1))


def _matches(legs: int, refresh: bool = False) -> str:
    """The matches of a run, in a table of its own or over the earlier results."""
    legged = ", ".join(f'bookmaker{i}, {sql_strip(f"bet{i}")} AS bet{i}, odd{i} AS "betOdd{i}"' for i in range(1, legs + 1))
    first = {"tournament": "'Cup ' || (k % 10)", "event": "'HOME' || c || ' - AWAY' || k", "date": "date"}
    old = {"tournament": "'OLD CUP'", "event": "'OLD EVENT ' || k", "date": "TIMESTAMP '1996-06-01'"}
    pick = lambda c: f"CASE WHEN {_known(legs)} THEN {old[c]} ELSE {first[c]} END AS {c}" if refresh else f"{first[c]} AS {c}"
    return f"""{_PAIRS if legs == 2 else _TRIPLES} SELECT "RTP", {pick("tournament")}, id AS "betRadarID", {pick("event")},
  {pick("date")}, {legged}, TIMESTAMP '1997-01-01' AS insertingdate FROM ({sql_rounded("m")})"""


_KIND = lambda n: f"SELECT o_orderkey AS page, o_custkey AS c, {n} AS i FROM orders"
_THREE = " UNION ALL ".join(_KIND(i) for i in range(3))

SQL = {
    "flat_feed": _FLAT,
    "nested_feed": _NESTED,
    "offer_feed": _OFFER,
    "map_feed": _MAP,
    "feed_rejects": """WITH o AS (SELECT count(*) AS total, count(*) FILTER (WHERE o_orderdate > TIMESTAMP '1997-01-01') AS later,
        count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1997-01-01') AS open FROM orders)
      SELECT 'SportPesa' AS bookmaker, 'event not listed or started' AS reason, later + 4 * (total - later) AS n FROM o
      UNION ALL SELECT 'SportPesa', 'not a match', later FROM o
      UNION ALL SELECT 'AdmiralYes', 'unknown market or line', 2 * open FROM o
      UNION ALL SELECT 'Sisal', 'event not listed or started', later + 4 * (total - later) FROM o""",
    "unreadable_pages": """SELECT o_orderkey AS ingest_seq, feed, 'unreadable page' AS reason FROM orders
      CROSS JOIN (VALUES ('flat'), ('nested'), ('offer'), ('map')) AS t(feed) WHERE o_orderkey % 5 < 2""",
    "html_quotes": """WITH p AS (SELECT *, '1.' || lpad((page_id % 100)::VARCHAR, 2, '0') AS odd,
        'HOME' || page_id || ' - AWAY' || (page_id + 1) AS event,
        TIMESTAMP '2021-04-27 12:00:00' + to_minutes(CAST(page_id % 60 AS INTEGER)) AS date FROM pages)
      SELECT page_id, event, date, '1X2 <> 1' AS bet, odd AS "betOdd", NULL AS reason FROM p
      UNION ALL SELECT page_id, event, date, '1X2 <> X', (page_id % 7 + 1) || '/4', NULL FROM p
      UNION ALL SELECT page_id, NULL, TIMESTAMP '2021-05-06 23:00:00', '1X2 <> 2', odd, 'not a match' FROM p""",
    "schedule_flat": f"SELECT page, page * 3 + i AS tournament_id, 'Cup ' || page || '/' || i AS tournament FROM ({_THREE})",
    "schedule_nested": f"""SELECT page, '1' AS sport_code, page * 3 + i AS tournament_id, 'Cup ' || page || '/' || i AS tournament,
      'b' AS bet_code, 's' AS bet_section FROM ({_THREE}) WHERE c % 2 + i > 1""",
    "schedule_offer": f"""SELECT page, 'C' || page || '/0' AS country, 'Cup ' || page || '/' || i AS tournament
      FROM ({_THREE}) WHERE c % 9 + 4 * i > 10
      UNION ALL SELECT o_orderkey, 'C' || o_orderkey || '/1', NULL FROM orders WHERE o_custkey % 20 > 10""",
    "schedule_map": f"""SELECT page, CAST(page * 3 + i AS VARCHAR) AS tournament_id, 'Cup ' || page || '/' || i AS tournament,
      i = 0 AS top FROM ({_THREE}) WHERE i = 0 OR c % 2 + i > 1""",
    "list_events_nested": """SELECT o_orderkey AS page, o_orderkey || '.1.' || o_custkey AS event_key,
      o_orderkey::VARCHAR AS schedule_code, '1.' || o_custkey AS event_code FROM orders""",
    "list_events_offer": """SELECT o_orderkey AS page, o_orderkey * 2 AS event_id FROM orders
      UNION ALL SELECT o_orderkey, o_orderkey * 2 + 1 FROM orders""",
    "landed_feed": f"SELECT * EXCLUDE (ingest_seq) REPLACE ('Cup' AS tournament) FROM ({_MAP})",
    "landed_tournaments": f"""SELECT * EXCLUDE (ingest_seq) REPLACE ('Cup ' || (ingest_seq % {CUPS}) || '/0' AS tournament)
      FROM ({_MAP}) WHERE ingest_seq % {CUPS} IN (SELECT o_orderkey FROM orders)""",
    "quotes_stream": f"SELECT * EXCLUDE (ingest_seq) REPLACE ('Cup' AS tournament) FROM ({_MAP})",
    "resolved_quotes": f"WITH {_RESOLVED} SELECT * FROM r",
    "run_quarantine": """WITH o AS (SELECT count(*) AS total, count(*) FILTER (WHERE o_orderdate > TIMESTAMP '1997-01-01') AS later,
        count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1997-01-01') AS open FROM orders WHERE o_orderkey % 5 >= 2)
      SELECT 'event not listed or started' AS reason, 2 * later + 8 * (total - later) AS n FROM o
      UNION ALL SELECT 'not a match', later FROM o UNION ALL SELECT 'unknown market or line', 2 * open FROM o
      UNION ALL SELECT 'unreadable page', 4 * count(*) FROM orders WHERE o_orderkey % 5 < 2""",
    "run_counts": """WITH o AS (SELECT count(*) AS total, count(*) FILTER (WHERE o_orderdate > TIMESTAMP '1997-01-01') AS later,
        count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1997-01-01') AS open FROM orders WHERE o_orderkey % 5 >= 2),
      n AS (SELECT 'event not listed or started' AS reason, 2 * later + 8 * (total - later) AS n FROM o
        UNION ALL SELECT 'not a match', later FROM o UNION ALL SELECT 'unknown market or line', 2 * open FROM o
        UNION ALL SELECT 'unreadable page', 4 * count(*) FROM orders WHERE o_orderkey % 5 < 2
        UNION ALL SELECT 'none', 5 * later + 9 * open FROM o)
      SELECT reason, n AS observed, n AS written FROM n""",
    "schedule_deep": """WITH f AS (SELECT o.*, feed FROM orders o, (VALUES ('flat'), ('nested'), ('offer')) AS t(feed)),
      l AS (SELECT f.*, o_orderkey % 4 + 1 AS level, '' AS place FROM f
        UNION ALL SELECT f.*, k, 'a' FROM f, range(2, 5) AS r(k) WHERE k <= o_orderkey % 4 + 1)
      SELECT feed, o_orderkey AS page, array_to_string(
          list_concat(['Area ' || o_orderkey || '/' || x for x in range(1, level)], ['Cup ' || o_orderkey || '/' || level || place]), '>') AS path,
        CAST(level AS INTEGER) AS level,
        CASE WHEN feed <> 'offer' OR level > 1 THEN 'Cup ' || o_orderkey || '/' || level || place END AS tournament, NULL AS reason
      FROM l WHERE o_orderkey % 10 NOT IN (3, 7) AND (feed = 'flat' OR feed = 'nested' AND o_custkey % 2 + level > 1
        OR feed = 'offer' AND o_custkey % 9 + 4 * level > 10)
      UNION ALL SELECT feed, o_orderkey, NULL, NULL, NULL, 'unreadable page' FROM f WHERE o_orderkey % 10 = 7""",
    "match_run_two_way": _matches(2),
    "match_run_three_way": _matches(3),
    "match_refresh_two_way": _matches(2, True),
    "match_refresh_three_way": _matches(3, True),
    "cycle_tables": f"""{_PAIRS.replace("WITH u AS", "WITH u0 AS").replace("known AS (SELECT k, min(id) AS known FROM u", _CLASHING + "known AS (SELECT k, min(id) AS known FROM u")},
three AS ({_TRIPLES.replace("WITH u AS", "WITH u0 AS").replace("known AS (SELECT k, min(id) AS known FROM u", _CLASHING + "known AS (SELECT k, min(id) AS known FROM u")} SELECT * FROM m),
o AS (SELECT count(*) AS total, count(*) FILTER (WHERE o_orderdate > TIMESTAMP '1997-01-01') AS later,
  count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1997-01-01') AS open FROM orders)
SELECT 'quotes' AS part, bookmaker AS kind, count(*) AS n FROM q GROUP BY ALL
UNION ALL SELECT 'matches2', CASE WHEN {_known(2)} THEN 'retained' ELSE 'new' END, count(*) FROM m GROUP BY ALL
UNION ALL SELECT 'matches3', CASE WHEN {_known(3)} THEN 'retained' ELSE 'new' END, count(*) FROM three GROUP BY ALL
UNION ALL SELECT 'quarantine', 'event not listed or started', 2 * later + 8 * (total - later) FROM o
UNION ALL SELECT 'quarantine', 'not a match', later FROM o
UNION ALL SELECT 'quarantine', 'unknown market or line', 2 * open FROM o
UNION ALL SELECT 'quarantine', 'staged key not unique', 2 * count(*) FROM u0 WHERE bookmaker = 'Sisal' AND (k + 1) % 11 = 0""",
}

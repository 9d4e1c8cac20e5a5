import json
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pricematch.operators.normalise import accepted, normalise_quotes, rejected
from pricematch.sources import dictionaries, feeds, html

RUN = datetime(2021, 3, 1)


def pages(spark, *documents, tournament="T"):
    rows = [(tournament, json.dumps(d)) for d in documents]
    return spark.createDataFrame(rows, "tournament string, payload string")


def quotes(df):
    return sorted(
        (r["event"], r["bet"], r["betOdd"], r["betRadarID"], r["date"]) for r in accepted(df).collect()
    )


def reasons(df):
    return sorted(r["reason"] for r in rejected(df).collect())


def test_flat_feed(spark):
    page = {
        "events": [
            {"Id": 1, "BetRadarId": 77, "Name": "Old-Name", "StartDate": "/Date(1616360400000+0100)/"},
            {"Id": 1, "BetRadarId": 88, "Name": "Juventus-Napoli", "StartDate": "/Date(1616360400000+0100)/"},
            {"Id": 2, "BetRadarId": 99, "Name": "Started-Already", "StartDate": "/Date(1516360400000+0100)/"},
            {"Id": 3, "BetRadarId": 99, "Name": "Winner", "StartDate": "/Date(1616360400000+0100)/"},
        ],
        "eventsOutcome": [
            {"EventId": 1, "Kind": {"Name": "1X2 Finale"}, "Name": "1", "Odds": 1.85},
            {"EventId": 1, "Kind": {"Name": "1X2 Finale"}, "Name": None, "Odds": 1.85},
            {"EventId": 2, "Kind": {"Name": "1X2 Finale"}, "Name": "X", "Odds": 3},
            {"EventId": 3, "Kind": {"Name": "1X2 Finale"}, "Name": "X", "Odds": 3},
            {"EventId": 4, "Kind": {"Name": "1X2 Finale"}, "Name": "X", "Odds": 3},
        ],
    }
    out = feeds.parse_flat_feed(pages(spark, page), RUN).persist()
    # The later of two events with one id wins.
    assert quotes(out) == [("JUVENTUS - NAPOLI", "1X2 Finale <> 1", "1.85", 88, datetime(2021, 3, 21, 21))]
    assert reasons(out) == ["event not listed or started", "event not listed or started", "no label", "not a match"]


def test_first_price_of_a_page_wins(spark):
    from pricematch.operators.match import tag_bookmaker
    from pricematch.plans.runs import collect_quotes

    event = {"Id": 1, "BetRadarId": 88, "Name": "Juventus-Napoli", "StartDate": "/Date(1616360400000+0100)/"}
    odds = lambda *prices: {"events": [event], "eventsOutcome": [
        {"EventId": 1, "Kind": {"Name": "1X2 Finale"}, "Name": "1", "Odds": p} for p in prices]}
    first = pages(spark, odds("bad", 1.5, 1.4)).withColumn("ingest_seq", F.lit(1))
    later = pages(spark, odds(1.3)).withColumn("ingest_seq", F.lit(2))
    raw = feeds.parse_flat_feed(first.unionByName(later).repartition(3), RUN)
    good, bad = collect_quotes(spark, tag_bookmaker(raw, "SportPesa"))
    assert [r.betOdd for r in good.collect()] == [Decimal("1.50")]
    assert [r.reason for r in bad.collect()] == ["price"]


def nested_page(bets, when="2021-03-21T19:45:00Z", ref=None, name="AC Milan - Inter"):
    return {
        "head": {
            "3": {"name": "1X2", "spreadOptions": None},
            "14": {"name": "U/O", "spreadOptions": {"a": {"key": "250", "display": "2.5"},
                                                    "b": {"key": "350", "display": "3.5"}}},
            "9": {"name": "MARCATORE SI/NO", "spreadOptions": None},
        },
        "body": {"10.20": {"name": name, "dateTimeUTC": when,
                           "externalReferences": ref or {"BetRadar": {"matchId": 5}}, "bets": bets}},
    }


def info(*outcomes, status=1):
    return {"status": status, "outcome": {str(i): o for i, o in enumerate(outcomes)}}


def outcome(label, val, status=1):
    return {"label": label, "val": val, "status": status}


def test_nested_feed(spark):
    bets = {
        "3": {"hasSpread": False, "additionalInfos": {"0": info(outcome("1", 2.1), outcome("X", 3, status=0))}},
        "14": {"hasSpread": True, "additionalInfos": {
            "250": info(outcome("OVER", 1.9)), "350": info(outcome("OVER", 2.9), status=0)}},
        "9": {"hasSpread": False, "additionalInfos": {"0": info(outcome("SI", 9))}},
    }
    out = feeds.parse_nested_feed(pages(spark, nested_page(bets)), RUN).persist()
    when = datetime(2021, 3, 21, 21, 45)
    assert quotes(out) == [("MILAN - INTER", "1X2 <> 1", "2.1", 5, when),
                           ("MILAN - INTER", "U/O 2.5 <> OVER", "1.9", 5, when)]
    assert reasons(out) == []


def test_nested_feed_isolates_bad_markets(spark):
    bets = {
        "3": {"hasSpread": False, "additionalInfos": {"0": info(outcome("1", 2.1), status=0)}},
        "14": {"hasSpread": True, "additionalInfos": {"250": info(outcome("OVER", 1.9))}},
        "77": {"hasSpread": False, "additionalInfos": {"0": info(outcome("1", 2))}},
    }
    out = feeds.parse_nested_feed(pages(spark, nested_page(bets)), RUN).persist()
    assert [q[1] for q in quotes(out)] == ["U/O 2.5 <> OVER"]
    assert reasons(out) == ["unknown market or line"] * 3


def test_nested_feed_started_and_keyed(spark):
    bets = {"3": {"hasSpread": False, "additionalInfos": {"0": info(outcome("1", 2.1))}}}
    exact = nested_page(bets, when="2021-02-28T22:00:00Z")
    assert len(quotes(feeds.parse_nested_feed(pages(spark, exact), RUN))) == 1
    started = nested_page(bets, when="2021-02-28T21:59:59Z")
    assert feeds.parse_nested_feed(pages(spark, started), RUN).count() == 0
    keyed = pages(spark, exact).withColumn("event_key", F.lit("10.21"))
    assert feeds.parse_nested_feed(keyed, RUN).count() == 0
    no_ref = feeds.parse_nested_feed(pages(spark, nested_page(bets, ref={"Other": {}})), RUN)
    assert reasons(no_ref) == ["no event id"]


def offer_page(lines, name="AC Milan - Inter", start="2021-03-21T19:45:00Z"):
    outs = [{"line": l, "label": f"o{i}", "oddsFractional": "5/2"} for i, l in enumerate(lines)]
    return {"events": [{"group": "Serie A", "start": start, "name": name}],
            "betOffers": [{"criterion": {"label": "T"}, "outcomes": outs}]}


def test_offer_feed_line_sticks(spark):
    out = feeds.parse_offer_feed(pages(spark, offer_page([2500, None, 3500, 0])), RUN)
    assert [q[1] for q in quotes(out)] == ["T 2.5 <> o0", "T 2.5 <> o1", "T 3.5 <> o2", "T 3.5 <> o3"]
    out = feeds.parse_offer_feed(pages(spark, offer_page([None, 2500, 10000])), RUN)
    assert [q[1] for q in quotes(out)] == ["T 10.0 <> o2", "T 2.5 <> o1", "T <> o0"]
    assert {q[3] for q in quotes(out)} == {-1}


def test_ids_and_lines_in_either_form(spark):
    bets = {"3": {"hasSpread": False, "additionalInfos": {"0": info(outcome("1", "2.105"))}}}
    page = nested_page(bets, ref={"BetRadar": {"matchId": "26587112"}})
    out = feeds.parse_nested_feed(pages(spark, page), RUN, numeric_odds=False)
    assert [(q[2], q[3]) for q in quotes(out)] == [("2.105", 26587112)]
    out = feeds.parse_offer_feed(pages(spark, offer_page([2500.0, 0.0])), RUN)
    assert [q[1] for q in quotes(out)] == ["T 2.5 <> o0", "T 2.5 <> o1"]


def test_unreadable_pages(spark):
    rows = [("{}",), ("<html>",), ('{"events": [{"Id": 1}]}',), (None,), ('{"other": 1}',)]
    df = spark.createDataFrame(rows, "payload string")
    got = feeds.unreadable_pages(df, "flat").collect()
    assert [r.payload for r in got] == ["{}", "<html>", None, '{"other": 1}']


@pytest.mark.parametrize("feed", list(feeds.PAGES))
def test_unreadable_pages_are_read_once_and_where_they_were_dealt(spark, feed):
    dealt = spark.range(9).select(F.col("id").alias("page"), F.concat(F.lit('{"x'), "id").alias("payload")).repartition(4, "page")
    found = feeds.unreadable_pages(dealt, feed)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.index("from_json(") < plan.index("Exchange")
    assert found.count() == 9


def test_map_feed(spark):
    event = lambda code, ident, name="AC Milan - Inter", when="2021-03-21T19:45:00Z": {
        "data": when, "codiceAvvenimento": code, "descrizione": name,
        "externalProviderInfoList": [{"idAvvProviderLive": ident}]}
    market = lambda code, quota=185: {
        "codiceAvvenimento": code, "descrizione": "1X2 ESITO FINALE",
        "esitoList": [{"descrizione": "1", "quota": quota}]}
    page = {"avvenimentoFeList": [event(1, 5), event(2, 0), event(3, None), event(4, 6, name="Antepost")],
            "infoAggiuntivaMap": {"a": market(1), "b": market(2), "c": market(3), "d": market(4), "e": market(9)}}
    out = feeds.parse_map_feed(pages(spark, page), RUN).persist()
    assert quotes(out) == [("MILAN - INTER", "1X2 ESITO FINALE <> 1", "1.85", 5, datetime(2021, 3, 21, 21, 45))]
    assert len(reasons(out)) == 4


def test_html_forms(spark):
    page = """<div class="bg coupon-rows" data-event-name="C vs D"><span data-selection-key="k">2</span></div>
      <div data-event-name='Citt&agrave; vs Rock&#x27;n &quot;Best&quot;' class='coupon-row bg'>
      <td class='cell date'>12:30</td><span class=x data-selection-key='k&#49;&nbsp;&amp;lt; "q"'>1.5</span></div>
      <div class="bg coupon-row" data-event-name="Home vs Away"><span>no price</span></div>
      <div id='l' class='hidden-links x'><a href='/a?x&amp;y'></a></div>"""
    df = spark.createDataFrame([(page,)], "html string")
    got = html.extract_html_quotes(df, datetime(2021, 5, 6)).collect()
    assert len(got) == 2 and got[0].event == "CITT\u00c0 - ROCK' \"BEST\""
    assert got[0].bet == 'k1\u00a0&lt; "q"' and got[0].betOdd == "1.5" and got[0].date is not None and got[0].reason is None
    assert got[1].bet is None and got[1].reason == "no price"
    assert [r.href for r in html.extract_links(df).collect()] == ["/a?x&y"]
    texts = spark.createDataFrame([("&#0;&nope;&#xD800; & &#128512;",), (None,)], "t string")
    assert [r[0] for r in texts.select(html.unescape(texts.t)).collect()] == ["&#0;&nope;&#xD800; & \U0001f600", None]


def test_html_quotes(spark):
    page = """<html><div class="x">noise</div>
    <div class="bg coupon-row" data-event-name="AC Milan vs FC Inter" data-x="1"><table><tr>
      <td class="date date-with-month"> 27 Apr 2021 12:00 </td>
      <td class="height-column-with-price"><span data-selection-key="1X2 &lt;&gt; 1">1.85</span></td>
      <td class="height-column-with-price"><span class="c" data-selection-key="k2"> 5/2 </span></td></tr></table></div>
    <div data-event-name="Juve &amp; Co vs Roma" class="bg coupon-row"><td class="date">23:00</td>
      <span data-selection-key="k3">2</span></div></html>"""
    df = spark.createDataFrame([(page,)], "html string")
    got = quotes(html.extract_html_quotes(df, datetime(2021, 5, 6)))
    assert got == [
        ("JUVE & - ROMA", "k3", "2", -1, datetime(2021, 5, 6, 23)),
        ("MILAN - INTER", "1X2 <> 1", "1.85", -1, datetime(2021, 4, 27, 12)),
        ("MILAN - INTER", "k2", "5/2", -1, datetime(2021, 4, 27, 12)),
    ]


def test_links(spark):
    page = '<a href="/x"></a><div class="hidden-links"><a href="/a/Football/b/c?x&amp;y"></a><a href="/z"></a></div>'
    df = spark.createDataFrame([(page,)], "html string")
    assert [r.href for r in html.extract_links(df).collect()] == ["/a/Football/b/c?x&y", "/z"]
    assert html.extract_links(df, hidden_only=False).count() == 3


def test_schedules(spark):
    flat = [{"Children": [{"Children": [{"Id": 1, "Name": "A"}, {"Id": 2, "Name": "B"}]}]}, {"Children": []}]
    rows = feeds.flatten_schedule(pages(spark, flat).drop("tournament"), "flat").collect()
    assert [(r.tournament_id, r.tournament) for r in rows] == [(1, "A"), (2, "B")]

    t = lambda i, c: {"sportCode": "1", "id": i, "name": f"n{i}", "betCode": "3", "betSection": "s", "eventsCounter": c}
    nested = {"sports": {"1": {"categories": {"it": {"tournaments": {
        "a": t(1, {"x": 1}), "b": t(2, {"x": 1, "y": 1}), "c": t(3, {})}}}}, "2": {"categories": {}}}}
    rows = feeds.flatten_schedule(pages(spark, nested).drop("tournament"), "nested", True).collect()
    assert [(r.tournament_id, r.events) for r in rows] == [(2, 2)]

    offer = {"group": {"groups": [{"groups": [
        {"termKey": "it", "eventCount": 99, "groups": [{"termKey": "a", "eventCount": 11}, {"termKey": "b", "eventCount": 10}, {"termKey": "c"}]},
        {"termKey": "fr", "eventCount": 12}, {"termKey": "de", "eventCount": 3, "groups": []}]}]}}
    rows = feeds.flatten_schedule(pages(spark, offer).drop("tournament"), "offer").collect()
    assert [(r.country, r.tournament) for r in rows] == [("it", "a"), ("fr", None)]

    mapped = {"manifestazioneListByDisciplinaTutti": {"1": ["7", "8", "9"], "2": ["6"]},
              "manifestazioneMap": {"7": {"topManifestazione": True, "descrizione": "A"}, "8": {"descrizione": "B"},
                                    "9": {"topManifestazione": False, "descrizione": "C"}},
              "eventsNumberByManifestazioneTutti": {"7": 1, "8": 2, "9": 1}}
    rows = feeds.flatten_schedule(pages(spark, mapped).drop("tournament"), "map").collect()
    assert sorted((r.tournament_id, r.tournament, r.top) for r in rows) == [("7", "A", True), ("8", "B", False)]


def test_list_events(spark):
    body = {"body": {"1.2.3": {"liveStatus": None}, "4.5": {"liveStatus": "LIVE"}, "6.7": {}}}
    df = pages(spark, body)
    assert feeds.list_events(df, "nested").count() == 3
    got = feeds.list_events(df, "nested", skip_live=True).collect()
    assert sorted((r.schedule_code, r.event_code) for r in got) == [("1", "2.3"), ("6", "7")]
    ids = feeds.list_events(pages(spark, {"events": [{"event": {"id": 3}}, {"event": {"id": 4}}]}), "offer")
    assert [r.event_id for r in ids.collect()] == [3, 4]


def test_normalise_quotes(spark):
    rows = [
        ("SportPesa", "1X2 Finale <> 1", "1.855", True),
        ("SportPesa", "1X2 Finale <> 2", "1.855", False),
        ("SportPesa", "U/O 2,5 <> Ov.2,5", "abc", False),
        ("SportPesa", "Cards <> 3", "2", True),
        ("888Sport", "1X2 Finale <> 1", "2", True),
        ("888Sport", "Doppia Chance <> 12", "Evens", False),
        ("888Sport", "1X2 <> X", None, False),
    ]
    df = spark.createDataFrame(rows, "bookmaker string, bet string, betOdd string, odd_is_number boolean").select(
        "*", F.lit("T" * 100).alias("tournament"), F.lit(1).cast("bigint").alias("betRadarID"), F.lit("E").alias("event"))
    out = normalise_quotes(df, dictionaries.label_dictionary(spark)).persist()
    good = sorted((r.bookmaker, r.bet, r.betOdd) for r in accepted(out).collect())
    assert good == [
        ("888Sport", "1X2 <> X", Decimal("1.00")),
        ("888Sport", "DOPPIA CHANCE IN/OUT <> 12", Decimal("2.00")),
        ("SportPesa", "1X2 <> 1", Decimal("1.85")),
        ("SportPesa", "1X2 <> 2", Decimal("1.86")),
    ]
    assert reasons(out) == ["price"]
    assert {len(r.tournament) for r in out.collect()} == {80}


def test_dictionaries(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text('"U/O 0,5 <> Ov.0,5",first\nb,x\n"U/O 0,5 <> Ov.0,5",last\n')
    got = dictionaries.read_dictionary(spark, str(path), "labels").collect()
    assert sorted(map(tuple, got)) == [("U/O 0,5 <> Ov.0,5", "last"), ("b", "x")]
    path.write_text('"a ""b"", c",d\n')
    assert dictionaries.read_dictionary(spark, str(path), "labels").first().original == 'a "b", c'
    allowed = {r.bet for r in dictionaries.allowed_labels(spark).collect()}
    two = dictionaries.two_way_counters(spark)
    assert len(allowed) == 24 and two.count() == 20
    assert two.where(F.col("bet").isin(list(allowed))).count() == 10
    fixed = dictionaries.two_way_counters(spark, "corrected")
    assert fixed.where(F.col("bet").isin(list(allowed)) & F.col("counter").isin(list(allowed))).count() == 24
    assert dictionaries.label_dictionary(spark).count() == 110
    assert dictionaries.three_way_counters(spark).count() == 3


@pytest.mark.parametrize("fn", [feeds.parse_flat_feed, feeds.parse_nested_feed, feeds.parse_offer_feed, feeds.parse_map_feed])
def test_parsers_do_not_shuffle(spark, fn):
    plan = fn(pages(spark, {}), RUN)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "PythonUDF" not in plan


def test_sticky_lines(spark):
    df = spark.createDataFrame([([2.5, None, 3.5, None],), ([None, 1.0],), ([None],), ([],), (None,)], "x array<double>")
    got = [r[0] for r in df.select(feeds.sticky_lines(F.col("x"))).collect()]
    assert got == [[2.5, 2.5, 3.5, 3.5], [None, 1.0], [None], [], None]


def test_unreadable_pages_come_with_the_parsed_ones(spark):
    """A broken page gives one row in any feed, a readable one what it gave without it."""
    parsers = {
        "flat": feeds.parse_flat_feed, "nested": feeds.parse_nested_feed, "offer": feeds.parse_offer_feed, "map": feeds.parse_map_feed,
    }
    for feed, parse in parsers.items():
        df = spark.createDataFrame(
            [("T", 1, "<html>"), ("T", 2, None), ("T", 3, ""), ("T", 4, '{"x'), ("T", 5, "[]"), ("T", 6, "{}")],
            "tournament string, page int, payload string",
        )
        alone = feeds.unreadable_pages(df, feed)
        found = parse(df, RUN, unreadable=True)
        assert sorted((r.page, r.reason) for r in found.collect()) == sorted((r.page, r.reason) for r in alone.collect())
        assert found.columns == parse(df, RUN).columns
        assert parse(df, RUN).count() == 0


def test_one_parse_per_feed(spark):
    from catalogue.feeds import broken_feeds
    from pricematch.operators.shape import union_feeds
    from pricematch.plans.runs import collect_once, collect_quotes
    from pricematch.session import scratch_path

    parsed = broken_feeds(spark, "/root/testdata/sf0.001")
    marked = normalise_quotes(union_feeds(*parsed), dictionaries.label_dictionary(spark), keep_rejects=True)
    plan = marked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == len(parsed)
    quotes, bad, counts = collect_once(spark, scratch_path(spark, "one-parse"), *parsed)
    want, want_bad = collect_quotes(spark, *parsed)
    assert sorted(map(repr, quotes.collect())) == sorted(map(repr, want.collect()))
    by = lambda df: {r.reason: r["count"] for r in df.groupBy("reason").count().collect()}
    assert by(bad) == by(want_bad) == {k: n for k, n in counts.items() if k not in ("rows", "rejects")}
    assert counts["rejects"] == bad.count()


def test_collect_once_counts_prices_and_unlisted_reasons(spark):
    from pricematch.plans.runs import collect_once
    from pricematch.session import scratch_path

    df = spark.createDataFrame(
        [("B", "T", 1, "A - B", "1X2 <> 1", "abc", None, 1, [1]), ("B", "T", None, "A - B", "1X2 <> 1", "1.50", None, 2, [1]),
         ("B", "T", 1, "A - B", "1X2 <> 1", "1.50", None, 3, [1]), ("B", "T", 1, "A - B", "1X2 <> 1", "1.60", None, 3, [2]),
         ("B", "T", 1, "A - B", "not allowed", "1.60", None, 4, [1]), ("B", "T", 1, None, None, None, "own reason", 5, [1])],
        "bookmaker string, tournament string, betRadarID long, event string, bet string, betOdd string, reason string, "
        "ingest_seq int, position array<int>",
    ).withColumn("date", F.lit("2021-03-02").cast("timestamp_ntz"))
    base = scratch_path(spark, "collect-once")
    for _ in range(2):  # written again, it replaces itself
        quotes, bad, counts = collect_once(spark, base, df)
        assert [(str(r.betOdd), r.bet) for r in quotes.collect()] == [("1.50", "1X2 <> 1")]
        assert counts == {"rows": 5, "rejects": 3, "price": 1, "no betRadarID": 1, "other": 1}
        assert sorted(r.reason for r in bad.collect()) == ["no betRadarID", "own reason", "price"]


@pytest.mark.parametrize("feed", ["flat", "nested", "offer"])
def test_deep_schedule_on_two_levels(spark, feed):
    """On trees of two levels the deep form finds what the plain one does."""
    from catalogue import payloads

    df = payloads.schedule(payloads.orders(spark, "/root/testdata/sf0.001"), feed)
    want = feeds.flatten_schedule(df, feed, with_counts=True)
    got = feeds.flatten_schedule_deep(df, feed, with_counts=True)
    assert got.where("reason is not null").count() == 0
    plain = lambda x: sorted(map(repr, x.select(want.columns).collect()))
    assert plain(got) == plain(want) and plain(want)


def test_deep_schedule_odd_pages(spark):
    deep = None
    for i in range(30, 0, -1):
        deep = {"termKey": f"N{i}", "eventCount": 50, "groups": [deep] if deep else None}
    cases = [
        (1, json.dumps({"group": {"groups": [{"groups": [deep]}]}})),
        (2, None), (3, ""), (4, "[1"),
        (5, "{}"), (6, "[]"), (7, '{"group": 3}'), (8, '{"group": {"groups": [{"groups": []}]}}'),
        (9, '{"group": {"groups": [{"groups": [{"termKey": "A", "eventCount": 11, "groups": []}, {"eventCount": 12, "groups": "x"}, 5]}]}}'),
        (10, '{"group": {"groups": [{"groups": [{"termKey": "[[{{", "eventCount": "many"}]}]}}'),
    ]
    df = spark.createDataFrame(cases, "page int, payload string").withColumn("place", F.lit(1))
    got = feeds.flatten_schedule_deep(df, "offer").orderBy("page", "place").collect()
    assert [(r.page, r.level, r.country, r.tournament, r.reason) for r in got] == [
        (1, 30, "N1", "N30", None),
        (2, None, None, None, "unreadable page"), (3, None, None, None, "unreadable page"), (4, None, None, None, "unreadable page"),
        (9, 1, "A", None, None), (9, 1, None, None, None),
    ]
    assert got[0].path == [f"N{i}" for i in range(1, 31)] and got[0].place == [0] * 30
    plan = feeds.flatten_schedule_deep(df, "offer")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") == 1 and "Exchange" not in plan
    with pytest.raises(ValueError):
        feeds.flatten_schedule_deep(df, "map")

"""Feed payloads that Spark derives from the orders, one page per order.

They have the shape of what the feeds send, so that the parsers can be run over
as many pages as there are orders. Nothing here is part of the library.
"""

from __future__ import annotations

from catalogue.views import iso_text, naive_millis, spread, table
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def order_key() -> Column:
    return F.col("o_orderkey")


def customer() -> Column:
    return F.col("o_custkey")


def start() -> Column:
    return F.col("o_orderdate")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return spread(columns, "o_orderkey")


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def price(step: int) -> Column:
    """A price with two decimals that depends on the customer."""
    return (F.lit(110) + (customer() * step) % 300) / 100


def no_text() -> Column:
    return F.lit(None).cast("string")


def page(df: DataFrame, payload: Column) -> DataFrame:
    """Pages made in a step of their own: as an argument of ``from_json`` a payload would be put together by interpreted expressions."""
    return df.select(
        order_key().alias("ingest_seq"), text("Cup ", order_key() % 10).alias("tournament"),
        F.explode_outer(F.array(F.to_json(payload))).alias("payload"),
    )


def flat(df: DataFrame) -> DataFrame:
    """Two events; of four outcomes the third has no event and the fourth no match."""
    epoch = text("/Date(", naive_millis(start()), "+0100)/")
    event = lambda i, ident, name: F.struct(
        i.alias("Id"), ident.alias("BetRadarId"), name.alias("Name"), epoch.alias("StartDate"))
    outcome = lambda i, kind, name, odd: F.struct(
        i.alias("EventId"), F.struct(F.lit(kind).alias("Name")).alias("Kind"), F.lit(name).alias("Name"), odd.alias("Odds"))
    return page(df, F.struct(
        F.array(
            event(order_key() * 2, order_key() + 1, text("FC Home", customer(), "-A. Away", order_key())),
            event(order_key() * 2 + 1, order_key() + 1, text("Winner of cup ", order_key())),
        ).alias("events"),
        F.array(
            outcome(order_key() * 2, "1X2 Finale", "1", price(1)),
            outcome(order_key() * 2, "U/O 2,5", "Ov.2,5", price(2)),
            outcome(order_key() * 2 + 7, "1X2 Finale", "X", price(3)),
            outcome(order_key() * 2 + 1, "1X2 Finale", "2", price(4)),
        ).alias("eventsOutcome"),
    ))


def nested(df: DataFrame) -> DataFrame:
    """One event: a plain market, one with two lines, an excluded and an unknown one."""
    outcome = lambda label, odd, status=1: F.struct(
        F.lit(status).alias("status"), F.lit(label).alias("label"), odd.alias("val"))
    info = lambda status, **outs: F.struct(
        F.lit(status).alias("status"), F.create_map(*[v for k, o in outs.items() for v in (F.lit(k), o)]).alias("outcome"))
    market = lambda spread, **infos: F.struct(
        F.lit(spread).alias("hasSpread"),
        F.create_map(*[v for k, i in infos.items() for v in (F.lit(k[1:]), i)]).alias("additionalInfos"))
    option = lambda key, display: F.struct(F.lit(key).alias("key"), F.lit(display).alias("display"))
    options = F.create_map(F.lit("a"), option("250", "2.5"), F.lit("b"), option("350", "3.5"))
    head = lambda name, opts: F.struct(F.lit(name).alias("name"), opts.alias("spreadOptions"))
    none = F.lit(None).cast("map<string,struct<key:string,display:string>>")
    bets = F.create_map(
        F.lit("3"), market(False, _0=info(1, a=outcome("X", price(5)), b=outcome("1", price(6), 0))),
        F.lit("14"), market(True, _250=info(1, a=outcome("UNDER", price(7)), b=outcome("OVER", price(8))),
                            _350=info(0, a=outcome("UNDER", price(9)), b=outcome("OVER", price(10)))),
        F.lit("9"), market(False, _0=info(1, a=outcome("SI", price(1)), b=outcome("NO", price(1)))),
        F.lit("77"), market(False, _0=info(1, a=outcome("1", price(1)), b=outcome("2", price(1)))),
    )
    event = F.struct(
        text("FC Home", customer(), " - A. Away", order_key()).alias("name"), iso_text(start() - F.expr("INTERVAL 2 HOURS")).alias("dateTimeUTC"),
        F.struct(F.struct((order_key() + 1).alias("matchId")).alias("BetRadar")).alias("externalReferences"), bets.alias("bets"),
    )
    return page(df, F.struct(
        F.create_map(F.lit("3"), head("1X2", none), F.lit("14"), head("U/O", options),
                     F.lit("9"), head("MARCATORE SI/NO", none)).alias("head"),
        F.create_map(text(order_key(), ".", customer()), event).alias("body"),
    ))


def offer(df: DataFrame) -> DataFrame:
    """One event with fractional prices; a line holds until the next one."""
    outcome = lambda line, label, n, d: F.struct(
        F.lit(line).cast("int").alias("line"), F.lit(label).alias("label"),
        text(n.cast("bigint"), "/", d.cast("bigint")).alias("oddsFractional"))
    n, d = customer() % 30 + 1, order_key() % 16 + 1
    bet = lambda label, *outs: F.struct(F.struct(F.lit(label).alias("label")).alias("criterion"), F.array(*outs).alias("outcomes"))
    return page(df, F.struct(
        F.array(F.struct(
            text("Cup ", order_key() % 10).alias("group"), iso_text(start() - F.expr("INTERVAL 2 HOURS")).alias("start"),
            text("FC Home", customer(), " - A. Away", order_key()).alias("name"))).alias("events"),
        F.array(
            bet("Doppia Chance", outcome(None, "X2", n, d), outcome(None, "12", n + 1, d)),
            bet("Totale gol", outcome(2500, "Over", n, d + 1), outcome(None, "Under", n + 2, d),
                outcome(3500, "Over", n + 3, d), outcome(0, "Under", n + 4, d)),
        ).alias("betOffers"),
    ))


def mapped(df: DataFrame) -> DataFrame:
    """Two events, the second without an id; prices in hundredths."""
    event = lambda code, ident: F.struct(
        iso_text(start() - F.expr("INTERVAL 2 HOURS")).alias("data"), code.alias("codiceAvvenimento"),
        text("FC Home", customer(), " - A. Away", order_key()).alias("descrizione"),
        F.array(F.struct(ident.alias("idAvvProviderLive"))).alias("externalProviderInfoList"))
    cents = lambda step: F.lit(110) + (customer() * step) % 300
    market = lambda code, kind, *outs: F.struct(
        code.alias("codiceAvvenimento"), F.lit(kind).alias("descrizione"),
        F.array(*[F.struct(F.lit(o).alias("descrizione"), c.alias("quota")) for o, c in outs]).alias("esitoList"))
    return page(df, F.struct(
        F.array(event(order_key() * 2, order_key() + 1), event(order_key() * 2 + 1, F.lit(0).cast("bigint"))).alias("avvenimentoFeList"),
        F.create_map(
            F.lit("a"), market(order_key() * 2, "1X2 ESITO FINALE", ("1", cents(3)), ("X", cents(4)), ("2", cents(5))),
            F.lit("b"), market(order_key() * 2 + 1, "1X2 ESITO FINALE", ("1", cents(5))),
        ).alias("infoAggiuntivaMap"),
    ))


def html(pages: DataFrame) -> DataFrame:
    """Each given page with two coupon rows put in after its own markup."""
    key = F.col("page_id")
    row = lambda name, date, *spans: F.concat(
        F.lit('<div class="bg coupon-row" data-event-name="'), name, F.lit('"><table><tr><td class="date">'), date,
        F.lit("</td>"), *spans, F.lit("</tr></table></div>"))
    span = lambda label, odd: F.concat(
        F.lit(f'<td class="height-column-with-price"><span class="p" data-selection-key="{label}">'), odd, F.lit("</span></td>"))
    odd = text("1.", F.lpad((key % 100).cast("string"), 2, "0"))
    rows = F.concat(
        row(text("FC Home", key, " vs A. Away", key + 1), text("27 Apr 2021 12:", F.lpad((key % 60).cast("string"), 2, "0")),
            span("1X2 &lt;&gt; 1", odd), span("1X2 &lt;&gt; X", text(key % 7 + 1, "/4"))),
        row(text("Winner ", key), F.lit("23:00"), span("1X2 &lt;&gt; 2", odd)),
    )
    return pages.select("page_id", F.concat("html", rows).alias("html"))


def schedule(df: DataFrame, feed: str) -> DataFrame:
    """A schedule page per order with three tournaments."""
    name = lambda i: text("Cup ", order_key(), "/", F.lit(i))
    if feed == "flat":
        t = lambda i: F.struct((order_key() * 3 + i).alias("Id"), name(i).alias("Name"))
        country = lambda *ts: F.struct(F.array(*ts).alias("Children"))
        payload = F.array(F.struct(F.array(country(t(0), t(1)), country(t(2))).alias("Children")))
    elif feed == "nested":
        t = lambda i: F.struct(
            F.lit("1").alias("sportCode"), (order_key() * 3 + i).alias("id"), name(i).alias("name"), F.lit("b").alias("betCode"),
            F.lit("s").alias("betSection"), F.create_map(F.lit("x"), customer() % 2, F.lit("y"), F.lit(i).cast("bigint")).alias("eventsCounter"))
        country = lambda *ts: F.struct(F.create_map(*[v for i, x in enumerate(ts) for v in (F.lit(str(i)), x)]).alias("tournaments"))
        football = F.struct(F.create_map(F.lit("it"), country(t(0), t(1)), F.lit("fr"), country(t(2))).alias("categories"))
        payload = F.struct(F.create_map(F.lit("1"), football).alias("sports"))
    elif feed == "offer":
        t = lambda i: F.struct(name(i).alias("termKey"), (customer() % 9 + 4 * i).alias("eventCount"))
        country = lambda i, n, *ts: F.struct(
            text("C", order_key(), "/", F.lit(i)).alias("termKey"), n.alias("eventCount"),
            (F.array(*ts) if ts else F.lit(None).cast("array<struct<termKey:string,eventCount:bigint>>")).alias("groups"))
        football = F.struct(F.array(country(0, F.lit(99).cast("bigint"), t(0), t(1), t(2)), country(1, customer() % 20)).alias("groups"))
        payload = F.struct(F.struct(F.array(football).alias("groups")).alias("group"))
    else:
        ids = [text(order_key() * 3 + i) for i in range(3)]
        t = lambda i: F.struct((F.lit(i) == 0).alias("topManifestazione"), name(i).alias("descrizione"))
        payload = F.struct(
            F.create_map(F.lit("1"), F.array(*ids)).alias("manifestazioneListByDisciplinaTutti"),
            F.create_map(*[v for i, k in enumerate(ids) for v in (k, t(i))]).alias("manifestazioneMap"),
            F.create_map(*[v for i, k in enumerate(ids) for v in (k, customer() % 2 + i)]).alias("eventsNumberByManifestazioneTutti"),
        )
    return df.select(order_key().alias("page"), F.to_json(payload).alias("payload"))


def deep_schedule(df: DataFrame, feed: str) -> DataFrame:
    """A schedule page per order whose tree goes down one to four levels.

    Every inner node has a tournament beside the next node. Some pages are cut off, some list no country.
    """
    def leaf(level: int, place: str) -> Column:
        name = text("Cup ", order_key(), f"/{level}{place}")
        if feed == "flat":
            return text('{"Id":', order_key() * 10 + level, ',"Name":"', name, '","Children":[]}')
        if feed == "nested":
            return text('{"name":"', name, '","id":', order_key(), ',"eventsCounter":{"x":', customer() % 2, f',"y":{level}}}}}')
        return text('{"termKey":"', name, '","eventCount":', customer() % 9 + 4 * level, "}")

    def branch(level: int) -> Column:
        if level == 4:
            return leaf(4, "")
        inner, area = branch(level + 1), text("Area ", order_key(), f"/{level}")
        if feed == "flat":
            node = text('{"Id":0,"Name":"', area, '","Children":[', leaf(level + 1, "a"), ",", inner, "]}")
        elif feed == "nested":
            key = "categories" if level % 2 == 0 else "tournaments"
            node = text('{"name":"', area, f'","{key}":{{"a":', leaf(level + 1, "a"), ',"b":', inner, "}}")
        else:
            node = text('{"termKey":"', area, '","eventCount":99,"groups":[', leaf(level + 1, "a"), ",", inner, "]}")
        return F.when(order_key() % 4 + 1 == level, leaf(level, "")).otherwise(node)

    tree = F.when(order_key() % 10 == 3, "").otherwise(branch(1))
    if feed == "flat":
        payload = text('[{"Children":[', tree, "]}]")
    elif feed == "nested":
        payload = text('{"sports":{"1":{"categories":{', F.when(tree != "", F.concat(F.lit('"it":'), tree)).otherwise(""), "}}}}")
    else:
        payload = text('{"group":{"groups":[{"groups":[', tree, "]}]}}")
    payload = F.when(order_key() % 10 == 7, F.left(payload, F.char_length(payload) - 2)).otherwise(payload)
    return df.select(order_key().alias("page"), payload.alias("payload"))


def event_list(df: DataFrame, feed: str) -> DataFrame:
    """A tournament page per order with two events, one of them live."""
    if feed == "nested":
        live = lambda status: F.struct(status.alias("liveStatus"))
        payload = F.struct(F.create_map(
            text(order_key(), ".1.", customer()), live(no_text()), text(order_key(), ".2"), live(F.lit("LIVE"))).alias("body"))
    else:
        event = lambda i: F.struct(F.struct(i.alias("id")).alias("event"))
        payload = F.struct(F.array(event(order_key() * 2), event(order_key() * 2 + 1)).alias("events"))
    return df.select(order_key().alias("page"), F.to_json(payload).alias("payload"))

"""Feed payloads to raw quotes.

A parser takes (source, tournament, payload) and returns one row per price with
a ``reason`` on those the feed got wrong. It only explodes arrays inside the
row, so it never shuffles and serves batch and stream alike. ``betOdd`` stays
text, with ``odd_is_number`` where the feed sends a JSON number. ``position`` is
the price's place in its page; arrays compare from the left, so it puts the
prices of a page in their order. With ``unreadable`` a page that is not JSON of the
feed's form gives one row, with that reason; without, it gives none.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from pricematch import schemas
from pricematch.fixed_values import MIN_EVENTS, NO_ID
from pricematch.functions.dates import naive_timestamp, parse_epoch_date, parse_iso_date
from pricematch.functions.labels import compose_label, line_suffix
from pricematch.functions.names import normalise_event
from pricematch.functions.odds import odds_from_cents
from pricematch.operators.filters import has_excluded_word
from pricematch.operators.normalise import REASON
from pricematch.operators.shape import sum_map_values

RAW_COLUMNS = [
    "tournament", "betRadarID", "event", "date", "bet", "betOdd", "odd_is_number", "position",
]


LOST = "__lost"
UNREADABLE = "unreadable page"


def _page(df: DataFrame, schema: str, lost: bool = False) -> DataFrame:
    """The payload read; with ``lost``, also whether nothing of the feed's form was found in it."""
    page = df.withColumn("__page", F.from_json("payload", schema)).drop("payload")
    return page.withColumn(LOST, _nothing(page)) if lost else page


def _nothing(page: DataFrame) -> Column:
    """Whether no field of the page was read."""
    fields = [F.col(f"__page.{name}") for name in page.schema["__page"].dataType.fieldNames()]
    return F.coalesce(*[F.when(f.isNotNull(), True) for f in fields]).isNull()


def _or_lost(kept: list[str], when: Column) -> Column:
    """Rows that stay: those that meet ``when``, and pages that could not be read."""
    return when | F.col(LOST) if LOST in kept else when


def _carried(df: DataFrame, drop: tuple[str, ...] = ()) -> list[str]:
    """Columns of the input that are passed through."""
    own = {*RAW_COLUMNS, "payload", "__page", "reason", LOST, *drop}
    return [c for c in df.columns if c not in own]


def _with_matches(page: DataFrame, events: Column, key: str) -> DataFrame:
    """Add the page's events as a map ``matches``; the last of a repeated key wins.

    Duplicates go first, as a map refuses them. Each step has a column of its own,
    used twice by the next, so that none is inlined into a lambda and run again
    for every element.
    """
    page = page.withColumn("__events", events)
    page = page.withColumn("__keys", F.reverse(F.transform("__events", lambda e: e[key])))
    last = F.filter(
        "__events", lambda e, i: F.array_position("__keys", e[key]) == F.size("__keys") - i
    )
    entries = F.transform(last, lambda e: F.struct(e[key], e))
    return page.withColumn("matches", F.map_from_entries(entries)).drop("__events", "__keys")


PAGES = {
    "flat": schemas.FLAT_PAGE,
    "nested": schemas.NESTED_PAGE,
    "offer": schemas.OFFER_PAGE,
    "map": schemas.MAP_PAGE,
}


def unreadable_pages(df: DataFrame, feed: str) -> DataFrame:
    """Pages that are not JSON of the feed's form, for the quarantine.

    The parsers find nothing in them, or with ``unreadable=True`` give a row for each, so that the page is parsed
    once. A page that says nothing reads ``{}``.

    A filter on the page itself would read it once for each field, and be pushed below a ``repartition`` that deals the
    pages to all tasks, to where they lie in few. One on what was exploded stays above.
    """
    page = df.select("*", F.explode_outer(F.array(F.from_json("payload", PAGES[feed]))).alias("__page"))
    return page.where(_nothing(page)).drop("__page").withColumn(REASON, F.lit(UNREADABLE))


def each(
    df: DataFrame, kept: list[str], items: Column | str, *names: str, at: str | None = None
) -> DataFrame:
    """A row per item of an array, or per entry of a map; ``at`` names its place.

    An inner explode would make the optimizer infer a filter on the array, push it
    below the parsing, and so parse every page once more for it.
    """
    rows = F.posexplode_outer(items).alias(at, *names) if at else F.explode_outer(items).alias(*names)
    return df.select(*kept, rows).where(_or_lost(kept, F.col(names[0]).isNotNull()))


def _finish(
    rows: DataFrame, kept: list[str], number: bool, position: list[str], *reasons: tuple[str, Column]
) -> DataFrame:
    """Raw columns and the first reason that holds.

    Columns the reasons look at come first, in a step of their own: used twice,
    they are computed once.
    """
    reason = None
    if LOST in kept:
        kept = [c for c in kept if c != LOST]
        reasons = ((UNREADABLE, F.col(LOST)), *reasons)
    for text, when in reasons:
        reason = F.when(when, text) if reason is None else reason.when(when, text)
    return rows.select(
        *kept,
        "tournament",
        F.col("betRadarID").try_cast("bigint").alias("betRadarID"),
        "event",
        "date",
        "bet",
        "betOdd",
        F.lit(number).alias("odd_is_number"),
        F.array(*position).alias("position"),
        reason.alias(REASON),
    )


def events_to_outcomes(outcomes: DataFrame, matches: str, key: Column) -> DataFrame:
    """Look an outcome's event up in its page's own map: no join, no shuffle."""
    return outcomes.withColumn("match", F.try_element_at(F.col(matches), key)).drop(matches)


def parse_flat_feed(
    df: DataFrame, run_ts: datetime | Column, splitter: str = "-", zone: str = "UTC",
    numeric_odds: bool = True, unreadable: bool = False,
) -> DataFrame:
    """Events and outcomes side by side, joined on the event id."""
    now = naive_timestamp(run_ts)
    kept = _carried(df) + [LOST] * unreadable
    # Names are the dearest to work out, so events that are not listed go first.
    listed = F.filter(
        F.transform(
            F.col("__page.events"),
            lambda e: F.struct(
                e["Id"].alias("Id"),
                e["BetRadarId"].alias("ident"),
                e["Name"].alias("name"),
                parse_epoch_date(e["StartDate"], zone).alias("date"),
            ),
        ),
        lambda e: (e["date"] > now) & e["Id"].isNotNull(),
    )
    events = F.transform(
        listed,
        lambda e: F.struct(
            e["Id"].alias("Id"), e["ident"].alias("ident"),
            normalise_event(e["name"], splitter).alias("event"), e["date"].alias("date"),
        ),
    )
    page = _with_matches(_page(df, schemas.FLAT_PAGE, unreadable), events, "Id")
    rows = each(page, [*kept, "tournament", "matches"], "__page.eventsOutcome", "o", at="i")
    rows = events_to_outcomes(rows, "matches", F.col("o.EventId")).select(
        *kept, "tournament", "match", "i", F.col("match.ident").alias("betRadarID"),
        F.col("match.event").alias("event"), F.col("match.date").alias("date"),
        compose_label(F.col("o.Kind.Name"), F.col("o.Name")).alias("bet"),
        F.col("o.Odds").alias("betOdd"),
    )
    return _finish(
        rows, kept, numeric_odds, ["i"],
        ("event not listed or started", F.col("match").isNull()),
        ("not a match", F.col("event").isNull()),
        ("no label", F.col("bet").isNull()),
    )


def head_to_body(head: Column, code: Column) -> Column:
    """The market type an odds entry's code stands for."""
    return F.try_element_at(head, code)


def parse_nested_feed(
    df: DataFrame, run_ts: datetime | Column, splitter: str = " - ",
    tz_mode: str = "fixed_plus_2", numeric_odds: bool = True, unreadable: bool = False,
) -> DataFrame:
    """Market types in a head, event > market > line > outcome in a body.

    Started events and excluded types are left out. A market with an unknown code
    or line is put to quarantine alone; its event's other markets go on. Given an
    ``event_key`` column, only that event of the page is read.
    """
    now = naive_timestamp(run_ts)
    kept = _carried(df, ("event_key",)) + [LOST] * unreadable
    page = _page(df, schemas.NESTED_PAGE, unreadable).withColumn("head", F.col("__page.head"))
    asked = ["event_key"] if "event_key" in df.columns else []
    events = each(page, [*kept, *asked, "tournament", "head"], "__page.body", "key", "e", at="i")
    if asked:
        events = events.where(_or_lost(kept, F.col("key") == F.col("event_key")))
    events = events.select(
        *kept, "tournament", "head", "i", F.col("e.bets").alias("bets"),
        F.col("e.externalReferences.BetRadar").alias("ref"),
        normalise_event(F.col("e.name"), splitter).alias("event"),
        parse_iso_date(F.col("e.dateTimeUTC"), tz_mode).alias("date"),
    ).where(F.col("date").isNull() | (F.col("date") >= now))

    event = [*kept, "tournament", "event", "date", "ref", "i"]
    markets = each(events, [*event, "head"], "bets", "code", "m", at="j").select(
        *event, "j", head_to_body(F.col("head"), F.col("code")).alias("type"), "m"
    ).where(_or_lost(kept, ~has_excluded_word(F.col("type.name"))))

    infos = F.col("m.additionalInfos")
    only = F.try_element_at(infos, F.lit("0"))
    no_line = F.lit(None).cast("string")
    lines = F.when(
        ~F.coalesce(F.col("m.hasSpread"), F.lit(False)) & (only["status"] == 1),
        F.array(F.struct(no_line.alias("spread"), only.alias("info"))),
    ).otherwise(
        F.transform(
            F.map_values(F.col("type.spreadOptions")),
            lambda s: F.struct(
                s["display"].alias("spread"), F.try_element_at(infos, s["key"]).alias("info")
            ),
        )
    )
    # A market whose lines cannot be told keeps one row, for the quarantine.
    market = [*event, "j", "type"]
    rows = markets.select(*event, "j", F.col("type.name").alias("type"), lines.alias("lines"))
    rows = rows.select(*market, "lines", F.col("lines").isNull().alias("lost"))
    rows = rows.select(*market, "lost", F.posexplode_outer("lines").alias("k", "l")).where(
        F.col("lost") | F.col("l.info").isNull() | (F.col("l.info.status") == 1)
    )
    rows = rows.select(
        *market, "lost", "k",
        F.col("l.spread").alias("spread"),
        (F.col("l").isNotNull() & F.col("l.info").isNull()).alias("no_info"),
        F.posexplode_outer(F.map_values("l.info.outcome")).alias("n", "o"),
    ).where(F.col("lost") | F.col("no_info") | (F.col("o.status") == 1))
    rows = rows.select(
        *market, "lost", "no_info", "k", "n",
        F.col("ref.matchId").alias("betRadarID"),
        compose_label(F.col("type"), F.col("o.label"), F.col("spread")).alias("bet"),
        F.col("o.val").alias("betOdd"),
    )
    return _finish(
        rows, kept, numeric_odds, ["i", "j", "k", "n"],
        ("not a match", F.col("event").isNull()),
        ("no date", F.col("date").isNull()),
        ("no event id", F.col("ref").isNull()),
        ("unknown market or line", F.col("lost") | F.col("no_info") | F.col("type").isNull()),
        ("no label", F.col("bet").isNull()),
    )


def own_lines(outcomes: Column) -> Column:
    """The line of each outcome; 0 counts as none."""
    return F.transform(outcomes, lambda o: F.nullif(o["line"], F.lit(0.0)))


def sticky_lines(lines: Column) -> Column:
    """For each outcome its own line, or else that of the nearest outcome before it.

    The places of own lines cut the offer into runs, each of which repeats one line: every
    outcome is written once, however long the offer is.
    """
    def runs(own: Column) -> Column:
        places = F.filter(F.transform(own, lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull())

        def filled(at: Column) -> Column:
            head = F.array_repeat(F.lit(None).cast("double"), F.coalesce(F.get(at, 0), F.size(own)))
            rest = F.transform(at, lambda p, k: F.array_repeat(F.get(own, p), F.coalesce(F.get(at, k + 1), F.size(own)) - p))
            return F.concat(head, F.flatten(rest))

        return F.transform(F.array(places), filled)[0]

    return F.transform(F.array(lines), runs)[0]


def parse_offer_feed(
    df: DataFrame, run_ts: datetime | Column, splitter: str = " - ", tz_mode: str = "fixed_plus_2",
    unreadable: bool = False,
) -> DataFrame:
    """One event with its offers. It has no shared id, and fractional prices.

    A line labels its outcome and those after it in the offer, up to the next.
    """
    now = naive_timestamp(run_ts)
    kept = _carried(df, ("tournament",)) + [LOST] * unreadable
    first = F.get(F.col("__page.events"), 0)
    events = _page(df, schemas.OFFER_PAGE, unreadable).select(
        *kept,
        first["group"].alias("tournament"),
        normalise_event(first["name"], splitter).alias("event"),
        parse_iso_date(first["start"], tz_mode).alias("date"),
        F.col("__page.betOffers").alias("offers"),
    )
    event = [*kept, "tournament", "event", "date"]
    started = F.coalesce(F.col("date") < now, F.lit(False))
    offers = each(events, event, F.when(~started, F.col("offers")), "b", at="i").select(
        *event, "i", F.col("b.criterion.label").alias("type"),
        F.arrays_zip(
            F.col("b.outcomes").alias("o"), sticky_lines(own_lines(F.col("b.outcomes"))).alias("line")
        ).alias("outcomes"),
    )
    offer = [*event, "i", "type"]
    rows = each(offers, offer, "outcomes", "z", at="j").select(*offer, "j", "z.o", "z.line")
    suffix = F.when(F.col("line").isNotNull(), line_suffix(F.col("line")))
    rows = rows.select(*offer, "j", "o", suffix.alias("suffix")).select(
        *event, "i", "j",
        F.lit(NO_ID).alias("betRadarID"),
        compose_label(F.col("type"), F.col("o.label"), F.col("suffix")).alias("bet"),
        F.col("o.oddsFractional").alias("betOdd"),
    )
    return _finish(
        rows, kept, False, ["i", "j"],
        ("not a match", F.col("event").isNull()),
        ("no date", F.col("date").isNull()),
        ("no label", F.col("bet").isNull()),
    )


def parse_map_feed(
    df: DataFrame, run_ts: datetime | Column, splitter: str = " - ", tz_mode: str = "fixed_plus_2",
    unreadable: bool = False,
) -> DataFrame:
    """Events in a list, their markets in a map, prices in hundredths.

    Events without a shared id, or with id 0, cannot be quoted.
    """
    now = naive_timestamp(run_ts)
    # Names are the dearest to work out, so events that are not listed go first.
    listed = F.filter(
        F.transform(
            F.col("__page.avvenimentoFeList"),
            lambda e: F.struct(
                e["codiceAvvenimento"].alias("code"),
                F.get(e["externalProviderInfoList"], 0)["idAvvProviderLive"].try_cast("bigint").alias("ident"),
                e["descrizione"].alias("name"),
                parse_iso_date(e["data"], tz_mode).alias("date"),
            ),
        ),
        lambda e: (e["date"] > now) & (e["ident"] != 0) & e["code"].isNotNull(),
    )
    events = F.filter(
        F.transform(
            listed,
            lambda e: F.struct(
                e["code"].alias("code"), e["ident"].alias("ident"),
                normalise_event(e["name"], splitter).alias("event"), e["date"].alias("date"),
            ),
        ),
        lambda e: e["event"].isNotNull(),
    )
    kept = _carried(df) + [LOST] * unreadable
    page = _with_matches(_page(df, schemas.MAP_PAGE, unreadable), events, "code")
    rows = each(
        page, [*kept, "tournament", "matches"], F.map_values("__page.infoAggiuntivaMap"), "m", at="i"
    )
    rows = events_to_outcomes(rows, "matches", F.col("m.codiceAvvenimento")).select(
        *kept, "tournament", "match", "i", F.col("m.descrizione").alias("type"),
        F.col("m.esitoList").alias("outcomes"),
    )
    rows = each(rows, [*kept, "tournament", "match", "i", "type"], "outcomes", "o", at="j").select(
        *kept, "tournament", "match", "i", "j",
        F.col("match.ident").alias("betRadarID"),
        F.col("match.event").alias("event"),
        F.col("match.date").alias("date"),
        compose_label(F.col("type"), F.col("o.descrizione")).alias("bet"),
        odds_from_cents(F.col("o.quota")).cast("string").alias("betOdd"),
    )
    return _finish(
        rows, kept, False, ["i", "j"],
        ("event not listed or started", F.col("match").isNull()),
        ("no label", F.col("bet").isNull()),
        ("price", F.col("betOdd").isNull()),
    )


def flatten_schedule(df: DataFrame, feed: str, with_counts: bool = False) -> DataFrame:
    """Schedule tree to tournaments.

    ``flat`` gives (id, name); ``nested`` and ``map`` also filter on the number of
    events; ``offer`` gives the country key and, below it, the tournament key,
    which is null where a country has no tournaments of its own.
    """
    kept = [c for c in df.columns if c != "payload"]
    page = lambda schema: _page(df, schema)
    if feed == "flat":
        football = F.get(F.col("__page"), 0)["Children"]
        countries = each(page(schemas.FLAT_SCHEDULE), kept, football, "c")
        return each(countries, kept, "c.Children", "t").select(
            *kept, F.col("t.Id").alias("tournament_id"), F.col("t.Name").alias("tournament")
        )
    if feed == "nested":
        football = F.try_element_at(F.col("__page.sports"), F.lit("1"))
        countries = each(
            page(schemas.NESTED_SCHEDULE), kept, F.map_values(football["categories"]), "c"
        )
        rows = each(countries, kept, F.map_values("c.tournaments"), "t").select(
            *kept, F.col("t.sportCode").alias("sport_code"), F.col("t.id").alias("tournament_id"),
            F.col("t.name").alias("tournament"), F.col("t.betCode").alias("bet_code"),
            F.col("t.betSection").alias("bet_section"),
            sum_map_values(F.col("t.eventsCounter")).alias("events"),
        )
    elif feed == "offer":
        football = F.get(F.col("__page")["group"]["groups"], 0)
        countries = each(page(schemas.OFFER_SCHEDULE), kept, football["groups"], "c")
        leaf = F.array(
            F.struct(F.lit(None).cast("string").alias("termKey"), F.col("c.eventCount").alias("eventCount"))
        )
        below = F.when(F.size("c.groups") > 0, F.col("c.groups")).otherwise(leaf)
        countries = countries.select(*kept, F.col("c.termKey").alias("country"), below.alias("below"))
        rows = each(countries, [*kept, "country"], "below", "t").select(
            *kept, "country", F.col("t.termKey").alias("tournament"), F.col("t.eventCount").alias("events")
        )
    elif feed == "map":
        parsed = page(schemas.MAP_SCHEDULE).select(
            *kept, F.col("__page.manifestazioneMap").alias("names"),
            F.col("__page.eventsNumberByManifestazioneTutti").alias("counts"),
            F.try_element_at(
                F.col("__page.manifestazioneListByDisciplinaTutti"), F.lit("1")
            ).alias("football"),
        )
        ids = each(parsed, [*kept, "names", "counts"], "football", "tournament_id")
        rows = ids.select(
            *kept, "tournament_id",
            F.try_element_at("names", F.col("tournament_id")).alias("t"),
            F.try_element_at("counts", F.col("tournament_id")).alias("events"),
        ).select(
            *kept, "tournament_id", F.col("t.descrizione").alias("tournament"),
            F.coalesce(F.col("t.topManifestazione"), F.lit(False)).alias("top"), "events",
        )
    else:
        raise ValueError(f"no feed family {feed!r}")
    enough = F.col("events") > MIN_EVENTS[feed]
    rows = rows.where(F.col("top") | enough if feed == "map" else enough)
    return rows if with_counts else rows.drop("events")


def _children(node: Column, feed: str) -> Column:
    """What lies below a node of a schedule tree, as an array of variants; null or empty for a leaf."""
    many = lambda path, kind: F.try_variant_get(node, path, kind)
    if feed == "nested":
        below = [F.map_values(many(f"$.{key}", "map<string,variant>")) for key in ("categories", "tournaments")]
        return F.coalesce(*below)
    return many({"flat": "$.Children", "offer": "$.groups"}[feed], "array<variant>")


_TREE_ROOT = {"flat": "$[0]", "nested": "$.sports['1']", "offer": "$.group.groups[0]"}
_TREE_NAME = {"flat": "$.Name", "nested": "$.name", "offer": "$.termKey"}


def tree_leaves(root: Column, feed: str, most_levels: Column) -> Column:
    """The leaves below ``root`` as an array of (path, place, node), whatever levels they lie on.

    One fold over levels: ``open`` has the nodes of a level, of which those without children are leaves. ``place`` is
    the path of indexes from the root, so that sorting by it gives the order of the page. Levels after the last one
    change nothing, so ``most_levels`` may be any upper bound. No row is exploded until the leaves are known, and
    nothing is shuffled. A root without children has no leaves.
    """
    kind = "array<struct<path:array<string>,place:array<int>,node:variant>>"
    none = F.array().cast(kind)
    name = lambda node: F.try_variant_get(node, _TREE_NAME[feed], "string")

    def below(parent: Column) -> Column:
        return F.transform(
            F.coalesce(_children(parent["node"], feed), F.array().cast("array<variant>")),
            lambda c, i: F.struct(
                F.concat(parent["path"], F.array(name(c))).alias("path"),
                F.concat(parent["place"], F.array(i)).alias("place"), c.alias("node"),
            ),
        )

    def level(state: Column, _: Column) -> Column:
        found = F.transform(state["open"], lambda n: F.struct(n.alias("n"), below(n).alias("below")))
        step = F.transform(F.array(found), lambda f: F.struct(
            F.flatten(F.transform(f, lambda x: x["below"])).alias("open"),
            F.concat(state["leaves"], F.transform(
                F.filter(f, lambda x: (F.size(x["below"]) == 0) & (F.size(x["n"]["place"]) > 0)), lambda x: x["n"]
            )).alias("leaves"),
        ))[0]
        return F.when(F.size(state["open"]) > 0, step).otherwise(state)

    top = F.array(F.struct(F.array().cast("array<string>").alias("path"), F.array().cast("array<int>").alias("place"),
                           root.alias("node"))).cast(kind)
    start = F.struct(F.when(root.isNotNull(), top).otherwise(none).alias("open"), none.alias("leaves"))
    return F.aggregate(F.sequence(F.lit(0), most_levels), start, level, lambda s: s["leaves"])


def flatten_schedule_deep(df: DataFrame, feed: str, with_counts: bool = False) -> DataFrame:
    """Schedule tree of any depth to its leaves, a page that is no JSON to one row with a reason.

    The trees of ``flat``, ``nested`` and ``offer`` pages (``map`` pages have none). ``path`` has the names from the
    country to the leaf, which is last; ``place`` their indexes; ``level`` its depth. A node without children, or with
    an empty list of them, is a tournament on whatever level it lies. Filters on counts are those of ``flatten_schedule``.
    A page without the sport has no rows; neither has a sport without children.
    """
    if feed not in _TREE_ROOT:
        raise ValueError(f"no tree in pages of feed family {feed!r}")
    kept = [c for c in df.columns if c not in ("payload", "path", "place", "level", REASON)]
    # A level opens at least one bracket, so the page has no more levels than opening brackets.
    brackets = F.char_length("payload") - F.char_length(F.translate("payload", "[{", ""))
    page = df.select(*kept, F.try_parse_json("payload").alias("__tree"), F.coalesce(brackets, F.lit(0)).alias("__levels"))
    page = page.select(
        *kept, F.col("__tree").isNull().alias(LOST), "__levels",
        F.try_variant_get("__tree", _TREE_ROOT[feed], "variant").alias("__root"),
    )
    page = page.select(*kept, LOST, tree_leaves(F.col("__root"), feed, F.col("__levels")).alias("__leaves"))
    rows = each(page, [*kept, LOST], "__leaves", "leaf")
    got = lambda path, kind: F.try_variant_get("leaf.node", path, kind)
    common = [*kept, F.col("leaf.path").alias("path"), F.col("leaf.place").alias("place"), F.size("leaf.place").alias("level")]
    reason = F.when(F.col(LOST), UNREADABLE).alias(REASON)
    if feed == "flat":
        return rows.select(*common, got("$.Id", "bigint").alias("tournament_id"), got("$.Name", "string").alias("tournament"), reason)
    if feed == "nested":
        rows = rows.select(
            *common, got("$.sportCode", "string").alias("sport_code"), got("$.id", "bigint").alias("tournament_id"),
            got("$.name", "string").alias("tournament"), got("$.betCode", "string").alias("bet_code"),
            got("$.betSection", "string").alias("bet_section"),
            sum_map_values(got("$.eventsCounter", "map<string,bigint>")).alias("events"), reason,
        )
    else:
        rows = rows.select(
            *common, F.get("leaf.path", F.lit(0)).alias("country"),
            F.when(F.size("leaf.place") > 1, got("$.termKey", "string")).alias("tournament"),
            got("$.eventCount", "bigint").alias("events"), reason,
        )
    rows = rows.where(F.col(REASON).isNotNull() | (F.col("events") > MIN_EVENTS[feed]))
    return rows if with_counts else rows.drop("events")


def list_events(df: DataFrame, feed: str, skip_live: bool = False) -> DataFrame:
    """Tournament page to event keys.

    ``nested`` keys read ``schedule.event``; ``skip_live`` leaves out events with
    a live status. ``offer`` pages list ids.
    """
    kept = [c for c in df.columns if c != "payload"]
    if feed == "nested":
        rows = each(_page(df, schemas.NESTED_EVENT_LIST), kept, "__page.body", "event_key", "e")
        if skip_live:
            rows = rows.where(F.col("e.liveStatus").isNull())
        codes = F.split("event_key", r"\.", 2)
        return rows.select(
            *kept, "event_key", F.get(codes, 0).alias("schedule_code"), F.get(codes, 1).alias("event_code")
        )
    if feed == "offer":
        events = each(_page(df, schemas.OFFER_EVENT_LIST), kept, "__page.events", "e")
        return events.select(*kept, F.col("e.event.id").alias("event_id"))
    raise ValueError(f"no feed family {feed!r}")

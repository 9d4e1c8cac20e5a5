"""Merges, shapes, filters and the run."""
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pricematch import fixed_values as fixed
from pricematch.operators import filters, normalise, shape
from pricematch.sinks import merge, tables

ROWS = [("b", 1, 30), ("a", 1, 10), ("c", 2, 20), ("d", 3, 40)]


@pytest.fixture()
def new(spark):
    return spark.createDataFrame([("x", 1, 9), ("y", 1, 8), ("z", 5, 7), ("w", 5, 6)], "v string, k int, ingest_seq int")


@pytest.fixture()
def target(spark):
    return spark.createDataFrame([("t", 1, 0), ("u", 2, 0)], "v string, k int, ingest_seq int")


def values(df):
    return sorted((r.k, r.v) for r in df.collect())


def test_insert_only_first_wins(target, new):
    assert values(merge.merge_insert_only(target, new, ["k"])) == [(1, "t"), (2, "u"), (5, "w")]
    once = merge.merge_insert_only(target, new, ["k"])
    assert values(merge.merge_insert_only(once, new, ["k"])) == values(once)


def test_replace_last_wins(target, new):
    assert values(merge.merge_replace(target, new, ["k"])) == [(1, "x"), (2, "u"), (5, "z")]


def test_upsert_retains(spark):
    schema = "k int, RTP int, event string, insertingdate timestamp_ntz"
    t0, t1 = datetime(2021, 1, 1), datetime(2021, 1, 2)
    old = spark.createDataFrame([(1, 10, "old", t0), (2, 20, "old", t0)], schema)
    new = spark.createDataFrame([(1, 11, "new", t1), (3, 31, "new", t1)], schema)
    out = merge.upsert_matches(old, new, ["k"], ["RTP", "insertingdate"])
    assert sorted(map(tuple, out.collect())) == [(1, 11, "old", t1), (2, 20, "old", t0), (3, 31, "new", t1)]
    again = merge.upsert_matches(out, new, ["k"], ["RTP", "insertingdate"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))
    kept = merge.purge_stale(out, t1)
    assert sorted(r.k for r in kept.collect()) == [1, 3]


def test_upsert_of_a_key_twice(spark):
    """As if row by row: the last update wins, the first insert's other columns stay."""
    schema = "k int, RTP int, event string, insertingdate timestamp_ntz"
    t0, t1, t2 = datetime(2021, 1, 1), datetime(2021, 1, 2), datetime(2021, 1, 3)
    old = spark.createDataFrame([(1, 10, "old", t0)], schema)
    new = spark.createDataFrame([(1, 11, "a", t1), (1, 9, "b", t2), (2, 20, "c", t2), (2, 30, "d", t1)], schema)
    out = merge.upsert_matches(old, new, ["k"], ["RTP", "insertingdate"])
    assert sorted(map(tuple, out.collect())) == [(1, 9, "old", t2), (2, 20, "d", t2)]


def test_upsert_can_update_to_null(spark):
    old = spark.createDataFrame([(1, 10)], "k int, RTP int")
    new = spark.createDataFrame([(1, None)], "k int, RTP int")
    assert merge.upsert_matches(old, new, ["k"], ["RTP"]).first().RTP is None


def test_purge_grace(spark):
    run = datetime(2021, 1, 1, 12)
    rows = [(s, run - timedelta(seconds=s)) for s in (0, 1, 2, 3)] + [(9, None)]
    df = spark.createDataFrame(rows, "s int, insertingdate timestamp_ntz")
    assert sorted(r.s for r in merge.purge_stale(df, run).collect()) == [0, 1, 2, 9]
    assert sorted(r.s for r in merge.purge_stale(df, run, 0).collect()) == [0, 9]


def test_assert_unique(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")], "k int, v string")
    own, shared = merge.assert_unique(df, ["k"])
    assert sorted(r.v for r in own.collect()) == ["c"]
    assert sorted(r.v for r in shared.collect()) == ["a", "b", "d", "e"]


def test_truncate(spark):
    df = spark.createDataFrame([("x" * 300, "y" * 300, 1)], "event string, bet string, n int")
    row = normalise.truncate_to_width(df).first()
    assert (len(row.event), len(row.bet), row.n) == (120, 60, 1)


def test_tables(spark):
    name = "pricematch_test_quotes"
    tables.reset_table(spark, name, drop=True)
    tables.ensure_table(spark, name, "k int, v string")
    assert tables.ensure_table(spark, name, "k int, v string").count() == 0
    spark.sql(f"INSERT INTO {name} VALUES (1, 'a'), (2, 'b')")
    copy = tables.snapshot(spark.table(name), name + "_copy", ["k"], 4)
    assert copy.count() == 2
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        other = tables.snapshot(spark.table(name), name + "_other", ["k"], 4)
        plan = copy.join(other, "k")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    tables.reset_table(spark, name)
    assert spark.table(name).count() == 0
    for t in (name, name + "_copy", name + "_other"):
        tables.reset_table(spark, t, drop=True)
    assert not spark.catalog.tableExists(name)


def test_quarantine_and_versions(spark, tmp_path):
    df = spark.createDataFrame([(1, "price"), (2, "no date")], "k int, reason string")
    tables.write_quarantine(df, str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).where("reason = 'price'").count() == 1
    base = str(tmp_path / "v")
    tables.write_version(df, base, 3)
    tables.write_version(df.limit(1), base, 3)
    schema = "k int, reason string"
    assert tables.read_version(spark, base, 3, schema).count() == 1
    assert tables.read_version(spark, base, None, schema).count() == 0


def carry(rows):
    out, last = {}, {}
    for p, o, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if v is not None:
            last[p] = v
        out[(p, o)] = last.get(p)
    return out


@pytest.mark.parametrize("chunk", [None, 1, 7, 1000])
def test_carry_forward(spark, chunk):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.randrange(99) if rng.random() < 0.1 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "p string, o int, v int").repartition(5)
    out = shape.carry_forward_label(df, ["p"], ["o"], "v", None if chunk is None else F.floor(F.col("o") / chunk))
    assert {(r.p, r.o): r.v for r in out.collect()} == carry(rows)


def test_dedupe_keep(spark):
    df = spark.createDataFrame(ROWS, "v string, k int, s int")
    assert values(shape.dedupe(df, ["k"], ["s"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert values(shape.dedupe(df, ["k"], ["s"], "last")) == [(1, "b"), (2, "c"), (3, "d")]


def test_filters(spark):
    df = spark.createDataFrame([("HANDICAP 1",), ("handicap",), ("1X2",), (None,), ("TEMPO X + U/O TEMPO Y",)], "t string")
    assert [r.t for r in filters.exclude_types(df, "t").collect()] == ["handicap", "1X2", None]
    labels = spark.createDataFrame([("x MARCATORE y",), ("Angoli",), ("1X2",)], "bet string")
    assert [r.bet for r in filters.not_like_any(labels, "bet", fixed.NOISE_PATTERNS).collect()] == ["1X2"]
    now = datetime(2021, 1, 1)
    dates = spark.createDataFrame([(now,), (datetime(2021, 1, 2),), (None,)], "date timestamp_ntz")
    assert filters.future_only(dates, now, inclusive=False).count() == 1
    assert filters.future_only(dates, now, inclusive=True).count() == 2
    links = spark.createDataFrame([("/it/Football/Italy/Serie+A",), ("/it/Football/Italy",), ("/it/Football/Italy/Outright",),
                                   ("/it/Tennis/Italy/x",), ("/it/Football/Spain/Liga",)], "href string")
    assert filters.link_filter(links).count() == 2
    assert filters.link_filter(links, "Italy/Serie+A").count() == 1


def test_bet_list_is_pushed_down(spark, tmp_path):
    from pricematch.sources.quotes import read_quotes

    path = str(tmp_path / "q")
    spark.createDataFrame([("a", 1)], "bet string, n int").write.parquet(path)
    plan = read_quotes(spark, path, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(bet, [a,b])]" in plan


def test_read_feed(spark, tmp_path):
    from pricematch.sources.quotes import read_feed

    (tmp_path / "a.json").write_text('{"x":\n1}')
    (tmp_path / "b.json").write_text('{"x": 2}')
    whole = read_feed(spark, str(tmp_path), "Sisal")
    assert sorted(r.payload for r in whole.collect()) == ['{"x":\n1}', '{"x": 2}']
    assert whole.columns == ["bookmaker", "source", "ingest_seq", "payload"]
    assert read_feed(spark, str(tmp_path), "Sisal", whole_file=False).count() == 3


def test_pages_get_their_tournament(spark, tmp_path):
    from pricematch.sources.quotes import name_tournaments, read_feed

    (tmp_path / "odds-7.json").write_text("{}")
    (tmp_path / "odds-8.json").write_text("{}")
    listed = spark.createDataFrame([(7, "Serie A"), (9, "Liga")], "tournament_id bigint, tournament string")
    pages = name_tournaments(read_feed(spark, str(tmp_path), "SportPesa"), listed, r"odds-(\d+)\.json")
    assert [(r.tournament, r.payload) for r in pages.collect()] == [("Serie A", "{}")]


def test_ids_meet_along_a_long_chain(spark):
    """Event k has the ids k and k + 1 but for two gaps; one event is everyone's neighbour among the last ids."""
    from pricematch.operators.identity import identity_groups, unify_ids

    rows = [(f"E{k}", 1, i) for k in range(60) for i in (k, k + 1) if k not in (20, 41)]
    rows += [("HOT", 1, i) for i in range(100, 140)] + [(f"P{i}", 2, i) for i in range(100, 140)] + [("P100", 2, 3)]
    rows += [("alone", 1, 500), ("E5", 1, -1), ("nobody", 1, -1), (None, 1, 7), (None, 1, 55), ("E6", None, 30), ("E6", 1, None)]
    df = spark.createDataFrame(rows, "event string, date int, betRadarID long").repartition(5)
    got = {r.betRadarID: r.identity for r in identity_groups(df).collect()}
    want = {i: 0 for i in range(21)} | {i: 21 for i in range(21, 42)} | {i: 42 for i in range(42, 61)} | {i: 0 for i in range(100, 140)} | {500: 500}
    assert got == want
    unified = sorted(map(tuple, unify_ids(df).collect()), key=repr)
    assert unified == sorted(((e, d, {("E5", -1): 0, ("nobody", -1): -1, ("E6", None): None}.get((e, i), want.get(i))) for e, d, i in rows), key=repr)
    assert identity_groups(df.limit(0)).count() == 0


def test_carry_forward_needs_no_stretches(spark):
    import random

    from pricematch.operators.shape import carry_forward_label

    rng = random.Random(2)
    rows = [(rng.choice([None, "hot", "hot", f"p{rng.randrange(20)}"]), rng.choice([None, rng.randrange(400)]), i, rng.choice([None, None, None, i])) for i in range(3000)]
    df = spark.createDataFrame(rows, "part string, at int, seq int, line int").repartition(4)
    order = lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])
    want, last = {}, {}
    for r in sorted(rows, key=order):
        last[r[0]] = r[3] if r[3] is not None else last.get(r[0])
        want[r[2]] = last[r[0]]
    for width in (None, "1"):
        if width:
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            assert {r.seq: r.line for r in carry_forward_label(df, ["part"], ["at", "seq"], "line").collect()} == want
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert carry_forward_label(df.limit(0), ["part"], ["at"], "line").count() == 0


def test_database_reads_are_cut_by_a_column():
    from pricematch.sources.quotes import jdbc_options

    assert jdbc_options("jdbc:x", "quotes", user="me") == {"url": "jdbc:x", "dbtable": "quotes", "fetchsize": "10000", "user": "me"}
    cut = jdbc_options("jdbc:x", "quotes", "betRadarID", (1, 900), 8)
    assert {k: cut[k] for k in ("partitionColumn", "lowerBound", "upperBound", "numPartitions")} == {"partitionColumn": "betRadarID", "lowerBound": "1", "upperBound": "900", "numPartitions": "8"}
    for wrong in ({"column": "id"}, {"column": "id", "bounds": (5, 1), "parts": 3}, {"column": "id", "bounds": (1, 5)}):
        with pytest.raises(ValueError):
            jdbc_options("jdbc:x", "quotes", **wrong)

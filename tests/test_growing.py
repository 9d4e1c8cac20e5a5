"""A table of leaves that split: only what a batch touches is read or written, and nothing is lost."""
import os

import pytest

from pricematch.sinks.growing import GrowingState
from pricematch.sinks.merge import insert_only_rows, upsert_matches

SCHEMA = "k string, part int, v int, seq int"
KEYS = ["k", "part"]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def content(state):
    return sorted(map(tuple, state.read(state.newest()).collect()), key=repr)


def check_leaves(state):
    leaves = state.leaves(state.newest())
    assert sum(0.5**x.depth for x in leaves) == 1 and all(x.rows <= state.most_rows for x in leaves)
    assert sum(x.rows for x in leaves) == state.read(state.newest()).count()
    return leaves


def test_upserts_touch_few_leaves(spark, tmp_path):
    state = GrowingState(spark, str(tmp_path / "s"), SCHEMA, KEYS, most_rows=20)
    old = [(f"k{i}", i % 3, 0, i) for i in range(30)]
    state.create(frame(spark, old))
    want = {r[:2]: r for r in old}
    for step, n in ((1, 200), (2, 2), (3, 1)):
        new = [(f"k{i * step}", i * step % 3, step, i) for i in range(n)]
        had = check_leaves(state)
        batch = frame(spark, new)
        read = state.replace(batch, lambda o: upsert_matches(o, batch, KEYS, ["v", "seq"], ["seq"]))
        now = check_leaves(state)
        assert read <= n and (n > 2 or len([x for x in now if x.versions == (state.newest(),)]) <= 2 * n)
        assert n > 2 or len(set(now) & set(had)) >= len(had) - n
        want |= {r[:2]: r for r in new}
        assert content(state) == sorted(want.values(), key=repr)
    assert len(now) >= 8
    kept = sorted(p for p in os.listdir(tmp_path / "s") if p.startswith("places"))
    assert len(kept) == 2


@pytest.mark.parametrize("blocks", [1, 3])
def test_inserts_are_those_of_the_whole_merge(spark, tmp_path, blocks):
    state = GrowingState(spark, str(tmp_path / "s"), SCHEMA, KEYS, most_rows=25)
    state.blocks = blocks
    state.create(frame(spark, []))
    target, parts = frame(spark, []), []
    for step in range(8):
        new = [(f"k{i}", i % 2, step, 1000 * step + i) for i in range(40 * step, 40 * step + 60)] + [(f"k{40 * step}", 0, 99, 1000 * step - 1), (None, step, step, step)]
        batch = frame(spark, new)
        want = insert_only_rows(target, batch, KEYS, ["seq"]).collect()
        leaves, read, inserted = state.insert_absent(batch, ["seq"], f"run#{step}")
        assert inserted == len(want)
        parts.append(read / leaves)
        target = target.unionByName(frame(spark, [tuple(r) for r in want])) if want else target
        assert content(state) == sorted(map(tuple, target.collect()), key=repr)
        check_leaves(state)
    assert min(parts) < 1


def test_a_filter_knows_all_its_keys_and_few_others(spark, tmp_path):
    state = GrowingState(spark, str(tmp_path / "s"), SCHEMA, KEYS, most_rows=400)
    state.create(frame(spark, []))
    state.insert_absent(frame(spark, [(f"k{i}", 0, 0, i) for i in range(4000)]), ["seq"])
    assert state.insert_absent(frame(spark, [(f"k{i}", 0, 1, i) for i in range(0, 4000, 9)]), ["seq"])[2] == 0
    leaves, read, inserted = state.insert_absent(frame(spark, [(f"n{i}", 0, 0, i) for i in range(30)]), ["seq"])
    assert inserted == 30 and read <= 5 and leaves >= 16


def test_a_batch_tried_again_counts_once(spark, tmp_path):
    state = GrowingState(spark, str(tmp_path / "s"), SCHEMA, KEYS, most_rows=10)
    state.create(frame(spark, []))
    one, two = ([(f"k{i}", 0, s, i) for i in range(20 * s, 20 * s + 30)] for s in (0, 1))
    state.insert_absent(frame(spark, one), ["seq"], "run#0")
    for _ in range(2):
        state.insert_absent(frame(spark, two), ["seq"], "run#1")
        assert state.newest() == 2 and len(content(state)) == 50
    os.remove(tmp_path / "s" / "places-000000000002" / "_SUCCESS")  # ended while it wrote its directory
    state.insert_absent(frame(spark, two), ["seq"], "run#1")
    assert state.newest() == 2 and len(content(state)) == 50
    check_leaves(state)

"""Indexes and counts on inputs that used to grow beyond bounds."""
import numpy as np

from pricematch.llm import decontaminate, quality_rules


def test_index_of_many_items_is_small():
    rng = np.random.default_rng(1)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 30_000, 30)).encode()) for i in range(50_000)]
    index = decontaminate.build(items)
    assert index.nbytes < 100 << 20  # a broadcast and two workers' copies are far below 1,000 MB
    text = b"before " + items[31_000][1].upper() + b" after " + items[7][1]
    assert set(decontaminate.matches(index, text)) == {7, 31_000}


def test_blocks_of_a_benchmark_find_what_one_does(spark):
    items = spark.createDataFrame([(i, " ".join(f"p{i}x{k}" for k in range(20 + i % 7))) for i in range(40)] + [(99, "two words"), (None, "x y z"), (3, None)], "item_id long, text string")
    texts = [(i, f"start p{i}x0 " + " ".join(f"p{i}x{k}" for k in range(20 + i % 7)) + " end") for i in range(0, 40, 3)] + [(100, "two words"), (101, None), (102, "other text " * 30)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    blocks = list(decontaminate.load(items, most_bytes=900))
    assert len(blocks) > 3
    rows = [sorted(map(tuple, decontaminate.find(docs, decontaminate.load(items, most_bytes=n)).collect())) for n in (900, 1 << 20)]
    assert rows[0] == rows[1] and len(rows[0]) == 15
    left = [sorted(r.doc_id for r in decontaminate.clean(docs, decontaminate.load(items, most_bytes=n)).collect()) for n in (900, 1 << 20)]
    assert left[0] == left[1] == [101, 102]


def test_columns_named_like_ours_stay(spark):
    good = " ".join(f"word{i}" for i in range(80))
    df = spark.createDataFrame([(1, good, 5, "a", True), (2, "short", 6, "b", False)], "doc_id long, text string, __s int, __rule string, __base boolean")
    assert [tuple(r) for r in quality_rules.keep_good(df, quality_rules.DecisionList()).collect()] == [(1, good, 5, "a", True)]

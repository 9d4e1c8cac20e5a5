"""Near copies that no hub links: tiles of crowds and of buckets against brute force."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricematch.llm import minhash


def brute(texts, width=5, percent=80):
    sets = [frozenset(zip(*(t.split()[k:] for k in range(width)))) for t in texts]
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 100 * both >= percent * (len(a) + len(sets[j]) - both) > 0:
                p, q = top(i), top(j)
                up[max(p, q)] = min(p, q)
    return {i: top(i) for i in range(len(texts))}


def copies(n, edits, seed):
    """Near copies of one text; the text itself comes last, so it is the hub of no bucket."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(900)}" for _ in range(300)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(edits):
            words[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return [*out, " ".join(base)]


@pytest.mark.parametrize("edits", [4, 6, 9])
def test_crowd_without_a_hub(spark, edits):
    texts = copies(160, edits, edits)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()} == brute(texts)


@pytest.mark.parametrize("blocks", [(2048, 512), (20, 7)])
@pytest.mark.parametrize("one_place", [True, False])
def test_tiles_lose_no_link(spark, blocks, one_place):
    """All texts in one bucket, each a component of its own: the links that tiles give join what brute force joins."""
    texts = copies(90, 5, 1) + copies(60, 5, 2)
    signer = minhash.Signer(52, 6)
    longs = [f"s{k}" for k in range(signer.longs)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", F.col("text").cast("binary").alias("raw"))
    rows = minhash._signed(df, 5, signer).withColumnRenamed("doc_id", "rep").withColumn("comp", F.col("rep"))
    # with several places, those of the bands themselves
    rows = rows.withColumn("open", F.array(F.lit(77)) if one_place else F.col("keys")).withColumn("open", F.col("open").cast("array<long>"))
    if one_place:
        rows = rows.withColumn("keys", F.concat(F.array(F.lit(77).cast("long")), F.slice("keys", 2, 51)))
    found = minhash.more_links(rows, df, longs, 5, 80, 0.11, 312, *blocks).collect()
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in found:
        p, q = top(r.a), top(r.b)
        up[max(p, q)] = min(p, q)
    want = brute(texts)
    assert {i: top(i) for i in range(len(texts))} == want
    assert len(found) < 20 * len(texts)


def test_table_form_of_intersections():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 30_000, rng.integers(1, 500)).astype(np.uint64)) for _ in range(90)]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(30)))
    i, j = np.concatenate([i, i]), np.concatenate([j, j])
    got = minhash._Crowd.shared(sets[:60], sets[60:], i, j)
    assert len(i) >= 2000 and got.tolist() == [len(np.intersect1d(sets[x], sets[60 + y])) for x, y in zip(i, j)]

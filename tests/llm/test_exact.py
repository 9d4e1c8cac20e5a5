"""Counts and samples that must not hang on a hash."""
import random
from collections import Counter

from pyspark.sql import functions as F

from pricematch.llm import quality_rules, secret_scan
from pricematch.llm.text_stats import repeated_words

SF = "/root/testdata/sf0.01"


def covered(words):
    seen = Counter(zip(words, words[1:], words[2:]))
    return len({i + k for i, x in enumerate(zip(words, words[1:], words[2:])) if seen[x] > 1 for k in range(3)})


def test_windows_that_share_a_hash_only(spark):
    """With hashes of one, two or three values nearly all windows collide; the count is that of the words."""
    rng = random.Random(5)
    texts = [[rng.choice("abcdefgh") for _ in range(n)] for n in (0, 1, 2, 3, 4, 5, 9, 40, 200, 1200)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, w array<string>")
    for kinds in (1, 2, 3):
        hashes = F.transform("w", lambda x: F.pmod(F.xxhash64(x), F.lit(kinds)))
        got = {r.k: r.n for r in df.select("k", repeated_words(hashes, F.col("w")).alias("n")).collect()}
        assert got == {k: covered(t) for k, t in enumerate(texts)}


def test_a_very_long_text(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(400)}" for _ in range(120_000)]
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    assert quality_rules.score(df, quality_rules.DecisionList()).first().n_repeat_words == covered(words)


def test_sample_is_that_of_the_whole_order(spark):
    rows = spark.range(5000).select((F.col("id") % 4000).alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    order = F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text")
    for found, size in ((F.lit(True), 5000), (F.col("doc_id") % 7 == 0, 700), (F.col("doc_id") < 3, 4), (F.lit(False), 0), (F.lit(True), 500_000)):
        want = rows.filter(found).orderBy(*order).limit(60).collect()
        assert sorted(secret_scan._lowest(rows, order, found, size, 60).collect()) == sorted(want)

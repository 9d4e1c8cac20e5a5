"""How pages are dealt changes no text."""
from pyspark.sql import functions as F

from pricematch.llm import wrappers


def test_any_number_of_salts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    hot = pages.withColumn("url", F.when(F.col("page_id") % 3 == 0, F.lit("https://hot.example/x")).otherwise(F.col("url")))
    texts = lambda n: sorted(map(repr, wrappers.extract(hot, per_task=n).collect()))
    assert texts(3) == texts(10**9) == texts(64)

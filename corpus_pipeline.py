"""A corpus cleaned in stages. Each takes (spark, docs, sf_dir) and its result is written and read again for the next.

Every stage but the last returns the columns of its input. Rows leave where a stage says so: documents that the quality
rules reject, all but one of each group of near-duplicates, documents that hold a benchmark passage. Secrets are
masked in the texts that stay, and ``n_chars`` follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricematch.llm import decontaminate, minhash, packing, quality_rules, secret_scan
from pricematch.llm.common import new_folder, ship, table
from pricematch.llm.queries import TOKENIZER


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the decision list learned from ``labels`` reject."""
    return quality_rules.keep_good(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates (five-word shingles, 0.8) the document with the smallest id; of repeated rows, one."""
    ship(spark)
    kept = minhash.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__id"]), "left_semi").dropDuplicates(["doc_id", "text"])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of ``benchmark``."""
    ship(spark)
    return decontaminate.clean(docs, decontaminate.load(table(spark, sf_dir, "benchmark")))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; a document without one is untouched."""
    ship(spark)
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    before = "__old"
    while before in docs.columns:
        before += "_"
    old = docs.withColumnRenamed("text", before).withColumn("text", F.col(before))
    out = secret_scan.redact(old, secret_scan.fit(docs))
    if kind is not None:
        changed = F.col("text") != F.col(before)
        out = out.withColumn("n_chars", F.when(changed, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    ship(spark)
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality_rules", good_quality),
    ("near_dedup", one_of_each),
    ("decontamination", without_benchmark),
    ("secret_scans", without_secrets),
    ("packing", packed),
]

#: A trained model, sketches and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

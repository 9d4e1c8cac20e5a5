"""The registered queries of this package: (spark, sf_dir) to DataFrame, with SQL where it can say the same."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, licences, minhash, nbsvm, packing, pieces, quality_rules, records, secret_scan, spelling, wrappers
from .common import new_folder, ship, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "records")
    index = records.write_records(table(spark, sf_dir, "documents"), path, TOKENIZER)
    read = records.read_records(records.with_starts(index), path, ("doc_id", "start"))
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.score(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels"))).drop("rule")


def op5_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op6_licence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.windows(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = nbsvm.fit(docs, labels.filter(~held_out))
    return nbsvm.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = wrappers.extract(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), decontaminate.load(table(spark, sf_dir, "benchmark")))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), PIECES), PIECES)
    digest = [F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")]
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), *digest)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.words(table(spark, sf_dir, "documents")))


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {f.__name__: _shipped(f) for f in (
    op1_token_records, op2_secrets, op3_minhash, op4_quality_rules, op5_perspectives, op6_licences, op6_licence_windows,
    op7_quality_classifier, op8_main_text, op9_packing, op10_decontaminate,
    op11_pieces, op12_divergence, op13_spelling,
)}
SQL: dict[str, str] = {"op5_perspectives": chat.PERSPECTIVES_SQL, "op6_licences": licences.SCAN_SQL, "op12_divergence": divergence.AUDIT_SQL}

"""The queries of the corpus operators, with production parameters, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import byte_bpe, decontamination, language_id, ngram_join, oracles, paragraph_dedup, pii, quality_rules, secret_scan, substring_order, token_files
from corvane.llm.common import Scratch, documents


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir), Scratch(spark, "op1"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    return language_id.predict(docs, model).select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op3")
    found = secret_scan.scan(documents(spark, sf_dir), scratch)
    base = secret_scan.joined(secret_scan.base(F.col("spans")))
    return found.select(
        "doc_id",
        *[secret_scan.count(F.col("spans"), i).alias(f"n_{secret_scan.KINDS[i][0]}") for i in range(secret_scan.BASE)],
        F.sha2(base, 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"),
        F.size("live").cast("long").alias("n_live"),
        F.size("copied").cast("long").alias("n_copied"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(documents(spark, sf_dir), Scratch(spark, "op4"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = byte_bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


def op6_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paragraph_dedup.repeats(documents(spark, sf_dir), Scratch(spark, "op6"))
    return found.withColumnRenamed("class_key", "class_doc_id")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Scratch(spark, "op7").path("tokens", stay=True)
    token_files.write(documents(spark, sf_dir), out, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.checksums(token_files.read(spark, out)).withColumnRenamed("key", "doc_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.contained(documents(spark, sf_dir), items, Scratch(spark, "op8"))
    return found.select("doc_id", F.col("item").alias("item_id"), "n_shared", "n_shingles")


def with_spans(docs: DataFrame) -> DataFrame:
    found = pii.find(docs)
    return found.select("doc_id", *[f"n_{k}" for k in pii.BASE], F.sha2("base", 256).alias("base_sha256"), "spans", "n_spans")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_spans(documents(spark, sf_dir))


def op10_substring_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    stripped = substring_order.strip(documents(spark, sf_dir), Scratch(spark, "op10"))
    return stripped.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_language_id": op2_language_id,
    "op3_secret_scan": op3_secret_scan,
    "op4_quality_rules": op4_quality_rules,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_paragraph_dedup": op6_paragraph_dedup,
    "op7_token_files": op7_token_files,
    "op8_decontamination": op8_decontamination,
    "op9_pii": op9_pii,
    "op10_substring_order": op10_substring_order,
}

ORACLE: dict[str, str] = {
    "op1_ngram_join": oracles.OP1,
    "op3_secret_scan": oracles.OP3,
    "op6_paragraph_dedup": oracles.OP6,
    "op8_decontamination": oracles.OP8,
}

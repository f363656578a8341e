"""A corpus pipeline in five stages; each works on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

Defined cases: null, empty and letterless texts go in the first stage; an empty table stays one; rows with
a null key are never near duplicates to remove, and repeated rows of a key stay together or go together;
extra columns are carried along, and the last stage returns none of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import byte_bpe, decontamination, language_id, ngram_join, secret_scan
from corvane.llm.common import Scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those of whose n-grams no language contains a quarter."""
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    return language_id.identified(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group linked by a similarity of 0.8 on five-word shingles."""
    return ngram_join.one_of_each(docs, Scratch(spark, "stage_near_duplicates"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item's five-word shingles to 0.8 or more."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Scratch(spark, "stage_leaks"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces live-looking credentials in the text; n_chars follows."""
    return secret_scan.without_live(docs, Scratch(spark, "stage_secrets"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes that they decode to."""
    tokens = byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("tokens", encode_tokens),
]

#: Language identification is learned and can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), name, stay=i == len(STAGES) - 1)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs

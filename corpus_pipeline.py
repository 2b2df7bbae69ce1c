"""A corpus pipeline over the documents table: toxicity, near-duplicates,
secrets, source mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns the columns of documents; the last returns tokens. Between stages
the rows are written as Parquet and read again.

Defined results: rows with null texts pass the toxicity stage (nothing in them is
toxic), are near-duplicates of one another, have no secrets and weigh 0 words in
the mix, which takes them by the same rate as others; null doc_ids and sources
are values like others; an empty table gives an empty result; extra columns of
documents pass through to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.llm import bpe, secret_scan, simhash, source_mix, toxicity
from graphmill.llm.shared import fresh, written

TOXIC = 0.3


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score TOXIC or more."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = fresh(docs, "toxicity")
    scored = toxicity.score(docs, model, out_col=name)
    return scored.where(F.col(name) < TOXIC).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return simhash.keep_first(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts secrets from the texts."""
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources reach their targets."""
    return source_mix.mix_sources(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document's whole text, and the digest of what they decode to."""
    tokenizer = bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    both = docs.select("doc_id", "source", tokenizer.round_trip("text").alias("both")).select("doc_id", "source", "both.*")
    return both.select("doc_id", "source", bpe.n_tokens("ids").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", not_toxic),
    ("simhash_near_dedup", one_of_each),
    ("secret_scans", without_secrets),
    ("source_mix", mixed),
    ("byte_bpe", tokens),
]
#: The toxicity model, the fingerprints and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents in sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

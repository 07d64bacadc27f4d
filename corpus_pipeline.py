"""From raw documents to token ids in five stages, each over all rows that the one before kept.

Language identification drops documents without a language, the n-gram join keeps one document of each
group of near copies, decontamination drops documents that hold benchmark items, the secret scan masks
what it finds, and the rest is encoded with merge-dropout. A stage's result is written as Parquet and
read again, so a lost executor costs a part of one stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townpulse.llm import decontamination, language_id, merge_dropout, ngram_jaccard, secret_scan
from townpulse.llm.common import join_sized, kept
from townpulse.llm.queries import remainder
from townpulse.session import apply_settings

# Below this mean probability a document belongs to no language that was learned.
LEAST_LANGUAGE_SCORE = 0.3
# Texts that go to a task's Python at once.
BATCH_BYTES = 8 << 20
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

# The first stage learns languages from labels, which SQL cannot state; tests check every stage.
ORACLE_SQL = None


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """The stage, with Arrow batches bounded by bytes: ten thousand texts at once, Spark's bound by rows, are
    held several times, in the JVM's buffers and in Python, and long-lived workers keep what they once took."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    found = language_id.identify(docs, remainder("doc_id", 4) != 2, carry=COLUMNS)
    known = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return found.where(known).select(*COLUMNS)


@in_small_batches
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by 5-word shingles."""
    return ngram_jaccard.keep_one(docs).select(*COLUMNS)


@in_small_batches
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    leaks = decontamination.find_leaks(rows, benchmark, key="_key").select("_key").distinct()
    return join_sized(rows, leaks, "_key", "left_anti").select(*COLUMNS)


@in_small_batches
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and their lengths counted anew."""
    masked = secret_scan.mask(F.col("text"), F.col("spans"))
    found = secret_scan.scan(docs).withColumn("text", masked)
    return found.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


@in_small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and whether they decode to the text."""
    return merge_dropout.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("ngram_jaccard", keep_one_of_each_group),
    ("decontamination", decontaminate),
    ("secret_scan", mask_secrets),
    ("merge_dropout", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over the documents of ``sf_dir``."""
    apply_settings(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

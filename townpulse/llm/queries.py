"""The operators as queries over the given tables: ``name -> (spark, folder) -> DataFrame``."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townpulse.llm import (
    decontamination,
    hard_negatives,
    html_extraction,
    language_id,
    merge_dropout,
    ngram_jaccard,
    periodic_runs,
    secret_scan,
    spot_signatures,
    substring_dedup,
    token_counts,
    toxicity,
    url_filters,
)
from townpulse.scale import shared_path
from townpulse.session import apply_settings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    """Register under the function's name; sessions built elsewhere get our settings."""

    @functools.wraps(fn)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        apply_settings(spark)
        return fn(spark, folder)

    QUERIES[fn.__name__] = run
    return run


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


# Fixed values: (host, path, verdict).
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def url_rules(spark: SparkSession) -> DataFrame:
    rows = [
        F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict"))
        for h, p, v in URL_RULES
    ]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*rows)))


@query
def op6_secret_scan(spark, folder):
    found = secret_scan.scan(documents(spark, folder).select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["ord"] < len(secret_scan.BASE_RULES))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(secret_scan.spans_text(base), 256).alias("base_sha256"),
        secret_scan.spans_text(F.col("spans")).alias("spans"),
    )


@query
def op8_token_counts(spark, folder):
    counted = token_counts.count_tokens(
        documents(spark, folder),
        public_tokenizers.path("word_bpe_49k.json"),
        shared_path(spark, "token-counts"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


@query
def op9_url_filters(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    return url_filters.judge_urls(pages, url_rules(spark))


@query
def op7_substring_dedup(spark, folder):
    found = substring_dedup.remove_repeats(documents(spark, folder))
    return found.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256")
    )


@query
def op10_ngram_jaccard(spark, folder):
    return ngram_jaccard.join_sets(documents(spark, folder))


@query
def op3_spot_signatures(spark, folder):
    return spot_signatures.compare_with_next(documents(spark, folder))


@query
def op2_decontamination(spark, folder):
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    return decontamination.find_leaks(documents(spark, folder), benchmark)


@query
def op1_merge_dropout(spark, folder):
    encoded = merge_dropout.encode(
        documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model")
    )
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "lossless")


def remainder(key: str, parts: int):
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(key).cast("string")) % parts


@query
def op4_language_id(spark, folder):
    docs = documents(spark, folder)
    found = language_id.identify(docs, remainder("doc_id", 4) != 2)
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op5_toxicity(spark, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = toxicity.score_documents(documents(spark, folder), labels, remainder("doc_id", 5) != 0)
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted)


def planted_period(key: str, text: str):
    """The text, with a repeated stretch of words at its end where crc32 of the id is divisible by 10."""
    h = F.crc32(F.col(key).cast("string"))
    words = F.filter(F.split(F.col(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def repeated(ws):
        g, n = F.floor(h / 10), F.size(ws)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.transform(ws, lambda w, i: F.when(i < a, w).otherwise(F.get(ws, a + (i - a) % p)))

    # inside the lambda the text is cut into words once, not for every word
    planted = F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, F.array_join(repeated(ws), " ")))
    return F.when(h % 10 == 0, F.get(planted, F.lit(0))).otherwise(F.col(text))


@query
def op12_periodic_runs(spark, folder):
    docs = documents(spark, folder).select("doc_id", planted_period("doc_id", "text").alias("text"))
    found = periodic_runs.find_runs(docs)
    ranked = F.array_sort(
        F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"], r["period"]))
    )
    lines = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    )
    best = F.get(ranked, F.lit(0))
    length = -best["shorter"]
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        best["start"].alias("start"),
        length.alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * length / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"),
    )


@query
def op13_hard_negatives(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


@query
def op11_html_extraction(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    found = html_extraction.extract(pages, carry=("url",))
    n_chars = F.char_length("text").cast("bigint").alias("n_chars")
    return found.select("page_id", "url", "text", n_chars, "n_blocks", "n_kept")

"""Token counts with a cache keyed by content digest and tokenizer digest.

For a tokenizer that drops white space (``drops_space``) the normalised content of a text has each run
of ASCII white space as one space and none at the ends: white space only parts tokens there, so equal
normalised contents have equal counts, and a content has as many tokens as its words together, of which
each task encodes every different one once. For other tokenizers the content is the text itself. The
key of a count is the SHA-256 of the content together with the SHA-256 of the tokenizer file. Contents
without a stored count are encoded once each and appended.

Defined cases: a null text counts as empty and has 0 tokens. Equal rows are each returned. An empty
table gives no rows and appends nothing. Only the id and the text column are read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from townpulse.llm.common import kept

CACHE_SCHEMA = "tokenizer string, content string, n_tokens bigint"
# A tokenizer file is sent to every executor; larger ones are refused.
MOST_TOKENIZER_BYTES = 64 << 20
# Characters given to the encoder at once.
SLICE_CHARS = 1 << 20
# Words whose counts a task remembers.
KNOWN_WORDS = 1 << 20


def normalised(text: Column, drops_space: bool) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")) if drops_space else text


def tokenizer_digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Stored counts, one per key; empty if nothing was stored under ``path`` yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], CACHE_SCHEMA)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(path)
    return stored.groupBy("tokenizer", "content").agg(F.first("n_tokens").alias("n_tokens"))


def encode_counts(texts: DataFrame, tokenizer: bytes, drops_space: bool) -> DataFrame:
    """content, n_tokens for rows of content and text."""
    shared = texts.sparkSession.sparkContext.broadcast(tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_str(shared.value.decode())
        encoder.no_padding()
        encoder.no_truncation()

        def encoded(pieces: list[str]) -> list[int]:
            return [len(e) for e in encoder.encode_batch_fast(pieces, add_special_tokens=False)]

        known: dict[str, int] = {}
        for batch in batches:
            lengths = []
            for chunk in slices(batch.column(1).to_pylist()):
                if not drops_space:
                    lengths += encoded(chunk)
                    continue
                if len(known) > KNOWN_WORDS:
                    known.clear()
                new = list(set(" ".join(chunk).split(" ")).difference(known))
                known.update(zip(new, encoded(new), strict=True))
                lengths += [sum(map(known.__getitem__, text.split(" "))) for text in chunk]
            yield pa.record_batch(
                [batch.column(0), pa.array(lengths, pa.int64())], names=["content", "n_tokens"]
            )

    return texts.select("content", "text").mapInArrow(count, "content string, n_tokens bigint")


def slices(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts of about ``SLICE_CHARS`` characters together, so that memory stays bounded."""
    chunk, size = [], 0
    for text in texts:
        chunk.append(text)
        size += len(text)
        if size >= SLICE_CHARS:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    cache_path: str,
    *,
    key: str = "doc_id",
    text: str = "text",
    drops_space: bool = True,
) -> DataFrame:
    """``key``, n_bytes and n_tokens of every row; appends counts of new contents to the cache."""
    spark = docs.sparkSession
    data = Path(tokenizer_path).read_bytes()
    if len(data) > MOST_TOKENIZER_BYTES:
        raise ValueError(f"{tokenizer_path} is larger than {MOST_TOKENIZER_BYTES} bytes")
    version = tokenizer_digest(data)
    content = normalised(F.col(text), drops_space)
    digest = F.sha2(content, 256).alias("content")
    # Digests once, beside the id: later joins move no texts.
    rows = kept(
        docs.select(
            F.col(key),
            F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("bigint").alias("n_bytes"),
            digest,
        ),
        "digests",
    )
    stored = read_cache(spark, cache_path).where(F.col("tokenizer") == version)
    texts = docs.select(digest, content.alias("text"))
    # Copies meet in the task that reads them before anything is shuffled.
    missing = (
        texts.join(stored.select("content"), "content", "left_anti")
        .groupBy("content")
        .agg(F.first("text").alias("text"))
    )
    encode_counts(missing, data, drops_space).select(F.lit(version).alias("tokenizer"), "content", "n_tokens").write.mode(
        "append"
    ).parquet(cache_path)
    counts = read_cache(spark, cache_path).where(F.col("tokenizer") == version)
    return rows.join(counts.select("content", "n_tokens"), "content", "left").select(
        key, "n_bytes", "n_tokens"
    )

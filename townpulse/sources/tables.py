"""The flat comment file, the accumulating store and the result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from townpulse.functions.dates import FRESHNESS_FORMAT, STAMP_FORMAT, week_label, week_start, year_of
from townpulse.operators.feed import FLAT_COLUMNS

FLAT_SCHEMA = (
    "group_domain string, post_id bigint, post_date timestamp, comment_id bigint, "
    "from_id bigint, text string, comment_date timestamp"
)
BYTES_PER_TASK = 32 << 20
# Words that stand for a missing text in the flat file (fixed values).
MISSING_WORDS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]
_CSV = {
    "header": "true",
    "escape": '"',
    "multiLine": "true",
    "timestampFormat": STAMP_FORMAT,
    "encoding": "UTF-8",
}


def write_comments(flat: DataFrame, path: str, first: bool, rows_per_file: int = 1_000_000):
    """Write the flat table as CSV with header; the first batch replaces, others add."""
    (
        flat.select(*FLAT_COLUMNS)
        .write.mode("overwrite" if first else "append")
        .options(**{k: v for k, v in _CSV.items() if k != "multiLine"})
        .option("quoteAll", "true")
        .option("nullValue", None)
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
        .option("maxRecordsPerFile", rows_per_file)
        .csv(path)
    )


def read_comments(spark: SparkSession, path: str, missing_words: bool = True) -> DataFrame:
    """Read the flat CSV table; texts may hold quotes and line breaks.

    A file whose texts span lines is read by one task, so files are kept to a
    bounded number of rows when written. With ``missing_words`` texts such as
    ``NA`` and ``null`` become null.
    """
    rows = spark.read.schema(FLAT_SCHEMA).options(**_CSV).csv(path)
    if missing_words:
        rows = rows.withColumn("text", F.when(~F.col("text").isin(MISSING_WORDS), F.col("text")))
    return rows


def append_groups(flat: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """Append rows to the store, one directory per group.

    The rebalance hint brings a group's rows together, yet splits a group too
    large for one task.
    """
    (
        flat.hint("rebalance", "group_domain")
        .write.mode("append")
        .partitionBy("group_domain")
        .option("maxRecordsPerFile", rows_per_file)
        .parquet(path)
    )


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The accumulated rows, columns in the order of the flat table.

    Group names are text even where they all look like numbers.
    """
    fields = [f for f in FLAT_SCHEMA.split(", ") if not f.startswith("group_domain ")]
    schema = ", ".join([*fields, "group_domain string"])
    return spark.read.schema(schema).parquet(path).select(*FLAT_COLUMNS)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def read_table(spark: SparkSession, path: str, spread_by: str | None = None) -> DataFrame:
    """Read a stored table.

    Spark reads a file in pieces no smaller than a row group, so a small table may
    come as a single task. With ``spread_by`` a table that has less than
    ``BYTES_PER_TASK`` for each core is redistributed by that column before costly
    work on its rows; a larger one is left as it lies.
    """
    rows = spark.read.parquet(path)
    if spread_by is None:
        return rows
    cores = spark.sparkContext.defaultParallelism
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    size = files.agg(F.sum("length")).first()[0] or 0
    return rows.repartition(cores, spread_by) if size < BYTES_PER_TASK * cores else rows


def date_time_of() -> Column:
    """Instant of a flat row: the comment's, or the post's for the post itself."""
    return F.coalesce("comment_date", "post_date")


def with_time_keys(df: DataFrame, ts: str = "date_time") -> DataFrame:
    """Adds ``year``, ``week`` (Monday/Sunday) and ``week_start``."""
    return df.withColumns(
        {"year": year_of(ts), "week": week_label(ts), "week_start": week_start(ts)}
    )


def freshness(spark: SparkSession, path: str) -> DataFrame:
    """``last_updated``: time of the newest file below ``path`` as ``dd.MM.yyyy HH:mm``.

    Files are listed, not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(
        F.date_format(F.max("modificationTime"), FRESHNESS_FORMAT).alias("last_updated")
    )

"""Incremental ingest and incremental weekly counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from townpulse.operators.feed import flatten, latest_rows
from townpulse.sources.feeds import land_batch, landed_bad_lines, landed_posts, listed_posts, parse_feed
from townpulse.sources.versions import read_version, write_version


def stream_posts(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Arriving feed lines below ``path/group_domain=<name>/``, parsed, bad ones marked."""
    reader = spark.readStream.schema("value string, group_domain string")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return parse_feed(reader.text(path))


def ingest_new(
    spark: SparkSession,
    feed_path: str,
    store_path: str,
    state_path: str,
    first_date=None,
    last_date=None,
    bad_path: str | None = None,
    files_per_batch: int | None = None,
    landing: str | None = None,
    rule: str = "line",
    groups: DataFrame | None = None,
) -> StreamingQuery:
    """Flatten the feed files that arrived since the last run and add them to the store.

    Handles what is there, then ends. ``state_path`` remembers the files done. A
    batch that is run again after a failure replaces its own rows (each batch has
    its directory), so nothing is doubled. Every batch lands below ``landing`` (beside
    ``state_path`` where not given) with its manifest, as in a batch run: unreadable
    lines are kept there, and ``rule`` says whether they take their group's lines of
    that batch with them. They also go to ``bad_path`` where that is given. With
    ``groups`` only listed groups reach the store.
    """
    landing = landing or f"{state_path.rstrip('/')}-landed"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        land_batch(batch, landing, number, rule)
        if bad_path:
            bad = landed_bad_lines(spark, landing).filter(F.col("batch") == number).drop("batch")
            bad.write.mode("overwrite").parquet(f"{bad_path}/batch={number}")
        good = landed_posts(spark, landing, number)
        if groups is not None:
            good = listed_posts(good, groups)
        flatten(good, first_date, last_date).hint("rebalance", "group_domain").write.mode(
            "overwrite"
        ).parquet(f"{store_path}/batch={number}")

    return (
        stream_posts(spark, feed_path, files_per_batch)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", state_path)
        .trigger(availableNow=True)
        .start()
    )


def weekly_counts(
    events: DataFrame, ts: str = "date_time", topic: str = "topic_name", late: str = "7 days"
) -> DataFrame:
    """``week_start, topic_name, count`` of a stream, kept up to date.

    Weeks start on Monday: day 0 of the epoch is a Thursday, hence the shift by
    four days. The state is one count per week and topic; in append and update
    mode the watermark drops weeks that can no longer change.
    """
    timed = events.select(F.col(ts).cast("timestamp").alias("_ts"), F.col(topic).alias("topic_name"))
    week = F.window("_ts", "7 days", startTime="4 days")
    return (
        timed.filter(F.col("_ts").isNotNull() & F.col("topic_name").isNotNull())
        .withWatermark("_ts", late)
        .groupBy(week, "topic_name")
        .agg(F.count("*").alias("count"))
        .select(F.to_date("window.start").alias("week_start"), "topic_name", "count")
    )


def keep_weekly_counts(
    events: DataFrame,
    table_path: str,
    state_path: str,
    ts: str = "date_time",
    topic: str = "topic_name",
    late: str = "7 days",
) -> StreamingQuery:
    """Keep the weekly counts at ``table_path``, the open week included; handles what is there, then ends.

    A batch brings the counts that it changed, which replace those of the last version in a new one
    (``read_weekly_counts`` reads the newest). Rows of weeks that ended before the watermark, ``late``
    behind the newest row of earlier batches, are dropped, and their state with them.
    """

    def write(changed: DataFrame, number: int) -> None:
        keys = ["week_start", "topic_name"]
        latest = changed.withColumn("_batch", F.lit(number))
        before = read_version(changed.sparkSession, table_path, WEEKLY_SCHEMA, before=number)
        both = before.withColumn("_batch", F.lit(-1)).unionByName(latest)
        merged = both.groupBy(*keys).agg(F.max_by("count", "_batch").alias("count"))
        write_version(merged, table_path, number)

    return (
        weekly_counts(events, ts, topic, late)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", state_path)
        .trigger(availableNow=True)
        .start()
    )


WEEKLY_SCHEMA = "week_start date, topic_name string, count bigint"


def read_weekly_counts(spark: SparkSession, table_path: str) -> DataFrame:
    """``week_start, topic_name, count`` as the last whole batch left them."""
    return read_version(spark, table_path, WEEKLY_SCHEMA)


def newest_rows(
    rows: DataFrame, keys: list[str], version: str, ts: str, late: str = "7 days"
) -> DataFrame:
    """Of a stream the rows that are newer, by ``version``, than all earlier rows of their keys.

    Of one batch only the newest row of a key comes out; equal versions are settled by the whole row,
    the greatest, as in ``latest_rows``. The state holds the newest row of a key in each stretch of
    length ``late`` and is given up when the watermark, ``late`` behind the newest row of earlier
    batches, passes its end; rows of such stretches are dropped, as rows without ``ts`` are.
    """
    columns = [c for c in rows.columns if c not in keys]
    newest = F.max(F.struct(version, *[c for c in columns if c != version])).alias("_row")
    timed = rows.withColumn("_ts", F.col(ts).cast("timestamp")).filter(F.col("_ts").isNotNull())
    return (
        timed.withWatermark("_ts", late)
        .groupBy(*keys, F.window("_ts", late))
        .agg(newest)
        .select(*keys, "_row.*")
        .select(*rows.columns)
    )


def keep_latest_rows(
    rows: DataFrame,
    table_path: str,
    state_path: str,
    keys: list[str],
    version: str,
    ts: str,
    late: str = "7 days",
) -> StreamingQuery:
    """Keep at ``table_path`` the newest row of each key; handles what is there, then ends.

    Each batch's newest rows are merged with those of the last version, so a row that comes late never
    replaces a newer one, whatever the state still knows.
    """
    schema = rows.schema

    def write(changed: DataFrame, number: int) -> None:
        before = read_version(changed.sparkSession, table_path, schema, before=number)
        merged = latest_rows(before.unionByName(changed), keys, version)
        write_version(merged, table_path, number)

    return (
        newest_rows(rows, keys, version, ts, late)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", state_path)
        .trigger(availableNow=True)
        .start()
    )

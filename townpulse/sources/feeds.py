"""Group lists and exported group feeds (nested JSON)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townpulse.functions.text import SPACE
from townpulse.scale import attach, settle, shared_path

COMMENT_SCHEMA = "struct<id: bigint, from_id: bigint, date: bigint, text: string>"
POST_SCHEMA = (
    "seq bigint, id bigint, owner_id bigint, from_id bigint, date bigint, text string, "
    f"comments array<{COMMENT_SCHEMA}>"
)
_BAD = "_bad_line"


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """``group_domain`` per non-blank line of a text file, stripped; repeats stay."""
    stripped = F.regexp_replace("value", f"^[{SPACE}]+|[{SPACE}]+$", "")
    return (
        spark.read.text(path)
        .select(stripped.alias("group_domain"))
        .filter(F.length("group_domain") > 0)
    )


def parse_feed(lines: DataFrame, line: str = "value") -> DataFrame:
    """JSON ``line`` to post columns and ``bad_line``, the text of an unreadable one."""
    parsed = F.from_json(
        line,
        f"{POST_SCHEMA}, {_BAD} string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD},
    )
    rows = lines.filter(F.length(F.trim(line)) > 0).withColumn("_post", parsed)
    bad = F.when(F.col(f"_post.{_BAD}").isNotNull() | F.col("_post.id").isNull(), F.col(line))
    return rows.select("group_domain", "_post.*", bad.alias("bad_line")).drop(_BAD)


def read_feed_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines below ``path/group_domain=<name>/``, parsed, bad ones marked."""
    lines = spark.read.text(path).withColumn("group_domain", F.col("group_domain").cast("string"))
    return parse_feed(lines)


# What an unreadable line takes out: itself, or its whole group in that batch.
RULES = ("line", "group")
LANDED_SCHEMA = f"group_domain string, {POST_SCHEMA}, bad_line string"
MANIFEST_SCHEMA = "batch bigint, group_domain string, lines bigint, bad bigint, kept boolean"


def land_batch(rows: DataFrame, landing: str, batch: int, rule: str = "group") -> None:
    """Write parsed lines below ``landing``, good and bad ones apart, and what there was of each group.

    ``lines/batch=<n>/state=<good or bad>`` holds the lines, ``manifest/batch=<n>`` one row for each
    group: its lines, the unreadable ones, and whether the group's good lines are used under ``rule``.
    A batch that is written again replaces itself.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}")
    spark, path = rows.sparkSession, f"{landing.rstrip('/')}/lines/batch={batch}"
    state = F.when(F.col("bad_line").isNull(), "good").otherwise("bad")
    rows.withColumn("state", state).write.mode("overwrite").partitionBy("state").parquet(path)
    landed = spark.read.schema(f"{LANDED_SCHEMA}, state string").parquet(path)
    bad = F.count(F.when(F.col("state") == "bad", 1))
    counts = landed.groupBy("group_domain").agg(F.count("*").alias("lines"), bad.alias("bad"))
    kept = (F.col("bad") == 0) if rule == "group" else F.lit(True)
    counts.withColumn("kept", kept).write.mode("overwrite").parquet(
        f"{landing.rstrip('/')}/manifest/batch={batch}"
    )


def manifest(spark: SparkSession, landing: str) -> DataFrame:
    """``batch, group_domain, lines, bad, kept`` of all batches landed."""
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{landing.rstrip('/')}/manifest").select(
        "batch", "group_domain", "lines", "bad", "kept"
    )


def landed_posts(spark: SparkSession, landing: str, batch: int | None = None) -> DataFrame:
    """Good lines of the groups that the manifest keeps, of one batch or of all.

    Lines stay where they are while the groups left out are few. Runs the manifest.
    """
    rows = spark.read.schema(f"{LANDED_SCHEMA}, batch bigint, state string").parquet(
        f"{landing.rstrip('/')}/lines"
    )
    out = manifest(spark, landing).filter(~F.col("kept")).select("batch", "group_domain")
    if batch is not None:
        rows, out = rows.filter(F.col("batch") == batch), out.filter(F.col("batch") == batch)
    rows, out = rows.filter(F.col("state") == "good"), settle(out)
    if not out.isEmpty():
        rows = attach(rows, out, ["batch", "group_domain"], "left_anti", null_safe=True)
    return rows.drop("bad_line", "batch", "state")


def landed_bad_lines(spark: SparkSession, landing: str) -> DataFrame:
    """``batch, group_domain, bad_line`` of every unreadable line."""
    rows = spark.read.schema(f"{LANDED_SCHEMA}, batch bigint, state string").parquet(
        f"{landing.rstrip('/')}/lines"
    )
    return rows.filter(F.col("state") == "bad").select("batch", "group_domain", "bad_line")


def land_feed(spark: SparkSession, path: str, landing: str) -> DataFrame:
    """Parse the feed once into a columnar table at ``landing`` and read that."""
    read_feed_lines(spark, path).write.mode("overwrite").parquet(landing)
    return spark.read.parquet(landing)


def good_posts(rows: DataFrame) -> DataFrame:
    """Posts of the groups whose feed is readable throughout.

    One bad line takes its whole group out; other groups are not affected.
    ``bad_lines`` has what was left out. Runs a pass that lists the bad groups.
    """
    bad = settle(rows.filter(F.col("bad_line").isNotNull()).select("group_domain").distinct())
    if bad.isEmpty():
        return rows.drop("bad_line")
    return attach(rows, bad, ["group_domain"], "left_anti").drop("bad_line")


def bad_lines(rows: DataFrame) -> DataFrame:
    """``group_domain, bad_line`` of every unreadable line, for a side table."""
    return rows.filter(F.col("bad_line").isNotNull()).select("group_domain", "bad_line")


def read_posts(
    spark: SparkSession, path: str, landing: str | None = None, rule: str = "group"
) -> DataFrame:
    """Usable posts of the feed, by way of a landing table: below ``landing``, or in the shared folder."""
    landing = landing or shared_path(spark, "landed")
    land_batch(read_feed_lines(spark, path), landing, 0, rule)
    return landed_posts(spark, landing, 0)


def listed_posts(posts: DataFrame, groups: DataFrame) -> DataFrame:
    """Posts of the groups on the list. Runs the list."""
    return attach(posts, groups.select("group_domain").distinct(), ["group_domain"], "left_semi")

"""From posts with nested comments to one flat table of posts and comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from townpulse.functions.dates import from_epoch, in_range, instant, stamp_text
from townpulse.functions.numbers import batch_of
from townpulse.operators.ordering import (
    WIDTH,
    bucket_totals,
    in_buckets,
    keep_first,
    place_of,
    running_number,
    take_while,
)
from townpulse.scale import attach, settle
from townpulse.sources.feeds import COMMENT_SCHEMA

# Columns of the flat table, in order (fixed).
FLAT_COLUMNS = [
    "group_domain",
    "post_id",
    "post_date",
    "comment_id",
    "from_id",
    "text",
    "comment_date",
]
# Rows per group that a crawl may keep (fixed), and posts per written batch.
MAX_POSTS = 1_000_000
MAX_COMMENTS = 1_000_000
BATCH_SIZE = 100


def post_window(
    posts: DataFrame,
    first_date=None,
    last_date=None,
    stop_at_old: bool = False,
    max_posts: int | None = None,
    width: int = WIDTH,
) -> DataFrame:
    """Posts dated within the bounds, both included.

    ``stop_at_old`` gives a crawl's reading of a feed: nothing after the first
    post older than ``first_date`` in ``seq`` order, even if it is in range.
    ``max_posts`` then caps each group in ``seq`` order.
    """
    date = from_epoch("date")
    if stop_at_old and first_date is not None:
        old = date < instant(first_date)
        posts = take_while(posts, "group_domain", F.col("seq"), old)
    posts = posts.filter(in_range(date, first_date, last_date))
    if max_posts is not None:
        posts = keep_first(posts, "group_domain", ["seq"], max_posts, width=width)
    return posts


def usable_comments(first_date=None, last_date=None) -> Column:
    """The post's comments that have text and a date within the bounds.

    A comment without a date counts as dated 1970.
    """
    def usable(comment: Column) -> Column:
        date = from_epoch(F.coalesce(comment["date"], F.lit(0)))
        has_text = F.coalesce(comment["text"], F.lit("")) != ""
        return has_text & in_range(date, first_date, last_date)

    none = F.array().cast(f"array<{COMMENT_SCHEMA}>")
    return F.filter(F.coalesce("comments", none), usable)


def cap_comments(posts: DataFrame, max_comments: int, width: int = WIDTH) -> DataFrame:
    """Keep the first ``max_comments`` comments per group, in post then comment order.

    Every post stays. Groups of more than ``width`` posts are cut into buckets, as for
    ``running_number``; buckets wholly under or beyond the cap are settled from their
    totals, and running sums are taken just inside the bucket that crosses it. Runs the
    totals; when no group reaches the cap the posts are returned as they are.
    """
    have = F.coalesce(F.size("comments"), F.lit(0))
    whole = settle(posts.groupBy("group_domain").agg(F.sum(have).alias("_size")))
    if whole.filter(F.col("_size") > max_comments).isEmpty():
        return posts
    placed = posts.withColumn("_place", place_of(posts, ["seq"]))
    cut = in_buckets(placed, ["group_domain"], "_place", "_bucket", width)
    if cut is None:
        cut = placed.withColumn("_bucket", F.lit(0))
    totals = settle(bucket_totals(cut, ["group_domain"], "_bucket", have))
    tagged = attach(cut, totals, ["group_domain", "_bucket"], "inner", null_safe=True)
    crosses = (F.col("_before") < max_comments) & (
        F.col("_before") + F.col("_size") > max_comments
    )
    settled = tagged.filter(~crosses).withColumn(
        "comments",
        F.when(F.col("_before") < max_comments, F.col("comments")).otherwise(
            F.expr("slice(comments, 1, 0)")
        ),
    )
    earlier = (
        W.partitionBy("group_domain", "_bucket")
        .orderBy("_place")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    used = F.col("_before") + F.coalesce(F.sum(have).over(earlier), F.lit(0))
    edge = (
        tagged.filter(crosses)
        .withColumn("_keep", F.greatest(F.lit(0), F.lit(max_comments) - used).cast("int"))
        .withColumn("comments", F.slice("comments", F.lit(1), F.col("_keep")))
    )
    return settled.select(*posts.columns).unionByName(edge.select(*posts.columns))


def flatten(
    posts: DataFrame,
    first_date=None,
    last_date=None,
    stop_at_old: bool = False,
    max_posts: int | None = None,
    max_comments: int | None = None,
    width: int = WIDTH,
) -> DataFrame:
    """Nested posts to the flat table: a row per post and a row per usable comment.

    Each post becomes one small array (itself, then its comments) that is
    unrolled once, so that the input is read a single time.
    """
    posts = post_window(posts, first_date, last_date, stop_at_old, max_posts, width)
    posts = posts.withColumn("comments", usable_comments(first_date, last_date))
    if max_comments is not None:
        posts = cap_comments(posts, max_comments, width)
    own = F.struct(
        F.lit(None).cast("bigint").alias("comment_id"),
        F.col("from_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.lit(None).cast("timestamp").alias("comment_date"),
    )
    answers = F.transform(
        "comments",
        lambda c: F.struct(
            c["id"].alias("comment_id"),
            c["from_id"].alias("from_id"),
            c["text"].alias("text"),
            from_epoch(c["date"]).alias("comment_date"),
        ),
    )
    return posts.select(
        "group_domain",
        F.col("id").alias("post_id"),
        from_epoch("date").alias("post_date"),
        F.inline(F.concat(F.array(own), answers)),
    ).select(*FLAT_COLUMNS)


def join_comments(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """The flat table from two flat inputs.

    ``posts``: group_domain, owner_id, post_id, post_date, from_id, text.
    ``comments``: owner_id, post_id, comment_id, from_id, text, comment_date.
    A comment takes group and date of its post. Only these narrow columns of a
    post are shuffled; a post with very many comments is split at run time.
    """
    heads = posts.select("owner_id", "post_id", "group_domain", "post_date")
    with_text = comments.filter(F.coalesce("text", F.lit("")) != "")
    answers = with_text.join(heads, ["owner_id", "post_id"])
    own = posts.select(
        "group_domain",
        "post_id",
        "post_date",
        F.lit(None).cast("bigint").alias("comment_id"),
        "from_id",
        F.coalesce("text", F.lit("")).alias("text"),
        F.lit(None).cast(comments.schema["comment_date"].dataType).alias("comment_date"),
    )
    return own.unionByName(answers.select(*FLAT_COLUMNS))


def as_text_dates(flat: DataFrame) -> DataFrame:
    """The flat table with both dates as text, the form the CSV file holds."""
    return flat.withColumns(
        {"post_date": stamp_text("post_date"), "comment_date": stamp_text("comment_date")}
    )


def post_batches(
    posts: DataFrame,
    group: str = "group_domain",
    seq: str = "seq",
    size: int = BATCH_SIZE,
    width: int = WIDTH,
) -> DataFrame:
    """Adds each post's running ``number`` in its group and its ``batch`` of ``size``."""
    numbered = running_number(posts, group, seq, "number", width)
    return numbered.withColumn("batch", batch_of("number", size))


def rows_per_group(df: DataFrame, group: str = "group_domain") -> DataFrame:
    """Row count per group, and the grand total on the row whose group is null.

    Counted per group first; only those few rows take part in the roll-up.
    """
    counted = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("_n"))
    return counted.rollup(group).agg(F.sum("_n").cast("bigint").alias("count"))


def append_runs(*runs: DataFrame) -> DataFrame:
    """Rows of all runs one below the other; nothing is merged."""
    result = runs[0]
    for run in runs[1:]:
        result = result.unionByName(run)
    return result


def drop_repeats(flat: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per (group, post, comment); null comment ids compare as equal."""
    return flat.dropDuplicates(keys or ["group_domain", "post_id", "comment_id"])


def latest_rows(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Of the rows of each key the one with the greatest ``version``, null versions last.

    Different rows with one version are settled by their other columns, the greatest, so the result
    does not depend on the order of rows. Nulls among the keys are equal. Combined before the shuffle,
    so a key with any number of rows costs one row of each task.
    """
    others = [c for c in rows.columns if c not in (*keys, version)]
    # maps cannot be compared; their text can
    kinds = {f.name: f.dataType.typeName() for f in rows.schema.fields}
    order = F.struct(version, *[F.to_json(c) if kinds[c] == "map" else F.col(c) for c in others])
    whole = F.struct(version, *others)
    best = F.max_by(whole, order).alias("_row")
    return rows.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*rows.columns)

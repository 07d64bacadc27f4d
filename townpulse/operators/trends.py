"""Counts, shares and rankings over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from townpulse.functions.dates import calendar_month, in_range, month_of_week, week_start, year_of
from townpulse.functions.numbers import percent
from townpulse.functions.text import wrap_label

# Display names of the three sentiment labels (fixed values).
LABEL_NAMES = {
    "positive": "Позитивный",
    "negative": "Негативный",
    "neutral": "Нейтральный",
}


def date_range(df: DataFrame, start, end, ts: str = "date_time", end_inclusive: bool = True):
    return df.filter(in_range(ts, start, end, end_inclusive))


def only_values(df: DataFrame, column: str, values: list | None) -> DataFrame:
    """Rows whose ``column`` is among ``values``; no values means all rows."""
    return df.filter(F.col(column).isin(list(values))) if values else df


def without_nulls(df: DataFrame, *columns: str) -> DataFrame:
    return df.na.drop(subset=list(columns))


def recode(column, mapping: dict) -> Column:
    """Value looked up in ``mapping``; null where it is not listed."""
    pairs = [F.lit(part) for pair in mapping.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), F.col(column) if isinstance(column, str) else column)


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values in ascending order."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def time_bounds(df: DataFrame, ts: str = "date_time") -> DataFrame:
    return df.agg(F.min(ts).alias("min_date"), F.max(ts).alias("max_date"))


def latest_period(df: DataFrame, period: Column, name: str) -> DataFrame:
    return df.agg(F.max(period).alias(name))


def dense_counts(df: DataFrame, period: Column, period_name: str, topic: str = "topic_name"):
    """Rows per (period, topic) for every pair of a seen period and a seen topic.

    Gives ``period_name, topic_name, count, total_comments``; absent pairs count
    0, and the total is over the period's rows that have a topic. Periods come
    from all rows, also those without a topic.

    The table is aggregated once. The list of periods (with totals) is bounded by
    the calendar and enters as a single array value; each topic carries its own
    counts in a map no longer than that list. So the grid is laid out inside each
    topic's row, without a product of tables and without a join.
    """
    pairs = (
        df.select(period.alias("_period"), F.col(topic).alias("topic_name"))
        .filter(F.col("_period").isNotNull())
        .groupBy("_period", "topic_name")
        # counting the topic leaves 0 for rows without one
        .agg(F.count("topic_name").alias("_n"))
    )
    axis = (
        pairs.groupBy("_period")
        .agg(F.sum("_n").alias("_total"))
        .agg(F.array_sort(F.collect_list(F.struct("_period", "_total"))).alias("axis"))
    )
    topics = (
        pairs.groupBy("topic_name")
        .agg(
            F.map_from_entries(F.collect_list(F.struct("_period", "_n"))).alias("_counts"),
            F.sum("_n").alias("_all"),
        )
        .filter("_all > 0")
    )
    return topics.withColumn("_cell", F.explode(axis.scalar())).select(
        F.col("_cell._period").alias(period_name),
        "topic_name",
        F.coalesce(F.try_element_at("_counts", F.col("_cell._period")), F.lit(0))
        .cast("bigint")
        .alias("count"),
        F.col("_cell._total").cast("bigint").alias("total_comments"),
    )


def weekly_topic_counts(df: DataFrame, ts: str = "date_time", topic: str = "topic_name"):
    """``week_start, topic_name, count`` on the full grid of weeks and topics."""
    return dense_counts(df, week_start(ts), "week_start", topic).drop("total_comments")


def monthly_topic_share(
    df: DataFrame, ts: str = "date_time", topic: str = "topic_name", by: str = "week"
) -> DataFrame:
    """``month_start, topic_name, count, total_comments, percent`` on the full grid.

    ``by='week'`` puts a row into the month of its week's Monday,
    ``by='calendar'`` into the month of its own date.
    """
    period = {"week": month_of_week, "calendar": calendar_month}[by](ts)
    grid = dense_counts(df, period, "month_start", topic)
    return grid.withColumn("percent", percent(F.col("count"), F.col("total_comments")))


def yearly_counts(df: DataFrame, column: str, ts: str = "date_time") -> DataFrame:
    """``year, <column>, count`` of the pairs that occur; null keys are left out."""
    keyed = df.select(year_of(ts).cast("bigint").alias("year"), column)
    return keyed.na.drop().groupBy("year", column).agg(F.count("*").alias("count"))


def yearly_top(df: DataFrame, count: int = 3, ts: str = "date_time", topic: str = "topic_name"):
    """The ``count`` most frequent topics of each year, ties by name."""
    best = W.partitionBy("year").orderBy(F.desc("count"), F.asc(topic))
    ranked = yearly_counts(df, topic, ts).withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= count).withColumn("rank", F.col("rank").cast("bigint"))


def yearly_label_share(
    df: DataFrame, label: str = "label", ts: str = "date_time", names: dict | None = None
) -> DataFrame:
    """``year, label, count, share``: rows per label and their part of the year.

    Labels are renamed by ``names`` (default: the display names); others leave.
    """
    named = df.withColumn("label", recode(label, names or LABEL_NAMES))
    counts = yearly_counts(named, "label", ts)
    return counts.withColumn(
        "share", F.col("count") / F.sum("count").over(W.partitionBy("year"))
    )


def last_values(series: DataFrame, value: str, period: str, key: str = "topic_name") -> DataFrame:
    """The latest value of each series, 0 where it is missing."""
    latest = F.max_by(value, period)
    return series.groupBy(key).agg(F.coalesce(latest, F.lit(0.0)).alias("last_value"))


def wrapped(df: DataFrame, column: str = "topic_name", every: int = 5, mode: str = "clean"):
    """The same rows with the label column broken into lines, for display."""
    return df.withColumn(column, wrap_label(column, every, mode))

"""The report page's tables, each from the stored tables and the reader's choices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townpulse.functions.text import series_name
from townpulse.operators import trends
from townpulse.operators.forecast import HORIZON, SEASON, share_with_forecast
from townpulse.operators.terms import first_comments, word_frequencies

COMMENTS_SHOWN = 20
LABEL_WORDS = 5


def choices(topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topic names to choose from, and the default date bounds."""
    return trends.distinct_sorted(topics, "topic_name"), trends.time_bounds(topics)


def weekly_trend(
    topics: DataFrame, start=None, end=None, selected: list[str] | None = None, **options
) -> DataFrame:
    """Weekly counts of the chosen topics within the dates, names broken into lines."""
    rows = trends.date_range(topics, start, end, **options)
    rows = trends.only_values(rows, "topic_name", selected)
    return trends.wrapped(trends.weekly_topic_counts(rows), every=LABEL_WORDS)


def monthly_shares(
    topics: DataFrame,
    start=None,
    end=None,
    horizon: int = HORIZON,
    season: int | None = SEASON,
    by: str = "week",
    **options,
) -> DataFrame:
    """Monthly shares and their forecast, names broken into lines; ``series`` is the
    name as the legend shows it."""
    rows = trends.date_range(topics, start, end, **options)
    table = share_with_forecast(trends.monthly_topic_share(rows, by=by), horizon, season)
    table = trends.wrapped(table, every=LABEL_WORDS)
    return table.withColumn("series", series_name("topic_name"))


def yearly_view(
    labelled: DataFrame, topics: DataFrame, start=None, end=None, **options
) -> tuple[DataFrame, DataFrame]:
    """Top three topics of each year, and each year's shares of the sentiments."""
    top = trends.yearly_top(trends.date_range(topics, start, end, **options))
    share = trends.yearly_label_share(trends.date_range(labelled, start, end, **options))
    return trends.wrapped(top, every=LABEL_WORDS), share


def topic_words(topics: DataFrame, topic_name: str, stop: list[str] = ()) -> DataFrame:
    """Words of one topic's cloud; an unknown topic has none."""
    chosen = topics.filter(F.col("topic_name") == topic_name)
    return word_frequencies(chosen, "topic_name", stop=stop)


def topic_comments(
    topics: DataFrame, topic_name: str, order: list[str], count: int = COMMENTS_SHOWN
) -> DataFrame:
    """The first comments of one topic; an unknown topic has none."""
    return first_comments(topics, "topic_name", order, count, topic_name).select("text")

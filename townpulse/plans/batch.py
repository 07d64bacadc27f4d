"""The batch run: feed -> flat table -> labelled table -> topic table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townpulse.functions.text import clean_text, stop_words, terms
from townpulse.operators.feed import flatten
from townpulse.operators.terms import attach_names, auto_names, topic_terms
from townpulse.operators.topics import NOISE, density_topics
from townpulse.operators.wording import (
    lemmatize,
    lexicon_sentiment,
    predict_sentiment,
    prepare,
)
from townpulse.scale import settle
from townpulse.sources.feeds import listed_posts, read_posts
from townpulse.sources.tables import date_time_of, read_table, write_table


@dataclass
class Settings:
    """What a run needs to know besides its paths.

    Caps and the stop at the first old post leave rows out; they act only when asked for.
    """

    first_date: object = None
    last_date: object = None
    stop_at_old: bool = False
    max_posts: int | None = None
    max_comments: int | None = None
    # what an unreadable line takes out, and where all lines and their manifest are kept
    bad_rule: str = "group"
    landing_path: str | None = None
    language: str = "russian"
    dims: int = 256
    topic_options: dict = field(default_factory=dict)


ROW_KEY = ["group_domain", "post_id", "comment_id"]


def label_table(
    flat: DataFrame,
    stop: list[str],
    dictionary: DataFrame | None = None,
    lexicon: DataFrame | None = None,
    model=None,
) -> DataFrame:
    """Flat rows with ``row_id, text_preprocessed, label, date_time``.

    ``row_id`` is made of the row's own key, so it is the same on every run.
    Sentiment comes from ``model`` where given, else from ``lexicon``.
    """
    identity = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ROW_KEY])
    rows = prepare(flat, stop).withColumns({"row_id": identity, "date_time": date_time_of()})
    if dictionary is not None:
        rows = lemmatize(rows, dictionary, "row_id", out="text_preprocessed")
    if model is not None:
        return predict_sentiment(rows, model, "text_preprocessed")
    if lexicon is None:
        raise ValueError("either a model or a lexicon is needed")
    return lexicon_sentiment(rows, lexicon, "row_id")


def negative_rows(labelled: DataFrame) -> DataFrame:
    """Negative rows with text, and their ``cleaned`` text."""
    return (
        labelled.filter(F.col("label") == "negative")
        .na.drop(subset=["text_preprocessed"])
        .withColumn("cleaned", clean_text("text_preprocessed"))
    )


def text_vectors(df: DataFrame, dims: int, text: str = "cleaned", out: str = "vector") -> DataFrame:
    """Adds a unit vector of hashed TF-IDF words, centred on the mean text. Runs the fit."""
    from pyspark.ml.stat import Summarizer

    hashed = HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=dims).transform(
        df.withColumn("_terms", terms(text))
    )
    # the fit, the mean and the vectors follow; texts are split and hashed once
    hashed = settle(hashed.select(*df.columns, "_tf"))
    weighed = IDF(inputCol="_tf", outputCol="_idf").fit(hashed).transform(hashed)
    scaled = Normalizer(inputCol="_idf", outputCol="_unit").transform(weighed)
    mean = scaled.select(vector_to_array(Summarizer.mean(F.col("_unit"))).alias("m")).scalar()
    arrays = scaled.withColumn("_array", vector_to_array("_unit")).withColumn("_mean", mean)
    centred = F.zip_with("_array", "_mean", lambda x, m: (x - m).cast("float"))
    return arrays.select(*df.columns, centred.alias(out))


def topic_table(
    negatives: DataFrame,
    dims: int = 256,
    names: DataFrame | None = None,
    stop: list[str] = (),
    **options,
) -> DataFrame:
    """Negative rows with ``topic`` and ``topic_name``. Runs the clustering.

    ``names`` (topic, topic_name) may bring names from elsewhere; otherwise a
    topic is named by its first words.
    """
    # several passes follow; the words are hashed for the first one only
    vectors = settle(text_vectors(negatives, dims))
    rows = density_topics(vectors, "row_id", "vector", dims, **options).drop("vector")
    if names is None:
        ranked = topic_terms(rows.filter(F.col("topic") != NOISE), "topic", stop=stop)
        names = auto_names(ranked, "topic")
    return attach_names(rows, names)


def full_run(
    spark: SparkSession,
    feed_path: str,
    labelled_path: str,
    topics_path: str,
    settings: Settings | None = None,
    dictionary: DataFrame | None = None,
    lexicon: DataFrame | None = None,
    model=None,
    names: DataFrame | None = None,
    groups: DataFrame | None = None,
) -> None:
    """Feed files to the two result tables; each table is written, then read by the next step.

    With ``groups`` (``group_domain``, as ``read_groups`` gives it) only listed groups are read.
    """
    settings = settings or Settings()
    stop = stop_words(spark, settings.language)
    posts = read_posts(spark, feed_path, settings.landing_path, settings.bad_rule)
    if groups is not None:
        posts = listed_posts(posts, groups)
    flat = flatten(
        posts,
        settings.first_date,
        settings.last_date,
        settings.stop_at_old,
        settings.max_posts,
        settings.max_comments,
    )
    write_table(label_table(flat, stop, dictionary, lexicon, model), labelled_path)
    negatives = negative_rows(read_table(spark, labelled_path))
    table = topic_table(
        negatives, settings.dims, names, stop, **settings.topic_options
    )
    write_table(table, topics_path)

"""Every operator as a query over the given tables: ``name -> (spark, folder) -> DataFrame``.

All of them run over whole tables and whole texts.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import params as P
from townpulse.functions import dates, text
from townpulse.operators import feed, forecast, ordering, terms, topics, trends, wording
from townpulse.plans import batch, reports
from townpulse.scale import shared_path
from townpulse.session import apply_settings
from townpulse.sources import feeds, tables, versions
from townpulse.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    """Register under the function's name; sessions built elsewhere get our settings."""

    @functools.wraps(fn)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        apply_settings(spark)
        return fn(spark, folder)

    QUERIES[fn.__name__] = run
    return run


# ---- the given tables in the shapes the operators expect -------------------


def table(spark, folder, name) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark, folder) -> DataFrame:
    """date_time, topic_name, group_domain, seq and the event's own columns."""
    return table(spark, folder, "events").withColumns(
        {
            "date_time": F.col("ts"),
            "topic_name": F.col("event_type"),
            "group_domain": F.col("user_id"),
            "seq": F.col("event_id"),
        }
    )


def orders(spark, folder) -> DataFrame:
    return table(spark, folder, "orders").withColumns(
        {
            "date_time": F.col("o_orderdate"),
            "topic_name": F.col("o_orderpriority"),
            "label": trends.recode("o_orderstatus", P.STATE_LABELS),
        }
    )


def raw_documents(spark, folder) -> DataFrame:
    return tables.read_table(spark, f"{folder}/documents.parquet", spread_by="doc_id")


def documents(spark, folder) -> DataFrame:
    return raw_documents(spark, folder).withColumn("cleaned", text.clean_text("text"))


def labelled(spark, folder) -> DataFrame:
    """Documents that have a training label, read as a sentiment."""
    label = (
        F.when(F.col("toxic") == 1, "negative")
        .when(F.col("quality") == 1, "positive")
        .otherwise("neutral")
    )
    marks = table(spark, folder, "labels").select("doc_id", label.alias("label"))
    return raw_documents(spark, folder).join(marks, "doc_id")


def document_feed(spark, folder) -> DataFrame:
    """Each document as a post of its source; its lines are the comments. Dates repeat every 1000 hours.

    Every seventh comment has no date and every ninth no author.
    """
    start = F.lit(1704067200).cast("bigint") + F.col("doc_id") % 1000 * 3600
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(
            (i + 1).cast("bigint").alias("id"),
            F.when(i % 9 != 8, F.col("doc_id") + i).alias("from_id"),
            F.when(i % 7 != 6, start + i * 60).alias("date"),
            line.alias("text"),
        ),
    )
    return raw_documents(spark, folder).select(
        F.col("source").alias("group_domain"),
        F.col("doc_id").alias("seq"),
        F.col("doc_id").alias("id"),
        (-F.col("doc_id")).alias("owner_id"),
        F.col("n_chars").alias("from_id"),
        start.alias("date"),
        F.col("lang").alias("text"),
        lines.alias("comments"),
    )


def some_without(name: str):
    """The column, null where its hash says so: about one value in sixteen."""
    return F.when(F.left(F.md5(F.col(name).cast("string")), F.lit(1)) != "0", F.col(name))


def conversation_posts(spark, folder) -> tuple[DataFrame, DataFrame]:
    """First turns as posts, later turns as comments; hours and minutes as dates."""
    turns = table(spark, folder, "conversations").withColumns(
        {
            "owner_id": -F.col("conv_id"),
            "post_id": F.col("conv_id"),
            "from_id": F.when(F.col("role") == "user", 1).otherwise(2).cast("bigint"),
        }
    )
    start = F.lit(1704067200).cast("bigint") + F.col("conv_id") * 3600
    posts = turns.filter("turn = 0").withColumns(
        {
            "group_domain": F.concat(F.lit("g"), (F.col("conv_id") % 3).cast("string")),
            "post_date": dates.from_epoch(start),
        }
    )
    comments = turns.filter("turn > 0").withColumns(
        {"comment_id": F.col("turn"), "comment_date": dates.from_epoch(start + F.col("turn") * 60)}
    )
    return posts, comments


# ---- time tables ------------------------------------------------------------


@query
def weekly_topic_counts(spark, folder):
    return trends.weekly_topic_counts(events(spark, folder))


@query
def date_range_filter(spark, folder):
    rows = trends.date_range(events(spark, folder), *P.EVENT_RANGE)
    return rows.select("event_id", "topic_name")


@query
def date_range_open_end(spark, folder):
    rows = trends.date_range(events(spark, folder), *P.EVENT_RANGE, end_inclusive=False)
    return rows.select("event_id", "topic_name")


@query
def week_keys(spark, folder):
    rows = tables.with_time_keys(orders(spark, folder))
    return rows.select("o_orderkey", F.col("year").cast("bigint").alias("year"), "week", "week_start")


@query
def monthly_topic_share(spark, folder):
    return trends.monthly_topic_share(orders(spark, folder))


@query
def monthly_share_calendar(spark, folder):
    return trends.monthly_topic_share(orders(spark, folder), by="calendar")


@query
def yearly_topic_counts(spark, folder):
    return trends.yearly_counts(orders(spark, folder), "topic_name")


@query
def yearly_top3(spark, folder):
    return trends.yearly_top(orders(spark, folder))


@query
def yearly_label_share(spark, folder):
    shares = trends.yearly_label_share(orders(spark, folder))
    return shares.withColumn("share", F.round("share", 6))


@query
def label_recode(spark, folder):
    rows = events(spark, folder).withColumn("name", trends.recode("event_type", P.EVENT_NAMES))
    return trends.without_nulls(rows, "name").groupBy("name").agg(F.count("*").alias("count"))


@query
def topic_filter(spark, folder):
    rows = trends.only_values(events(spark, folder), "topic_name", ["click", "error"])
    return rows.select("event_id", "topic_name", "value")


@query
def topic_names(spark, folder):
    return trends.distinct_sorted(events(spark, folder), "topic_name")


@query
def time_bounds(spark, folder):
    return trends.time_bounds(events(spark, folder))


@query
def latest_month(spark, folder):
    month = dates.month_of_week("date_time")
    return trends.latest_period(orders(spark, folder), month, "month_start")


# ---- feeds and stores -------------------------------------------------------


@query
def flatten_posts_comments(spark, folder):
    return feed.as_text_dates(feed.join_comments(*conversation_posts(spark, folder)))


@query
def flatten_nested_feed(spark, folder):
    return feed.as_text_dates(feed.flatten(document_feed(spark, folder), *P.FEED_RANGE))


@query
def comment_window(spark, folder):
    rows = trends.date_range(events(spark, folder), *P.COMMENT_RANGE)
    return rows.groupBy("group_domain").agg(F.count("*").alias("count"))


@query
def take_while_window(spark, folder):
    rows = events(spark, folder)
    first = dates.instant(P.COMMENT_RANGE[0])
    position = F.struct((-F.col("value")).alias("v"), F.col("event_id").alias("e"))
    before = ordering.take_while(rows, "group_domain", position, F.col("date_time") < first)
    return trends.date_range(before, *P.COMMENT_RANGE).select("group_domain", "event_id")


@query
def post_cap(spark, folder):
    rows = trends.date_range(events(spark, folder), *P.COMMENT_RANGE)
    rows = rows.withColumn("group_domain", some_without("group_domain"))
    kept = ordering.keep_first(rows, "group_domain", ["seq"], P.POST_CAP)
    return kept.select("group_domain", "event_id")


@query
def comment_cap(spark, folder):
    posts, comments = conversation_posts(spark, folder)
    heads = posts.select("post_id", "group_domain")
    rows = comments.join(heads, "post_id")
    levels = [F.col("post_id")]
    kept = ordering.keep_first(rows, "group_domain", ["post_id", "turn"], P.COMMENT_CAP, levels)
    return kept.select("group_domain", "post_id", "turn")


@query
def comment_cap_nested(spark, folder):
    posts = document_feed(spark, folder).withColumn("group_domain", some_without("group_domain"))
    flat = feed.flatten(posts, max_comments=P.NESTED_COMMENT_CAP)
    return flat.select("group_domain", "post_id", "comment_id")


@query
def post_batches(spark, folder):
    rows = events(spark, folder).withColumn("group_domain", some_without("group_domain"))
    rows = feed.post_batches(rows, size=10)
    return rows.select("group_domain", "event_id", "number", "batch")


@query
def epoch_format(spark, folder):
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    shown = dates.stamp_text(dates.from_epoch(seconds))
    return events(spark, folder).select("event_id", shown.alias("stamp"))


@query
def rows_per_group(spark, folder):
    return feed.rows_per_group(table(spark, folder, "documents"), "source")


@query
def append_union(spark, folder):
    rows = events(spark, folder).select("event_id", "date_time", "topic_name")
    first = trends.date_range(rows, None, P.EVENT_RANGE[1])
    second = trends.date_range(rows, P.EVENT_RANGE[0], None)
    both = feed.append_runs(first, second)
    return both.groupBy("event_id").agg(F.count("*").alias("copies"))


@query
def append_dedup(spark, folder):
    rows = events(spark, folder).select("event_id", "date_time", "topic_name")
    first = trends.date_range(rows, None, P.EVENT_RANGE[1])
    second = trends.date_range(rows, P.EVENT_RANGE[0], None)
    return feed.drop_repeats(feed.append_runs(first, second), ["event_id"]).select(
        "event_id", "topic_name"
    )


@query
def feed_files(spark, folder):
    """The feed written as JSON lines per group, read back and flattened."""
    path = shared_path(spark, "feed")
    posts = document_feed(spark, folder)
    line = F.to_json(F.struct(*[c for c in posts.columns if c != "group_domain"]))
    posts.select("group_domain", line.alias("value")).write.partitionBy("group_domain").text(path)
    return feed.as_text_dates(feed.flatten(feeds.read_posts(spark, path)))


@query
def stream_ingest(spark, folder):
    """The same files taken in by the incremental job."""
    path, store, state = (shared_path(spark, n) for n in ("feed", "store", "state"))
    posts = document_feed(spark, folder)
    line = F.to_json(F.struct(*[c for c in posts.columns if c != "group_domain"]))
    posts.select("group_domain", line.alias("value")).write.partitionBy("group_domain").text(path)
    jobs.ingest_new(spark, path, store, state, files_per_batch=32).awaitTermination()
    return feed.as_text_dates(spark.read.parquet(store).select(*feed.FLAT_COLUMNS))


def broken_feed(spark, folder) -> str:
    """The feed as files, with the line of every thirteenth document cut in half."""
    path = shared_path(spark, "feed")
    posts = document_feed(spark, folder)
    line = F.to_json(F.struct(*[c for c in posts.columns if c != "group_domain"]))
    half = F.when(F.col("seq") % 13 == 5, F.substr(line, F.lit(1), F.greatest(F.length(line) / 2, F.lit(1)).cast("int")))
    lines = posts.select("group_domain", F.coalesce(half, line).alias("value"))
    lines.write.partitionBy("group_domain").text(path)
    return path


@query
def bad_groups(spark, folder):
    """What each group lost to unreadable lines, by a batch run and by the incremental job."""
    path = broken_feed(spark, folder)
    landing, store, state = (shared_path(spark, n) for n in ("landed", "store", "state"))
    feeds.read_posts(spark, path, f"{landing}/batch")
    jobs.ingest_new(
        spark, path, store, state, landing=f"{landing}/stream", rule="line", files_per_batch=32
    ).awaitTermination()
    runs = [
        feeds.manifest(spark, f"{landing}/{mode}").withColumn("mode", F.lit(mode)) for mode in ("batch", "stream")
    ]
    return runs[0].unionByName(runs[1]).groupBy("mode", "group_domain").agg(
        F.sum("lines").alias("lines"), F.sum("bad").alias("bad"), F.bool_and("kept").alias("kept")
    )


@query
def readable_posts(spark, folder):
    """Posts left by either rule, in either run mode."""
    path = broken_feed(spark, folder)
    found = []
    for rule in feeds.RULES:
        posts = feeds.read_posts(spark, path, rule=rule).select("id", F.lit("batch").alias("mode"))
        found.append(posts.withColumn("rule", F.lit(rule)))
    store, state = shared_path(spark, "store"), shared_path(spark, "state")
    jobs.ingest_new(spark, path, store, state, rule="line", files_per_batch=32).awaitTermination()
    stored = spark.read.parquet(store).filter("comment_id IS NULL")
    found.append(stored.select(F.col("post_id").alias("id"), F.lit("stream").alias("mode"), F.lit("line").alias("rule")))
    return feed.append_runs(*found).select("mode", "rule", "id")


def event_versions(spark, folder) -> DataFrame:
    """Events as rows that replace each other: one key for every three, different values under it."""
    rows = events(spark, folder)
    return rows.select(
        F.floor(F.col("event_id") / 3).alias("key"),
        F.when(F.col("event_id") % 11 != 0, F.col("event_id") % 5).alias("version"),
        "event_id",
        "topic_name",
        "date_time",
    )


@query
def latest_rows(spark, folder):
    rows = event_versions(spark, folder).drop("date_time")
    return feed.latest_rows(rows, ["key"], "version")


@query
def latest_rows_stream(spark, folder):
    """The same events as a stream; a week of lateness covers a key's rows."""
    path, table_path, state = (shared_path(spark, n) for n in ("events", "latest", "state"))
    event_versions(spark, folder).repartitionByRange(4, "event_id").write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 2).parquet(path)
    jobs.keep_latest_rows(stream, table_path, state, ["key"], "version", "date_time", "60 days").awaitTermination()
    return versions.read_version(spark, table_path, stream.schema).drop("date_time")


@query
def csv_store(spark, folder):
    """The flat table through the CSV file, in two batches."""
    path = shared_path(spark, "csv")
    posts, comments = conversation_posts(spark, folder)
    flat = feed.join_comments(posts, comments)
    tables.write_comments(flat.filter("comment_id is null"), path, first=True)
    tables.write_comments(flat.filter("comment_id is not null"), path, first=False)
    return feed.as_text_dates(tables.read_comments(spark, path))


@query
def group_store(spark, folder):
    """The flat table appended twice to the per-group store."""
    path = shared_path(spark, "groups")
    flat = feed.join_comments(*conversation_posts(spark, folder))
    tables.append_groups(flat, path)
    tables.append_groups(flat, path)
    return feed.rows_per_group(tables.read_store(spark, path))


@query
def group_list(spark, folder):
    """Posts of the groups on a list with spaces around names, blank lines and repeats."""
    path = shared_path(spark, "groups")
    posts = document_feed(spark, folder)
    names = posts.select("group_domain").distinct().filter(F.length("group_domain") % 2 == 0)
    name = F.col("group_domain")
    lines = F.explode(F.array(name, F.lit("  "), F.concat(F.lit(" \t"), name, F.lit("  ")), F.lit("nobody")))
    names.select(lines.alias("value")).write.text(path)
    groups = feeds.read_groups(spark, path)
    listed = feeds.listed_posts(posts, groups).groupBy("group_domain").agg(F.count("*").alias("posts"))
    repeats = groups.groupBy("group_domain").agg(F.count("*").alias("listed"))
    return repeats.join(listed, "group_domain", "left")


# ---- dates as text, stored answers ------------------------------------------


@query
def lenient_dates(spark, folder):
    """Dates as text in several forms, some of them no dates."""
    stamp = dates.stamp_text("date_time")
    written = (
        F.when(F.col("o_orderkey") % 5 == 0, stamp)
        .when(F.col("o_orderkey") % 5 == 1, F.substring(stamp, 1, 10))
        .when(F.col("o_orderkey") % 5 == 2, F.concat(F.substring(stamp, 1, 8), F.lit("31 10:00:00")))
        .when(F.col("o_orderkey") % 5 == 3, F.concat(F.lit("on "), stamp))
    )
    rows = orders(spark, folder).withColumn("written", written)
    return rows.select("o_orderkey", dates.stamp_text(dates.parse_lenient("written")).alias("stamp"))


@query
def strict_dates(spark, folder):
    rows = orders(spark, folder).withColumn("written", F.date_format("date_time", dates.FRESHNESS_FORMAT))
    read = dates.parse_strict("written", dates.FRESHNESS_FORMAT)
    return rows.select("o_orderkey", dates.stamp_text(read).alias("stamp"))


@query
def stored_answers(spark, folder):
    """Texts of stored naming answers in both of their shapes, and of answers without a text."""
    plain = F.to_json(F.struct(F.array(F.struct("text")).alias("choices")))
    spoken = F.to_json(
        F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices"))
    )
    answer = F.when(F.col("turn") % 3 == 0, plain).when(F.col("turn") % 3 == 1, spoken).otherwise('{"choices": []}')
    rows = table(spark, folder, "conversations").withColumn("answer", answer)
    return rows.select("conv_id", "turn", text.answer_text("answer").alias("name"))


# ---- words ------------------------------------------------------------------


@query
def clean_text(spark, folder):
    return documents(spark, folder).select("doc_id", "cleaned")


@query
def strip_links(spark, folder):
    return table(spark, folder, "pages").select("page_id", text.remove_links("html").alias("text"))


@query
def strip_emojis(spark, folder):
    """Every text with one of some emoji signs in its middle and another at its end."""
    docs = raw_documents(spark, folder)
    signs = F.array(*[F.lit(e) for e in P.EMOJI])
    half = F.floor(F.char_length("text") / 2).cast("int")

    def sign(shift: int):
        return F.get(signs, ((F.col("doc_id") + shift) % len(P.EMOJI)).cast("int"))

    with_signs = F.concat(
        F.substr("text", F.lit(1), half), sign(0), F.substr("text", half + 1), sign(1), F.lit("end")
    )
    return docs.select("doc_id", text.remove_emojis(with_signs).alias("text"))


@query
def remove_stopwords(spark, folder):
    docs = documents(spark, folder)
    return docs.select("doc_id", text.remove_stopwords("cleaned", P.STOP).alias("text"))


@query
def prepare_text(spark, folder):
    docs = wording.prepare(raw_documents(spark, folder), P.STOP)
    return docs.select("doc_id", "text_preprocessed")


@query
def lemmatize(spark, folder):
    dictionary = spark.createDataFrame(list(P.LEMMAS.items()), "form string, lemma string")
    docs = wording.lemmatize(documents(spark, folder), dictionary, "doc_id", "cleaned")
    return docs.select("doc_id", "lemmas")


@query
def lexicon_sentiment(spark, folder):
    lexicon = spark.createDataFrame(list(P.SCORES.items()), "word string, score bigint")
    docs = wording.lexicon_score(documents(spark, folder), lexicon, "doc_id", "cleaned")
    return docs.select("doc_id", "score", wording.score_label("score").alias("label"))


@query
def lemmatize_joined(spark, folder):
    """Every document twice, under one id, with the dictionary joined instead of sent along."""
    dictionary = spark.createDataFrame(list(P.LEMMAS.items()), "form string, lemma string")
    docs = documents(spark, folder)
    found = wording.lemmatize(feed.append_runs(docs, docs), dictionary, "doc_id", "cleaned", max_rows=0)
    return found.select("doc_id", "lemmas")


@query
def lexicon_sentiment_joined(spark, folder):
    lexicon = spark.createDataFrame(list(P.SCORES.items()), "word string, score bigint")
    docs = documents(spark, folder)
    found = wording.lexicon_score(feed.append_runs(docs, docs), lexicon, "doc_id", "cleaned", max_rows=0)
    return found.select("doc_id", "score", wording.score_label("score").alias("label"))


@query
def trained_sentiment(spark, folder):
    model = wording.train_sentiment(labelled(spark, folder))
    docs = wording.predict_sentiment(raw_documents(spark, folder), model)
    return docs.select("doc_id", "label")


@query
def bayes_sentiment(spark, folder):
    model = wording.train_bayes(labelled(spark, folder))
    docs = wording.predict_bayes(raw_documents(spark, folder), model, "doc_id", score="score")
    return docs.select("doc_id", "label", F.round("score", 4).alias("score"))


@query
def bayes_sentiment_joined(spark, folder):
    """The same with the words' weights joined instead of sent along."""
    model = wording.train_bayes(labelled(spark, folder))
    docs = raw_documents(spark, folder)
    found = wording.predict_bayes(docs, model, "doc_id", score="score", max_rows=0)
    return found.select("doc_id", "label", F.round("score", 4).alias("score"))


@query
def label_wrap_exact(spark, folder):
    docs = raw_documents(spark, folder)
    return docs.select("doc_id", text.wrap_label("text", 5, "exact").alias("label"))


@query
def label_wrap_clean(spark, folder):
    docs = raw_documents(spark, folder)
    return docs.select("doc_id", text.wrap_label("text", 5).alias("label"))


@query
def series_name(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", text.series_name("text").alias("name"))


# ---- terms and topics -------------------------------------------------------


@query
def negative_rows(spark, folder):
    rows = labelled(spark, folder).withColumn("text_preprocessed", F.col("text"))
    return batch.negative_rows(rows).select("doc_id", "cleaned")


@query
def tfidf(spark, folder):
    weights = terms.tfidf(documents(spark, folder), "doc_id", stop=P.STOP)
    return weights.withColumn("weight", F.round("weight", 6))


@query
def topic_word_freq(spark, folder):
    words = terms.word_frequencies(documents(spark, folder), "source", stop=P.STOP)
    return words.withColumn("frequency", F.round("frequency", 6))


@query
def topic_phrase_freq(spark, folder):
    words = terms.phrase_frequencies(documents(spark, folder), "source", stop=P.STOP)
    return words.withColumn("frequency", F.round("frequency", 6))


@query
def topic_terms(spark, folder):
    ranked = terms.topic_terms(documents(spark, folder), "source", stop=P.STOP)
    return ranked.withColumn("weight", F.round("weight", 6))


@query
def topic_terms_normalised(spark, folder):
    ranked = terms.topic_terms(
        documents(spark, folder), "source", stop=P.STOP, count=30, normalise=True
    )
    return ranked.withColumn("weight", F.round("weight", 6))


@query
def topic_word_line(spark, folder):
    ranked = terms.topic_terms(documents(spark, folder), "source", stop=P.STOP)
    return terms.topic_lines(ranked, "source")


@query
def topic_names_auto(spark, folder):
    ranked = terms.topic_terms(documents(spark, folder), "source", stop=P.STOP)
    return terms.auto_names(ranked, "source")


@query
def named_rows(spark, folder):
    """Row counts as names; labels 8 and 9 stand for noise and an unlisted topic."""
    label = F.col("label")
    topic = F.when(label == 8, -1).when(label == 9, 46).otherwise(label).cast("bigint")
    rows = table(spark, folder, "embeddings").select("vec_id", topic.alias("topic"))
    names = rows.groupBy("topic").agg(
        F.concat(F.lit("topic of "), F.count("*").cast("string")).alias("topic_name")
    )
    return terms.attach_names(rows, names, last=terms.LAST_LISTED_TOPIC)


@query
def topic_comments(spark, folder):
    rows = terms.first_comments(table(spark, folder, "documents"), "source", ["doc_id"], 20)
    return rows.select("source", "position", "doc_id", "text")


@query
def one_topic_comments(spark, folder):
    rows = terms.first_comments(
        table(spark, folder, "documents"), "source", ["doc_id"], 20, value="src3"
    )
    return rows.select("doc_id", "text")


@query
def assign_centroid(spark, folder):
    vectors = table(spark, folder, "embeddings")
    centroids = topics.topic_centroids(vectors, "label", "embedding")
    found = topics.assign_topics(vectors, centroids, "vec_id", "embedding", "label", 0.3)
    return found.withColumn("closeness", F.round("closeness", 6))


@query
def density_topics(spark, folder):
    found = topics.density_topics(
        table(spark, folder, "embeddings"),
        "vec_id",
        "embedding",
        bits=P.BITS,
        tables=P.TABLES,
        threshold=P.CLOSE,
    )
    return found.select("vec_id", "topic")


@query
def kmeans_topics(spark, folder):
    found = topics.kmeans_topics(
        table(spark, folder, "embeddings"), "vec_id", "embedding", 10, threshold=0.3
    )
    return found.select("vec_id", "topic")


@query
def density_topics_text(spark, folder):
    rows = documents(spark, folder).withColumn("row_id", F.col("doc_id"))
    found = batch.topic_table(rows, dims=128, stop=P.STOP, threshold=0.6)
    return found.select("doc_id", "topic", "topic_name")


# ---- forecasts --------------------------------------------------------------


@query
def forecast_trend(spark, folder):
    shares = trends.monthly_topic_share(orders(spark, folder))
    return forecast.forecast_series(shares, season=None)


@query
def forecast_seasonal(spark, folder):
    return forecast.forecast_series(trends.monthly_topic_share(orders(spark, folder)))


@query
def series_last_value(spark, folder):
    shares = trends.monthly_topic_share(orders(spark, folder))
    return trends.last_values(shares, "percent", "month_start")


@query
def share_with_forecast(spark, folder):
    return forecast.share_with_forecast(trends.monthly_topic_share(orders(spark, folder)))


# ---- streams and whole reports ----------------------------------------------


@query
def stream_weekly_counts(spark, folder):
    path, state = shared_path(spark, "weekly"), shared_path(spark, "state")
    schema = table(spark, folder, "events").schema
    stream = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(folder)
        .select(F.col("ts").alias("date_time"), F.col("event_type").alias("topic_name"))
    )
    jobs.keep_weekly_counts(stream, path, state).awaitTermination()
    return jobs.read_weekly_counts(spark, path)


@query
def report_weekly(spark, folder):
    return reports.weekly_trend(events(spark, folder), *P.EVENT_RANGE, ["click", "view"])


@query
def report_monthly(spark, folder):
    return reports.monthly_shares(orders(spark, folder), "1996-01-01", "2000-12-31")


@query
def report_yearly_top(spark, folder):
    return reports.yearly_view(orders(spark, folder), orders(spark, folder), "1996-01-01", "2000-12-31")[0]


@query
def report_yearly_labels(spark, folder):
    shares = reports.yearly_view(orders(spark, folder), orders(spark, folder), "1996-01-01", "2000-12-31")[1]
    return shares.withColumn("share", F.round("share", 6))


# one topic that is there and one that is not, which gives no rows
ASKED = ["src3", "no such topic"]


@query
def report_topic_words(spark, folder):
    docs = documents(spark, folder).withColumn("topic_name", F.col("source"))
    clouds = [reports.topic_words(docs, name, P.STOP).withColumn("asked", F.lit(name)) for name in ASKED]
    return feed.append_runs(*clouds).select(
        "asked", "term", "count", F.round("frequency", 6).alias("frequency")
    )


@query
def report_topic_comments(spark, folder):
    docs = documents(spark, folder).withColumn("topic_name", F.col("source"))
    shown = [
        reports.topic_comments(docs, name, ["doc_id"]).withColumn("asked", F.lit(name)) for name in ASKED
    ]
    return feed.append_runs(*shown).select("asked", "text")


def labelled_feed(spark, folder) -> DataFrame:
    """The feed of documents as the run's first result table, written and read again."""
    path = shared_path(spark, "labelled")
    lexicon = spark.createDataFrame(list(P.RUN_SCORES.items()), "word string, score bigint")
    flat = feed.flatten(document_feed(spark, folder))
    tables.write_table(batch.label_table(flat, P.STOP, lexicon=lexicon), path)
    return tables.read_table(spark, path)


@query
def full_run_labels(spark, folder):
    return labelled_feed(spark, folder).select("row_id", "text_preprocessed", "label")


@query
def full_run_topics(spark, folder):
    """Feed of documents to the topic table, through the labelled table."""
    topics_path = shared_path(spark, "topics")
    negatives = batch.negative_rows(labelled_feed(spark, folder))
    found = batch.topic_table(negatives, dims=128, stop=P.STOP, threshold=0.6)
    tables.write_table(found, topics_path)
    return tables.read_table(spark, topics_path).select("row_id", "topic", "topic_name")

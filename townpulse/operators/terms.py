"""Weights and frequencies of words, per document and per topic.

Inputs hold text that went through ``clean_text``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from townpulse.functions.lookup import counted_keys, key_bitmap, values_sent_along
from townpulse.functions.text import SPACE, terms, word_line, words
from townpulse.scale import attach, settle

# Document-frequency cuts of the vectoriser and list lengths (fixed).
MIN_DF = 10
MAX_DF = 0.9
TERMS_PER_TOPIC = 10
CLOUD_WORDS = 200
# Terms and weights that are sent to every task at once.
MOST_VOCABULARY_BYTES = 64 << 20
# Likelihood ratio above which two neighbouring words are a phrase (fixed).
PHRASE_THRESHOLD = 30.0
# Words that clouds leave out.
BARE_NUMBER = r"^\p{Nd}+$"
# Bytes of texts whose words and pairs a task counts together, and rows of counts in a batch.
SLICE_BYTES, COUNT_ROWS = 16 << 20, 1 << 17
# Topics listed and named: ids 0 to 45 (fixed).
LAST_LISTED_TOPIC = 45


def unit_weights(words_of: Column, idfs: Column) -> Column:
    """Array of (term, weight) of a row: its different words with an idf, as a vector of length 1."""

    @F.arrow_udf("array<struct<term:string,weight:double>>")
    def weigh(lists: pa.Array, idfs: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(lists)), sizes)
        coded = lists.flatten().dictionary_encode()
        idf = idfs.flatten().to_numpy(zero_copy_only=False).astype(float)
        known = np.flatnonzero(~np.isnan(idf))
        size = max(1, len(coded.dictionary))
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pair, first, count = np.unique(rows[known] * size + code[known], return_index=True, return_counts=True)
        row, weight = pair // size, count * idf[known][first]
        length = np.sqrt(np.bincount(row, weight * weight, len(lists)))
        made = pa.StructArray.from_arrays(
            [coded.dictionary.take(pa.array(pair % size)), pa.array(weight / length[row])], ["term", "weight"]
        )
        offsets = np.append(0, np.cumsum(np.bincount(row, minlength=len(lists))))
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), made)

    return weigh(words_of, idfs)


def tfidf(
    docs: DataFrame,
    key: str,
    text: str = "cleaned",
    stop: list[str] = (),
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
    max_rows: int | None = None,
) -> DataFrame:
    """``key, term, weight``: term count times smoothed idf, each document of length 1.

    Terms in fewer than ``min_df`` documents or in more than the share ``max_df``
    of them are left out. ``key`` names one row each. A vocabulary of up to
    64 MB (or, where given, ``max_rows`` terms) goes to every task, where a row's terms are counted, weighed
    and scaled in the row; with a larger one (key, term, count), counted in the row and
    without words that a bitmap rules out, is shuffled to the terms and (key, term, weight) back.
    Texts stay where they are. Runs the vocabulary.
    """
    total = docs.agg(F.count("*").alias("n")).scalar()
    vocabulary = settle(
        docs.select(F.explode(F.array_distinct(terms(text, stop))).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("_df"))
        .withColumn("_all", total)
        .filter((F.col("_df") >= min_df) & (F.col("_df") <= F.col("_all") * F.lit(max_df)))
        .select("term", (F.ln((1 + F.col("_all")) / (1 + F.col("_df"))) + 1).alias("_idf"))
    )
    many, size = vocabulary.agg(F.count("*"), F.sum(F.octet_length("term") + 12)).first()
    if many <= max_rows if max_rows is not None else (size or 0) <= MOST_VOCABULARY_BYTES:
        # split once; words outside the vocabulary, stop words among them, have no idf
        split = docs.select(key, words(text).alias("_words"))
        idfs = values_sent_along(vocabulary, "term", "_idf", F.col("_words"))
        weighed = split.withColumn("_idfs", idfs).select(
            key, F.explode(unit_weights(F.col("_words"), F.col("_idfs"))).alias("_w")
        )
        return weighed.select(key, "_w.term", "_w.weight")
    counted = counted_keys(key_bitmap(vocabulary, "term"), words(text), vocabulary)
    counts = docs.select(key, F.explode(counted).alias("_t")).select(key, F.col("_t.w").alias("term"), "_t.n")
    met = counts.join(vocabulary.hint("merge"), "term").select(key, "term", (F.col("n") * F.col("_idf")).alias("_w"))
    # rows of one key are summed by term; one shuffle and sort serve the sums and the lengths
    by_term = W.partitionBy(key).orderBy("term")
    weighed = met.select(
        key,
        "term",
        F.sum("_w").over(by_term.rangeBetween(W.currentRow, W.currentRow)).alias("_w"),
        F.lag("term").over(by_term).eqNullSafe(F.col("term")).alias("_again"),
    ).filter(~F.col("_again"))
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(W.partitionBy(key)))
    return weighed.select(key, "term", (F.col("_w") / length).alias("weight"))


def topic_term_counts(
    df: DataFrame, topic: str, text: str = "cleaned", stop: list[str] = ()
) -> DataFrame:
    """``topic, term, count`` over all texts of each topic; rows without topic are left out.

    Counts are combined before the shuffle, so a topic or word of any size is
    spread over the tasks that read it.
    """
    return (
        df.filter(F.col(topic).isNotNull())
        .select(topic, F.explode(terms(text, stop)).alias("term"))
        .groupBy(topic, "term")
        .agg(F.count("*").alias("count"))
    )


def word_frequencies(
    df: DataFrame,
    topic: str,
    text: str = "cleaned",
    stop: list[str] = (),
    count: int = CLOUD_WORDS,
) -> DataFrame:
    """``topic, term, count, frequency``: the words of each topic's cloud.

    The ``count`` most frequent words other than stop words and bare numbers,
    ties by word; ``frequency`` is relative to the topic's most frequent word.
    """
    counts = topic_term_counts(df, topic, text, stop)
    return cloud(counts.filter(~F.col("term").rlike(BARE_NUMBER)), topic, count)


def likelihood_ratio(both, first, second, total) -> Column:
    """Dunning's (1993) log-likelihood ratio of two words standing next to each other."""

    def fit(hits: Column, tries: Column, chance: Column) -> Column:
        tiny = F.lit(1e-10)
        return F.ln(F.greatest(chance, tiny)) * hits + F.ln(F.greatest(1 - chance, tiny)) * (
            tries - hits
        )

    alone = second - both
    rest = total - first
    ratio = (
        fit(both, first, second / total)
        + fit(alone, rest, second / total)
        - fit(both, first, both / first)
        - fit(alone, rest, F.try_divide(alone, rest))
    )
    return F.when((total <= first) | (total <= second), 0.0).otherwise(-2 * ratio)


def word_and_pair_counts(df: DataFrame, topic: str, text: str, stop: list[str]) -> DataFrame:
    """``topic, _w1, _w2, count``: words other than stop words and bare numbers (``_w2`` null), and
    neighbouring pairs of them.

    A text is read and split once; its words and pairs are one stream, combined before its one shuffle.
    """
    listed_words = list(stop)

    def usable(word: Column) -> Column:
        return ~word.isin(listed_words) if listed_words else F.lit(True)

    def both(tokens: Column) -> Column:
        zipped = F.arrays_zip(tokens.alias("_w1"), F.slice(tokens, F.lit(2), F.size(tokens)).alias("_w2"))
        pairs = F.filter(zipped, lambda z: z["_w2"].isNotNull() & usable(z["_w1"]) & usable(z["_w2"]))
        alone = F.transform(
            F.filter(tokens, usable),
            lambda w: F.struct(w.alias("_w1"), F.lit(None).cast("string").alias("_w2")),
        )
        return F.concat(alone, pairs)

    tokens = F.filter(terms(text), lambda w: ~w.rlike(BARE_NUMBER))
    return (
        df.filter(F.col(topic).isNotNull())
        .select(topic, F.explode(F.transform(F.array(tokens), both)[0]).alias("z"))
        .groupBy(topic, F.col("z._w1").alias("_w1"), F.col("z._w2").alias("_w2"))
        .agg(F.count("*").alias("count"))
    )


def slice_counts(topics: pa.Array, texts: pa.Array, stop: pa.Array) -> pa.Table:
    """``word_and_pair_counts`` of some rows, whose texts have single spaces between words.

    What a word is told by is looked at once for each different word; words of a topic and pairs of them
    are numbered, and the numbers are counted.
    """
    lists = pc.split_pattern(texts, " ")
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    vocabulary, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    number = pc.match_substring_regex(vocabulary, BARE_NUMBER).to_numpy(zero_copy_only=False)
    token = (pc.utf8_length(vocabulary).to_numpy(zero_copy_only=False) >= 2) & ~number.astype(bool)
    at = np.flatnonzero(token[code])
    row, code = np.repeat(np.arange(len(lists)), sizes)[at], code[at]
    usable = ~pc.is_in(vocabulary, value_set=stop).to_numpy(zero_copy_only=False).astype(bool)[code]
    of = topics.dictionary_encode()
    group = of.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = max(1, len(vocabulary))
    lone, place, n = np.unique(group[row] * size + code, return_inverse=True, return_counts=True)
    neighbours = np.flatnonzero((row[1:] == row[:-1]) & usable[1:] & usable[:-1])
    many = max(1, len(lone))
    pair, n_pair = np.unique(place[neighbours] * many + place[neighbours + 1], return_counts=True)
    kept = np.zeros(len(lone), bool)
    kept[place[usable]] = True
    first = np.concatenate([lone[kept], lone[pair // many]])
    second = np.concatenate([np.zeros(int(kept.sum()), np.int64), lone[pair % many] % size])
    no_second = np.arange(len(first)) < kept.sum()
    return pa.table(
        {
            "topic": of.dictionary.take(pa.array(first // size)),
            "_w1": vocabulary.take(pa.array(first % size)),
            "_w2": vocabulary.take(pa.array(second, mask=no_second)),
            "n": pa.array(np.concatenate([n[kept], n_pair])),
        }
    )


def counts_by_first_word(df: DataFrame, topic: str, text: str, stop: list[str]) -> DataFrame:
    """``word_and_pair_counts`` and ``_c1``, the count of the pair's first word.

    Like the plain form, which tests compare it with, but words are looked at in slices of rows: a task counts slices of rows, and what it counted is shuffled once, to the first word: there a word
    meets its pairs. A word has as many rows as it has different neighbours in each slice.
    """
    listed_words = pa.array(list(stop), pa.string())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            slices = np.cumsum(lengths, dtype=np.int64) // SLICE_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(slices)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi > lo:
                    some = batch.slice(lo, hi - lo)
                    found = slice_counts(some.column(0), some.column(1), listed_words)
                    yield from found.to_batches(max_chunksize=COUNT_ROWS)

    kind = df.schema[topic].dataType.simpleString()
    # sorted by word first: the first bytes of topics tell little apart
    by_first = W.partitionBy("_w1", "topic")
    return (
        df.filter(F.col(topic).isNotNull())
        .select(F.col(topic).alias("topic"), F.regexp_replace(text, f"[{SPACE}]+", " ").alias("text"))
        .mapInArrow(count, f"topic {kind}, _w1 string, _w2 string, n bigint")
        .repartition("topic", "_w1")
        .groupBy("topic", "_w1", "_w2")
        .agg(F.sum("n").alias("count"))
        .withColumn("_c1", F.max(F.when(F.col("_w2").isNull(), F.col("count"))).over(by_first))
        .withColumnRenamed("topic", topic)
    )


def phrase_frequencies(
    df: DataFrame,
    topic: str,
    text: str = "cleaned",
    stop: list[str] = (),
    count: int = CLOUD_WORDS,
    threshold: float = PHRASE_THRESHOLD,
) -> DataFrame:
    """``topic, term, count, frequency`` as ``word_frequencies``, with two-word phrases.

    Neighbouring words of a text, neither of them a stop word, are a phrase where
    their likelihood ratio in the topic is above ``threshold``. Occurrences of a
    phrase are taken off the counts of its words. Pairs are counted before they
    meet the word counts: that of the first word where they are counted, that of
    the second in a join, which sees each pair of a topic once.
    """
    counts = settle(counts_by_first_word(df, topic, text, stop))
    lone = counts.filter(F.col("_w2").isNull()).select(topic, F.col("_w1").alias("term"), "count")
    pairs = counts.filter(F.col("_w2").isNotNull())
    total = lone.groupBy(topic).agg(F.sum("count").alias("_n"))
    second = lone.select(topic, F.col("term").alias("_w2"), F.col("count").alias("_c2"))
    score = likelihood_ratio(F.col("count"), F.col("_c1"), F.col("_c2"), F.col("_n"))
    # totals are one row a topic: sent along where they are few
    placed = attach(pairs.join(second, ["_w2", topic]), total, [topic], "inner")
    # read for the words' counts and for the phrases themselves
    phrases = settle(placed.filter(score > threshold).select(topic, "_w1", "_w2", "count"))
    taken = (
        phrases.select(topic, F.explode(F.array("_w1", "_w2")).alias("term"), "count")
        .groupBy(topic, "term")
        .agg(F.sum("count").alias("_taken"))
    )
    left = lone.join(taken, ["term", topic], "left").select(
        topic, "term", (F.col("count") - F.coalesce("_taken", F.lit(0))).alias("count")
    )
    both = left.filter(F.col("count") > 0).unionByName(
        phrases.select(topic, F.concat_ws(" ", "_w1", "_w2").alias("term"), "count")
    )
    return cloud(both, topic, count)


def cloud(counts: DataFrame, topic: str, count: int = CLOUD_WORDS) -> DataFrame:
    """The ``count`` largest rows of each topic, scaled to the largest."""
    best = W.partitionBy(topic).orderBy(F.desc("count"), F.asc("term"))
    return (
        counts.withColumn("_rank", F.row_number().over(best))
        .filter(F.col("_rank") <= count)
        .withColumn("frequency", F.col("count") / F.max("count").over(W.partitionBy(topic)))
        .drop("_rank")
    )


def topic_terms(
    df: DataFrame,
    topic: str,
    text: str = "cleaned",
    stop: list[str] = (),
    count: int = TERMS_PER_TOPIC,
    normalise: bool = False,
) -> DataFrame:
    """``topic, rank, term, weight``: the words that set each topic apart.

    Class-based TF-IDF (Grootendorst 2022): a term's count in the topic times
    ``ln(1 + mean words per topic / count of the term in all topics)``. With
    ``normalise`` the count is divided by the topic's words.
    """
    # counted once; the mean, the totals and the weights all read the counts
    counts = settle(topic_term_counts(df, topic, text, stop))
    mean_words = counts.agg((F.sum("count") / F.countDistinct(topic)).alias("a")).scalar()
    everywhere = F.sum("count").over(W.partitionBy("term"))
    weight = F.col("count") * F.ln(1 + F.col("_mean") / F.col("_f"))
    weighed = counts.withColumn("_f", everywhere).withColumn("_mean", mean_words)
    if normalise:
        totals = counts.groupBy(topic).agg(F.sum("count").alias("_words"))
        weighed = attach(weighed, totals, [topic], "inner")
        weight = weight / F.col("_words")
    best = W.partitionBy(topic).orderBy(F.desc("weight"), F.asc("term"))
    return (
        weighed.select(topic, "term", F.round(weight, 9).alias("weight"))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= count)
        .select(topic, F.col("rank").cast("bigint").alias("rank"), "term", "weight")
    )


def listed(topic, last: int = LAST_LISTED_TOPIC) -> Column:
    """Whether a topic id is among those listed: not noise, not beyond the last."""
    column = F.col(topic) if isinstance(topic, str) else topic
    return column.between(0, last)


def term_arrays(ranked: DataFrame, topic: str, count: int | None = None) -> DataFrame:
    """``topic, terms``: each topic's ranked words as one array (a short list per topic)."""
    if count is not None:
        ranked = ranked.filter(F.col("rank") <= count)
    pairs = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return ranked.groupBy(topic).agg(F.transform(pairs, lambda x: x["term"]).alias("terms"))


def topic_lines(ranked: DataFrame, topic: str, count: int = TERMS_PER_TOPIC) -> DataFrame:
    """``topic, line``: the words of each topic with bars between them."""
    return term_arrays(ranked, topic, count).select(topic, word_line("terms", count).alias("line"))


def auto_names(ranked: DataFrame, topic: str, count: int = 4) -> DataFrame:
    """``topic, topic_name``: the first words of each topic as its name."""
    arrays = term_arrays(ranked, topic, count)
    return arrays.select(topic, F.array_join("terms", " ").alias("topic_name"))


def attach_names(
    rows: DataFrame, names: DataFrame, topic: str = "topic", last: int | None = None
) -> DataFrame:
    """Left-join ``names`` (topic, topic_name) to rows; noise stays unnamed.

    With ``last`` topics beyond it stay unnamed too, and at most ``last + 1`` names
    are broadcast; without, the names are counted first.
    """
    wanted = F.col(topic) >= 0 if last is None else listed(topic, last)
    few = names.filter(wanted).groupBy(topic).agg(F.min("topic_name").alias("topic_name"))
    if last is None:
        return attach(rows, few, [topic])
    return rows.join(F.broadcast(few), topic, "left")


def first_comments(
    df: DataFrame, topic: str, order: list[str], count: int = 20, value=None
) -> DataFrame:
    """The first ``count`` rows of a topic in stored order, or of every topic.

    An unknown topic gives no rows. Adds ``position`` when all topics are asked for.
    """
    if value is not None:
        return df.filter(F.col(topic) == value).orderBy(*order).limit(count)
    place = F.row_number().over(W.partitionBy(topic).orderBy(*order))
    return (
        df.filter(F.col(topic).isNotNull())
        .withColumn("position", place.cast("bigint"))
        .filter(F.col("position") <= count)
    )

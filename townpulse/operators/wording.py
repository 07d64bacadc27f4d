"""Word-level labelling of texts: preparation, lemmas, sentiment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, IndexToString, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townpulse.functions.lookup import with_sums, with_values
from townpulse.functions.text import (
    clean_text,
    remove_emojis,
    remove_links,
    remove_stopwords,
    terms,
    words,
)
from townpulse.scale import BROADCAST_ROWS, settle


def prepare(df: DataFrame, stop: list[str], text: str = "text", out: str = "text_preprocessed"):
    """Links, emojis, punctuation and stop words removed, in that order."""
    ready = remove_stopwords(clean_text(remove_emojis(remove_links(text))), stop)
    return df.withColumn(out, ready)


def lemmatize(
    df: DataFrame,
    dictionary: DataFrame,
    key: str,
    text: str = "text_preprocessed",
    out: str = "lemmas",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Replace each word found in ``dictionary`` (form, lemma) by its lemma.

    Runs the dictionary to learn its size; beyond ``max_rows`` it is joined (see ``with_values``).
    ``key`` is not needed: rows are never told apart by it.
    """
    found = with_values(df, text, dictionary, "form", "lemma", "_lemmas", max_rows, line=True)
    return found.withColumn(out, F.col("_lemmas")).drop("_lemmas")


def lexicon_score(
    df: DataFrame,
    lexicon: DataFrame,
    key: str,
    text: str = "text_preprocessed",
    out: str = "score",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Sum of the ``lexicon`` (word, score: whole numbers) scores of a text's words."""
    given = F.col("score").isNotNull()
    lexicon = lexicon.filter(given).select("word", F.array(F.col("score").cast("bigint")).alias("score"))
    found = with_sums(df, text, lexicon, "word", "score", "_scores", max_rows)
    total = F.when(F.col(text).isNotNull(), F.coalesce(F.get("_scores", F.lit(0)), F.lit(0).cast("bigint")))
    return found.withColumn(out, total).drop("_scores")


def score_label(score) -> Column:
    """positive, negative or neutral by the sign of the score."""
    column = F.col(score) if isinstance(score, str) else score
    return F.when(column > 0, "positive").when(column < 0, "negative").otherwise("neutral")


def lexicon_sentiment(
    df: DataFrame,
    lexicon: DataFrame,
    key: str,
    text: str = "text_preprocessed",
    out: str = "label",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    scored = lexicon_score(df, lexicon, key, text, "_score", max_rows)
    return scored.withColumn(out, score_label("_score")).drop("_score")


def train_sentiment(
    examples: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 16
) -> PipelineModel:
    """Fit a classifier of hashed TF-IDF words to labelled ``examples``. Runs jobs."""
    words_of = terms(clean_text(text)).alias("_words")
    # every stage goes over the examples again; their words are made once
    ready = settle(examples.select(words_of, F.col(label).alias("_given")).na.drop())
    stages = [
        StringIndexer(inputCol="_given", outputCol="_target", stringOrderType="alphabetAsc"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        LogisticRegression(
            featuresCol="_tfidf",
            labelCol="_target",
            predictionCol="_class",
            rawPredictionCol="_raw",
            probabilityCol="_probability",
            family="multinomial",
            regParam=0.01,
            maxIter=30,
        ),
    ]
    model = Pipeline(stages=stages).fit(ready)
    names = IndexToString(inputCol="_class", outputCol="_name", labels=model.stages[0].labels)
    # the label indexer is for training only
    return PipelineModel([*model.stages[1:], names])


def predict_sentiment(
    df: DataFrame, model: PipelineModel, text: str = "text", out: str = "label"
) -> DataFrame:
    keep = [c for c in df.columns if c != out]
    scored = model.transform(df.withColumn("_words", terms(clean_text(F.coalesce(text, F.lit(""))))))
    return scored.select(*keep, F.col("_name").alias(out))


@dataclass
class BayesModel:
    """Multinomial naive Bayes as tables.

    ``table`` (word, gains): for each label by how much a word lifts it over one that the label never
    had, and a last 1. ``priors`` and ``floors``: each label's share of examples, and its weight of a
    word it never had, as logarithms.
    """

    labels: list[str]
    table: DataFrame
    priors: list[float]
    floors: list[float]


def train_bayes(
    examples: DataFrame, text: str = "text", label: str = "label", smoothing: float = 1.0
) -> BayesModel:
    """Count the words of labelled ``examples``. Runs jobs.

    Rows without label or text are not learned from. Only counts are shuffled, combined before; the
    labels are expected to be few, the words may be any number.
    """
    ready = examples.select(F.col(label).alias("label"), words(clean_text(text)).alias("words")).na.drop()
    sizes = ready.groupBy("label").agg(F.count("*").alias("rows"), F.sum(F.size("words")).alias("n")).collect()
    sizes.sort(key=lambda r: r.label)
    counts = settle(
        ready.select("label", F.explode("words").alias("word")).groupBy("label", "word").agg(F.count("*").alias("n"))
    )
    distinct = counts.agg(F.countDistinct("word").alias("v")).first().v
    of_label = [F.sum(F.when(F.col("label") == r.label, F.col("n")).otherwise(0)) for r in sizes]
    gains = F.array(*[F.ln((n + F.lit(smoothing)) / smoothing) for n in of_label], F.lit(1.0))
    weights = [F.lit(smoothing) / (F.lit(float(r.n)) + smoothing * distinct) for r in sizes]
    total = sum(r.rows for r in sizes)
    logs = ready.sparkSession.range(1).select(
        F.array(*[F.ln(F.lit(float(r.rows)) / total) for r in sizes]).alias("priors"),
        F.array(*[F.ln(w) for w in weights]).alias("floors"),
    ).first()
    return BayesModel(
        [r.label for r in sizes], counts.groupBy("word").agg(gains.alias("gains")), logs.priors, logs.floors
    )


def predict_bayes(
    df: DataFrame,
    model: BayesModel,
    key: str,
    text: str = "text",
    out: str = "label",
    score: str | None = None,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Add the label whose prior and words' weights sum to most, ties (9 digits) to the first by name.

    Words that no example had count nothing, and a text without known words, or null, gets the most
    frequent label. ``score`` names a column for the winning sum. Words are looked up as in
    ``lexicon_score``.
    """
    if not model.labels:
        raise ValueError("a model without labels")
    n = len(model.labels)
    nothing = F.array(*[F.lit(0.0)] * (n + 1))
    sums, body = f"_sums_{out}", f"_body_{out}"
    read = df.withColumn(body, clean_text(F.coalesce(text, F.lit(""))))
    found = with_sums(read, body, model.table, "word", "gains", sums, max_rows)
    # summed once: the totals read the sums several times
    found = found.withColumn(sums, F.transform(F.array(F.coalesce(sums, nothing)), lambda s: s)[0])
    totals = [
        F.round(F.lit(prior) + F.lit(floor) * F.get(sums, F.lit(n)) + F.get(sums, F.lit(i)), 9)
        for i, (prior, floor) in enumerate(zip(model.priors, model.floors, strict=True))
    ]
    ranked = F.array(*[F.struct(t.alias("s"), F.lit(-i).alias("i")) for i, t in enumerate(totals)])
    names = F.array(*[F.lit(name) for name in model.labels])
    best = found.withColumn(sums, F.array_max(ranked))
    added = {out: F.get(names, -F.col(f"{sums}.i"))} | ({score: F.col(f"{sums}.s")} if score else {})
    return best.withColumns(added).drop(sums, body)

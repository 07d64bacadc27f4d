import numpy as np
import pytest

from townpulse.operators import wording as W


@pytest.fixture
def texts(spark):
    rows = [
        (1, "дороги плохие и ямы ямы"),
        (2, ""),
        (3, "хорошие люди плохие дороги хорошие"),
        (4, None),
        (5, "ничего"),
    ]
    return spark.createDataFrame(rows, "id bigint, t string").repartition(3)


@pytest.fixture
def forms(spark):
    rows = [("дороги", "дорога"), ("ямы", "яма"), ("плохие", "плохой"), ("ямы", "ямы"), (None, "x")]
    return spark.createDataFrame(rows, "form string, lemma string")


@pytest.fixture
def lexicon(spark):
    return spark.createDataFrame([("плохие", -2), ("ямы", -1), ("хорошие", 1)], "word string, score int")


@pytest.mark.parametrize("max_rows", [200_000, 0])
def test_lemmas_in_row_or_joined(texts, forms, max_rows):
    found = W.lemmatize(texts, forms, "id", "t", max_rows=max_rows)
    assert {r.id: r.lemmas for r in found.collect()} == {
        1: "дорога плохой и яма яма",
        2: "",
        3: "хорошие люди плохой дорога хорошие",
        4: None,
        5: "ничего",
    }


@pytest.mark.parametrize("max_rows", [200_000, 0])
def test_lexicon_sentiment(texts, lexicon, max_rows):
    found = W.lexicon_sentiment(texts, lexicon, "id", "t", max_rows=max_rows)
    labels = {r.id: r.label for r in found.collect()}
    assert labels == {1: "negative", 2: "neutral", 3: "neutral", 4: "neutral", 5: "neutral"}
    assert found.columns == ["id", "t", "label"]


@pytest.mark.parametrize("max_rows", [200_000, 0])
def test_repeated_and_null_keys_stay_apart(spark, max_rows):
    rows = [("k", "was red"), ("k", "was blue"), (None, "was green"), (None, None), ("k", "")]
    texts = spark.createDataFrame(rows, "id string, t string")
    forms = spark.createDataFrame([("was", "be")], "form string, lemma string")
    found = W.lemmatize(texts, forms, "id", "t", max_rows=max_rows).collect()
    assert sorted(map(str, ((r.id, r.lemmas) for r in found))) == sorted(
        map(str, [("k", "be red"), ("k", "be blue"), (None, "be green"), (None, None), ("k", "")])
    )
    scores = spark.createDataFrame([("red", -1), ("blue", 1)], "word string, score int")
    found = W.lexicon_score(texts, scores, "id", "t", max_rows=max_rows).collect()
    assert {r.t: r.score for r in found if r.t} == {"was red": -1, "was blue": 1, "was green": 0}


def test_bounded_dictionary_moves_no_texts(texts, forms, spark, tmp_path):
    texts.write.parquet(str(tmp_path / "t"))
    found = W.lemmatize(spark.read.parquet(str(tmp_path / "t")), forms, "id", "t")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("Subquery")[0]
    assert "Generate" not in plan


def test_many_entries_are_found_in_their_buckets(spark):
    table = spark.range(5000).selectExpr("concat('w', id) AS form", "concat('l', id) AS lemma")
    rows = spark.range(5000).selectExpr("id", "concat('w', id, ' x', id, ' w', (id * 7) % 5000) AS t")
    found = W.lemmatize(rows, table, "id", "t")
    assert found.filter("lemmas <> concat('l', id, ' x', id, ' l', (id * 7) % 5000)").count() == 0


def test_empty_dictionary(texts, forms, lexicon):
    assert W.lemmatize(texts, forms.limit(0), "id", "t").filter("lemmas = t").count() == 4
    labels = W.lexicon_sentiment(texts, lexicon.limit(0), "id", "t").select("label").distinct()
    assert [r.label for r in labels.collect()] == ["neutral"]


def test_prepare_runs_the_steps_in_order(spark):
    rows = spark.createDataFrame([("Ямы \U0001f621 и ДОРОГИ: http://a.ru/и !",), (None,)], "text string")
    found = [r.text_preprocessed for r in W.prepare(rows, ["и"]).collect()]
    assert found == ["ямы дороги", None]


def test_trained_sentiment_separates_plain_words(spark):
    rows = [(f"отлично хорошо спасибо {i}", "positive") for i in range(20)]
    rows += [(f"ужас плохо позор {i}", "negative") for i in range(20)]
    rows += [(f"стол стул окно {i}", "neutral") for i in range(20)]
    model = W.train_sentiment(spark.createDataFrame(rows, "text string, label string"), features=1024)
    test = spark.createDataFrame(
        [(1, "хорошо спасибо"), (2, "позор ужас"), (3, "окно стол"), (4, None)], "id int, text string"
    )
    found = {r.id: r.label for r in W.predict_sentiment(test, model).collect()}
    assert (found[1], found[2], found[3]) == ("positive", "negative", "neutral")
    assert found[4] in {"positive", "negative", "neutral"}


def plain_bayes(examples, texts, smoothing=1.0):
    import math

    rows = [(t.lower().split(), y) for t, y in examples if t is not None and y is not None]
    labels = sorted({y for _, y in rows})
    counts = {y: {} for y in labels}
    for ws, y in rows:
        for w in ws:
            counts[y][w] = counts[y].get(w, 0) + 1
    known = {w for c in counts.values() for w in c}
    out = []
    for t in texts:
        scores = []
        for y in labels:
            n = sum(counts[y].values()) + smoothing * len(known)
            s = math.log(sum(z == y for _, z in rows) / len(rows))
            s += sum(math.log((counts[y].get(w, 0) + smoothing) / n) for w in (t or "").lower().split() if w in known)
            scores.append(round(s, 9))
        best = max(range(len(labels)), key=lambda i: (scores[i], -i))
        out.append((labels[best], scores[best]))
    return out


@pytest.mark.parametrize("max_rows", [200_000, 0])
def test_bayes_equals_plain_counts(spark, max_rows):
    import random

    rng = random.Random(2)

    def some():
        return " ".join(rng.choice(["Red", "green", "blue", "of", "a"]) for _ in range(rng.randint(0, 9)))

    examples = [(some() + " ill" * (i % 3 == 0), ["bad", "good", "ill"][i % 3]) for i in range(40)]
    examples += [(None, "good"), ("red", None)]
    model = W.train_bayes(spark.createDataFrame(examples, "text string, label string"))
    texts = [some() + " unseen" for _ in range(30)] + [None, "", "nothing known", "ill ill", "ill ill"]
    df = spark.createDataFrame([(i % 20, t, i) for i, t in enumerate(texts)], "id bigint, text string, entries int")
    found = W.predict_bayes(df.repartition(4), model, "id", score="score", max_rows=max_rows)
    assert found.columns == ["id", "text", "entries", "label", "score"]
    got = [(r.label, r.score) for r in sorted(found.collect(), key=lambda r: r.entries)]
    for (label, score), (expected, wanted) in zip(got, plain_bayes(examples, texts), strict=True):
        assert label == expected and abs(score - wanted) < 1e-8


def test_bayes_without_examples(spark):
    model = W.train_bayes(spark.createDataFrame([], "text string, label string"))
    with pytest.raises(ValueError):
        W.predict_bayes(spark.createDataFrame([("x",)], "text string"), model, "text")


@pytest.mark.parametrize("max_rows", [200_000, 0])
def test_large_dictionary_and_long_texts(spark, max_rows):
    """Sixty thousand forms, a text of 20,000 words among empty and null ones, and hot copies."""
    forms = spark.range(60_000).selectExpr("concat('w', id) AS form", "concat('l', id % 7) AS lemma")
    long = " ".join(f"w{i * 7 % 90_000}" for i in range(20_000))
    rows = [(1, long), (2, ""), (3, None), (4, "  "), (5, "none here")] + [(i, "w1 x w2") for i in range(10, 500)]
    df = spark.createDataFrame(rows, "id bigint, t string").repartition(5)
    found = {r.id: r.lemmas for r in W.lemmatize(df, forms, "id", "t", max_rows=max_rows).collect()}

    def plain(t):
        parts = [f"l{int(w[1:]) % 7}" if w[0] == "w" and int(w[1:]) < 60_000 else w for w in t.split()]
        return " ".join(parts)

    assert found[1] == plain(long) and found[2] == found[4] == "" and found[3] is None
    assert found[5] == "none here" and {found[i] for i in range(10, 500)} == {"l1 x l2"}


def test_texts_stay_where_they_are_within_the_bound(texts, forms):
    plan = W.lemmatize(texts, forms, "id", "t")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1  # the fixture's own


def test_only_words_that_may_be_forms_travel(spark):
    from townpulse.functions import lookup

    forms = spark.createDataFrame([("b", "x")], "form string, lemma string")
    bits = lookup.key_bitmap(forms, "form")
    assert int(np.unpackbits(bits).sum()) == 1
    df = spark.createDataFrame([("a b c b",), ("",), (None,)], "t string")
    kept = df.select(lookup._may_be_keys(bits, W.words("t"), df).alias("k")).collect()
    assert [r.k for r in kept] == [["b"], [], None]


@pytest.mark.parametrize("max_rows", [200_000, 0])
def test_sums_count_each_copy_of_a_text_once(spark, max_rows):
    rows = [(i, "red red blue") for i in range(7)] + [(8, "blue none"), (9, "none"), (10, ""), (11, None)]
    texts = spark.createDataFrame(rows, "id bigint, t string").repartition(3)
    lexicon = spark.createDataFrame([("red", 5), ("blue", -3), ("blue", 2), ("none", None), (None, 9)], "word string, score int")
    found = {r.id: r.score for r in W.lexicon_score(texts, lexicon, "id", "t", max_rows=max_rows).collect()}
    assert found == {**dict.fromkeys(range(7), 7), 8: -3, 9: 0, 10: 0, 11: None}


def test_joined_weights_bring_only_sums_back(spark, monkeypatch):
    """Texts of many known words: what meets the rows is a sum a label and text, not the words' weights."""
    from townpulse.functions import lookup

    met, attach = [], lookup.attach
    monkeypatch.setattr(lookup, "attach", lambda rows, table, *a, **b: met.append(table) or attach(rows, table, *a, **b))
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(200)), ["bad", "good"][i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, text string, label string")
    model = W.train_bayes(df)
    found = W.predict_bayes(df.select("id", "text"), model, "id", max_rows=0)
    assert {r.id: r.label for r in found.collect()} == {i: y for i, _, y in rows}
    arrays = [c for c, kind in met[0].dtypes if kind.startswith("array")]
    assert max(met[0].selectExpr(*[f"max(size({c}))" for c in arrays]).first()) == 3


def test_many_entries_are_merged_though_texts_are_few(spark, monkeypatch):
    from townpulse.functions import lookup

    monkeypatch.setattr(lookup, "MOST_ENTRIES", 50)
    table = spark.range(200).selectExpr("concat('w', id) AS form", "concat('l', id) AS lemma")
    rows = [(1, " ".join(f"w{i}" for i in range(200))), (2, "none")]
    found = W.lemmatize(spark.createDataFrame(rows, "id int, t string"), table, "id", "t", max_rows=0)
    assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.lemmas for r in found.collect()} == {1: " ".join(f"l{i}" for i in range(200)), 2: "none"}


@pytest.mark.parametrize("max_rows", [200_000, 0])
def test_lines_and_sums_leave_python_without_words(spark, max_rows):
    """No list of values by word comes back, which would be as large as the texts; words are split once."""
    df = spark.createDataFrame([(1, "a b  a"), (2, None), (3, ""), (4, "c")], "id int, t string")
    table = spark.createDataFrame([("a", "x", 2), ("c", None, 1 << 40)], "w string, lemma string, score bigint")
    lemmas = W.lemmatize(df, table.withColumnRenamed("w", "form"), "id", "t", max_rows=max_rows)
    scores = W.lexicon_score(df, table.select(table.w.alias("word"), "score"), "id", "t", max_rows=max_rows)
    assert {r.id: r.lemmas for r in lemmas.collect()} == {1: "x b x", 2: None, 3: "", 4: "c"}
    assert {r.id: r.score for r in scores.collect()} == {1: 4, 2: None, 3: 0, 4: 1 << 40}
    for found in (lemmas, scores):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") <= 1 and "zip_with" not in plan and "aggregate(" not in plan


@pytest.mark.parametrize("max_rows", [200_000, 0])
def test_large_scores_of_many_copies(spark, max_rows):
    df = spark.createDataFrame([(i, "a b a") for i in range(20)], "id int, t string").repartition(3)
    table = spark.createDataFrame([("a", 1 << 60), ("b", -5)], "word string, score bigint")
    found = W.lexicon_score(df, table, "id", "t", max_rows=max_rows).collect()
    assert {r.score for r in found} == {(1 << 61) - 5} and len(found) == 20

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_file
from townpulse.llm import language_id as L
from townpulse.llm import toxicity as X
from townpulse.llm.queries import QUERIES, remainder
from townpulse.llm.words import LOWER, MARKS, split_words


def numeric(loss, array, i, step=5e-3):
    old = array.flat[i]
    values = []
    for sign in (1, -1):
        array.flat[i] = old + sign * step
        values.append(loss())
    array.flat[i] = old
    return (values[0] - values[1]) / (2 * step)


def test_gradients_of_the_byte_network():
    rng = np.random.default_rng(0)
    windows, labels = rng.integers(0, 256, (5, 12)), np.array([0, 1, 2, 0, 1])
    windows[0, 8:] = L.BLANK
    model = {k: v.astype(np.float64) for k, v in L.train(windows, labels, 3, epochs=1).items()}

    def loss():
        p = L.probabilities(model, windows)
        real = (windows != L.BLANK).T
        return -(np.log(p[:, np.arange(5), labels]) * real).sum() / real.sum()

    grads = L.gradients(model, windows, labels)
    for name, g in grads.items():
        for i in np.argsort(-np.abs(g.ravel()))[:3]:
            assert numeric(loss, model[name], i) == pytest.approx(float(g.flat[i]), rel=0.05, abs=2e-4)


def test_gradients_of_the_word_network():
    rng = np.random.default_rng(0)
    windows, labels = [b"aa bb cc dd ee", b"aa xx yy", b"qq rr bb cc"] * 3, np.array([1, 0, 1] * 3)
    vocabulary = np.unique(split_words(pa.array([b"aa bb cc xx"], pa.binary()), MARKS, LOWER).hashes)
    trigrams, model = X.train(windows, labels, vocabulary, rng.normal(size=len(vocabulary)), epochs=1)
    model = {k: v.astype(np.float64) for k, v in model.items()}
    words = split_words(pa.array(windows, pa.binary()), MARKS, LOWER)
    looked = X.Reader(vocabulary, trigrams).look(words)
    _, index = X.index_windows(words, looked[0], len(looked[1]))

    def loss():
        logits = X.read_windows(model, X.word_vectors(model, *looked[1:]), index)["logits"].astype(float)
        p = 1 / (1 + np.exp(-logits))
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean()

    for name, g in X.gradients(model, looked, index, labels.astype(np.float32)).items():
        for i in np.argsort(-np.abs(g.ravel()))[:3]:
            assert numeric(loss, model[name], i) == pytest.approx(float(g.flat[i]), rel=0.05, abs=2e-4)


def test_windows_cover_every_word():
    counts = np.array([0, 1, 24, 25, 36, 37, 1000])
    owner, start = X.window_starts(counts)
    for i, n in enumerate(counts.tolist()):
        own = start[owner == i]
        assert set(range(n)) == {j for s in own.tolist() for j in range(s, min(n, s + X.WIDTH))}
        assert len(own) >= 1 and (n <= X.WIDTH or (np.diff(own) == X.STRIDE).all())


def test_languages_held_out(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op4_language_id"](spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert found.count() == docs.count()
    rate = (
        found.where("held_out").join(docs, "doc_id")
        .agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    )
    assert rate > 0.97


def test_language_of_odd_rows(spark, table, odd_rows):
    texts = {"aa": "lorem ipsum dolor sit amet ", "bb": "zwölf große öfen über "}
    learned = [(100 + i, text * 8, lang, None, None) for i, (lang, text) in enumerate(list(texts.items()) * 10)]
    docs = spark.createDataFrame(learned, table([], extra=False).schema).unionByName(
        table(odd_rows), allowMissingColumns=True
    )
    found = {r.doc_id: r for r in L.identify(docs, F.lit(True), carry=("text", "score", "lang")).collect()}
    assert {i for i, r in found.items() if r.lang_pred == L.UNKNOWN} == {2, 3, 4, 6}
    assert all(r.score == 0 for r in found.values() if r.lang_pred == L.UNKNOWN)
    assert all(found[r[0]].lang_pred == r[2] for r in learned)
    assert {r.lang_pred for r in L.identify(docs, F.lit(False)).collect()} == {L.UNKNOWN}
    assert L.identify(table([]), F.lit(True)).collect() == []


def test_toxic_words_and_their_variants(spark, table, odd_rows):
    rng = np.random.default_rng(1)
    common = [f"{a}{b}" for a in ("ba", "lo", "mi", "tu", "re") for b in ("no", "ka", "si", "per")]
    rows, marks = [], []
    for i in range(400):
        words = list(rng.choice(common, rng.integers(5, 150)))
        toxic = i % 2
        if toxic:
            words[rng.integers(len(words))] = "zgraff" + str(rng.choice(["", "en", "ic", "ous", f"{i}x"]))
        rows.append((1000 + i, " ".join(words)))
        marks.append((1000 + i, toxic))
    rows += odd_rows
    labels = spark.createDataFrame([*marks, (2, None), (77777, 1)], "doc_id bigint, toxic int")
    found = X.score_documents(table(rows), labels, remainder("doc_id", 5) != 0).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    truth = dict(marks)
    held_out = {r[0] for r in labels.where(remainder("doc_id", 5) == 0).collect()}
    judged = [(r.score >= 0.5) == bool(truth[r.doc_id]) for r in found if r.doc_id in held_out and r.doc_id in truth]
    assert len(judged) > 40 and sum(judged) / len(judged) > 0.95
    assert {r.score for r in X.score_documents(table(rows), labels.limit(0), F.lit(True)).collect()} == {0.0}


def test_toxicity_query(spark):
    found = QUERIES["op5_toxicity"](spark, entry_file.SMALL)
    docs = spark.read.parquet(f"{entry_file.SMALL}/documents.parquet")
    assert found.count() == docs.count() and found.columns == ["doc_id", "held_out", "score", "predicted"]

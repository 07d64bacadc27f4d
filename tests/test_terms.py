import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from townpulse.operators import terms as T

DOCS = [
    (1, "a", "ямы ямы дорога город"),
    (2, "a", "ямы город свет x"),
    (3, "b", "вода город вода вода"),
    (4, "b", "вода город 2024"),
    (5, None, "ямы вода город"),
    (6, "b", ""),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "id bigint, topic string, cleaned string").repartition(3)


def test_tfidf_against_a_direct_count(docs):
    found = {(r.id, r.term): r.weight for r in T.tfidf(docs, "id", stop=["свет"], min_df=2, max_df=0.8).collect()}
    texts = {i: [w for w in t.split() if len(w) > 1 and w != "свет"] for i, _, t in DOCS}
    df = Counter(w for ws in texts.values() for w in set(ws))
    n = len(DOCS)
    keep = {w for w, k in df.items() if 2 <= k <= 0.8 * n}
    assert "город" not in keep and keep == {"ямы", "вода"}
    expected = {}
    for i, ws in texts.items():
        raw = {w: c * (math.log((1 + n) / (1 + df[w])) + 1) for w, c in Counter(ws).items() if w in keep}
        length = math.sqrt(sum(v * v for v in raw.values()))
        expected.update({(i, w): v / length for w, v in raw.items()})
    assert found.keys() == expected.keys()
    assert all(abs(found[k] - expected[k]) < 1e-12 for k in found)


def test_tfidf_with_a_vocabulary_too_large_to_send(docs):
    small = sorted(T.tfidf(docs, "id", min_df=1, max_df=1.0).collect())
    large = sorted(T.tfidf(docs, "id", min_df=1, max_df=1.0, max_rows=0).collect())
    assert [(r.id, r.term) for r in small] == [(r.id, r.term) for r in large]
    assert all(abs(a.weight - b.weight) < 1e-12 for a, b in zip(small, large))


@pytest.mark.parametrize("max_rows", [200_000, 0])
def test_tfidf_shuffles_no_text(spark, tmp_path, max_rows):
    rows = spark.range(50).selectExpr("id", "concat('word', id % 3, ' of words ', id) AS cleaned")
    rows.write.parquet(str(tmp_path / "d"))
    found = T.tfidf(spark.read.parquet(str(tmp_path / "d")), "id", min_df=2, max_df=1.0, max_rows=max_rows)
    plan = found._jdf.queryExecution().optimizedPlan()
    shuffled = [p for p in plan.toString().split("\n") if "Repartition" in p or "RebalancePartitions" in p]
    assert shuffled == []
    executed = found._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange") == (0 if max_rows else executed.count("Exchange hashpartitioning"))
    assert "FileScan" in executed and found.count() > 0


def test_tfidf_of_null_and_empty_texts(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "aa bb"), (5, "aa aa"), (5, "aa cc")]
    docs = spark.createDataFrame(rows, "id bigint, cleaned string")
    found = sorted((r.id, r.term, round(r.weight, 6)) for r in T.tfidf(docs, "id", min_df=1, max_df=1.0).collect())
    assert [(i, t) for i, t, _ in found] == [(4, "aa"), (4, "bb"), (5, "aa"), (5, "aa"), (5, "cc")]
    assert T.tfidf(docs.limit(0), "id").collect() == []


def test_words_and_pairs_are_counted_in_one_reading(spark, tmp_path):
    rows = [(i, "ab"[i % 2], f"слово{i % 9} вода раз 2024 горячая вода") for i in range(200)]
    spark.createDataFrame(rows, "id bigint, topic string, cleaned string").write.parquet(str(tmp_path / "p"))
    docs = spark.read.parquet(str(tmp_path / "p"))
    counts = T.word_and_pair_counts(docs, "topic", "cleaned", ["раз"])
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "partial_count" in plan
    found = {(r.topic, r._w1, r._w2): r["count"] for r in counts.collect()}
    assert found["a", "вода", None] == 200 and found["a", "горячая", "вода"] == 100
    # a bare number between two words is not there, so they are neighbours
    assert ("a", "раз", "горячая") not in found and ("a", "раз", None) not in found
    clouds = T.phrase_frequencies(docs, "topic", stop=["раз"])
    assert "FileScan" not in clouds._jdf.queryExecution().executedPlan().toString()


def test_word_frequencies_drop_numbers_and_scale_to_the_top(docs):
    found = {(r.topic, r.term): (r["count"], r.frequency) for r in T.word_frequencies(docs, "topic", stop=["город"]).collect()}
    assert found == {
        ("a", "ямы"): (3, 1.0), ("a", "дорога"): (1, 1 / 3), ("a", "свет"): (1, 1 / 3),
        ("b", "вода"): (4, 1.0),
    }
    top = T.word_frequencies(docs, "topic", count=2).filter("topic = 'a'").collect()
    assert sorted(r.term for r in top) == ["город", "ямы"]


def test_topic_terms_formula_and_rank(docs):
    found = T.topic_terms(docs, "topic", stop=["город"]).collect()
    counts = {"a": Counter(["ямы"] * 3 + ["дорога", "свет"]), "b": Counter(["вода"] * 4 + ["2024"])}
    mean = sum(sum(c.values()) for c in counts.values()) / 2
    total = counts["a"] + counts["b"]
    for r in found:
        assert abs(r.weight - counts[r.topic][r.term] * math.log(1 + mean / total[r.term])) < 1e-8
    assert [(r.rank, r.term) for r in sorted(found, key=lambda r: (r.topic, r.rank)) if r.topic == "a"] == [
        (1, "ямы"), (2, "дорога"), (3, "свет"),
    ]
    scaled = T.topic_terms(docs, "topic", stop=["город"], normalise=True).collect()
    assert sorted((r.topic, r.term) for r in scaled) == sorted((r.topic, r.term) for r in found)


def test_lines_names_and_arrays(docs):
    ranked = T.topic_terms(docs, "topic", stop=["город"])
    assert {r.topic: r.line for r in T.topic_lines(ranked, "topic", 2).collect()} == {
        "a": "ямы | дорога", "b": "вода | 2024",
    }
    assert {r.topic: r.topic_name for r in T.auto_names(ranked, "topic", 1).collect()} == {"a": "ямы", "b": "вода"}


def test_only_listed_topics_get_names(spark):
    rows = spark.createDataFrame([(i,) for i in (-1, 0, 45, 46)], "topic bigint")
    names = spark.createDataFrame([(i, f"n{i}") for i in (-1, 0, 45, 46)], "topic bigint, topic_name string")
    found = T.attach_names(rows, names, last=T.LAST_LISTED_TOPIC)
    assert {r.topic: r.topic_name for r in found.collect()} == {-1: None, 0: "n0", 45: "n45", 46: None}
    assert rows.filter(T.listed("topic")).count() == 2


def test_first_comments(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else "cold", f"t{i}") for i in range(90)], "id bigint, topic string, text string")
    found = T.first_comments(rows, "topic", ["id"], 20, "hot").collect()
    assert [r.id for r in found] == [i for i in range(90) if i % 3][:20]
    assert T.first_comments(rows, "topic", ["id"], 20, "unknown").count() == 0
    each = T.first_comments(rows, "topic", ["id"], 5)
    assert {(r.topic, r.position) for r in each.collect()} == {(t, p) for t in ("hot", "cold") for p in range(1, 6)}


def test_no_topic_or_word_is_gathered_whole(spark, tmp_path):
    rows = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 50)).alias("topic"),
        F.lit("слово за словом").alias("cleaned"),
    )
    rows.write.parquet(str(tmp_path / "t"))
    found = T.word_frequencies(spark.read.parquet(str(tmp_path / "t")), "topic", count=10)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "partial_count(1)" in plan and "WindowGroupLimit" in plan and "collect_list" not in plan


def test_phrases_take_their_words_with_them(spark):
    rows = [(i, "a", "горячая вода нет") for i in range(30)] + [(i, "a", f"слово{i} вода раз") for i in range(30, 200)]
    docs = spark.createDataFrame(rows, "id bigint, topic string, cleaned string")
    found = {r.term: r["count"] for r in T.phrase_frequencies(docs, "topic", stop=["нет"]).collect()}
    assert found["горячая вода"] == 30
    assert "горячая" not in found
    # the rest of "вода" went into the phrase with the other frequent neighbour
    assert found["вода раз"] == 170 and "вода" not in found and "вода нет" not in found


def test_likelihood_ratio_of_independent_words_is_small(spark):
    row = spark.range(1).select(
        T.likelihood_ratio(F.lit(25), F.lit(50), F.lit(50), F.lit(100)).alias("even"),
        T.likelihood_ratio(F.lit(50), F.lit(50), F.lit(50), F.lit(100)).alias("tied"),
        T.likelihood_ratio(F.lit(5), F.lit(100), F.lit(5), F.lit(100)).alias("only"),
    ).first()
    assert abs(row.even) < 1e-9 and row.tied > 100 and row.only == 0.0


def test_tfidf_of_many_terms_moves_counted_terms_twice_at_most(spark, tmp_path):
    """A row's terms are counted before they travel: to the vocabulary, and to their row."""
    rows = [(i, f"aa aa b{i % 3}b cc only{i}") for i in range(30)]
    spark.createDataFrame(rows, "id bigint, cleaned string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    large = T.tfidf(docs, "id", min_df=2, max_df=1.0, max_rows=0)
    small = T.tfidf(docs, "id", min_df=2, max_df=1.0)
    plan = large._jdf.queryExecution().executedPlan().toString()
    # the third one moves the vocabulary
    assert plan.count("Exchange hashpartitioning") <= 3

    def rounded(df):
        return sorted((r.id, r.term, round(r.weight, 9)) for r in df.collect())

    assert rounded(large) == rounded(small) and len(rounded(large)) == 90

    twice = T.tfidf(docs.unionByName(docs.selectExpr("id", "'aa ' || cleaned AS cleaned")), "id", min_df=2, max_rows=0)
    assert twice.groupBy("id", "term").count().filter("count > 1").count() == 0
    lengths = twice.groupBy("id").agg({"weight": "count"}).count()
    assert lengths == 30


def test_vocabularies_are_sent_along_by_their_bytes(spark, monkeypatch):
    docs = spark.range(30).selectExpr("id", "concat('aa b', id % 3, 'b cc') AS cleaned")

    def joined():
        plan = T.tfidf(docs, "id", min_df=2, max_df=1.0)._jdf.queryExecution().executedPlan().toString()
        return "SortMergeJoin" in plan

    assert not joined()
    monkeypatch.setattr(T, "MOST_VOCABULARY_BYTES", 50)
    assert joined()


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_words_and_pairs_of_slices_equal_those_counted_one_by_one(spark, kind):
    texts = [
        "вода раз вода раз 2024 раз", " aa  bb\taa bb cc x 7 aa ", "", None, "нет", "x 1 22", "٣٣ aa aa aa",
        "aa\u0085bb\x1cbb нет aa", "\U0001f600 \U0001f600\U0001f600 aa", "bb aa " * 400,
    ]
    rows = [(str(i % 3) if i % 7 else None, t) for i, t in enumerate(texts * 5)]
    docs = spark.createDataFrame(rows, "topic string, cleaned string").withColumn("topic", F.col("topic").cast(kind))

    def plain(df):
        return sorted((r.topic, r._w1, r._w2 or "", r["count"]) for r in df.collect())

    for stop in ([], ["нет", "раз"]):
        expected = plain(T.word_and_pair_counts(docs, "topic", "cleaned", stop))
        found = T.counts_by_first_word(docs, "topic", "cleaned", stop)
        assert plain(found) == expected and len(expected) > 20
        alone = {(t, w): n for t, w, other, n in expected if not other}
        assert all(r._c1 == alone[r.topic, r._w1] for r in found.collect())


def test_pairs_meet_the_word_counts_once(spark):
    docs = spark.range(60).selectExpr("'t' AS topic", "concat('aa bb', id % 3, ' cc') AS cleaned")
    found = T.phrase_frequencies(docs, "topic")
    # what is left to join are the words and what phrases take of them
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert found.count() > 0

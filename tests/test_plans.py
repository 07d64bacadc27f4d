import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from townpulse.operators.feed import FLAT_COLUMNS
from townpulse.plans import batch, reports

BASE = 1_704_067_200
ROADS = "ужасная дорога яма асфальт машина колесо"
WATER = "вода отключили труба кран холодная платёж"


def build_feed(root):
    """Two groups with complaints about roads and water, praise, and one broken group."""
    def posts(name, count):
        for n in range(count):
            comments = []
            for k in range(6):
                words = (ROADS if k % 2 else WATER).split()
                kept = [w for i, w in enumerate(words) if i != (n + k) % 6]
                text = " ".join(kept) + ("! плохо" if k < 5 else " \U0001f44d отлично")
                comments.append({"id": k, "from_id": k, "date": BASE + n * 86_400 + k, "text": text})
            yield {"seq": n, "id": n, "owner_id": -1, "date": BASE + n * 86_400, "text": "пост https://a.ru", "comments": comments}

    for name, count in (("city", 20), ("news", 10)):
        folder = root / f"group_domain={name}"
        folder.mkdir(parents=True)
        lines = [json.dumps(p, ensure_ascii=False) for p in posts(name, count)]
        (folder / "feed.json").write_text("\n".join(lines), encoding="utf-8")
    folder = root / "group_domain=broken"
    folder.mkdir()
    (folder / "feed.json").write_text('{"seq": 1, "id": 1}\n{"seq":', encoding="utf-8")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("run")
    build_feed(root / "feed")
    lexicon = spark.createDataFrame([("плохо", -1), ("отлично", 1)], "word string, score int")
    forms = spark.createDataFrame([("машина", "авто")], "form string, lemma string")
    batch.full_run(
        spark,
        str(root / "feed"),
        str(root / "labelled"),
        str(root / "topics"),
        batch.Settings(last_date="2024-01-25 00:00:00", topic_options={"threshold": 0.5}),
        dictionary=forms,
        lexicon=lexicon,
    )
    return spark.read.parquet(str(root / "labelled")), spark.read.parquet(str(root / "topics"))


def test_labelled_table(tables):
    labelled, _ = tables
    assert set(FLAT_COLUMNS) | {"text_preprocessed", "label", "date_time", "row_id"} == set(labelled.columns)
    assert labelled.count() == labelled.select("row_id").distinct().count() == 30 * 7
    counts = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    assert counts == {"neutral": 30, "negative": 150, "positive": 30}
    assert {r.group_domain for r in labelled.select("group_domain").distinct().collect()} == {"city", "news"}
    assert labelled.filter(F.col("text_preprocessed").contains("авто")).count() > 0
    assert labelled.filter("text_preprocessed like '%http%'").count() == 0


def test_topic_table_separates_the_two_complaints(tables):
    _, topics = tables
    assert topics.count() == 150
    named = topics.filter("topic >= 0")
    assert named.count() >= 120
    kinds = named.select("topic", F.col("text").contains("вод").alias("water") | F.col("text").contains("труба")).distinct()
    per_topic = {}
    for row in kinds.collect():
        per_topic.setdefault(row[0], set()).add(row[1])
    assert all(len(v) == 1 for v in per_topic.values()) and len(per_topic) >= 2
    assert named.filter("topic_name is null").count() == 0
    assert topics.filter("topic = -1 and topic_name is not null").count() == 0


def test_reports_over_the_tables(tables):
    labelled, topics = tables
    names, bounds = reports.choices(topics)
    every = [r[0] for r in names.collect()]
    assert every == sorted(every) and len(every) >= 2
    assert bounds.first().min_date == dt.datetime(2024, 1, 1)
    weekly = reports.weekly_trend(topics)
    weeks = weekly.select("week_start").distinct().count()
    assert weekly.count() == weeks * len(every)
    one = reports.weekly_trend(topics, "2024-01-01", "2024-01-07", every[:1])
    assert one.count() == 1 and one.first()["count"] > 0
    shares = reports.monthly_shares(topics)
    assert shares.filter("data_type = 'прогноз'").count() == 3 * len(every)
    assert "series" in shares.columns
    top, share = reports.yearly_view(labelled, topics)
    assert top.count() == min(3, len(every))
    assert share.agg(F.sum("share")).first()[0] == pytest.approx(1.0)
    words = reports.topic_words(topics, every[0])
    assert words.agg(F.max("frequency")).first()[0] == 1.0
    assert reports.topic_words(topics, "no such topic").count() == 0
    comments = reports.topic_comments(topics, every[0], ["date_time", "row_id"])
    size = topics.filter(F.col("topic_name") == every[0]).count()
    assert comments.count() == min(20, size) and comments.columns == ["text"]
    assert reports.topic_comments(topics, "no such topic", ["row_id"]).count() == 0


def test_names_from_stored_answers(tables, spark):
    from townpulse.functions.text import answer_text

    _, topics = tables
    answers = spark.createDataFrame([(0, '{"choices":[{"text":"Дороги, ямы"}]}'), (1, "{}")], "topic bigint, answer string")
    names = answers.select("topic", answer_text("answer").alias("topic_name"))
    from townpulse.operators.terms import attach_names

    found = attach_names(topics.drop("topic_name"), names)
    assert found.filter("topic = 0").select("topic_name").distinct().first()[0] == "Дороги, ямы"
    assert found.filter("topic = 1 and topic_name is not null").count() == 0


def test_a_lexicon_or_a_model_is_needed(spark):
    flat = spark.createDataFrame([], "group_domain string, post_id bigint, post_date timestamp, comment_id bigint, from_id bigint, text string, comment_date timestamp")
    with pytest.raises(ValueError):
        batch.label_table(flat, [])

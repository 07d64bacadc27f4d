import datetime as dt

import pytest
from pyspark.sql import functions as F

from townpulse.operators import feed as P
from townpulse.sources.feeds import POST_SCHEMA

DAY = 86_400
BASE = 1_704_067_200  # 2024-01-01
SCHEMA = "group_domain string, " + POST_SCHEMA
LO, HI = "2024-01-03 00:00:00", "2024-01-10 00:00:00"


def post(group, seq, day, comments=(), text="post", from_id=5):
    return (group, seq, 100 + seq, -1, from_id, BASE + int(day * DAY), text, list(comments))


def comment(number, day=4.0, text="hi", from_id=7):
    date = None if day is None else BASE + int(day * DAY)
    return (number, from_id, date, text)


def flat(spark, posts, *args, **kwargs):
    return P.flatten(spark.createDataFrame(posts, SCHEMA), *args, **kwargs).collect()


def keys(rows):
    return sorted(((r.group_domain, r.post_id, r.comment_id) for r in rows), key=str)


def test_bounds_are_inclusive_on_posts_and_comments(spark):
    posts = [
        post("g", 1, 9 + 1 / DAY),
        post("g", 2, 9, [comment(1, 2), comment(2, 9), comment(3, 2 - 1 / DAY), comment(4, 9.1)]),
        post("g", 3, 2),
        post("g", 4, 2 - 1 / DAY),
    ]
    assert keys(flat(spark, posts, LO, HI)) == keys_of(
        [(102, None), (102, 1), (102, 2), (103, None)]
    )


def keys_of(pairs, group="g"):
    return sorted(((group, p, c) for p, c in pairs), key=str)


def test_take_while_loses_posts_after_an_old_one(spark):
    posts = [post("g", 1, 5), post("g", 2, 1), post("g", 3, 5), post("h", 1, 1), post("i", 1, 12), post("i", 2, 5)]
    rows = flat(spark, posts, LO, HI, stop_at_old=True)
    assert keys(rows) == [("g", 101, None), ("i", 102, None)]
    assert len(flat(spark, posts, LO, HI)) == 3


def test_texts_and_missing_fields(spark):
    posts = [
        post(
            "g", 1, 5,
            [comment(1, None), comment(2, 5, None), comment(3, 5, ""), (None, None, BASE + 5 * DAY, "x")],
            text=None, from_id=None,
        ),
        ("g", 2, 102, -1, 5, BASE + 5 * DAY, "", None),
    ]
    rows = flat(spark, posts, LO, HI)
    assert keys(rows) == keys_of([(101, None), (101, None), (102, None)])
    own = [r for r in rows if r.post_id == 101 and r.comment_date is None][0]
    assert own.text == "" and own.from_id is None
    answer = [r for r in rows if r.comment_date is not None][0]
    assert (answer.comment_id, answer.from_id, answer.text) == (None, None, "x")
    # without bounds a comment without date is dated 1970
    dated = [r for r in flat(spark, posts) if r.comment_id == 1]
    assert len(dated) == 1


def test_columns_and_dates(spark):
    rows = P.flatten(spark.createDataFrame([post("g", 1, 5, [comment(1, 5.5)])], SCHEMA))
    assert rows.columns == P.FLAT_COLUMNS
    shown = {r.comment_id: r for r in P.as_text_dates(rows).collect()}
    assert shown[None].post_date == shown[1].post_date == "2024-01-06 00:00:00"
    assert shown[None].comment_date is None
    assert shown[1].comment_date == "2024-01-06 12:00:00"


def test_post_cap_counts_after_the_date_filter(spark):
    posts = [post("g", s, 12 if s % 2 else 5) for s in range(20)] + [post("h", 1, 5)]
    rows = flat(spark, posts, LO, HI, max_posts=3, width=4)
    assert keys(rows) == sorted([("g", 100, None), ("g", 102, None), ("g", 104, None), ("h", 101, None)], key=str)


@pytest.mark.parametrize("width", [1, 3, 1000])
@pytest.mark.parametrize("limit", [0, 1, 4, 5, 11, 12, 50])
def test_comment_cap_is_per_group_and_keeps_all_posts(spark, width, limit):
    posts, expected = [], []
    for s in range(6):
        comments = [comment(n, 5, "" if n == 1 else "t") for n in range(s + 1)]
        posts.append(post("g", s, 5, comments))
        expected += [(100 + s, n) for n in range(s + 1) if n != 1]
    rows = flat(spark, posts, LO, HI, max_comments=limit, width=width)
    assert keys(rows) == keys_of([(100 + s, None) for s in range(6)] + expected[:limit])


def test_nested_feed_is_read_once(spark, tmp_path):
    posts = spark.createDataFrame([post("g", 1, 5, [comment(1, 5)])], SCHEMA)
    posts.write.parquet(str(tmp_path / "posts"))
    rows = P.flatten(spark.read.schema(SCHEMA).parquet(str(tmp_path / "posts")), LO, HI)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_join_comments(spark):
    posts = spark.createDataFrame(
        [("g", -1, 1, 9, "p"), ("g", -1, 2, 9, None), ("h", -2, 1, 9, "q")],
        "group_domain string, owner_id bigint, post_id bigint, from_id bigint, text string",
    ).withColumn("post_date", F.timestamp_seconds(F.lit(BASE)))
    comments = spark.createDataFrame(
        [(-1, 1, 5, 3, "a"), (-2, 1, 6, 3, "b"), (-1, 2, 7, 3, ""), (-3, 1, 8, 3, "c")],
        "owner_id bigint, post_id bigint, comment_id bigint, from_id bigint, text string",
    ).withColumn("comment_date", F.timestamp_seconds(F.lit(BASE + 60)))
    rows = P.join_comments(posts, comments).collect()
    assert keys(rows) == sorted(
        [("g", 1, None), ("g", 2, None), ("h", 1, None), ("g", 1, 5), ("h", 1, 6)], key=str
    )
    assert {r.post_date for r in rows} == {dt.datetime(2024, 1, 1)}


def test_batches_of_a_hundred(spark):
    df = spark.range(250).select(F.lit("g").alias("group_domain"), (F.col("id") * 7).alias("seq"))
    sizes = P.post_batches(df, width=64).groupBy("batch").count().collect()
    assert sorted((r.batch, r["count"]) for r in sizes) == [(1, 100), (2, 100), (3, 50)]


def test_rows_per_group_adds_the_total(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "group_domain string")
    assert {r.group_domain: r["count"] for r in P.rows_per_group(df).collect()} == {
        "a": 2, "b": 1, None: 3,
    }


def test_repeated_runs_and_their_repeats(spark):
    run = spark.createDataFrame(
        [("g", 1, None, "p"), ("g", 1, 2, "c")],
        "group_domain string, post_id bigint, comment_id bigint, text string",
    )
    both = P.append_runs(run, run)
    assert both.count() == 4
    assert P.drop_repeats(both).count() == 2


def test_latest_row_of_each_key(spark):
    rows = [
        (1, None, 3, "a"), (1, None, 5, "b"), (1, None, 5, "c"), (1, 7, 1, "d"), (2, None, None, "e"),
        (2, None, None, None), (3, None, None, "f"), (3, None, -1, "g"), (4, 1, 2, "same"), (4, 1, 2, "same"),
    ]
    df = spark.createDataFrame(rows, "post bigint, comment bigint, version int, _row string")
    for parts in (1, 5):
        found = P.latest_rows(df.repartition(parts), ["post", "comment"], "version")
        assert found.columns == df.columns
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [
            (1, None, 5, "c"), (1, 7, 1, "d"), (2, None, None, "e"), (3, None, -1, "g"), (4, 1, 2, "same")
        ]))
    plan = P.latest_rows(df, ["post"], "version")._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan


def test_latest_row_beside_maps(spark):
    df = spark.createDataFrame([(1, 1, {"a": 1}), (1, 1, {"b": 2})], "k int, v int, m map<string,int>")
    assert P.latest_rows(df, ["k"], "v").collect()[0].m == {"b": 2}

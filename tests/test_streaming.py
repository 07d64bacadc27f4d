import json
import time

import pytest

from townpulse.operators import feed as P
from townpulse.operators import trends as R
from townpulse.sources import feeds, versions
from townpulse.streaming import jobs

BASE = 1_704_067_200


def add_file(root, group, posts):
    folder = root / f"group_domain={group}"
    folder.mkdir(parents=True, exist_ok=True)
    lines = [
        json.dumps(
            {
                "seq": n, "id": n, "owner_id": -1, "from_id": 1, "date": BASE + n * 3600, "text": f"p{n}",
                "comments": [{"id": n * 10, "from_id": 2, "date": BASE + n * 3600 + 60, "text": f"c{n}"}],
            }
        )
        for n in posts
    ]
    (folder / f"{time.time_ns()}.json").write_text("\n".join(lines), encoding="utf-8")


def rows(df):
    return sorted(((r.group_domain, r.post_id, r.comment_id, r.text) for r in df.collect()), key=str)


@pytest.mark.parametrize("files_per_batch", [None, 1])
def test_only_new_files_are_taken_in(spark, tmp_path, files_per_batch):
    feed, store, state, bad = (tmp_path / n for n in ("feed", "store", "state", "bad"))

    def run():
        jobs.ingest_new(
            spark, str(feed), str(store), str(state), bad_path=str(bad), files_per_batch=files_per_batch
        ).awaitTermination()
        return spark.read.schema("group_domain string, post_id bigint, comment_id bigint, text string").parquet(str(store))

    add_file(feed, "g", [1, 2])
    add_file(feed, "h", [3])
    assert run().count() == 6
    assert run().count() == 6
    add_file(feed, "g", [4])
    (feed / "group_domain=h" / "broken.json").write_text('{"seq": 9,', encoding="utf-8")
    found = run()
    assert found.count() == 8
    assert [r.bad_line for r in spark.read.parquet(str(bad)).select("bad_line").collect()] == ['{"seq": 9,']
    batch = feeds.read_feed_lines(spark, str(feed)).filter("bad_line is null").drop("bad_line")
    assert rows(found) == rows(P.flatten(batch))


def test_weekly_counts_of_the_stream_equal_the_batch(spark, tmp_path):
    source, table, state = (str(tmp_path / n) for n in ("in", "table", "state"))

    def put(days, mode="append"):
        data = [(f"2024-01-{d:02d} 12:00:00", "ab"[d % 2]) for d in days] + [(None, "a"), ("2024-01-03 00:00:00", None)]
        df = spark.createDataFrame(data, "t string, topic_name string")
        df.select(df.t.cast("timestamp").alias("date_time"), "topic_name").write.mode(mode).parquet(source)

    def run():
        stream = spark.readStream.schema("date_time timestamp, topic_name string").parquet(source)
        jobs.keep_weekly_counts(stream, table, state).awaitTermination()
        found = jobs.read_weekly_counts(spark, table).collect()
        return {(r.week_start, r.topic_name): r["count"] for r in found}

    put(range(1, 15))
    first = run()
    put([3, 4, 20, 31])  # late rows and new weeks
    second = run()
    grid = R.weekly_topic_counts(spark.read.parquet(source)).filter("count > 0").collect()
    assert second == {(r.week_start, r.topic_name): r["count"] for r in grid}
    assert sum(second.values()) == sum(first.values()) + 4


def test_append_mode_holds_back_the_open_week(spark, tmp_path):
    source = str(tmp_path / "in")
    df = spark.createDataFrame([(f"2024-01-{d:02d} 00:00:00", "a") for d in range(1, 25)], "t string, topic_name string")
    df.select(df.t.cast("timestamp").alias("date_time"), "topic_name").write.parquet(source)
    stream = spark.readStream.schema("date_time timestamp, topic_name string").parquet(source)
    query = (
        jobs.weekly_counts(stream, late="1 day").writeStream.format("memory").queryName("closed_weeks")
        .outputMode("append").option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    weeks = sorted(r.week_start.isoformat() for r in spark.table("closed_weeks").collect())
    assert weeks == ["2024-01-01", "2024-01-08", "2024-01-15"]


def put(spark, source, stamps):
    df = spark.createDataFrame(stamps, "t string, topic_name string")
    df.select(df.t.cast("timestamp").alias("date_time"), "topic_name").coalesce(1).write.mode("append").parquet(source)


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_path):
    source, table, state = (str(tmp_path / n) for n in ("in", "table", "state"))

    def run():
        stream = spark.readStream.schema("date_time timestamp, topic_name string").parquet(source)
        jobs.keep_weekly_counts(stream, table, state, late="2 days").awaitTermination()
        return {(r.week_start.isoformat(), r.topic_name): r["count"] for r in jobs.read_weekly_counts(spark, table).collect()}

    put(spark, source, [("2024-01-02 00:00:00", "a"), ("2024-01-25 00:00:00", "a")])
    assert run() == {("2024-01-01", "a"): 1, ("2024-01-22", "a"): 1}
    # the week of 1 January ended long before 23 January; that of 22 January is open
    put(spark, source, [("2024-01-03 00:00:00", "a"), ("2024-01-22 00:00:00", "a"), ("2024-01-22 00:00:00", "b")])
    assert run() == {("2024-01-01", "a"): 1, ("2024-01-22", "a"): 2, ("2024-01-22", "b"): 1}


def test_a_reader_between_batches_sees_a_whole_version(spark, tmp_path):
    table = str(tmp_path / "table")
    empty = versions.read_version(spark, table, jobs.WEEKLY_SCHEMA)
    assert empty.collect() == [] and versions.whole_versions(spark, table) == []

    def write(number, count):
        rows = spark.range(count).selectExpr("DATE'2024-01-01' AS week_start", "string(id) AS topic_name", "id AS count")
        versions.write_version(rows, table, number)

    write(0, 3)
    reader = jobs.read_weekly_counts(spark, table)
    write(1, 5)
    assert reader.count() == 3 and jobs.read_weekly_counts(spark, table).count() == 5
    # a write that did not come to its end is not seen, and is replaced when the batch runs again
    (tmp_path / "table" / "version=2").mkdir()
    (tmp_path / "table" / "version=2" / "part-0.parquet").write_text("half")
    assert jobs.read_weekly_counts(spark, table).count() == 5
    assert versions.read_version(spark, table, jobs.WEEKLY_SCHEMA, before=1).count() == 3
    for number in range(2, 8):
        write(number, number)
    assert versions.whole_versions(spark, table) == [5, 6, 7]
    write(7, 9)
    assert jobs.read_weekly_counts(spark, table).count() == 9


def test_latest_row_wins_in_the_stream_as_in_the_batch(spark, tmp_path):
    source, table, state = (str(tmp_path / n) for n in ("in", "table", "state"))
    kind = "id bigint, version int, text string, at timestamp"

    def add(rows):
        df = spark.createDataFrame([(i, v, t, f"2024-01-{d:02d}") for i, v, t, d in rows], "id bigint, version int, text string, t string")
        df.selectExpr("id", "version", "text", "timestamp(t) AS at").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(kind).parquet(source)
        jobs.keep_latest_rows(stream, table, state, ["id"], "version", "at", "3 days").awaitTermination()
        return sorted((r.id, r.version, r.text) for r in versions.read_version(spark, table, kind).collect())

    assert add([(1, 1, "a", 1), (1, 2, "b", 1), (2, 5, "c", 1)]) == [(1, 2, "b"), (2, 5, "c")]
    assert add([(1, 1, "late and old", 2), (2, 5, "d", 2), (3, 1, "new", 20)]) == [(1, 2, "b"), (2, 5, "d"), (3, 1, "new")]
    whole = P.latest_rows(spark.read.schema(kind).parquet(source), ["id"], "version")
    assert sorted((r.id, r.version, r.text) for r in whole.collect()) == [(1, 2, "b"), (2, 5, "d"), (3, 1, "new")]
    # the state of the first days is gone, and the merge still keeps the newer row
    assert add([(3, 0, "older", 21), (1, 1, "dropped", 1)]) == [(1, 2, "b"), (2, 5, "d"), (3, 1, "new")]


@pytest.mark.parametrize("rule", feeds.RULES)
def test_batch_and_stream_leave_out_the_same(spark, tmp_path, rule):
    feed, store, state = (tmp_path / n for n in ("feed", "store", "state"))
    for group, numbers in {"g": [1, 2], "h": [3, 4, 5], "k": [6]}.items():
        add_file(feed, group, numbers)
    (feed / "group_domain=h" / "broken.json").write_text('{"seq": 9,\n{"seq": 10}', encoding="utf-8")
    posts = feeds.read_posts(spark, str(feed), str(tmp_path / "landed"), rule)
    jobs.ingest_new(spark, str(feed), str(store), str(state), rule=rule).awaitTermination()
    stored = spark.read.parquet(str(store)).filter("comment_id IS NULL")
    expected = [1, 2, 6] if rule == "group" else [1, 2, 3, 4, 5, 6]
    assert sorted(r.id for r in posts.collect()) == sorted(r.post_id for r in stored.collect()) == expected
    for landing in (tmp_path / "landed", tmp_path / "state-landed"):
        lists = {r.group_domain: (r.lines, r.bad, r.kept) for r in feeds.manifest(spark, str(landing)).collect()}
        assert lists == {"g": (2, 0, True), "h": (5, 2, rule == "line"), "k": (1, 0, True)}
        bad = feeds.landed_bad_lines(spark, str(landing)).collect()
        assert sorted(r.bad_line for r in bad) == ['{"seq": 10}', '{"seq": 9,']
    with pytest.raises(ValueError):
        feeds.read_posts(spark, str(feed), rule="none")


def test_only_listed_groups_reach_the_store(spark, tmp_path):
    feed, store, state = (str(tmp_path / n) for n in ("feed", "store", "state"))
    add_file(tmp_path / "feed", "g", [1])
    add_file(tmp_path / "feed", "h", [2])
    (tmp_path / "groups.txt").write_text("h\nh\nnobody\n", encoding="utf-8")
    listed = feeds.read_groups(spark, str(tmp_path / "groups.txt"))
    jobs.ingest_new(spark, feed, store, state, groups=listed).awaitTermination()
    assert {r.group_domain for r in spark.read.parquet(store).select("group_domain").collect()} == {"h"}

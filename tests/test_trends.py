import datetime as dt
import random

from pyspark.sql import functions as F

from townpulse.operators import trends as R

ROWS = [
    ("2025-01-01 10:00:00", "roads"),  # week of 2024-12-30
    ("2025-01-05 23:00:00", "roads"),
    ("2025-01-06 00:00:00", "water"),
    ("2025-01-14 00:00:00", None),  # a week with unnamed rows only
    (None, "roads"),
    (None, "heat"),  # a topic seen only on a row without date
]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, "t string, topic_name string").withColumn(
        "date_time", F.col("t").cast("timestamp")
    )


def test_weekly_grid_is_full_and_zero_filled(spark):
    found = R.weekly_topic_counts(table(spark)).collect()
    cells = {(r.week_start.isoformat(), r.topic_name): r["count"] for r in found}
    assert cells == {
        ("2024-12-30", "roads"): 2,
        ("2024-12-30", "water"): 0,
        ("2025-01-06", "roads"): 0,
        ("2025-01-06", "water"): 1,
        ("2025-01-13", "roads"): 0,
        ("2025-01-13", "water"): 0,
    }


def test_month_with_unnamed_rows_only_has_zero_percent(spark):
    rows = [("2025-01-08", "a"), ("2025-02-05", None)]
    found = {(r.month_start.isoformat(), r.topic_name): r for r in R.monthly_topic_share(table(spark, rows)).collect()}
    assert found["2025-01-01", "a"].percent == 100.0
    empty = found["2025-02-01", "a"]
    assert (empty["count"], empty.total_comments, empty.percent) == (0, 0, 0.0)


def test_month_of_the_week_or_of_the_day(spark):
    rows = [("2025-01-01", "a")]
    by_week = R.monthly_topic_share(table(spark, rows)).first().month_start
    by_day = R.monthly_topic_share(table(spark, rows), by="calendar").first().month_start
    assert (by_week, by_day) == (dt.date(2024, 12, 1), dt.date(2025, 1, 1))


def test_percents_of_a_month_sum_to_a_hundred(spark):
    rnd = random.Random(3)
    rows = [
        (f"2024-{rnd.randrange(1, 13):02d}-{rnd.randrange(1, 29):02d}", rnd.choice("abcdefg"))
        for _ in range(500)
    ]
    grid = R.monthly_topic_share(table(spark, rows)).cache()
    assert grid.count() == grid.select("month_start").distinct().count() * 7
    sums = grid.groupBy("month_start").agg(F.sum("percent").alias("s"), F.sum("count").alias("n"), F.max("total_comments").alias("t")).collect()
    assert all(abs(r.s - 100) <= 0.05 * 7 and r.n == r.t for r in sums)
    grid.unpersist()


def test_grid_of_nothing_is_nothing(spark):
    assert R.weekly_topic_counts(table(spark, [])).count() == 0


def test_grid_reads_its_input_once_and_joins_nothing(spark, tmp_path):
    table(spark).write.parquet(str(tmp_path / "t"))
    grid = R.monthly_topic_share(spark.read.parquet(str(tmp_path / "t")))
    grid.collect()
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan and "Join" not in plan and "Cartesian" not in plan


def test_same_result_whatever_the_partitioning(spark):
    rnd = random.Random(5)
    rows = [(f"2024-01-{rnd.randrange(1, 29):02d}", rnd.choice("aaab")) for _ in range(300)]
    results = []
    for parts in (1, 3, 11):
        rnd.shuffle(rows)
        results.append(sorted(R.weekly_topic_counts(table(spark, rows).repartition(parts)).collect()))
    assert results[0] == results[1] == results[2]


def test_top_three_are_exactly_three_with_ties_by_name(spark):
    rows = [("2024-05-05", t) for t in "aabbccdd"] + [("2025-05-05", "z"), ("2025-05-05", None)]
    found = R.yearly_top(table(spark, rows)).collect()
    assert sorted((r.year, r.rank, r.topic_name) for r in found) == [
        (2024, 1, "a"), (2024, 2, "b"), (2024, 3, "c"), (2025, 1, "z"),
    ]


def test_label_shares_leave_unknown_labels_out(spark):
    labels = ["positive"] * 3 + ["negative"] + ["odd"] * 5 + [None]
    rows = spark.createDataFrame([("2024-05-05", x) for x in labels], "t string, label string")
    found = R.yearly_label_share(rows.withColumn("date_time", F.col("t").cast("timestamp"))).collect()
    assert {(r.label, r["count"], r.share) for r in found} == {
        ("Позитивный", 3, 0.75), ("Негативный", 1, 0.25),
    }


def test_selection_of_topics(spark):
    rows = table(spark)
    assert R.only_values(rows, "topic_name", None).count() == len(ROWS)
    assert R.only_values(rows, "topic_name", []).count() == len(ROWS)
    assert R.only_values(rows, "topic_name", ["water", "nope"]).count() == 1
    assert R.only_values(rows, "topic_name", ["nope"]).count() == 0


def test_names_bounds_and_latest(spark):
    rows = table(spark)
    assert [r[0] for r in R.distinct_sorted(rows, "topic_name").collect()] == ["heat", "roads", "water"]
    assert R.time_bounds(rows).first().min_date == dt.datetime(2025, 1, 1, 10)
    assert R.latest_period(rows, R.week_start("date_time"), "w").first().w == dt.date(2025, 1, 13)
    assert R.without_nulls(rows, "topic_name", "date_time").count() == 3


def test_last_value_is_zero_when_missing(spark):
    series = spark.createDataFrame(
        [("a", 1, 5.0), ("a", 2, 7.0), ("b", 1, None)], "topic_name string, month_start int, percent double"
    )
    found = {r.topic_name: r.last_value for r in R.last_values(series, "percent", "month_start").collect()}
    assert found == {"a": 7.0, "b": 0.0}


def test_range_filter_reaches_the_scan(spark, tmp_path):
    table(spark).write.parquet(str(tmp_path / "t"))
    rows = R.date_range(spark.read.parquet(str(tmp_path / "t")), "2025-01-01", "2025-01-05").select("topic_name")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date_time" in plan and "LessThan(date_time" in plan
    assert "ReadSchema: struct<topic_name:string,date_time:timestamp>" in plan
    assert rows.count() == 2

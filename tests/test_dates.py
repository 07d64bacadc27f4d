import datetime as dt

import pytest
from pyspark.sql import functions as F

from townpulse.functions import dates as D
from townpulse.functions.numbers import batch_of, percent


def stamps(values, expression, texts):
    return values(expression, texts)


def test_weeks_start_on_monday(values):
    ts = F.col("text").cast("timestamp")
    given = ["2024-12-30 00:00:00", "2025-01-05 23:59:59", "2025-01-06 00:00:00", None]
    assert values(D.week_start(ts), given) == [
        dt.date(2024, 12, 30), dt.date(2024, 12, 30), dt.date(2025, 1, 6), None,
    ]
    assert values(D.week_label(ts), given[:3]) == [
        "2024-12-30/2025-01-05", "2024-12-30/2025-01-05", "2025-01-06/2025-01-12",
    ]


def test_month_is_that_of_the_weeks_monday(values):
    ts = F.col("text").cast("timestamp")
    assert values(D.month_of_week(ts), ["2025-01-01", "2025-01-06"]) == [
        dt.date(2024, 12, 1), dt.date(2025, 1, 1),
    ]
    assert values(D.calendar_month(ts), ["2025-01-01"]) == [dt.date(2025, 1, 1)]
    assert values(D.year_of(ts), ["2025-01-01"]) == [2025]


def test_epoch_seconds_are_utc(values):
    shown = D.stamp_text(D.from_epoch("text"))
    assert values(shown, [0, 1735689599, None], "bigint") == [
        "1970-01-01 00:00:00", "2024-12-31 23:59:59", None,
    ]


def test_parsing(spark, values):
    good = dt.datetime(2024, 2, 29, 1, 2, 3)
    assert values(D.parse_lenient("text"), ["2024-02-29 01:02:03", "2024-02-30", "x", None]) == [
        good, None, None, None,
    ]
    assert values(D.parse_lenient("text", "dd.MM.yyyy"), ["29.02.2024", "2024"])[1] is None
    assert values(D.parse_strict("text"), ["2024-02-29 01:02:03"]) == [good]
    with pytest.raises(Exception):
        values(D.parse_strict("text"), ["x"])


def test_next_months(values):
    assert values(D.next_months(F.col("text").cast("date"), 3), ["2024-11-01"]) == [
        [dt.date(2024, 12, 1), dt.date(2025, 1, 1), dt.date(2025, 2, 1)]
    ]


def test_days_ago(spark):
    row = spark.range(1).select(
        (F.current_timestamp() - D.days_ago(40) == F.expr("interval 40 days")).alias("same")
    )
    assert row.first().same


LAST = ["2024-01-30 23:59:59", "2024-01-31 00:00:00", "2024-01-31 18:00:00", "2024-02-01 00:00:00"]


@pytest.mark.parametrize(
    "end, inclusive, kept",
    [
        ("2024-01-31", True, 3),
        ("2024-01-31", False, 1),
        (dt.date(2024, 1, 31), True, 3),
        ("2024-01-31 18:00:00", True, 3),
        ("2024-01-31 18:00:00", False, 2),
        (dt.datetime(2024, 1, 31, 18), True, 3),
        (dt.datetime(2024, 1, 31, 20, tzinfo=dt.timezone(dt.timedelta(hours=2))), True, 3),
        (None, True, 4),
    ],
)
def test_end_of_range(values, end, inclusive, kept):
    inside = D.in_range(F.col("text").cast("timestamp"), "2024-01-01", end, inclusive)
    assert values(inside, LAST) == [True] * kept + [False] * (4 - kept)


def test_both_bounds_are_inside(values):
    inside = D.in_range(F.col("text").cast("timestamp"), LAST[0], LAST[2])
    assert values(inside, LAST) == [True, True, True, False]


def test_percent_rounds_half_to_even(spark):
    rows = spark.createDataFrame([(49, 400), (51, 400), (0, 0), (1, 3)], "c bigint, t bigint")
    assert [r[0] for r in rows.select(percent(F.col("c"), F.col("t"))).collect()] == [
        12.2, 12.8, 0.0, 33.3,
    ]


def test_batches_count_from_one(values):
    assert values(batch_of("text", 100), [1, 100, 101, 200], "bigint") == [1, 1, 2, 2]

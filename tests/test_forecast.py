import datetime as dt
import itertools
import math
import random

import pytest

from townpulse.operators import forecast as C
from townpulse.operators import trends as R


def month(n):
    return dt.date(2020 + n // 12, n % 12 + 1, 1)


def series(spark, **named):
    rows = [(name, month(i), v) for name, ys in named.items() for i, v in enumerate(ys)]
    return spark.createDataFrame(rows, "topic_name string, month_start date, percent double")


def predicted(df, **options):
    rows = C.forecast_series(df, **options).collect()
    return {
        name: [r.percent for r in sorted(rows, key=lambda r: r.month_start) if r.topic_name == name]
        for name in {r.topic_name for r in rows}
    }


TENTHS = [i / 10 for i in range(1, 10)]


def one_fit(y, seasonal, p, m=12):
    """Smoothing written as a loop over one series: its error and final state."""
    a, b, g, shift, tilt, swing = p
    if seasonal:
        first, second = sum(y[:m]) / m, sum(y[m : 2 * m]) / m
        level, slope = first + shift * (second - first), tilt * ((second - first) / m)
        season, rest = [swing * (v - first) for v in y[:m]], y[m:]
    else:
        rise = y[1] - y[0]
        level, slope, season, rest = y[0] + shift * rise, tilt * rise, [0.0], y[1:]
    sse = 0.0
    for v in rest:
        base, due = level + slope, season[0]
        sse += (v - base - due) ** 2
        new = a * (v - due) + (1 - a) * base
        slope = b * (new - level) + (1 - b) * slope
        season = season[1:] + [g * (v - base) + (1 - g) * due if seasonal else 0.0]
        level = new
    return round(sse, 9), p, (level, slope, season)


def by_hand(y, horizon=3, m=12):
    """The same search for one series: error and forecast."""
    seasonal = len(y) >= 2 * m
    coarse = (0.1, 0.3, 0.5, 0.7, 0.9)
    starts = itertools.product(coarse, coarse, coarse if seasonal else [0.0])
    best = min(one_fit(y, seasonal, (*p, 0.0, 1.0, 1.0)) for p in starts)
    for n in range(7):
        for smoothing, starting in ((0.1 / 2**n, 0.0), (0.0, 0.5 / 2**n)):
            tried = []
            for corner in itertools.product((-1, 0, 1), repeat=3):
                p = [
                    min(max(round(x + c * smoothing, 6), 0.01), 0.99) for x, c in zip(best[1][:3], corner)
                ] + [round(x + c * starting, 6) for x, c in zip(best[1][3:], corner)]
                if not seasonal:
                    p[2], p[5] = best[1][2], best[1][5]
                tried.append(one_fit(y, seasonal, tuple(p)))
            best = min(tried)
    level, slope, season = best[2]
    return best[0], [level + h * slope + season[(h - 1) % len(season)] for h in range(1, horizon + 1)]


def wavy(n):
    return [20 + 0.3 * i + 5 * math.sin(2 * math.pi * i / 12) + ((i * 7919) % 13) / 4 for i in range(n)]


@pytest.mark.parametrize("length", [2, 3, 23, 24, 30, 47])
def test_same_as_a_loop_over_one_series(spark, length):
    y = wavy(length)
    found = predicted(series(spark, a=y))["a"]
    assert found == pytest.approx(by_hand(y)[1], abs=0.051)


@pytest.mark.parametrize("length", [6, 23, 24, 30, 47, 80])
def test_less_error_than_a_fine_grid_from_fixed_starts(length):
    rng = random.Random(length)
    for y in (wavy(length), [rng.uniform(0, 40) for _ in range(length)], [v + rng.gauss(0, 6) for v in wavy(length)]):
        seasonal = length >= 24
        grid = itertools.product(TENTHS, TENTHS, TENTHS if seasonal else [0.0])
        fixed = min(one_fit(y, seasonal, (*p, 0.0, 1.0, 1.0))[0] for p in grid)
        assert by_hand(y)[0] < fixed


def test_short_series_repeat_the_last_value(spark):
    assert predicted(series(spark, one=[7.25]))["one"] == [7.2] * 3
    assert predicted(series(spark, none=[None]))["none"] == [0.0] * 3
    assert predicted(series(spark)) == {}


def test_each_series_adds_exactly_the_horizon(spark):
    df = series(spark, a=wavy(30), b=wavy(5), c=[1.0])
    found = C.forecast_series(df, horizon=4).collect()
    assert len(found) == 12
    assert sorted(r.month_start for r in found if r.topic_name == "a") == [month(n) for n in range(30, 34)]


def test_straight_line_and_pure_season_continue(spark):
    line = [float(i) for i in range(10)]
    wave = [10 + 5 * math.sin(2 * math.pi * i / 12) for i in range(36)]
    found = predicted(series(spark, line=line, wave=wave))
    assert found["line"] == [10.0, 11.0, 12.0]
    assert found["wave"] == [pytest.approx(wave[i], abs=0.06) for i in range(3)]


def test_gaps_are_closed(spark):
    gappy = [1.0, 2.0, None, 3.0, 4.0]
    assert predicted(series(spark, a=gappy))["a"] == [5.0, 6.0, 7.0]


def test_values_may_leave_0_to_100(spark):
    assert predicted(series(spark, a=[90.0, 95.0, 100.0]))["a"] == [105.0, 110.0, 115.0]


def test_without_season(spark):
    y = wavy(30)
    assert predicted(series(spark, a=y), season=None)["a"] != predicted(series(spark, a=y))["a"]


def test_rows_without_a_name_make_no_series(spark):
    df = series(spark, a=[1.0, 2.0]).unionByName(
        spark.createDataFrame([(None, month(0), 1.0)], "topic_name string, month_start date, percent double")
    )
    assert list(predicted(df)) == ["a"]


def test_observed_and_forecast_in_one_table(spark):
    rows = [(f"2024-{m:02d}-10", t) for m in range(1, 7) for t in "aab"]
    df = spark.createDataFrame(rows, "date_time string, topic_name string")
    df = df.withColumn("date_time", df.date_time.cast("timestamp"))
    table = C.share_with_forecast(R.monthly_topic_share(df))
    assert table.columns == ["month_start", "topic_name", "count", "total_comments", "percent", "data_type"]
    ahead = table.filter(table.data_type == C.FORECAST).collect()
    assert len(ahead) == 6 and all(r["count"] is None and r.total_comments is None for r in ahead)
    assert {r.percent for r in ahead} == {66.7, 33.3}
    assert min(r.month_start for r in ahead) == dt.date(2024, 7, 1)


def test_fits_stay_inside_the_row_of_their_series(spark):
    found = C.forecast_series(series(spark, a=wavy(30), b=wavy(31)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    # the values of a series meet once; the only rows made are the months ahead
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Generate explode") == 1

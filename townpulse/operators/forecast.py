"""Short forecasts of many series at once by exponential smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Months in a season, months ahead (fixed).
SEASON = 12
HORIZON = 3
# Marks of the two kinds of rows (fixed values).
OBSERVED = "актуальный"
FORECAST = "прогноз"
# Smoothing parameters tried first, and the bounds of those tried later.
COARSE = (0.1, 0.3, 0.5, 0.7, 0.9)
LEAST, MOST = 0.01, 0.99
# Sizes of the boxes searched one after the other: of smoothing parameters, of the starting state.
BOXES = [
    size for n in range(7) for size in ((0.1 / 2**n, 0.0), (0.0, 0.5 / 2**n))
]
SMOOTHING, STARTING = ("alpha", "beta", "gamma"), ("shift", "tilt", "swing")


def _coarse(seasonal: bool) -> Column:
    """First candidates: smoothing parameters on a grid, the starting state as the data suggest it."""
    values = F.array(*[F.lit(v) for v in COARSE])

    def pairs(a: Column) -> Column:
        def triples(b: Column) -> Column:
            def candidate(g: Column) -> Column:
                start = [F.lit(v).alias(n) for n, v in zip(STARTING, (0.0, 1.0, 1.0), strict=True)]
                return F.struct(a.alias("alpha"), b.alias("beta"), g.alias("gamma"), *start)

            return F.transform(values if seasonal else F.array(F.lit(0.0)), candidate)

        return F.flatten(F.transform(values, triples))

    return F.flatten(F.transform(values, pairs))


def _box(best: Column, size: Column, seasonal: Column) -> Column:
    """Candidates around the best one: each parameter of a kind less, the same or more."""
    names = ("x", "y", "z")
    corners = F.array(
        *[
            F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(names, (i, j, k), strict=True)])
            for i in (-1, 0, 1)
            for j in (-1, 0, 1)
            for k in (-1, 0, 1)
        ]
    )

    def candidate(o: Column) -> Column:
        moved = []
        for kind, step in ((SMOOTHING, size["smoothing"]), (STARTING, size["starting"])):
            for name, axis in zip(kind, names, strict=True):
                value = F.round(best[name] + o[axis] * step, 6)
                if kind is SMOOTHING:
                    value = F.least(F.greatest(value, F.lit(LEAST)), F.lit(MOST))
                if name in ("gamma", "swing"):
                    value = F.when(seasonal, value).otherwise(best[name])
                moved.append(value.alias(name))
        return F.struct(*moved)

    return F.transform(corners, candidate)


def _mean(values: Column, count: int) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x) / F.lit(float(count))


def _state(sse: Column, p: Column, level: Column, slope: Column, season: Column) -> Column:
    """A fit so far. Its error comes first, then its parameters, so that fits are ordered by them."""
    own = [p[n].alias(n) for n in (*SMOOTHING, *STARTING)]
    return F.struct(sse.alias("sse"), *own, level.alias("level"), slope.alias("slope"), season.alias("season"))


def _rounded(state: Column) -> Column:
    """Errors that agree in nine digits are equal."""
    return _state(F.round(state["sse"], 9), state, state["level"], state["slope"], state["season"])


def _fit_trend(p: Column, length: int) -> Column:
    """Additive trend: level and slope start about the first two values."""
    first = F.col("_y")[0]
    rise = F.col("_y")[1] - first
    none = F.array_repeat(F.lit(0.0), length)
    start = _state(F.lit(0.0), p, first + p["shift"] * rise, p["tilt"] * rise, none)

    def step(state: Column, value: Column) -> Column:
        expected = state["level"] + state["slope"]
        level = state["alpha"] * value + (1 - state["alpha"]) * expected
        return _state(
            state["sse"] + (value - expected) * (value - expected),
            state,
            level,
            state["beta"] * (level - state["level"]) + (1 - state["beta"]) * state["slope"],
            state["season"],
        )

    return F.aggregate("_rest", start, step, _rounded)


def _fit_season(p: Column, season: int) -> Column:
    """Additive trend and season; starts about the means of the first two years.

    ``season`` of the state always begins with the entry due next.
    """
    rise = F.col("_second") - F.col("_first")
    start = _state(
        F.lit(0.0),
        p,
        F.col("_first") + p["shift"] * rise,
        p["tilt"] * (rise / F.lit(float(season))),
        F.transform(F.slice("_y", 1, season), lambda x: p["swing"] * (x - F.col("_first"))),
    )

    def step(state: Column, value: Column) -> Column:
        due = state["season"][0]
        base = state["level"] + state["slope"]
        expected = base + due
        level = state["alpha"] * (value - due) + (1 - state["alpha"]) * base
        return _state(
            state["sse"] + (value - expected) * (value - expected),
            state,
            level,
            state["beta"] * (level - state["level"]) + (1 - state["beta"]) * state["slope"],
            F.concat(
                F.slice(state["season"], 2, season - 1),
                F.array(state["gamma"] * (value - base) + (1 - state["gamma"]) * due),
            ),
        )

    return F.aggregate("_rest", start, step, _rounded)


def _searched(seasonal: bool, length: int) -> Column:
    """The best fit of the row's series: the best of the grid, then of each box around the best so far."""

    def fit(p: Column) -> Column:
        return _fit_season(p, length) if seasonal else _fit_trend(p, length)

    boxes = F.array(
        *[F.struct(F.lit(a).alias("smoothing"), F.lit(b).alias("starting")) for a, b in BOXES]
    )
    return F.aggregate(
        boxes,
        F.array_min(F.transform(_coarse(seasonal), fit)),
        lambda best, size: F.array_min(F.transform(_box(best, size, F.lit(seasonal)), fit)),
    )


def forecast_series(
    series: DataFrame,
    key: str = "topic_name",
    period: str = "month_start",
    value: str = "percent",
    horizon: int = HORIZON,
    season: int | None = SEASON,
) -> DataFrame:
    """``key, period, value`` for the ``horizon`` months after each series' last one.

    Two full seasons or more: additive trend and season; two values or more:
    additive trend; less: the last value, or 0. Gaps are closed, not filled. For
    each series the smoothing parameters and the starting state with the least
    squared one-step error are searched: on a coarse grid, then in boxes that shrink
    around the best found, ties to the smallest. Values are rounded to one decimal.

    A series is one array of monthly values, a length the calendar bounds, and all
    its fits happen inside its row; only the monthly values and one row for each
    series are shuffled.
    """
    spark = series.sparkSession
    ordered = F.array_sort(F.collect_list(F.struct(F.col(period).alias("p"), F.col(value).alias("v"))))
    known = (
        series.filter(F.col(period).isNotNull())
        .groupBy(key)
        # counted, not filtered on input: the grid below is then computed only once
        .agg(F.max(period).alias("_last"), ordered.alias("_pairs"), F.count(key).alias("_named"))
        .filter("_named > 0")
        .withColumn("_y", F.filter(F.transform("_pairs", lambda x: x["v"].cast("double")), lambda v: v.isNotNull()))
        .select(key, "_last", "_y")
    )
    length = season or 1
    size = F.size("_y")
    seasonal = (size >= 2 * season) if season else F.lit(False)
    ready = known.withColumns(
        {
            "_first": F.when(seasonal, _mean(F.slice("_y", 1, length), length)),
            "_second": F.when(seasonal, _mean(F.slice("_y", length + 1, length), length)),
            "_rest": F.when(seasonal, F.slice("_y", F.lit(length + 1), F.greatest(size - length, F.lit(0))))
            .when(size >= 2, F.slice("_y", F.lit(2), F.greatest(size - 1, F.lit(0))))
            .otherwise(F.array().cast("array<double>")),
        }
    )
    # fits are long: few series are spread over the tasks too, one row each
    spread = ready.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)
    flat = _state(
        F.lit(0.0),
        F.struct(*[F.lit(0.0).alias(n) for n in (*SMOOTHING, *STARTING)]),
        F.coalesce(F.try_element_at("_y", F.lit(-1)), F.lit(0.0)),
        F.lit(0.0),
        F.array_repeat(F.lit(0.0), length),
    )
    fitted = F.when(size >= 2, _searched(False, length)).otherwise(flat)
    if season:
        fitted = F.when(seasonal, _searched(True, length)).otherwise(fitted)
    best = spread.select(key, "_last", fitted.alias("_fit"))
    ahead = best.withColumn("_h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    due = F.element_at("_fit.season", (F.pmod(F.col("_h") - 1, F.lit(length)) + 1).cast("int"))
    predicted = F.col("_fit.level") + F.col("_h") * F.col("_fit.slope") + due
    return ahead.select(
        key,
        F.add_months("_last", F.col("_h")).alias(period),
        F.bround(predicted, 1).alias(value),
    )


def share_with_forecast(
    shares: DataFrame, horizon: int = HORIZON, season: int | None = SEASON
) -> DataFrame:
    """Observed monthly shares and their forecast in one table, told apart by ``data_type``.

    Forecast rows have neither ``count`` nor ``total_comments``. Topics are kept
    apart by their raw name; break names into lines afterwards.
    """
    ahead = forecast_series(shares, horizon=horizon, season=season)
    return shares.withColumn("data_type", F.lit(OBSERVED)).unionByName(
        ahead.withColumn("data_type", F.lit(FORECAST)), allowMissingColumns=True
    )

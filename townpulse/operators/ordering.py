"""Running numbers, caps and take-while over a feed, safe when one group is huge.

A window over a whole group would put that group into one task. Here a group that is
too large is first cut into buckets that follow its order, at quantiles of a sample of
its rows; buckets still too large are cut again. Bucket sizes are aggregated (one
row per bucket), running totals are taken over those few rows, and a real sort
happens only inside a bucket. Equal and missing positions are ordered by a hash of the
whole row, so that they are cut too, whatever the distribution of positions.

Rows without a group form a group of their own; rows without a position come
last in their group. No row is lost for having nulls. Rows equal in every column cannot
be cut apart and stay in one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from townpulse.scale import attach, settle

# Rows of a bucket that one task sorts.
WIDTH = 1 << 20
# Parts that a bucket is cut into at once, a power of 2, and rows looked at for each of them.
PARTS, SAMPLED = 64, 32
# Crowded buckets whose cuts are sent along; more are merged with the rows.
MOST_CUT = 2_000


def seq_bucket(seq: str | Column, width: int = WIDTH) -> Column:
    column = F.col(seq) if isinstance(seq, str) else seq
    return F.floor(column / F.lit(width)).cast("bigint")


def place_of(df: DataFrame, order: list[str]) -> Column:
    """A row's place in the order of the ``order`` columns, nulls last, ties by a hash of the row."""
    maps = {f.name for f in df.schema.fields if f.dataType.typeName() == "map"}
    whole = [F.to_json(c) if c in maps else F.col(c) for c in df.columns]
    given = [
        part
        for n, c in enumerate(order)
        for part in (F.col(c).isNull().alias(f"n{n}"), F.col(c).alias(f"o{n}"))
    ]
    return F.struct(*given, F.xxhash64(*whole).alias("h"))


def _crowded(rows: DataFrame, keys: list[str], place: str, most: int) -> DataFrame:
    """Buckets of more than ``most`` rows that can be cut, with where to cut them. Runs jobs."""
    named = {key: f"_key{n}" for n, key in enumerate(keys)}
    narrow = rows.select(*[F.col(k).alias(v) for k, v in named.items()], F.col(place).alias("_place"))
    by = list(named.values())
    big = settle(
        narrow.groupBy(*by)
        .agg(F.count("*").alias("_n"), F.min("_place").alias("_first"), F.max("_place").alias("_last"))
        .filter((F.col("_n") > most) & (F.col("_first") < F.col("_last")))
    )
    parts = F.least(F.lit(PARTS), F.ceil(2 * F.col("_n") / most)).cast("int")
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / (parts * SAMPLED)))
    sampled = attach(narrow, big, by, "inner", null_safe=True).filter(
        F.pmod(F.xxhash64("_place"), step) == 0
    )
    quantiles = F.transform(
        F.sequence(F.lit(1), F.col("_parts")),
        lambda i: F.get("_all", F.floor(F.size("_all") * i / (F.col("_parts") + 1)).cast("int")),
    )
    cuts = (
        sampled.groupBy(*by)
        .agg(F.sort_array(F.collect_list("_place")).alias("_all"), F.first(parts - 1).alias("_parts"))
        .withColumn("_cuts", quantiles)
        .select(*by, "_cuts")
    )
    # the last place is always a cut, so that every round takes something off
    found = attach(big.select(*by, "_last"), cuts, by, null_safe=True)
    none = F.array().cast(cuts.schema["_cuts"].dataType)
    usable = F.filter(F.coalesce("_cuts", none), lambda c: c.isNotNull())
    all_cuts = F.array_sort(F.array_distinct(F.concat(usable, F.array("_last"))))
    return found.select(*by, all_cuts.alias("_cuts")).withColumnsRenamed({v: k for k, v in named.items()})


def _part_of(place: str) -> Column:
    """How many of the row's cuts its place has reached, by halving; null without cuts."""
    halves = F.array(*[F.lit(1 << n) for n in reversed(range(PARTS.bit_length()))])

    def step(at: Column, half: Column) -> Column:
        reached = (at + half <= F.size("_cuts")) & (F.get("_cuts", at + half - 1) <= F.col(place))
        return F.when(F.coalesce(reached, F.lit(False)), at + half).otherwise(at)

    return F.when(F.col("_cuts").isNotNull(), F.aggregate(halves, F.lit(0), step))


def in_buckets(rows: DataFrame, keys: list[str], place: str, bucket: str, most: int) -> DataFrame | None:
    """``rows`` with ``bucket``, an array that sorts like their places, where some are too many for one.

    None when no bucket is needed. Runs a count, and a sample for each round of cuts.
    """
    rows, cut = rows.withColumn(bucket, F.array().cast("array<int>")), False
    while True:
        cuts = settle(_crowded(rows, [*keys, bucket], place, most))
        if cuts.isEmpty():
            return rows if cut else None
        rows, cut = attach(rows, cuts, [*keys, bucket], max_rows=MOST_CUT, null_safe=True), True
        deeper = F.concat(bucket, F.array(_part_of(place)))
        rows = rows.withColumn(bucket, F.when(F.col("_cuts").isNull(), F.col(bucket)).otherwise(deeper)).drop("_cuts")


def bucket_totals(df: DataFrame, keys: list[str], bucket: str, weight: Column) -> DataFrame:
    """One row per (keys, bucket): ``_size``, and ``_before`` = sum of earlier buckets."""
    order = F.asc_nulls_last(bucket)
    earlier = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return (
        df.groupBy(*keys, bucket)
        .agg(F.sum(weight).cast("bigint").alias("_size"))
        .withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    )


def running_number(
    df: DataFrame, group: str, seq: str, out: str = "number", width: int = WIDTH
) -> DataFrame:
    """1-based number of each row in its group, in ``seq`` order; a task sorts about ``width`` rows.

    Runs a count of the groups, and of the buckets of those too large for a task.
    """
    placed = df.withColumn("_place", place_of(df, [seq]))
    cut = in_buckets(placed, [group], "_place", "_bucket", width)
    if cut is None:
        number = F.row_number().over(W.partitionBy(group).orderBy("_place"))
        return placed.withColumn(out, number.cast("bigint")).drop("_place")
    totals = bucket_totals(cut, [group], "_bucket", F.lit(1))
    inside = F.row_number().over(W.partitionBy(group, "_bucket").orderBy("_place"))
    return (
        attach(cut, totals, [group, "_bucket"], "inner", null_safe=True)
        .withColumn(out, (F.col("_before") + inside).cast("bigint"))
        .drop("_place", "_bucket", "_size", "_before")
    )


def keep_first(
    df: DataFrame,
    group: str,
    order: list[str],
    count: int,
    levels: list[Column] | None = None,
    width: int = WIDTH,
) -> DataFrame:
    """The first ``count`` rows of each group in the order of the ``order`` columns.

    ``levels`` are ever finer coarsenings of that order, if some are known, e.g. post,
    bucket of the comment in the post. Level by level, buckets wholly under the cap are
    kept and wholly beyond it dropped, without any sort; only the one bucket of a group
    that crosses the cap is looked into. While that one has more than ``width`` rows it
    is cut at quantiles. Runs one small aggregation per level; when no group reaches the
    cap, the first one shows it and the rows are returned as they are.
    """
    columns = df.columns
    keys = [group]
    totals = settle(df.groupBy(group).agg(F.count("*").alias("_size")))
    if totals.filter(F.col("_size") > count).isEmpty():
        return df
    place = place_of(df, order)
    rest = df.withColumns({"_place": place, "_room": F.lit(count).cast("bigint")})
    kept = None

    def look_into(rest: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Rows of whole buckets, and those of buckets that cross the cap with the room left there."""
        totals = settle(bucket_totals(rest, [*keys, "_room"], name, F.lit(1)))
        under = F.col("_before") + F.col("_size") <= F.col("_room")
        totals = totals.filter(F.col("_before") < F.col("_room")).select(
            *keys, name, under.alias("_whole"), (F.col("_room") - F.col("_before")).alias("_left")
        )
        keys.append(name)
        tagged = attach(rest.drop("_room"), totals, keys, "inner", null_safe=True)
        whole = tagged.filter("_whole").select(*columns)
        crossing = tagged.filter(~F.col("_whole")).withColumnRenamed("_left", "_room").drop("_whole")
        return whole, crossing

    for depth, level in enumerate(levels or []):
        whole, rest = look_into(rest.withColumn(f"_level{depth}", level), f"_level{depth}")
        kept = whole if kept is None else kept.unionByName(whole)
    depth = 0
    while True:
        cuts = settle(_crowded(rest, keys, "_place", width))
        if cuts.isEmpty():
            break
        name = f"_cut{depth}"
        rest = attach(rest, cuts, keys, max_rows=MOST_CUT, null_safe=True)
        whole, rest = look_into(rest.withColumn(name, F.coalesce(_part_of("_place"), F.lit(0))).drop("_cuts"), name)
        kept = whole if kept is None else kept.unionByName(whole)
        depth += 1
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("_place"))
    edge = rest.withColumn("_rank", rank).filter(F.col("_rank") <= F.col("_room")).select(*columns)
    return edge if kept is None else kept.unionByName(edge)


def take_while(df: DataFrame, group: str, position: Column, stop: Column) -> DataFrame:
    """Rows of each group that come before its first row where ``stop`` holds.

    ``position`` is one comparable expression (a struct for several columns). A
    null position comes after all others: such a row stays only where its group
    has no stop before it. One minimum per group, then a comparison; no sort.
    Runs the aggregation.
    """
    marked = df.withColumn("_position", position)
    stops = settle(marked.filter(stop).groupBy(group).agg(F.min("_position").alias("_stop")))
    if stops.isEmpty():
        return df
    return (
        attach(marked, stops, [group], "left", null_safe=True)
        .filter(F.col("_stop").isNull() | (F.col("_position") < F.col("_stop")))
        .select(*df.columns)
    )

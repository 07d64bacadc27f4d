import random

import pytest
from pyspark.sql import functions as F

from townpulse import scale
from townpulse.operators import ordering as O


def feed(spark, sizes, seed=1):
    """Groups of the given sizes with gaps between positions, in random order."""
    rnd = random.Random(seed)
    rows = []
    for name, size in sizes.items():
        positions = rnd.sample(range(size * 3), size)
        rows += [(name, p, rnd.randrange(100)) for p in positions]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "g string, seq bigint, v bigint").repartition(5), rows


SIZES = {"hot": 600, "warm": 40, "cold": 3}


@pytest.mark.parametrize("limit", [0, 1, 7, 40, 599, 600, 1000])
@pytest.mark.parametrize("width", [16, 10_000])
def test_keep_first(spark, limit, width):
    df, rows = feed(spark, SIZES)
    kept = O.keep_first(df, "g", ["seq"], limit, [O.seq_bucket("seq", width)])
    expected = set()
    for name in SIZES:
        expected |= {(name, s) for s in sorted(s for g, s, _ in rows if g == name)[:limit]}
    assert sorted((r.g, r.seq) for r in kept.collect()) == sorted(expected)


def test_keep_first_by_levels_inside_one_huge_post(spark):
    # nearly all comments of the group belong to one post
    rows = [("g", 1, p) for p in range(5)] + [("g", 2, p) for p in range(500)] + [("g", 3, 0)]
    df = spark.createDataFrame(rows, "g string, post bigint, pos bigint").repartition(4)
    levels = [O.seq_bucket("post", 10), F.col("post"), O.seq_bucket("pos", 32)]
    for limit in (4, 5, 77, 505, 506, 600):
        kept = O.keep_first(df, "g", ["post", "pos"], limit, levels)
        assert sorted((r.post, r.pos) for r in kept.collect()) == [r[1:] for r in rows[:limit]]


def test_keep_first_under_the_cap_returns_the_rows_themselves(spark):
    df, _ = feed(spark, SIZES)
    assert O.keep_first(df, "g", ["seq"], 600) is df


@pytest.mark.parametrize("width", [7, 10_000])
def test_running_number(spark, width):
    df, rows = feed(spark, SIZES)
    found = {(r.g, r.seq): r.number for r in O.running_number(df, "g", "seq", width=width).collect()}
    for name in SIZES:
        ordered = sorted(s for g, s, _ in rows if g == name)
        assert [found[name, s] for s in ordered] == list(range(1, len(ordered) + 1))


def test_take_while_stops_at_the_first_hit_even_if_later_rows_qualify(spark):
    rows = [("a", 1, 9), ("a", 2, 1), ("a", 3, 9), ("b", 1, 9), ("b", 2, 9), ("c", 1, 0)]
    df = spark.createDataFrame(rows, "g string, seq bigint, v bigint")
    kept = O.take_while(df, "g", F.col("seq"), F.col("v") < 5)
    assert sorted((r.g, r.seq) for r in kept.collect()) == [("a", 1), ("b", 1), ("b", 2)]


def test_take_while_without_a_stop_keeps_everything(spark):
    df, rows = feed(spark, SIZES)
    assert O.take_while(df, "g", F.col("seq"), F.col("v") < 0).count() == len(rows)


def test_no_window_spans_a_whole_group(spark):
    df, _ = feed(spark, SIZES)
    plan = O.running_number(df, "g", "seq", width=16)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_bucket" in line for line in windows)


def test_attach_gives_the_same_rows_broadcast_or_merged(spark):
    df, _ = feed(spark, SIZES)
    table = spark.createDataFrame([("hot", 1), ("cold", 2)], "g string, w int")
    small = scale.attach(df, table, ["g"], "left")
    large = scale.attach(df, table, ["g"], "left", max_rows=1)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in large._jdf.queryExecution().executedPlan().toString()
    assert sorted(small.collect()) == sorted(large.collect())


def test_a_hot_key_is_split_when_merged(spark):
    keys = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 60_000, 1, 16).select(
            F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5_000).alias("g"),
            F.sha2(F.col("id").cast("string"), 256).alias("text"),
        )
        table = spark.range(5_000).select(F.col("id").alias("g"), (F.col("id") * 2).alias("w"))
        joined = scale.attach(rows, table, ["g"], "left", max_rows=10)
        assert len(joined.collect()) == 60_000
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin(skew=true)" in plan
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_shared_folder_is_the_one_the_session_names(spark):
    assert scale.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scale.shared_path(spark, "x").startswith(scale.shared_folder(spark))


def odd_feed(spark):
    rows = [("a", 1), ("a", 2), ("a", None), ("b", 5), (None, 1), (None, 2), (None, None), ("b", None)]
    return spark.createDataFrame(rows, "g string, seq bigint")


@pytest.mark.parametrize("count", [1, 2, 3, 10])
@pytest.mark.parametrize("width", [1, 2, 1 << 20])
def test_keep_first_keeps_rows_with_nulls(spark, count, width):
    kept = O.keep_first(odd_feed(spark), "g", ["seq"], count, [O.seq_bucket("seq", width)]).collect()
    want = {"a": [1, 2, None], "b": [5, None], None: [1, 2, None]}
    for g, seqs in want.items():
        found = sorted((r.seq for r in kept if r.g == g), key=lambda s: (s is None, s))
        assert found == seqs[:count]


def test_numbers_of_rows_with_nulls(spark):
    rows = O.running_number(odd_feed(spark), "g", "seq", width=2).collect()
    found = {(r.g, r.seq): r.number for r in rows}
    assert len(rows) == 8 and found[("a", None)] == 3 and found[(None, None)] == 3 and found[(None, 1)] == 1


def test_take_while_treats_null_positions_as_last(spark):
    rows = odd_feed(spark)
    everything = O.take_while(rows, "g", F.col("seq"), F.col("seq") > 100)
    assert everything.count() == 8
    some = O.take_while(rows, "g", F.col("seq"), (F.col("seq") == 2))
    assert sorted(map(str, ((r.g, r.seq) for r in some.collect()))) == sorted(
        map(str, [("a", 1), (None, 1), ("b", 5), ("b", None)])
    )


@pytest.mark.parametrize("positions", ["null", "equal", "sparse", "skewed"])
def test_any_distribution_of_positions_spreads_over_tasks(spark, positions):
    """A million rows of one group, numbered in buckets of 50,000."""
    seq = {
        "null": "CAST(NULL AS BIGINT)",
        "equal": "7L",
        "sparse": "id * 9000000000000L",
        "skewed": "IF(id % 2 = 0, id, -5)",
    }[positions]
    df = spark.range(0, 1_000_000, 1, 8).selectExpr("'hot' AS g", f"{seq} AS seq", "id AS v")
    cut = O.in_buckets(df.withColumn("p", O.place_of(df, ["seq"])), ["g"], "p", "b", 50_000)
    sizes = [r["count"] for r in cut.groupBy("b").count().collect()]
    assert len(sizes) >= 20 and max(sizes) <= 50_000 and sum(sizes) == 1_000_000
    found = O.running_number(df, "g", "seq", width=50_000)
    row = found.agg(
        F.count("*").alias("n"), F.countDistinct("number").alias("d"), F.min("number").alias("a"), F.max("number").alias("z")
    ).first()
    assert tuple(row) == (1_000_000, 1_000_000, 1, 1_000_000)
    if positions == "sparse":
        assert found.filter("number <> v + 1").isEmpty()
    if positions == "skewed":
        assert found.filter("(seq = -5) <> (number <= 500000)").isEmpty()


@pytest.mark.parametrize("limit", [1, 33, 1999, 2000, 2345])
def test_caps_over_repeated_null_and_sparse_positions(spark, limit):
    rnd = random.Random(6)
    places = [None] * 900 + [5] * 700 + [rnd.randrange(10**15) for _ in range(700)]
    rows = [("g", p, n) for n, p in enumerate(places)] + [(None, n % 3, n) for n in range(50)]
    df = spark.createDataFrame(rows, "g string, seq bigint, v bigint").repartition(6)
    kept = O.keep_first(df, "g", ["seq"], limit, width=40).collect()
    assert len(kept) == len({(r.g, r.v) for r in kept})
    for g in ("g", None):
        order = sorted((p is None, p or 0) for name, p, _ in rows if name == g)
        assert sorted((r.seq is None, r.seq or 0) for r in kept if r.g == g) == order[:limit]
    again = O.keep_first(df.repartition(3), "g", ["seq"], limit, width=10_000).collect()
    assert sorted(map(str, kept)) == sorted(map(str, again))


def test_rows_equal_in_every_column_are_numbered_too(spark):
    df = spark.createDataFrame([("g", 1, "x")] * 300 + [("g", 2, "y")] * 3, "g string, seq int, t string")
    found = O.running_number(df.repartition(4), "g", "seq", width=10).collect()
    assert sorted(r.number for r in found) == list(range(1, 304))
    assert {r.number for r in found if r.seq == 2} == {301, 302, 303}
    assert len(O.keep_first(df, "g", ["seq"], 302, width=10).collect()) == 302

import numpy as np
import pytest
from pyspark.sql import functions as F

from townpulse.operators import topics as T

DIMS = 32


def planted(seed=0, spread=0.04):
    """Three tight groups of 12, 15 and 20, one of 5, and 10 scattered unit vectors."""
    rnd = np.random.default_rng(seed)
    rows, group, number = [], [], 0
    for name, size in enumerate((12, 15, 20, 5)):
        centre = rnd.normal(size=DIMS)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            v = centre + rnd.normal(size=DIMS) * spread
            rows.append((number, [float(x) for x in v / np.linalg.norm(v)]))
            group.append(name)
            number += 1
    for _ in range(10):
        v = rnd.normal(size=DIMS)
        rows.append((number, [float(x) for x in v / np.linalg.norm(v)]))
        group.append(-1)
        number += 1
    return rows, group


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, v array<double>").repartition(4)


def by_pairs(rows, threshold, neighbours, min_size=10):
    """Density clusters by comparing all pairs, for a fixture this small."""
    v = np.array([r[1] for r in rows])
    near = v @ v.T >= threshold
    core = near.sum(axis=1) >= neighbours
    label = [-1] * len(rows)
    current = 0
    for i in range(len(rows)):
        if not core[i] or label[i] != -1:
            continue
        stack, label[i] = [i], current
        while stack:
            j = stack.pop()
            for k in np.flatnonzero(near[j]):
                if label[k] == -1:
                    label[k] = current
                    if core[k]:
                        stack.append(k)
        current += 1
    sizes = {c: label.count(c) for c in set(label) - {-1}}
    keep = sorted((c for c in sizes if sizes[c] >= min_size), key=lambda c: (-sizes[c], label.index(c)))
    return [keep.index(c) if c in keep else -1 for c in label]


@pytest.mark.parametrize("seed", [0, 3])
def test_planted_groups_are_found_as_by_comparing_all_pairs(spark, seed):
    rows, group = planted(seed)
    expected = by_pairs(rows, 0.8, 5)
    assert sorted(set(expected)) == [-1, 0, 1, 2]
    found = T.density_topics(frame(spark, rows), "id", "v", DIMS, threshold=0.8).collect()
    labels = {r.id: r.topic for r in found}
    assert [labels[i] for i in range(len(rows))] == expected


def test_topic_zero_is_the_largest_and_small_groups_are_noise(spark):
    rows, group = planted(1)
    found = T.density_topics(frame(spark, rows), "id", "v", DIMS, threshold=0.8)
    sizes = {r.topic: r["count"] for r in found.groupBy("topic").count().collect()}
    assert sizes == {0: 20, 1: 15, 2: 12, -1: 15}


def test_copies_cost_nothing_and_count_fully(spark):
    rows, _ = planted(2)
    lone = next(r for r in rows if r[0] == 61)[1]
    copies = rows + [(1000 + i, lone) for i in range(2000)]
    found = T.density_topics(frame(spark, copies), "id", "v", DIMS, threshold=0.8)
    first = {r.id: r.topic for r in found.collect()}
    assert {first[1000 + i] for i in range(2000)} == {0} and first[61] == 0


def test_same_topics_whatever_the_order_and_partitioning(spark):
    rows, _ = planted(3)
    one = T.density_topics(spark.createDataFrame(rows, "id bigint, v array<double>").coalesce(1), "id", "v", DIMS)
    two = T.density_topics(frame(spark, rows[::-1]).repartition(9), "id", "v", DIMS)
    assert sorted((r.id, r.topic) for r in one.collect()) == sorted((r.id, r.topic) for r in two.collect())


def test_missing_and_zero_vectors_are_handled(spark):
    rows, _ = planted(0)
    rows = rows + [(900, None), (901, [0.0] * DIMS)]
    found = T.density_topics(frame(spark, rows), "id", "v", DIMS, threshold=0.8)
    labels = {r.id: r.topic for r in found.collect()}
    assert len(labels) == len(rows) and labels[900] == labels[901] == -1


def test_all_columns_stay(spark):
    rows, _ = planted(0)
    df = frame(spark, rows).withColumn("text", F.lit("t"))
    assert T.density_topics(df, "id", "v", DIMS).columns == ["id", "v", "text", "topic"]
    with pytest.raises(ValueError):
        T.density_topics(df, "id", "v", DIMS, bits=T.MOST_BITS + 1)


def test_components_of_a_long_chain(spark):
    nodes = spark.range(40).select(F.col("id").alias("cell"))
    pairs = [(i, i + 1) for i in range(0, 19)] + [(i, i + 1) for i in range(25, 32)]
    links = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "a bigint, b bigint")
    found = {r.cell: r.root for r in T.components(nodes, links).collect()}
    assert all(found[i] == 0 for i in range(20)) and all(found[i] == 25 for i in range(25, 33))
    assert found[22] == 22


def unrelated(number, seed=9, first=10_000):
    rnd = np.random.default_rng(seed)
    v = rnd.normal(size=(number, DIMS))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return [(first + i, x) for i, x in enumerate(v.tolist())]


def groups_of(found, rows):
    """Sets of rows that share a topic."""
    labels = {r.id: r.topic for r in found.collect()}
    sets = {}
    for i, _ in rows:
        sets.setdefault(labels[i], set()).add(i)
    return {frozenset(s) for t, s in sets.items() if t >= 0}, {i for i, _ in rows if labels[i] < 0}


def test_unrelated_rows_and_doubling_leave_groups_as_they_were(spark):
    rows, _ = planted(4, spread=0.06)
    alone = groups_of(T.density_topics(frame(spark, rows), "id", "v"), rows)
    assert sorted(map(len, alone[0])) == [12, 15, 20]
    beside = frame(spark, rows + unrelated(30_000))
    assert groups_of(T.density_topics(beside, "id", "v"), rows) == alone
    big = [r for r in rows if r[0] < 47]
    twice = frame(spark, big + [(i + 1000, v) for i, v in big])
    again = T.density_topics(twice, "id", "v")
    assert groups_of(again, big) == groups_of(T.density_topics(frame(spark, big), "id", "v"), big)
    assert sorted(r["count"] for r in again.groupBy("topic").count().collect()) == [24, 30, 40]


def test_an_unrelated_row_in_a_cell_is_noise_and_a_near_one_is_not(spark):
    """With no planes all rows are in one cell, where each is judged by itself."""
    rows, group = planted(0)
    expected = by_pairs(rows, 0.8, 5)
    found = T.density_topics(frame(spark, rows), "id", "v", threshold=0.8, bits=0, tables=1).collect()
    labels = {r.id: r.topic for r in found}
    assert [labels[i] for i in range(len(rows))] == expected


def test_crowded_cells_are_cut_and_what_no_plane_cuts_is_chained(spark, monkeypatch):
    rows, _ = planted(6)
    expected = groups_of(T.density_topics(frame(spark, rows), "id", "v", threshold=0.8), rows)
    monkeypatch.setattr(T, "MOST_ROWS", 12)
    cut = T.density_topics(frame(spark, rows), "id", "v", threshold=0.8, bits=0)
    assert groups_of(cut, rows) == expected
    monkeypatch.setattr(T, "MOST_ROWS", 60)
    rnd = np.random.default_rng(1)
    tight = [(i, (1 + rnd.random(DIMS) * 1e-9).tolist()) for i in range(300)]
    found = T.density_topics(frame(spark, tight), "id", "v", threshold=0.9, tables=2)
    assert {r.topic for r in found.collect()} == {0}


def test_groups_of_sorted_batches_meet_again():
    import pyarrow as pa

    keys = [0] * 3 + [1] * 7 + [2] + [3] * 4
    batches = [pa.record_batch({"k": keys[a:b], "n": list(range(a, b))}) for a, b in [(0, 2), (2, 2), (2, 9), (9, 15)]]
    found = [t.column("n").to_pylist() for t in T.together(iter(batches), ["k"])]
    assert found == [[0, 1, 2], [3, 4, 5, 6, 7, 8, 9], [10], [11, 12, 13, 14]]


def test_keys_may_repeat_and_columns_may_clash(spark):
    rows, _ = planted(0)
    df = frame(spark, [(7, v) for _, v in rows]).selectExpr(
        "*", "1 AS h1", "2 AS h2", "3 AS point", "4 AS weight", "5 AS part", "6 AS topic"
    )
    found = T.density_topics(df, "id", "v", threshold=0.8)
    sizes = {r.topic: r["count"] for r in found.groupBy("topic").count().collect()}
    assert sizes == {0: 20, 1: 15, 2: 12, -1: 15} and "weight" in found.columns


def test_kmeans_topics(spark):
    rows, group = planted(0)
    found = {r.id: r.topic for r in T.kmeans_topics(frame(spark, rows[:47]), "id", "v", 3, seed=3).collect()}
    assert sorted(set(found.values())) == [0, 1, 2]
    sizes = [list(found.values()).count(t) for t in range(3)]
    assert sizes == sorted(sizes, reverse=True)
    strict = T.kmeans_topics(frame(spark, rows[:47]), "id", "v", 3, threshold=0.999999, seed=3)
    assert strict.filter("topic = -1").count() > 0


@pytest.mark.parametrize("chunk", [500, 2])
def test_nearest_given_topic(spark, chunk):
    given = [(3, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [0.0, 5.0]), (9, [0.0, 0.0])]
    centroids = spark.createDataFrame(given, "topic bigint, centroid array<double>")
    rows = [(1, [9.0, 0.1]), (2, [0.1, 3.0]), (3, [-1.0, -1.0]), (4, [0.0, 0.0]), (5, None)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    found = T.assign_topics(df, centroids, "id", "v", threshold=0.5, chunk=chunk)
    assert {r.id: r.topic for r in found.collect()} == {1: 3, 2: 1, 3: -1, 4: -1, 5: -1}


def test_centroids(spark):
    rows = [(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [0.0, 1.0]), (None, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "topic bigint, v array<float>")
    found = {r.topic: r.centroid for r in T.topic_centroids(df, "topic", "v").collect()}
    assert found == {1: [2.0, 3.0], 2: [0.0, 1.0]}


def by_all_products(vectors, ids, centroids, threshold):
    c = centroids / np.linalg.norm(centroids, axis=1, keepdims=True)
    scores = np.round(vectors / np.linalg.norm(vectors, axis=1, keepdims=True) @ c.T, 9)
    best = scores.max(axis=1)
    return [min(ids[s == b]) if b >= threshold else -1 for s, b in zip(scores, best)], best


@pytest.mark.parametrize("most", [T.MOST_CENTRE_NUMBERS, 200_000])
def test_fifty_thousand_centroids(spark, monkeypatch, most):
    """In one pass over the rows, and in several."""
    monkeypatch.setattr(T, "MOST_CENTRE_NUMBERS", most)
    rnd = np.random.default_rng(4)
    centroids, vectors = rnd.normal(size=(50_000, 8)), rnd.normal(size=(400, 8))
    centroids[40_000:] = centroids[:10_000]  # ties
    ids = rnd.permutation(50_000)
    expected, best = by_all_products(vectors, ids, centroids, 0.97)
    known = spark.createDataFrame([(int(i), c.tolist()) for i, c in zip(ids, centroids)], "topic bigint, centroid array<double>")
    df = spark.createDataFrame([(n // 2, v.tolist()) for n, v in enumerate(vectors)], "id bigint, v array<double>")
    found = T.assign_topics(df, known, "id", "v", threshold=0.97)
    assert sorted((r.id, r.topic, r.closeness) for r in found.collect()) == sorted(
        (n // 2, t, b) for n, (t, b) in enumerate(zip(expected, best))
    )
    plan = found._jdf.queryExecution().toString()
    assert len(plan) < 50_000 and "Join" not in plan


def test_blocks_that_cannot_be_nearest_are_not_compared():
    rnd = np.random.default_rng(0)
    places = rnd.normal(size=(20, 16))
    places /= np.linalg.norm(places, axis=1, keepdims=True)
    centroids = np.repeat(places, 100, axis=0) + rnd.normal(size=(2000, 16)) * 0.03
    centroids /= np.linalg.norm(centroids, axis=1, keepdims=True)
    index = T.Nearest(np.arange(2000), centroids, centroids[::100], 64)
    rows = centroids[5::40] + 0.001
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    found, best, compared = index.find(rows)
    expected, closeness = by_all_products(rows, np.arange(2000), centroids, -1)
    assert found.tolist() == expected and np.array_equal(best, closeness)
    assert compared < len(rows) * 2000 / 5


def test_centroids_of_no_use(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id bigint, v array<double>")
    kind = "topic bigint, centroid array<double>"
    for rows in ([], [(1, [0.0, 0.0]), (None, [1.0, 1.0]), (2, None)]):
        found = T.assign_topics(df, spark.createDataFrame(rows, kind), "id", "v").collect()
        assert {(r.id, r.topic, r.closeness) for r in found} == {(1, -1, None), (2, -1, None)}
    found = T.assign_topics(df, spark.createDataFrame([(7, [1.0, 2.0])], kind), "id", "v").collect()
    assert {(r.id, r.topic) for r in found} == {(1, 7), (2, -1)}


def test_kmeans_ends_at_a_fixed_point(spark):
    """Each row's centre, the direction of its cluster's sum, is the nearest of all centres."""
    rnd = np.random.default_rng(8)
    vectors = rnd.normal(size=(300, 5))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    found = T.kmeans_topics(frame(spark, rows), "id", "v", 6, max_iter=100).collect()
    labels = np.array([r.topic for r in sorted(found, key=lambda r: r.id)])
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    centres = np.array([units[labels == k].sum(axis=0) for k in range(6)])
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    assert (np.argmax(units @ centres.T, axis=1) == labels).all()


def test_kmeans_of_copies_and_of_too_few_rows(spark):
    rows = [(i, [1.0, 0.0]) for i in range(50)] + [(90, [0.0, 1.0]), (91, [0.0, 0.0]), (92, None)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>").withColumn("cluster", F.lit("x"))
    found = T.kmeans_topics(df, "id", "v", 5)
    assert {(r.topic, r["count"]) for r in found.groupBy("topic").count().collect()} == {(0, 50), (1, 1)}
    assert found.columns == ["id", "v", "cluster", "topic"]
    assert T.kmeans_topics(df.limit(0), "id", "v", 5).collect() == []


def test_near_rows_in_single_precision_equal_rounded_products():
    rng = np.random.default_rng(5)
    rows = np.repeat(rng.normal(size=(60, 24)), 12, axis=0) + 0.3 * rng.normal(size=(720, 24))
    rows = np.concatenate([rows, np.repeat(rows[:2], 300, axis=0)])
    rows /= np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    exact = np.round(rows @ rows.T, 9)
    # thresholds that pairs, and whole groups of copies, lie on
    for threshold in (0.7, 1.0, -1.0, float(exact[0, 1]), float(exact[0, 500])):
        assert (T.near_rows(rows, threshold) == (exact >= threshold)).all()


def test_a_unit_vector_sums_its_length_once(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 2.0],)], "v array<double>")
    made = T.unit("v").alias("u")
    assert [r.u for r in rows.select(made).collect()] == [[0.6, 0.8], [0.0, 1.0]]
    plan = rows.select(made)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SQRT") == 1 and plan.index("SQRT") < plan.index("/")


def test_texts_are_hashed_once_for_the_fit_the_mean_and_the_vectors(spark, tmp_path):
    from townpulse.plans.batch import text_vectors

    spark.range(40).selectExpr("id AS row_id", "concat('aa bb', id % 3, ' cc') AS cleaned").write.parquet(str(tmp_path / "v"))
    made = text_vectors(spark.read.parquet(str(tmp_path / "v")), 16)
    assert "FileScan" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.columns == ["row_id", "cleaned", "vector"] and made.count() == 40

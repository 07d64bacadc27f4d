import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from townpulse.llm import hard_negatives as H

SCHEMA = "vec_id bigint, embedding array<float>, label int, v string, tree string, id string, anchor int"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, "x", "x", "x", 1) for r in rows], schema).repartition(5)


def plain(rows, every=10, scale=256):
    good = [
        (i, [int(np.floor(scale * float(np.float32(x)))) for x in v], label)
        for i, v, label in rows
        if i is not None and label is not None and v is not None
        and all(x is not None and np.isfinite(x) for x in v)
    ]
    sizes = [len(v) for _, v, _ in good]
    dims = max(set(sizes), key=lambda d: (sizes.count(d), d)) if sizes else 0
    good = [g for g in good if len(g[1]) == dims]
    out = []
    for at, (i, v, label) in enumerate(good):
        if i % every:
            continue
        scored = [
            (-sum(x * y for x, y in zip(v, w)), j, other) for n, (j, w, other) in enumerate(good) if n != at
        ]
        scored.sort(key=lambda s: s[:2])
        for ps, p, _ in [s for s in scored if s[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and 30 * -ps <= 100 * -s[0] <= 90 * -ps][:10]
            out += [(i, p, n, s[1], -ps, -s[0]) for n, s in enumerate(fits, 1)]
    return sorted(out)


def found(df, every=10):
    return sorted(tuple(r) for r in H.mine(df, F.col("vec_id") % every == 0).collect())


def vectors(n, dims, seed, groups=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    out = []
    for i in range(n):
        v = centres[i % groups] * rng.random() + rng.normal(size=dims) * 0.4
        out.append((i, (v / np.linalg.norm(v)).tolist(), int(rng.integers(0, 3))))
    return out


def odd():
    rows = vectors(300, 6, 1)
    copies = [(1000 + i, rows[7][1], rows[7][2] if i % 2 else 9) for i in range(60)]
    return rows + copies + [rows[10], rows[10], (None, rows[3][1], 1), (2000, None, 1), (2010, rows[5][1], None)] + [
        (2020, [0.1, None, 0.2, 0.0, 0.0, 0.0], 1),
        (2030, [float("nan")] * 6, 1),
        (2040, [float("-inf")] + [0.0] * 5, 1),
        (2050, [1.0, 2.0], 1),
        (2060, [], 1),
        (2070, [0.0] * 6, 2),
        (2080, [-0.9] * 6, 77),
    ]


@pytest.mark.parametrize("leaf,tree,block", [(256, 8192, 4096), (4, 40, 3)])
def test_negatives_equal_brute_force(spark, monkeypatch, leaf, tree, block):
    monkeypatch.setattr(H, "LEAF_ROWS", leaf)
    monkeypatch.setattr(H, "NODE_CHILDREN", 3)
    monkeypatch.setattr(H, "TREE_ROWS", tree)
    monkeypatch.setattr(H, "ANCHOR_BLOCK", block)
    rows = odd()
    assert found(frame(spark, rows)) == plain(rows)


def test_large_components_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-(2**22), 2**22) for _ in range(4)], i % 2) for i in range(40)]
    assert found(frame(spark, rows)) == plain(rows)


def test_no_rows_no_anchors_no_negatives(spark):
    assert found(frame(spark, [])) == []
    assert found(frame(spark, [(1, [1.0], 1), (2, [1.0], 2)])) == []
    assert found(frame(spark, [(10, [1.0], 1), (20, [1.0], 1)])) == []


def test_keys_and_labels_of_text(spark):
    rows = [(f"k{i:03}", v, f"l{label}") for i, v, label in vectors(80, 5, 2)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>, label string")
    got = H.mine(df, F.col("vec_id").endswith("0")).collect()
    as_numbers = [(int(i[1:]), v, int(label[1:])) for i, v, label in rows]
    numbers = H.mine(
        spark.createDataFrame(as_numbers, "vec_id bigint, embedding array<double>, label int"),
        F.col("vec_id") % 10 == 0,
    ).collect()
    assert len(got) > 0
    assert sorted((int(r[0][1:]), int(r[1][1:]), r[2], int(r[3][1:]), *r[4:]) for r in got) == sorted(
        tuple(r) for r in numbers
    )


def test_boxes_bound_all_products_and_leaves_hold_all_rows():
    rng = np.random.default_rng(3)
    points = np.floor(rng.normal(size=(700, 5)) * 50)
    leaves = H.tiled(points, np.arange(700), 16, [2, 0, 4])
    order = np.concatenate(leaves)
    assert sorted(order.tolist()) == list(range(700)) and max(len(x) for x in leaves) <= 16
    tree = H.Tree(points[order], order.tolist(), np.zeros(700), np.cumsum([len(x) for x in leaves]))
    anchors = np.floor(rng.normal(size=(9, 5)) * 50)
    least, most = tree.bounds(anchors)
    products = anchors @ tree.points.T

    def rows_below(node):
        a, b = tree.spans[node]
        return list(range(a, b)) if node >= tree.first_leaf else [r for c in range(a, b) for r in rows_below(c)]

    assert rows_below(0) == list(range(700))
    for node in range(len(tree.spans)):
        rows = rows_below(node)
        assert (least[:, node] <= products[:, rows].min(axis=1)).all()
        assert (most[:, node] >= products[:, rows].max(axis=1)).all()


def test_boxes_outside_the_windows_stay_shut(monkeypatch):
    """Of well separated groups only the leaves about the windows are read."""
    points = np.repeat(np.arange(64.0), 8)[:, None] * np.array([1.0, 0.0])
    tree = H.Tree(points, list(range(512)), np.zeros(512), np.arange(8, 513, 8))
    read = []

    class Seen(np.ndarray):
        def __matmul__(self, other):
            read.append(len(self))
            return np.asarray(self) @ other

    tree.points = points.view(Seen)
    least, most = tree.bounds(np.array([[1.0, 0.0]]))
    best = [[]]
    tree.search(
        np.array([1.0, 0.0]), least[0].tolist(), most[0].tolist(), np.ones(512, bool), np.array([[10.0, 20.0]]), 10, best
    )
    assert [(-s, i) for s, i in best[0]] == [(20, i) for i in range(160, 168)] + [(19, 152), (19, 153)]
    assert read == [8, 8]

"""Hard negatives by inner product, from R-trees packed by sort-tile-recursive.

Vectors are made integer: each component x becomes floor(scale * x). Rows are dealt to tasks by ranges
of the coordinate with the greatest variance and the key, so that equal vectors spread too. A task sorts
and tiles its rows by the next coordinates into leaves, and groups leaves into nodes, each with its
minimum bounding box. A box bounds the inner product with an anchor coordinate by coordinate: from the
sum of the smaller to the sum of the larger of a * low and a * high.

Anchors are searched in blocks of bounded size, each against all trees. A best-first queue per anchor
opens the box with the greatest upper bound. First come an anchor's positives, the rows of its own
label with the highest scores. Each positive's score gives a window of scores, and the second search
looks for the rows of other labels in these windows: a box is passed over if it lies outside all
windows, or strictly below the last of the rows already found in each. Tasks keep what they found from
tree to tree and return at most ``count`` rows for each window, which are merged by the anchor.

All anchors against all rows take time in proportion to their product; boxes of vectors without
structure in many dimensions overlap and exclude little. Trees are written to the shared folder, results
block by block, so a lost executor costs a part of one block.

Defined cases: rows without key, label or vector, with a null or non-finite component, or with another
number of components than most rows have (ties: the greater) take no part. Equal scores are ordered by
the smaller key. A repeated key is another row, and so is an equal row: an anchor leaves out itself
alone. Empty tables give no rows. Other columns are not read. Scores must fit into 64 bits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from townpulse.llm.common import kept
from townpulse.scale import shared_path

LEAF_ROWS = 256
NODE_CHILDREN = 16
# Rows of one tree, and anchors searched together.
TREE_ROWS = 8192
ANCHOR_BLOCK = 4096

Found = list[tuple[int, object]]


def tiled(points: np.ndarray, rows: np.ndarray, leaf: int, axes: list[int]) -> list[np.ndarray]:
    """``rows`` in leaves: sorted by the first axis and cut into slabs, each tiled by the other axes."""
    order = rows[np.argsort(points[rows, axes[0]], kind="stable")]
    pages = -(-len(rows) // leaf)
    slabs = max(1, int(np.ceil(pages ** (1 / len(axes)) - 1e-9)))
    size = leaf * -(-pages // slabs)
    if len(axes) == 1 or pages == 1:
        return [order[at : at + leaf] for at in range(0, len(order), leaf)]
    return [
        tile
        for at in range(0, len(order), size)
        for tile in tiled(points, order[at : at + size], leaf, axes[1:])
    ]


class Tree:
    """Rows in leaf order and the nodes above them; node 0 is the root, children follow their parents."""

    def __init__(self, points: np.ndarray, ids: list, labels: np.ndarray, bounds: np.ndarray):
        """``bounds`` are the ends of the leaves."""
        self.points, self.ids, self.labels = points, ids, labels
        starts = np.append(0, bounds[:-1])
        low, high = np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts)
        levels, spans = [(low, high)], [list(zip(starts.tolist(), bounds.tolist(), strict=True))]
        while len(low) > 1:
            groups = np.arange(0, len(low), NODE_CHILDREN)
            spans.append([(g, min(g + NODE_CHILDREN, len(low))) for g in groups.tolist()])
            low, high = np.minimum.reduceat(low, groups), np.maximum.reduceat(high, groups)
            levels.append((low, high))
        # from the root down; children's numbers are moved to where their level begins
        self.spans, offset = [], 0
        for depth in range(len(levels) - 1, -1, -1):
            offset += len(spans[depth])
            shift = offset if depth else 0
            self.spans += [(a + shift, b + shift) for a, b in spans[depth]]
        self.first_leaf = len(self.spans) - len(spans[0])
        self.low = np.concatenate([x for x, _ in levels[::-1]])
        self.high = np.concatenate([x for _, x in levels[::-1]])

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each anchor with anything in each node's box."""
        plus, minus = np.maximum(anchors, 0), np.minimum(anchors, 0)
        least = plus @ self.low.T + minus @ self.high.T
        return least, plus @ self.high.T + minus @ self.low.T

    def search(
        self,
        anchor: np.ndarray,
        least: list,
        most: list,
        allowed: np.ndarray,
        windows: np.ndarray,
        count: int,
        found: list[Found],
    ) -> None:
        """Put the best ``count`` allowed rows of each window [low, high] into ``found``, best first."""
        floor, top = np.where(windows[:, 0] <= windows[:, 1], windows[:, 0], np.inf), windows[:, 1]

        def raise_floor(w: int) -> None:
            if len(found[w]) == count:
                floor[w] = max(windows[w, 0], -found[w][-1][0])

        for w in range(len(windows)):
            raise_floor(w)
        queue = [(-most[0], 0)]
        while queue:
            above, node = heapq.heappop(queue)
            if -above < floor.min():
                return
            if not ((floor <= -above) & (top >= least[node])).any():
                continue
            a, b = self.spans[node]
            if node < self.first_leaf:
                for child in range(a, b):
                    heapq.heappush(queue, (-most[child], child))
                continue
            scores = self.points[a:b] @ anchor
            hits = (scores >= floor[:, None]) & (scores <= top[:, None]) & allowed[a:b]
            for w in np.flatnonzero(hits.any(axis=1)).tolist():
                fresh = [(-int(scores[i]), self.ids[a + i]) for i in np.flatnonzero(hits[w]).tolist()]
                found[w] = sorted(found[w] + fresh)[:count]
                raise_floor(w)


def _exact(points: np.ndarray, greatest: float) -> np.ndarray:
    """Doubles where sums of products are exact in them, Python integers otherwise."""
    size = max(float(np.abs(points).max(initial=0)), greatest)
    return points if size * size * points.shape[1] < 2**52 else points.astype("int64").astype(object)


def packed_trees(rows: DataFrame, key: str, label: str, vector: str, scale: int, queries: Column) -> DataFrame:
    """One row per tree: tree, ids, labels, anchors (whether each row is one), bounds, vectors (doubles)."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = rows.select(
        F.col(key).alias("id"),
        F.col(label).alias("label"),
        F.coalesce(queries, F.lit(False)).alias("anchor"),
        F.col(vector).cast("array<double>").alias("v"),
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad)
    sizes = usable.groupBy(F.size("v").alias("dims")).count()
    most = sizes.orderBy(F.desc("count"), F.desc("dims")).first()
    dims = most.dims if most else 0
    usable = usable.where(F.size("v") == dims)
    axes = [0]
    if dims:
        spread = usable.agg(vector_to_array(Summarizer.variance(array_to_vector("v"))).alias("s")).first().s
        axes = sorted(range(dims), key=lambda i: (-spread[i], i))
    tasks = -(-most["count"] // TREE_ROWS) if most else 1
    kinds = {c: usable.schema[c].dataType.simpleString() for c in ("id", "label")}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _rows_together(batches, TREE_ROWS):
            n = table.num_rows
            points = np.floor(table.column("v").combine_chunks().flatten().to_numpy() * scale).reshape(n, dims)
            pages = -(-n // LEAF_ROWS)
            used = axes[1 : 1 + max(1, int(np.log2(pages)))] or axes
            leaves = tiled(points, np.arange(n), LEAF_ROWS, used) if dims else [np.arange(n)]
            order = np.concatenate(leaves)
            whole = points[order]
            small = np.abs(whole).max(initial=0) < 2**15
            table = table.take(pa.array(order)).combine_chunks()

            def listed(column, offsets=pa.array([0, n], pa.int32())):
                return pa.ListArray.from_arrays(offsets, column.combine_chunks())

            yield pa.record_batch(
                [
                    listed(table.column("id")),
                    listed(table.column("label")),
                    listed(table.column("anchor")),
                    pa.array([np.cumsum([len(x) for x in leaves]).tolist()], pa.list_(pa.int32())),
                    pa.array([small]),
                    pa.array([whole.astype("<i2" if small else "<f8").tobytes()], pa.binary()),
                ],
                names=["ids", "labels", "anchors", "bounds", "small", "vectors"],
            )

    # the key spreads equal coordinates
    dealt = usable.repartitionByRange(tasks, F.get("v", F.lit(axes[0])), "id")
    packed = dealt.mapInArrow(
        pack,
        f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, anchors array<boolean>, "
        "bounds array<int>, small boolean, vectors binary",
    )
    return kept(packed.withColumn("tree", F.expr("uuid()")), "trees")


def _rows_together(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches as tables of ``most`` rows, the last with the rest."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        while sum(b.num_rows for b in waiting) >= most:
            table = pa.Table.from_batches(waiting)
            yield table.slice(0, most)
            waiting = table.slice(most).to_batches()
    if sum(b.num_rows for b in waiting):
        yield pa.Table.from_batches(waiting)


def _trees(batches: Iterator[pa.RecordBatch], greatest: float) -> Iterator[tuple[str, Tree]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            ids = row["ids"].as_py()
            kind = "<i2" if row["small"].as_py() else "<f8"
            points = np.frombuffer(row["vectors"].as_buffer(), kind).astype(float).reshape(len(ids), -1)
            labels = row["labels"].values.to_numpy(zero_copy_only=False)
            bounds = np.array(row["bounds"].as_py())
            yield row["tree"].as_py(), Tree(_exact(points, greatest), ids, labels, bounds)


def anchor_rows(trees: DataFrame) -> DataFrame:
    """(tree, place, id, label, vector) of all rows that are anchors."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch.itertuples():
                points = np.frombuffer(t.vectors, "<i2" if t.small else "<f8").reshape(len(t.ids), -1)
                at = np.flatnonzero(np.asarray(t.anchors, bool))
                if not len(at):
                    continue
                yield pd.DataFrame(
                    {
                        "tree": t.tree,
                        "place": at,
                        "id": np.asarray(t.ids)[at],
                        "label": np.asarray(t.labels)[at],
                        "v": list(points[at].astype(float)),
                    }
                )

    kinds = [trees.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels")]
    schema = f"tree string, place bigint, id {kinds[0]}, label {kinds[1]}, v array<double>"
    return trees.mapInPandas(unpack, schema)


def best_rows(
    trees: DataFrame, anchors: list, windows: list[np.ndarray], same: bool, count: int
) -> tuple[DataFrame, Broadcast]:
    """(anchor, window, place, score, id): the best rows of each anchor's windows, place from 1.

    ``anchors`` is one block of rows of ``anchor_rows``; the result names them by number. ``same``
    looks for rows of the anchor's label, otherwise for rows of other labels. The block that was sent
    to the executors is returned too, to be destroyed after use.
    """
    points = np.array([a.v for a in anchors], float)
    greatest = float(np.abs(points).max(initial=0))
    own = [(a.tree, a.place, a.label) for a in anchors]
    block = trees.sparkSession.sparkContext.broadcast((_exact(points, greatest), own, windows))
    kind = trees.schema["ids"].dataType.elementType
    arrow_kind = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, own, windows = block.value
        found: list[list[Found]] = [[[] for _ in w] for w in windows]
        for name, tree in _trees(batches, greatest):
            at_once = max(1, (1 << 20) // len(tree.spans))
            for at in range(0, len(points), at_once):
                least, most = tree.bounds(points[at : at + at_once])
                for i in range(at, at + len(least)):
                    if not len(windows[i]):
                        continue
                    own_tree, place, label = own[i]
                    allowed = (tree.labels == label) == same
                    if own_tree == name:
                        allowed[place] = False
                    bounds = least[i - at].tolist(), most[i - at].tolist()
                    tree.search(points[i], *bounds, allowed, windows[i], count, found[i])
        rows = [
            (i, w, -score, key)
            for i, lists in enumerate(found)
            for w, best in enumerate(lists)
            for score, key in best
        ]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.record_batch(
            [*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], arrow_kind)],
            names=["anchor", "window", "score", "id"],
        )

    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    found = trees.select("tree", "ids", "labels", "bounds", "small", "vectors").mapInArrow(
        run, f"anchor bigint, window bigint, score bigint, id {kind.simpleString()}"
    )
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count), block


def mine(
    rows: DataFrame,
    queries: Column,
    *,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 10,
    least_percent: int = 30,
    most_percent: int = 90,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows that satisfy ``queries``. Each anchor's positives are its best rows of the same
    label; for each of these the best rows of other labels whose score is from ``least_percent`` to
    ``most_percent`` of the positive's are ranked from 1.
    """
    spark = rows.sparkSession
    trees = packed_trees(rows, key, label, vector, scale, queries)
    anchors = kept(anchor_rows(trees), "anchors")
    blocks = max(1, -(-anchors.count() // ANCHOR_BLOCK))
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("tree", "place"), F.lit(blocks)))
    path = shared_path(spark, "negatives")
    everything = np.array([[-np.inf, np.inf]])
    kind = trees.schema["ids"].dataType.elementType.simpleString()
    pair_schema = f"anchor bigint, window bigint, anchor_id {kind}, positive_id {kind}, positive_score bigint"
    out_schema = (
        f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, "
        "positive_score bigint, negative_score bigint"
    )
    written = False
    for number in range(blocks):
        block = anchors.where(F.col("block") == number).orderBy("tree", "place").collect()
        if not block:
            continue
        best, shared = best_rows(trees, block, [everything] * len(block), True, positives)
        pairs, windows = [], [[] for _ in block]
        for r in sorted(best.collect(), key=lambda r: (r.anchor, r.place)):
            pairs.append((r.anchor, len(windows[r.anchor]), block[r.anchor].id, r.id, r.score))
            windows[r.anchor].append((-(-least_percent * r.score // 100), most_percent * r.score // 100))
        shared.destroy()
        limits = [np.array(w, float).reshape(-1, 2) for w in windows]
        best, shared = best_rows(trees, block, limits, False, negatives)
        # at most a block's anchors times their positives
        of_pairs = F.broadcast(spark.createDataFrame(pairs, pair_schema))
        best.join(of_pairs, ["anchor", "window"]).select(
            "anchor_id",
            "positive_id",
            F.col("place").cast("int").alias("rank"),
            F.col("id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        ).write.mode("overwrite").parquet(f"{path}/{number}")
        shared.destroy()
        written = True
    if not written:
        return spark.createDataFrame([], out_schema)
    return spark.read.schema(out_schema).option("recursiveFileLookup", "true").parquet(path)

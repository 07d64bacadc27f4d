"""Topics from vectors: density clusters, k-means, nearest given topic."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from townpulse.functions.vectors import norm, unit
from townpulse.scale import attach, settle, written

NOISE = -1
# Rows a topic needs (fixed).
MIN_TOPIC_SIZE = 10
# Sets of planes, planes of a set that cut space at first, and planes that a set has.
TABLES, BITS, MOST_BITS = 8, 8, 60
# Numbers of centres or centroids that are sent to every task at once (64 MB).
MOST_CENTRE_NUMBERS = 1 << 23
# Centroids that serve as points of reference for the others.
PIVOTS = 32
# Different vectors that are compared in one cell; a cell with more is cut by this many further planes.
MOST_ROWS, MORE_BITS = 4096, 4


def plane_signs(dims: int, bits: int) -> np.ndarray:
    """``dims x bits`` matrix of +1 and -1: +1 where (131 i + 977 j + 7)^3 mod 1000003
    is even, for dimension i and plane j counted from 0."""
    i = np.arange(dims, dtype=np.int64)[:, None]
    j = np.arange(bits, dtype=np.int64)[None, :]
    base = (131 * i + 977 * j + 7) % 1000003
    cube = (base * base % 1000003) * base % 1000003
    return np.where(cube % 2 == 0, 1.0, -1.0)


def plane_codes(vectors: np.ndarray, tables: int) -> np.ndarray:
    """(rows, tables): bit j is set where a vector lies on the positive side of the table's plane j."""
    sides = vectors @ plane_signs(vectors.shape[1], tables * MOST_BITS) > 0
    bits = np.zeros((len(vectors), tables, 64), bool)
    bits[:, :, :MOST_BITS] = sides.reshape(len(vectors), tables, MOST_BITS)
    return np.packbits(bits, axis=2, bitorder="little").view("<i8").reshape(len(vectors), tables)


def different_vectors(df: DataFrame, key: str, vector: str, tables: int) -> DataFrame:
    """One row per different vector with a direction, written to the shared folder.

    ``point`` (its smallest key and a hash), ``h1, h2`` (by which rows find it), ``weight`` (rows that
    have it), ``v`` (scaled to length 1) and ``codes`` (one for each table of planes).
    """
    given = df.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_v"))
    points = (
        given.filter(norm("_v") > 0)
        .groupBy(*_hashes("_v"))
        .agg(F.min("_key").alias("_key"), F.count("*").alias("weight"), F.first("_v").alias("_v"))
        .select(
            F.struct(F.col("_key").alias("key"), "h1").alias("point"),
            "h1",
            "h2",
            "weight",
            unit("_v").alias("v"),
        )
    )

    @F.pandas_udf("array<bigint>")
    def codes(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        return pd.Series(list(plane_codes(np.stack(vectors.to_numpy()), tables)))

    return written(points.withColumn("codes", codes("v")), "points")


def _hashes(vector: str) -> list[Column]:
    """128 bits by which vectors are told apart."""
    return [F.xxhash64(vector).alias("h1"), F.xxhash64(F.lit(1), vector).alias("h2")]


def _cell(depth) -> Column:
    """The first ``depth`` bits of the code."""
    return F.col("code").bitwiseAND(F.expr(f"shiftleft(1L, {depth}) - 1"))


def in_cells(points: DataFrame, bits: int) -> DataFrame:
    """``t, depth, cell, chunk, point, weight, v``: each point once in every table.

    A cell of more than ``MOST_ROWS`` points is cut by further planes of its table. What no plane cuts
    is dealt to chunks that share one point. Runs counts of narrow rows, and joins only where needed.
    """
    rows = points.select(
        "point", "weight", "v", "h1", F.posexplode("codes").alias("t", "code")
    ).withColumns({"depth": F.lit(bits), "cell": _cell(bits), "chunk": F.lit(0).cast("bigint")})
    depth = bits
    while True:
        crowded = settle(
            rows.filter(F.col("depth") == depth)
            .groupBy("t", "depth", "cell")
            .agg(F.count("*").alias("_n"), F.min("point").alias("_pivot"))
            .filter(F.col("_n") > MOST_ROWS)
        )
        if crowded.isEmpty():
            break
        if depth == MOST_BITS:
            chunks = F.ceil(F.col("_n") / MOST_ROWS)
            dealt = F.when(F.col("point") == F.col("_pivot"), F.sequence(F.lit(0), chunks - 1)).otherwise(
                F.array(F.pmod(F.xxhash64("h1", "t"), chunks))
            )
            rows = attach(rows, crowded, ["t", "depth", "cell"])
            rows = rows.withColumn("chunk", F.explode(F.coalesce(dealt, F.array(F.lit(0).cast("bigint")))))
            rows = rows.drop("_n", "_pivot")
            break
        deeper = min(MOST_BITS, depth + MORE_BITS)
        split = crowded.select("t", "depth", "cell", F.lit(True).alias("_split"))
        rows = attach(rows, split, ["t", "depth", "cell"])
        rows = rows.withColumns(
            {
                "cell": F.when(F.col("_split"), _cell(deeper)).otherwise(F.col("cell")),
                "depth": F.when(F.col("_split"), deeper).otherwise(F.col("depth")),
            }
        ).drop("_split")
        depth = deeper
    return rows.drop("code", "h1")


def near_rows(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows (of length 1) are as alike as ``threshold``, in 9 digits.

    Products in single precision settle all but those within its error of the threshold, and each two rows
    meet once.
    """
    n, dims = vectors.shape
    single, error = vectors.astype(np.float32), (dims + 4) * 2.0**-23
    near = np.empty((n, n), bool)
    for at in range(0, n, 512):
        end = min(n, at + 512)
        close = single[at:end] @ single[at:].T
        found = close >= threshold
        row, other = np.nonzero(np.abs(close - np.float32(threshold)) <= error)
        if len(row) > 8 * n:
            found = np.round(vectors[at:end] @ vectors[at:].T, 9) >= threshold
        elif len(row):
            exact = np.einsum("ij,ij->i", vectors[at + row], vectors[at + other])
            found[row, other] = np.round(exact, 9) >= threshold
        near[at:end, at:] = found
        near[at:, at:end] = found.T
    return near


def dense_parts(
    vectors: np.ndarray, weights: np.ndarray, threshold: float, least: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first row of a dense part, whether the row is dense itself, and its closeness to the part.

    A row is dense when rows of ``least`` weight, itself included, are within ``threshold`` of it.
    Dense rows within the threshold of each other are of one part; another row belongs to every part
    that has a dense row within the threshold.
    """
    n = len(vectors)
    near = near_rows(vectors, threshold)
    dense = np.empty(n, bool)
    for at in range(0, n, 512):
        dense[at : at + 512] = near[at : at + 512].astype(float) @ weights.astype(float) >= least
    part = np.full(n, -1)
    for first in np.flatnonzero(dense).tolist():
        frontier = np.array([first]) if part[first] < 0 else np.zeros(0, int)
        while len(frontier):
            part[frontier] = first
            reached = near[frontier].any(axis=0)
            frontier = np.flatnonzero(reached & dense & (part < 0))
    inside = np.flatnonzero(dense)
    rows, parts, close = [inside], [part[inside]], [np.ones(len(inside))]
    for row in np.flatnonzero(~dense & near[:, dense].any(axis=1)).tolist():
        by = np.flatnonzero(near[row] & dense)
        score = np.round(vectors[by] @ vectors[row], 9)
        for p in np.unique(part[by]).tolist():
            rows.append([row])
            parts.append([p])
            close.append([score[part[by] == p].max()])
    rows = np.concatenate(rows).astype(np.int64)
    return rows, np.concatenate(parts).astype(np.int64), dense[rows], np.concatenate(close)


def together(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Sorted batches as one table for each group, wherever batches end."""
    waiting: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        fresh = np.zeros(table.num_rows, bool)
        for name in by:
            values = table.column(name).to_numpy()
            fresh[1:] |= values[1:] != values[:-1]
            if waiting and table.num_rows:
                fresh[0] |= waiting[-1].column(name)[0].as_py() != values[0]
        done = 0
        for head in np.flatnonzero(fresh).tolist():
            if head > done:
                waiting.append(table.slice(done, head - done))
            yield pa.concat_tables(waiting)
            waiting, done = [], head
        if table.num_rows > done:
            waiting.append(table.slice(done))
    if waiting:
        yield pa.concat_tables(waiting)


def dense_places(points: DataFrame, bits: int, threshold: float, least: int) -> DataFrame:
    """``point, part, dense, closeness``: the dense parts that a point belongs to, in any cell.

    A part is named by one of its dense points.
    """
    by = ["t", "depth", "cell", "chunk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in together(batches, by):
            n = table.num_rows
            weights = table.column("weight").to_numpy()
            if weights.sum() < least:
                continue
            vectors = table.column("v").combine_chunks().flatten().to_numpy().reshape(n, -1)
            rows, parts, dense, close = dense_parts(vectors, weights, threshold, least)
            point = table.column("point").combine_chunks()
            yield pa.record_batch(
                [point.take(pa.array(rows)), point.take(pa.array(parts)), pa.array(dense), pa.array(close)],
                names=["point", "part", "dense", "closeness"],
            )

    kind = points.schema["point"].dataType.simpleString()
    cells = in_cells(points, bits).repartition(*by).sortWithinPartitions(*by, "point")
    return cells.mapInArrow(run, f"point {kind}, part {kind}, dense boolean, closeness double")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``cell, root``: the smallest cell each node is connected with.

    ``links`` (a, b) hold both directions. Every round each node takes the least
    root among its neighbours, then the root of that root, until nothing changes;
    each round is written to the shared folder.
    """
    roots = settle(nodes.select("cell", F.col("cell").alias("root")))
    while True:
        offered = (
            links.join(roots.select(F.col("cell").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("cell"))
            .agg(F.min("root").alias("_offer"))
        )
        nearer = roots.join(offered, "cell", "left").select(
            "cell", F.col("root").alias("_old"), F.least("root", "_offer").alias("_via")
        )
        onward = roots.select(F.col("cell").alias("_via"), "root")
        moved = settle(
            nearer.join(onward, "_via").select(
                "cell", "root", (F.col("root") < F.col("_old")).alias("_moved")
            )
        )
        if moved.filter("_moved").isEmpty():
            return moved.select("cell", "root")
        roots = moved.select("cell", "root")


def number_by_size(groups: DataFrame, group: str, size: str, first: str) -> DataFrame:
    """``group, topic``: 0 for the largest, ties by the smallest member.

    ``groups`` are whole topics, never more than there are cells or centres.
    """
    order = W.orderBy(F.desc(size), F.asc(first))
    return groups.select(group, (F.row_number().over(order) - 1).cast("bigint").alias("topic"))


def density_topics(
    df: DataFrame,
    key: str,
    vector: str,
    dims: int | None = None,
    bits: int = BITS,
    min_neighbours: int = 5,
    threshold: float = 0.7,
    tables: int = TABLES,
    min_size: int = MIN_TOPIC_SIZE,
) -> DataFrame:
    """Adds ``topic``: density clusters of the vectors by direction; noise is -1.

    ``tables`` fixed sets of planes each cut space into ``2 ** bits`` cells. Rows of one cell are
    compared by cosine: a row with rows of ``min_neighbours`` (itself and copies included) within
    ``threshold`` in a cell is dense, and rows within the threshold of a dense row join it. Cells of
    different tables are linked through the dense rows they share, and what is connected forms a topic.
    Another row takes the topic of the dense row it is most like, if that is within the threshold, and
    is noise otherwise, so unrelated rows in a cell change nothing. Topics under ``min_size`` rows are
    noise, topic 0 is the largest.

    The parameters do not follow the number of rows. Only a cell of more than ``MOST_ROWS`` different
    vectors is cut by further planes, which bounds the comparisons in a task; copies are merged first.
    ``dims`` is not needed any more. Runs jobs.
    """
    if not 0 <= bits <= MOST_BITS:
        raise ValueError(f"a table has {MOST_BITS} planes")
    points = different_vectors(df, key, vector, tables)
    places = written(dense_places(points, bits, threshold, min_neighbours), "places")
    dense = settle(places.filter("dense").select("point").distinct())
    hung = places.filter(F.col("point") != F.col("part")).join(dense, "point", "left_semi")
    ends = F.array(
        F.struct(F.col("point").alias("a"), F.col("part").alias("b")),
        F.struct(F.col("part").alias("a"), F.col("point").alias("b")),
    )
    links = settle(hung.select(F.inline(ends)).distinct())
    roots = components(dense.withColumnRenamed("point", "cell"), links).withColumnRenamed("cell", "point")
    border = (
        places.join(dense, "point", "left_anti")
        .join(roots.withColumnRenamed("point", "part"), "part")
        .groupBy("point")
        .agg(F.min_by("root", F.struct(-F.col("closeness"), F.col("root"))).alias("root"))
    )
    placed = settle(
        roots.select("point", "root")
        .unionByName(border)
        .join(points.select("point", "h1", "h2", "weight"), "point")
    )
    groups = (
        placed.groupBy("root")
        .agg(F.sum("weight").alias("size"), F.min("point.key").alias("first_key"))
        .filter(F.col("size") >= min_size)
    )
    topics = placed.join(number_by_size(groups, "root", "size", "first_key"), "root")
    own = {c: f"_{uuid.uuid4().hex}" for c in ("h1", "h2", "topic")}
    of_vector = topics.select(*[F.col(c).alias(name) for c, name in own.items()])
    rows = df.drop("topic")
    hashes = dict(zip(own.values(), _hashes(F.col(vector).cast("array<double>")), strict=False))
    found = attach(rows.withColumns(hashes), of_vector, [own["h1"], own["h2"]])
    topic = F.coalesce(own["topic"], F.lit(NOISE).cast("bigint")).alias("topic")
    return found.select(*[F.col(c) for c in rows.columns], topic)


def _unit_rows(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """Vectors of equal length as rows of length 1."""
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(float)
    rows = flat.reshape(batch.num_rows, -1) if batch.num_rows else flat.reshape(0, 1)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def first_centres(df: DataFrame, key: str, vector: str, count: int, seed: int) -> np.ndarray:
    """``count`` different directions: vectors in the order of the md5 of ``seed/key``."""
    order = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string")))
    given = df.select(F.col(vector).cast("array<double>").alias("_v"), order.alias("_order"))
    ranked = given.groupBy(*_hashes("_v")).agg(F.min("_order").alias("_order"))
    least = ranked.orderBy("_order", "h1").limit(count)
    # at most ``count`` rows go along
    picked = given.join(F.broadcast(least.select("_order")), "_order", "left_semi")
    chosen = picked.dropDuplicates(["_order"]).orderBy("_order").collect()
    if not chosen:
        return np.zeros((0, 1))
    centres = np.array([r._v for r in chosen], float)
    return np.round(centres / np.sqrt((centres * centres).sum(axis=1, keepdims=True)), 9)


def moved_centres(points: DataFrame, vector: str, centres: np.ndarray) -> np.ndarray:
    """Each centre moved to the direction of the sum of the rows nearest to it.

    A task adds up its rows by centre, so that a centre's numbers are all that is shuffled, whatever
    the size of its cluster. Equal closeness (to 9 digits) goes to the first centre; a centre without
    rows stays where it is.
    """
    count, dims = centres.shape
    shared = points.sparkSession.sparkContext.broadcast(centres)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count, dims))
        for batch in batches:
            rows = _unit_rows(batch, vector)
            if len(rows):
                nearest = np.round(rows @ shared.value.T, 9).argmax(axis=1)
                total += (nearest == np.arange(count)[:, None]).astype(float) @ rows
        centre, place = np.nonzero(total)
        yield pa.record_batch(
            [pa.array(centre), pa.array(place), pa.array(total[centre, place])], names=["centre", "place", "part"]
        )

    sums = (
        points.mapInArrow(add_up, "centre bigint, place bigint, part double")
        .groupBy("centre", "place")
        .agg(F.sum("part").alias("total"))
        .collect()
    )
    shared.destroy()
    moved = np.zeros((count, dims))
    for r in sums:
        moved[r.centre, r.place] = r.total
    length = np.sqrt((moved * moved).sum(axis=1, keepdims=True))
    return np.where(length > 0, np.round(moved / np.where(length > 0, length, 1), 9), centres)


def kmeans_topics(
    df: DataFrame,
    key: str,
    vector: str,
    count: int,
    threshold: float | None = None,
    seed: int = 7,
    max_iter: int = 20,
) -> DataFrame:
    """Adds ``topic``: k-means by cosine; rows less alike to their centre than
    ``threshold`` are noise; ids by size. Rows without direction leave.

    Rounds of assignment and mean until no centre moves (in 9 digits) or ``max_iter`` rounds are done.
    The vectors are written once; a round reads them and shuffles at most ``count`` centres of each
    task. Centres travel as a variable of at most ``MOST_CENTRE_NUMBERS`` numbers, not with the plan.
    """
    columns = [c for c in df.columns if c != "topic"]
    ready = df.filter(F.col(vector).isNotNull() & (norm(vector) > 0))
    points = written(ready.select(F.col(key).alias("key"), F.col(vector).alias("v")), "vectors")
    centres = first_centres(points, "key", "v", count, seed)
    if centres.size > MOST_CENTRE_NUMBERS:
        raise ValueError("too many centres for one variable; cluster in steps")
    for _ in range(max_iter if len(centres) else 0):
        moved = moved_centres(points.select("v"), "v", centres)
        if np.array_equal(moved, centres):
            break
        centres = moved
    shared = df.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("struct<cluster:bigint,closeness:double>")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        if not len(vectors):
            return pd.DataFrame({"cluster": pd.Series([], dtype="int64"), "closeness": pd.Series([], dtype=float)})
        rows = np.stack(vectors.to_numpy()).astype(float)
        rows /= np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        closeness = np.round(rows @ shared.value.T, 9)
        best = closeness.argmax(axis=1)
        return pd.DataFrame({"cluster": best, "closeness": closeness[np.arange(len(best)), best]})

    def placed(of: DataFrame, column: str, out: str) -> DataFrame:
        found = of.withColumn(out, nearest(column))
        if threshold is None:
            return found.withColumn(out, F.col(f"{out}.cluster"))
        return found.withColumn(out, F.when(F.col(out)["closeness"] >= threshold, F.col(out)["cluster"]))

    groups = (
        placed(points, "v", "cluster")
        .filter(F.col("cluster").isNotNull())
        .groupBy("cluster")
        .agg(F.count("*").alias("size"), F.min("key").alias("first_key"))
    )
    own = f"_{uuid.uuid4().hex}"
    # at most ``count`` rows
    numbers = number_by_size(groups, "cluster", "size", "first_key").withColumnsRenamed(
        {"cluster": own, "topic": f"{own}_topic"}
    )
    named = placed(ready, vector, own).join(F.broadcast(numbers), own, "left")
    topic = F.coalesce(f"{own}_topic", F.lit(NOISE).cast("bigint")).alias("topic")
    return named.select(*columns, topic)


def topic_centroids(df: DataFrame, topic: str, vector: str) -> DataFrame:
    """``topic, centroid``: mean vector of each topic's rows, summed as they are read."""
    as_double = F.transform(vector, lambda x: x.cast("double"))
    mean = vector_to_array(Summarizer.mean(array_to_vector(as_double)))
    return df.filter(F.col(topic).isNotNull()).groupBy(topic).agg(mean.alias("centroid"))


class Nearest:
    """Centroids in blocks about pivots, searched with bounds from the triangle inequality on angles.

    A block holds centroids whose angles to their nearest pivot are alike. A row whose angle to that
    pivot differs from theirs by a gap is at least that gap away from all of them, so a block whose
    least angle cannot better what the row has already is not compared with it.
    """

    def __init__(self, ids: np.ndarray, centroids: np.ndarray, pivots: np.ndarray, block: int):
        """Centroids and pivots have length 1."""
        closeness = np.clip(centroids @ pivots.T, -1, 1)
        pivot = closeness.argmax(axis=1)
        angle = np.arccos(closeness[np.arange(len(pivot)), pivot])
        order = np.lexsort((angle, pivot))
        cuts = np.flatnonzero(np.diff(pivot[order])) + 1
        self.pivots, self.blocks = pivots, []
        for part in np.split(order, cuts):
            for at in range(0, len(part), block):
                some = part[at : at + block]
                low, high = float(angle[some].min()), float(angle[some].max())
                by_id = some[np.argsort(ids[some])]  # the first of equals has the smallest id
                self.blocks.append((int(pivot[some[0]]), low, high, ids[by_id], centroids[by_id]))

    def find(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Best id and closeness (9 digits) of each row of length 1, and the comparisons made."""
        angles = np.arccos(np.clip(rows @ self.pivots.T, -1, 1))
        pivot, low, high = (np.array(x) for x in list(zip(*self.blocks, strict=True))[:3])
        gap = np.maximum(0, np.maximum(angles[:, pivot] - high, low - angles[:, pivot]))
        bound = np.cos(np.minimum(gap, np.pi))
        best = np.full(len(rows), -np.inf)
        found = np.zeros(len(rows), np.int64)
        compared = 0

        def look(number: int, at: np.ndarray) -> None:
            nonlocal compared
            _, _, _, ids, centroids = self.blocks[number]
            scores = np.round(rows[at] @ centroids.T, 9)
            first = scores.argmax(axis=1)
            score, name = scores[np.arange(len(at)), first], ids[first]
            better = (score > best[at]) | ((score == best[at]) & (name < found[at]))
            best[at[better]], found[at[better]] = score[better], name[better]
            compared += scores.size

        likely = bound.argmax(axis=1)
        for number in range(len(self.blocks)):
            at = np.flatnonzero(likely == number)
            if len(at):
                look(number, at)
        for number in range(len(self.blocks)):
            # rounding may lift a score by half of the ninth digit
            at = np.flatnonzero((likely != number) & (bound[:, number] >= best - 1e-8))
            if len(at):
                look(number, at)
        return found, best, compared


def assign_topics(
    df: DataFrame,
    centroids: DataFrame,
    key: str,
    vector: str,
    topic: str = "topic",
    threshold: float = 0.0,
    chunk: int = 512,
) -> DataFrame:
    """``key, topic, closeness``: the most alike centroid by cosine, ties to the smaller
    id; -1 where even that is under ``threshold``.

    Centroids are rows, grouped into blocks of ``chunk`` about ``PIVOTS`` of them, and a row is
    compared only with blocks that can hold a better one. Up to ``MOST_CENTRE_NUMBERS`` numbers of
    centroids are sent along at once and the rows are read in place. More go in several passes over
    the rows, of which each row keeps the best. A row without direction, or of another length than
    the centroids have, is -1 without closeness. Runs the centroids.
    """
    spark = df.sparkSession
    length = norm("c")
    known = written(
        centroids.select(F.col(topic).cast("bigint").alias("t"), F.col("centroid").cast("array<double>").alias("c"))
        .filter(F.col("t").isNotNull() & (length > 0) & ~F.isnan(length))
        .withColumn("h", F.xxhash64("t", "c")),
        "centroids",
    )
    sizes = known.agg(F.count("*").alias("n"), F.max(F.size("c")).alias("dims")).first()
    dims = sizes.dims or 0
    passes = max(1, -(-sizes.n * dims // MOST_CENTRE_NUMBERS))
    pivots = np.array([r.c for r in known.orderBy("h").limit(PIVOTS).collect()], float).reshape(-1, dims or 1)
    pivots /= np.sqrt((pivots * pivots).sum(axis=1, keepdims=True))
    given = F.col(vector).cast("array<double>")
    usable = (F.size("v") == dims) & (norm("v") > 0) & ~F.isnan(norm("v"))
    rows = df.select(F.col(key).alias("key"), given.alias("v"))
    rows = rows.select("key", F.coalesce(usable, F.lit(False)).alias("ok"), "v")
    if passes > 1:
        rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    carried = [c for c in rows.columns if c not in ("ok", "v")]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carried)

    def one_pass(number: int) -> DataFrame:
        part = known.filter(F.pmod("h", F.lit(passes)) == number).select("t", "c").toArrow()
        index = None
        if part.num_rows:
            vectors = part.column("c").combine_chunks().flatten().to_numpy().reshape(-1, dims)
            vectors = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
            index = Nearest(part.column("t").to_numpy(), vectors, pivots, chunk)
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    some = batch.slice(at, 2048)
                    topics, best = np.zeros(some.num_rows, np.int64), np.full(some.num_rows, np.nan)
                    ok = some.column("ok").to_numpy(zero_copy_only=False).astype(bool)
                    if shared.value is not None and ok.any():
                        units = _unit_rows(some.filter(some.column("ok")), "v")
                        topics[ok], best[ok], _ = shared.value.find(units)
                    yield pa.record_batch(
                        [
                            *(some.column(c) for c in carried),
                            pa.array(topics, mask=np.isnan(best)),
                            pa.array(best, mask=np.isnan(best)),
                        ],
                        names=[*carried, "t", "s"],
                    )

        return rows.mapInArrow(run, f"{schema}, t bigint, s double")

    found = one_pass(0)
    if passes > 1:
        for number in range(1, passes):
            found = found.unionByName(one_pass(number))
        best = F.max_by(F.struct("t", "s"), F.when(F.col("s").isNotNull(), F.struct("s", -F.col("t"))))
        found = found.groupBy("row", "key").agg(best.alias("b")).select("key", "b.t", "b.s")
    near = F.col("s") >= threshold
    return found.select(
        F.col("key").alias(key),
        F.when(near, F.col("t")).otherwise(NOISE).cast("bigint").alias("topic"),
        F.col("s").alias("closeness"),
    )

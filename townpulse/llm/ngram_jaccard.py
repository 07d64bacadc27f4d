"""Exact Jaccard join of shingle sets that skips by the relations between sets.

A document's set holds the hashes (64 bits) of its distinct word shingles. Equal sets are one node.
Two nodes link when their Jaccard similarity is at least 4/5, and every link joins their components.

0. A linked set shares at least 4/5 of its shingles with one other set. In a fixed part of the hash
   space all sets' shingles meet by their hashes, and tasks return how many of a set's stand alone
   there; a set with more of them than a fifth of its size is in no link and goes no further. The
   others are written as hashes, so later steps read no text. What is shuffled for this grows with
   the corpus alone, whatever the number of different shingles.
1. Shingles that stand alone among those sets come first in the order of a set's shingles (a bitmap of
   fixed size tells them from most others), repeated ones next, and frequent ones, counted in each
   task, last; the rest of the order is by hash. Any one order gives exact results; this one leaves
   hardly an entry of sets that have no near copy.
2. Linked sets share a shingle among the first fifth of each. A bitmap of fixed size marks shingles
   that stand in that prefix of two different sets; the places of the marked shingles are the entries
   of the index lists.
3. Blocks by size and place: a shingle at place p of a set of size n leaves n - p shingles. For each
   block of partner sizes an entry is used only if that is enough, so whole blocks of a list are
   skipped, and sets that no block needs go no further. Only the others are fetched whole.
4. Answers of similar sets: in every list all sets are compared with one leader, a different one for
   each list and round. Sets that link are one component, and further pairs inside it are never formed.
   From the overlaps of two sets with one leader, bounds of their own overlap follow: many pairs are
   settled by them alone. What remains between different components is compared on the whole sets:
   in lists with many components inside a task, where a link found makes two components one at once.

Defined cases: a null or empty text has an empty set and no links; its component is its own id. Texts
of fewer words than a shingle have one shingle, all their words. Equal rows are each returned. A null
id is no component id; a component of null ids only has a null one. An empty table gives no rows.
Extra columns are not read. Sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townpulse.llm.common import bits_of, components, give_back, has_bit, join_sized, kept, repeated_bits
from townpulse.llm.words import BLANKS, LOWER, gram_hashes, row_slices, split_words
from townpulse.scale import settle

# Shingles sent to every task as frequent ones, at most; how often a task must meet one to report it,
# and how many shingles a task looks at together. They change the order in a set, never a result.
FREQUENT = 1 << 17
FREQUENT_IN_TASK = 4
TOGETHER = 1 << 21
# Bits of the bitmap of repeated shingles, and of a piece of it that is filled at one place.
REPEATED_BITS = 27
FILL_BITS = 20
# Hashes are cut by their first bits into ranges; lone shingles are counted in the first so many of them.
RANGE_BITS = 10
COUNTED_RANGES = 384
# Sets that are sent together for that, at most.
CHUNK_SETS = 8192
# Rounds of comparisons with leaders before the remaining pairs are formed.
LEADER_ROUNDS = 3
# A list with more components than this after the leaders is compared inside a task, where its sets are
# brought, with at most about so many entries at once; pairs of shorter lists are formed one by one.
LONG_LIST = 32
LIST_ROWS = 256
# Columns of a piece of the table of a list's sets.
COLUMNS = 4096
# A block holds sizes up to this factor apart.
BLOCK_STEP = 1.05


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    found = split_words(texts, BLANKS, LOWER)
    grams = gram_hashes(found.hashes, words)
    out = []
    for lo, hi in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
        if hi - lo >= words:
            part = np.sort(grams[lo : hi - words + 1])
            out.append(part[np.append(True, part[1:] != part[:-1])])
        else:
            out.append(gram_hashes(found.hashes[lo:hi], hi - lo) if hi > lo else grams[:0])
    return out


def sets_in(column: pa.Array, words: int | None) -> list[np.ndarray]:
    """The sets of texts, or with ``words`` None those whose hashes the column holds."""
    if words is not None:
        return shingle_sets(column, words)
    return [np.frombuffer(whole, np.uint64) for whole in column.to_pylist()]


def packed(numbers: np.ndarray) -> bytes:
    """Numbers, none below zero, in the fewest bytes that hold the largest, compressed."""
    numbers = numbers.astype(np.min_scalar_type(int(numbers.max(initial=0))))
    return bytes([numbers.itemsize]) + zlib.compress(numbers.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"u{data[0]}").astype(np.int64)


def sets_that_may_link(docs: DataFrame, text: str, words: int) -> DataFrame:
    """Numbers of all sets but those of whose shingles more than a fifth are seen to stand alone.

    Chunks of sets, named by their nodes, send the hashes of each range to one place, and get back how
    many of each set's hashes no other set has. Sets of one chunk are different ones; equal sets of
    several chunks are each other's repetition, so they stay.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        waiting: dict[bytes, np.ndarray] = {}
        size = 0
        end = np.uint64(COUNTED_RANGES << (64 - RANGE_BITS))

        def flush() -> pa.RecordBatch:
            sets, numbers = list(waiting.values()), b"".join(node[:8] for node in waiting)
            heads = [one[: np.searchsorted(one, end)] for one in sets]
            owner = np.repeat(np.arange(len(sets)), [len(head) for head in heads])
            heads = np.concatenate(heads)
            place = (heads >> np.uint64(64 - RANGE_BITS)).astype(np.int16)
            each = np.bincount(owner * COUNTED_RANGES + place, minlength=len(sets) * COUNTED_RANGES)
            each = each.reshape(-1, COUNTED_RANGES).T
            # by range, then by set
            codes = (heads >> np.uint64(32 - RANGE_BITS)).astype(np.uint32)[np.argsort(place, kind="stable")]
            ends = np.cumsum(each.sum(axis=1)).tolist()
            chunk = xxhash.xxh3_64_intdigest(b"".join(waiting)) - (1 << 63)
            own = [None] * COUNTED_RANGES
            most = list(own)
            own[chunk % COUNTED_RANGES] = numbers
            most[chunk % COUNTED_RANGES] = packed(np.array([len(one) // 5 for one in sets]))
            return pa.record_batch(
                [
                    pa.array(np.arange(COUNTED_RANGES, dtype=np.int32)),
                    pa.array(np.full(COUNTED_RANGES, chunk)),
                    pa.array([codes[a:b].tobytes() for a, b in zip([0, *ends], ends)], pa.binary()),
                    pa.array([packed(n) for n in each], pa.binary()),
                    pa.array(own, pa.binary()),
                    pa.array(most, pa.binary()),
                ],
                names=["range", "chunk", "codes", "each", "numbers", "most"],
            )

        for batch in batches:
            for part in row_slices(batch, 0):
                for one in shingle_sets(part.column(0), words):
                    if len(one) and (node := node_of(one)) not in waiting:
                        waiting[node] = one
                        size += len(one)
                    if len(waiting) == CHUNK_SETS:
                        yield flush()
                        waiting, size = {}, 0
                if size >= TOGETHER:
                    yield flush()
                    waiting, size = {}, 0
        if waiting:
            yield flush()

    def count_lone(table: pa.Table) -> pa.Table:
        codes = np.concatenate([np.frombuffer(c, np.uint32) for c in table.column("codes").to_pylist()])
        order = np.argsort(codes)
        codes = codes[order]
        differs = np.concatenate([[True], codes[1:] != codes[:-1], [True]])
        lone = np.zeros(len(order) + 1, np.int64)
        lone[order + 1] = differs[1:] & differs[:-1]
        upto = np.cumsum(lone)
        at, counts = 0, []
        for each in map(unpacked, table.column("each").to_pylist()):
            ends = at + np.cumsum(each)
            counts.append(packed(upto[ends] - upto[ends - each]))
            at = int(ends[-1])
        return pa.table(
            {"chunk": table.column("chunk"), "lone": pa.array(counts, pa.binary())}
            | {c: table.column(c) for c in ("numbers", "most")}
        )

    def left(table: pa.Table) -> pa.Table:
        lone = sum(map(unpacked, table.column("lone").to_pylist()))
        numbers = next(n for n in table.column("numbers").to_pylist() if n is not None)
        most = next(n for n in table.column("most").to_pylist() if n is not None)
        return pa.table({"number": pa.array(np.frombuffer(numbers, np.int64)[lone <= unpacked(most)])})

    return (
        docs.select(text)
        .mapInArrow(
            send, "range int, chunk bigint, codes binary, each binary, numbers binary, most binary"
        )
        .groupBy("range")
        .applyInArrow(count_lone, "chunk bigint, lone binary, numbers binary, most binary")
        .groupBy("chunk")
        .applyInArrow(left, "number bigint")
    )


def set_rows(docs: DataFrame, key: str, text: str, words: int, likely) -> DataFrame:
    """key, size, node and its number for bitmaps, of every row, and ``whole``, the hashes of sets whose
    number is in a bitmap, at one row of equal ones that a task meets."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in batches:
            for part in row_slices(batch, 1):
                sets = shingle_sets(part.column(1), words)
                nodes = [node_of(one) if len(one) else None for one in sets]
                numbers = np.frombuffer(b"".join(n[:8] if n else bytes(8) for n in nodes), np.uint64)
                wholes = []
                for one, node, may in zip(sets, nodes, has_bit(likely.value, numbers).tolist(), strict=True):
                    first = may and node is not None and node not in met
                    wholes.append(one.tobytes() if first else None)
                    if first:
                        met.add(node)
                yield pa.record_batch(
                    [
                        part.column(0),
                        pa.array([len(one) for one in sets], pa.int64()),
                        pa.array(nodes, pa.binary()),
                        pa.array(numbers.view(np.int64)),
                        pa.array(wholes, pa.binary()),
                    ],
                    names=[key, "size", "node", "number", "whole"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        emit, f"{key} {kind}, size bigint, node binary, number bigint, whole binary"
    )


def frequent_shingles(docs: DataFrame, text: str, words: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and the logarithms of their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def flush() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(waiting), return_counts=True)
            often = n >= FREQUENT_IN_TASK
            return pa.record_batch(
                [pa.array(values[often].view(np.int64)), pa.array(n[often])], names=["shingle", "n"]
            )

        for batch in batches:
            for part in row_slices(batch, 0):
                for one in sets_in(part.column(0), words):
                    waiting.append(one)
                    size += len(one)
                if size >= TOGETHER:
                    yield flush()
                    waiting, size = [], 0
        if waiting:
            yield flush()

    rows = (
        docs.select(text)
        .mapInArrow(count, "shingle bigint, n bigint")
        .groupBy("shingle")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "shingle")
        .limit(FREQUENT)
        .toArrow()  # two arrays in the driver, no object for each row
    )
    values, counts = (np.array(rows.column(c), np.int64) for c in ("shingle", "n"))
    values = values.view(np.uint64)
    order = np.argsort(values)
    return values[order], np.log2(counts[order]).astype(np.int8)


def repeated_shingles(docs: DataFrame, text: str, words: int | None) -> np.ndarray:
    """A bitmap of the shingles met more than once, among them a part of those met once.

    Tasks send the low bits of their shingles sorted and packed, piece by piece; the counters of a
    piece have a fixed size.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        edges = np.arange((1 << (REPEATED_BITS - FILL_BITS)) + 1) << FILL_BITS

        def flush() -> pa.RecordBatch:
            low = np.concatenate(waiting) & np.uint64((1 << REPEATED_BITS) - 1)
            low = np.sort(low.astype(np.uint32))
            cuts = np.searchsorted(low, edges)
            packed = [
                zlib.compress(np.diff(low[a:b], prepend=np.uint32(edge)).tobytes(), 1)
                for edge, a, b in zip(edges[:-1].tolist(), cuts[:-1], cuts[1:], strict=True)
            ]
            pieces = pa.array(np.arange(len(packed), dtype=np.int32))
            return pa.record_batch([pieces, pa.array(packed, pa.binary())], names=["piece", "codes"])

        for batch in batches:
            for part in row_slices(batch, 0):
                for one in sets_in(part.column(0), words):
                    waiting.append(one)
                    size += len(one)
                if size >= TOGETHER:
                    yield flush()
                    waiting, size = [], 0
        if waiting:
            yield flush()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = np.cumsum(np.frombuffer(zlib.decompress(codes), np.uint32), dtype=np.uint32)
                at, n = np.unique(at, return_counts=True)
                counts = met.setdefault(piece, np.zeros(1 << FILL_BITS, np.uint8))
                counts[at] = np.minimum(2, counts[at] + n)
        bits = [np.packbits(c > 1, bitorder="little").tobytes() for c in met.values()]
        yield pa.record_batch(
            [pa.array(list(met), pa.int32()), pa.array(bits, pa.binary())], names=["piece", "bits"]
        )

    pieces = (
        docs.select(text)
        .mapInArrow(pack, "piece int, codes binary")
        .repartition("piece")
        .mapInArrow(fill, "piece int, bits binary")
        .collect()
    )
    out = np.zeros((1 << REPEATED_BITS) >> 3, np.uint8)
    size = (1 << FILL_BITS) >> 3
    for row in pieces:
        out[row.piece * size : (row.piece + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return out


def ordered(one: np.ndarray, order: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """A set's shingles: those met once first, frequent ones last."""
    values, ranks, repeated = order
    if not len(one):
        return one
    rank = has_bit(repeated, one).astype(np.int8)
    if len(values):
        at = np.minimum(np.searchsorted(values, one), len(values) - 1)
        rank = np.where(values[at] == one, ranks[at] + 1, rank)
    return one[np.argsort(rank, kind="stable")]


def prefix_length(size: int) -> int:
    """A set needs 4/5 of its shingles in common, so one of the first n - ceil(4n/5) + 1 is among them."""
    return size - (4 * size + 4) // 5 + 1 if size else 0


def node_of(one: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(one.tobytes())


def prefix_shingles(sets: DataFrame, shared) -> DataFrame:
    """(shingle, node as a number) of all prefixes, without shingles that stand alone."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, 1):
                heads = [ordered(s, shared.value)[: prefix_length(len(s))] for s in sets_in(part.column(1), None)]
                # what stands alone is in no second set
                heads = [h[has_bit(shared.value[2], h)] for h in heads]
                tokens = np.concatenate(heads) if heads else np.zeros(0, np.uint64)
                yield pa.record_batch(
                    [
                        pa.array(tokens.view(np.int64)),
                        pa.array(np.repeat(part.column(0).to_numpy(), [len(h) for h in heads])),
                    ],
                    names=["shingle", "node"],
                )

    return sets.select("number", "whole").mapInArrow(emit, "shingle bigint, node bigint")


def indexed_sets(sets: DataFrame, shared, marked) -> DataFrame:
    """node, number, size, and the marked shingles of its prefix with their places."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, 3):
                tokens, places = [], []
                for one in sets_in(part.column(3), None):
                    head = ordered(one, shared.value)[: prefix_length(len(one))]
                    at = np.flatnonzero(has_bit(marked.value, head))
                    tokens.append(head[at].view(np.int64))
                    places.append(at.astype(np.int32))
                yield pa.record_batch(
                    [
                        *part.columns[:3],
                        pa.array(tokens, pa.list_(pa.int64())),
                        pa.array(places, pa.list_(pa.int32())),
                    ],
                    names=["node", "number", "size", "shingles", "places"],
                )

    return sets.select("node", "number", "size", "whole").mapInArrow(
        emit, "node binary, number bigint, size bigint, shingles array<bigint>, places array<int>"
    )


def whole_sets(sets: DataFrame, wanted, needed: DataFrame) -> DataFrame:
    """(node, size, whole) of the needed sets, whose numbers are in a bitmap; ``whole`` holds the hashes,
    ``node`` the id that ``needed`` gives."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(3).to_numpy().view(np.uint64)
            yield batch.filter(pa.array(has_bit(wanted.value, numbers))).select(["node", "size", "whole"])

    chosen = sets.select("node", "size", "whole", "number").mapInArrow(
        choose, "node binary, size bigint, whole binary"
    )
    return (
        join_sized(chosen, needed, "node", "inner")
        .groupBy("id")
        .agg(F.first("size").alias("size"), F.first("whole").alias("whole"))
        .withColumnRenamed("id", "node")
    )


def least_overlap(a: Column, b: Column) -> Column:
    """The smallest overlap with which sets of these sizes link: 100 i >= 80 (a + b - i)."""
    return F.ceil((a + b) * 4 / 9.0).cast("bigint")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, overlap) of pairs of nodes, counted on the whole sets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            n = [
                len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), True))
                for x, y in zip(left, right, strict=True)
            ]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["a", "b", "overlap"]
            )

    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = join_sized(sets, needed, "node", "left_semi")
    left = sets.select(F.col("node").alias("a"), F.col("whole").alias("whole_a"))
    right = sets.select(F.col("node").alias("b"), F.col("whole").alias("whole_b"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select("a", "b", "whole_a", "whole_b")
        .mapInArrow(count, "a bigint, b bigint, overlap bigint")
    )


def may_link(a: str, b: str) -> Column:
    """Whether list entries leave room for a link: by their sizes, and by what follows their places."""
    size_a, size_b = F.col(f"{a}size"), F.col(f"{b}size")
    room = F.least(size_a - F.col(f"{a}place"), size_b - F.col(f"{b}place"))
    return (
        (size_a * 5 >= size_b * 4) & (size_b * 5 >= size_a * 4) & (room >= least_overlap(size_a, size_b))
    )


def with_component(entries: DataFrame, links: DataFrame | None) -> DataFrame:
    """List entries with their component, only of lists with two components at least."""
    if links is None:
        entries = entries.withColumn("part", F.col("node"))
    else:
        entries = entries.join(components(links), "node", "left").withColumn(
            "part", F.coalesce("root", "node")
        ).drop("root")
    mixed = (
        entries.groupBy("shingle")
        .agg(F.min("part").alias("low"), F.max("part").alias("high"))
        .where("low < high")
        .select("shingle")
    )
    return entries.join(mixed, "shingle", "left_semi")


def compare_with_leaders(
    entries: DataFrame, sets: DataFrame, turn: int, known: DataFrame | None
) -> tuple[DataFrame, DataFrame]:
    """Entries with the overlap of their set and the list's leader, and all overlaps known by then."""
    leader = F.min(
        F.struct(F.xxhash64("node", "shingle", F.lit(turn)).alias("h"), "node", "size", "place", "part")
    )
    leaders = entries.groupBy("shingle").agg(leader.alias("l")).select("shingle", "l.*")
    led = entries.select("shingle", "node", "size", "place", "part").join(
        leaders.toDF("shingle", "h", "leader", "leader_size", "leader_place", "leader_part"), "shingle"
    )
    led = settle(led.withColumns({"a": F.least("node", "leader"), "b": F.greatest("node", "leader")}))
    pairs = (
        led.where((F.col("part") != F.col("leader_part")) & may_link("", "leader_"))
        .select("a", "b")
        .distinct()
    )
    if known is not None:
        pairs = pairs.join(known, ["a", "b"], "left_anti")
    counted = kept(overlaps(settle(pairs), sets), "leader-overlaps")
    known = counted if known is None else known.unionByName(counted)
    led = led.join(known, ["a", "b"], "left").withColumn(
        "overlap", F.when(F.col("node") == F.col("leader"), F.col("size")).otherwise(F.col("overlap"))
    )
    return led, known


def linked(known: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose overlap is enough for a link."""
    sizes = sets.select("node", "size")
    return (
        known.join(sizes.toDF("a", "size_a"), "a")
        .join(sizes.toDF("b", "size_b"), "b")
        .where(F.col("overlap") >= least_overlap(F.col("size_a"), F.col("size_b")))
        .select("a", "b")
    )


def block_of(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) / F.log(F.lit(BLOCK_STEP))).cast("int")


def in_blocks(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries as the smaller set of a pair, in the block of their size, and as the larger, in the
    blocks of all partner sizes for which their place leaves enough."""
    room = F.col("size") - F.col("place")
    smaller = entries.where(room >= least_overlap(F.col("size"), F.col("size"))).withColumn(
        "block", block_of(F.col("size"))
    )
    from_size = F.ceil(F.col("size") * 0.8 - 1e-9).cast("bigint")

    def enough(block: Column) -> Column:
        first = F.floor(F.pow(F.lit(BLOCK_STEP), block) - 1e-6).cast("bigint")
        return room >= least_overlap(F.col("size"), F.greatest(from_size, first))

    blocks = F.filter(F.sequence(block_of(from_size), block_of(F.col("size"))), enough)
    return smaller, entries.withColumn("block", F.explode(blocks))


def needed_entries(entries: DataFrame) -> DataFrame:
    """Entries of sets that share a block of some list with another set.

    Most lists have two entries: whether those may link follows from sums and bounds of the list, and
    only longer lists are cut into blocks.
    """
    size, room = F.col("size"), F.col("size") - F.col("place")
    lists = (
        entries.groupBy("shingle")
        .agg(
            F.count("*").alias("n"),
            F.min(size).alias("low"),
            F.max(size).alias("high"),
            F.sum(size).alias("sum"),
            F.min(room).alias("room"),
        )
        .where("n > 1")
        .where(
            (F.col("n") > 2)
            | ((F.col("low") * 5 >= F.col("high") * 4) & (F.col("room") >= least_overlap(F.col("sum"), F.lit(0))))
        )
        .select("shingle", "n")
    )
    near = kept(entries.join(lists.hint("merge"), "shingle"), "near-entries")
    smaller, larger = in_blocks(near.where("n > 2"))
    met = smaller.select("shingle", "block", "node", F.lit(1).alias("smaller")).unionByName(
        larger.select("shingle", "block", "node", F.lit(0).alias("smaller"))
    )
    shared = (
        met.groupBy("shingle", "block")
        .agg(F.min("node").alias("low"), F.max("node").alias("high"), F.max("smaller").alias("any"))
        .where("low < high AND any = 1")
        .select("shingle", "block")
    )
    nodes = (
        near.where("n = 2").select("node")
        .unionByName(met.join(shared, ["shingle", "block"], "left_semi").select("node"))
        .distinct()
    )
    return near.drop("n").join(nodes, "node", "left_semi")


def remaining_pairs(entries: DataFrame) -> DataFrame:
    """Pairs of entries between different components, with what their leader tells of them.

    A pair is met in the size block of its smaller set. ``settled`` says whether the bounds from the
    leader link it without a look at the sets; pairs that they rule out are left out.
    """
    biggest = (
        entries.groupBy("shingle", "part").count()
        .groupBy("shingle").agg(F.max(F.struct("count", "part"))["part"].alias("main"))
    )
    entries = entries.join(biggest, "shingle").withColumn("in_main", F.col("part") == F.col("main"))
    names = ["shingle", "node", "size", "place", "part", "in_main", "overlap", "leader_size"]
    smaller, larger = in_blocks(settle(entries.select(*names)))
    x = [F.col(c).alias(f"x_{c}") for c in names[1:]]
    y = [F.col(c).alias(f"y_{c}") for c in names[1:]]

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        order = (F.col("x_size") < F.col("y_size")) | (
            (F.col("x_size") == F.col("y_size")) & (F.col("x_node") < F.col("y_node"))
        )
        return left.select("shingle", "block", *x).join(
            right.select("shingle", "block", *y), ["shingle", "block"]
        ).where((F.col("x_part") != F.col("y_part")) & order & may_link("x_", "y_"))

    # The main component of a list meets the others only, never itself.
    pairs = met(smaller.where(~F.col("in_main")), larger).unionByName(
        met(smaller.where("in_main"), larger.where(~F.col("in_main")))
    )
    need = least_overlap(F.col("x_size"), F.col("y_size"))
    with_x, with_y = F.col("x_overlap"), F.col("y_overlap")
    most = F.least(with_x, with_y) + F.least(F.col("x_size") - with_x, F.col("y_size") - with_y)
    return (
        pairs.where(most.isNull() | (most >= need))
        .select(
            F.least("x_node", "y_node").alias("a"),
            F.greatest("x_node", "y_node").alias("b"),
            F.coalesce(with_x + with_y - F.col("x_leader_size") >= need, F.lit(False)).alias("settled"),
            need.alias("need"),
        )
        .groupBy("a", "b", "need")
        .agg(F.max("settled").alias("settled"))
    )


def overlap_table(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles every two sets have in common, by products of bounded pieces of their columns."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = count[code] > 1
    owner, code = owner[several], (np.cumsum(count > 1) - 1)[code[several]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    out = np.zeros((n, n), np.float32)
    for at in range(0, int((count > 1).sum()), COLUMNS):
        lo, hi = np.searchsorted(code, (at, at + COLUMNS))
        piece = np.zeros((n, COLUMNS), np.float32)
        piece[owner[lo:hi], code[lo:hi] - at] = 1
        out += piece @ piece.T
    return out


def linked_in_list(
    sizes: np.ndarray, rooms: np.ndarray, parts: np.ndarray, sides: np.ndarray, sets: list[np.ndarray]
) -> list[tuple[int, int]]:
    """Places of entries of one list whose sets link, as far as they join different components.

    ``parts`` are numbers of components; a link makes two components one. Where ``sides`` holds two
    values only entries of different ones meet.
    """
    parts, out, across = parts.copy(), [], len(np.unique(sides)) > 1
    need = -(-(sizes[:, None] + sizes) * 4 // 9)
    may = (parts[:, None] != parts) & (np.minimum(rooms[:, None], rooms) >= need)
    if across:
        may &= sides[:, None] != sides
    links = np.triu(may & (overlap_table(sets) >= need), 1)
    for i, j in zip(*(x.tolist() for x in np.nonzero(links)), strict=True):
        if parts[i] != parts[j]:
            out.append((i, j))
            parts[parts == parts[j]] = parts[i]
    return out


def links_of_long_lists(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) that join the components met in lists, by whole sets brought to the list once.

    A list of more than ``LIST_ROWS`` entries is dealt to parts, every two of which meet in one group,
    so a group has at most about twice as many rows. Only links come out, never pairs.
    """
    lists = entries.groupBy("shingle").agg(F.ceil(F.count("*") / LIST_ROWS).cast("int").alias("sides"))
    sided = entries.join(lists, "shingle").withColumn("side", F.pmod(F.xxhash64("node"), "sides").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("sides") - 1))
    met = (
        sided.withColumn("other", other)
        # a part meets itself only where it is the only one, or with the part after it
        .where((F.col("sides") == 1) | (F.col("other") != F.col("side")))
        .select(
            "shingle", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"),
            "node", "size", "place", "part", "side", "sides",
        )
    )

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "ascending"), ("node", "ascending")]).combine_chunks()
        sizes, places, sides = (table.column(c).to_numpy() for c in ("size", "place", "side"))
        parts = table.column("part").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        whole = [np.frombuffer(w, np.uint64) for w in table.column("whole").to_pylist()]
        nodes = table.column("node").to_pylist()
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        # each part is compared with itself once, in the group with its neighbour
        own = [lo] if hi == lo + 1 else []
        own += [hi] if hi == lo + 1 and hi == table.column("sides")[0].as_py() - 1 else []
        found = linked_in_list(sizes, sizes - places, parts, sides, whole)
        for side in own:
            at = np.flatnonzero(sides == side)
            inside = linked_in_list(
                sizes[at], (sizes - places)[at], parts[at], sides[at], [whole[n] for n in at.tolist()]
            )
            found += [(int(at[x]), int(at[y])) for x, y in inside]
        pairs = [sorted((nodes[x], nodes[y])) for x, y in found]
        return pa.table({c: pa.array([p[i] for p in pairs], pa.int64()) for i, c in enumerate("ab")})

    needed = entries.select("node").distinct()
    near = join_sized(sets.select("node", "whole"), needed, "node", "left_semi")
    return (
        met.join(near.hint("merge"), "node")
        .groupBy("shingle", "lo", "hi")
        .applyInArrow(compare, "a bigint, b bigint")
        .distinct()
    )


def join_sets(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5
) -> DataFrame:
    """``key``, n_shingles and component_id (the least key that links reach) of every row."""
    context = docs.sparkSession.sparkContext
    likely = context.broadcast(bits_of(sets_that_may_link(docs, text, words), "number"))
    rows = kept(set_rows(docs, key, text, words, likely), "sets")
    # each goes as soon as what reads it is written; later stages need the memory
    likely.destroy()
    sets = rows.where("whole IS NOT NULL")
    order = context.broadcast(
        (*frequent_shingles(sets, "whole", None), repeated_shingles(sets, "whole", None))
    )
    marked = context.broadcast(repeated_bits(prefix_shingles(sets, order), "shingle", "node"))
    nodes = kept(
        indexed_sets(sets, order, marked)
        .where(F.size("shingles") > 0)
        .groupBy("node")
        .agg(
            F.first("number").alias("number"),
            F.first("size").alias("size"),
            F.first(F.arrays_zip("shingles", "places")).alias("entries"),
        )
        .withColumn("id", F.monotonically_increasing_id()),
        "nodes",
    )
    for shared in (order, marked):
        shared.destroy()
    # from here to the components a set goes by a number of its own, half as wide as its node
    entries = nodes.select(F.col("id").alias("node"), "size", F.inline("entries")).withColumnsRenamed(
        {"shingles": "shingle", "places": "place"}
    )
    entries = kept(needed_entries(entries), "entries")
    names = nodes.select("id", "node", "number")
    needed = settle(join_sized(names, entries.select(F.col("node").alias("id")).distinct(), "id", "left_semi"))
    wanted = context.broadcast(bits_of(needed, "number"))
    sets = kept(whole_sets(sets, wanted, needed.select("node", "id")), "wholes")
    wanted.destroy()
    give_back()
    links = known = None
    for turn in range(LEADER_ROUNDS):
        mixed = settle(with_component(entries.select("shingle", "node", "size", "place"), links))
        led, known = compare_with_leaders(mixed, sets, turn, known)
        links = settle(linked(known, sets))
    now = with_component(
        led.select("shingle", "node", "size", "place", "overlap", "leader_size"), links
    )
    now = settle(now)
    long = settle(
        now.groupBy("shingle").agg(F.countDistinct("part").alias("parts"))
        .where(F.col("parts") > LONG_LIST).select("shingle")
    )
    links = links.unionByName(
        links_of_long_lists(join_sized(now, long, "shingle", "left_semi"), sets)
    )
    short = join_sized(now, long, "shingle", "left_anti")
    pairs = kept(remaining_pairs(short).join(known, ["a", "b"], "left_anti"), "remaining-pairs")
    unsure = pairs.where(~F.col("settled"))
    verified = (
        overlaps(unsure.select("a", "b"), sets)
        .join(unsure.select("a", "b", "need"), ["a", "b"])
        .where("overlap >= need")
    )
    links = links.unionByName(pairs.where("settled").select("a", "b")).unionByName(
        verified.select("a", "b")
    )
    parts = components(settle(links))
    for side in ("node", "root"):
        named = names.select(F.col("id").alias(side), F.col("node").alias("name"))
        parts = parts.join(named, side).drop(side).withColumnRenamed("name", side)
    members = rows.select(key, "size", "node").join(parts, "node", "left").withColumn(
        "part", F.coalesce("root", "node")
    )
    least = members.where("part IS NOT NULL").groupBy("part").agg(F.min(key).alias("least"))
    return members.join(least, "part", "left").select(
        key,
        F.col("size").alias("n_shingles"),
        F.when(F.col("part").isNull(), F.col(key)).otherwise(F.col("least")).alias("component_id"),
    )


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5) -> DataFrame:
    """One row of each group of rows that links connect: that with the least key. All columns are kept.

    Rows are told apart by key and text, so a key that repeats with another text loses only the linked
    row; among rows of the least key a hash decides. Rows with a null key have no smaller key: of those in
    a group one stays besides the one with a key. Of rows that repeat key and text one stays. Rows without
    words link with nothing; with a null key they all stay.
    """
    own, number = "_own", F.xxhash64(key, text)
    owner = F.struct(F.col(key).isNull().alias("lost"), F.col(key).alias("id"), number.alias("number"))
    joined = join_sets(docs.select(owner.alias(own), text), key=own, text=text, words=words)
    # The least owner of a group stands for it: keys go before nulls.
    marked = kept(
        joined.select(
            f"{own}.*",
            F.col("component_id.number").alias("group"),
            (F.col(own) != F.col("component_id")).alias("later"),
            (~F.col(f"{own}.lost") | (F.col("n_shingles") > 0)).alias("once"),
        ).drop("id"),
        "marked",
    )
    lost = marked.where("lost")
    least = settle(lost.groupBy("group").agg(F.min("number").alias("least")))
    gone = (
        marked.where("later AND NOT lost").select("number")
        .unionByName(lost.join(least, "group").where("number > least").select("number"))
        .distinct()
        .withColumnRenamed("number", own)
    )
    again = settle(
        marked.where("once").groupBy("number").count().where("count > 1").select(F.col("number").alias(own))
    )
    left = join_sized(docs.withColumn(own, number), gone, own, "left_anti")
    nth = F.row_number().over(Window.partitionBy(own).orderBy(F.lit(0)))
    single = join_sized(left, again, own, "left_anti")
    several = join_sized(left, again, own, "left_semi").withColumn("_nth", nth).where("_nth = 1")
    return single.unionByName(several.drop("_nth")).drop(own)

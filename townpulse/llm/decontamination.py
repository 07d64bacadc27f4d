"""Benchmark decontamination by greedy string tiling.

Words are runs of ASCII letters and digits and of all other characters, A-Z in lower case. A seed is
the hash of ``seed`` consecutive words. Documents are joined with benchmark items on seeds; for the
pairs that may reach the threshold, tiles are laid: again and again the longest match of words that no
tile covers yet, in the item and in the document, becomes a tile, down to the length of a seed. Tiles
may lie in any order, so passages whose parts changed places are found. A document leaks an item when
tiles cover at least ``least`` of the item's words.

Matches are runs of equal rolling hashes, so only a document's seeds that occur in the benchmark, with
their places, leave the pass over the texts: a bitmap of fixed size filters them there.

Defined cases: null and empty texts match nothing; items with fewer words than a seed cannot match.
Rows that share id and text are
judged and returned once; so are items that share an id. An
empty table gives no rows. Only ids and texts are read.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townpulse.llm.common import bits_of, has_bit, kept
from townpulse.llm.words import LOWER, MARKS, gram_hashes, row_slices, split_words
from townpulse.scale import attach

TILES = "array<struct<item_word:int,doc_word:int,words:int>>"


def tile(item: dict[int, list[int]], places: list[int], seeds: list[int], seed: int) -> list[tuple]:
    """Tiles (word in the item, word in the document, words), longest first.

    ``item`` maps a seed to its places in the item; the document is given by places and seeds.
    """
    runs: list[tuple] = []
    diagonals = defaultdict(list)
    for place, value in zip(places, seeds, strict=True):
        for at in item.get(value, ()):
            diagonals[place - at].append(at)
    for shift, found in diagonals.items():
        found.sort()
        start = end = found[0]
        for at in [*found[1:], None]:
            if at is not None and at == end + 1:
                end = at
                continue
            runs.append((-(end - start + seed), start, start + shift))
            start = end = at
    heapq.heapify(runs)
    in_item, in_doc, tiles = set(), set(), []
    while runs:
        size, at, place = heapq.heappop(runs)
        size = -size
        free = [i for i in range(size) if at + i not in in_item and place + i not in in_doc]
        if len(free) == size:
            tiles.append((at, place, size))
            in_item.update(range(at, at + size))
            in_doc.update(range(place, place + size))
            continue
        # Parts that no tile covers yet wait for their turn by length.
        begin = 0
        for i in range(1, len(free) + 1):
            if i == len(free) or free[i] != free[i - 1] + 1:
                if i - begin >= seed:
                    heapq.heappush(runs, (-(i - begin), at + free[begin], place + free[begin]))
                begin = i
    return tiles


def item_seeds(items: DataFrame, key: str, text: str, seed: int) -> DataFrame:
    """(item, words, seeds in order) of all items with a seed at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = split_words(batch.column(1), MARKS, LOWER)
            grams = gram_hashes(words.hashes, seed).view(np.int64)
            sizes = np.diff(words.first)
            fits = np.flatnonzero(sizes >= seed)
            seeds = [grams[words.first[i] : words.first[i + 1] - seed + 1] for i in fits.tolist()]
            yield pa.record_batch(
                [
                    batch.column(0).take(pa.array(fits)),
                    pa.array(sizes[fits], pa.int64()),
                    pa.array(seeds, pa.list_(pa.int64())),
                ],
                names=["item", "words", "seeds"],
            )

    kind = items.schema[key].dataType.simpleString()
    return items.select(key, text).mapInArrow(run, f"item {kind}, words bigint, seeds array<bigint>")


def document_seeds(docs: DataFrame, key: str, text: str, seed: int, bitmap: np.ndarray) -> DataFrame:
    """(row, key, places, seeds) of documents with seeds whose bits are set."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, 2):
                words = split_words(part.column(2), MARKS, LOWER)
                grams = gram_hashes(words.hashes, seed)
                at = np.flatnonzero(has_bit(shared.value, grams))
                owner = np.searchsorted(words.first, at, "right") - 1
                inside = at + seed <= words.first[owner + 1]
                at, owner = at[inside], owner[inside]
                rows, begin = np.unique(owner, return_index=True)
                edges = pa.array(np.append(begin, len(at)).astype(np.int32))
                source = pa.array(rows)
                yield pa.record_batch(
                    [
                        part.column(0).take(source),
                        part.column(1).take(source),
                        pa.ListArray.from_arrays(edges, pa.array((at - words.first[owner]).astype(np.int32))),
                        pa.ListArray.from_arrays(edges, pa.array(grams[at].view(np.int64))),
                    ],
                    names=["row", key, "places", "seeds"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.xxhash64(key, text).alias("row"), key, text).mapInArrow(
        run, f"row bigint, {key} {kind}, places array<int>, seeds array<bigint>"
    )


def lay_tiles(pairs: DataFrame, key: str, seed: int) -> DataFrame:
    """Tiles of each pair of a document's and an item's seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiles = []
            for places, seeds, item in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
                where = defaultdict(list)
                for at, value in enumerate(item):
                    where[value].append(at)
                tiles.append(
                    [
                        {"item_word": a, "doc_word": d, "words": n}
                        for a, d, n in tile(where, places, seeds, seed)
                    ]
                )
            kind = pa.list_(
                pa.struct([("item_word", pa.int32()), ("doc_word", pa.int32()), ("words", pa.int32())])
            )
            yield pa.record_batch(
                [*batch.columns[:3], pa.array(tiles, kind)], names=[key, "item", "words", "tiles"]
            )

    types = {f.name: f.dataType.simpleString() for f in pairs.schema}
    return pairs.select(key, "item", "words", "places", "doc_seeds", "item_seeds").mapInArrow(
        run, f"{key} {types[key]}, item {types['item']}, words bigint, tiles {TILES}"
    )


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    seed: int = 4,
    least: float = 0.5,
) -> DataFrame:
    """``key``, ``item_key``, coverage, reordered and the tiles of every leak."""
    # Items are told apart by id and text: ids may be null or repeat.
    owner = F.struct(F.col(item_key).alias("id"), F.xxhash64(item_key, item_text).alias("number"))
    named = benchmark.select(owner.alias("item"), item_text)
    items = kept(
        item_seeds(named, "item", item_text, seed).select(
            F.col("item.number").alias("item"), F.col("item.id").alias("_item_id"), "words", "seeds"
        ),
        "items",
    )
    seeds = items.select("item", "words", F.posexplode("seeds").alias("at", "seed"))
    found = kept(document_seeds(docs, key, text, seed, bits_of(seeds, "seed")), "seeds")
    # A tile covers words of shared seeds only, so fewer shared places cannot reach the threshold.
    places = (
        found.select("row", F.explode(F.array_distinct("seeds")).alias("seed"))
        .distinct()
        .join(seeds.hint("merge"), "seed")
        .groupBy("row", "item", "words")
        .agg(F.array_sort(F.collect_set("at")).alias("at"))
    )
    covered = F.aggregate(
        F.col("at"),
        F.struct(F.lit(0).alias("n"), F.lit(-seed).alias("last")),
        lambda s, at: F.struct(
            (s["n"] + F.least(F.lit(seed), at - s["last"])).alias("n"), at.alias("last")
        ),
        lambda s: s["n"],
    )
    chosen = places.where(covered >= F.col("words") * least).select("row", "item")
    own = found.dropDuplicates(["row"]).withColumnRenamed("seeds", "doc_seeds")
    pairs = chosen.join(own, "row")
    whole = items.withColumnRenamed("seeds", "item_seeds").dropDuplicates(["item"])
    pairs = attach(pairs, whole.select("item", "_item_id", "words", "item_seeds"), ["item"], "inner")
    pairs = pairs.withColumn("item", F.col("_item_id"))
    size = F.aggregate("tiles", F.lit(0), lambda n, t: n + t["words"])
    by_doc = F.transform(
        F.array_sort(F.transform("tiles", lambda t: F.struct(t["doc_word"], t["item_word"]))),
        lambda t: t["item_word"],
    )
    return (
        lay_tiles(pairs, key, seed)
        .withColumn("coverage", size / F.col("words"))
        .where(F.col("coverage") >= least)
        .select(
            key,
            F.col("item").alias(item_key),
            "coverage",
            (F.array_sort(by_doc) != by_doc).alias("reordered"),
            "tiles",
        )
    )

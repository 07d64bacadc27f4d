"""Exact removal of repeated word windows by super-k-mer partitioning.

A window is ``width`` consecutive words. Its minimiser is the smallest hash of its ``gram``-word runs,
so equal windows have equal minimisers. Consecutive windows with one minimiser form a super-k-mer,
which travels as one packed string (its words, joined by single spaces) to the bucket of its
minimiser. There the windows are cut out of the strings and sorted, and each distinct window gets the
smallest id of the documents that hold it. The comparison is of words, not of hashes.

Most minimisers occur in one document only. A first pass finds those in two or more and sets their
bits in a bitmap of fixed size, so that only super-k-mers that may repeat are packed and moved; a full
bitmap would cost moves, never results. Equal super-k-mers of copies are merged before and after the
shuffle. A minimiser with more than ``MOST_PACKS`` different super-k-mers (a frequent short passage) is
not put in one bucket: its windows are spread over all tasks by a 128-bit hash and merged there.

Defined cases: a null text has no words. A null id is neither smaller nor larger than any id: such a
row keeps all words and removes none elsewhere. Rows that share an id do not remove each other's
windows. Equal rows are each returned. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townpulse.llm.common import bits_of, has_bit, join_sized, kept, repeated_bits
from townpulse.llm.words import gram_hashes, row_slices, split_words

MOST_PACKS = 4000
# A super-k-mer is cut at every multiple of this many windows of its document.
LONGEST_RUN = 256

RUNS = "array<struct<lo:int,hi:int,least:bigint>>"


@dataclass
class SuperKmers:
    """Runs of windows: text, first window in the text, their number, minimiser, first and last word."""

    text: np.ndarray
    first: np.ndarray
    count: np.ndarray
    minimiser: np.ndarray
    word: np.ndarray
    last_word: np.ndarray


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    if len(values) < width:
        return values[:0]
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def super_kmers(words, width: int, gram: int) -> SuperKmers:
    low = sliding_min(gram_hashes(words.hashes, gram), width - gram + 1)
    sizes = np.diff(words.first)
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(low)]
    at = np.flatnonzero(np.arange(len(low)) + width <= words.first[text + 1])
    text, low = text[at], low[at]
    place = at - words.first[text]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (low[1:] != low[:-1]) | (place[1:] % LONGEST_RUN == 0)
    head = np.flatnonzero(fresh)
    count = np.diff(np.append(head, len(at)))
    return SuperKmers(text[head], place[head], count, low[head], at[head], at[head] + count + width - 2)


def minimisers(docs: DataFrame, key: str, text: str, width: int, gram: int) -> DataFrame:
    """(minimiser, key) of all super-k-mers."""

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, 1):
                runs = super_kmers(split_words(part.column(1)), width, gram)
                ids = part.column(0).to_numpy(zero_copy_only=False)[runs.text]
                yield pa.record_batch(
                    [pa.array(runs.minimiser.view(np.int64)), pa.array(ids, pa.int64())],
                    names=["minimiser", "id"],
                )

    return (
        docs.where(F.col(key).isNotNull())
        .select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
        .mapInArrow(headers, "minimiser bigint, id bigint")
    )


def packed_super_kmers(
    docs: DataFrame, shared: Broadcast, key: str, text: str, width: int, gram: int
) -> DataFrame:
    """Super-k-mers whose minimiser is in the shared bitmap: row, id, first, count, minimiser, digest, packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        bits = shared.value
        for batch in batches:
            for part in row_slices(batch, 2):
                flat = pa.array(
                    [b" ".join(t.split()) for t in part.column(2).cast(pa.binary()).fill_null(b"").to_pylist()],
                    pa.binary(),
                )
                words = split_words(flat)
                runs = super_kmers(words, width, gram)
                hit = np.flatnonzero(has_bit(bits, runs.minimiser))
                data = memoryview(words.data)
                packs = [
                    bytes(data[a:b])
                    for a, b in zip(
                        words.starts[runs.word[hit]].tolist(),
                        words.ends[runs.last_word[hit]].tolist(),
                        strict=True,
                    )
                ]
                source = pa.array(runs.text[hit])
                yield pa.record_batch(
                    [
                        part.column(0).take(source),
                        part.column(1).take(source),
                        pa.array(runs.first[hit].astype(np.int32)),
                        pa.array(runs.count[hit].astype(np.int32)),
                        pa.array(runs.minimiser[hit].view(np.int64)),
                        pa.array([xxhash.xxh3_128_digest(p) for p in packs], pa.binary()),
                        pa.array(packs, pa.binary()),
                    ],
                    names=["row", "id", "first", "count", "minimiser", "digest", "packed"],
                )

    return (
        docs.where(F.col(key).isNotNull())
        .select("_row", F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
        .mapInArrow(
            pack,
            "row bigint, id bigint, first int, count int, minimiser bigint, digest binary, packed binary",
        )
    )


def windows_of(packed: bytes, width: int) -> list[bytes]:
    """The windows of a packed super-k-mer, in order."""
    spaces = np.flatnonzero(np.frombuffer(packed, np.uint8) == 0x20)
    starts = [0, *(spaces + 1).tolist()]
    ends = [*spaces.tolist(), len(packed)]
    return [packed[a:b] for a, b in zip(starts[: len(starts) - width + 1], ends[width - 1 :], strict=True)]


def runs_of(least: list[int]) -> list[dict]:
    """Runs of consecutive windows with the same least id."""
    values = np.asarray(least, np.int64)
    head = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    tail = np.append(head[1:], len(values)) - 1
    return [
        {"lo": lo, "hi": hi, "least": n}
        for lo, hi, n in zip(head.tolist(), tail.tolist(), values[head].tolist(), strict=True)
    ]


def count_bucket(packs: list[bytes], ids: list[int], width: int) -> list[list[dict]]:
    """Runs of each pack of one minimiser: all windows are sorted, equal ones get their least id."""
    if len(packs) == 1:
        spaces = packs[0].count(b" ")
        return [[{"lo": 0, "hi": spaces + 1 - width, "least": ids[0]}]]
    cut = [windows_of(p, width) for p in packs]
    windows = [w for c in cut for w in c]
    owner = [i for i, c in zip(ids, cut, strict=True) for _ in c]
    least = [0] * len(windows)
    order = sorted(range(len(windows)), key=windows.__getitem__)
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and windows[order[end]] == windows[order[at]]:
            end += 1
        smallest = min(owner[i] for i in order[at:end])
        for i in order[at:end]:
            least[i] = smallest
        at = end
    out, at = [], 0
    for c in cut:
        out.append(runs_of(least[at : at + len(c)]))
        at += len(c)
    return out


def runs_in_buckets(packs: DataFrame, width: int, buckets: int) -> DataFrame:
    """(minimiser, digest, runs) of packs dealt to buckets by their minimiser."""

    def bucket(table: pa.Table) -> pa.Table:
        order = table.column("minimiser").to_numpy().argsort(kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        minimiser = table.column("minimiser").to_numpy()
        head = np.flatnonzero(np.append(True, minimiser[1:] != minimiser[:-1])).tolist()
        runs = []
        for lo, hi in zip(head, [*head[1:], len(minimiser)], strict=True):
            part = table.slice(lo, hi - lo)
            runs += count_bucket(part.column("packed").to_pylist(), part.column("least").to_pylist(), width)
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("least", pa.int64())]))
        return pa.table(
            {
                "minimiser": table.column("minimiser"),
                "digest": table.column("digest"),
                "runs": pa.array(runs, kind),
            }
        )

    return (
        packs.withColumn("bucket", F.pmod(F.xxhash64("minimiser"), F.lit(buckets)))
        .groupBy("bucket")
        .applyInArrow(bucket, f"minimiser bigint, digest binary, runs {RUNS}")
    )


def runs_of_hot(packs: DataFrame, width: int) -> DataFrame:
    """The same for minimisers with too many packs for one bucket, by hashed windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part in row_slices(batch, 2, 1 << 17):
                rows = [
                    (m, d, i, xxhash.xxh3_128_digest(w), n)
                    for m, d, p, n in zip(*(c.to_pylist() for c in part.columns), strict=True)
                    for i, w in enumerate(windows_of(p, width))
                ]
                names = ["minimiser", "digest", "place", "window", "id"]
                kinds = [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64()]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.record_batch(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
                )

    windows = packs.select("minimiser", "digest", "packed", "least").mapInArrow(
        cut, "minimiser bigint, digest binary, place int, window binary, id bigint"
    )
    windows = kept(windows, "windows")
    least = windows.groupBy("window").agg(F.min("id").alias("least"))
    span = F.struct(F.col("place").alias("lo"), F.col("place").alias("hi"), "least")
    return (
        windows.join(least, "window")
        .groupBy("minimiser", "digest")
        .agg(F.array_sort(F.collect_list(span)).alias("runs"))
    )


def repeated_ranges(
    docs: DataFrame, key: str, text: str, width: int, gram: int, buckets: int | None
) -> DataFrame:
    """(row, id, ranges): word ranges, end exclusive, of each row that smaller ids have too."""
    bitmap = repeated_bits(minimisers(docs, key, text, width, gram), "minimiser", "id")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    packs = kept(packed_super_kmers(docs, shared, key, text, width, gram), "super-kmers")
    shared.destroy()
    distinct = packs.groupBy("minimiser", "digest").agg(
        F.first("packed").alias("packed"), F.min("id").alias("least")
    )
    hot = (
        packs.select("minimiser", "digest").distinct().groupBy("minimiser").count()
        .where(F.col("count") > MOST_PACKS)
        .select("minimiser", F.lit(True).alias("hot"))
    )
    distinct = join_sized(distinct, hot, "minimiser")
    buckets = buckets or max(64, packs.count() // 10_000)
    runs = runs_in_buckets(distinct.where("hot IS NULL"), width, buckets).unionByName(
        runs_of_hot(distinct.where("hot"), width)
    )
    ranges = F.transform(
        F.filter("runs", lambda r: r["least"] < F.col("id")),
        lambda r: F.struct(
            (F.col("first") + r["lo"]).alias("lo"), (F.col("first") + r["hi"] + width).alias("hi")
        ),
    )
    return (
        packs.select("row", "id", "first", "minimiser", "digest")
        .join(runs, ["minimiser", "digest"])
        .select("row", "id", F.explode(ranges).alias("range"))
        .groupBy("row", "id")
        .agg(F.collect_list("range").alias("ranges"))
    )


def remove_repeats(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    width: int = 50,
    gram: int = 8,
    buckets: int | None = None,
) -> DataFrame:
    """``key``, n_words, n_removed and the text of the kept words, joined by spaces, of every row.

    A word goes if a window that covers it also starts in a document with a smaller id.
    """
    docs = docs.select(key, text).withColumn("_row", F.xxhash64(key, text))
    ranges = kept(repeated_ranges(docs, key, text, width, gram, buckets), "ranges")
    marked = docs.sparkSession.sparkContext.broadcast(bits_of(ranges, "row"))

    def marked_rows(batch: pa.RecordBatch) -> np.ndarray:
        return has_bit(marked.value, batch.column(2).to_numpy().view(np.uint64))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that may have ranges; only they are shuffled."""
        for batch in batches:
            yield batch.filter(pa.array(marked_rows(batch)))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that have none, where they are."""
        for batch in batches:
            some = batch.filter(pa.array(~marked_rows(batch)))
            none = pa.nulls(some.num_rows, pa.list_(pa.int32()))
            yield from drop([pa.record_batch([some.column(0), some.column(1), none], names=["id", "text", "ranges"])])

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, 1):
                counts, removed, texts = [], [], []
                for body, gone in zip(
                    part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True
                ):
                    words = (body or b"").split()
                    counts.append(len(words))
                    if gone:
                        keep = np.ones(len(words), bool)
                        for r in gone:
                            keep[r["lo"] : r["hi"]] = False
                        words = [words[i] for i in np.flatnonzero(keep).tolist()]
                    removed.append(counts[-1] - len(words))
                    texts.append(b" ".join(words))
                yield pa.record_batch(
                    [
                        part.column(0),
                        pa.array(counts, pa.int64()),
                        pa.array(removed, pa.int64()),
                        pa.array(texts, pa.binary()).cast(pa.string()),
                    ],
                    names=[key, "n_words", "n_removed", "kept"],
                )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, `{text}` string, _row bigint"
    out = f"`{key}` {kind}, n_words bigint, n_removed bigint, kept string"
    # rows are told apart by their id besides the hash
    same = (F.col("_row") == F.col("row")) & (F.col(key).cast("bigint") == F.col("id"))
    cut = docs.mapInArrow(pick, schema).join(ranges, same, "left").select(key, text, "ranges")
    return docs.mapInArrow(whole, out).unionByName(cut.mapInArrow(drop, out))

"""Maximal periodic runs of words by the branching-tandem test on an enhanced suffix array.

A run is a stretch of consecutive words with smallest period q that is at least ``least_exponent`` * q
and ``least_length`` words long and that no neighbouring word extends. The texts of a slice are numbered
into one array of words (words of different texts never get one number) and indexed by a suffix array,
its inverse and the longest common prefixes. Every interval of suffixes with a common prefix of d words
is a node of the implicit suffix tree, which is never built. Of all its children but the largest, each
suffix i is looked up at i + d and i - d in the inverse array: if that rank lies in the interval too,
but in another child, a square of period d starts there that its next word breaks. Such a square is
rotated to the left as long as words repeat, which gives the run it belongs to; a run found with several
periods keeps the smallest. Suffixes outside the largest child number at most n log n over all intervals.

Every text is indexed whole; a slice holds one text or several short ones, so memory is bounded by the
longest text. Nothing is shuffled, and a lost task is read again from the table.

Defined cases: a null text, one without words and one without runs give no runs and all their words.
Null and repeated keys are rows like any other, repeated rows get equal results, an empty table gives
no rows. Other columns than key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townpulse.llm.words import row_slices

# Bytes of text that are indexed together.
SLICE_BYTES = 1 << 20
# Symbols compared at once.
COMPARED = 1 << 18

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all suffixes in order, and the rank of each start.

    Suffixes are sorted by their first symbol, then by twice as many symbols in every round; only
    suffixes that still share their rank take part.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(n, np.int64)

    def split(slots: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Ranks of the sorted suffixes in ``slots``; returns the slots of those that share theirs."""
        head = np.flatnonzero(fresh)
        sizes = np.diff(np.append(head, len(slots)))
        rank[order[slots]] = np.repeat(slots[head], sizes)
        return slots[np.repeat(sizes > 1, sizes)]

    values = symbols[order]
    shared = split(np.arange(n), np.append(True, values[1:] != values[:-1])[:n])
    width = 1
    while len(shared):
        starts = order[shared]
        after = starts + width
        onward = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        pair = rank[starts] * (n + 1) + onward
        by_pair = np.argsort(pair)
        order[shared] = starts[by_pair]
        pair = pair[by_pair]
        shared = split(shared, np.append(True, pair[1:] != pair[:-1]))
        width *= 2
    return order, rank


def common_length(symbols: np.ndarray, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """How many symbols agree from each a and its b on, forwards (step 1) or backwards (step -1).

    ``symbols`` ends with a symbol that occurs nowhere else, so that no comparison leaves the array.
    """
    total = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    last, width = len(symbols) - 1, 1
    while len(open_):
        w = max(1, min(width, COMPARED // len(open_)))
        ahead = total[open_, None] * step + np.arange(w) * step
        x = symbols[np.clip(a[open_, None] + ahead, -1, last)]
        y = symbols[np.clip(b[open_, None] + ahead, -1, last)]
        same = x == y
        found = np.where(same.all(axis=1), w, same.argmin(axis=1))
        total[open_] += found
        open_ = open_[found == w]
        width *= 4
    return total


def common_prefixes(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order (-1 at both ends).

    A suffix whose word before repeats before its neighbour too has one word less in common than the
    suffix that starts there; only the others are compared, which takes n log n comparisons at most.
    """
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    derived = np.zeros(n, bool)
    derived[1:] = (before[1:] > 0) & (symbols[place[1:] - 1] == symbols[np.maximum(before[1:] - 1, 0)])
    own = np.flatnonzero(~derived)
    length = np.zeros(len(own), np.int64)
    known = before[own] >= 0
    length[known] = common_length(symbols, own[known], before[own[known]], 1)
    source = np.cumsum(~derived) - 1
    by_start = length[source] - (place - own[source])
    out = np.full(n + 1, -1, np.int64)
    out[1:n] = by_start[order[1:]]
    return out


def nearest_smaller(values: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """The nearest place before (step -1) or after (step 1) each of ``at`` with a smaller value.

    All places between a place and its candidate are at least as large, so candidates are followed
    from candidate to candidate. Values of ``at`` are positive; both ends of ``values`` are not.
    """
    candidate = np.arange(len(values)) + step
    open_ = at
    while len(open_):
        to = candidate[open_]
        open_ = open_[values[to] >= values[open_]]
        candidate[open_] = candidate[candidate[open_]]
    return candidate[at]


def branching_squares(
    order: np.ndarray, rank: np.ndarray, shared: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of squares whose next word breaks the period."""
    n = len(order)
    cut = np.flatnonzero(shared > 0)
    none = np.zeros(0, np.int64)
    if not len(cut):
        return none, none
    lo, hi = nearest_smaller(shared, cut, -1), nearest_smaller(shared, cut, 1)
    # the cuts between the children of one interval, side by side
    sort = np.lexsort((cut, shared[cut], lo))
    cut, lo, hi = cut[sort], lo[sort], hi[sort]
    depth = shared[cut]
    first = np.append(True, (lo[1:] != lo[:-1]) | (depth[1:] != depth[:-1]))
    node = np.cumsum(first) - 1
    after = np.append(cut[1:], 0)
    last = np.append(first[1:], True)
    # a child to the right of each cut, and one to the left of a node's first
    left, right = np.append(cut, lo[first]), np.append(np.where(last, hi, after), cut[first])
    of_node = np.append(node, node[first])
    depth, lo, hi = (np.append(x, x[first]) for x in (depth, lo, hi))
    size = right - left
    by_size = np.lexsort((size, of_node))
    largest = by_size[np.append(of_node[by_size][1:] != of_node[by_size][:-1], True)]
    small = np.ones(len(size), bool)
    small[largest] = False
    left, right, depth, lo, hi, size = (x[small] for x in (left, right, depth, lo, hi, size))
    starts, periods = [none], [none]
    at, ends = 0, np.cumsum(size)
    while at < len(size):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 8 * COMPARED, "right")))
        child = np.repeat(np.arange(at, upto), size[at:upto])
        nth = np.arange(len(child)) - np.repeat(ends[at:upto] - size[at:upto] - (ends[at] - size[at]), size[at:upto])
        suffix = order[left[child] + nth]
        d = depth[child]
        for other in (suffix + d, suffix - d):
            inside = (other >= 0) & (other < n)
            r = rank[np.where(inside, other, 0)]
            inside &= (r >= lo[child]) & (r < hi[child]) & ((r < left[child]) | (r >= right[child]))
            starts.append(np.minimum(suffix, other)[inside])
            periods.append(d[inside])
        at = upto
    return np.concatenate(starts), np.concatenate(periods)


def rotated(
    closed: np.ndarray, at: np.ndarray, period: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of the runs that the branching squares end.

    Of the squares with one end the shortest is rotated first. Those that lie in its run have a
    multiple of its period and give the same run; only longer ones are rotated in their turn.
    """
    sort = np.lexsort((period, at + 2 * period))
    at, period = at[sort], period[sort]
    end = at + 2 * period
    runs = []
    while len(at):
        shortest = np.append(True, end[1:] != end[:-1])
        i, e, q = at[shortest], end[shortest], period[shortest]
        start = i - common_length(closed, i - 1, i + q - 1, -1)
        runs.append((start, e, q))
        onward = at < start[np.cumsum(shortest) - 1]
        at, end, period = at[onward], end[onward], period[onward]
    if not runs:
        return at, end, period
    return tuple(np.concatenate(x) for x in zip(*runs, strict=True))


def runs_of(
    symbols: np.ndarray, least_length: int = 6, least_exponent: int = 4
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and smallest periods of all runs, by start, then period.

    A run needs two periods at least, whatever ``least_exponent``.
    """
    none = np.zeros(0, np.int64)
    if len(symbols) < 2:
        return none, none, none
    order, rank = suffix_array(symbols)
    closed = np.append(symbols, -1)
    start, end, period = rotated(closed, *branching_squares(order, rank, common_prefixes(closed, order)))
    long_enough = end - start >= np.maximum(least_length, least_exponent * period)
    start, end, period = start[long_enough], end[long_enough], period[long_enough]
    sort = np.lexsort((period, end, start))
    start, end, period = start[sort], end[sort], period[sort]
    smallest = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[: len(start)]
    start, end, period = start[smallest], end[smallest], period[smallest]
    sort = np.lexsort((period, start))
    return start[sort], (end - start)[sort], period[sort]


def find_runs(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    least_length: int = 6,
    least_exponent: int = 4,
) -> DataFrame:
    """``key``, n_words, runs (start, length, period in words, by start, then period) and kept of each row.

    ``kept`` holds the words that no run contains after its first period, joined by single spaces.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, 1, SLICE_BYTES):
                texts = part.column(1).cast(pa.binary()).fill_null(b"").to_pylist()
                words = [t.split() for t in texts]
                counts = np.array([len(w) for w in words], np.int64)
                first = np.append(0, np.cumsum(counts))
                flat = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode()
                owner = np.repeat(np.arange(len(words)), counts)
                symbols = owner * len(flat.dictionary) + flat.indices.to_numpy().astype(np.int64)
                start, length, period = runs_of(symbols, least_length, least_exponent)
                of_row = np.searchsorted(start, first)
                drops = np.zeros(len(symbols) + 1, np.int64)
                np.add.at(drops, start + period, 1)
                np.add.at(drops, start + length, -1)
                keep = np.cumsum(drops)[:-1] == 0
                kept = [
                    b" ".join(
                        ws if lo == hi else [w for w, k in zip(ws, keep[a : a + len(ws)].tolist(), strict=True) if k]
                    )
                    for ws, a, lo, hi in zip(
                        words, first[:-1].tolist(), of_row[:-1].tolist(), of_row[1:].tolist(), strict=True
                    )
                ]
                inside = start - first[np.repeat(np.arange(len(words)), np.diff(of_row))]
                runs = pa.StructArray.from_arrays(
                    [pa.array(inside), pa.array(length), pa.array(period)], fields=list(RUN)
                )
                yield pa.record_batch(
                    [
                        part.column(0),
                        pa.array(counts),
                        pa.ListArray.from_arrays(pa.array(of_row.astype(np.int32)), runs),
                        pa.array(kept, pa.binary()).cast(pa.string()),
                    ],
                    names=["key", "n_words", "runs", "kept"],
                )

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        search,
        f"key {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, kept string",
    )
    return found.withColumnRenamed("key", key)

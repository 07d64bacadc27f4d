"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A text column is one byte buffer with offsets. Words are maximal runs of bytes outside a set of
separators; their 64-bit hashes come from prefix sums of a polynomial, with no loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes hashed at once.
BLOCK = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

# space, tab, line feed, vertical tab, form feed, carriage return
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True

# Everything in ASCII but letters and digits.
MARKS = np.zeros(256, bool)
MARKS[[c for c in range(128) if not chr(c).isalnum()]] = True

SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit numbers (one to one)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """Words of consecutive texts: ``first[i]`` to ``first[i + 1]`` are those of text i."""

    data: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary array and its offsets into them; nulls are empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, block by block; a word longer than a block is hashed by itself."""
    out = np.zeros(len(starts), np.uint64)
    up, down = _powers(_BASE, BLOCK), _powers(_INVERSE, BLOCK)
    at = 0
    while at < len(starts):
        origin = starts[at]
        upto = int(np.searchsorted(ends, origin + BLOCK, "right"))
        if upto <= at:
            out[at] = _hash_long(data[origin : ends[at]], up)
            at += 1
            continue
        part = data[origin : ends[upto - 1]].astype(np.uint64)
        part += np.uint64(1)
        part *= up[: len(part)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=sums[1:])
        s, e = starts[at:upto] - origin, ends[at:upto] - origin
        out[at:upto] = (sums[e] - sums[s]) * down[s]
        at = upto
    return mix(out)


def _hash_long(data: np.ndarray, up: np.ndarray) -> np.uint64:
    total, scale = 0, 1
    for i in range(0, len(data), BLOCK):
        part = data[i : i + BLOCK].astype(np.uint64) + np.uint64(1)
        part *= up[: len(part)]
        total = (total + scale * int(part.sum(dtype=np.uint64))) % (1 << 64)
        scale = scale * pow(int(_BASE), BLOCK, 1 << 64) % (1 << 64)
    return np.uint64(total)


def split_words(texts: pa.Array, between: np.ndarray = BLANKS, fold: np.ndarray = SAME) -> Words:
    """Words of all texts, with bytes mapped by ``fold``."""
    data, offsets = buffers(texts)
    gap = between[data]
    if fold is not SAME:
        data = fold[data]
    n = len(data)
    edges = offsets[:-1][offsets[:-1] < n]
    before = np.ones(n, bool)
    before[1:] = gap[:-1]
    before[edges] = True
    after = np.ones(n, bool)
    after[:-1] = gap[1:]
    after[edges[edges > 0] - 1] = True
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(~gap & after) + 1
    first = np.searchsorted(starts, offsets)
    return Words(data, first, starts, ends, hash_words(data, starts, ends))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; places with fewer words after them are left out."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out *= _BASE
        out += hashes[i : i + size]
    return mix(out)


def row_slices(batch: pa.RecordBatch, column: int, most: int = 8 * BLOCK) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most about ``most`` bytes of text each (one row at least)."""
    _, offsets = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        upto = min(max(upto, at + 1), batch.num_rows)
        yield batch.slice(at, upto - at)
        at = upto

"""SentencePiece encoding with seeded merge-dropout, and decoding.

A BPE piece model merges the best-scoring neighbouring pair again and again. Here each candidate merge
is skipped with probability ``dropout``: a keyed hash of the seed, the row (key and text), the chunk's
number in the text, the chunk and the candidate's place decides, so a skipped merge is never taken, a run
can be repeated exactly, and every occurrence of a word draws for itself. With ``dropout`` 0 the result is
the plain encoding.

No piece holds a space behind another character, so a text falls apart into chunks (spaces and what
follows them) that are encoded on their own. Occurrences of a chunk in a slice of texts share work only as
far as they draw alike: they follow the merges of the chunk's encoding up to the first one that they skip,
those that skip the same one go on together, and the few that skip many are encoded alone. Short chunks go
all together in numpy, long ones by an agenda (a heap of candidates). Both follow the same order: best
score, then leftmost.

Characters without a piece become byte pieces; so does U+2581, which otherwise would come back as a
space. Decoding therefore returns every text exactly.

Defined cases: null and empty texts have no tokens (null decodes to the empty text). Equal rows get
equal tokens. An empty table gives no rows. Only the id and the text column are read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townpulse.llm.common import give_back
from townpulse.llm.words import mix, row_slices

SPACE = "▁"
# A model file is sent to every executor; larger ones are refused.
MOST_MODEL_BYTES = 64 << 20
# Symbols up to which a chunk is encoded together with others.
SHORT = 96
SLICE_BYTES = 4 << 20
# Skipped merges up to which occurrences of a short chunk go together.
SHARED_SKIPS = 3
# Occurrences that are worth an encoding to share.
SHARE = 3
CHUNK = re.compile(r" *[^ ]+| +")

_NONE = np.iinfo(np.int64).max
_ALL = (1 << 64) - 1
_A, _B, _C = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@dataclass
class Model:
    """A piece model as arrays."""

    chars: np.ndarray  # sorted code points that have a piece
    char_ids: np.ndarray
    pairs: np.ndarray  # sorted: left id << 32 | right id
    merged: np.ndarray
    ranks: np.ndarray  # by piece: 0 for the best score
    byte_ids: np.ndarray
    texts: list[bytes]  # by piece, for decoding

    @cached_property
    def merges(self) -> dict[int, int]:
        return dict(zip(self.pairs.tolist(), self.merged.tolist(), strict=True))

    @cached_property
    def slots(self) -> tuple[np.ndarray, np.ndarray, np.uint64]:
        """A hash table of ``pairs``: keys (-1 is empty), merged pieces, and the shift from hash to slot."""
        bits = max(4, int(len(self.pairs)).bit_length() + 2)
        home = (self.pairs.view(np.uint64) * _A >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        # Sorted by home, each pair takes its home or the slot behind the one before.
        n = np.arange(len(order))
        slot = np.maximum.accumulate(home[order] - n) + n
        table = np.full((1 << bits) + len(order) + 1, -1, np.int64)
        merged = np.full(len(table), -1, np.int32)
        table[slot], merged[slot] = self.pairs[order], self.merged[order]
        return table, merged, np.uint64(64 - bits)


def load_model(path: str) -> Model:
    """Read a BPE model with byte fallback."""
    from sentencepiece import SentencePieceProcessor

    data = Path(path).read_bytes()
    if len(data) > MOST_MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MOST_MODEL_BYTES} bytes")
    model = SentencePieceProcessor(model_proto=data)
    size = model.get_piece_size()
    ids, texts, byte_ids = {}, [b""] * size, np.full(256, -1, np.int32)
    for i in range(size):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            texts[i] = bytes([int(piece[3:5], 16)])
        elif not (model.is_control(i) or model.is_unknown(i)):
            ids[piece] = i
            texts[i] = piece.replace(SPACE, " ").encode()
    if (byte_ids < 0).any():
        raise ValueError(f"{path} has no byte pieces")
    pairs = {}
    for piece, i in ids.items():
        for k in range(1, len(piece)):
            if piece[:k] in ids and piece[k:] in ids:
                pairs[ids[piece[:k]] << 32 | ids[piece[k:]]] = i
    keys = np.array(sorted(pairs), np.int64)
    scores = np.array([model.get_score(i) for i in range(size)])
    single = sorted((ord(p) if p != SPACE else 0x20, i) for p, i in ids.items() if len(p) == 1)
    return Model(
        np.array([c for c, _ in single], np.int64),
        np.array([i for _, i in single], np.int32),
        keys,
        np.array([pairs[k] for k in keys.tolist()], np.int32),
        np.unique(-scores, return_inverse=True)[1].astype(np.int64),
        byte_ids,
        texts,
    )


def symbols(chunks: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece ids of single characters or bytes, where each chunk starts among them, and chunk hashes."""
    points = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32).astype(np.int64)
    starts = np.append(0, np.cumsum([len(c) for c in chunks])).astype(np.int64)
    at = np.minimum(np.searchsorted(model.chars, points), len(model.chars) - 1)
    ids = np.where(model.chars[at] == points, model.char_ids[at], -1)
    powers = np.full(int(np.diff(starts).max(initial=0)) + 1, _A, np.uint64)
    powers[:1] = 1
    powers = np.multiply.accumulate(powers)
    place = np.arange(len(points)) - np.repeat(starts[:-1], np.diff(starts))
    hashes = mix(np.add.reduceat((points + 1).astype(np.uint64) * powers[place], starts[:-1]))
    lost = np.flatnonzero(ids < 0)
    if len(lost):
        codes = [chr(p).encode() for p in points[lost].tolist()]
        wide = np.ones(len(points), np.int64)
        wide[lost] = [len(c) for c in codes]
        begin = np.append(0, np.cumsum(wide))
        ids = np.repeat(ids, wide)
        ids[ids < 0] = model.byte_ids[np.frombuffer(b"".join(codes), np.uint8)]
        starts = begin[starts]
    return ids.astype(np.int64), starts, hashes


def place_code(left: np.ndarray, middle: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A candidate's place (where both parts start and the second ends) as one number."""
    return left.astype(np.uint64) * _A + middle.astype(np.uint64) * _B + right.astype(np.uint64) * _C


def skipped(keys: np.ndarray, codes: np.ndarray, dropout: float) -> np.ndarray:
    """Whether the candidates (key of the chunk's occurrence, place) are skipped."""
    return (mix(keys + codes) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < dropout


def skips(key: int, left: int, middle: int, right: int, dropout: float) -> bool:
    """``skipped`` for one candidate, in plain numbers."""
    x = (key + left * int(_A) + middle * int(_B) + right * int(_C)) & _ALL
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & _ALL
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & _ALL
    return ((x ^ x >> 31) >> 11) * 2.0**-53 < dropout


def find_merges(model: Model, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ids of the pieces that pairs of neighbours make, or -1."""
    table, merged, shift = model.slots
    key = left << 32 | right
    slot = (key.view(np.uint64) * _A >> shift).view(np.int64)
    found = table[slot]
    out = np.where(found == key, merged[slot], -1)
    # A slot that another pair has: go on to the next ones up to an empty one.
    on = np.flatnonzero((found != key) & (found >= 0))
    while len(on):
        slot[on] += 1
        found = table[slot[on]]
        out[on] = np.where(found == key[on], merged[slot[on]], -1)
        on = on[(found != key[on]) & (found >= 0)]
    return out


def encode_agenda(ids: list[int], key: int, model: Model, dropout: float) -> list[int]:
    """One chunk by an agenda of candidate merges; a popped candidate may be stale or skipped."""
    ids = list(ids)
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))
    agenda: list[tuple] = []
    pairs = model.merges

    def push(i: int) -> None:
        j = after[i]
        if j < n:
            new = pairs.get(ids[i] << 32 | ids[j], -1)
            if new >= 0:
                heapq.heappush(agenda, (int(model.ranks[new]), i, j, end[j], new))

    for i in range(n - 1):
        push(i)
    while agenda:
        _, i, j, stop, new = heapq.heappop(agenda)
        if ids[i] < 0 or ids[j] < 0 or after[i] != j or end[j] != stop:
            continue
        if pairs[ids[i] << 32 | ids[j]] != new:
            continue
        if dropout and skips(key, i, j, stop, dropout):
            continue
        ids[i], ids[j] = new, -1
        end[i] = stop
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        if before[i] >= 0:
            push(before[i])
        push(i)
    return [v for v in ids if v >= 0]


def encode_together(
    ids: np.ndarray,
    starts: np.ndarray,
    keys: np.ndarray,
    model: Model,
    dropout: float,
    barred: np.ndarray | None = None,
    taken: list | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Many chunks at once: in each round every chunk takes its best candidate.

    Returns all pieces and the offsets of the chunks in them. Places in a chunk's row of ``barred`` are
    skipped besides those that its key skips. ``taken`` gets the (chunks, places) of each round's merges.
    """
    n = len(starts) - 1
    chunk = np.repeat(np.arange(n), np.diff(starts))
    place = np.arange(len(ids)) - starts[:-1][chunk]
    out_chunk, out_place, out_ids = [], [], []
    size = np.diff(starts)

    def codes_at(a: np.ndarray) -> np.ndarray:
        """Places of the candidates of symbols ``a`` with the next ones."""
        b = a + 1
        c = np.minimum(b + 1, len(ids) - 1)
        stop = np.where((c > b) & (chunk[c] == chunk[b]), place[c], size[chunk[b]])
        return place_code(place[a], place[b], stop)

    def candidates(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece and rank of the merge of symbol at[i] with the next one; no rank if there is none."""
        right = np.minimum(at + 1, len(ids) - 1)
        fits = (right > at) & (chunk[right] == chunk[at])
        new = np.where(fits, find_merges(model, ids[at], ids[right]), -1)
        if dropout or barred is not None:
            some = np.flatnonzero(new >= 0)
            codes = codes_at(at[some])
            if dropout:
                new[some[skipped(keys[chunk[at[some]]], codes, dropout)]] = -1
            if barred is not None:
                new[some[(barred[chunk[at[some]]] == codes[:, None]).any(1)]] = -1
        return new, np.where(new >= 0, model.ranks[new], _NONE)

    new, rank = candidates(np.arange(len(ids)))
    while len(ids):
        head = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
        best = np.minimum.reduceat(rank, head)
        length = np.diff(np.append(head, len(ids)))
        # Chunks without a candidate are done.
        done = np.repeat(best == _NONE, length)
        if done.any():
            out_chunk.append(chunk[done])
            out_place.append(place[done])
            out_ids.append(ids[done])
            live = ~done
            ids, chunk, place, new, rank = (x[live] for x in (ids, chunk, place, new, rank))
            length, best = length[best != _NONE], best[best != _NONE]
            if not len(ids):
                break
            head = np.append(0, np.cumsum(length))[:-1]
        hit = np.flatnonzero(rank == np.repeat(best, length))
        at = hit[np.append(True, chunk[hit][1:] != chunk[hit][:-1])]
        if taken is not None:
            taken.append((chunk[at], codes_at(at)))
        ids[at] = new[at]
        stay = np.ones(len(ids), bool)
        stay[at + 1] = False
        moved = at - np.arange(len(at))
        ids, chunk, place, new, rank = (x[stay] for x in (ids, chunk, place, new, rank))
        previous = moved[moved > 0] - 1
        for touched in (previous, moved):
            new[touched], rank[touched] = candidates(touched)
    chunk = np.concatenate([*out_chunk, np.zeros(0, np.int64)])
    place = np.concatenate([*out_place, np.zeros(0, np.int64)])
    order = np.lexsort((place, chunk))
    pieces = np.concatenate([*out_ids, np.zeros(0, np.int64)])[order].astype(np.int32)
    return pieces, np.searchsorted(chunk[order], np.arange(n + 1))


def encode_chunks(
    chunks: list[str], key: int | np.ndarray, model: Model, dropout: float, of: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of chunks and their offsets; ``key`` is one for all or one for each.

    With ``of`` the result is that of the occurrences ``[chunks[i] for i in of]``, whose keys ``key`` holds.
    """
    ids, starts, hashes = symbols(chunks, model)
    if of is None:
        of = np.arange(len(chunks))
    keys = mix(hashes[of] ^ np.asarray(key, np.uint64))
    begin, size = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
    parts: list[np.ndarray] = [np.zeros(0, np.int32)]
    total = 0

    def put(occurrences: np.ndarray, pieces: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> None:
        nonlocal total
        begin[occurrences], size[occurrences] = total + offsets[at], offsets[at + 1] - offsets[at]
        parts.append(pieces)
        total += len(pieces)

    short = np.diff(starts) <= SHORT
    for i in np.flatnonzero(~short[of]).tolist():
        own = ids[starts[of[i]] : starts[of[i] + 1]].tolist()
        pieces = np.array(encode_agenda(own, int(keys[i]), model, dropout), np.int32)
        put(np.array([i]), pieces, np.array([0, len(pieces)]), np.array([0]))
    # Nodes are chunks with some merges barred; an occurrence moves to the node that bars the first
    # merge of its own node which it skips, until it skips none.
    nodes = np.flatnonzero(short)
    barred = np.zeros((len(nodes), 0), np.uint64)
    live = np.flatnonzero(short[of])
    at = np.searchsorted(nodes, of[live])
    alone = []
    for _ in range(SHARED_SKIPS + 1):
        shared = np.bincount(at, minlength=len(nodes)) >= SHARE
        alone.append(live[~shared[at]])
        live, at = live[shared[at]], (np.cumsum(shared) - 1)[at[shared[at]]]
        nodes, barred = nodes[shared], barred[shared]
        if not len(live):
            break
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        pieces, offsets = encode_together(*picked(ids, starts, nodes), keys, model, 0.0, barred, taken)
        chunk = np.concatenate([np.zeros(0, np.int64), *(c for c, _ in taken)])
        order = np.argsort(chunk, kind="stable")
        codes = np.concatenate([np.zeros(0, np.uint64), *(c for _, c in taken)])[order]
        steps = np.searchsorted(chunk[order], np.arange(len(nodes) + 1))
        step, owner = spread(steps[at], steps[at + 1] - steps[at])
        hit = np.flatnonzero(skipped(keys[live][owner], codes[step], dropout))
        hit = hit[np.append(True, owner[hit][1:] != owner[hit][:-1])] if len(hit) else hit
        done = np.ones(len(live), bool)
        done[owner[hit]] = False
        put(live[done], pieces, offsets, at[done])
        live = live[owner[hit]]
        first, at = np.unique(step[hit], return_inverse=True)
        parent = np.searchsorted(steps, first, "right") - 1
        barred = np.column_stack([barred[parent], codes[first]])
        nodes = nodes[parent]
    live = np.concatenate([*alone, live])
    own = encode_together(*picked(ids, starts, of[live]), keys[live], model, dropout)
    put(live, *own, np.arange(len(live)))
    where, _ = spread(begin, size)
    return np.concatenate(parts)[where], np.append(0, np.cumsum(size))


def spread(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the ranges that start at ``begin``, one range behind the other, and each one's range."""
    owner = np.repeat(np.arange(len(size)), size)
    return np.arange(len(owner)) + (begin - (np.cumsum(size) - size))[owner], owner


def picked(ids: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and starts of some chunks."""
    size = starts[which + 1] - starts[which]
    return ids[spread(starts[which], size)[0]], np.append(0, np.cumsum(size))


def encode_texts(texts: list[str], key: int | np.ndarray, model: Model, dropout: float) -> list[np.ndarray]:
    """Piece ids of each text; ``key`` is one for all or one for each text."""
    split = [CHUNK.findall(" " + t) if t else [] for t in texts]
    index: dict[str, int] = {}
    for chunks in split:
        index.update(dict.fromkeys(chunks))
    for n, chunk in enumerate(index):
        index[chunk] = n
    if not index:
        return [np.zeros(0, np.int32) for _ in texts]
    counts = np.array([len(chunks) for chunks in split])
    of = np.fromiter(map(index.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
    number, text = spread(np.zeros(len(texts), np.int64), counts)
    own = np.broadcast_to(np.asarray(key, np.uint64), len(texts))
    keys = mix(mix(own)[text] + number.astype(np.uint64) * _A)
    pieces, offsets = encode_chunks(list(index), keys, model, dropout, of)
    return np.split(pieces, offsets[np.cumsum(counts)[:-1]])


def decode_ids(ids: list[int], model: Model) -> str:
    return b"".join(map(model.texts.__getitem__, ids)).decode("utf-8", "replace")[1:]


def encode(
    docs: DataFrame,
    model_path: str,
    *,
    key: str = "doc_id",
    text: str = "text",
    dropout: float = 0.1,
    seed: int = 1,
) -> DataFrame:
    """``key``, ids and lossless (whether decoding gave the text back) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(load_model(model_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what earlier stages took
        model = Model(**shared.value)
        for batch in batches:
            for part in row_slices(batch, 1, SLICE_BYTES):
                texts = [t or "" for t in part.column(1).to_pylist()]
                drawn = part.column(2).to_numpy().view(np.uint64)
                ids = encode_texts(texts, drawn, model, dropout)
                same = [decode_ids(i.tolist(), model) == t for i, t in zip(ids, texts, strict=True)]
                sizes = np.append(0, np.cumsum([len(i) for i in ids])).astype(np.int32)
                flat = pa.array(np.concatenate(ids).astype(np.int32))
                yield pa.record_batch(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(sizes), flat), pa.array(same)],
                    names=[key, "ids", "lossless"],
                )
                del texts, ids, same, flat
                give_back()

    kind = docs.schema[key].dataType.simpleString()
    drawn = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    return docs.select(key, text, drawn.alias("drawn")).mapInArrow(
        run, f"{key} {kind}, ids array<int>, lossless boolean"
    )


def decode(encoded: DataFrame, model_path: str, *, ids: str = "ids", text: str = "text") -> DataFrame:
    """The columns of ``encoded`` with ``ids`` replaced by the decoded text, under the name ``text``."""
    shared = encoded.sparkSession.sparkContext.broadcast(vars(load_model(model_path)))
    others = [c for c in encoded.columns if c not in (ids, text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**shared.value)
        for batch in batches:
            rows = batch.column(len(others)).to_pylist()
            texts = pa.array([decode_ids(i or [], model) for i in rows], pa.string())
            yield pa.record_batch([*batch.columns[:-1], texts], names=[*others, text])

    kinds = {f.name: f.dataType.simpleString() for f in encoded.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in others) + (", " if others else "") + f"`{text}` string"
    return encoded.select(*others, ids).mapInArrow(run, schema)

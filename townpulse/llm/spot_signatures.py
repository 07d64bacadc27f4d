"""Document fingerprints from spot signatures.

At every common word (an anchor) a signature starts: the anchor and the chain of the next content
words. A signature's second, third, ... occurrence counts as another one, so that fingerprints are sets
that stand for multisets; they are written as 48-bit numbers, sorted, in base 64. Common words are
seldom part of menus, code or tables, so the signatures follow the running text. Where the last
``STRETCH`` words held none, every word is an anchor.

``near_pairs`` finds all pairs of fingerprints at or above a similarity: equal ones are one class,
sets are partitioned by length so that a set meets only its own and the next shorter partition, and
pairs are pruned by their lengths and by what follows a shared signature before sets are compared.

``compare_with_next`` puts documents in descending order of their ids without one task seeing them
all: ids are cut into ranges, each range is sorted by itself, and the first document of a range is also
sent to the range before it.

Defined cases: a null text counts as empty. A text too short for any chain has its whole sequence of
words as its one signature, without words the text itself; an empty text has the empty fingerprint. Two empty fingerprints
have likeness 1. Letters beyond A-Z are not folded. Null ids come last in the order; rows with equal
ids are ordered by text, descending; the last row is followed by the first, and a single one by
itself. An empty table gives no rows. Only the id and the text column are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townpulse.llm.common import kept
from townpulse.llm.words import LOWER, MARKS, mix, row_slices, split_words

# Common words of four languages.
ANCHORS = (
    "a an and are as at be but by for from has have he her his i if in is it its not of on or she so that "
    "the their them there they this to was we were which will with you "
    "als am auch auf aus bei das dem den der des die ein eine einen einer er es für hat ich im ist mit nach "
    "nicht noch nur sich sie sind so um und von vor war wie wird zu zum zur über "
    "au aux avec ce ces cette comme dans de du elle en est et il ils je la le les leur lui mais ne nous on ont "
    "ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con del el ella ellos era esta este fue ha hay lo los las más muy no o para pero por su sus también "
    "todo una uno y ya"
).split()

SIGNATURE_BITS = 48
# After so many words without a common word each word starts a signature; so do the first words.
STRETCH = 8
_MASK = np.uint64((1 << SIGNATURE_BITS) - 1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def anchor_hashes() -> np.ndarray:
    return np.unique(split_words(pa.array([" ".join(ANCHORS)]), MARKS, LOWER).hashes)


def chains(words: np.ndarray, first: np.ndarray, spots: np.ndarray, content: np.ndarray, length: int):
    """Texts and values of the signatures that start at the given words and go on over content words."""
    follow = np.searchsorted(content, spots, "right")
    owner = np.searchsorted(first, spots, "right") - 1
    fits = follow + length <= len(content)
    spots, follow, owner = spots[fits], follow[fits], owner[fits]
    fits = content[follow + length - 1] < first[owner + 1]
    spots, follow, owner = spots[fits], follow[fits], owner[fits]
    value = words[spots]
    for i in range(length):
        value = value * _MULTIPLIER + words[content[follow + i]]
    return owner, mix(value)


def numbered(values: np.ndarray) -> np.ndarray:
    """Sorted values in which each further occurrence of a value has become another value."""
    values = np.sort(values)
    nth = np.arange(len(values)) - np.searchsorted(values, values)
    return np.sort(mix(values + nth.astype(np.uint64)) & _MASK)


def signature_sets(texts: list[str], anchors: np.ndarray, chain: int) -> list[np.ndarray]:
    """The sorted signatures of each text."""
    import xxhash

    found = split_words(pa.array(texts, pa.string()), MARKS, LOWER)
    words, first = found.hashes, found.first
    is_anchor = np.isin(words, anchors)
    place = np.arange(len(words))
    last = np.maximum.accumulate(np.where(is_anchor, place, -1)) if len(words) else place
    begin = np.repeat(first[:-1], np.diff(first))
    spots = np.flatnonzero(is_anchor | (last < begin) | (place - last >= STRETCH))
    owner, value = chains(words, first, spots, np.flatnonzero(~is_anchor), chain)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for i, text in enumerate(texts):
        own = value[bounds[i] : bounds[i + 1]]
        body = words[first[i] : first[i + 1]]
        if not len(own) and text:
            own = np.array([xxhash.xxh3_64_intdigest(body.tobytes() or text.encode())], np.uint64)
        out.append(numbered(own))
    return out


def fingerprint_text(signatures: np.ndarray) -> str:
    wide = signatures.astype(">u8").view(np.uint8).reshape(-1, 8)
    return base64.b64encode(wide[:, 2:].tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of signatures."""
    if not len(a) and not len(b):
        return 1.0
    same = len(np.intersect1d(a, b, True))
    return same / (len(a) + len(b) - same)


def in_order(docs: DataFrame, key: str, text: str, ranges: int) -> DataFrame:
    """Rows (key, text, range, extra) in ranges by id, each in order and then the row that follows."""
    rank = F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63)))
    docs = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"), rank.alias("rank"))
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    cuts = sorted(set(docs.agg(F.percentile_approx("rank", shares, 10_000).alias("c")).first().c or []))
    marks = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    docs = docs.withColumn("range", F.size(F.filter(marks, lambda c: c < F.col("rank"))))
    heads = sorted(
        (r.range, r.head) for r in docs.groupBy("range").agg(F.max("rank").alias("head")).collect()
    )
    # The first row of a range follows the last one of the next range above it.
    turns = [
        F.struct(F.lit(head).alias("rank"), F.lit(heads[(i + 1) % len(heads)][0]).alias("goes_to"))
        for i, (_, head) in enumerate(heads)
    ]
    if not turns:
        return docs.select(key, "text", "range", F.lit(False).alias("extra"))
    ahead = docs.sparkSession.range(1, numPartitions=1).select(F.inline(F.array(*turns)))
    places = F.array_compact(
        F.array(
            F.struct(F.col("range"), F.lit(False).alias("extra")),
            F.when(
                F.col("goes_to").isNotNull(),
                F.struct(F.col("goes_to").alias("range"), F.lit(True).alias("extra")),
            ),
        )
    )
    return (
        docs.join(F.broadcast(ahead), "rank", "left")
        .select(key, "text", "rank", F.inline(places))
        .repartitionById(len(cuts) + 1, F.col("range"))
        .sortWithinPartitions("range", "extra", F.desc("rank"), F.desc("text"))
        .select(key, "text", "range", "extra")
    )


def compare_with_next(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    chain: int = 2,
    ranges: int | None = None,
) -> DataFrame:
    """Fingerprints of each text and of the text with its last third taken from the next document.

    Returns ``key``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    anchors = anchor_hashes()
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kind = docs.schema[key].dataType.simpleString()

    def compared(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        """Output for all rows but the last, which is only looked at."""
        own = signature_sets([r[1] for r in rows], anchors, chain)
        use = [
            i for i in range(len(rows) - 1) if not rows[i][3] and rows[i][2] == rows[i + 1][2]
        ]
        edited = []
        for i in use:
            body = rows[i][1]
            swap = len(body) // 3
            edited.append(body[: len(body) - swap] + rows[i + 1][1][:swap])
        changed = signature_sets(edited, anchors, chain)
        columns = [
            pa.array([rows[i][0] for i in use], key_type),
            pa.array([len(rows[i][1]) for i in use], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
            pa.array([fingerprint_text(own[i]) for i in use], pa.string()),
            pa.array([fingerprint_text(c) for c in changed], pa.string()),
            pa.array([likeness(own[i], c) for i, c in zip(use, changed, strict=True)], pa.float64()),
            pa.array([likeness(own[i], own[i + 1]) for i in use], pa.float64()),
        ]
        return pa.record_batch(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple] = []
        for batch in batches:
            for part in row_slices(batch, 1, 1 << 20):
                rows = last + list(zip(*(c.to_pylist() for c in part.columns), strict=True))
                yield compared(rows, part.schema.field(0).type)
                last = rows[-1:]

    return in_order(docs, key, text, ranges).mapInArrow(
        run,
        f"{key} {kind}, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", chain: int = 2) -> DataFrame:
    """``key`` and fingerprint of every row."""
    anchors = anchor_hashes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, 1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                marks = [fingerprint_text(s) for s in signature_sets(texts, anchors, chain)]
                yield pa.record_batch(
                    [part.column(0), pa.array(marks, pa.string())], names=[key, "fingerprint"]
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, fingerprint string")


def near_pairs(marks: DataFrame, *, least: float = 0.8) -> DataFrame:
    """(a, b, similarity) of different fingerprints with a Jaccard similarity of ``least`` or more.

    Partitions by length grow by the factor 1 / ``least``, so a set and a partner no longer than it
    stand in one partition or in neighbours. The shared signature is looked for among the first of
    each set only, in the sets' sorted order, so the first shared one bounds what may still follow.
    """
    signs = F.unbase64("fingerprint")
    n = F.floor(F.octet_length(signs) / 6).cast("int")
    sets = kept(
        marks.where("fingerprint <> ''").select("fingerprint").distinct().select(
            "fingerprint",
            n.alias("size"),
            F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.hex(F.substring(signs, i * 6 + 1, 6))).alias("set"),
        ),
        "signature-sets",
    )
    length = F.floor(-F.log(F.col("size").cast("double")) / F.log(F.lit(least)) + 1e-9).cast("int")
    heads = sets.select(
        "fingerprint",
        "size",
        length.alias("length"),
        F.posexplode(F.slice("set", 1, F.col("size") - F.ceil(F.col("size") * least - 1e-9).cast("int") + 1)).alias("place", "sign"),
    )
    short = heads.select("length", "sign", *[F.col(c).alias(f"a_{c}") for c in ("fingerprint", "size", "place")])
    long = heads.select(
        F.explode(F.array(F.col("length"), F.col("length") - 1)).alias("length"),
        "sign",
        *[F.col(c).alias(f"b_{c}") for c in ("fingerprint", "size", "place")],
    )
    need = F.ceil((F.col("a_size") + F.col("b_size")) * least / (1 + least) - 1e-9)
    found = (
        short.join(long, ["length", "sign"])
        .where(
            (F.struct("a_size", "a_fingerprint") < F.struct("b_size", "b_fingerprint"))
            & (F.col("a_size") >= F.col("b_size") * least - 1e-9)
            & (F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place")) >= need)
        )
        .select(F.col("a_fingerprint").alias("a"), F.col("b_fingerprint").alias("b"))
        .distinct()
    )
    same = F.size(F.array_intersect("set_a", "set_b"))
    return (
        found.join(sets.select(F.col("fingerprint").alias("a"), F.col("set").alias("set_a")), "a")
        .join(sets.select(F.col("fingerprint").alias("b"), F.col("set").alias("set_b")), "b")
        .select("a", "b", (same / (F.size("set_a") + F.size("set_b") - same)).alias("similarity"))
        .where(F.col("similarity") >= least - 1e-12)
    )

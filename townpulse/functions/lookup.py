"""What a dictionary says about every word of a text, without moving the texts for small dictionaries."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townpulse.functions.text import words
from townpulse.scale import BROADCAST_ROWS, attach, settle

# Bits that say which words may be in a dictionary, and bits in a piece of them.
BITMAP_BITS, PIECE_BITS = 24, 15
# Entries of texts that may be sent to every executor at once.
MOST_ENTRIES = 5 * BROADCAST_ROWS


def _slots(words: pa.Array) -> np.ndarray:
    """The bit that stands for each word."""
    made = pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)
    return (made % np.uint64(1 << BITMAP_BITS)).astype(np.int64)


def _slot(word: Column) -> Column:
    @F.arrow_udf("int")
    def slot(words: pa.Array) -> pa.Array:
        return pa.array(_slots(words).astype(np.int32))

    return slot(word)


def key_bitmap(table: DataFrame, key: str) -> np.ndarray:
    """Which slots the keys of a table take: 2 MB, however many keys there are.

    A full bitmap lets more words through; what is found does not change.
    """
    pieces = (
        table.select(_slot(F.col(key)).alias("slot"))
        .groupBy(F.shiftright("slot", PIECE_BITS).alias("piece"))
        .agg(F.call_function("bitmap_construct_agg", F.col("slot") % (1 << PIECE_BITS)).alias("bits"))
        .collect()
    )
    out = np.zeros((1 << BITMAP_BITS) >> 3, np.uint8)
    size = (1 << PIECE_BITS) >> 3
    for row in pieces:
        out[row.piece * size : (row.piece + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return out


def like_lists(lists: pa.ListArray, values: pa.Array) -> pa.ListArray:
    """Lists of the same lengths, and nulls at the same places, with other values."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=lists.is_null())


def line_of(lists: pa.ListArray, found: pa.Array) -> pa.Array:
    """The values found, or the words that have none, with spaces between them."""
    return pc.binary_join(like_lists(lists, pc.coalesce(found, lists.flatten())), " ")


def _sent(dictionary: DataFrame, form: str, value: str):
    """A dictionary's keys and values as two arrays that every task has."""
    table = dictionary.toArrow().combine_chunks()
    keys, values = (table.column(c).combine_chunks() for c in (form, value))
    keys, values = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (keys, values))
    return dictionary.sparkSession.sparkContext.broadcast((keys, values))


def lines_sent_along(dictionary: DataFrame, form: str, value: str, words_of: Column) -> Column:
    """A row's words, replaced by the values of a dictionary that every task has, as one line.

    The words of a slice of rows are made distinct first, so each is looked up once.
    """
    shared = _sent(dictionary, form, value)

    @F.arrow_udf("string")
    def look(lists: pa.Array) -> pa.Array:
        keys, values = shared.value
        coded = lists.flatten().dictionary_encode()
        found = values.take(pc.index_in(coded.dictionary, value_set=keys))
        return line_of(lists, found.take(coded.indices))

    return look(words_of)


def values_sent_along(dictionary: DataFrame, form: str, value: str, words_of: Column) -> Column:
    """Values of a row's words from a dictionary that every task has, looked up as in ``lines_sent_along``."""
    shared = _sent(dictionary, form, value)
    kind = dictionary.schema[value].dataType.simpleString()

    @F.arrow_udf(f"array<{kind}>")
    def look(lists: pa.Array) -> pa.Array:
        keys, values = shared.value
        coded = lists.flatten().dictionary_encode()
        found = values.take(pc.index_in(coded.dictionary, value_set=keys))
        return like_lists(lists, found.take(coded.indices))

    return look(words_of)


def sums_sent_along(dictionary: DataFrame, form: str, value: str, words_of: Column) -> Column:
    """Sums of the values (arrays of one length) of a row's words, null where none is found.

    Only a sum for each row leaves the task's Python, never a value for each word.
    """
    shared = _sent(dictionary, form, value)
    kind = dictionary.schema[value].dataType

    @F.arrow_udf(kind.simpleString())
    def look(lists: pa.Array) -> pa.Array:
        keys, values = shared.value
        coded = lists.flatten().dictionary_encode()
        place = pc.fill_null(pc.index_in(coded.dictionary, value_set=keys), -1).to_numpy(zero_copy_only=False)
        place = place[coded.indices.to_numpy(zero_copy_only=False)]
        at = np.flatnonzero(place >= 0)
        row, place = _row_numbers(lists)[at], place[at]
        table = values.flatten().to_numpy(zero_copy_only=False)
        table = table.reshape(len(values), -1 if len(values) else 0)
        hits = np.bincount(row, minlength=len(lists)) > 0
        ends = np.searchsorted(row, np.arange(len(lists) + 1))
        sums = np.zeros((len(lists), table.shape[1]), table.dtype)
        for i in range(table.shape[1]):
            if table.dtype.kind == "f":
                sums[:, i] = np.bincount(row, table[place, i], len(lists))
            else:
                sums[:, i] = np.diff(np.append(0, np.cumsum(table[place, i]))[ends])
        offsets = np.append(0, np.cumsum(np.where(hits, table.shape[1], 0))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums[hits].ravel()), mask=pa.array(~hits))

    return look(words_of)


def _row_numbers(lists: pa.ListArray) -> np.ndarray:
    """The row of each value of the flattened lists."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes)


def _known_words(lists: pa.ListArray, bitmap: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of each row whose slot is taken, how many a row has, how often it has each."""
    coded = lists.flatten().dictionary_encode()
    slot = _slots(coded.dictionary)
    taken = (bitmap[slot >> 3] >> (slot & 7)) & 1 > 0
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = max(1, len(coded.dictionary))
    at = np.flatnonzero(taken[code])
    pair, count = np.unique(_row_numbers(lists)[at] * size + code[at], return_counts=True)
    return coded.dictionary.take(pa.array(pair % size)), np.bincount(pair // size, minlength=len(lists)), count


def _of_sizes(sizes: np.ndarray, values: pa.Array, like: pa.ListArray) -> pa.ListArray:
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=like.is_null())


def _may_be_keys(bitmap: np.ndarray, words_of: Column, table: DataFrame) -> Column:
    """The distinct words of a row whose slot is taken."""
    shared = table.sparkSession.sparkContext.broadcast(bitmap)

    @F.arrow_udf("array<string>")
    def known(lists: pa.Array) -> pa.Array:
        found, sizes, _ = _known_words(lists, shared.value)
        return _of_sizes(sizes, found, lists)

    return known(words_of)


def _aligned(words_of: Column, entries: Column, form: str, value: str, kind: str, line: bool = False) -> Column:
    """Values of a row's words from the row's own entries (form, value), or a line of them and other words."""

    @F.arrow_udf("string" if line else f"array<{kind}>")
    def place(lists: pa.Array, entries: pa.Array) -> pa.Array:
        own = entries.flatten()
        keys, values = own.field(form), own.field(value)
        wanted = lists.flatten()
        coded = pa.concat_arrays([keys, wanted]).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)

        # a word of a row is the pair of its row and its number
        pair = np.concatenate([_row_numbers(entries), _row_numbers(lists)]) * max(1, len(coded.dictionary)) + code
        have, want = pair[: len(keys)], pair[len(keys) :]
        order = np.argsort(have, kind="stable")
        at = np.searchsorted(have[order], want)
        hit = at < len(have)
        hit[hit] = have[order][at[hit]] == want[hit]
        index = np.zeros(len(want), np.int64)
        index[hit] = order[at[hit]]
        found = values.take(pa.array(index, mask=~hit))
        return line_of(lists, found) if line else like_lists(lists, found)

    return place(words_of, entries)


def counted_keys(bitmap: np.ndarray, words_of: Column, table: DataFrame) -> Column:
    """``w, n``: the distinct words of a row whose slot is taken, and how often it has them."""
    shared = table.sparkSession.sparkContext.broadcast(bitmap)

    @F.arrow_udf("array<struct<w:string,n:bigint>>")
    def counted(lists: pa.Array) -> pa.Array:
        found, sizes, count = _known_words(lists, shared.value)
        return _of_sizes(sizes, pa.StructArray.from_arrays([found, pa.array(count)], ["w", "n"]), lists)

    return counted(words_of)


def with_sums(
    df: DataFrame, text: str, dictionary: DataFrame, form: str, value: str, out: str, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Adds ``out``: the sum of the dictionary's ``value`` (an array of numbers of one length) over
    ``words(text)``, place by place; null where no word is found or the text is null.

    As ``with_values``, but of a larger dictionary only sums come back to the rows: a text's different
    words are joined with the dictionary and summed by the text's 128-bit hash.
    """
    once = dictionary.filter(F.col(form).isNotNull()).groupBy(form).agg(F.min(value).alias(value))
    once = settle(once)
    of_sum = once.schema[value].dataType.elementType
    if once.count() <= max_rows:
        return df.withColumn(out, sums_sent_along(once, form, value, words(text)))
    own = {c: f"_{uuid.uuid4().hex}" for c in ("h1", "h2")}
    by = list(own.values())
    hashes = {own["h1"]: F.xxhash64(text), own["h2"]: F.xxhash64(F.lit(1), F.col(text))}
    # one more entry a row counts the copies of its text; no word has a space in it
    copy = F.struct(F.concat(F.lit(" "), F.col(own["h1"]).cast("string")).alias("w"), F.lit(None).cast("bigint").alias("n"))
    counted = counted_keys(key_bitmap(once, form), words(text), once)
    # a null text has no list, so no pieces
    pieces = (
        df.select(*[h.alias(name) for name, h in hashes.items()], counted.alias("_counted"))
        .select(*by, F.explode(F.concat("_counted", F.array(copy))).alias("_piece"))
        .select(*by, F.col("_piece.w").alias(form), F.col("_piece.n").alias("_n"))
    )
    wide = once.agg(F.max(F.size(value))).first()[0] or 0
    places = [F.get(value, F.lit(i)).alias(f"_v{i}") for i in range(wide)]
    met = pieces.join(once.select(form, *places).hint("merge"), form, "left")
    copies = F.count_if(F.col("_n").isNull())
    whole = of_sum.simpleString() in ("tinyint", "smallint", "int", "bigint")

    def summed(i: int) -> Column:
        part = F.col(f"_v{i}") * F.col("_n")
        # the copies' sum may be beyond a long where each sum is not
        return F.call_function("div", F.sum(part.cast("decimal(38,0)")), copies) if whole else F.sum(part) / copies

    sums = F.array(*[summed(i).cast(of_sum) for i in range(wide)])
    known = F.count_if(F.col("_n").isNotNull() & F.col("_v0").isNotNull()) if wide else F.lit(0)
    found = met.groupBy(*by).agg(sums.alias(out), known.alias("_known")).filter("_known > 0").drop("_known")
    return attach(df.drop(out).withColumns(hashes), found, by).drop(*by)


def with_values(
    df: DataFrame,
    text: str,
    dictionary: DataFrame,
    form: str,
    value: str,
    out: str,
    max_rows: int = BROADCAST_ROWS,
    line: bool = False,
) -> DataFrame:
    """Adds ``out``: for each of ``words(text)`` the dictionary's value, null where it has none.

    Of several values for a form the smallest is taken; a null text gives null. A dictionary of up to
    ``max_rows`` rows goes to every task and the rows stay where they are. A larger one is joined with
    the distinct words of each different text that may be in it, by a bitmap of its forms, and the
    entries found are brought to the rows by a 128-bit hash of their text. With ``line`` (values that are
    strings) ``out`` is one string: the values, or the words that have none, with spaces between them.
    """
    once = dictionary.filter(F.col(form).isNotNull()).groupBy(form).agg(F.min(value).alias(value))
    once = settle(once)
    if once.count() <= max_rows:
        sent_along = lines_sent_along if line else values_sent_along
        return df.withColumn(out, sent_along(once, form, value, words(text)))
    own = {c: f"_{uuid.uuid4().hex}" for c in ("h1", "h2", "entries")}
    hashes = {own["h1"]: F.xxhash64(text), own["h2"]: F.xxhash64(F.lit(1), F.col(text))}
    pieces = df.select(
        *[h.alias(name) for name, h in hashes.items()],
        F.explode(_may_be_keys(key_bitmap(once, form), words(text), once)).alias(form),
    )
    by = [own["h1"], own["h2"]]
    found = (
        pieces.join(once.hint("merge"), form)
        .groupBy(*by)
        .agg(F.collect_set(F.struct(form, value)).alias(own["entries"]))
    )
    kind = once.schema[value].dataType.simpleString()
    # a row's entries may be many: what may be sent along is counted in entries
    found = settle(found)
    entries = found.agg(F.sum(F.size(own["entries"]))).first()[0] or 0
    rows = attach(df.withColumns(hashes), found, by, max_rows=BROADCAST_ROWS if entries <= MOST_ENTRIES else -1)
    return rows.withColumn(out, _aligned(words(text), F.col(own["entries"]), form, value, kind, line)).drop(*own.values())

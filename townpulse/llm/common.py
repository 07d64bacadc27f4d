"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townpulse.scale import BROADCAST_ROWS, settle, shared_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def give_back() -> None:
    """Free memory of a Python worker goes back to the system: workers outlive tasks and stages, and
    allocators keep what the largest slice took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again, which cuts its lineage.

    Column-wise and compressed, so unlike a checkpoint later reads take only the columns they use.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_sized(
    rows: DataFrame, table: DataFrame, key: str, how: str = "left", max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Join on ``key`` (nulls match nulls) with a table that is counted first.

    Up to ``max_rows`` narrow rows are broadcast and ``rows`` stay where they are; more are merged,
    and adaptive execution splits hot keys. The result is the same.
    """
    other = f"_{uuid.uuid4().hex}"  # clashes with no column
    table = settle(table).withColumnRenamed(key, other)
    small = table.count() <= max_rows
    table = F.broadcast(table) if small else table.hint("merge")
    return rows.join(table, F.col(key).eqNullSafe(F.col(other)), how).drop(other)


# Bits in a piece of a bitmap, as ``bitmap_construct_agg`` makes them.
PIECE_BITS = 15


def bits_of(values: DataFrame, value: str, bits: int = 26) -> np.ndarray:
    """A bitmap of 2^bits bits with those of all values of a bigint column.

    Its size is fixed, so it may be sent to every executor; a full bitmap only lets more through.
    """
    slot = F.pmod(value, F.lit(1 << bits))
    pieces = (
        values.select(
            F.shiftright(slot, PIECE_BITS).alias("piece"), (slot % (1 << PIECE_BITS)).alias("bit")
        )
        .groupBy("piece")
        .agg(F.call_function("bitmap_construct_agg", F.col("bit")).alias("bits"))
        .collect()
    )
    out = np.zeros((1 << bits) >> 3, np.uint8)
    size = (1 << PIECE_BITS) >> 3
    for row in pieces:
        out[row.piece * size : (row.piece + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return out


def repeated_bits(pairs: DataFrame, value: str, owner: str, bits: int = 26) -> np.ndarray:
    """The bitmap of the values that at least two owners have."""
    several = pairs.groupBy(value).agg(F.min(owner).alias("a"), F.max(owner).alias("b")).where("a < b")
    return bits_of(several, value, bits)


def has_bit(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the bits of unsigned 64-bit values are set."""
    slot = values & np.uint64(len(bitmap) * 8 - 1)
    byte = bitmap[(slot >> np.uint64(3)).astype(np.int64)]
    return ((byte >> (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for all nodes of links (a, b); the root is the least node that links reach.

    Large and small stars by turns: each round hangs neighbours on their least neighbour, and the
    number of rounds grows with the logarithm of a chain's length. Every round is a written cut.
    """
    edges = settle(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct()
        )
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .select(F.inline(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                     F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
            .where("u <> v").distinct()
        )
        edges = settle(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())

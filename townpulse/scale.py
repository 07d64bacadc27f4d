"""Helpers that keep jobs safe at cluster size: durable cuts and size-checked joins."""

from __future__ import annotations

import functools
import operator
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A table of at most this many rows may be sent to every executor.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder for durable intermediate data, named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting (it then gets a temporary
    folder); on a cluster a folder of one machine would be lost with it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="townpulse-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Run ``df`` now and keep its rows in the shared folder, cutting its lineage.

    A frame that already is such a cut is returned as it is.
    """
    if getattr(df, "_settled", False):
        return df
    shared_folder(df.sparkSession)
    kept = df.checkpoint(eager=True)
    kept._settled = True
    return kept


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: a cut whose readers take only their columns."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach(
    rows: DataFrame,
    table: DataFrame,
    on: list[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
    null_safe: bool = False,
) -> DataFrame:
    """Join ``rows`` with a derived ``table`` that is usually, not provably, small.

    Runs ``table`` once and looks at its size. Within ``max_rows`` it is
    broadcast and ``rows`` stay where they are; beyond that both sides are
    shuffled and merged, a join whose hot keys adaptive execution splits. With
    ``null_safe`` a null key finds a null key.
    """
    table = settle(table)
    small = table.count() <= max_rows
    joined_on: list[str] | Column = on
    if null_safe:
        names = {key: f"_{key}_{uuid.uuid4().hex}" for key in on}
        table = table.withColumnsRenamed(names)
        pairs = [F.col(key).eqNullSafe(F.col(name)) for key, name in names.items()]
        joined_on = functools.reduce(operator.and_, pairs)
    table = F.broadcast(table) if small else table.hint("merge")
    found = rows.join(table, joined_on, how)
    return found.drop(*names.values()) if null_safe else found

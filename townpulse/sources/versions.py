"""Tables kept as whole versions: a reader sees one version or the next, never a mixture."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Versions that stay for readers that are still at them.
KEPT_VERSIONS = 3


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, root, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def whole_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that were written to their end, in order.

    The mark that a write leaves last makes a version visible, so the switch is one step.
    """
    jvm, root, fs = _file_system(spark, path)
    if not fs.exists(root):
        return []
    found = []
    for status in fs.listStatus(root):
        name = re.fullmatch(r"version=(\d+)", status.getPath().getName())
        if name and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(int(name[1]))
    return sorted(found)


def read_version(
    spark: SparkSession, path: str, schema: str | StructType, before: int | None = None
) -> DataFrame:
    """The newest whole version, or the newest below ``before``; no rows where there is none."""
    numbers = [n for n in whole_versions(spark, path) if before is None or n < before]
    if not numbers:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/version={numbers[-1]}")


def write_version(rows: DataFrame, path: str, number: int) -> None:
    """Write version ``number``; written again it replaces itself. Old versions go."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={number}")
    jvm, root, fs = _file_system(spark, path)
    for old in [n for n in whole_versions(spark, path) if n <= number][:-KEPT_VERSIONS]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(root, f"version={old}"), True)

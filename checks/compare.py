"""Run queries next to their SQL: ``python -m checks.compare [folder] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from checks.oracles import ORACLES
from checks.queries import QUERIES
from townpulse.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def normal(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(normal(row[i]) for i in order) for row in rows),
        key=lambda r: tuple("" if v is None else "=" + v for v in r),
    )


def spark_kind(kind: str) -> str:
    return {"timestamp_ntz": "timestamp", "string": "varchar", "int": "integer"}.get(kind, kind)


def compare(spark, name: str, folder: str) -> tuple[bool, str]:
    """Whether the query's columns, types and rows equal those of its SQL."""
    start = time.time()
    frame = QUERIES[name](spark, folder)
    kinds = {k: spark_kind(t) for k, t in frame.dtypes}
    ours = rows_of(frame.columns, frame.collect())
    took = f"{time.time() - start:.1f}s"
    if name not in ORACLES:
        return len(ours) > 0, f"rows only: {len(ours)} {took}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    theirs_kinds = {d[0]: str(d[1]).lower() for d in result.description}
    theirs = rows_of(names, result.fetchall())
    if sorted(names) != sorted(frame.columns):
        return False, f"columns {sorted(frame.columns)} / {sorted(names)}"
    other = {k: (kinds[k], theirs_kinds[k]) for k in kinds if kinds[k] != theirs_kinds[k]}
    if ours != theirs:
        bad = [(a, b) for a, b in zip(ours, theirs) if a != b][:2]
        return False, f"{len(ours)} / {len(theirs)} rows; {str(bad)[:900]} {took}"
    return not other, f"{len(ours)} rows {took} {'types ' + str(other) if other else ''}"


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(
        "compare",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.log.level": "ERROR",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    failed = 0
    for name in names:
        try:
            good, note = compare(spark, name, folder)
        except Exception as error:  # noqa: BLE001
            good, note = False, f"{type(error).__name__}: {str(error)[:1200]}"
        failed += not good
        print("ok  " if good else "FAIL", name, note, flush=True)
    print(f"{len(names) - failed} of {len(names)} equal")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from townpulse.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.log.level": "ERROR",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate one expression for each given text."""

    def run(expression, texts, kind="string"):
        rows = spark.createDataFrame(
            [(i, t) for i, t in enumerate(texts)], f"i bigint, text {kind}"
        )
        return [r[1] for r in sorted(rows.select("i", expression.alias("v")).collect())]

    return run

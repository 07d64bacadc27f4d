import pytest

import __spark_entry__ as entry_file
import checks.compare as comparison
from townpulse.llm.oracles import ORACLES
from townpulse.llm.queries import QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_sql(spark, monkeypatch, name):
    monkeypatch.setattr(comparison, "QUERIES", QUERIES)
    monkeypatch.setattr(comparison, "ORACLES", ORACLES)
    good, note = comparison.compare(spark, name, entry_file.SMALL)
    assert good, note


def test_all_operators_and_the_pipeline_are_registered():
    names = entry_file.queries().keys()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1

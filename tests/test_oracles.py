import pytest

import __spark_entry__ as entry_file
from checks.compare import compare
from checks.oracles import ORACLES
from checks.queries import QUERIES

SMALL = entry_file.SMALL


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, name):
    good, note = compare(spark, name, SMALL)
    assert good, note


def test_every_statement_has_its_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {
        "trained_sentiment", "density_topics_text", "full_run_topics",
    }


def test_entry(spark):
    first = entry_file.entry(spark)
    assert first.columns == ["week_start", "topic_name", "count"] and first.count() > 0
    assert entry_file.queries().items() >= QUERIES.items()
    assert entry_file.oracle_sql().items() >= ORACLES.items()
    assert entry_file.oracle_sql().keys() <= entry_file.queries().keys()

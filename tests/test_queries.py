import importlib

import pytest

from tests.oracle import DATA, connect, same

MODULES = ["reaction_queries", "candle_queries", "article_queries", "analysis_queries", "similarity_queries", "further_queries", "extra_queries", "verdict_queries", "story_queries", "source_queries", "corpus_queries"]
ALL = {n: (m.QUERIES[n], q) for m in (importlib.import_module(f"tidemark.plans.{x}") for x in MODULES) for n, q in m.SQL.items()}


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ALL)
def test_query_equals_sql(spark, con, name):
    same(spark, con, *ALL[name])


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 12
    assert set(e.oracle_sql()) <= set(e.queries())

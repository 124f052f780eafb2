"""Registered queries against their SQL on the smallest tables, where these are at hand."""

from pathlib import Path

import pytest

from tests.oracle import compare, duck
from verdigris.plans import catalogue

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(TABLES)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, con, name):
    same, n, m, _, extra, missing = compare(spark, con, str(TABLES), name, catalogue.queries()[name], catalogue.oracle_sql()[name])
    assert same, (n, m, extra, missing)


def test_every_query_with_sql_is_registered():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_others_run(spark, name):
    assert catalogue.queries()[name](spark, str(TABLES)).count() > 0


def test_whole_search_runs_with_the_defaults(spark, monkeypatch):
    from verdigris.config import Settings
    from verdigris.plans import text_queries

    class Asked(Exception):
        pass

    def seen(queries, view, encoder, settings, **more):
        raise Asked(settings)

    monkeypatch.setattr(text_queries, "search", seen)
    with pytest.raises(Asked) as asked:
        text_queries.verified_search(spark, str(TABLES))
    assert asked.value.args[0] == Settings()

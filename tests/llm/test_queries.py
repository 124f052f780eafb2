"""The registered queries of the subpackage on the smallest tables, where these are at hand."""

from pathlib import Path

import pytest

from tests.oracle import compare, duck
from verdigris.llm import queries

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="no test tables")
# The columns that the statements of the problems give.
COLUMNS = {
    "p1_found": "qid string, language string", "p2_found": "rec_a string, rec_b string", "p3_found": "search_id bigint, id string", "p4_found": "key_a string, key_b string", "p5_found": "rec string", "p7_ids": "doc_id bigint, ids array<int>",
    "p9_found": "doc_id bigint, kind string, found string",
}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    same, n, m, _, extra, missing = compare(spark, duck(TABLES), str(TABLES), name, queries.QUERIES[name], queries.SQL[name])
    assert same, (n, m, extra, missing)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_distinct_rows(spark, name):
    df = queries.QUERIES[name](spark, str(TABLES))
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
    rows = [tuple(map(str, r)) for r in df.collect()]
    assert rows and len(rows) == len(set(rows))

"""Every query of the catalogue against its SQL on the small tables."""

import math
import os

import pytest

from lodestack.plans import catalog

SF = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return found


def plain(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: round(x, 6) if isinstance(x, float) and math.isfinite(x) else x
    return sorted((tuple(value(r[i]) for i in at) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = plain(df.collect(), df.columns)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = duck.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = plain(result.fetchall(), columns)
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", ["approximate_topk", "stored_cells_topk"])
def test_approximate_recall_on_the_tables(spark, name):
    pair = lambda of: {(r["query_id"], r["representation_id"]) for r in catalog.queries()[of](spark, SF).collect()}
    exact, near = pair("exact_cosine_topk"), pair(name)
    assert len(exact & near) / len(exact) >= 0.9

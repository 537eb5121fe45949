import pytest
from compare import connect, rows

import cairn.plans.store_queries  # noqa: F401
from cairn.plans.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def sql(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, sf, sql, name):
    df = QUERIES[name](spark, sf)
    cursor = sql.execute(ORACLE[name])
    theirs = rows([c[0] for c in cursor.description], cursor.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == theirs


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert {"recall_static", "knn_topk"} <= set(e.queries())

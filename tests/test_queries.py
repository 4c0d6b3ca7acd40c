"""Every query of the library against its SQL in DuckDB, on the smallest given tables."""

import math

import duckdb
import pytest

from serialspark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Their SQL takes minutes in DuckDB or their rows are many; a run of all queries covers them.
SLOW = {"window_classify", "window_stats", "topk_samples", "detector_coverage"}


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return repr(v) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(catalogue.oracle_sql()) - SLOW))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    found = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted(str([plain(x) for x in r]) for r in found.fetchall())
    assert sorted(str([plain(x) for x in r]) for r in df.select(*columns).collect()) == expected


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).limit(1).count() == 1


def test_theta_joins_keep_their_equi_key(spark):
    plan = catalogue.queries()["window_classify"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan

"""Every query with SQL against DuckDB, on the smallest tables."""

import duckdb
import pytest

from packwright.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    ours, theirs = catalog.queries()[name](spark, SF).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(ours) == sorted(theirs)
    text = lambda x: x[sorted(x)].astype(str).sort_values(sorted(x)).reset_index(drop=True)
    assert text(ours).equals(text(theirs))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_gives_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_retrieve_reads_texts_once(spark):
    """What is planned on has only lengths of texts, and no scan that asks for a text."""
    plan = catalog.queries()["retrieve_full"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scans = [x.split("ReadSchema:")[1] for x in plan.splitlines() if "ReadSchema:" in x]
    assert scans and not any("text:" in x for x in scans)

"""Every query runs; those with SQL give the rows that DuckDB gives."""

import pytest

from siftwell.plans import catalog
from tests.conftest import same_rows


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, duck, name):
    df = catalog.QUERIES[name](spark, data)
    if name in catalog.ORACLES:
        assert same_rows(df, duck.execute(catalog.ORACLES[name]).df())
    else:
        rows = df.collect()
        assert rows and all(any(r[c] is not None for r in rows) for c in df.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(catalog.ORACLES) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_basic_ranking_ties_rounded_utilities(spark, tmp_path):
    """Utilities that differ in the seventh digit only are ties, as in the SQL."""
    import duckdb

    values = [(1, "a", 0.0), (1, "b", 0.001), (2, "a", 0.0), (2, "b", 0.0011), (3, "a", 0.0), (3, "b", 3.0)]
    spark.createDataFrame(values, "user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    df = catalog.QUERIES["basic_metric_var"](spark, str(tmp_path))
    assert [r["item_id"] for r in df.orderBy("rank").collect()] == [3, 1, 2]
    assert same_rows(df, con.execute(catalog.ORACLES["basic_metric_var"]).df())

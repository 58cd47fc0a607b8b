import duckdb
import pytest

from genoscape.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        db.sql(f"create view {table} as from '{SF}/{table}.parquet'")
    other = db.sql(queries.oracle_sql()[name])
    mine = queries.queries()[name](spark, SF)
    assert sorted(mine.columns) == sorted(other.columns)
    assert sorted(map(tuple, mine.select(*other.columns).collect()), key=repr) == sorted(other.fetchall(), key=repr)

import os

import duckdb
import pytest

from docquarry.plans import papers, registry, rules  # noqa: F401  papers and rules add to the registry

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(TABLES):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{TABLES}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, db, name):
    df = registry.QUERIES[name](spark, TABLES)
    columns = sorted(df.columns)
    want = db.sql(registry.ORACLE[name])
    assert sorted(want.columns) == columns
    order = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=order) == sorted(want.project(",".join(columns)).fetchall(), key=order)

"""Every query against its SQL in DuckDB, on the small tables."""

import duckdb
import pytest

from lodestar import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, con, name):
    df = queries.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(str(tuple(r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    if name not in queries.oracle_sql():
        assert got
        return
    r = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert got == sorted(str(tuple(x[names.index(c)] for c in cols)) for x in r.fetchall())

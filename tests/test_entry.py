import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(x):
    if x is None or x != x:
        return None
    return x.item() if hasattr(x, "item") else x


def test_queries_match_sql(spark):
    import duckdb

    from octetlens.plans import queries as plans

    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    for name, sql in plans.ORACLE_SQL.items():
        mine, theirs = plans.QUERIES[name](spark, SF).toPandas(), con.execute(sql).fetchdf()
        columns = sorted(mine.columns)
        assert columns == sorted(theirs.columns), name
        rows = [sorted(map(repr, ([plain(x) for x in r] for r in f[columns].astype(object).itertuples(index=False)))) for f in (mine, theirs)]
        assert rows[0] == rows[1], name


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

"""The queries that have SQL against it, on the test tables and on texts made for linking."""

import os
import random

import pandas as pd
import pytest

from octetlens.llm.oracle import ORACLE_SQL
from octetlens.llm.queries import QUERIES
from octetlens.llm.secrets import secret_spans

SF = "/root/testdata/sf0.001"


def plain(x):
    if x is None or x != x:
        return None
    return x.item() if hasattr(x, "item") else x


def agree(mine, theirs) -> None:
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    mine, theirs = (sorted(repr([plain(x) for x in r]) for r in f[columns].astype(object).itertuples(index=False)) for f in (mine, theirs))
    assert mine == theirs


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    agree(QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE_SQL[name]).fetchdf())


def test_linked_secrets_match_sql(spark):
    import duckdb

    rng = random.Random(3)
    key = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    letters = "ABCDEFGHIJabcdefghij0123456789/+"
    parts = [
        lambda: "AKIA" + key(rng.choice([12, 16, 20]), "ABCDEFGH01234567"), lambda: key(rng.choice([39, 40, 41]), letters), lambda: key(rng.choice([20, 24, 40]), "0123456789abcdef"),
        lambda: rng.choice(["https", "HTTP", "ftp"]) + "://" + rng.choice(["h.example:443/x", "abc", "é.example", "example.org:123456"]),
        lambda: rng.choice(["client_id", "UserName", "login", "log"]) + rng.choice([": ", "'=\"", "  =", " "]) + key(rng.choice([2, 3, 9]), "abc_.@-"),
        lambda: rng.choice(["password", "Api_Key", "apikey", "toKen", "toKen"]) + rng.choice([" = ", "\":'", " "]) + key(rng.choice([5, 6, 30]), letters),
    ]
    filler = lambda: rng.choice([" ", "\n", "", "漢 ", " " + "é " * rng.choice([10, 150, 190, 195, 199, 201])])
    texts = [None, "", *("".join(rng.choice(parts)() + filler() for _ in range(rng.randint(1, 12))) for _ in range(1500))]
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})  # noqa: F841
    got = secret_spans(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).toPandas()
    shown = " ".join(got.spans)
    assert all(shown.count(kind) > 50 for kind in ("weak_key:", "endpoint:", "client:"))
    agree(got, duckdb.query(ORACLE_SQL["op10_secret_scan"]).fetchdf())

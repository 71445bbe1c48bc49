import math

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}") + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_gives_what_sql_gives(spark, duck, name):
    df, sql = entry.queries()[name](spark, DATA), entry.oracle_sql()[name]
    cols = sorted(df.columns)
    mine = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=str)
    assert cols == sorted(duck.sql(f"SELECT * FROM ({sql}) LIMIT 0").columns)
    theirs = sorted((tuple(map(plain, r)) for r in duck.sql(f"SELECT {', '.join(f'"{c}"' for c in cols)} FROM ({sql})").fetchall()), key=str)
    assert mine == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0

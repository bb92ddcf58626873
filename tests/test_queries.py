import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from vellumspark.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(df):
    def one(x):
        if pd.isna(x):
            return "null"
        return str(int(x)) if isinstance(x, float) and x == int(x) else str(x)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(one, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, tables, name):
    got, want = QUERIES[name](spark, SF).toPandas(), tables.execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_names_of_whole_texts(spark, tmp_path):
    texts = {1: "a" * 50 + " (b)/#%é中\n" * 30, 2: "", 3: "plain" * 20}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    keep = lambda b: 33 <= b <= 126 and chr(b) not in "()<>[]{}/%#"
    for r in QUERIES["name_round_trip"](spark, str(tmp_path)).collect():
        assert r.name == "/" + "".join(chr(b) if keep(b) else f"#{b:02X}" for b in texts[r.doc_id].encode()) and r.back == texts[r.doc_id]

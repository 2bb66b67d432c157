import re

import duckdb
import pandas as pd
import pytest

from sumiveil.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def rows(frame):
    shown = lambda v: "" if pd.isna(v) else str(v)
    return sorted(tuple(map(shown, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


def test_one_query_of_each_number():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES if n.startswith("op")) == list(range(1, 11))
    import __spark_entry__

    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", ["op2_toxicity", "op5_licenses", "op8_substrings"])
def test_query_gives_each_document(spark, name):
    out = QUERIES[name](spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert dict(out.dtypes)["doc_id"] == "bigint" and (out.count() == n or name == "op5_licenses")
    if name == "op2_toxicity":
        assert out.where("score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").count() == 0

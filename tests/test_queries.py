import duckdb
import pandas as pd
import pytest

from sumiveil import queries as Q

SF = "/root/testdata/sf0.001"


def rows(frame):
    shown = lambda v: "" if pd.isna(v) else str(round(v, 9)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(shown, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "customer", "orders", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = Q.QUERIES[name](spark, SF).toPandas()
    if name in Q.ORACLE_SQL:
        assert rows(got) == rows(duck.execute(Q.ORACLE_SQL[name]).df())


def sides(spark, folder, name, texts):
    """A query and its SQL over documents whose file has the last one first."""
    frame = pd.DataFrame({"doc_id": range(1, len(texts) + 1), "text": texts}).iloc[::-1]
    frame.to_parquet(f"{folder}/documents.parquet", index=False)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    return rows(Q.QUERIES[name](spark, str(folder)).toPandas()), rows(con.execute(Q.ORACLE_SQL[name]).df())


def test_numbers_do_not_depend_on_the_files(spark, tmp_path):
    got, sql = sides(spark, tmp_path, "mask_without_ids", ["first@b.co " * 5, *(f"u{k}@b.co" for k in range(11))])
    assert got == sql


def test_whole_words_inside_addresses_count(spark, tmp_path):
    got, sql = sides(spark, tmp_path, "whole_word_match", ["the.a@b.co the then", "x@the.co", "other"])
    assert got == sql == [("1", "2"), ("2", "1")]

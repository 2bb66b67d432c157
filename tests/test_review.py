import json

import pytest
from pyspark.sql import functions as F

from sumiveil.operators import review as V


def cells(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], "doc_id int, row int, col int, text string")


def test_counts(spark):
    spans = spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 1, "a"), (1, 2, 1, "a"), (1, 2, 1, ""), (1, 3, 1, "")], "doc_id int, row int, col int, term string")
    assert {tuple(r) for r in V.term_cell_counts(spans).collect()} == {("a", 2), ("", 1)}
    assert [tuple(r) for r in V.term_span_counts(spans).collect()] == [("a", 3)]


def test_highlight(spark):
    df = spark.createDataFrame([("a<b>c", [(1, 4, "person")])], "t string, s array<struct<begin:int,end:int,category:string>>")
    assert df.select(V.highlight("t", F.col("s")).alias("h")).first()["h"] == 'a<mark class="person">&lt;b&gt;</mark>c'


def test_blocks(spark):
    files = spark.createDataFrame([(0, "b.txt", "text", "x a@b.co {{A_1}}", ["n"], ""), (1, "b.txt", "text", "", [], "bad")], "ord int, source string, kind string, text string, attachments array<string>, error string")
    rows = V.preview_blocks(files).collect()
    assert [(r["ord"], r["kind"], len(r["spans"]), r["collisions"]) for r in rows] == [(-1, "names", 0, []), (0, "text", 1, ["{{A_1}}"]), (1, "text", 0, [])]


def test_review_list(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "text string, entity_type string")
    rows = V.compose_rows(make(("a", "PERSON"), ("1", "ID")), make(("a", "ORGANIZATION"), ("b", "LOCATION")), make(("b", "PERSON"), ("c", "PERSON")))
    assert {tuple(r) for r in rows.collect()} == {("a", "PERSON", "column"), ("b", "LOCATION", "found"), ("c", "PERSON", "manual")}
    assert {r["text"] for r in V.confirmed_rows(rows, make(("b", "LOCATION"))).collect()} == {"a", "c"}


def test_columns(spark):
    df = cells(spark, (1, 1, "氏名"), (1, 2, "番号"), (2, 1, " 山田"), (3, 1, "山田"), (4, 1, "-"), (2, 2, "7"), (3, 2, " "))
    assert {(r["col"], r["value"], r["row"]) for r in V.distinct_values(df, 1).collect()} == {(1, "山田", 2), (1, "-", 4), (2, "7", 2)}
    assert {(r["col"], r["header"], r["cells"]) for r in V.column_infos(df, 1).collect()} == {(1, "氏名", 3), (2, "番号", 1)}
    kinds = spark.createDataFrame([(1, "PERSON"), (2, "AUTO")], "col int, kind string")
    off = spark.createDataFrame([(1, "山田")], "col int, value string")
    assert [(r["col"], r["r1"], r["skip"]) for r in V.column_rules(kinds, V.distinct_values(df, 1), off, 1).collect()] == [(1, 2, ["-", "山田"])]
    assert json.loads(V.table_skeletons(df).first()["value"]) == {"file": 1, "header_row": 1, "name_cols": ["氏名"], "company_cols": []}
    assert V.table_skeletons(cells(spark, (1, 1, "a"), (1, 2, "b"))).first()["value"].startswith("# {")


def test_memory(tmp_path):
    path = str(tmp_path / "m.json")
    V.ColumnMemory(path).remember(["a", "b"], ["PERSON", "AUTO"])
    memory = V.ColumnMemory(path)
    assert memory.lookup(["a", "b"]) == (["PERSON", None], True) and memory.lookup(["b", "a"]) == ([None, "PERSON"], False)
    memory.remember(["a"], ["AUTO"])
    assert memory.lookup(["a", "x"]) == ([None, None], False)
    for k in range(120):
        memory.remember([str(k)], ["ID"])
    assert len(memory.tables) == 100 and memory.tables[0]["headers"] == ["119"]


def test_specs():
    assert V.read_table_specs('# c\n\n{"file":"x/a.csv","header_row":2}')["a.csv"]["header_row"] == 2
    with pytest.raises(ValueError, match="line 1"):
        V.read_table_specs("{}")
    assert V.resolve_columns(["a", "b", "3"], ["b", 1, "3", "9", "z"]) == ["b", "a", "3"]


def test_output(spark):
    df = cells(spark, (1, 1, "=1+1"), (1, 2, "x"))
    new = cells(spark, (1, 2, "{{ID_1}}"))
    assert {(r["col"], r["text"]) for r in V.output_cells(df, new).collect()} == {(1, "'=1+1"), (2, "{{ID_1}}")}
    written, left = V.write_back(new, df.where("col = 2"))
    assert written.count() == 0 and left.count() == 1
    plan = df.withColumn("mode", F.lit("whole"))
    assert [r["col"] for r in V.unmasked_whole_cells(plan, new).collect()] == [1]
    assert [r["text"] for r in V.changed_cells(df, new).collect()] == ["{{ID_1}}"]
    assert V.ratchet(5, 3, 0, (5, 3)) and not V.ratchet(5, 3, 1, (5, 3)) and not V.ratchet(4, 3, 0, (5, 3))

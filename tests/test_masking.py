import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sumiveil.functions.numbering import dense_numbers
from sumiveil.functions.spans import literal_hits, matches, without_contained
from sumiveil.operators import candidates as C
from sumiveil.operators import detection as D
from sumiveil.operators import evaluation as E
from sumiveil.operators import masking as M
from sumiveil.streaming.masking import mask_stream

TERMS = [(0, "山田太郎", "PERSON", False), (1, "株式会社サンプル商事", "ORGANIZATION", False), (2, "山田", "PERSON", False)]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


@pytest.mark.parametrize(
    ("text", "phones", "postals"),
    [
        ("03-1234-5678", ["03-1234-5678"], []),
        ("０３－１２３４－５６７８", ["０３－１２３４－５６７８"], []),
        ("03(1234)5678", ["03(1234)5678"], []),
        ("03 1234 5678", ["03 1234 5678"], []),
        ("+81-3-1234-5678", ["+81-3-1234-5678"], []),
        ("0312345678", ["0312345678"], []),
        ("150-0001 １５０－０００１", [], ["150-0001", "１５０－０００１"]),
        ("A-1234-5678", [], []),
        ("9876-5432", [], []),
        ("+1 (743) 555-3824", [], ["555-3824"]),
    ],
)
def test_number_forms(spark, text, phones, postals):
    row = docs(spark, text).select(D.phone_spans("text").alias("a"), D.postal_spans("text").alias("b")).first()
    assert [s["value"] for s in row["a"]] == phones and [s["value"] for s in row["b"]] == postals


@settings(max_examples=20, deadline=None)
@given(st.text(alphabet="a1@.b 𠮷あ-0", max_size=60))
def test_offsets_are_code_points(spark, text):
    for pattern in (r"[a1]+", r"@\.?", "あ"):
        for s in docs(spark, text).select(matches("text", pattern).alias("m")).first()["m"]:
            assert text[s["begin"] : s["end"]] == s["value"]


def test_long_building_chain_does_not_overflow(spark):
    row = docs(spark, "東京都あ1" + "ビル" * 1500).select(D.pattern_spans("text").alias("s")).first()
    assert [s["type"] for s in row["s"]] == ["LOCATION"]


def test_literal_hits(spark):
    row = docs(spark, "aXaXX").select(literal_hits("text", F.lit("X")).alias("h")).first()
    assert [tuple(h) for h in row["h"]] == [(1, 2), (3, 4), (4, 5)]


def test_contained_spans_go(spark):
    rows = [[("A", 0, 5), ("A", 1, 3), ("B", 1, 3), ("A", 0, 5)]]
    df = spark.createDataFrame([(r,) for r in rows], "s array<struct<type:string,begin:int,end:int>>")
    assert [tuple(x) for x in df.select(without_contained(F.col("s")).alias("s")).first()["s"]] == [("A", 0, 5), ("B", 1, 3)]


def test_mask_restore_and_gate(spark):
    given_docs = docs(spark, "山田\n太郎 と山田 a@b.co", "株式会社サン プル商事 a@b.co x@y.jp 山田太郎", None)
    out, mapping = M.mask(given_docs, TERMS)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "{{PERSON_1}} と{{PERSON_2}} {{EMAIL_1}}", 2: "{{COMPANY_1}} {{EMAIL_1}} {{EMAIL_2}} {{PERSON_1}}", 3: ""}
    assert {r["value"]: r["token"] for r in mapping.collect()} == {"山田太郎": "{{PERSON_1}}", "山田": "{{PERSON_2}}", "株式会社サンプル商事": "{{COMPANY_1}}", "a@b.co": "{{EMAIL_1}}", "x@y.jp": "{{EMAIL_2}}"}
    back = {r["doc_id"]: (r["text"], r["left_over"]) for r in M.restore(out, mapping).collect()}
    assert back[1] == ("山田太郎 と山田 a@b.co", []) and back[3] == ("", [])
    assert all(r["g"] == [] for r in out.select(M.gate("text", ["山田太郎"]).alias("g")).collect())


def test_preview_counts_what_is_masked(spark):
    given_docs = docs(spark, "山田太郎と山田", "x")
    out, _ = M.mask(given_docs, TERMS)
    tokens = out.select(F.size(M.unreplaced_tokens("text")).alias("n")).agg(F.sum("n")).first()[0]
    assert tokens == M.preview(given_docs, TERMS).count() == 2


def test_longest_term_first(spark):
    got = M.preview(docs(spark, "XABCD"), [(0, "ABCD", "PERSON", False), (1, "XA", "PERSON", False)]).collect()
    assert [(r["begin"], r["end"], r["term"]) for r in got] == [(1, 5, "ABCD")]


def test_a_term_without_a_hit_gets_no_number(spark):
    _, mapping = M.mask(docs(spark, "佐藤"), [(0, "鈴木一郎", "PERSON", False), (1, "佐藤", "PERSON", False)])
    assert [(r["value"], r["n"]) for r in mapping.collect()] == [("佐藤", 1)]


def test_one_value_has_one_token_across_kinds(spark):
    _, mapping = M.mask(docs(spark, "北海"), [(0, "北海", "PERSON", False), (1, "北海", "ORGANIZATION", False)])
    assert [r["token"] for r in mapping.collect()] == ["{{PERSON_1}}"]


def test_irreversible_labels(spark):
    out, _ = M.mask(docs(spark, "山田 a@b.co"), TERMS, reversible=False)
    assert out.first()["text"] == "[人名1] [メール1]"
    row = docs(spark, "x").select(M.placeholder(F.lit("MASKED"), F.lit(1), False).alias("p")).first()
    assert row["p"] == "[MASKED1]"


def test_gate_reports_leaks_outside_placeholders(spark):
    row = docs(spark, "{{PERSON_1}} ON 03-1234-5678 A75").select(M.gate("text", ["PERSON", "ON"], ["A7"]).alias("g")).first()
    assert row["g"] == ["ON", "03-1234-5678"]


def test_placeholders_in_sources(spark):
    row = docs(spark, "{{A_1}} [人名2] {{A_1}} [MASKED1]").select(M.existing_placeholders("text").alias("p")).first()
    assert row["p"] == ["{{A_1}}", "[人名2]"]


def sequential(text, terms):
    taken = []
    import re

    for m in re.finditer(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", text):
        taken.append(m.span())
    for t in sorted(terms, key=lambda x: -len(x)):
        core = t.replace(" ", "")
        pattern = r"\s*".join(map(re.escape, core)) if len(core) >= 4 else re.escape(t)
        for m in re.finditer(pattern, text):
            if not any(m.start() < e and m.end() > b for b, e in taken):
                taken.append(m.span())
    return sorted(taken)


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="abc \n@.", max_size=40))
def test_hits_match_a_sequential_model(spark, text):
    terms = ["abca", "bc", "a b", "cabc"]
    got = M.preview(docs(spark, text), [(i, t, "PERSON", False) for i, t in enumerate(terms)]).collect()
    assert sorted((r["begin"], r["end"]) for r in got) == sequential(text, terms)


def test_candidates(spark):
    given_docs = docs(spark, "株式会社サンプル商事、a", "株式会社サンプル商事。東京都港区芝1-2", "総務部", None).withColumn("spans", D.pattern_spans("text"))
    got = [tuple(r) for r in C.in_order(C.merge_candidates(C.document_candidates(given_docs))).collect()]
    assert got == [("株式会社サンプル商事", "ORGANIZATION", 2), ("東京都港区芝1-2", "LOCATION", 1)]


@pytest.mark.parametrize(
    ("kind", "text", "gone"),
    [
        ("PERSON", "山田1丁目", True), ("PERSON", "ク", True), ("PERSON", "林", False), ("PERSON", "msg", True), ("PERSON", "--", True),
        ("ORGANIZATION", "総務部", True), ("ORGANIZATION", "株式会社営業部", False), ("ORGANIZATION", "株式会社", True), ("LOCATION", "東京都", True), ("LOCATION", "港区二丁目", False),
    ],
)
def test_drop_gates(spark, kind, text, gone):
    df = spark.createDataFrame([(kind, text)], "k string, t string")
    none = F.array().cast("array<struct<begin:int,end:int>>")
    assert df.select(C.dropped(F.col("k"), F.col("t"), none, none).alias("x")).first()["x"] is gone


def test_trims(spark):
    row = docs(spark, "担当、株式会社 サンプル 商事／東京").select(C.trim_organisation("text").alias("o")).first()
    assert row["o"] == "株式会社 サンプル 商事"
    row = docs(spark, "150-0001 東京都港区1-2 株式会社X 03-1234-5678").select(C.trim_location("text").alias("l")).first()
    assert row["l"] == ["東京都港区1-2"]


def test_dense_numbers_cross_buckets(spark):
    df = spark.createDataFrame([("a", i * 7) for i in range(50)] + [("b", 3)], "k string, o long")
    got = dense_numbers(df, ["k"], ["o"]).where("k = 'a'").orderBy("o").collect()
    assert [r["n"] for r in got] == list(range(1, 51))


def test_entities(spark):
    rows = [(1, 0, "B-PER", 0, 2, 0.5), (1, 1, "B-PER", 2, 4, 1.0), (1, 2, "O", 4, 5, 0.2), (1, 3, "B-INS", 5, 8, 0.75)]
    df = spark.createDataFrame(rows, "doc_id int, pos int, label string, begin int, end int, score double")
    assert sorted((r["type"], r["begin"], r["end"], r["score"]) for r in D.group_entities(df).collect()) == [("LOCATION", 5, 8, 0.75), ("PERSON", 0, 4, 0.75)]


def test_evaluation(spark):
    df = docs(spark, "曲淵テクノ㈱")
    row = df.select(E.covered("text", F.array(F.lit("曲淵 テクノ株式会社x"))).alias("a"), E.covered_strict("text", F.array(F.lit("曲淵"))).alias("b"), E.round_trip("text", F.lit("曲淵 テクノ㈱")).alias("c"), E.false_mask(F.lit("ab ab"), F.lit("ab"), F.lit("ab")).alias("d")).first()
    assert tuple(row) == (True, False, "whitespace", True)


def test_stream(spark, tmp_path):
    docs(spark, "a@b.co と c@d.co").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    query = mask_stream(stream, {"a@b.co": "{{EMAIL_1}}"}).writeStream.format("memory").queryName("masked").start()
    query.processAllAvailable()
    query.stop()
    assert [(r["text"], r["leaks"]) for r in spark.table("masked").collect()] == [("{{EMAIL_1}} と c@d.co", ["c@d.co"])]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=4), min_size=20, max_size=30), st.text(alphabet="abc", max_size=40))
def test_finders_agree(needles, text):
    from sumiveil.functions.finder import Finder

    few = Finder(needles)
    few.automaton = None
    assert Finder(needles).find(text) == sorted(few.find(text))


def test_many_terms(spark):
    terms = [(k, f"term{k:03d}x", "PERSON", False) for k in range(60)]
    got = M.preview(docs(spark, "term007x te rm059x term7"), terms).collect()
    assert [r["term"] for r in got] == ["term007x", "term059x"]


def test_readings_share_the_token_of_their_name(spark):
    from sumiveil.plans.pipeline import with_readings

    aliases = spark.createDataFrame([("ヤマダタロウ", "山田太郎")], "alias string, canonical string")
    given_docs = docs(spark, "山田太郎とヤマダ タロウ")
    out, mapping = M.mask(given_docs, with_readings([(0, "山田太郎", "PERSON", False)], aliases))
    assert out.first()["text"] == "{{PERSON_1}}と{{PERSON_1}}" and [r["value"] for r in mapping.collect()] == ["山田太郎"]
    assert M.restore(out, mapping).first()["text"] == "山田太郎と山田太郎"


def test_rows_without_an_id_of_their_own(spark):
    """Null and repeated ids are masked and restored each, and no text is joined with another's tokens."""
    rows = [(1, "hi a@b.co x"), (1, "hi a@b.co x"), (2, "c@d.co"), (2, "zz e@f.co tail"), (None, "null id q@r.co"), (None, "山田太郎 q@r.co"), (None, None), (3, "no hit")]
    given_docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out, mapping = M.mask(given_docs, TERMS)
    got = sorted((r["doc_id"] or 9, r["text"]) for r in out.collect())
    assert got[0] == got[1] == (1, "hi {{EMAIL_1}} x") and got[4] == (3, "no hit") and got[5][1] == ""
    tokens = {r["value"]: r["token"] for r in mapping.collect()}
    assert {t for _, t in got} == {"hi {{EMAIL_1}} x", "", "no hit", tokens["c@d.co"], f"zz {tokens['e@f.co']} tail", f"null id {tokens['q@r.co']}", f"{tokens['山田太郎']} {tokens['q@r.co']}"}
    assert tokens["q@r.co"] == "{{EMAIL_4}}" and {tokens["c@d.co"], tokens["e@f.co"]} == {"{{EMAIL_2}}", "{{EMAIL_3}}"}
    back = sorted((r["doc_id"] or 9, r["text"]) for r in M.restore(out, mapping).collect())
    assert back == sorted((i or 9, t or "") for i, t in rows)


def test_white_space_inside_terms(spark):
    text = " 山 田\n太郎\u3000x　山田太 郎\x1c山田\x85太郎"
    got = M.TermMatcher([(0, "山田太郎", "PERSON", False), (1, "x", "ID", True)]).hits(text)
    assert [text[h["begin"] : h["end"]] for h in got] == ["山 田\n太郎", "山田太 郎", "山田\x85太郎", "x"] and M.TermMatcher([]).hits(text) == []
    assert M.TermMatcher([(0, "ab cd", "PERSON", False)]).hits("a bcd   ab\ncd")[1]["begin"] == 8


def test_leaks_are_reported_not_passed_over(spark):
    from sumiveil.plans.pipeline import LeakError, exit_status, mask_checked, require_clean

    clean, _ = mask_checked(docs(spark, "山田 {{EMAIL_1}}", "x"), TERMS)
    assert exit_status(clean) == 0 and require_clean(clean).columns == ["doc_id", "text", "existing"]
    assert {r["doc_id"]: r["existing"] for r in clean.collect()} == {1: ["{{EMAIL_1}}"], 2: []}
    leaking = clean.withColumn("leaks", F.array(F.lit("山田")))
    assert exit_status(leaking) == 3
    with pytest.raises(LeakError, match="^2 masked texts"):
        require_clean(leaking)


def test_address_without_caps(spark):
    from sumiveil.operators.detection import pattern_spans

    number, chain = "1" + "-1" * 300, "東棟" * 60
    row = docs(spark, f"東京都千代田区千代田{number}", f"大阪府北区1-1サクラビル{chain}12階です").orderBy("doc_id").select(pattern_spans("text").alias("s")).collect()
    assert [s["value"] for s in row[0]["s"]] == [f"東京都千代田区千代田{number}"] and [s["value"] for s in row[1]["s"]] == [f"大阪府北区1-1サクラビル{chain}12階"]


def test_then_orders_rows_of_one_id(spark):
    rows = [(None, k, f"u{k}@b.co") for k in (3, 1, 2)]
    _, mapping = M.mask(spark.createDataFrame(rows, "doc_id long, own long, text string"), then=("own",))
    assert {r["value"]: r["n"] for r in mapping.collect()} == {f"u{k}@b.co": k for k in (1, 2, 3)}

import io
import json
import os
import stat
import zipfile

import pytest

from sumiveil import queries as Q
from sumiveil.operators import tables as B
from sumiveil.plans.pipeline import detect, mask_checked
from sumiveil.sources import extract as X
from sumiveil.sources import files as S


def cells(spark):
    return spark.createDataFrame(Q.CELLS, "doc_id int, row int, col int, text string")


def test_sheet_golden(spark):
    out = B.sanitise(cells(spark), [("山田太郎", "PERSON"), ("佐藤 花子", "PERSON")], Q._rules(spark))
    got = {(r["row"], r["col"]): r["text"] for r in out["cells"].collect()}
    assert got == {
        (2, 1): "{{ID_1}}", (2, 2): "{{PERSON_1}}", (2, 3): "{{ADDRESS_1}}", (2, 4): "{{PHONE_1}}", (2, 6): "{{PERSON_1}}に連絡済み", (2, 7): "{{EMAIL_1}}", (2, 8): "{{ID_2}}",
        (3, 1): "{{ID_3}}", (3, 4): "{{PHONE_2}}", (3, 6): "{{PERSON_2}}を担当", (3, 8): "{{ID_4}}",
        (4, 1): "{{ID_5}}", (4, 2): " {{PERSON_2}}", (4, 3): "{{ADDRESS_2}}", (4, 4): "{{PHONE_3}}", (4, 6): "{{ID_1}} の件、A-0012 は別", (4, 8): "{{ID_6}}",
    }
    assert out["mapping"].count() == 14 and out["leaks"].count() == 0
    assert "山田太郎" in {r["value"] for r in out["excluded_leaks"].collect()}


def test_header_rows(spark):
    rows = [(1, 1, 1, "顧客一覧"), (1, 2, 1, "氏名"), (1, 2, 2, "電話"), (1, 3, 1, "山田"), (1, 3, 2, "03"), (1, 4, 1, " "), (1, 4, 2, "")]
    df = spark.createDataFrame(rows, "doc_id int, row int, col int, text string")
    assert B.first_table_row(df).first()["row"] == 2
    assert B.header_row(df, ["電話"]).first()["row"] == 2
    assert B.guess_header_row(df).first()["row"] == 2
    assert {r["row"] for r in B.table_of(df).collect()} == {3, 4}
    assert {r["row"] for r in B.table_of(df, explicit=2).collect()} == {3}


def test_density_and_runs(spark):
    df = spark.createDataFrame([(1, r, 1, "x") for r in (1, 2, 3, 7)], "doc_id int, row int, col int, text string")
    spans = spark.createDataFrame([(1, 1, 1, "email"), (1, 2, 1, "email"), (1, 3, 1, "email"), (1, 3, 1, "postal")], "doc_id int, row int, col int, category string")
    assert [tuple(r) for r in B.column_kind_from_density(df, spans).collect()] == [(1, 1, "EMAIL")]
    assert sorted((r["first"], r["last"]) for r in B.cell_runs(df).collect()) == [(1, 3), (7, 7)]


def test_full_width_headers(spark):
    df = spark.createDataFrame([("ＴＥＬ",), ("ｉｄ",), ("void",), (None,)], "h string")
    assert [r[0] for r in df.select(B.column_kind_from_header("h")).collect()] == ["PHONE", "ID", None, None]


def test_bundle_and_table_values(spark):
    files = spark.createDataFrame([(0, "b.txt", "text", "T1"), (1, "a.txt", "text", "T2"), (2, "x.xlsx", "xlsx", "")], "ord int, source string, kind string, text string")
    assert B.bundle(files).first()["text"] == "【ファイル名】\na.txt\nb.txt\n\n【b.txt】\nT1\n\n【a.txt】\nT2"
    table = spark.createDataFrame([(1, 2, 1, "氏名", "山田"), (1, 2, 2, "連絡", "a@b.co 03-1234-5678 150-0001")], "doc_id int, row int, col int, header string, text string")
    assert {(r["kind"], r["value"]) for r in B.register_table_values(table, ["氏名"], []).collect()} == {("PERSON", "山田"), ("EMAIL", "a@b.co"), ("PHONE", "03-1234-5678")}


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="urn:w"'
DOCX = zipped(**{"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>難波(なんば)</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:t>a</w:t></w:p><w:p><w:t>b</w:t></w:p></w:tc><w:tc><w:p/></w:tc><w:tc><w:p><w:t>c</w:t></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"})
XLSX = zipped(**{
    "xl/workbook.xml": '<workbook xmlns:r="urn:r"><sheets><sheet name="一" r:id="x1"/><sheet name="二" r:id="x2"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<R><r Id="x1" Target="worksheets/s1.xml"/><r Id="x2" Target="/xl/worksheets/s2.xml"/></R>',
    "xl/sharedStrings.xml": "<sst><si><t>山田</t><rPh><t>ヤマダ</t></rPh></si></sst>",
    "xl/worksheets/s1.xml": '<s><row r="3"><c r="B3" t="s"><v>0</v></c><c r="D3"><v>7</v></c></row></s>',
    "xl/worksheets/s2.xml": '<s><row r="1"><c r="A1" t="inlineStr"><is><t>z</t></is></c></row></s>',
})
PPTX = zipped(**{
    "ppt/slides/slide10.xml": "<s><spTree><sp><txBody><p><t>ten</t></p></txBody></sp></spTree></s>",
    "ppt/slides/slide2.xml": "<s><spTree><grpSp><sp><txBody><p><t>two</t></p></txBody></sp></grpSp><graphicFrame><tbl><tr><tc><t>cell</t></tc></tr></tbl></graphicFrame></spTree></s>",
    "ppt/slides/_rels/slide2.xml.rels": '<R><r Target="../notesSlides/notesSlide1.xml"/></R>',
    "ppt/notesSlides/notesSlide1.xml": '<n><sp><ph type="body"/><p><t>memo</t></p></sp><sp><ph type="sldNum"/><p><t>2</t></p></sp></n>',
})
EML = b"\r\n".join([
    b"Subject: =?utf-8?B?" + __import__("base64").b64encode("件名です".encode()) + b"?=", b"From: a@b.co", b"To: c@d.co", b"Reply-To: r@d.co", b"X-Secret: no", b"MIME-Version: 1.0", b"Content-Type: multipart/mixed; boundary=q", b"",
    b"--q", b"Content-Type: text/plain; charset=iso-2022-jp", b"", "山田です。\r\n続き。".encode("iso2022_jp"), b"--q", b"Content-Type: application/pdf; name=x.pdf", b"Content-Disposition: attachment; filename=x.pdf", b"", b"secret", b"--q--", b"",
])


def test_extractors():
    assert X.docx(DOCX) == "難波\na\nb\tc"
    assert X.pptx(PPTX) == "two\ncell\n[ノート] memo\nten"
    assert X.xlsx(XLSX) == "山田\t7\nz"
    assert X.xlsx_cells(XLSX, "二") == [(1, 1, "z")] and X.xlsx_cells(XLSX, "?") == [(3, 2, "山田"), (3, 4, "7")]
    assert X.csv_rows('a,"b\nc""d"\n\ne\n') == [["a", 'b\nc"d'], ["e"]]
    got = X.eml(EML)
    assert got["text"] == "件名: 件名です\n差出人: a@b.co\n宛先: c@d.co\n\n【ヘッダ】\nReply-To: r@d.co\n\n山田です。続き。\n\n【添付ファイル】\nx.pdf"
    assert X.eml(b"Content-Type: text/plain; charset=x-odd\n\nabc")["error"] == "the body's charset is not supported"
    assert X.eml(b"Subject: a\n\n  \n")["error"] == "there is no body"
    assert X.extract("a/b.PDF", b"")["kind"] == "skipped" and X.extract("b.docx", b"broken")["error"] == "BadZipFile"


def test_read_files(spark, tmp_path):
    for name, data in (("a.docx", DOCX), ("b.xlsx", XLSX), ("c.csv", "氏名,電話\n山田,03\n".encode("cp932")), ("d.bin", b"x")):
        (tmp_path / name).write_bytes(data)
    got = {r["source"]: (r["kind"], r["text"]) for r in S.read_files(spark, str(tmp_path)).collect()}
    assert got["a.docx"] == ("docx", "難波\na\nb\tc") and got["d.bin"] == ("skipped", "") and got["c.csv"][1].startswith("氏名")
    got = {(r["doc_id"], r["row"], r["col"]): r["text"] for r in S.read_cells(spark, [str(tmp_path / "b.xlsx"), str(tmp_path / "c.csv")]).collect()}
    assert got["c.csv", 2, 1] == "山田" and got["b.xlsx", 3, 2] == "山田"


@pytest.mark.parametrize("body", ["", "x", "[1]", '{"token":"a"}', '{"token":"a","original":1}', '{"token":"a","original":""}', '{"token":"a","original":"b"}\n{"token":"a","original":"c"}', '{"_meta":{"version":3}}'])
def test_bad_mappings_are_refused(body):
    with pytest.raises(ValueError) as e:
        S.parse_mapping(body)
    assert "original\":\"b" not in str(e.value)


def test_mapping_round_trip(spark, tmp_path):
    mapping = spark.createDataFrame([("山田", "PERSON", 1, "{{PERSON_1}}")], "value string, kind string, n int, token string")
    path = tmp_path / "m.jsonl"
    path.write_text("old")
    S.write_mapping(mapping, str(path))
    assert stat.S_IMODE(os.stat(path).st_mode) == 0o600
    assert S.parse_mapping("# c\n\n" + path.read_text() + '{"more": 1}\n{"token":"{{PERSON_1}}","original":"山田"}') == [("山田", "{{PERSON_1}}")]
    assert S.read_mapping(spark, str(path)).count() == 1
    with pytest.raises(S.NeedsPassphrase):
        S.parse_mapping(json.dumps({"_meta": {"version": 2}}) + "\nabc")
    assert set(S.PASSPHRASE_LETTERS) == set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") - set("ILO01") and len(S.passphrase()) == 23 and not S.is_encrypted("junk")


def test_candidate_rows():
    assert S.read_candidates('# x\n\n{"type":"PERSON","text":"a","count":1}\n{"type":"PERSON"}') == [{"type": "PERSON", "text": "a", "count": 1}]
    with pytest.raises(ValueError, match="line 1"):
        S.read_candidates("{")


def test_whole_way(spark):
    docs = spark.createDataFrame([(1, "株式会社サンプル商事、03-1234-5678"), (2, "")], "doc_id long, text string")
    terms = [(i, r["text"], r["entity_type"], False) for i, r in enumerate(detect(docs).collect())]
    out, _ = mask_checked(docs, terms)
    assert {r["doc_id"]: (r["text"], r["leaks"]) for r in out.collect()} == {1: ("{{COMPANY_1}}、{{PHONE_1}}", []), 2: ("", [])}


def test_sheets_keep_to_themselves(spark):
    """Values of one sheet are no terms in another; numbers go sheet by sheet; a null doc_id is a sheet, too."""
    rows = [(2, 1, 1, "山田"), (2, 2, 2, "山田 佐藤"), (1, 1, 1, "佐藤"), (1, 2, 2, "山田 佐藤"), (None, 1, 1, "鈴木"), (None, 2, 2, "鈴木 佐藤")]
    sheets = spark.createDataFrame(rows, "doc_id long, row int, col int, text string")
    rules = spark.createDataFrame([(0, 1, 1, 1, "PERSON", [])], "ord int, col int, r1 int, r2 int, kind string, skip array<string>")
    out = B.sanitise(sheets, [], rules)
    assert {(r["doc_id"], r["row"]): r["text"] for r in out["cells"].collect()} == {(1, 1): "{{PERSON_1}}", (1, 2): "山田 {{PERSON_1}}", (2, 1): "{{PERSON_2}}", (2, 2): "{{PERSON_2}} 佐藤", (None, 1): "{{PERSON_3}}", (None, 2): "{{PERSON_3}} 佐藤"}
    assert out["leaks"].count() == 0

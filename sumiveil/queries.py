"""Driver queries over the test tables and small Japanese fixtures, with SQL that computes the same."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sumiveil.functions import patterns as P
from sumiveil.functions import text as T
from sumiveil.functions.charset import decode_charset, decode_text
from sumiveil.operators import candidates as C
from sumiveil.operators import detection as D
from sumiveil.operators import evaluation as E
from sumiveil.operators import masking as M
from sumiveil.operators import review as R
from sumiveil.operators import tables as B
from sumiveil.plans.pipeline import exit_status, mask_checked
from sumiveil.session import shared_dir
from sumiveil.sources import files as S
from sumiveil.streaming.masking import mask_stream

CELLS = [
    (1, 1, 1, "ID"), (1, 1, 2, "氏名"), (1, 1, 3, "住所"), (1, 1, 4, "電話"), (1, 1, 5, "備考"), (1, 1, 6, "メモ"), (1, 1, 7, "メール"), (1, 1, 8, "No"),
    (1, 2, 1, "A-001"), (1, 2, 2, "山田太郎"), (1, 2, 3, "〒100-0001 東京都千代田区千代田1-1"), (1, 2, 4, "内線1234"), (1, 2, 5, "山田太郎に連絡済み"), (1, 2, 6, "山田太郎に連絡済み"), (1, 2, 7, "taro@example.jp"), (1, 2, 8, "1"),
    (1, 3, 1, "A-002"), (1, 3, 2, "なし"), (1, 3, 3, "-"), (1, 3, 4, "03-1234-5678"), (1, 3, 5, "A-001 の件"), (1, 3, 6, "佐藤花子を担当"), (1, 3, 7, "-"), (1, 3, 8, "2"),
    (1, 4, 1, "A-003"), (1, 4, 2, " 佐藤 花子"), (1, 4, 3, "大阪府大阪市北区1-1"), (1, 4, 4, "090-1111-2222"), (1, 4, 6, "A-001 の件、A-0012 は別"), (1, 4, 8, "3"),
]
SANITISED = [
    (2, 1, "{{ID_1}}"), (2, 2, "{{PERSON_1}}"), (2, 3, "{{ADDRESS_1}}"), (2, 4, "{{PHONE_1}}"), (2, 6, "{{PERSON_1}}に連絡済み"), (2, 7, "{{EMAIL_1}}"), (2, 8, "{{ID_2}}"),
    (3, 1, "{{ID_3}}"), (3, 4, "{{PHONE_2}}"), (3, 6, "{{PERSON_2}}を担当"), (3, 8, "{{ID_4}}"),
    (4, 1, "{{ID_5}}"), (4, 2, " {{PERSON_2}}"), (4, 3, "{{ADDRESS_2}}"), (4, 4, "{{PHONE_3}}"), (4, 6, "{{ID_1}} の件、A-0012 は別"), (4, 8, "{{ID_6}}"),
]
CANDIDATES = [("総務部と（株）", "ORGANIZATION", 1), ("サンプル商事株式会社", "ORGANIZATION", 1), ("株式会社サンプル商事", "ORGANIZATION", 2), ("（株）テスト", "ORGANIZATION", 1), ("東京都千代田区千代田1-1サクラビル3階", "LOCATION", 1), ("大阪府大阪市北区1-1", "LOCATION", 1)]
RULES = [(0, 1, 2, 4, "ID", ""), (1, 2, 2, 4, "PERSON", "なし"), (2, 3, 2, 4, "LOCATION", "-"), (3, 4, 2, 4, "PHONE", ""), (4, 5, 2, 4, "NONE", ""), (5, 7, 2, 4, "EMAIL", ""), (6, 8, 2, 4, "ID", "")]
NUMBERS = [
    (1, "お問い合わせは 03-1234-5678 まで"), (2, "全角 ０３－１２３４－５６７８ です"), (3, "括弧 03(1234)5678"), (4, "空白 03 1234 5678 。"), (5, "国番号 +81-3-1234-5678"),
    (6, "続き 0312345678、150-0001"), (7, "１５０－０００１"), (8, "A-1234-5678 と 9876-5432"), (9, "taro@example.jp へ 090-1111-2222"),
]
PROSE = [
    (1, "株式会社サンプル商事、担当は山田。東京都千代田区千代田1-1サクラビル3階"), (2, "連絡先: サンプル商事株式会社 a@example.jp"), (3, "大阪府大阪市北区1-1、株式会社サンプル商事"), (4, "難波(なんば)さん\n折り返し\n\nこの行は\n続く。"), (5, "総務部と（株）テスト"),
]
HEADERS = ["氏名", "ふりがな", "会社名", "住所", "電話番号", "メールアドレス", "郵便番号", "社員番号", "ID", "備考", "TEL", "NO.", "VOID"]
LABELS = [(1, 0, "B-PER", 0, 2, 0.5), (1, 1, "B-PER", 2, 4, 1.0), (1, 2, "O", 4, 5, 0.25), (1, 3, "B-INS", 5, 8, 0.75), (1, 4, "O", 8, 9, 0.5), (2, 0, "B-ORG", 0, 3, 0.5), (2, 1, "B-LOC", 3, 5, 0.25)]
ENTITIES = [(1, "サンプル商事㈱", "サンプル商事株式会社"), (2, "山田 太郎", "山田"), (3, "灰田涼", "灰田"), (4, "北", "東"), (5, "", "東")]
CASE = [(3, "b.txt", "txt", "second"), (1, "a.eml", "eml", "first\nline"), (2, "t.xlsx", "xlsx", "rows"), (4, "", "txt", "nameless"), (5, "c.txt", "txt", "")]
TERMS = [(0, "idiot", "PERSON", False), (1, "worthless", "ORGANIZATION", False), (2, "the", "ID", True)]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _rows(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _values(rows) -> str:
    shown = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows)


def _cells(spark):
    return _rows(spark, CELLS, "doc_id int, row int, col int, text string")


def _rules(spark):
    return _rows(spark, [(*r[:5], [r[5]] if r[5] else []) for r in RULES], "ord int, col int, r1 int, r2 int, kind string, skip array<string>")


def email_spans(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.explode(D.email_spans("text")).alias("s")).select("doc_id", F.col("s.begin").alias("begin_at"), F.col("s.end").alias("end_at"), "s.value")


def postal_values(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.explode(D.postal_spans("text")).alias("s")).groupBy("doc_id", F.col("s.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def phone_values(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "text").union(_rows(spark, NUMBERS, "doc_id int, text string"))
    return docs.select("doc_id", F.explode(D.phone_spans("text")).alias("s")).select("doc_id", "s.value")


def email_mapping(spark, sf_dir):
    return M.mask(_docs(spark, sf_dir))[1].where("kind = 'EMAIL'").select("value", "n", "token")


def mask_documents(spark, sf_dir):
    return M.mask(_docs(spark, sf_dir))[0].select("doc_id", "text")


def redact_documents(spark, sf_dir):
    return M.mask(_docs(spark, sf_dir), reversible=False)[0].select("doc_id", "text")


def mask_without_ids(spark, sf_dir):
    """Every document three times: under its id, under none and under one that all share; in order of the documents' own ids."""
    docs = _docs(spark, sf_dir).select("doc_id", "text", F.col("doc_id").alias("own"))
    three = docs.union(docs.withColumn("doc_id", F.lit(None).cast("long"))).union(docs.withColumn("doc_id", F.lit(-1).cast("long")))
    out, mapping = M.mask(three, then=("own",))
    back = M.restore(out, mapping)
    return out.groupBy(F.coalesce("doc_id", F.lit(-2)).alias("id"), "text").count().withColumn("masked", F.lit(True)).unionByName(back.groupBy(F.coalesce("doc_id", F.lit(-2)).alias("id"), "text").count().withColumn("masked", F.lit(False))).where("id < 0 or not masked").groupBy("masked", "id").agg(F.sum("count").alias("n"), F.sum(F.length("text") * F.col("count")).alias("chars"), F.sum(F.regexp_count("text", F.lit(M.P.EMAIL)) * F.col("count")).alias("emails"))


def restore_roundtrip(spark, sf_dir):
    out, mapping = M.mask(_docs(spark, sf_dir))
    back = M.restore(out, mapping).select("doc_id", F.col("text").alias("restored"), F.size("left_over").cast("long").alias("left_over"))
    return out.select("doc_id", F.size(M.unreplaced_tokens("text")).cast("long").alias("tokens")).join(back, "doc_id")


def safety_gate(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    before = docs.select("doc_id", F.size(M.gate("text")).cast("long").alias("before"))
    after = M.mask(docs)[0].select("doc_id", F.size(M.gate("text", ["idiot"])).cast("long").alias("after"))
    return before.join(after, "doc_id")


def checked_documents(spark, sf_dir):
    """What the gate finds in documents masked but for one term, and the exit status."""
    out, _ = mask_checked(_docs(spark, sf_dir), [(0, "worthless", "ORGANIZATION", False)])
    out = out.withColumn("leaks", F.concat("leaks", M.gate("text", ["idiot"])))
    return out.where(F.size("leaks") > 0).select("doc_id", F.explode("leaks").alias("value"), F.lit(exit_status(out)).alias("status"))


def raw_gate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.explode(M.gate("text", ["idiot", "worthless"])).alias("value"))


def placeholders(spark, sf_dir):
    rows = [(1, "{{PERSON_1}} と [人名2] と {{PERSON_1}}"), (2, "[MASKED1] {{a_1}}"), (3, "{{EMAIL_10}}")]
    return _rows(spark, rows, "doc_id int, text string").select("doc_id", F.explode(M.existing_placeholders("text")).alias("token"))


def html_to_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.html_to_text("html").alias("text"))


def text_scalars(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", T.char_count(t).cast("long").alias("chars"), F.size(T.split_lines(t)).cast("long").alias("lines"), T.has_letter(t).alias("letters"), T.symbol_only(t).alias("symbols"), F.char_length(T.strip_spaces(t)).cast("long").alias("tight"), T.cut(t, 3, 9).alias("piece"), T.trim(t).alias("trimmed"))


def prose_scalars(spark, sf_dir):
    return _rows(spark, PROSE, "doc_id int, text string").select("doc_id", T.dewrap_prose(T.strip_ruby("text")).alias("text"), T.katakana_to_hiragana("text").alias("hiragana"))


def chunk_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.explode(T.chunks("text")).alias("c")).select("doc_id", "c.base", F.char_length("c.text").alias("n_chars"))


def confirmed_match(spark, sf_dir):
    return M.preview(_docs(spark, sf_dir), TERMS[:2]).where("term <> ''").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


def whole_word_match(spark, sf_dir):
    """Every place of a term as a whole word, those inside addresses too, which a preview leaves to the address."""
    return _docs(spark, sf_dir).select("doc_id", F.size(M.term_hits("text", TERMS[2:])).cast("long").alias("n")).where("n > 0")


def pattern_spans(spark, sf_dir):
    return _rows(spark, PROSE, "doc_id int, text string").select("doc_id", F.explode(D.pattern_spans("text")).alias("s")).select("doc_id", "s.type", "s.value")


def candidates(spark, sf_dir):
    docs = _rows(spark, PROSE, "doc_id int, text string").withColumn("spans", D.pattern_spans("text"))
    return C.merge_candidates(C.document_candidates(docs))


def group_entities(spark, sf_dir):
    return D.group_entities(_rows(spark, LABELS, "doc_id int, pos int, label string, begin int, end int, score double")).select("doc_id", "type", F.col("begin").alias("begin_at"), F.col("end").alias("end_at"), F.col("score").cast("double").alias("score"))


def column_kinds(spark, sf_dir):
    return _rows(spark, [(h,) for h in HEADERS], "header string").select("header", B.column_kind_from_header("header").alias("kind"), B.guess_column("header").alias("guess"))


def header_rows(spark, sf_dir):
    return B.header_row(_cells(spark), ["氏名", "電話"])


def table_rows(spark, sf_dir):
    return B.first_table_row(_cells(spark))


def cell_plan(spark, sf_dir):
    return B.cell_plan(_cells(spark), _rules(spark)).select("row", "col", "mode", "kind", "value", "lead")


def cell_runs(spark, sf_dir):
    return B.cell_runs(_cells(spark)).select("col", F.col("first").alias("first_row"), F.col("last").alias("last_row"))


def column_density(spark, sf_dir):
    cells = _cells(spark).where("row > 1")
    spans = cells.select("doc_id", "row", "col", F.explode(M.mask_hits("text")).alias("h")).select("doc_id", "row", "col", F.lower("h.kind").alias("category"))
    return B.column_kind_from_density(cells, spans).select("col", "kind")


def sheet_sanitise(spark, sf_dir):
    return B.sanitise(_cells(spark), [("山田太郎", "PERSON"), ("佐藤 花子", "PERSON")], _rules(spark))["cells"].select("row", "col", "text")


def sheet_mapping(spark, sf_dir):
    return B.sanitise(_cells(spark), [("山田太郎", "PERSON"), ("佐藤 花子", "PERSON")], _rules(spark))["mapping"].groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def excluded_leaks(spark, sf_dir):
    return B.sanitise(_cells(spark), [("山田太郎", "PERSON"), ("佐藤 花子", "PERSON")], _rules(spark))["excluded_leaks"].select("value")


def source_names(spark, sf_dir):
    return B.source_names(_docs(spark, sf_dir).select("source", F.lit("txt").alias("kind")))


def bundle(spark, sf_dir):
    return B.bundle(_rows(spark, CASE, "ord int, source string, kind string, text string"))


def coverage(spark, sf_dir):
    rows = _rows(spark, ENTITIES, "id int, expected string, found string")
    return rows.select("id", E.covered("expected", F.array("found")).alias("loose"), E.covered_strict("expected", F.array("found")).alias("strict"), E.occurrences("found", F.lit("田")).alias("n"))


def stream_mask(spark, sf_dir):
    """Documents as a stream, masked with a frozen mapping, written by the streaming sink and read back."""
    known = _docs(spark, sf_dir).select(F.explode(D.email_spans("text")).alias("s")).where("s.value < 'm'").select("s.value").distinct()
    mapping = {v: f"{{{{EMAIL_{k}}}}}" for k, v in enumerate(sorted(r["value"] for r in known.collect()), 1)}  # of a size that a person has reviewed
    docs = spark.readStream.schema(_docs(spark, sf_dir).schema).parquet(f"{sf_dir}/documents*.parquet")  # a file or a folder: a stream takes no single file
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    masked = mask_stream(docs.select("doc_id", "text"), mapping)
    masked.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("doc_id", "text", F.size(F.filter("leaks", lambda v: v.contains("@"))).cast("long").alias("emails_left"))


def mapping_rows(spark, sf_dir):
    """The mapping of the documents' addresses as lines of its file, parsed again."""
    lines = M.mask(_docs(spark, sf_dir))[1].where("kind = 'EMAIL'").select(F.to_json(F.struct("token", F.col("value").alias("original"))).alias("line"))
    body = "\n".join(['{"_meta": {"version": 1}}', "# comment", "", *(r["line"] for r in lines.toLocalIterator())])
    return _rows(spark, S.parse_mapping(body), "value string, token string")


def eml_documents(spark, sf_dir):
    """Every document as a message with an encoded subject, two bodies and an attachment."""
    b64 = lambda c: F.base64(F.encode(c, "UTF-8"))
    part = lambda *lines: F.concat_ws("\r\n", *[x if isinstance(x, Column) else F.lit(x) for x in lines])
    subject = F.concat(F.lit("Subject: =?UTF-8?B?"), b64(F.concat(F.lit("件名 "), F.col("doc_id").cast("string"))), F.lit("?="))
    message = part(subject, "From: a@b.co", "To: c@d.co", "Cc:", "Reply-To: r@d.co", "X-Secret: no", "MIME-Version: 1.0", "Content-Type: multipart/mixed; boundary=q", "",
        "--q", "Content-Type: text/html; charset=utf-8", "Content-Transfer-Encoding: base64", "", b64(F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>"))),
        "--q", "Content-Type: text/plain; charset=utf-8", "Content-Transfer-Encoding: base64", "", b64(F.regexp_replace("text", "[\r。]", "")),
        "--q", "Content-Type: application/pdf; name=x.pdf", "Content-Disposition: attachment; filename=x.pdf", "", "secret", "--q--", "")
    return S.parse_files(_docs(spark, sf_dir).where("trim(text) <> ''").select(F.concat(F.lit("m/"), "doc_id", F.lit(".eml")).alias("path"), F.encode(message, "UTF-8").alias("content"))).select("source", "kind", "text", F.array_join("attachments", ",").alias("attachments"), "error")


def decoded_documents(spark, sf_dir):
    """Bytes in several charsets back to text: with a byte-order mark, cp932 where the text allows, and named ones."""
    docs = _docs(spark, sf_dir).select("doc_id", F.col("text").alias("t"))
    utf = F.encode("t", "UTF-8")
    out = docs.select("doc_id", decode_text(F.concat(F.unhex(F.lit("EFBBBF")), utf)).alias("marked"), decode_text(utf).alias("plain"), decode_charset(F.lit('"UTF-8"'), utf).alias("named"), decode_charset(F.lit("x-odd"), utf).alias("odd"), decode_charset(F.lit("latin1"), utf).alias("latin"))
    return out.select("doc_id", "marked", "plain", F.col("named.text").alias("named"), F.col("odd.ok").alias("odd"), F.char_length("latin.text").alias("bytes"))


def csv_cells(spark, sf_dir):
    """Every customer segment's accounts as a csv file with quotes and breaks in its cells, read to cells."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_mktsegment", "c_custkey", "c_name", "c_acctbal")
    line = F.concat(F.lit('"'), F.replace("c_name", F.lit("#"), F.lit('""')), F.lit('","a\nb, '), F.col("c_custkey").cast("string"), F.lit('",'), F.col("c_custkey").cast("string"), F.lit("\n"))
    files = rows.groupBy("c_mktsegment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("l")))), lambda x: x["l"]), "").alias("body"))
    return S.parse_cells(files.select(F.concat(F.lit("d/"), "c_mktsegment", F.lit(".csv")).alias("path"), F.encode("body", "UTF-8").alias("content")))


def more_scalars(spark, sf_dir):
    t, n = F.col("text"), F.col("doc_id")
    return _docs(spark, sf_dir).select(
        "doc_id", F.char_length(T.strip_all_whitespace(t)).cast("long").alias("dense"), T.regex_escape(F.left(t, F.lit(60))).alias("escaped"), T.strip_set(F.left(t, F.lit(30)), "aeT .").alias("stripped"),
        T.to_int(F.concat(F.lit(" "), n.cast("string"), F.lit("x"))).alias("number"), T.hex_to_int(F.concat(F.lit("0x"), F.lower(F.hex(n)))).alias("hexed"), T.to_int(t, -7).alias("nothing"),
        T.is_single_kanji(F.substring(t, 2, 1)).alias("kanji"), T.is_file_extension(F.element_at(F.array(F.lit("PDF"), F.lit("exe"), F.lit("docx")), (n % 3 + 1).cast("int"))).alias("file"),
        T.column_letter(n % 700 + 1).alias("letter"), T.column_index(F.concat(T.column_letter(n % 700 + 1), F.lit("7"))).cast("long").alias("column"),
        F.decode(T.base64_lenient(F.concat(F.lit("\n "), F.base64(F.encode(t, "UTF-8")))), "UTF-8").alias("decoded"), T.unfold_headers(F.concat(F.lit("A: b\r\n c\nD: "), F.left(t, F.lit(9)))).alias("unfolded"),
        T.repair_utf8(F.encode(t, "UTF-8")).alias("repaired"), T.normalise_entity(F.concat(F.lit("㈱ "), F.left(t, F.lit(20)))).alias("entity"),
        T.name_with_address(F.col("source"), F.when(n % 2 == 0, F.lit("/O=ORG/ou=x/cn=y")).otherwise(F.lit("a@b.co"))).alias("address"), T.exchange_address(F.lit("/o=Org/cn=z")).alias("exchange"),
        R.escape_html(t).alias("html"),
    )


def highlighted(spark, sf_dir):
    spans = F.transform(D.email_spans("text"), lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"), F.lit("email").alias("category")))
    return _docs(spark, sf_dir).select("doc_id", R.highlight(F.col("text"), spans).alias("html"), R.replace_spans(F.col("text"), spans, "#").alias("blotted"))


def review_counts(spark, sf_dir):
    """Cells and spans of each term over documents taken as rows of a sheet."""
    spans = M.preview(_docs(spark, sf_dir), TERMS).select(F.lit(1).alias("doc_id"), F.col("doc_id").alias("row"), F.lit(1).alias("col"), "term")
    return R.term_cell_counts(spans).join(R.term_span_counts(spans), "term", "left").fillna(0, ["spans"])


def column_review(spark, sf_dir):
    cells = _cells(spark)
    infos = R.column_infos(cells, 1)
    return R.distinct_values(cells, 1).groupBy("doc_id", "col").agg(F.count(F.lit(1)).alias("distinct")).join(infos, ["doc_id", "col"]).select("col", "header", "cells", "distinct")


def review_rows(spark, sf_dir):
    """The review list of nations and regions: dictionary columns first, then candidates, then manual entries, less the unchecked."""
    names = lambda table, column, kind: spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(column).alias("text"), F.lit(kind).alias("entity_type"))
    nations, regions = names("nation", "n_name", "LOCATION"), names("region", "r_name", "ORGANIZATION")
    manual = nations.where("text < 'G'").withColumn("entity_type", F.lit("PERSON")).union(_rows(spark, [("extra", "PERSON")], "text string, entity_type string"))
    return R.confirmed_rows(R.compose_rows(nations.where("text > 'C'"), regions, manual), nations.where("text like 'I%'"))


def sheet_output(spark, sf_dir):
    """Order lines as a sheet: changed cells put back, formulas left alone and made harmless in the copy."""
    lines = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.lit(1).alias("doc_id"), F.col("o_orderkey").cast("int").alias("row"), "o_orderpriority", "o_orderstatus")
    cells = lines.select("doc_id", "row", F.lit(1).alias("col"), F.concat(F.lit("="), "o_orderstatus").alias("text")).union(lines.select("doc_id", "row", F.lit(2), F.col("o_orderpriority")))
    changed = cells.where("row % 3 = 0").withColumn("text", F.concat(F.lit("x"), "text"))
    written, left = R.write_back(changed, cells.where("col = 1"))
    plan = cells.withColumn("mode", F.when(F.col("col") == 1, "whole").otherwise("normal"))
    kinds = ((R.output_cells(cells, changed), "copy"), (written, "written"), (left, "left"), (R.changed_cells(cells, changed.union(cells.where("row % 3 = 1"))), "changed"))
    every = [df.select(F.lit(kind).alias("kind"), "row", "col", "text") for df, kind in kinds]
    every.append(R.unmasked_whole_cells(plan, changed).select(F.lit("open").alias("kind"), "row", "col", F.lit("").alias("text")))
    return functools.reduce(DataFrame.union, every)


QUERIES = {f.__name__: f for f in (email_spans, postal_values, phone_values, email_mapping, mask_documents, redact_documents, restore_roundtrip, safety_gate, raw_gate, placeholders, html_to_text, text_scalars, prose_scalars, chunk_text, confirmed_match, whole_word_match, pattern_spans, candidates, group_entities, column_kinds, header_rows, table_rows, cell_plan, cell_runs, column_density, sheet_sanitise, sheet_mapping, excluded_leaks, source_names, bundle, coverage, stream_mask, mask_without_ids, checked_documents, mapping_rows, eml_documents, decoded_documents, csv_cells, more_scalars, highlighted, review_counts, column_review, review_rows, sheet_output)}

_E = P.EMAIL.replace("'", "''")
# RE2 knows no lookaround: the neighbours are matched and left out of group 1.
_POSTAL = r"(?:^|[^\p{Nd}\-－])(\p{Nd}{3}[-－‐‑−–—]\p{Nd}{4})(?:$|[^\p{Nd}\-－])"
_SEP = "[-－‐‑−–— 　]"
_PHONE = rf"(?:^|[^\p{{Nd}}\-－])((?:[+＋]81{_SEP}?\p{{Nd}}{{1,4}}{_SEP}\p{{Nd}}{{1,4}}{_SEP}\p{{Nd}}{{3,4}}|[0０]\p{{Nd}}{{1,4}}{_SEP}\p{{Nd}}{{1,4}}{_SEP}\p{{Nd}}{{3,4}}|[0０]\p{{Nd}}{{1,4}}[(（]\p{{Nd}}{{1,4}}[)）]\p{{Nd}}{{3,4}}|[0０]\p{{Nd}}{{9,10}}))(?:$|[^\p{{Nd}}\-－])"
_HITS = f"""
    SELECT doc_id, value, begin_at, begin_at + length(value) AS end_at FROM (
      SELECT doc_id, v[i] AS value, CAST(list_sum([length(s) for s in p[1:i]]) + coalesce(list_sum([length(s) for s in v[1:i - 1]]), 0) AS INTEGER) AS begin_at
      FROM (SELECT doc_id, v, p, unnest(generate_series(1, len(v))) AS i FROM (
        SELECT doc_id, regexp_extract_all(text, '{_E}') AS v, regexp_split_to_array(text, '{_E}') AS p FROM documents)))"""
_WORD = r"[0-9A-Za-z\x{80}-\x{9F}\x{C0}-\x{1FFF}\x{2070}-\x{2DFF}\x{3040}-\x{30FA}\x{30FC}-\x{FEFF}]"
_NOT_WORD = "[^" + _WORD[1:]
# Fixed values, in the dialect of RE2.
_FORMS = "株式会社|有限会社|合同会社|合名会社|合資会社|一般社団法人|一般財団法人|公益社団法人|公益財団法人|協同組合|（株）|\\(株\\)|（有）|\\(有\\)"
_COMPANY_BEFORE = f"(?:{_FORMS})\\s?[一-龥々〆ヶぁ-んァ-ヶー・ゝゞ0-9０-９a-zA-Zａ-ｚＡ-Ｚ]{{1,25}}"
_COMPANY_AFTER = f"[一-龥々〆ヶぁ-んァ-ヶー・ゝゞ0-9０-９a-zA-Zａ-ｚＡ-Ｚ]{{1,25}}\\s?(?:{_FORMS}|㈱|㈲)"
_BUILDING = "(?:ビルディング|ビル|タワー|センター|オフィス|プラザ|マンション|ハイツ|コーポ|棟)"
_ADDRESS = (
    "(?:北海道|東京都|京都府|大阪府|[一-龥]{2,3}県)[一-龥ぁ-んァ-ヶー]{1,16}?[0-9０-９][0-9０-９丁目番地号条\\-－ー−―‐]*"
    "(?:[ 　]?[0-9０-９A-Za-zＡ-Ｚａ-ｚ一-龥ァ-ヶ・ー][0-9０-９A-Za-zＡ-Ｚａ-ｚ一-龥ぁ-んァ-ヶ・ー]{0,24}?" + _BUILDING
    + "(?:[0-9０-９A-Za-zＡ-Ｚａ-ｚ一-龥ぁ-んァ-ヶ・ー]{0,24}?" + _BUILDING + ")*(?:[0-9０-９]{1,4}(?:階|Ｆ|F|号室|号)?)?)?"
)
_PROSE = f"(SELECT * FROM (VALUES {_values(PROSE)}) t(doc_id, text))"
_SPANS = f"""
    SELECT doc_id, 'ORGANIZATION' AS type, unnest(regexp_extract_all(text, '{_COMPANY_BEFORE}')) AS value FROM {_PROSE}
    UNION ALL SELECT doc_id, 'ORGANIZATION', unnest(regexp_extract_all(text, '{_COMPANY_AFTER}')) FROM {_PROSE}
    UNION ALL SELECT doc_id, 'LOCATION', unnest(regexp_extract_all(text, '{_ADDRESS}')) FROM {_PROSE}"""
_CELLS = f"(SELECT * FROM (VALUES {_values(CELLS)}) t(doc_id, row, col, text))"
_RULES = f"(SELECT * FROM (VALUES {_values(RULES)}) r(ord, rcol, r1, r2, kind, skip))"
_PLAN = f"""
    SELECT c.row, c.col, c.text, trim(c.text) AS v, arg_max(r.kind, r.ord) AS kind, arg_max(r.skip, r.ord) AS skip
    FROM {_CELLS} c LEFT JOIN {_RULES} r ON c.col = r.rcol AND c.row BETWEEN r.r1 AND r.r2 GROUP BY c.row, c.col, c.text"""
_MODED = f"""
    SELECT row, col, text, v, kind, CASE WHEN kind IS NULL THEN 'normal' WHEN kind = 'NONE' THEN 'excluded'
      WHEN v = skip OR NOT regexp_matches(v, '{_WORD}') THEN 'normal' ELSE 'whole' END AS mode FROM ({_PLAN})"""
_KIND = """CASE WHEN regexp_matches(h, '郵便') THEN NULL WHEN regexp_matches(h, 'メール|MAIL') THEN 'EMAIL' WHEN regexp_matches(h, '電話|TEL|携帯|FAX|ファックス|内線') THEN 'PHONE'
    WHEN regexp_matches(h, '住所|所在地|宛先|送付先') THEN 'LOCATION' WHEN regexp_matches(h, '会社|法人|取引先|企業|団体|組織名|勤務先') THEN 'ORGANIZATION'
    WHEN regexp_matches(h, '氏名|名前|姓名|担当者|申請者|代表者|責任者|作成者|承認者|依頼者|紹介者|フリガナ|ふりがな') THEN 'PERSON'
    WHEN regexp_matches(h, '番号|コード|ナンバー|(^|[^A-Z])ID($|[^A-Z])|(^|[^A-Z])NO\\.?($|[^A-Z])|№') THEN 'ID' END"""
_KATA = "".join(map(chr, range(0x30A1, 0x30F7)))
_HIRA = "".join(chr(ord(c) - 0x60) for c in _KATA)
_BLANKS = r"[ \t\r\n\x0B\f\x{00a0}\x{3000}]"

# every address and postal code with its place: postal codes are looked for position by position where there can be one
_PLACES = f"""
    SELECT doc_id, 'EMAIL' AS kind, value, begin_at, end_at FROM ({_HITS})
    UNION ALL SELECT doc_id, 'POSTAL', substring(text, CAST(i AS INTEGER), 8), CAST(i - 1 AS INTEGER), CAST(i + 7 AS INTEGER)
    FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 7)) AS i FROM documents WHERE regexp_matches(text, '\\p{{Nd}}{{3}}[-－‐‑−–—]\\p{{Nd}}{{4}}'))
    WHERE regexp_full_match(substring(text, CAST(i AS INTEGER), 8), '\\p{{Nd}}{{3}}[-－‐‑−–—]\\p{{Nd}}{{4}}')
      AND NOT (i > 1 AND regexp_full_match(substring(text, CAST(i - 1 AS INTEGER), 1), '[\\p{{Nd}}\\-－]')) AND NOT regexp_full_match(substring(text, CAST(i + 8 AS INTEGER), 1), '[\\p{{Nd}}\\-－]')"""
_NUMBERED = f"""
    SELECT kind, value, row_number() OVER (PARTITION BY kind ORDER BY d, b) AS n FROM (SELECT kind, value, min(doc_id) AS d, arg_min(begin_at, doc_id * 10000000 + begin_at) AS b FROM ({_PLACES}) GROUP BY 1, 2)"""


def _replaced(token: str, places: str = f"(SELECT * FROM ({_PLACES}) JOIN ({_NUMBERED}) USING (kind, value))", text: str = "text") -> str:
    """doc_id and text of the documents with the given token in the place of each hit."""
    return f"""SELECT d.doc_id, coalesce(p.head, '') || substring({text}, coalesce(p.at, 0) + 1) AS text FROM documents d LEFT JOIN (
        SELECT doc_id, max(end_at) AS at, string_agg(piece, '' ORDER BY begin_at) AS head FROM (
          SELECT h.doc_id, begin_at, end_at, substring(text, coalesce(lag(end_at) OVER (PARTITION BY h.doc_id ORDER BY begin_at), 0) + 1, begin_at - coalesce(lag(end_at) OVER (PARTITION BY h.doc_id ORDER BY begin_at), 0)) || {token} AS piece
          FROM {places} h JOIN documents USING (doc_id)) GROUP BY doc_id) p ON d.doc_id = p.doc_id"""


_ESCAPED = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
# documents have no other blanks than these
_LINES = """
    SELECT doc_id, i, n, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY i) - n AS INTEGER) AS pos FROM (
      SELECT doc_id, i, length(l[i]) + CAST(i < len(l) AS INTEGER) AS n FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)))
    WHERE n > 0"""
ORACLE_SQL = {
    "chunk_text": f"""WITH RECURSIVE l AS ({_LINES}),
        p AS (SELECT doc_id, i, n, pos AS start, CASE WHEN n > 250 THEN 0 ELSE n END AS held FROM l WHERE i = 1
          UNION ALL SELECT l.doc_id, l.i, l.n, CASE WHEN l.n <= 250 AND p.held > 0 AND p.held + l.n <= 250 THEN p.start ELSE l.pos END,
            CASE WHEN l.n > 250 THEN 0 WHEN p.held > 0 AND p.held + l.n <= 250 THEN p.held + l.n ELSE l.n END FROM p JOIN l ON l.doc_id = p.doc_id AND l.i = p.i + 1)
        SELECT doc_id, start AS base, CAST(max(held) AS INTEGER) AS n_chars FROM p WHERE n <= 250 GROUP BY doc_id, start
        UNION ALL SELECT doc_id, CAST(pos + k * 200 AS INTEGER), CAST(least(250, n - k * 200) AS INTEGER) FROM (SELECT doc_id, pos, n, unnest(generate_series(0, CAST(ceil((n - 250) / 200) AS INTEGER))) AS k FROM l WHERE n > 250)""",
    "mask_without_ids": f"""WITH e AS (SELECT coalesce(sum(n), 0) AS hits FROM (SELECT count(*) AS n FROM ({_HITS}))),
        m AS (SELECT sum(length(text)) AS chars FROM ({_replaced("'{{' || kind || '_' || n || '}}'")}))
        SELECT true AS masked, CAST(id AS BIGINT) AS id, count(*) AS n, CAST(any_value(m.chars) AS BIGINT) AS chars, CAST(0 AS BIGINT) AS emails FROM documents, m, (VALUES (-1), (-2)) t(id) GROUP BY id
        UNION ALL SELECT false, id, 1, length(text), len(regexp_extract_all(text, '{_E}')) FROM (SELECT doc_id AS id, text FROM documents)
        UNION ALL SELECT false, CAST(id AS BIGINT), count(*), CAST(sum(length(text)) AS BIGINT), CAST(any_value(hits) AS BIGINT) FROM documents, e, (VALUES (-1), (-2)) t(id) GROUP BY id""",
    "checked_documents": f"""SELECT doc_id, value, 3 AS status FROM (SELECT doc_id, 'idiot' AS value FROM documents WHERE contains(text, 'idiot'))""",
    "bundle": f"SELECT '【ファイル名】' || chr(10) || string_agg(CASE WHEN source <> '' AND kind <> 'xlsx' THEN source END, chr(10) ORDER BY source) || chr(10) || chr(10) || string_agg(CASE WHEN text <> '' THEN CASE WHEN source <> '' THEN '【' || source || '】' || chr(10) ELSE '' END || text END, chr(10) || chr(10) ORDER BY ord) AS text FROM (VALUES {_values(CASE)}) t(ord, source, kind, text)",
    "mapping_rows": f"SELECT value, '{{{{EMAIL_' || n || '}}}}' AS token FROM ({_NUMBERED}) WHERE kind = 'EMAIL'",
    "eml_documents": r"""SELECT doc_id || '.eml' AS source, 'eml' AS kind, '件名: 件名 ' || doc_id || chr(10) || '差出人: a@b.co' || chr(10) || '宛先: c@d.co' || chr(10) || chr(10) || '【ヘッダ】' || chr(10) || 'Reply-To: r@d.co' || chr(10) || chr(10)
        || regexp_replace(text, '[\r。]', '', 'g') || chr(10) || chr(10) || '【添付ファイル】' || chr(10) || 'x.pdf' AS text, 'x.pdf' AS attachments, '' AS error FROM documents WHERE trim(text) <> ''""",
    "decoded_documents": "SELECT doc_id, text AS marked, text AS plain, text AS named, false AS odd, CAST(octet_length(encode(text)) AS INTEGER) AS bytes FROM documents",
    "csv_cells": """SELECT c_mktsegment || '.csv' AS doc_id, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, CASE col WHEN 1 THEN replace(c_name, '#', '"') WHEN 2 THEN 'a' || chr(10) || 'b, ' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS text
        FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS row FROM customer), (VALUES (1), (2), (3)) t(col)""",
    "more_scalars": rf"""SELECT doc_id, length(regexp_replace(text, '[\s\x0B\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]', '', 'g')) AS dense, regexp_replace(left(text, 60), '([\\^$.|?*+()\[\]{{}}\-#&~])', '\\\1', 'g') AS escaped,
        regexp_replace(left(text, 30), '^[aeT .]+|[aeT .]+$', '', 'g') AS stripped, CAST(doc_id AS INTEGER) AS number, CAST(doc_id AS INTEGER) AS hexed, CASE WHEN regexp_matches(text, '^\s*[+-]?\d') THEN CAST(regexp_extract(text, '^\s*([+-]?\d+)', 1) AS INTEGER) ELSE -7 END AS nothing,
        regexp_matches(substring(text, 2, 1), '[\x{{4E00}}-\x{{9FFF}}\x{{3400}}-\x{{4DBF}}\x{{F900}}-\x{{FAFF}}\x{{20000}}-\x{{2FA1F}}\x{{3005}}]') AS kanji, doc_id % 3 <> 1 AS file,
        CASE WHEN doc_id % 700 < 26 THEN chr(CAST(65 + doc_id % 700 AS INTEGER)) ELSE chr(CAST(64 + (doc_id % 700) // 26 AS INTEGER)) || chr(CAST(65 + (doc_id % 700) % 26 AS INTEGER)) END AS letter, doc_id % 700 AS column,
        text AS decoded, 'A: b c' || chr(10) || 'D: ' || left(text, 9) AS unfolded, text AS repaired, '株式会社' || regexp_replace(left(text, 20), '{_BLANKS}', '', 'g') AS entity, source || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' <a@b.co>' END AS address, true AS exchange, {_ESCAPED.format("text")} AS html FROM documents""",
    "highlighted": f"""SELECT h.doc_id, html, blotted FROM (SELECT doc_id, text AS blotted FROM ({_replaced("'#'", f"(SELECT * FROM ({_HITS}))")})) b JOIN (
        SELECT doc_id, regexp_replace({_ESCAPED.format("text")}, '({_E})', '<mark class="email">\\1</mark>', 'g') AS html FROM documents) h USING (doc_id)""",
    "review_counts": f"""SELECT term, count(*) AS cells, CAST(sum(n) AS BIGINT) AS spans FROM (
        SELECT doc_id, term, len(regexp_extract_all(text, p)) AS n FROM documents, (VALUES ('idiot', 'i\\s*d\\s*i\\s*o\\s*t'), ('worthless', 'w\\s*o\\s*r\\s*t\\s*h\\s*l\\s*e\\s*s\\s*s')) t(term, p)
        UNION ALL SELECT doc_id, 'the', len(regexp_extract_all(regexp_replace(' ' || text || ' ', '({_NOT_WORD})', '\\1\\1', 'g'), '{_NOT_WORD}the{_NOT_WORD}')) FROM documents) WHERE n > 0 GROUP BY term
        UNION ALL SELECT '', count(*), 0 FROM (SELECT doc_id FROM ({_PLACES}) p JOIN documents d USING (doc_id) WHERE NOT regexp_matches(text, 'i\\s*d\\s*i\\s*o\\s*t|w\\s*o\\s*r\\s*t\\s*h\\s*l\\s*e\\s*s\\s*s') AND NOT regexp_matches(' ' || text || ' ', '{_NOT_WORD}the{_NOT_WORD}') GROUP BY doc_id) HAVING count(*) > 0""",
    "column_review": f"SELECT col, max(CASE WHEN row = 1 THEN text END) AS header, count(*) FILTER (row > 1 AND trim(text) <> '') AS cells, count(DISTINCT CASE WHEN row > 1 THEN trim(text) END) AS distinct FROM {_CELLS} GROUP BY col",
    "review_rows": """SELECT text, arg_min(entity_type, rank) AS entity_type, arg_min(origin, rank) AS origin FROM (
        SELECT n_name AS text, 'LOCATION' AS entity_type, 'column' AS origin, 0 AS rank FROM nation WHERE n_name > 'C' UNION ALL SELECT r_name, 'ORGANIZATION', 'found', 1 FROM region
        UNION ALL SELECT n_name, 'PERSON', 'manual', 2 FROM nation WHERE n_name < 'G' UNION ALL SELECT 'extra', 'PERSON', 'manual', 2) GROUP BY text
        HAVING NOT (text IN (SELECT n_name FROM nation WHERE n_name LIKE 'I%') AND arg_min(entity_type, rank) = 'LOCATION')""",
    "sheet_output": """WITH c AS (SELECT CAST(o_orderkey AS INTEGER) AS row, 1 AS col, '=' || o_orderstatus AS text FROM orders UNION ALL SELECT CAST(o_orderkey AS INTEGER), 2, o_orderpriority FROM orders)
        SELECT 'copy' AS kind, row, col, CASE WHEN row % 3 = 0 THEN 'x' || text WHEN col = 1 THEN chr(39) || text ELSE text END AS text FROM c
        UNION ALL SELECT CASE col WHEN 1 THEN 'left' ELSE 'written' END, row, col, 'x' || text FROM c WHERE row % 3 = 0
        UNION ALL SELECT 'changed', row, col, 'x' || text FROM c WHERE row % 3 = 0 UNION ALL SELECT 'open', row, col, '' FROM c WHERE col = 1 AND row % 3 <> 0""",
    "email_spans": f"SELECT doc_id, begin_at, end_at, value FROM ({_HITS})",
    "postal_values": f"SELECT doc_id, value, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_POSTAL}', 1)) AS value FROM documents) GROUP BY 1, 2",
    "phone_values": f"SELECT doc_id, unnest(regexp_extract_all(text, '{_PHONE}', 1)) AS value FROM (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {_values(NUMBERS)}) t(doc_id, text))",
    "email_mapping": f"""SELECT value, row_number() OVER (ORDER BY d, b) AS n, '{{{{EMAIL_' || row_number() OVER (ORDER BY d, b) || '}}}}' AS token
        FROM (SELECT value, min(doc_id) AS d, arg_min(begin_at, doc_id * 10000000 + begin_at) AS b FROM ({_HITS}) GROUP BY value)""",
    "mask_documents": _replaced("'{{' || kind || '_' || n || '}}'"),
    "redact_documents": _replaced("'[' || CASE kind WHEN 'EMAIL' THEN 'メール' ELSE '郵便番号' END || n || ']'"),
    "restore_roundtrip": f"SELECT d.doc_id, text AS restored, CAST(0 AS BIGINT) AS left_over, coalesce(n, 0) AS tokens FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({_PLACES}) GROUP BY doc_id) USING (doc_id)",
    "safety_gate": f"SELECT d.doc_id, coalesce(n, 0) AS before, CAST(contains(text, 'idiot') AS BIGINT) AS after FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({_PLACES}) GROUP BY doc_id) USING (doc_id)",
    "raw_gate": f"SELECT doc_id, value FROM documents, (VALUES ('idiot'), ('worthless')) t(value) WHERE contains(text, value) UNION ALL SELECT doc_id, value FROM ({_PLACES})",
    "placeholders": r"""SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\{\{[A-Z]+_\d+\}\}|\[(?:人名|会社名|住所|メール|電話|郵便番号|識別子)\d+\]'))) AS token
        FROM (VALUES (1, '{{PERSON_1}} と [人名2] と {{PERSON_1}}'), (2, '[MASKED1] {{a_1}}'), (3, '{{EMAIL_10}}')) t(doc_id, text)""",
    "html_to_text": r"""SELECT page_id, array_to_string([x for x in [regexp_replace(l, '^[ \t\r\n\x0B\f\x{00a0}\x{3000}]+|[ \t\r\n\x0B\f\x{00a0}\x{3000}]+$', '', 'g') for l in regexp_split_to_array(
        replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b[^>]*>.*?</script>', '', 'gis'), '<style\b[^>]*>.*?</style>', '', 'gis'), '<head\b[^>]*>.*?</head>', '', 'gis'), '<[^>]+>', chr(10), 'g'),
        '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]')] if x <> ''], chr(10)) AS text FROM pages""",
    "text_scalars": rf"""SELECT doc_id, length(text) AS chars, len([x for x in string_split(text, chr(10)) if true]) - CAST(text = '' OR right(text, 1) = chr(10) AS INTEGER) AS lines, regexp_matches(text, '\p{{L}}') AS letters,
        NOT regexp_matches(text, '{_WORD}') AS symbols, length(regexp_replace(text, '{_BLANKS}', '', 'g')) AS tight, substring(text, 4, 6) AS piece, regexp_replace(text, '^{_BLANKS}+|{_BLANKS}+$', '', 'g') AS trimmed FROM documents""",
    "prose_scalars": rf"""SELECT doc_id, array_to_string([CASE WHEN contains(b, '。') THEN replace(b, chr(10), '') ELSE b END for b in string_split(regexp_replace(text, '([一-龥々〆ヶ])[（(][ぁ-んァ-ヶーゝゞ・]{{1,10}}[）)]', '\1', 'g'), chr(10) || chr(10))], chr(10) || chr(10)) AS text,
        translate(text, '{_KATA}', '{_HIRA}') AS hiragana FROM {_PROSE}""",
    "confirmed_match": r"""SELECT doc_id, term, n FROM (SELECT doc_id, term, len(regexp_extract_all(text, p)) AS n FROM documents, (VALUES ('idiot', 'i\s*d\s*i\s*o\s*t'), ('worthless', 'w\s*o\s*r\s*t\s*h\s*l\s*e\s*s\s*s')) t(term, p)) WHERE n > 0""",
    "whole_word_match": f"SELECT doc_id, n FROM (SELECT doc_id, len(regexp_extract_all(regexp_replace(' ' || text || ' ', '({_NOT_WORD})', '\\1\\1', 'g'), '{_NOT_WORD}the{_NOT_WORD}')) AS n FROM documents) WHERE n > 0",
    "pattern_spans": f"SELECT doc_id, type, value FROM ({_SPANS})",
    "group_entities": f"""SELECT doc_id, type, min(b) AS begin_at, max(e) AS end_at, avg(s) AS score FROM (
        SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM (
          SELECT doc_id, pos, b, e, s, label, name, CASE name WHEN 'PER' THEN 'PERSON' WHEN 'ORG' THEN 'ORGANIZATION' WHEN 'LOC' THEN 'LOCATION' WHEN 'INS' THEN 'LOCATION' END AS type,
            CAST(lag(label) OVER (PARTITION BY doc_id ORDER BY pos) IS DISTINCT FROM label AS INTEGER) AS new
          FROM (SELECT *, string_split(label, '-')[-1] AS name FROM (VALUES {_values(LABELS)}) t(doc_id, pos, label, b, e, s)))) WHERE type IS NOT NULL GROUP BY doc_id, type, island""",
    "column_kinds": f"""SELECT h AS header, {_KIND} AS kind, CASE WHEN regexp_matches(h, '氏名|名前|担当|姓名|顧客名|会員名|氏 名|name|Name') THEN 'name' WHEN regexp_matches(h, '会社|取引先|法人|企業|組織|得意先|屋号|company|Company') THEN 'company' ELSE '' END AS guess
        FROM (VALUES {_values([(h,) for h in HEADERS])}) t(h)""",
    "header_rows": f"SELECT doc_id, arg_max(row, n * 1000 - row) AS row FROM (SELECT doc_id, row, count(DISTINCT trim(text)) AS n FROM {_CELLS} WHERE trim(text) IN ('氏名', '電話') GROUP BY 1, 2) GROUP BY doc_id",
    "table_rows": f"""SELECT doc_id, arg_max(first, n * 1000 - first) AS row FROM (SELECT doc_id, width, count(*) AS n, min(row) AS first FROM (
        SELECT doc_id, row, count(*) AS width FROM {_CELLS} WHERE trim(text) <> '' GROUP BY 1, 2) WHERE width >= 2 GROUP BY 1, 2) GROUP BY doc_id""",
    "cell_plan": f"SELECT row, col, mode, CASE WHEN mode = 'whole' THEN kind END AS kind, CASE WHEN mode = 'whole' THEN v END AS value, CAST(CASE WHEN mode = 'whole' THEN length(text) - length(ltrim(text)) ELSE 0 END AS INTEGER) AS lead FROM ({_MODED})",
    "cell_runs": f"SELECT col, min(row) AS first_row, max(row) AS last_row FROM (SELECT col, row, row - row_number() OVER (PARTITION BY col ORDER BY row) AS g FROM {_CELLS}) GROUP BY col, g",
    "sheet_mapping": f"""SELECT k AS kind, count(DISTINCT v) AS n FROM (SELECT v, CASE kind WHEN 'LOCATION' THEN 'ADDRESS' ELSE kind END AS k FROM ({_MODED}) WHERE mode = 'whole') GROUP BY k""",
    "excluded_leaks": f"SELECT DISTINCT w.v AS value FROM ({_MODED}) w, ({_MODED}) x WHERE w.mode = 'whole' AND x.mode = 'excluded' AND contains(x.text, w.v) AND length(w.v) > 1",
    "column_density": f"""SELECT col, kind FROM (SELECT col, kind, count(*) AS n, any_value(total) AS total FROM (
        SELECT col, count(*) OVER (PARTITION BY col) AS total, CASE WHEN regexp_matches(text, '{_E}') THEN 'EMAIL' WHEN regexp_matches(text, '{_PHONE}') THEN 'PHONE' END AS kind
        FROM {_CELLS} WHERE row > 1 AND trim(text) <> '') WHERE kind IS NOT NULL GROUP BY col, kind) WHERE total >= 2 AND n * 10 >= total * 6""",
    # known results of the two fixtures
    "sheet_sanitise": f"SELECT row, col, text FROM (VALUES {_values(SANITISED)}) t(row, col, text)",
    "candidates": f"SELECT text, entity_type, count FROM (VALUES {_values(CANDIDATES)}) t(text, entity_type, count)",
    "source_names": "SELECT DISTINCT source FROM documents WHERE source <> ''",
    "coverage": f"""SELECT id, g <> '' AND f <> '' AND (contains(f, g) OR contains(g, f)) AS loose, g <> '' AND contains(f, g) AS strict, CAST(length(found) - length(replace(found, '田', '')) AS INTEGER) AS n
        FROM (SELECT id, found, replace(replace(replace(expected, ' ', ''), '㈱', '株式会社'), '㈲', '有限会社') AS g, replace(replace(replace(found, ' ', ''), '㈱', '株式会社'), '㈲', '有限会社') AS f FROM (VALUES {_values(ENTITIES)}) t(id, expected, found))""",
    "stream_mask": f"""SELECT doc_id, text, len(regexp_extract_all(text, '{_E}')) AS emails_left FROM ({_replaced("'{{EMAIL_' || n || '}}'", f"(SELECT * FROM ({_HITS}) JOIN (SELECT value, row_number() OVER (ORDER BY encode(value)) AS n FROM (SELECT DISTINCT value FROM ({_HITS}) WHERE value < 'm')) USING (value))")})""",
}

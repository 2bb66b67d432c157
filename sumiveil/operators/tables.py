"""Tables as long-form cells (doc_id, row, col, text): headers, column kinds, rules, sheets."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sumiveil.functions import patterns as P
from sumiveil.functions.finder import Finder
from sumiveil.functions.numbering import nulls_last, with_row
from sumiveil.functions.spans import first_taken, matches
from sumiveil.functions.text import _c, symbol_only, trim
from sumiveil.operators.masking import HIT, HIT_ARROW, TermMatcher, gate, number_hits, number_values, outside_placeholders, spliced, touches_word
from sumiveil.session import settle

NUMERIC_LIKE = r"(?U)^[\d０-９.,．，/／\-－:：\s年月日時分秒%％¥￥$+±()（）]+$"


def filled(text) -> Column:
    return F.coalesce(trim(text) != "", F.lit(False))


def first_table_row(cells: DataFrame) -> DataFrame:
    """doc_id and row: the first row as wide as most rows of two cells or more (the width seen first on a tie), else the first with a cell."""
    widths = cells.where(filled("text")).groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("width"))
    modal = widths.where("width >= 2").groupBy("doc_id", "width").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row"))
    best = modal.groupBy("doc_id").agg(F.max_by("row", F.struct("n", -F.col("row"))).alias("row"))
    any_row = widths.groupBy("doc_id").agg(F.min("row").alias("any"))
    return any_row.join(best, "doc_id", "left").select("doc_id", F.coalesce("row", "any").alias("row"))


def header_row(cells: DataFrame, wanted: list[str] = ()) -> DataFrame:
    """doc_id and row: the first row with most of the wanted names, else :func:`first_table_row`."""
    base = first_table_row(cells)
    if not wanted:
        return base
    hits = cells.where(trim("text").isin(*wanted)).groupBy("doc_id", "row").agg(F.countDistinct(trim("text")).alias("n"))
    best = hits.groupBy("doc_id").agg(F.max_by("row", F.struct("n", -F.col("row"))).alias("wanted"))
    return base.join(best, "doc_id", "left").select("doc_id", F.coalesce("wanted", "row").alias("row"))


def table_of(cells: DataFrame, wanted: list[str] = (), explicit: int | None = None) -> DataFrame:
    """doc_id, row, col, header, text of the cells below the header.

    An explicit header row (1-based, by the order of rows) drops rows that are all blank; a detected
    one keeps them.
    """
    at = cells.select("doc_id").distinct().withColumn("_h", F.lit(explicit)) if explicit else header_row(cells, wanted).withColumnRenamed("row", "_h")
    joined = cells.join(at, "doc_id")
    names = joined.where(F.col("row") == F.col("_h")).select("doc_id", "col", F.col("text").alias("header"))
    body = joined.where(F.col("row") > F.col("_h")).drop("_h").join(names, ["doc_id", "col"], "left")
    if explicit:
        body = body.join(cells.where(filled("text")).select("doc_id", "row").distinct(), ["doc_id", "row"], "left_semi")
    return body.select("doc_id", "row", "col", "header", "text")


def guess_column(header) -> Column:
    """name, company or an empty string, by words in a header."""
    h = _c(header)
    # Fixed values.
    names = "氏名|名前|担当|姓名|顧客名|会員名|氏 名|name|Name"
    companies = "会社|取引先|法人|企業|組織|得意先|屋号|company|Company"
    return F.when(h.rlike(names), "name").when(h.rlike(companies), "company").otherwise("")


@F.arrow_udf(StringType())
def nfkc_upper(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t.upper()) for t in texts.to_pylist()], pa.string())


def column_kind_from_header(header) -> Column:
    """The kind that a header names for sure, else null."""
    u = nfkc_upper(trim(header))
    # Fixed values, in this order.
    return (
        F.when(u.isNull() | (u == "") | u.rlike("郵便"), F.lit(None).cast("string"))
        .when(u.rlike("メール|MAIL"), "EMAIL")
        .when(u.rlike("電話|TEL|携帯|FAX|ファックス|内線"), "PHONE")
        .when(u.rlike("住所|所在地|宛先|送付先"), "LOCATION")
        .when(u.rlike("会社|法人|取引先|企業|団体|組織名|勤務先"), "ORGANIZATION")
        .when(u.rlike("氏名|名前|姓名|担当者|申請者|代表者|責任者|作成者|承認者|依頼者|紹介者|フリガナ|ふりがな") | u.isin("姓", "名", "氏", "セイ", "メイ"), "PERSON")
        .when(u.rlike(r"番号|コード|ナンバー|(^|[^A-Z])ID($|[^A-Z])|(^|[^A-Z])NO\.?($|[^A-Z])|№"), "ID")
    )


def looks_numeric(text) -> Column:
    t = _c(text)
    return t.rlike(NUMERIC_LIKE) & t.rlike("[0-9０-９]")


def guess_header_row(cells: DataFrame, rows: int = 10) -> DataFrame:
    """doc_id and row: of the first rows, the first of texts only that fills four fifths of the columns; else the first row."""
    shape = cells.groupBy("doc_id").agg(F.countDistinct("col").alias("cols"), F.min("row").alias("top"))
    kinds = cells.where(filled("text")).groupBy("doc_id", "row").agg(F.count_if(~looks_numeric(trim("text"))).alias("texts"), F.count_if(looks_numeric(trim("text"))).alias("numbers"))
    good = kinds.join(shape, "doc_id").where((F.col("row") < F.col("top") + rows) & (F.col("numbers") == 0) & (F.col("texts") * 10 >= F.col("cols") * 8)).groupBy("doc_id").agg(F.min("row").alias("row"))
    return shape.join(good, "doc_id", "left").select("doc_id", F.coalesce("row", "top").alias("row"))


def column_kind_from_density(cells: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, col, kind of columns of two cells or more where one kind was found in six tenths of them.

    ``spans`` has doc_id, row, col, category; on a tie the kind of the earliest row wins.
    """
    kinds = F.create_map(*[F.lit(x) for kv in P.CATEGORY_KIND.items() for x in kv])
    totals = cells.where(filled("text")).groupBy("doc_id", "col").agg(F.count(F.lit(1)).alias("cells"))
    found = spans.withColumn("kind", F.try_element_at(kinds, F.col("category"))).where("kind is not null").groupBy("doc_id", "col", "kind").agg(F.countDistinct("row").alias("n"), F.min("row").alias("first"))
    best = found.groupBy("doc_id", "col").agg(F.max_by("kind", F.struct("n", -F.col("first"), "kind")).alias("kind"), F.max("n").alias("n"))
    return totals.join(best, ["doc_id", "col"]).where("cells >= 2 and n * 10 >= cells * 6").select("doc_id", "col", "kind")


def propose_kinds(columns: DataFrame) -> DataFrame:
    """Adds kind: remembered, else by header, else by density, else AUTO."""
    return columns.withColumn("kind", F.coalesce("remembered", "by_header", "by_density", F.lit("AUTO")))


def placeholder_value(text) -> Column:
    return F.lower(trim(text)).isin(*P.PLACEHOLDER_VALUES)


def cell_plan(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds mode (normal, whole, excluded), kind, value and lead (characters before the value) to cells.

    ``rules`` (ord, col, r1, r2, kind, skip array) are few and broadcast; the last that covers a cell
    holds.  Blank marks and skipped values stay normal.
    """
    r = F.broadcast(rules.withColumnRenamed("col", "_col"))
    hit = cells.join(r, (F.col("col") == F.col("_col")) & F.col("row").between(F.col("r1"), F.col("r2")), "left")
    last = hit.groupBy("doc_id", "row", "col", "text").agg(F.max_by(F.struct("kind", "skip"), F.col("ord")).alias("rule"))
    value = trim("text")
    skipped = symbol_only(value) | F.exists(F.coalesce(F.col("rule.skip"), F.array().cast("array<string>")), lambda s: trim(s) == value)
    mode = F.when(F.col("rule.kind").isNull(), "normal").when(F.col("rule.kind") == "NONE", "excluded").when(skipped, "normal").otherwise("whole")
    whole = mode == "whole"
    lead = F.char_length("text") - F.char_length(F.regexp_replace("text", "^[ \\t\\r\\n\\x0B\\f\\u00a0\\u3000]+", ""))
    return last.select("doc_id", "row", "col", "text", mode.alias("mode"), F.when(whole, F.col("rule.kind")).alias("kind"), F.when(whole, value).alias("value"), F.when(whole, lead).otherwise(0).alias("lead"))


def weak_value(value) -> Column:
    v = _c(value)
    return (F.char_length(v) <= 1) | v.rlike("^[0-9０-９]{1,4}$")


def column_terms(plan: DataFrame, confirmed: list[str] = ()) -> DataFrame:
    """doc_id, value, kind and weak of the distinct whole values of each sheet that are no confirmed term, with their first row and col."""
    values = plan.where("mode = 'whole'")
    values = values.where(~F.col("value").isin(*confirmed)) if confirmed else values
    return values.groupBy("doc_id", "value").agg(F.min(F.struct("row", "col", "kind")).alias("f")).select("doc_id", "value", "f.kind", weak_value("value").alias("weak"), F.col("f.row").alias("row"), F.col("f.col").alias("col"))


def _sheet() -> Column:
    """A key for a sheet that a null doc_id has, too."""
    return F.concat(F.when(F.col("doc_id").isNull(), "n").otherwise("s"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("sheet")


_FOUND = "cell long, text string, found array<struct<begin:int,end:int,value:string>>"


def _find_terms(confirmed: list[tuple[str, str]]):
    """Hits of the confirmed terms and of its own strong column values in each normal cell of a sheet."""

    def find(cells: pa.Table, strong: pa.Table) -> pa.Table:
        own = sorted(strong.select(["row", "col", "value", "kind"]).to_pylist(), key=lambda r: (r["row"], r["col"]))
        terms = [(i, t, k, False) for i, (t, k) in enumerate(confirmed)] + [(len(confirmed) + i, r["value"], r["kind"], True) for i, r in enumerate(own)]
        matcher = TermMatcher(terms)
        hits = pa.array([matcher.hits(t) for t in cells.column("text").to_pylist()], HIT_ARROW)
        return pa.table([cells.column("cell"), cells.column("text"), hits], names=["cell", "text", "hits"])

    return find


def _find_values(cells: pa.Table, values: pa.Table) -> pa.Table:
    """Places of a sheet's own values in its cells, bounded ones as whole words."""
    given = values.select(["value", "bounded"]).to_pylist()
    finder = Finder([r["value"] for r in given])
    out = []
    for text in cells.column("text").to_pylist():
        places = [(given[k], p, p + len(given[k]["value"])) for k, p in finder.find(text)]
        out.append([{"begin": b, "end": e, "value": r["value"]} for r, b, e in places if not r["bounded"] or not touches_word(text, b, e)])
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
    return pa.table([cells.column("cell"), cells.column("text"), pa.array(out, kind)], names=["cell", "text", "found"])


def sanitise(cells: DataFrame, confirmed: list[tuple[str, str]], rules: DataFrame, reversible: bool = True) -> dict[str, DataFrame]:
    """Masked cells, mapping, leaks and what excluded columns still show, of any number of sheets (doc_id).

    Whole cells are numbered first, sheet by sheet in row and column order; a sheet's strong column
    values then count as whole-word terms in its other cells, weak ones only in their own.  Sheets
    share the mapping and nothing else.  Each is matched in one task, as it was parsed in one; nothing
    but the confirmed terms, which a person has reviewed, passes through the driver.  Cells that
    repeat a place are masked each.
    """
    plan = with_row(cell_plan(cells.where(filled("text")), rules), "cell")
    terms = column_terms(plan, [t for t, _ in confirmed])
    prefix = F.create_map(*[F.lit(x) for kv in P.TOKEN_PREFIX.items() for x in kv])
    place = F.struct(nulls_last("doc_id").alias("id"), "row", "col").alias("ord")
    whole = plan.where("mode = 'whole'").select("cell", place, F.lit(0).alias("begin"), F.lit(-1).alias("stage"), F.coalesce(F.try_element_at(prefix, F.col("kind")), F.lit("MASKED")).alias("kind"), "value", F.lit(0).cast("long").alias("rank"), F.col("lead").alias("b"), (F.col("lead") + F.char_length("value")).alias("e"))
    normal = plan.where("mode = 'normal'")
    strong = terms.where("not weak").select(_sheet(), "row", "col", "value", "kind")
    matched = normal.select(_sheet(), "cell", "text").groupBy("sheet").cogroup(strong.groupBy("sheet")).applyInArrow(_find_terms(list(confirmed)), f"cell long, text string, hits array<{HIT}>")
    taken = matched.select("cell", F.explode(first_taken(F.concat(number_hits("text").cast(f"array<{HIT}>"), F.col("hits")), HIT)).alias("h"))
    met = taken.join(normal.select("cell", place), "cell").select("cell", "ord", "h.begin", "h.stage", "h.kind", "h.value", "h.rank", F.col("h.begin").alias("b"), F.col("h.end").alias("e"))
    hits = settle(whole.unionByName(met))
    mapping = number_values(hits.select("ord", "begin", "stage", "kind", "value", "rank"), reversible)
    pieces = hits.join(mapping.select("value", "token"), "value").select("cell", F.col("b").alias("begin"), F.col("e").alias("end"), "token")
    out = spliced(plan.select("cell", "doc_id", "row", "col", "mode", F.col("text").alias("old"), "text"), pieces, "token", by="cell")
    # what each sheet may not show: its values but for the weak ones, strong ones as whole words
    own = hits.join(plan.select("cell", _sheet()), "cell").select("sheet", "value").distinct()
    known = own.join(terms.select(_sheet(), "value", "weak"), ["sheet", "value"], "left").where("weak is null or not weak").select("sheet", "value", F.col("weak").isNotNull().alias("bounded"))
    found = out.select(_sheet(), "cell", "text").groupBy("sheet").cogroup(known.groupBy("sheet")).applyInArrow(_find_values, _FOUND)
    shown = F.array_distinct(F.transform(outside_placeholders(F.col("found"), "text"), lambda s: s["value"]))
    leaks = found.select("cell", F.explode(F.concat(shown, gate("text"))).alias("value")).join(out.select("cell", "doc_id", "row", "col", "mode"), "cell")
    return {
        "cells": out.where("text <> old").select("doc_id", "row", "col", "text"),
        "mapping": mapping,
        "leaks": leaks.where("mode <> 'excluded'").select("doc_id", "row", "col", "value"),
        "excluded_leaks": leaks.where("mode = 'excluded'").select("doc_id", "value").distinct(),
    }


def cell_runs(cells: DataFrame) -> DataFrame:
    """doc_id, col, first and last row of each run of consecutive rows of a column."""
    run = F.col("row") - F.row_number().over(Window.partitionBy("doc_id", "col").orderBy("row"))
    return cells.select("doc_id", "row", "col").distinct().withColumn("run", run).groupBy("doc_id", "col", "run").agg(F.min("row").alias("first"), F.max("row").alias("last")).drop("run")


def register_table_values(table: DataFrame, name_cols: list[str], company_cols: list[str]) -> DataFrame:
    """Hits of a table's cells: whole cells of the named columns, and e-mails and phones (not postal codes) of the others."""
    kind = F.when(F.col("header").isin(*name_cols), "PERSON") if name_cols else F.lit(None).cast("string")
    kind = F.coalesce(kind, F.when(F.col("header").isin(*company_cols), "COMPANY") if company_cols else F.lit(None).cast("string"))
    place = F.col("row").cast("long") * 16_384 + F.col("col")
    cells = table.where("text <> ''").withColumn("k", kind).withColumn("ord", place)
    whole = cells.where("k is not null").select("doc_id", "ord", F.lit(0).alias("begin"), F.lit(-1).alias("stage"), F.col("k").alias("kind"), F.col("text").alias("value"), F.lit(0).cast("long").alias("rank"))
    found = F.concat(*[F.transform(matches("text", p), _as(k)) for k, p in (("EMAIL", P.EMAIL), ("PHONE", P.PHONE))])
    rest = cells.where("k is null").select("doc_id", "ord", F.explode(found).alias("h")).select("doc_id", "ord", "h.begin", F.lit(-1).alias("stage"), "h.kind", "h.value", F.lit(0).cast("long").alias("rank"))
    return whole.unionByName(rest)


def _as(kind: str):
    return lambda s: F.struct(s["begin"].alias("begin"), F.lit(kind).alias("kind"), s["value"].alias("value"))


def _named() -> Column:
    return (F.col("source") != "") & (F.col("kind") != "xlsx")


def source_names(files: DataFrame) -> DataFrame:
    """source: the names that a case is headed by, each once; workbooks are named elsewhere."""
    return files.where(_named()).select("source").distinct()


def bundle(files: DataFrame) -> DataFrame:
    """One text of a case from files (ord, source, kind, text): names first, then texts, headed if there are several."""
    names = F.array_sort(F.collect_set(F.when(_named(), F.col("source"))))
    texts = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("ord", "source", "text"))))
    one = files.agg(names.alias("names"), texts.alias("texts"))
    block = F.when(F.size("names") > 0, F.array(F.concat(F.lit("【ファイル名】\n"), F.array_join("names", "\n")))).otherwise(F.array().cast("array<string>"))
    body = F.transform("texts", lambda t: F.when((F.size("texts") > 1) & (t["source"] != ""), F.concat(F.lit("【"), t["source"], F.lit("】\n"), t["text"])).otherwise(t["text"]))
    return one.select(F.array_join(F.concat(block, body), "\n\n").alias("text"))

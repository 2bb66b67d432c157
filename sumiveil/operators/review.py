"""What a reviewer sees and edits between detection and masking, and what is written afterwards."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sumiveil.functions.spans import splice
from sumiveil.functions.text import _c, trim
from sumiveil.operators.masking import existing_placeholders, mask_hits
from sumiveil.operators.tables import filled, guess_column, header_row, placeholder_value

DICTIONARY_KINDS = ("PERSON", "ORGANIZATION", "LOCATION")


def term_cell_counts(spans: DataFrame) -> DataFrame:
    """term and cells: distinct cells a term is masked in; cells hit by numbers only are under an empty term.

    ``spans`` has doc_id, row, col, term.
    """
    cell = F.struct("doc_id", "row", "col")
    terms = spans.where("term <> ''").groupBy("term").agg(F.countDistinct(cell).alias("cells"))
    numbers = spans.groupBy("doc_id", "row", "col").agg(F.max(F.col("term") != "").alias("named")).where("not named").agg(F.lit("").alias("term"), F.count(F.lit(1)).alias("cells"))
    return terms.unionByName(numbers.where("cells > 0"))


def term_span_counts(spans: DataFrame) -> DataFrame:
    return spans.where("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("spans"))


def escape_html(text) -> Column:
    t = _c(text)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(char), F.lit(entity))
    return t


def highlight(text, spans: Column) -> Column:
    """HTML of a text with each span (begin, end, category) marked; the text itself is escaped."""
    t = _c(text)
    step = lambda s, x: F.struct(F.concat(s["out"], escape_html(F.substring(t, s["at"] + 1, x["begin"] - s["at"])), F.lit('<mark class="'), x["category"], F.lit('">'), escape_html(F.substring(t, x["begin"] + 1, x["end"] - x["begin"])), F.lit("</mark>")).alias("out"), x["end"].alias("at"))
    return F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda s: F.concat(s["out"], escape_html(F.substring(t, s["at"] + 1, F.char_length(t) - s["at"]))))


def preview_blocks(files: DataFrame, terms=()) -> DataFrame:
    """One block per file, and one for the names of all, with what would be masked; blocks go by place, not by name.

    ``files`` has ord, source, kind, text, attachments, error.
    """
    names = files.where("source <> '' and kind <> 'xlsx'").agg(F.array_sort(F.collect_set("source")).alias("n")).where("size(n) > 0")
    head = names.select(F.lit(-1).alias("ord"), F.lit("").alias("source"), F.lit("names").alias("kind"), F.array_join("n", "\n").alias("text"), F.array().cast("array<string>").alias("attachments"), F.lit("").alias("error"))
    every = head.unionByName(files.select(F.col("ord").cast("int").alias("ord"), "source", "kind", "text", "attachments", "error"))
    return every.withColumn("collisions", existing_placeholders("text")).withColumn("spans", F.transform(mask_hits("text", terms), lambda h: F.struct(h["begin"].alias("begin"), h["end"].alias("end"), h["kind"].alias("kind"), h["term"].alias("term")))).orderBy("ord")


def compose_rows(column_values: DataFrame, candidates: DataFrame, manual: DataFrame) -> DataFrame:
    """text, entity_type and origin of the review list: values of dictionary columns, then candidates, then manual entries; a text is listed once."""
    parts = ((column_values.where(F.col("entity_type").isin(*DICTIONARY_KINDS)), "column"), (candidates, "found"), (manual, "manual"))
    ranked = [df.select("text", "entity_type", F.lit(origin).alias("origin"), F.lit(rank).alias("rank")) for rank, (df, origin) in enumerate(parts)]
    best = Window.partitionBy("text").orderBy("rank", "entity_type")
    return ranked[0].unionByName(ranked[1]).unionByName(ranked[2]).withColumn("k", F.row_number().over(best)).where("k = 1").select("text", "entity_type", "origin")


def confirmed_rows(rows: DataFrame, unchecked: DataFrame) -> DataFrame:
    return rows.join(unchecked.select("text", "entity_type"), ["text", "entity_type"], "left_anti")


def distinct_values(cells: DataFrame, header: int = 0) -> DataFrame:
    """doc_id, col, value, first row of the trimmed values below the header row."""
    return cells.where((F.col("row") > header) & filled("text")).groupBy("doc_id", "col", trim("text").alias("value")).agg(F.min("row").alias("row"))


def column_infos(cells: DataFrame, header: int) -> DataFrame:
    """doc_id, col, header and number of data cells."""
    return cells.groupBy("doc_id", "col").agg(F.max(F.when(F.col("row") == header, trim("text"))).alias("header"), F.count_if((F.col("row") > header) & filled("text")).alias("cells"))


def column_rules(columns: DataFrame, values: DataFrame, unchecked: DataFrame, header: int, last: int = 1 << 20) -> DataFrame:
    """Rules (ord, col, r1, r2, kind, skip) of the columns whose kind isn't AUTO; placeholders and unchecked values are skipped.

    ``columns`` has col and kind, ``values`` and ``unchecked`` col and value.
    """
    off = values.join(unchecked.select("col", "value").withColumn("off", F.lit(True)), ["col", "value"], "left").where(F.col("off") | placeholder_value("value"))
    skip = off.groupBy("col").agg(F.array_sort(F.collect_set("value")).alias("skip"))
    kept = columns.where("kind <> 'AUTO'").join(skip, "col", "left")
    return kept.select(F.row_number().over(Window.orderBy("col")).alias("ord"), "col", F.lit(header + 1).alias("r1"), F.lit(last).alias("r2"), "kind", F.coalesce("skip", F.array().cast("array<string>")).alias("skip"))


class ColumnMemory:
    """Kinds chosen for headers in earlier tables: at most 100 header lists, the latest first; values are never kept."""

    def __init__(self, path: str, most: int = 100):
        self.path, self.most = path, most
        self.tables: list[dict] = []
        self.headers: dict[str, str] = {}
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                kept = json.load(f)
            self.tables, self.headers = kept["tables"], kept["headers"]

    def remember(self, headers: Sequence[str], kinds: Sequence[str]) -> None:
        """Keeps a table's kinds; AUTO forgets a header."""
        self.tables = [{"headers": list(headers), "kinds": list(kinds)}, *(t for t in self.tables if t["headers"] != list(headers))][: self.most]
        for h, k in zip(headers, kinds):
            if k == "AUTO":
                self.headers.pop(h, None)
            elif h:
                self.headers[h] = k
        with open(self.path, "w", encoding="utf-8") as f:
            json.dump({"tables": self.tables, "headers": self.headers}, f, ensure_ascii=False)

    def lookup(self, headers: Sequence[str]) -> tuple[list[str | None], bool]:
        """Kinds by the exact header list (and True), else header by header."""
        for t in self.tables:
            if t["headers"] == list(headers):
                return [k if k != "AUTO" else None for k in t["kinds"]], True
        return [self.headers.get(h) for h in headers], False


def table_skeletons(cells: DataFrame) -> DataFrame:
    """value: one JSON line per table with its header row and guessed columns; commented out if none is guessed."""
    at = header_row(cells).withColumnRenamed("row", "_h")
    names = cells.join(at, "doc_id").where(F.col("row") == F.col("_h")).where(filled("text")).withColumn("guess", guess_column("text"))
    pick = lambda g: F.transform(F.array_sort(F.collect_list(F.when(F.col("guess") == g, F.struct("col", "text")))), lambda x: x["text"])
    rows = names.groupBy("doc_id", "_h").agg(pick("name").alias("name_cols"), pick("company").alias("company_cols"))
    line = F.to_json(F.struct(F.col("doc_id").alias("file"), F.col("_h").alias("header_row"), "name_cols", "company_cols"))
    return rows.select(F.when(F.size("name_cols") + F.size("company_cols") == 0, F.concat(F.lit("# "), line)).otherwise(line).alias("value"))


def read_table_specs(body: str) -> dict[str, dict]:
    """Table specs by file name; comments and blanks are passed over, bad lines are errors."""
    out = {}
    for n, line in enumerate(body.split("\n"), 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        try:
            row = json.loads(line)
            out[os.path.basename(row["file"])] = row
        except (ValueError, KeyError, TypeError):
            raise ValueError(f"tables line {n} can't be read") from None
    return out


def resolve_columns(headers: Sequence[str], wanted: Sequence[str | int]) -> list[str]:
    """Header names of columns given by name or by number from 1."""
    out = []
    for w in wanted:
        k = int(w) if str(w).isdigit() and str(w) not in headers else None
        if k is not None and 1 <= k <= len(headers):
            out.append(headers[k - 1])
        elif k is None and w in headers:
            out.append(str(w))
    return out


def output_cells(cells: DataFrame, changed: DataFrame) -> DataFrame:
    """All cells as text, replaced where changed; a leading ``=`` is made harmless."""
    new = changed.select("doc_id", "row", "col", F.col("text").alias("_new"))
    text = F.coalesce("_new", "text")
    return cells.join(new, ["doc_id", "row", "col"], "left").select("doc_id", "row", "col", F.when(text.startswith("="), F.concat(F.lit("'"), text)).otherwise(text).alias("text"))


def write_back(changed: DataFrame, formulas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells to write, cells left because they hold a formula)."""
    at = ["doc_id", "row", "col"]
    return changed.join(formulas.select(*at), at, "left_anti"), changed.join(formulas.select(*at), at, "left_semi")


def unmasked_whole_cells(plan: DataFrame, changed: DataFrame) -> DataFrame:
    """Whole cells of the plan that were not replaced; anything here forbids output."""
    at = ["doc_id", "row", "col"]
    return plan.where("mode = 'whole'").join(changed.select(*at), at, "left_anti").select(*at)


def changed_cells(cells: DataFrame, restored: DataFrame) -> DataFrame:
    """Cells whose restored text differs."""
    at = ["doc_id", "row", "col"]
    return cells.select(*at, F.col("text").alias("_old")).join(restored, at).where("text <> _old").drop("_old")


def replace_spans(text, spans: Column, to: str) -> Column:
    return splice(text, spans, lambda s: F.lit(to))


def ratchet(masked: int, round_trips: int, false_masks: int, floors: tuple[int, int]) -> bool:
    """Whether the quality figures are no worse than their floors, with no false mask."""
    return masked >= floors[0] and round_trips >= floors[1] and false_masks == 0

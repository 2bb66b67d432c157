"""Files as DataFrames, and the small files that stay on the driver."""

from __future__ import annotations

import json
import os
import secrets

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumiveil.sources import extract as X
from sumiveil.sources import msg as _msg  # registers the extractor

# Fixed value: without the letters and digits that look alike.
PASSPHRASE_LETTERS = "ABCDEFGHJKMNPQRSTUVWXYZ23456789"


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """source, kind, text, attachments, error of every file; binary files are read and parsed on the executors."""
    return parse_files(spark.read.format("binaryFile").load(paths))


def parse_files(raw: DataFrame) -> DataFrame:
    """As :func:`read_files`, of rows with path and content; a null content is an empty file."""
    extractors = dict(X.EXTRACTORS)

    def run(batches):
        for b in batches:
            rows = [X.extract(p, d or b"", extractors) | {"source": p.rpartition("/")[2]} for p, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("source", pa.string()), ("kind", pa.string()), ("text", pa.string()), ("attachments", pa.list_(pa.string())), ("error", pa.string())]))

    return raw.select("path", "content").mapInArrow(run, "source string, kind string, text string, attachments array<string>, error string")


def read_cells(spark: SparkSession, paths: str | list[str], sheet: str | None = None) -> DataFrame:
    """doc_id (the source), row, col, text of csv and xlsx files; csv rows count from 1, blank lines left out."""
    return parse_cells(spark.read.format("binaryFile").load(paths), sheet)


def parse_cells(raw: DataFrame, sheet: str | None = None) -> DataFrame:
    """As :func:`read_cells`, of rows with path and content; a null content has no cells."""

    def run(batches):
        for b in batches:
            rows = []
            for p, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if d is None:
                    continue
                name = p.rpartition("/")[2]
                cells = X.xlsx_cells(d, sheet) if name.lower().endswith(".xlsx") else [(r, c, v) for r, row in enumerate(X.csv_rows(X.decode_bytes(d)), 1) for c, v in enumerate(row, 1)]
                rows += [{"doc_id": name, "row": r, "col": c, "text": v} for r, c, v in cells]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("text", pa.string())]))

    return raw.select("path", "content").mapInArrow(run, "doc_id string, row int, col int, text string")


def write_private(path: str, text: str) -> None:
    """A file only its owner can read, even if it was there before."""
    with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w", encoding="utf-8") as f:
        os.fchmod(f.fileno(), 0o600)
        f.write(text)


def write_mapping(mapping: DataFrame, path: str) -> None:
    """The mapping as JSON lines under a ``_meta`` line, to a private file, by kind and number."""
    rows = mapping.orderBy("kind", "n").select("token", "value").toLocalIterator()
    lines = [json.dumps({"_meta": {"version": 1}}), *(json.dumps({"token": r["token"], "original": r["value"]}, ensure_ascii=False) for r in rows)]
    write_private(path, "\n".join(lines) + "\n")


class NeedsPassphrase(ValueError):
    pass


def is_encrypted(body: str) -> bool:
    """Whether the first line says version 2; never fails."""
    try:
        return json.loads(body.lstrip("﻿").split("\n", 1)[0])["_meta"]["version"] == 2
    except (ValueError, KeyError, TypeError):
        return False


def parse_mapping(body: str) -> list[tuple[str, str]]:
    """(value, token) pairs, strictly: half rows, wrong types, empty or conflicting values are errors with a line number.

    Blank lines, comments and records with neither key are passed over.  Messages never carry values.
    """
    if is_encrypted(body):
        raise NeedsPassphrase("the mapping is encrypted; no cipher for it is installed here")
    seen: dict[str, str] = {}
    out, any_line = [], False
    for n, line in enumerate(body.lstrip("﻿").split("\n"), 1):
        line = line.rstrip("\r")
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        any_line = True
        try:
            row = json.loads(line)
        except ValueError:
            raise ValueError(f"mapping line {n} is no JSON") from None
        if not isinstance(row, dict):
            raise ValueError(f"mapping line {n} is no object")
        if "token" not in row and "original" not in row:
            if "_meta" in row and not (isinstance(row["_meta"], dict) and row["_meta"].get("version") == 1):
                raise ValueError(f"mapping line {n} has another version")
            continue
        token, original = row.get("token"), row.get("original")
        if not isinstance(token, str) or not isinstance(original, str):
            raise ValueError(f"mapping line {n} lacks a text for token or original")
        if not token or not original:
            raise ValueError(f"mapping line {n} has an empty token or original")
        if token in seen:
            if seen[token] != original:
                raise ValueError(f"mapping line {n} gives a token a second value")
            continue
        seen[token] = original
        out.append((original, token))
    if not any_line:
        raise ValueError("the mapping is empty")
    return out


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        return spark.createDataFrame(parse_mapping(f.read()), "value string, token string")


def read_candidates(body: str) -> list[dict]:
    """Candidate rows; comments, blanks and rows without type or text are passed over, bad JSON is an error."""
    out = []
    for n, line in enumerate(body.split("\n"), 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        try:
            row = json.loads(line)
        except ValueError:
            raise ValueError(f"candidates line {n} is no JSON") from None
        if isinstance(row, dict) and row.get("type") and row.get("text"):
            out.append(row)
    return out


def candidate_lines(candidates: DataFrame) -> DataFrame:
    """One JSON line per candidate, for a text writer."""
    return candidates.select(F.to_json(F.struct(F.col("entity_type").alias("type"), "text", "count")).alias("value"))


def passphrase() -> str:
    """Twenty letters in groups of five."""
    letters = [secrets.choice(PASSPHRASE_LETTERS) for _ in range(20)]
    return "-".join("".join(letters[i : i + 5]) for i in range(0, 20, 5))


def first_line(path: str) -> str:
    with open(path, encoding="utf-8-sig") as f:
        return f.readline().rstrip("\r\n")

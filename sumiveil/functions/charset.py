"""Decoding bytes: byte-order mark, UTF-8, cp932, else repair; named charsets strictly or not at all."""

from __future__ import annotations

import codecs

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructType

# Aliases, after quotes, case, "-" and "_" are gone.
ALIASES = {
    "utf8": "utf-8", "usascii": "utf-8", "ascii": "utf-8",
    "iso2022jp": "iso2022_jp_ext", "csiso2022jp": "iso2022_jp_ext", "iso2022jpms": "iso2022_jp_ext",
    "shiftjis": "cp932", "sjis": "cp932", "xsjis": "cp932", "mskanji": "cp932", "windows31j": "cp932", "cp932": "cp932", "ms932": "cp932",
    "eucjp": "euc_jp", "xeucjp": "euc_jp",
    "iso88591": "latin-1", "latin1": "latin-1", "windows1252": "cp1252", "cp1252": "cp1252",
}


def decode_bytes(data: bytes | None) -> str:
    """Text of a file; never fails."""
    data = data or b""
    if data.startswith(codecs.BOM_UTF8):
        return data[3:].decode("utf-8", "replace")
    for charset in ("utf-8", "cp932"):
        try:
            return data.decode(charset)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def decode_named(charset: str | None, data: bytes) -> str | None:
    """Text in a named charset; None if the name is unknown or the bytes aren't in it: nothing is guessed."""
    name = ALIASES.get((charset or "utf-8").strip().strip("\"'").lower().replace("-", "").replace("_", ""))
    if name is None:
        return None
    try:
        return data.decode(name)
    except (UnicodeDecodeError, LookupError):
        return None


@F.arrow_udf(StringType())
def decode_text(data: pa.Array) -> pa.Array:
    return pa.array([None if d is None else decode_bytes(d) for d in data.to_pylist()], pa.string())


@F.arrow_udf(StructType().add("text", StringType()).add("ok", BooleanType()))
def decode_charset(charset: pa.Array, data: pa.Array) -> pa.Array:
    out = [decode_named(c, d or b"") for c, d in zip(charset.to_pylist(), data.to_pylist())]
    return pa.StructArray.from_arrays([pa.array([o or "" for o in out], pa.string()), pa.array([o is not None for o in out])], ["text", "ok"])

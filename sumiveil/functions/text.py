"""Text scalars as columns; a null text gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sumiveil.functions import patterns as P


def _c(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often a lambda in ``body`` reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_ruby(text):
    """Readings in brackets directly after kanji go."""
    return F.regexp_replace(_c(text), P.RUBY, "")


def trim(text):
    return F.btrim(_c(text), F.lit(P.NARROW_SPACE))


def strip_set(text, chars: str):
    return F.btrim(_c(text), F.lit(chars))


def strip_spaces(text):
    """Without the narrow set of blanks (not the same set as :func:`strip_all_whitespace`)."""
    return F.regexp_replace(_c(text), "[ \\t\\r\\n\\x0B\\f\\u00a0\\u3000]", "")


def strip_all_whitespace(text):
    return F.regexp_replace(_c(text), r"(?U)\s", "")


def char_count(text):
    return F.char_length(_c(text))


def cut(text, begin, end):
    """Code points [begin, end); outside the text, nothing."""
    b, e = (x if isinstance(x, Column) else F.lit(x) for x in (begin, end))
    return F.when((b >= 0) & (e > b), F.substring(_c(text), b + 1, e - b)).otherwise(F.when(_c(text).isNotNull(), F.lit("")))


def split_keeping(text, pattern: str) -> Column:
    """Array of struct(piece, separator): the text's pieces, each with the separator after it."""
    t = _c(text)
    return F.arrays_zip(F.split(t, pattern).alias("piece"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("separator"))


def dewrap_prose(text):
    """Line breaks go from every block (between blank lines) that has a full stop ``。``."""
    parts = F.transform(split_keeping(text, r"\n[ \t]*\n"), lambda x: F.concat(F.when(F.contains(x["piece"], F.lit("。")), F.replace(x["piece"], F.lit("\n"), F.lit(""))).otherwise(x["piece"]), F.coalesce(x["separator"], F.lit(""))))
    return F.array_join(parts, "")


def html_to_text(html):
    """Text of a page: blocks of script, style and head go, tags become breaks, blank lines go."""
    t = _c(html)
    for tag in ("script", "style", "head"):
        t = F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "")
    t = F.regexp_replace(t, "<[^>]+>", "\n")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.array_join(F.filter(F.transform(F.split(t, P.LINE_BREAK), trim), lambda x: x != ""), "\n")


def split_lines(text):
    """Lines with their breaks, by every break character; no empty last line."""
    lines = F.transform(split_keeping(text, P.LINE_BREAK), lambda x: F.concat(x["piece"], F.coalesce(x["separator"], F.lit(""))))
    return F.filter(lines, lambda x: x != "")


def chunks(text, size: int = 250):
    """Array of struct(base, text): whole lines packed up to ``size`` code points.

    A longer line is cut into windows of ``size`` that overlap by a fifth of it.
    """
    stride = size - size // 5
    state = "struct<at:int,out:array<struct<base:int,text:string>>,hold:string,from:int>"

    def windows(line, at):
        n = F.char_length(line)
        return F.transform(F.sequence(F.lit(0), F.ceil((n - size) / stride).cast("int")), lambda k: F.struct((at + k * stride).cast("int").alias("base"), F.substring(line, k * stride + 1, F.lit(size)).alias("text")))

    def flush(s):
        return F.when(s["hold"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(s["from"].alias("base"), s["hold"].alias("text")))))

    def step(s, line):
        n = F.char_length(line)
        at = (s["at"] + n).cast("int")
        make = lambda out, hold, begin: F.struct(at.alias("at"), out.alias("out"), hold.alias("hold"), begin.alias("from")).cast(state)
        long = make(F.concat(flush(s), windows(line, s["at"])), F.lit(""), at)
        fresh = make(flush(s), line, s["at"])
        more = make(s["out"], F.concat(s["hold"], line), s["from"])
        return F.when(n > size, long).when((s["hold"] != "") & (F.char_length(s["hold"]) + n > size), fresh).when(s["hold"] == "", fresh).otherwise(more)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<base:int,text:string>>").alias("out"), F.lit("").alias("hold"), F.lit(0).alias("from")).cast(state)
    return F.aggregate(split_lines(text), start, step, flush)


def katakana_to_hiragana(text):
    kata = "".join(map(chr, range(0x30A1, 0x30F7)))
    return F.translate(_c(text), kata, "".join(chr(ord(c) - 0x60) for c in kata))


def has_letter(text):
    return _c(text).rlike(r"(?U)[\p{L}]|[^\W\d_]")


def symbol_only(text):
    return ~_c(text).rlike(P.WORD_CHAR)


def regex_escape(text):
    return F.regexp_replace(_c(text), r"([\\^$.|?*+()\[\]{}\-#&~])", r"\\$1")


def to_int(text, default: int = 0):
    """The number a text begins with; ``default`` on anything else, null or overflow."""
    return F.coalesce(F.expr("try_cast(null as int)") if text is None else F.regexp_extract(_c(text), r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(default))


def hex_to_int(text, default: int = 0):
    digits = F.regexp_extract(_c(text), r"^\s*(?:0[xX])?([0-9A-Fa-f]{1,8})", 1)
    return F.coalesce(F.when(digits != "", F.conv(digits, 16, 10)).try_cast("int"), F.lit(default))


def is_single_kanji(text):
    return _c(text).rlike(P.SINGLE_KANJI)


def is_file_extension(text):
    return F.lower(_c(text)).isin(*P.FILE_EXTENSIONS)


def base64_lenient(text):
    """Bytes of base64 up to the first ``=``, other characters left out; a lone last character is dropped."""
    clean = F.regexp_replace(F.substring_index(_c(text), "=", 1), "[^A-Za-z0-9+/]", "")
    whole = F.when(F.length(clean) % 4 == 1, F.expr("''")).otherwise(F.lit(""))
    body = F.substring(clean, F.lit(1), F.length(clean) - F.when(F.length(clean) % 4 == 1, 1).otherwise(0))
    return F.unbase64(F.concat(F.rpad(body, F.ceil(F.length(body) / 4) * 4, "="), whole))


def unfold_headers(raw):
    """Continuation lines of mail headers join the line before, with their leading blank."""
    return F.regexp_replace(_c(raw), r"\r?\n(?=[ \t])", "")


def repair_utf8(data):
    """Text of bytes, invalid sequences replaced."""
    return F.make_valid_utf8(_c(data).cast("string"))


def normalise_entity(text):
    """For comparing entities: without blanks, legal-form signs spelt out."""
    return F.replace(F.replace(strip_spaces(text), F.lit("㈱"), F.lit("株式会社")), F.lit("㈲"), F.lit("有限会社"))


def exchange_address(text):
    """Whether an address is an Exchange distinguished name."""
    return trim(text).rlike(r"^/[oO]=[^/]*(?:/(?i:ou|cn|c|dc|l|s|g|i)=[^/]*)+$")


def name_with_address(name, address):
    """``name <address>``; an empty or Exchange address is left out."""
    n, a = F.coalesce(trim(name), F.lit("")), F.coalesce(trim(address), F.lit(""))
    shown = F.concat(F.lit("<"), a, F.lit(">"))
    return F.when((a == "") | exchange_address(a), n).when(n == "", shown).otherwise(F.concat(n, F.lit(" "), shown))


def column_letter(number):
    """1 is A, 27 is AA."""
    def step(s, _):
        return F.struct(F.concat(F.when(s["n"] > 0, F.char(F.lit(65) + (s["n"] - 1) % 26)).otherwise(F.lit("")), s["out"]).alias("out"), F.when(s["n"] > 0, F.floor((s["n"] - 1) / 26)).otherwise(F.lit(0)).cast("int").alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(7)), F.struct(F.lit("").alias("out"), _c(number).cast("int").alias("n")), step, lambda s: s["out"])


def column_index(reference):
    """0-based column of a cell reference such as AB12."""
    letters = F.upper(F.regexp_extract(_c(reference), "^([A-Za-z]+)", 1))
    return F.aggregate(F.filter(F.split(letters, ""), lambda x: x != ""), F.lit(0), lambda a, x: (a * 26 + F.ascii(x) - 64).cast("int")) - 1

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sumiveil.functions import text as T
from sumiveil.functions.charset import decode_bytes, decode_charset, decode_named


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "make", "expected"),
    [
        ("難波(なんば)と東京（注）", T.strip_ruby, "難波と東京（注）"),
        ("a\nb\n\nこれは\n長い。\n \n次\n行", T.dewrap_prose, "a\nb\n\nこれは長い。\n \n次\n行"),
        ("<head><title>x</title></head><p>a&amp;b</p><script>z</script> <b>c</b>", T.html_to_text, "a&b\nc"),
        ("　 a ", T.trim, "a"),
        ("a b　c d", T.strip_spaces, "abc d"),
        ("a b　c d", T.strip_all_whitespace, "abcd"),
        ("ヤマダ・タロウー", T.katakana_to_hiragana, "やまだ・たろうー"),
        ("123", T.has_letter, False),
        ("田中", T.has_letter, True),
        ("-―・", T.symbol_only, True),
        ("-a", T.symbol_only, False),
        ("12x", T.to_int, 12),
        ("x", T.to_int, 0),
        ("999999999999", T.to_int, 0),
        ("1Fz", T.hex_to_int, 31),
        ("林", T.is_single_kanji, True),
        ("ク", T.is_single_kanji, False),
        ("PDF", T.is_file_extension, True),
        ("A: b\r\n  c\r\nD: e", T.unfold_headers, "A: b  c\r\nD: e"),
        ("AB12", T.column_index, 27),
        ("㈱ サンプル", T.normalise_entity, "株式会社サンプル"),
        ("/o=Org/ou=X/cn=Y", T.exchange_address, True),
        ("a.b*c", T.regex_escape, "a\\.b\\*c"),
        ("a\r\nb\x0bc\n\nd", T.split_lines, ["a\r\n", "b\x0b", "c\n", "\n", "d"]),
        ("", T.split_lines, []),
    ],
)
def test_scalars(spark, text, make, expected):
    assert one(spark, text, make("text")) == expected


def test_nulls_stay_null(spark):
    for make in (T.strip_ruby, T.dewrap_prose, T.html_to_text, T.trim, T.strip_spaces, T.katakana_to_hiragana):
        assert one(spark, None, make("text")) is None


def test_cut_counts_code_points(spark):
    assert one(spark, "𠮷田太郎", T.cut("text", 1, 3)) == "田太"
    assert one(spark, "abc", T.cut("text", 3, 2)) == ""


def test_column_letters(spark):
    for n, s in ((1, "A"), (26, "Z"), (27, "AA"), (703, "AAA")):
        assert one(spark, "", T.column_letter(F.lit(n))) == s


def test_names_with_addresses(spark):
    for n, a, e in ((" A ", "a@b", "A <a@b>"), ("", "a@b", "<a@b>"), ("A", "/o=x/ou=y/cn=z", "A"), ("A", None, "A"), (None, "", "")):
        df = spark.createDataFrame([(n, a)], "n string, a string")
        assert df.select(T.name_with_address("n", "a").alias("x")).first()["x"] == e


def test_base64_is_lenient(spark):
    assert bytes(one(spark, "YW\nJj=YQ==", T.base64_lenient("text"))) == b"abc"


def reference_chunks(text, size):
    import re

    out, hold, begin, base = [], "", 0, 0
    for line in re.findall(r"[^\n\r]*(?:\r\n|[\n\r])|[^\n\r]+$", text):
        if len(line) > size:
            if hold:
                out.append((begin, hold))
                hold = ""
            i = 0
            while True:
                out.append((base + i, line[i : i + size]))
                if i + size >= len(line):
                    break
                i += size - size // 5
        else:
            if hold and len(hold) + len(line) > size:
                out.append((begin, hold))
                hold = ""
            if not hold:
                begin = base
            hold += line
        base += len(line)
    return out + ([(begin, hold)] if hold else [])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab\n", max_size=60), max_size=6))
def test_chunks_match_a_sequential_model(spark, pieces):
    text = "\n".join(pieces)
    assert [(c["base"], c["text"]) for c in one(spark, text, T.chunks("text", 20))] == reference_chunks(text, 20)


def test_decoding():
    assert decode_bytes("﻿あ".encode()) == "あ"
    assert decode_bytes("山田".encode("cp932")) == "山田"
    assert decode_bytes(b"ab\xffc\x81") == "ab�c�"
    assert decode_named("ISO-2022-JP", "山田".encode("iso2022_jp")) == "山田"
    assert decode_named('"Shift_JIS"', "山田".encode("cp932")) == "山田"
    assert decode_named("utf-8", b"\xff") is None
    assert decode_named("x-unknown", b"a") is None


def test_decode_column(spark):
    df = spark.createDataFrame([("euc-jp", bytearray("山田".encode("euc_jp"))), ("x", bytearray(b"a"))], "c string, d binary")
    assert [tuple(r["x"]) for r in df.select(decode_charset("c", "d").alias("x")).collect()] == [("山田", True), ("", False)]

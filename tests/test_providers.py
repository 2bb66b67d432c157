import struct

from pyspark.sql import functions as F

from sumiveil.operators import providers as R
from sumiveil.sources.msg import msg


def morph(*parts):
    out, at = [], 0
    for surface, pos, reading in parts:
        out.append((surface, pos.split("-"), reading, at, at + len(surface)))
        at += len(surface)
    return out


def one(spark, name, parts, make):
    df = spark.createDataFrame([(name, morph(*parts))], f"n string, m {R.MORPHEMES}")
    return df.select(make("n", "m").alias("x")).first()["x"]


NAME = [("佐藤", "名詞-固有名詞-人名", "サトウ"), (" ", "空白", ""), ("美咲", "名詞-固有名詞-人名", "ミサキ"), ("さん", "接尾辞-名詞的-一般", "サン"), ("林", "名詞-固有名詞-人名", "ハヤシ")]


def test_person_core(spark):
    assert one(spark, "佐藤 美咲さん林", NAME, R.person_core) == "佐藤 美咲"
    assert one(spark, "えっと", [("えっと", "感動詞-フィラー-*", "エット")], R.person_core) == "えっと"


def test_organisation_core(spark):
    parts = [("はい", "感動詞-一般-*", ""), ("有限会社", "名詞-普通名詞-一般", ""), (" ", "空白", ""), ("蛇喰産業", "名詞-固有名詞-一般", ""), ("の", "助詞-格助詞-*", ""), ("件", "名詞-普通名詞-一般", "")]
    assert one(spark, "はい有限会社 蛇喰産業の件", parts, R.organisation_core) == "有限会社 蛇喰産業"
    assert one(spark, "ええとサンプル", [("ええと", "感動詞-フィラー-*", ""), ("サンプル", "名詞-普通名詞-一般", "")], R.organisation_core) == "サンプル"


def test_nouns_and_readings(spark):
    assert one(spark, "あの", [("あの", "連体詞-*-*", "アノ")], lambda n, m: R.no_noun(m)) is True
    assert one(spark, "", [], lambda n, m: R.no_noun(m)) is False
    assert one(spark, "佐藤 美咲", NAME[:3], R.readings) == ["サトウミサキ", "さとうみさき", "サトウ ミサキ", "さとう みさき", "サトウ　ミサキ", "さとう　みさき"]


def test_reading_terms(spark):
    terms = spark.createDataFrame([("林", "PERSON"), ("阿野", "PERSON"), ("X", "ORGANIZATION")], "text string, entity_type string")
    known = {"林": [("林", "名詞-固有名詞-人名", "ハヤシ")], "阿野": [("阿野", "名詞-固有名詞-人名", "アノ")], "ハヤシ": [("ハヤシ", "名詞-x-y", "ハヤシ")], "はやし": [("はやし", "名詞-x-y", "ハヤシ")], "アノ": [("アノ", "連体詞-x-y", "アノ")], "あの": [("あの", "連体詞-x-y", "アノ")]}
    analyse = F.udf(lambda t: morph(*known.get(t, [])), R.MORPHEMES)
    assert {tuple(r) for r in R.reading_terms(terms, analyse).collect()} == {("ハヤシ", "林"), ("はやし", "林")}


def test_entities():
    tokens = [{"label": "B-PER", "score": 1.0, "begin": 0, "end": 2}, {"label": "O", "score": 0.5, "begin": 2, "end": 5}, {"label": "B-LOC", "score": 0.5, "begin": 6, "end": 8}, {"label": "B-INS", "score": 0.5, "begin": 8, "end": 9}]
    R.align_words(tokens, "Tanaka 東京都")
    assert R.entities(tokens) == [{"type": "PERSON", "begin": 0, "end": 5, "score": 0.75}, {"type": "LOCATION", "begin": 6, "end": 8, "score": 0.5}, {"type": "LOCATION", "begin": 8, "end": 9, "score": 0.5}]


def test_model_spans(spark):
    docs = spark.createDataFrame([(1, "a" * 300), (2, None)], "doc_id long, text string")
    table = spark.createDataFrame([(1, 0, "PERSON", 210, 220, 0.5), (1, 200, "PERSON", 10, 20, 0.5), (1, 200, "PERSON", 12, 15, 0.5)], "doc_id long, base int, type string, begin int, end int, score float")
    got = {r["doc_id"]: [(s["type"], s["begin"], s["end"]) for s in r["model_spans"]] for r in R.model_spans(docs, R.TableNer(table)).collect()}
    assert got == {1: [("PERSON", 210, 220)], 2: []}
    assert all(not r["model_spans"] for r in R.model_spans(docs, R.NullNer()).collect())


def compound(streams):
    """A small compound file: every stream in the mini stream, folders one level deep."""
    names = [("Root Entry", 5, None)]
    folders = sorted({p[0] for p in streams if len(p) > 1})
    tops = [*((f, 1, None) for f in folders), *((p[0], 2, v) for p, v in streams.items() if len(p) == 1)]
    names += tops
    children = {}
    for f in folders:
        children[f] = len(names)
        names += [(p[1], 2, v) for p, v in streams.items() if len(p) > 1 and p[0] == f]
    mini, minifat, entries = b"", [], b""
    for k, (name, kind, value) in enumerate(names):
        start, size = 0xFFFFFFFE, 0
        if value is not None:
            size, n = len(value), max(1, -(-len(value) // 64))
            start = len(minifat)
            minifat += [*range(start + 1, start + n), 0xFFFFFFFE]
            mini += value.ljust(n * 64, b"\0")
        right = k + 1 if k and k < len(tops) else 0xFFFFFFFF
        if k > len(tops):
            right = k + 1 if k + 1 < len(names) and k + 1 not in children.values() else 0xFFFFFFFF
        child = 1 if not k else children.get(name, 0xFFFFFFFF) if kind == 1 else 0xFFFFFFFF
        raw = name.encode("utf-16-le") + b"\0\0"
        entries += raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, 0xFFFFFFFF, right, child) + b"\0" * 36 + struct.pack("<IQ", start, size)
    pad = lambda b: b.ljust(-(-len(b) // 512) * 512, b"\0")
    mini, table = pad(mini), pad(struct.pack(f"<{len(minifat)}I", *minifat))
    n_dir, n_mini, n_table = len(pad(entries)) // 512, len(mini) // 512, len(table) // 512
    run = lambda a, n: [*range(a + 1, a + n), 0xFFFFFFFE]
    fat = [0xFFFFFFFD, *run(1, n_dir), *run(1 + n_dir, n_mini), *run(1 + n_dir + n_mini, n_table)]
    entries = entries[:116] + struct.pack("<IQ", 1 + n_dir, len(mini)) + entries[128:]
    header = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<IIIIIIIII", 1, 1, 0, 4096, 1 + n_dir + n_mini, n_table, 0xFFFFFFFE, 0, 0)[:32]
    header = header + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    return header.ljust(512, b"\0") + pad(struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff")) + pad(entries) + mini + table


def test_msg():
    text = lambda s: s.encode("utf-16-le")
    data = compound({
        ("__substg1.0_0037001F",): text("件名です"), ("__substg1.0_0C1A001F",): text("山田"), ("__substg1.0_0C1F001F",): text("/o=X/ou=Y/cn=Z"), ("__substg1.0_1000001F",): text("一行目。\r\n二行目"),
        ("__recip_version1.0_#00000000", "__substg1.0_3001001F"): text("佐藤"), ("__recip_version1.0_#00000000", "__substg1.0_3003001F"): text("s@a.jp"),
        ("__attach_version1.0_#00000000", "__substg1.0_3707001F"): text("表.xlsx"),
    })
    got = msg(data)
    assert got == {"text": "件名: 件名です\n差出人: 山田\n受信者: 佐藤 <s@a.jp>\n\n一行目。二行目\n【添付】表.xlsx", "attachments": ["表.xlsx"], "error": ""}
    assert msg(compound({("__substg1.0_0037001F",): text("x")}))["error"]

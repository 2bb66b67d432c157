import functools
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pyspark.sql import functions as F

from sumiveil.llm import sketches as S
from sumiveil.llm.common import join_by_count, settle
from sumiveil.llm.components import connected_components
from sumiveil.llm.simhash import fingerprints, near_duplicates, near_links, one_of_each, op6_simhash
from sumiveil.llm.substrings import EDGE, TOKENS, dedup_substrings, units

from .conftest import AWKWARD


def simhash(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(pairs, n):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, x) for x in range(201, 230)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = classes(edges, 300)
    assert got == {x: root[x] for e in edges if e[0] != e[1] for x in e}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints_match_plain_ones(small):
    texts = [r["text"] for r in small.collect()] + [t or "" for _, t in AWKWARD]
    assert fingerprints(texts).tolist() == [simhash(t) for t in texts]


def test_links_match_all_pairs(spark, small):
    rng = random.Random(2)
    base = [r["text"] for r in small.limit(60).collect()]
    texts = base + [" ".join(w if rng.random() > 0.002 else "edited" for w in t.split()) for t in base for _ in range(3)] + [None, "", " "]
    fps = [simhash(t) for t in texts]
    root = classes([(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2], len(fps))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (np.int64(r["fp"]).astype(np.uint64).item(), r["component_id"]) for r in near_duplicates(docs).collect()}
    assert got == {i: (fps[i], root[i]) for i in range(len(fps))}
    assert len(set(root)) < len(root) - 3
    assert sorted(r["doc_id"] for r in one_of_each(docs).collect()) == sorted(set(root))


def all_links(fps):
    return [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2]


@pytest.mark.parametrize("crowd", [64, 3, 0])
def test_segment_tables_lose_no_link(spark, crowd):
    """Crowded first and second halves, chains and balls, against all pairs."""
    rng = random.Random(9)
    half = rng.getrandbits(32)
    fps = {rng.getrandbits(64) for _ in range(100)} | {half << 32 | rng.getrandbits(6) for _ in range(60)} | {rng.getrandbits(6) << 32 | half for _ in range(60)}
    fps |= {f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in list(fps) for _ in range(2)} | {0, 1, 3, (1 << 64) - 1, (1 << 64) - 2}
    fps = sorted(fps)
    signed = [np.uint64(f).astype(np.int64).item() for f in fps]
    found = near_links(settle(spark.createDataFrame([(f,) for f in signed], "fp long")), crowd=crowd).collect()
    at = {f: i for i, f in enumerate(signed)}
    got, expected = classes([(at[r["a"]], at[r["b"]]) for r in found], len(fps)), classes(all_links(fps), len(fps))
    assert got == expected and len(set(expected)) < len(fps) - 100


def test_hot_keys_meet_their_rows_once(spark):
    rows = [(7, i) for i in range(3000)] + [(k, k) for k in range(1000, 3000)]
    left = settle(spark.createDataFrame(rows, "k long, x long"))
    table = settle(left.groupBy("k").agg(F.count("*").alias("n")).withColumn("y", F.col("k") * 2))
    assert sorted((r["k"], r["x"], r["y"]) for r in join_by_count(left, table, "k", "n").collect()) == sorted((k, x, 2 * k) for k, x in rows)


def test_near_duplicates_bear_awkward_rows(awkward, nothing):
    rows = near_duplicates(awkward).collect()
    assert sorted((r["doc_id"] or -1, np.int64(r["fp"]).astype(np.uint64).item()) for r in rows) == sorted((i or -1, simhash(t)) for i, t in AWKWARD)
    assert {r["component_id"] for r in rows if r["fp"] == 0 and r["doc_id"] in (1, 2, 3)} == {1}
    kept = one_of_each(awkward).collect()
    assert len(kept) == len({r["root"] for r in rows}) and {r["doc_id"] for r in kept} >= {1, 4, 5}
    assert near_duplicates(nothing).count() == one_of_each(nothing).count() == 0


def test_query_columns(spark):
    out = op6_simhash(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.where("length(fingerprint) <> 16").count() == 0


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def sketch(text):
    return S.sketch_texts(pa.array([text], pa.large_string()))[0]


def test_sketch_estimates():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(5000)]
    a = " ".join(rng.choices(words, k=3000))
    b = " ".join(a.split()[:2000] + rng.choices(words, k=1500))
    x, y = sketch(a), sketch(b)
    assert S.resemblance(x, y) == pytest.approx(likeness(shingles(a), shingles(b)), abs=0.1)
    assert S.containment(x, y) == pytest.approx(len(shingles(a) & shingles(b)) / len(shingles(a)), abs=0.15)
    assert S.distinct_count(x) == pytest.approx(len(shingles(a)), rel=0.2)
    half = [sketch(" ".join(a.split()[:1600])), sketch(" ".join(a.split()[1596:]))]
    assert (S.merged(*half) == x).all()
    assert (S.read_sketch(S.shown(x)) == x).all()
    assert S.resemblance(sketch(""), sketch("")) == 1.0 and S.resemblance(sketch(""), x) == 0.0


def check_edited(rows, source):
    source = sorted(((i, t or "") for i, t in source), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    expected = []
    for (i, t), (_, u) in zip(source, source[1:] + source[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        expected.append((i or -1, len(t), hashlib.sha256(edited.encode()).hexdigest(), S.shown(sketch(t)), S.shown(sketch(edited))))
    assert sorted((r["doc_id"] or -1, r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) for r in rows) == sorted(expected)


@pytest.mark.parametrize("per_part", [5000, 3])
def test_edited_texts(small, awkward, nothing, per_part, monkeypatch):
    monkeypatch.setattr(S, "with_next", functools.partial(S.with_next, rows_per_part=per_part))
    rows = S.edited_fingerprints(small).collect()
    check_edited(rows, [(r["doc_id"], r["text"]) for r in small.collect()])
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    ids = sorted(texts)
    for r in rows:
        after = texts[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
        assert r["near_next"] == pytest.approx(likeness(shingles(texts[r["doc_id"]]), shingles(after)), abs=0.12)
    check_edited(S.edited_fingerprints(awkward).collect(), AWKWARD)
    check_edited(S.edited_fingerprints(awkward.limit(1)).collect(), AWKWARD[:1])
    assert S.edited_fingerprints(nothing).count() == 0


PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega and one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty words of it in all to make it over fifty of them"


def test_repeated_passages_go(spark):
    rng = random.Random(3)
    own = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    rows = [(1, f"{own(20)} {PASSAGE} {own(20)}"), (2, f"{PASSAGE}\n{own(30)}"), (3, f"{own(30)}\n{PASSAGE}\n{own(10)}"), (4, f"{own(15)} {PASSAGE.upper()}. {own(9)}"), (5, own(60)), (6, f"{own(9)}\n{PASSAGE}\nx\n{PASSAGE}")]
    got = {r["doc_id"]: r for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    assert got[1]["text"] == texts[1] and got[5]["text"] == texts[5] and not got[5]["spans"]
    for i in (2, 3, 4, 6):
        cut = texts[i]
        for s in reversed(got[i]["spans"]):
            cut = cut[: s["start"]] + cut[s["end"] :]
        assert cut == got[i]["text"] and got[i]["n_removed"] >= 0.7 * len(PASSAGE)
    assert got[6]["n_removed"] >= 1.5 * len(PASSAGE)


def normal(text):
    """Per token its normalised word, or None for a line break."""
    return [None if m.group() == "\n" else m.group().lower().strip(EDGE) for m in TOKENS.finditer(text)]


def test_units_are_told_apart_by_every_word():
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.randint(1, 40))) + rng.choice(["", "\n", "\n\nx y"]) for _ in range(400)]
    own = units(pa.array(texts, pa.large_string()))
    seen, lines = {}, 0
    for row, first, end, digest in zip(own["row"], own["first"], own["end"], own["digest"]):
        tokens = normal(texts[row])
        unit = tuple(tokens[first:end])
        whole = (first == 0 or tokens[first - 1] is None) and (end == len(tokens) or tokens[end] is None)
        assert None not in unit and seen.setdefault(int(digest), unit) == unit and (whole or len(unit) >= 10)
        lines += whole
    assert len(seen) > 1000 and lines >= sum(bool(x.strip()) for t in texts for x in t.split("\n"))


def brute_dedup(rows, min_words=10):
    """Which tokens of each row go, from plain comparisons of token sequences; rows in order of rank."""
    own = units(pa.array([t for _, t in rows], pa.large_string()), min_words=min_words)
    tokens = [normal(t) for _, t in rows]
    kinds = lambda r, a, b: ("line" if (a == 0 or tokens[r][a - 1] is None) and (b == len(tokens[r]) or tokens[r][b] is None) and w < min_words else "", *tokens[r][a:b]) if (w := b - a) else ()
    seen, goes = set(), [set() for _ in rows]
    for r, a, b in zip(own["row"].tolist(), own["first"].tolist(), own["end"].tolist()):
        if kinds(r, a, b) in seen:
            goes[r] |= set(range(a, b))
        seen.add(kinds(r, a, b))
    return goes


def test_substrings_match_brute_force(spark, small):
    source = sorted((r["doc_id"], r["text"] or "") for r in small.collect())
    goes = brute_dedup(source)
    got = {r["doc_id"]: r for r in dedup_substrings(small).collect()}
    lost = 0
    for (i, t), gone in zip(source, goes):
        spans = [m.span() for m in TOKENS.finditer(t)]
        hit = lambda a, b, i=i: any(s["start"] <= a and b <= s["end"] for s in got[i]["spans"])
        assert {k for k, (a, b) in enumerate(spans) if t[a:b] != "\n" and hit(a, b)} == gone
        lost += len(gone)
        cut = t
        for s in reversed(got[i]["spans"]):
            cut = cut[: s["start"]] + cut[s["end"] :]
        assert cut == got[i]["text"] and got[i]["n_removed"] == len(t) - len(cut)
    assert lost > 1000


def test_every_later_line_goes(spark):
    """Lines of one to a dozen words, in documents, in a document, under null and repeated ids."""
    rows = [(1, "six words make up this line\nalpha"), (2, "beta gamma\nanother line with seven words here"), (3, "six words make up this line\nanother line with seven words here"), (4, "six words make up this line"),
            (None, "only here twice\nx1"), (None, "only here twice\nx2"), (5, "same id first\ny1"), (5, "same id first\ny2"), (6, "z\nz\n---\n---"), (None, "only here twice\nx1")]
    got = sorted((r["doc_id"] or 99, r["text"]) for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    one, two = [t for i, t in got if i == 5]
    assert {one, two} in ({"same id first\ny1", "y2"}, {"same id first\ny2", "y1"})
    nulls = sorted(t for i, t in got if i == 99)
    assert nulls in (["only here twice\nx1", "only here twice\nx1", "x2"], ["only here twice\nx2", "x1", "x1"])
    assert [t for i, t in got if i < 5 or i == 6] == [rows[0][1], rows[1][1], "", "", "z\n---\n---"]


def test_passages_need_one_source(spark):
    """Pieces that stand in two texts, but nowhere one after another, stay; the same words in a row go."""
    rng = random.Random(6)
    own = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    a, b = own(6), own(6)
    rows = [(1, f"{own(20)} {a} {own(20)}"), (2, f"{own(20)} {b} {own(20)}"), (3, f"{own(20)} {a} {b} {own(20)}")]
    got = {r["doc_id"]: r["text"] for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(rows)


def test_whole_lines_and_lone_short_ones(spark):
    line = "this very line of ten words stands in two texts"
    rows = [(1, f"{line}\nyes"), (2, f"no\n{line}\nyes"), (3, "yes")]
    got = {r["doc_id"]: r["text"] for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "no\n", 3: ""}


def test_substrings_bear_awkward_rows(awkward, nothing):
    rows = dedup_substrings(awkward).collect()
    assert sorted(r["doc_id"] or -1 for r in rows) == sorted(i or -1 for i, _ in AWKWARD)
    by = {r["doc_id"]: r for r in rows}
    assert by[5]["text"] == AWKWARD[4][1] and by[6]["text"] == "" and by[1]["text"] == by[2]["text"] == ""
    assert dedup_substrings(nothing).count() == 0


def test_names_that_clash(spark):
    """Columns of the caller keep their values, even under names that the operators use for their own."""
    from sumiveil.llm.quality import measure
    from sumiveil.llm.substrings import with_substrings_removed

    names = ["_key", "_later", "_rank", "_words", "_n", "__key", "_bad", "key", "fp", "rank", "digest"]
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven", *range(len(names))), (2, "one two three four five six seven eight nine ten eleven", *range(9, 9 + len(names)))], ["doc_id", "text", *names])
    for out in (measure(docs), with_substrings_removed(docs), one_of_each(docs)):
        rows = {r["doc_id"]: r for r in out.collect()}
        assert [rows[1][c] for c in names] == list(range(len(names))) and out.columns[: len(docs.columns)] == docs.columns

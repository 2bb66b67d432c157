import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sumiveil.llm import licenses as L
from sumiveil.llm import maxent as X
from sumiveil.llm import toxicity as T
from sumiveil.llm.quality import quality_rules

from .conftest import AWKWARD

WORD = r"[^\x20\x09-\x0D]+"


def base_counts(text):
    text = text or ""
    w = re.findall(WORD, text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_base_counts(small, awkward, nothing):
    for docs, source in ((small, [(r["doc_id"], r["text"]) for r in small.collect()]), (awkward, AWKWARD)):
        rows = quality_rules(docs).collect()
        assert sorted((r["doc_id"] or -1, *r[1:7]) for r in rows) == sorted((i or -1, *base_counts(t)) for i, t in source)
        assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert quality_rules(nothing).count() == 0


def test_line_rules(spark):
    good = "This is a line of ordinary prose that ends as it should."
    rows = [
        (1, "\n".join([good, "Then there is another one, about something else entirely."])),
        (2, f"{good}\nHome | About | Contact | Help\nAll rights reserved.\nSkip to content"),
        (3, "\n".join(["BUY!! NOW!! THIS!! IS!! IT!!"] * 1 + ["a$$$ b%%% c### d&&& e*** f$$$ g%%%", "x | y | z | w | v"])),
        (4, good + "\n" + "BUY!! NOW!! OR!! NEVER!! SEE!! IT!! AGAIN!! EVER!! I!! SAY!! YES!! NO!! A!! B!! C!!"),
    ]
    got = {r["doc_id"]: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["kept"] and got[1]["cleaned_text"] == rows[0][1]
    assert got[2]["n_bad_lines"] == 3 and got[2]["cleaned_text"] == good
    assert not got[3]["kept"] and not got[4]["kept"] and got[4]["n_bad_lines"] == 1


def test_labelled_documents(spark, small):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = quality_rules(small).join(labels, "doc_id").collect()
    assert all(r["kept"] or r["base_failed"] for r in rows if r["quality"] == 1)


def license_shingles(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return [L._chain(x.encode() for x in w[i : i + 5]) for i in range(len(w) - 4)]


def test_licenses_match_a_sliding_window(spark, awkward, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    words = L.TEMPLATES["MIT"].split()
    edited = words[:30] + ["other"] + words[31:]
    planted = [(9001, "foo " * 100 + L.TEMPLATES["MIT"] + " bar" * 50), (9002, "q " * 31 + " ".join(edited) + " r" * 77), (9003, L.TEMPLATES["GPL-2.0"].upper() + " z " + L.TEMPLATES["BSD"]), (9004, " ".join(words[::2]))]
    every = docs.union(spark.createDataFrame(planted, "doc_id long, text string")).union(awkward.select("doc_id", "text"))
    expected = {}
    for r in every.collect():
        s = license_shingles(r["text"])
        for name, text in L.TEMPLATES.items():
            t = set(license_shingles(text))
            share = max((len(t & set(s[i : i + len(t) + max(1, len(t) // 8)])) / len(t) for i, h in enumerate(s) if h in t), default=0)
            if share >= L.LEAST:
                expected[r["doc_id"], name] = share
    got = {(r["doc_id"], r["license"]): r["containment"] for r in L.scan_licenses(every).collect()}
    assert set(got) == set(expected) and {(9001, "MIT"), (9002, "MIT"), (9003, "BSD")} <= set(got)
    assert all(got[k] == pytest.approx(expected[k], abs=0.1) for k in got)
    assert L.scan_licenses(nothing).count() == 0
    with pytest.raises(ValueError, match="under 5 words"):
        L.scan_licenses(nothing, {"short": "too short"})


def toxic_corpus(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    out = []
    for i in range(n):
        w = rng.choices(words, k=rng.randint(5, 200))
        if label := int(rng.random() < 0.2):
            for _ in range(max(1, len(w) // 60)):
                w.insert(rng.randrange(len(w)), rng.choice(["zorko", "zorkas,", "Vilxum.", "vilxa"]))
        out.append((i, " ".join(w), label))
    return out


def test_toxicity(spark, awkward, nothing):
    rows = toxic_corpus(1, 1200)
    models = T.fit(spark.createDataFrame([(t, y) for _, t, y in rows[:900]], "text string, label int"))
    held = spark.createDataFrame(rows[900:], "doc_id long, text string, label int")
    got = held.select("label", T.toxicity(models, F.col("text"), spark).alias("s")).collect()
    assert np.mean([(r["s"] >= 0.5) == r["label"] for r in got]) > 0.97
    scores = [r[0] for r in awkward.select(T.toxicity(models, F.col("text"), spark)).collect()]
    assert len(scores) == len(AWKWARD) and all(0 <= s < 0.5 for s in scores)
    assert nothing.select(T.toxicity(models, F.col("text"), spark)).count() == 0
    empty = T.fit(spark.createDataFrame([], "text string, label int"))
    assert awkward.select(T.toxicity(empty, F.col("text"), spark).alias("s")).where("s >= 0.5").count() == 0


def brute_differences(train, text):
    """Interpolated Kneser-Ney bigrams of both classes from plain dictionaries: per word, of the best two words, and of those by single words."""
    plain = lambda t: [w.decode("utf8").lower().strip(T.EDGE) for w in (t or "").encode().split()]
    pair, cont = [Counter(), Counter()], [Counter(), Counter()]
    for t, y in train:
        w = plain(t)
        pair[y].update(set(zip(["<s>", *w], w)))
    for y in (0, 1):
        cont[y].update(b for _, b in pair[y])
    words = {b for y in (0, 1) for b in cont[y]}
    stem = lambda w: w[: T.STEM]
    stems = [Counter(), Counter()]
    for y in (0, 1):
        for w, n in cont[y].items():
            stems[y][stem(w)] += n
    kept_pairs = {p for y in (0, 1) for p, n in pair[y].items() if n > 1}
    total, context = [max(1, sum(c.values())) for c in cont], [Counter(), Counter()]
    for y in (0, 1):
        for (a, _), n in pair[y].items():
            context[y][a] += n

    def p_stem(y, s):
        share = (stems[0][s] + stems[1][s]) / sum(sum(x.values()) for x in stems)
        return (max(stems[y][s] - T.STEM_DISCOUNT, 0) + sum(min(n, T.STEM_DISCOUNT) for n in stems[y].values()) * share) / total[y]

    free = [sum(min(n, T.DISCOUNT) for n in cont[y].values()) / total[y] for y in (0, 1)]

    def p_word(y, w):
        s = stem(w)
        inside = (cont[0][w] + cont[1][w]) / (stems[0][s] + stems[1][s])
        return max(cont[y][w] - T.DISCOUNT, 0) / total[y] + free[y] * p_stem(y, s) * inside

    def p_pair(y, a, w):
        n = context[y][a]
        own = max(pair[y][a, w] - T.DISCOUNT, 0) / n if n and (a, w) in kept_pairs else 0
        rest = 1 - sum(max(m - T.DISCOUNT, 0) / n for (x, v), m in pair[y].items() if x == a and (x, v) in kept_pairs) if n else 1
        if w in words:
            return own + rest * p_word(y, w)
        return rest * (free[y] * p_stem(y, stem(w)) if stem(w) in stems[0] or stem(w) in stems[1] else 1)

    def p_alone(y, w):
        return p_word(y, w) if w in words else free[y] * p_stem(y, stem(w)) if stem(w) in stems[0] or stem(w) in stems[1] else 1

    w = plain(text)
    gain = [math.log(p_pair(1, a, b)) - math.log(p_pair(0, a, b)) for a, b in zip(["<s>", *w], w)]
    alone = [math.log(p_alone(1, x)) - math.log(p_alone(0, x)) for x in w]
    best = lambda g: max([(a + b) / 2 for a, b in zip(g, g[1:])] or g)
    return (sum(gain) / len(gain), best(gain), best(alone)) if w else (0.0, 0.0, 0.0)


def test_toxicity_matches_brute_force(spark):
    rows = [(t, y) for _, t, y in toxic_corpus(5, 160)]
    labelled = spark.createDataFrame(rows, "text string, label int").withColumn("part", F.pmod(F.xxhash64("text"), F.lit(4))).collect()
    models = T.fit(spark.createDataFrame(rows, "text string, label int"))
    train = [(r["text"], r["label"]) for r in labelled if r["part"]]
    texts = [t for t, _ in rows[:25]] + ["", "zorko zorkas unknownword", "Vilxum.", " \n"]
    got = models.differences(pa.array(texts, pa.large_string()))
    assert got == pytest.approx(np.array([brute_differences(train, t) for t in texts]), abs=1e-6)


def test_labelled_sample_is_bounded(spark):
    twice = spark.createDataFrame([(1, f"t{i}") for i in range(500)] + [(2, None)], "doc_id long, text string")
    assert T.labelled_sample(twice, spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id long, toxic int")).count() == 2

    docs = spark.createDataFrame([(i, f"t{i}") for i in range(50)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(40)] + [(None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    assert T.labelled_sample(docs, labels, bound=15).count() == 15
    assert T.labelled_sample(docs, labels).count() == 40


def ngram_tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + ["\n"]


@pytest.mark.parametrize("known", [X.KNOWN, 500])
def test_language_model(spark, small, awkward, known, monkeypatch):
    monkeypatch.setattr(X, "KNOWN", known)
    docs = small.select("doc_id", "text").union(awkward.select("doc_id", "text"))
    source = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    model, vocabulary = X.train(docs.where(~out))
    rows = X.score(docs, model, vocabulary, keep={"doc_id": F.col("doc_id"), "held_out": out}).collect()
    count = Counter()
    for i, t in source:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(ngram_tokens(t))
    total, types = sum(count.values()), len(count)
    expected = sorted((i or -1, len(w := ngram_tokens(t)), sum(x in count for x in w), total, round(sum(math.log10((count[x] + 1) / (total + types + 1)) for x in w), 6)) for i, t in source)
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == expected
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def plain_probability(model, counts, word, one, two):
    """P(word | history) of a trained model, a word at a time, from its weights and all counts."""
    hashed = lambda w: X.tokens(pa.array([w], pa.large_string()))[2][:1] if w != "\n" else np.array([X.END])

    def number(w):
        if w is None:
            return X.START, 0
        symbol, past, _ = model.look_up(np.zeros(1, int), hashed(w))
        return int(symbol[0]), int(past[0]) if symbol[0] >= X.HEAD else 0

    (one, a), (two, b) = number(one), number(two)
    symbol = int(model.look_up(np.zeros(1, int), hashed(word))[0][0])
    history = np.array([[one], [two], [a], [b]], np.uint32)
    softmax = lambda x: np.exp(x) / np.exp(x).sum()
    p = softmax(model.class_bias.astype(float) + sum(model.classes[r[0]].astype(float) for _, r in model.class_rows(history) if len(r)))
    if symbol >= X.HEAD:
        return p[X.HEAD_CLASSES + symbol - X.HEAD] * (counts[word] + 1) / model.rare[symbol - X.HEAD]
    kind, slot = divmod(symbol, X.SLOTS)
    return p[kind] * softmax(model.slot_bias[kind].astype(float) + sum(model.slots[r[0]].astype(float) for r in model.slot_rows(np.array([kind]), history)))[slot]


@pytest.mark.parametrize("known", [X.KNOWN, 300])
def test_language_model_score_matches_plain_one(spark, small, known, monkeypatch):
    monkeypatch.setattr(X, "KNOWN", known)
    docs = small.select("doc_id", "text").orderBy("doc_id").limit(60)
    source = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    learnt = docs.where("doc_id % 3 <> 0")
    model, others = X.train(learnt)
    counts = Counter(w for i, t in source if i % 3 for w in ngram_tokens(t))
    got = {r["doc_id"]: r["score"] for r in X.score(docs, model, others, keep={"doc_id": F.col("doc_id")}).collect()}
    short = sorted(source, key=lambda r: len(r[1] or ""))[:12]
    assert len({i % 3 == 0 for i, _ in short}) == 2
    for i, t in short:
        w = ngram_tokens(t)
        plain = sum(math.log10(plain_probability(model, counts, x, w[k - 1] if k else None, w[k - 2] if k > 1 else None)) for k, x in enumerate(w))
        assert got[i] == pytest.approx(plain, rel=1e-4)


def test_language_model_adds_up_to_one(small):
    docs = small.limit(60)
    model, _ = X.train(docs)
    counts = Counter(w for r in docs.collect() for w in ngram_tokens(r["text"]))
    words = list(counts)
    for one, two in ((words[3], words[70]), (None, None), (min(words, key=counts.get), words[5])):
        seen = sum(plain_probability(model, counts, w, one, two) for w in words)
        # an unseen word of each shape has what one more type of it has
        unseen = {X.shape(w): w for w in ("zzzz", "zzzz.", "zzzz%", "zzzzzzzzzz", "zzzzzzzzzz.", "zzzzzzzzzz%", "ßzzz", "ßzzz.", "ßzzz%", "ßzzzzzzzzz", "ßzzzzzzzzz.", "ßzzzzzzzzz%")}
        assert len(unseen) == X.RARE and not set(unseen.values()) & set(counts)
        assert seen + sum(plain_probability(model, counts, w, one, two) for w in unseen.values()) == pytest.approx(1, abs=1e-3)


def test_rarer_words_are_features(small):
    """Histories that differ in a word beyond the most frequent, but not in its shape, have different features."""
    model, _ = X.train(small)
    words = {w for r in small.collect() for w in ngram_tokens(r["text"])}
    by_shape = {}
    for w in sorted(words - {"\n"}):
        symbol, past, _ = model.look_up(np.zeros(1, int), X.tokens(pa.array([w], pa.large_string()))[2][:1])
        if symbol[0] >= X.HEAD:
            by_shape.setdefault(int(symbol[0]), []).append(int(past[0]))
    symbol, (a, b, *_) = max(by_shape.items(), key=lambda x: len(x[1]))
    rows = [[int(r[0]) for _, r in model.class_rows(np.array([[symbol], [symbol], [x], [x]], np.uint32))] for x in (a, b)]
    assert len(words) > 2 * X.HEAD and rows[0][:3] == rows[1][:3] and rows[0][3] != rows[1][3]
    slots = [model.slot_rows(np.array([1]), np.array([[symbol], [symbol], [x], [x]], np.uint32)) for x in (a, b)]
    assert all(x[0] != y[0] for x, y in zip(*slots))


def test_known_words_are_bounded_and_never_none(spark, monkeypatch):
    monkeypatch.setattr(X, "KNOWN", 100)
    once = spark.createDataFrame([(i * 7919, 1) for i in range(5000)], "hash long, n long")
    known, others = X._known(once)
    assert 50 < known.num_rows <= 110 and once.where(others).count() == 5000 - known.num_rows
    known, others = X._known(once.union(spark.createDataFrame([(-i, 1 + i) for i in range(1, 31)], "hash long, n long")))
    assert 50 < known.num_rows <= 110 and known.column("n").to_pylist().count(1) == known.num_rows - 30


def test_sums_go_through_a_tree(spark, small, monkeypatch):
    monkeypatch.setattr(X, "TOKENS_PER_TRAINER", 2_000)
    docs = small.repartition(12).cache()
    trees = []
    for fan in (2, 64):
        monkeypatch.setattr(X, "FAN", fan)
        trees.append(X.train(docs)[0])
    assert trees[0].classes == pytest.approx(trees[1].classes, abs=1e-3) and abs(trees[0].classes).max() > 0.01


def test_language_model_of_nothing(nothing, awkward):
    model, vocabulary = X.train(nothing)
    assert X.score(nothing, model, vocabulary, keep={"doc_id": F.col("doc_id")}).count() == 0
    rows = X.score(awkward, model, vocabulary, keep={"doc_id": F.col("doc_id")}).collect()
    assert len(rows) == len(AWKWARD) and all(math.isfinite(r["score"]) and r["n_known"] == 0 for r in rows)


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
            docs = docs.cache()
            counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] == counts[4] > 0
    assert sorted(map(tuple, docs.drop("sequence_id", "offset").collect())) == sorted(map(tuple, corpus_pipeline.run(spark, sf).drop("sequence_id", "offset").collect()))


def test_pipeline_bears_awkward_rows(spark, awkward, nothing):
    sf = "/root/testdata/sf0.001"
    for given in (awkward, nothing):
        docs = given.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("n_chars"))
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf)
            assert out.count() >= 0
            assert k == 4 or out.columns == corpus_pipeline.COLUMNS


def test_license_recall_over_edited_templates(spark):
    """Templates with words changed, whose containment is 0.8 or more, inside other words: nearly all are found."""
    from sumiveil.llm import licenses as L

    rng, rows, wanted = random.Random(12), [], set()
    for name, text in L.TEMPLATES.items():
        own = set(L.template_shingles(text))
        for _ in range(12):
            words = text.split()
            for _ in range(rng.randint(0, max(0, len(own) // 25 + 1))):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(1000)}"
            around = [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(0, 60))) for _ in range(2)]
            i = len(rows)
            rows.append((i, f"{around[0]} {' '.join(words)} {around[1]}"))
            if len(own & set(L.template_shingles(rows[i][1]))) >= L.LEAST * len(own):
                wanted.add((i, name))
    got = {(r["doc_id"], r["license"]) for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(wanted) > 120 and len(wanted & got) >= 0.97 * len(wanted), (len(wanted), len(wanted & got))

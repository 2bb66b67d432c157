import random

from pyspark.sql import functions as F

from corpus_pipeline import near_duplicate_stage
from sumiveil.llm.common import settle
from sumiveil.llm.likeness import prefix_pairs, whole_set

from .conftest import AWKWARD
from .test_duplicates import classes, likeness, shingles, simhash


def test_stage_takes_all_texts_alike(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choices(words, k=n) for n in (4, 9, 30, 60, 120, 250) for _ in range(4)]
    edited = [["other" if rng.random() < rate else w for w in t] for t in base for rate in (0.005, 0.01, 0.02, 0.03, 0.05)]
    hub = rng.choices(words, k=300)  # its copies are alike to it, but hardly to each other
    spokes = [hub[:k] + ["x%d" % k] + hub[k + 1 :] for k in range(10, 290, 7)] + [hub[: 4 * k] + rng.choices(words, k=30) + hub[4 * k + 30 :] for k in range(1, 60)]
    texts = [" ".join(t) for t in base + edited + [hub] + spokes]
    sets = [shingles(t) for t in texts]
    fps = [simhash(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if likeness(sets[i], sets[j]) >= 0.8 or bin(fps[i] ^ fps[j]).count("1") <= 2]
    assert sum(bin(fps[i] ^ fps[j]).count("1") > 2 for i, j in pairs) > 50
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in near_duplicate_stage(spark, docs, "").collect()) == sorted(set(classes(pairs, len(texts))))


def test_stage_bears_awkward_rows(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in AWKWARD], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in near_duplicate_stage(spark, docs, "").collect()}
    assert kept >= {1, 4, 5, 8, 9, 10} and not kept & {2, 3, 6}
    assert near_duplicate_stage(spark, docs.limit(0), "").count() == 0


def test_prefix_filter_loses_no_pair(spark):
    """A group with edits of its own, of sets of several sizes: all pairs alike are met, few others."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(2000)]
    texts = []
    for n in (5, 12, 60, 150):
        base = rng.choices(words, k=n)
        for k in range(60):
            t = list(base)
            for i in rng.sample(range(n), min(n, k // 6)):
                t[i] = f"e{rng.randrange(10 ** 6)}"
            texts.append(" ".join(t[: n - k % 7] if n > 20 else t))
    texts = sorted(set(texts))
    sets = [shingles(t) for t in texts]
    own = spark.createDataFrame([(i, i, len(sets[i]), t) for i, t in enumerate(texts)], "node long, root long, n int, text string")
    got = {(r["a"], r["b"]) for r in prefix_pairs(settle(own.select("node", "root", "n", whole_set(F.col("text")).alias("s")))).collect()}
    alike = {(i, j) for j in range(len(texts)) for i in range(j) if likeness(sets[i], sets[j]) >= 0.8}
    assert alike <= got and len(alike) > 150 and len(got) < 0.5 * len(texts) * (len(texts) - 1) / 2

"""Toxicity by two class-conditional Kneser-Ney models with shared backoff counts.

Each class, toxic and ordinary, has an interpolated Kneser-Ney model of bigrams.  What a bigram's
discount frees goes to the word by its continuation counts in the class (after how many different
words it was seen, so copies of a text count once), what the word's discount frees to the word's stem
(its first letters), again by the class's continuation counts, and what the stem's discount frees to
counts that both classes share.  A word that is rare in either class so has the likelihood of its
stem, and a rare stem is as likely in both classes.  Bigrams are counted in texts; those of one text
only are left to the backoff.

Log-likelihoods are compared per word: over the whole text, over its most toxic passage of ``PASSAGE``
words, and over that passage with words taken by themselves, which bigrams of copied texts don't
sway.  The score is the logistic of the three differences, fitted on labelled texts that gave no
counts.  Over the whole text alone the difference mostly tells the languages and topics of the
classes apart; a few insults in a long text show in the passages.

At most ``MAX_LABELLED`` labelled documents are used, those with the least hashes of their ids; that
bounds the tables that are broadcast, too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sumiveil.llm.common import once, read_table, row_sums, settle, slices, tabled, words_of

MAX_LABELLED = 20_000
STEM = 4
PASSAGE = 2
DISCOUNT = 0.75
STEM_DISCOUNT = 0.75
EDGE = ".,;:!?()[]{}\"'«»¡¿…*_-$%&#|<>=/\\~"


def word_hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word, lower-cased and without punctuation at its ends, and of its stem."""
    plain = [w.lower().strip(EDGE) for w in words.to_pylist()]
    digest = xxhash.xxh64_intdigest
    return (
        np.fromiter((digest(w) for w in plain), np.uint64, len(plain)).view(np.int64),
        np.fromiter((digest(w[:STEM], 1) for w in plain), np.uint64, len(plain)).view(np.int64),
    )


#: Stands before the first word of a text.
START = -1
STEM_ROW = 2


def bigrams(labelled: DataFrame) -> DataFrame:
    """before, word, is_stem, b0, b1: the number of texts that have a word after another, by class.

    Where is_stem holds, before is the word's stem: each word has one such row.
    """

    def pairs(batches):
        for batch in batches:
            for at, some in slices(batch.column(0)):
                codes, offsets, words = words_of(some)
                word, stem = word_hashes(words)
                size = np.diff(offsets)
                before = np.full(len(codes), len(words), np.int64)
                before[1:] = codes[:-1]
                before[offsets[:-1][size > 0]] = len(words)
                text = np.repeat(np.arange(len(size)), size)
                label = batch.column(1).slice(at, len(some)).to_numpy(zero_copy_only=False).astype(np.int64)
                order = np.lexsort((codes, before, text))
                text, before, codes = text[order], before[order], codes[order]
                new = np.ones(len(codes), bool)
                new[1:] = (text[1:] != text[:-1]) | (before[1:] != before[:-1]) | (codes[1:] != codes[:-1])
                # each once a text, then summed over the slice
                key, n = np.unique((label[text[new]] * (len(words) + 1) + before[new]) * max(1, len(words)) + codes[new], return_counts=True)
                rest, code = np.divmod(key, max(1, len(words)))
                kind, prev = np.divmod(rest, len(words) + 1)
                ends = np.append(word, START)
                columns = np.append(kind, np.full(len(word), STEM_ROW)).astype(np.int32), np.append(ends[prev], stem), np.append(word[code], word), np.append(n, np.ones(len(word), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["label", "before", "word", "n"])

    seen = labelled.select("text", "label").mapInArrow(pairs, "label int, before long, word long, n long")
    by = lambda c: F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)).alias(f"b{c}")
    return seen.groupBy((F.col("label") == STEM_ROW).alias("is_stem"), "before", "word").agg(by(0), by(1))


class Models:
    """What each known bigram, word and stem adds to the toxic less the ordinary log-likelihood.

    ``words`` has word, stem and, by class, in how many contexts the word was seen (n0, n1);
    ``contexts`` has before and its bigrams' counts (b0, b1); ``pairs`` the bigrams that are kept.
    """

    def __init__(self, words: dict[str, np.ndarray], contexts: dict[str, np.ndarray], pairs: dict[str, np.ndarray]):
        both = lambda t, c: np.stack([t[f"{c}0"], t[f"{c}1"]], axis=1).astype(np.float64).reshape(-1, 2)
        self.line = np.array([-10.0, 0.0, 0.0, 0.0])
        order = np.argsort(words["word"])
        self.word, stem, n = words["word"][order], words["stem"][order], both(words, "n")[order]
        self.stem, of = np.unique(stem, return_inverse=True)
        m = np.stack([np.bincount(of, weights=n[:, c], minlength=len(self.stem)) for c in (0, 1)], axis=1) if len(n) else np.zeros((0, 2))
        total = np.maximum(n.sum(axis=0), 1)
        shared = m.sum(axis=1, keepdims=True) / max(m.sum(), 1)
        kept = np.maximum(m - STEM_DISCOUNT, 0)
        stems = kept / total + (1 - kept.sum(axis=0) / total) * shared
        self.free = np.maximum(1 - np.maximum(n - DISCOUNT, 0).sum(axis=0) / total, 1e-9)
        inside = n.sum(axis=1, keepdims=True) / np.maximum(m.sum(axis=1, keepdims=True)[of], 1)
        self.words = np.maximum(n - DISCOUNT, 0) / total + self.free * stems[of] * inside
        base = self.free * stems
        self.stem_gain = np.log(base[:, 1]) - np.log(base[:, 0])
        # bigrams, by the places of their words; the place after the last is a text's start
        place = lambda x: np.where(x == START, len(self.word), np.searchsorted(self.word, x))
        before, seen = place(contexts["before"]), both(contexts, "b")
        self.seen = np.zeros((len(self.word) + 2, 2))  # the last: words that are not known
        self.seen[before] = seen
        at, count = place(pairs["before"]), both(pairs, "b")
        key = at * (len(self.word) + 1) + place(pairs["word"])
        order = np.argsort(key)
        self.pair = key[order]
        self.pair_own = (np.maximum(count - DISCOUNT, 0) / np.maximum(self.seen[at], 1))[order]
        used = np.stack([np.bincount(at[order], weights=self.pair_own[:, c], minlength=len(self.seen)) for c in (0, 1)], axis=1) if len(at) else np.zeros_like(self.seen)
        self.pair_free = np.maximum(1 - used, 1e-9)

    def places(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each word its place among the known (the one after a text's start if it is none), and the gain of its stem."""
        word, stem = word_hashes(words)
        place, gain = np.full(len(word), len(self.word) + 1), np.zeros(len(word))
        if len(self.word) and len(word):
            at = np.minimum(np.searchsorted(self.word, word), len(self.word) - 1)
            hit = self.word[at] == word
            place[hit] = at[hit]
            at = np.minimum(np.searchsorted(self.stem, stem), len(self.stem) - 1)
            hit = self.stem[at] == stem
            gain[hit] = self.stem_gain[at[hit]]
        return place, gain

    def gains(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Per word of the texts the toxic less the ordinary log-probability, after the word before and by itself, and row offsets."""
        codes, offsets, words = words_of(texts)
        if not len(codes):
            return np.zeros((2, 0)), offsets
        place, stem_gain = self.places(words)
        own = place[codes]
        before = np.full(len(own), len(self.word))
        before[1:] = own[:-1]
        before[offsets[:-1][offsets[:-1] < offsets[1:]]] = len(self.word)
        free = self.pair_free[before]
        known = own < len(self.word)
        p = free * self.words[np.where(known, own, 0)] if len(self.word) else free.copy()
        if len(self.pair):
            key = before * (len(self.word) + 1) + own
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            hit = known & (self.pair[at] == key)
            p[hit] += self.pair_own[at[hit]]
        p = np.where(known[:, None], p, free)
        ratio = lambda x: np.log(x[:, 1]) - np.log(x[:, 0])
        stem = np.where(known, 0.0, stem_gain[codes])
        alone = np.append(ratio(self.words), [0.0, 0.0])[own]
        return np.stack([ratio(p), alone]) + stem, offsets

    def differences(self, texts: pa.Array) -> np.ndarray:
        """Per text the difference per word of the whole text, of the passage where it is greatest, and so by single words; 0 without words."""
        gain, offsets = self.gains(texts)
        out = np.zeros((len(texts), 3))
        n = np.diff(offsets)
        full = n > 0
        if not full.any():
            return out
        out[full, 0] = row_sums(gain[0], offsets)[full] / n[full]
        total, size = gain.copy(), np.ones(gain.shape[1])
        last = np.repeat(offsets[1:], n)
        for k in range(1, PASSAGE):
            inside = np.flatnonzero(np.arange(len(size)) + k < last)
            total[:, inside] += gain[:, inside + k]
            size[inside] += 1
        # a passage that the text's end cuts short counts only in a text as short as that
        short = (size < PASSAGE) & (np.repeat(n, n) >= PASSAGE)
        out[full, 1:] = np.maximum.reduceat(np.where(short, -np.inf, total / size), offsets[:-1][full], axis=1).T
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.line[0] + self.differences(texts) @ self.line[1:], -40, 40)))

    def fit_line(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression of the label on the differences, by Newton steps."""
        if len(set(y.tolist())) < 2:
            return
        m, s = x.mean(axis=0), x.std(axis=0)
        s[s == 0] = 1.0
        z = np.concatenate([np.ones((len(x), 1)), (x - m) / s], axis=1)
        w = np.zeros(4)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(4) * 0.01, z.T @ (y - p) - 0.01 * w)
            w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        self.line = np.array([w[0] - (w[1:] * m / s).sum(), *(w[1:] / s)])


def fit(labelled: DataFrame) -> Models:
    """Models from the columns text and label (0 or 1; other labels and nulls are left out).

    A quarter of the texts, by their hash, fit the line; the others give the counts.  Without rows
    of both classes every text scores about 0.
    """
    labelled = settle(labelled.where(F.col("label").isin(0, 1)).select(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label")))
    part = F.pmod(F.xxhash64("text"), F.lit(4))
    column = lambda df: {c: x.to_numpy() for c, x in zip(df.columns, df.toArrow().columns)}
    with tabled(bigrams(labelled.where(part != 0))) as counted:
        seen = counted.where("not is_stem")
        words = column(counted.groupBy("word").agg(F.max(F.when(F.col("is_stem"), F.col("before"))).alias("stem"), F.count_if(F.col("b0") > 0).alias("n0"), F.count_if(F.col("b1") > 0).alias("n1")))
        contexts = column(seen.groupBy("before").agg(F.sum("b0").alias("b0"), F.sum("b1").alias("b1")))
        pairs = column(seen.where("greatest(b0, b1) > 1").select("before", "word", "b0", "b1"))
    models = Models(words, contexts, pairs)
    held = labelled.where(part == 0).select(differences_of(models, labelled.sparkSession)(F.col("text")).alias("x"), F.col("label").cast("double").alias("y")).toArrow()
    models.fit_line(held.column("x").combine_chunks().flatten().to_numpy().reshape(-1, 3), held.column("y").to_numpy())
    return models


def differences_of(models: Models, spark: SparkSession):
    shared = spark.sparkContext.broadcast(models)

    @F.arrow_udf("array<double>")
    def apply(texts: pa.Array) -> pa.Array:
        x = np.concatenate([np.zeros((0, 3)), *(shared.value.differences(some) for _, some in slices(texts))])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * 3, pa.int32()), pa.array(x.ravel()))

    return apply


def score_of(models: Models, spark: SparkSession):
    shared = spark.sparkContext.broadcast(models)

    @F.arrow_udf("double")
    def apply(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(shared.value.score(some) for _, some in slices(texts))]))

    return apply


def toxicity(models: Models, text: Column, spark: SparkSession) -> Column:
    """The score of a text, from 0 to 1; null and empty texts have the score of no evidence."""
    return once(score_of(models, spark)(text))


def labelled_sample(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", bound: int = MAX_LABELLED) -> DataFrame:
    """text and label of at most ``bound`` labelled documents, those whose ids have the least hashes.

    Ids are drawn from ``labels``; rows without a document, with a null id or a null label are left
    out.  Of documents that share an id, and of labels that do, one is taken.  Only the bounded set of
    ids is broadcast.
    """
    ids = labels.select(F.col(doc_id).alias("_id"), F.col(label).alias("label")).where("_id is not null and label is not null").groupBy("_id").agg(F.min("label").alias("label"))
    drawn = ids.orderBy(F.xxhash64("_id"), "_id").limit(bound)
    found = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(drawn), "_id")
    return found.groupBy("_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select("x.text", "label")


def held_out(doc_id: str = "doc_id", parts: int = 5) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == 0


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    models = fit(labelled_sample(docs, labels.where(~held_out())))
    out = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), toxicity(models, F.col("text"), spark).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

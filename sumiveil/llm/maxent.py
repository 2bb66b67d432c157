"""A hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class, history), and every word has a class.  The
most frequent words are dealt to ``HEAD_CLASSES`` classes of ``SLOTS`` words each and are told apart
by a second softmax; all other words, whatever their number, belong to ``RARE`` classes by their shape
and are told apart by their counts (plus one, with one type for all unseen words), so the
probabilities of a history add up to 1.  Features are the word before, the word before that (skip) and
the two together, hashed into rows of weights; a word that is not among the most frequent is there
as its shape and, for the class if it is the word before and for the slot always, as itself.  Unigram log-probabilities are the bias.  The weights
are trained by gradient steps (Adagrad) in parallel over all training documents, in rounds; after each
round the trainers' changes are summed in a tree and averaged.

Counts cover all training documents.  The counts of the ``KNOWN`` most frequent words are broadcast
(a fixed bound), those of other words meet their occurrences in a join, whose crowded words Spark can
split.  Words are known by 64-bit hashes whose low four bits are the shape.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sumiveil.llm.common import read_table, release, row_sums, settle, slices, words_of

HEAD_CLASSES, RARE, SLOTS = 20, 12, 64
CLASSES = HEAD_CLASSES + RARE
HEAD = HEAD_CLASSES * SLOTS
#: What a word is as history: its place among the most frequent, or its shape, or the start of a text.
START = HEAD + RARE
CONTEXTS = START + 1
#: Rows of class weights: of both words before by place or shape, of the two together, and of a rarer word before by its hash; rows of slot weights.
PAIR_ROWS, WORD_ROWS, SLOT_ROWS = 1 << 14, 1 << 15, 1 << 15
CLASS_ROWS = -(-(2 * CONTEXTS + PAIR_ROWS + WORD_ROWS) // 128) * 128
KNOWN = 1 << 20
CACHED = 500_000
BLOCKS = 128
BATCH = 4096
ROUNDS = 2
RATE = 0.3
#: What the sum of squares of a row begins with: rows that have seen little move little.
GROUND = 1.0
TOKENS_PER_TRAINER = 8_000_000
#: Trainers whose changes one sum takes in.
FAN = 16
SLICE = 6_000_000
END = xxhash.xxh64_intdigest(b"\n") & ~15
END -= (END >> 63) << 64
LN10 = float(np.log(10.0))


def shape(word: str) -> int:
    """A class for a rare word: alphabet, length, and what it ends in."""
    last = word[-1]
    return (0 if word.isascii() else 6) + (3 if len(word) > 8 else 0) + (0 if last.isalnum() else 1 if last in ".," else 2)


class _Hashes(dict):
    """Hashes of the words that a worker has met, emptied when they are too many."""

    def __missing__(self, word: str) -> int:
        h = (xxhash.xxh64_intdigest(word) & ~15) | shape(word)
        self[word] = h = h - ((h >> 63) << 64)
        return h


_HASHES = _Hashes()


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of a batch's tokens (each text's words, then its end), row offsets, and the codes' hashes."""
    codes, offsets, words = words_of(pc.ascii_lower(texts))
    if len(_HASHES) > CACHED:
        _HASHES.clear()
    hashes = np.fromiter(map(_HASHES.__getitem__, words.to_pylist()), np.int64, len(words))
    n = len(texts)
    wide = np.full(len(codes) + n, len(words), np.int64)
    rows = np.arange(n + 1)
    wide[np.arange(len(codes)) + np.repeat(rows[:-1], np.diff(offsets))] = codes
    return wide, offsets + rows, np.append(hashes, END)


def mixed(a: np.ndarray, b: np.ndarray, m: int, n: int, rows: int) -> np.ndarray:
    """A row for a pair of 32-bit numbers."""
    x = a * np.uint32(m) + b * np.uint32(n)
    x ^= x >> np.uint32(15)
    return ((x * np.uint32(0x85EBCA6B)) >> np.uint32(32 - rows.bit_length() + 1)).astype(np.int32)


class Model:
    """Counts of the known words, biases and weights."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, types: int, rare_total: np.ndarray, rare_types: np.ndarray):
        """``rare_total`` and ``rare_types`` are those of all words, by shape."""
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.total, self.types = total, types
        rank = np.lexsort((self.hashes, -self.counts))[:HEAD]
        self.head = np.full(len(self.hashes), -1, np.int32)
        self.head[rank] = np.arange(len(rank))
        inside = np.zeros((HEAD_CLASSES, SLOTS))
        inside.ravel()[: len(rank)] = self.counts[rank]
        gone = lambda w: np.bincount(self.hashes[rank] & 15, weights=w, minlength=RARE)
        #: By shape: counts and types of the words that share the class, and one for the unseen.
        self.rare = rare_total - gone(self.counts[rank]) + rare_types - gone(np.ones(len(rank))) + 1
        mass = np.concatenate([inside.sum(axis=1), rare_total - gone(self.counts[rank]) + 1.0])
        self.class_bias = np.log(np.maximum(mass, 1e-9) / mass.sum()).astype(np.float32)
        self.slot_bias = np.where(inside > 0, np.log(np.maximum(inside, 1) / np.maximum(inside.sum(axis=1, keepdims=True), 1)), -30).astype(np.float32)
        self.classes = np.zeros((CLASS_ROWS, CLASSES), np.float32)
        self.slots = np.zeros((SLOT_ROWS, SLOTS), np.float32)

    def look_up(self, codes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: its symbol (place among the most frequent, or HEAD + shape), its hash in 32 bits, and its count (-1 where not among the known)."""
        count = np.full(len(hashes), -1, np.int64)
        symbol = HEAD + (hashes & 15)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes
            count[hit] = self.counts[at[hit]]
            head = np.where(hit, self.head[at], -1)
            symbol = np.where(head >= 0, head, symbol)
        return symbol.astype(np.int32)[codes], (hashes.view(np.uint64) >> np.uint64(20)).astype(np.uint32)[codes], count[codes]

    def history(self, symbol: np.ndarray, past: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per token the symbols of the words one and two before in its row, and their hashes (0 where a symbol says all)."""
        out = np.empty((4, len(symbol)), np.uint32)
        own = np.where((symbol >= HEAD) & (symbol < START), past, np.uint32(0))
        for k in (1, 2):
            out[k - 1, k:], out[k + 1, k:] = symbol[:-k], own[:-k]
            for j in range(k):  # the first k tokens of a row have nothing so far back
                at = offsets[:-1] + j
                at = at[at < offsets[1:]]
                out[k - 1, at], out[k + 1, at] = START, 0
        return out

    def class_rows(self, history: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray]]:
        """The features of the class: which tokens have one (most have all), and its row."""
        one, two, rarer, _ = history
        pair = (one * np.uint32(2654435761) + two * np.uint32(40503) >> np.uint32(7)) & np.uint32(PAIR_ROWS - 1)
        rows = [(slice(None), x.astype(np.int32)) for x in (one, two + np.uint32(CONTEXTS), pair + np.uint32(2 * CONTEXTS))]
        at = np.flatnonzero(rarer)
        row = (rarer[at] * np.uint32(0x9E3779B1) >> np.uint32(13)) & np.uint32(WORD_ROWS - 1)
        return [*rows, (at, row.astype(np.int32) + (2 * CONTEXTS + PAIR_ROWS))]

    def slot_rows(self, kind: np.ndarray, history: np.ndarray) -> list[np.ndarray]:
        """The features of a frequent word's slot in its class: the words before, a rarer one by its hash."""
        one, two, a, b = history
        own = kind.astype(np.uint32) * np.uint32(0x9E3779B1)
        return [((own + np.where(h > 0, h, c) * np.uint32(m) >> np.uint32(9)) & np.uint32(SLOT_ROWS - 1)).astype(np.int32) for c, h, m in ((one, a, 2246822519), (two, b, 3266489917))]

    def forward(self, symbol: np.ndarray, history: np.ndarray):
        """Classes and the class softmax with its features; the frequent words among the tokens and the softmax inside their classes with its."""
        kind = np.where(symbol < HEAD, symbol // SLOTS, HEAD_CLASSES - HEAD + symbol)
        rows = self.class_rows(history)
        logits = self.class_bias + self.classes.take(rows[0][1], axis=0)
        for at, row in rows[1:]:
            logits[at] += self.classes.take(row, axis=0)
        head = np.flatnonzero(symbol < HEAD)
        own = kind[head]
        slot_rows = self.slot_rows(own, history[:, head])
        inner = self.slot_bias.take(own, axis=0)
        for row in slot_rows:
            inner += self.slots.take(row, axis=0)
        return kind, rows, softmax(logits), head, symbol[head] % SLOTS, slot_rows, softmax(inner)

    def log_probability(self, symbol: np.ndarray, history: np.ndarray) -> np.ndarray:
        """Natural logarithm of each token's class and, for frequent words, slot probability."""
        out = np.empty(len(symbol))
        for a in range(0, len(symbol), BATCH):
            s = slice(a, a + BATCH)
            kind, _, p, head, slot, _, q = self.forward(symbol[s], history[:, s])
            gain = p[np.arange(len(p)), kind]
            gain[head] *= q[np.arange(len(q)), slot]
            out[s] = np.log(gain)
        return out

    def train(self, symbol: np.ndarray, history: np.ndarray, squares: tuple[np.ndarray, np.ndarray]) -> None:
        """One pass of gradient steps, a batch of tokens at a time; ``squares`` are those of class and slot rows."""
        for a in range(0, len(symbol), BATCH):
            s = slice(a, a + BATCH)
            kind, rows, p, head, slot, slot_rows, q = self.forward(symbol[s], history[:, s])
            p[np.arange(len(p)), kind] -= 1
            q[np.arange(len(q)), slot] -= 1
            for r, g, w, sq in (*((r, p[at], self.classes, squares[0]) for at, r in rows), *((r, q, self.slots, squares[1]) for r in slot_rows)):
                if not len(r):
                    continue
                order = np.argsort(r)
                ranked = r[order]
                first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
                at = ranked[first]
                step = np.add.reduceat(g.take(order, axis=0), first, axis=0)
                sq[at] += np.einsum("ij,ij->i", step, step) / step.shape[1]
                w[at] -= (RATE / np.sqrt(sq[at] + GROUND))[:, None] * step


def softmax(x: np.ndarray) -> np.ndarray:
    """In place; logits beyond 60 either way count as 60, so nothing overflows or vanishes."""
    np.clip(x, -60, 60, out=x)
    np.exp(x, out=x)
    x /= (x @ np.ones(x.shape[1], x.dtype))[:, None]
    np.maximum(x, 1e-12, out=x)
    return x


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """hash and n of every distinct token, summed per task before they are shuffled."""

    def count(batches):
        for batch in batches:
            for _, some in slices(batch.column(0), 4 * SLICE):
                codes, _, hashes = tokens(some)
                n = np.bincount(codes, minlength=len(hashes))
                yield pa.RecordBatch.from_arrays([pa.array(hashes[n > 0]), pa.array(n[n > 0])], names=["hash", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def _known(vocabulary: DataFrame) -> tuple[pa.Table, Column]:
    """The words whose counts are broadcast, at most about ``KNOWN``, and what holds for all others.

    They are the words above a count; of the words of that count, those whose hash falls in the share
    that there is room for.
    """
    level, room = 0, KNOWN
    for r in vocabulary.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        if r["count"] > room:
            level = r["n"]
            break
        room -= r["count"]
    share = int(0.95 * room / r["count"] * (1 << 20)) if level else 0
    known = (F.col("n") > level) | ((F.col("n") == level) & (F.pmod(F.xxhash64("hash"), F.lit(1 << 20)) < share))
    return vocabulary.where(known).toArrow(), ~known


def train(docs: DataFrame, *, text: str = "text") -> tuple[Model, DataFrame]:
    """The model, and the settled table of the training tokens whose counts it doesn't hold.

    Null and empty texts are an end token alone; repeated rows are learnt as often as they occur.
    Without any row all words are unseen.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(text).alias("text"))
    vocabulary = settle(count_words(docs))
    rare_total, rare_types = np.zeros(RARE), np.zeros(RARE)
    for r in vocabulary.groupBy(F.expr("hash & 15").alias("shape")).agg(F.sum("n").alias("n"), F.count("n").alias("types")).collect():  # a row for each shape
        rare_total[r["shape"]], rare_types[r["shape"]] = r["n"], r["types"]
    known, others = _known(vocabulary)
    model = Model(known.column("hash").to_numpy(), known.column("n").to_numpy(), int(rare_total.sum()), int(rare_types.sum()), rare_total, rare_types)
    trainers = max(6, -(-model.total // TOKENS_PER_TRAINER))
    part = F.pmod(F.xxhash64("text"), F.lit(ROUNDS))
    for k in range(ROUNDS):
        now = spark.sparkContext.broadcast(model)
        learn, add_up = _trainer(now)
        first = True
        sums, groups = docs.where(part == k).coalesce(trainers).mapInArrow(learn, SUMS), trainers
        while groups > 1:  # a sum takes in FAN others, so none grows with the trainers
            groups = -(-groups // FAN)
            sums = sums.withColumn("giver", F.floor(F.col("giver") / FAN).cast("int")).repartition(min(groups * BLOCKS, trainers * 4), "giver", "block").mapInArrow(functools.partial(add_up, first), SUMS)
            first = False
        # one row a block: as large as the weights, whatever the corpus
        for r in sums.toArrow().to_pylist():
            change, weight = np.frombuffer(r["change"], np.float32), np.frombuffer(r["weight"], np.float32)
            for w, c, n in zip((model.classes, model.slots), _split(change), _split_rows(weight)):
                rows = _rows(len(w), r["block"])
                w[rows] += c / np.maximum(n, 1e-9)[:, None]
        now.unpersist()
    return model, vocabulary.where(others)


SUMS = "giver int, block int, change binary, weight binary"
_PER_BLOCK = (CLASS_ROWS // BLOCKS, SLOT_ROWS // BLOCKS)


def _rows(n: int, block: int) -> slice:
    return slice(block * n // BLOCKS, (block + 1) * n // BLOCKS)


def _split(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block's class rows and slot rows from the flat form that travels."""
    n = _PER_BLOCK[0] * CLASSES
    return flat[:n].reshape(-1, CLASSES), flat[n:].reshape(-1, SLOTS)


def _split_rows(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return flat[: _PER_BLOCK[0]], flat[_PER_BLOCK[0] :]


def _trainer(now):
    def sent(giver: int, block: int, change: list[np.ndarray], weight: list[np.ndarray], kind: type) -> pa.RecordBatch:
        flat = np.concatenate([c.ravel() for c in change]).astype(kind).tobytes()
        columns = [pa.array([giver], pa.int32()), pa.array([block], pa.int32()), pa.array([flat], pa.binary()), pa.array([np.concatenate(weight).astype(np.float32).tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["giver", "block", "change", "weight"])

    def learn(batches):
        """A trainer's change of the weights in half precision, and how much was learnt of each row, in blocks."""
        model: Model = now.value
        first = model.classes, model.slots
        model.classes, model.slots = first[0].copy(), first[1].copy()
        squares = np.zeros(CLASS_ROWS, np.float32), np.zeros(SLOT_ROWS, np.float32)
        try:
            for batch in batches:
                for _, some in slices(batch.column(0), SLICE):
                    codes, offsets, hashes = tokens(some)
                    symbol, past, _ = model.look_up(codes, hashes)
                    model.train(symbol, model.history(symbol, past, offsets), squares)
                release()
            change = model.classes - first[0], model.slots - first[1]
        finally:
            model.classes, model.slots = first  # the worker may take another task
        giver = TaskContext.get().partitionId()
        weight = [np.sqrt(x) for x in squares]
        for k in range(BLOCKS):
            w = [x[_rows(len(x), k)] for x in weight]
            if any(x.any() for x in w):
                yield sent(giver, k, [c[_rows(len(c), k)] for c in change], w, np.float16)

    def add_up(first: bool, batches):
        """Sums by giver and block of what was learnt and of changes times that; ``first``: of trainers, else of sums."""
        sums: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            for giver, block, change, weight in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(change, np.float16 if first else np.float32).astype(np.float32), np.frombuffer(weight, np.float32)
                if first:
                    for c, n in zip(_split(own[0]), _split_rows(own[1])):
                        c *= n[:, None]
                if (giver, block) in sums:
                    for x, y in zip(sums[giver, block], own):
                        x += y
                else:
                    sums[giver, block] = [x.copy() for x in own]
        for (giver, block), (change, weight) in sums.items():
            yield sent(giver, block, [change], [weight], np.float32)

    return learn, add_up


HEADED = "n_tokens long, n_known long, base double, score double, hashes array<long>, times array<int>"


def score(docs: DataFrame, model: Model, vocabulary: DataFrame, *, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """The columns ``keep``, then n_tokens, n_known, train_tokens, base_score and score of every row.

    Null and empty texts are an end token alone; repeated rows are scored each; an empty table gives
    no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(f"struct<{HEADED.replace(' ', ':').replace(',:', ',')}>")
    def head(texts: pa.Array) -> pa.Array:
        m: Model = shared.value
        floor = m.total + m.types + 1
        parts, hashes, times, ends = [], [], [], [0]
        for _, some in slices(texts, SLICE):
            codes, offsets, own = tokens(some)
            symbol, past, count = m.look_up(codes, own)
            gain = m.log_probability(symbol, m.history(symbol, past, offsets)) / LN10
            seen = count >= 0
            base = np.where(seen, np.log10((np.maximum(count, 0) + 1) / floor), 0.0)
            rare = symbol >= HEAD
            gain += np.where(rare & seen, np.log10((np.maximum(count, 0) + 1) / m.rare[np.where(rare, symbol - HEAD, 0)]), 0.0)
            parts.append((np.diff(offsets), row_sums(seen, offsets), row_sums(base, offsets), row_sums(gain, offsets)))
            at = np.flatnonzero(~seen)
            row = np.searchsorted(offsets, at, "right") - 1
            pair, n = np.unique(row * len(own) + codes[at], return_counts=True)
            row, code = np.divmod(pair, len(own))
            hashes.append(own[code])
            times.append(n)
            ends.extend((np.searchsorted(row, np.arange(len(some)), "right") + ends[-1]).tolist())
        columns = [np.concatenate(x) if parts else np.zeros(0) for x in (zip(*parts) if parts else [()] * 4)]
        ends = pa.array(ends, pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else np.zeros(0), kind)) for x, kind in ((hashes, pa.int64()), (times, pa.int32()))]
        release()
        return pa.StructArray.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))] + lists, [x.split()[0] for x in HEADED.split(", ")])

    scored = settle(docs.select(F.struct(*[c.alias(k) for k, c in keep.items()]).alias("kept"), head(F.col(text)).alias("h"))).withColumn("row", F.monotonically_increasing_id())
    floor = float(model.total + model.types + 1)
    inside = F.element_at(F.lit(model.rare.tolist()), (F.col("hash").bitwiseAND(F.lit(15)) + 1).cast("int"))
    tail = scored.select("row", F.explode(F.arrays_zip(F.col("h.hashes").alias("hash"), F.col("h.times").alias("times"))).alias("x")).select("row", "x.hash", "x.times")
    met = tail.join(vocabulary, "hash", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"), F.sum(F.col("times") * F.log10((F.col("n") + 1) / F.lit(floor))).alias("base"), F.sum(F.col("times") * F.log10((F.col("n") + 1) / inside)).alias("gain"))
    whole = scored.select("row", "kept", "h.n_tokens", F.col("h.n_known").alias("k"), F.col("h.base").alias("b"), F.col("h.score").alias("s")).join(sums, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return whole.select("kept.*", "n_tokens", (F.col("k") + zero("known")).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (F.col("b") + zero("base")).alias("base_score"), (F.col("s") + zero("gain")).alias("score"))


def op3_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    model, vocabulary = train(docs.where(~held_out))
    return score(docs, model, vocabulary, keep={"doc_id": F.col("doc_id"), "held_out": held_out})

"""Pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates are found by MinHash: of ``BANDS`` keys of ``DEPTH`` minima each, texts at the bound share
one with probability 1 - (1 - 0.8 ** 5) ** 24 = 0.9999, likelier ones more often.  Every text that
shares a key is first compared with one other, the centre of one of its keys: the one that shares
most keys with others.  A candidate is checked on its whole set.

What no chain of links has brought together after that, though it shares a key, is compared by an
exact prefix filter: shingles are put in one order, rare ones first, and of two sets at the bound the
lesser has one of its first n // 9 + 1 shingles among the first n // 5 + 1 of the greater (the lesser
lacks a ninth of its own at most, the greater a fifth), at places that leave room for what they must
share.  Texts of one group with edits of their own begin with shingles that no other has, and so
don't meet, where their keys would pair all of them.  Any one order loses no pair; how rare a shingle
is, is read off ``SLOTS`` counters, which is all that is broadcast.

Shingles are told apart by 32 bits: with d shingles in which two texts differ, the chance that one
of them is taken for shared, which matters only right at the bound, is d * d / 2**34.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumiveil.llm.common import doc_key, gather_runs, join_by_count, settle, slices, words_of
from sumiveil.llm.components import connected_components

WORDS = 5
#: At least 4 of 5 shingles of both are shared.
SHARED, OF = 4, 5
BANDS, DEPTH = 24, 5
SLOTS = 1 << 20
_RNG = np.random.default_rng(42)
_PLACES = _RNG.integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _RNG.integers(0, 1 << 63, (BANDS, DEPTH), np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles in order, and row offsets; shorter texts are one shingle, blank ones none."""
    codes, offsets, words = words_of(pc.ascii_lower(texts))
    size = np.diff(offsets)
    count = np.where(size >= WORDS, size - WORDS + 1, size > 0)
    start = gather_runs(offsets[:-1], count)
    row = np.repeat(np.arange(len(size)), count)
    own = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))
    word = np.append(own[codes], np.zeros(WORDS, np.uint64))
    h = np.zeros(len(start), np.uint64)
    for k in range(WORDS):
        h += np.where(start + k < offsets[1:][row], word[start + k], np.uint64(0)) * _PLACES[k]
    h = _mixed(h)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(size) + 1))


def marks(text: Column) -> Column:
    """set (a digest of the shingles), n (how many) and bands (keys; none for blank texts) of a text."""

    @F.arrow_udf("struct<set:long,n:int,bands:array<long>>")
    def mark(texts: pa.Array) -> pa.Array:
        sets, counts, keys = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros((0, BANDS), np.uint64)]
        for _, some in slices(texts):
            h, offsets = shingle_sets(some)
            n = np.diff(offsets)
            full = np.flatnonzero(n)
            digest, bands = np.zeros(len(n), np.uint64), np.zeros((len(n), BANDS), np.uint64)
            if len(full):
                digest[full] = _mixed(np.add.reduceat(_mixed(h + np.uint64(1)), offsets[full]) + n[full].astype(np.uint64))
                for b in range(BANDS):
                    key = np.full(len(full), b + 1, np.uint64)
                    for f in _FACTORS[b]:
                        key = _mixed(key * _PLACES[0] + _mixed(np.minimum.reduceat(h * f, offsets[full])))
                    bands[full, b] = key
            sets.append(digest)
            counts.append(n)
            keys.append(bands)
        n, keys = np.concatenate(counts), np.concatenate(keys)
        ends = pa.array(np.append(0, np.cumsum(np.where(n > 0, BANDS, 0))), pa.int32())
        lists = pa.ListArray.from_arrays(ends, pa.array(keys[n > 0].ravel().view(np.int64)))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(n, pa.int32()), lists], ["set", "n", "bands"])

    return mark(text)


def whole_set(text: Column) -> Column:
    """32 bits of the hash of each of a text's distinct shingles."""

    @F.arrow_udf("array<int>")
    def whole(texts: pa.Array) -> pa.Array:
        out = []
        for _, some in slices(texts):
            h, offsets = shingle_sets(some)
            out.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array((h >> np.uint64(32)).astype(np.uint32).view(np.int32))))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))

    return whole(text)


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose whole sets are alike."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("s")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("t")), "b")
    shared = F.size(F.array_intersect("s", "t"))
    return both.where(shared * (OF + SHARED) >= (F.size("s") + F.size("t")) * SHARED).select("a", "b")


def like_links(marked: DataFrame, texts: DataFrame, others: DataFrame) -> DataFrame:
    """a, b (fingerprints): links that, with those of ``others``, bring together all texts alike.

    ``marked`` has key, fp and like (``marks``) of the documents, ``texts`` their key and text.
    """
    some = marked.where("like.n > 0").select("key", "fp", F.col("like.set").alias("node"), F.col("like.n").alias("n"), F.col("like.bands").alias("bands"))
    node = settle(some.groupBy("node").agg(F.min(F.struct("fp", "key")).alias("x"), F.first("n").alias("n"), F.first("bands").alias("bands")).select("node", "x.fp", "x.key", "n", "bands"))
    fps = node.select("node", "fp")
    same = some.select("node", F.col("fp").alias("a")).distinct().join(fps.withColumnRenamed("fp", "b"), "node").where("a <> b").select("a", "b")
    member = node.select("node", "fp", "n", F.explode("bands").alias("band"))
    sizes = settle(member.groupBy("band").agg(F.count("*").alias("c")).where("c > 1"))
    met = settle(join_by_count(member, sizes.withColumn("of", F.col("c")), "band", "of"))
    ranked = settle(met.join(met.groupBy("node").agg(F.sum("c").alias("d")), "node").drop("c"))
    centre = settle(ranked.groupBy("band").agg(F.max(F.struct("d", "node", "n")).alias("x"), F.count("*").alias("c")))
    nearest = join_by_count(ranked, centre, "band", "c").where("node <> x.node").groupBy("node").agg(F.max("x").alias("x"), F.first("n").alias("n"))
    stars = nearest.where(F.least("n", "x.n") * OF >= F.greatest("n", "x.n") * SHARED).select(*_ordered("node", "x.node")).distinct()
    wanted = node.join(met.select("node").distinct(), "node", "left_semi").select("node", "key", "n")
    sets = settle(texts.join(wanted, "key").dropDuplicates(["node"]).select("node", "n", whole_set(F.col("text")).alias("s")))

    def linked(pairs: DataFrame) -> DataFrame:
        named = verified(pairs, sets).join(fps.select(F.col("node").alias("a"), F.col("fp").alias("f")), "a").join(fps.select(F.col("node").alias("b"), F.col("fp").alias("g")), "b")
        return named.select(F.col("f").alias("a"), F.col("g").alias("b")).where("a <> b").distinct()

    first = settle(others.union(same).union(linked(stars)))
    found = connected_components(first).select(F.col("node").alias("fp"), "root")
    rooted = settle(met.join(found, "fp", "left").select("band", "node", F.coalesce("root", "fp").alias("root")))
    split = settle(rooted.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("c")).where("x <> y").select("band", "c"))
    rest = join_by_count(rooted, split, "band", "c").groupBy("node").agg(F.first("root").alias("root"))
    return first.union(linked(settle(prefix_pairs(settle(rest.join(sets, "node"))))))


def prefix_pairs(rest: DataFrame) -> DataFrame:
    """a, b: the pairs of different roots that the prefix filter leaves, of nodes with root, n and s (settled)."""

    def slot(h: np.ndarray) -> np.ndarray:
        return h.view(np.uint32) % np.uint32(SLOTS)

    def count(batches):
        slots = np.zeros(SLOTS, np.int64)
        for batch in batches:
            slots += np.bincount(slot(batch.column(0).flatten().to_numpy()), minlength=SLOTS)
        at = np.flatnonzero(slots)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(slots[at])], names=["slot", "n"])

    counted = rest.select("s").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slots = np.zeros(SLOTS, np.int64)
    slots[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    shared = rest.sparkSession.sparkContext.broadcast(slots)

    @F.arrow_udf("array<int>")
    def rare(sets: pa.Array) -> pa.Array:
        h = sets.flatten().to_numpy()
        size = pc.list_value_length(sets).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((h, shared.value[slot(h)], np.repeat(np.arange(len(size)), size)))
        head = size // 5 + (size > 0)
        first = h[order][gather_runs(np.cumsum(size) - size, head)]
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(head)), pa.int32()), pa.array(first))

    entry = rest.select("node", "root", "n", F.posexplode(rare(F.col("s"))).alias("at", "shingle"))
    # a shingle of one root leads to no pair, nor does a place from which even the shortest set that has it can't be reached
    some = entry.groupBy("shingle").agg(F.min("root").alias("p"), F.max("root").alias("q"), F.min("n").alias("least")).where("p <> q").select("shingle", "least")
    entry = settle(entry.join(some, "shingle").where(f"(n - at) * {OF + SHARED} >= (n + least) * {SHARED}").drop("least"))
    x = entry.where("at <= n div 9").select("shingle", *[F.col(c).alias(f"{c}_x") for c in ("node", "root", "n", "at")])
    y = entry.select("shingle", *[F.col(c).alias(f"{c}_y") for c in ("node", "root", "n", "at")])
    ordered = "(n_x < n_y or (n_x = n_y and node_x < node_y)) and root_x <> root_y"
    room = f"least(n_x - at_x, n_y - at_y) * {OF + SHARED} >= (n_x + n_y) * {SHARED}"
    pairs = x.join(y, (x.shingle == y.shingle) & F.expr(ordered) & F.expr(room))
    return pairs.select(*_ordered("node_x", "node_y")).distinct()


def with_text(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(doc_key(doc_id, text).alias("key"), F.col(text).alias("text"))

"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the ascending array of the ``k`` least distinct 48-bit hashes of a text's five-word
shingles.  Sketches of parts merge into the sketch of the whole, and estimate resemblance,
containment and the number of distinct shingles; of a text with at most ``k`` distinct shingles
they are exact.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumiveil.llm.common import read_table, slices, words_of

K = 256
SHINGLE = 5
BITS = 48
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def sketch_texts(texts: pa.Array, k: int = K, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sketch of each text; words are lower-cased, and fewer than ``shingle`` words are one shingle."""
    codes, offsets, words = words_of(texts)
    word = np.fromiter((xxhash.xxh64_intdigest(w.lower()) for w in words.to_pylist()), np.uint64, len(words))[codes]
    n = len(word)
    rolled = word.copy()
    for i in range(1, min(shingle, n)):
        rolled[: n - i] = rolled[: n - i] * _STEP + word[i:]
    hashes = _mixed(rolled) >> np.uint64(64 - BITS)
    out = []
    for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
        if b - a >= shingle:
            own = np.sort(hashes[a : b - shingle + 1])
            keep = np.ones(len(own), bool)
            keep[1:] = own[1:] != own[:-1]
            out.append(own[keep][:k])
        elif b > a:
            whole = word[a : a + 1]
            for i in range(a + 1, b):
                whole = whole * _STEP + word[i : i + 1]
            out.append(_mixed(whole + np.uint64(b - a)) >> np.uint64(64 - BITS))
        else:
            out.append(hashes[:0])
    return out


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two parts taken together."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of common distinct shingles; two texts without shingles are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort()
    twice = both[1:] == both[:-1]
    first = np.ones(len(both), bool)
    first[1:] = ~twice
    number = np.cumsum(first)  # how many distinct hashes are at most this one
    least = min(int(number[-1]), k)
    return float(np.count_nonzero(twice & (number[1:] <= least)) / least)


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2**BITS)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1 for a text without shingles."""
    if not len(a):
        return 1.0
    union = distinct_count(merged(a, b, k), k)
    return min(1.0, resemblance(a, b, k) * union / distinct_count(a, k))


def shown(a: np.ndarray) -> str:
    """A sketch as text: base64 of its big-endian 48-bit numbers."""
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def read_sketch(s: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(s), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    return wide.view(">u8").ravel().astype(np.uint64)


def sketches(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint and the estimated number of distinct shingles of every row.

    Null and empty texts have the empty fingerprint; equal texts have equal ones; an empty table
    gives no rows; other columns are not looked at.
    """

    @F.arrow_udf("struct<f:string,n:double>")
    def sketch(texts: pa.Array) -> pa.Array:
        own = [s for _, some in slices(texts) for s in sketch_texts(some, k, shingle)]
        return pa.StructArray.from_arrays([pa.array([shown(s) for s in own], pa.string()), pa.array([distinct_count(s, k) for s in own], pa.float64())], ["f", "n"])

    return docs.select(F.col(doc_id).alias("doc_id"), sketch(F.col(text)).alias("x")).select("doc_id", F.col("x.f").alias("fingerprint"), F.col("x.n").alias("n_shingles"))


def with_next(docs: DataFrame, each, schema: str, *, doc_id: str = "doc_id", text: str = "text", rows_per_part: int = 5_000, max_parts: int = 20_000) -> DataFrame:
    """Apply ``each`` to every document together with the next one in ascending (doc_id, text).

    ``each(ids, texts)`` gets runs of documents, the last only as successor of the one before, and
    yields record batches.  After the last document comes the first; null ids come first of all.
    Documents are dealt into ranges of doc_id once, each range with a copy of the first document of
    the range after it; only the ranges' bounds, ``max_parts`` at most, reach the driver.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = docs.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.count("doc_id").alias("known")).first()
    parts = max(1, min(max_parts, -(-ids["n"] // rows_per_part)))
    bounds = np.zeros(0, np.int64)
    if parts > 1 and ids["known"]:
        cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts + 1000).alias("c")).first()["c"]
        bounds = np.unique(np.array(cuts, np.int64))
        bounds = bounds[bounds > ids["least"]]
    parts = len(bounds) + 1
    nulls = ids["known"] < ids["n"]
    first = None if nulls else ids["least"]

    @F.arrow_udf("array<int>")
    def places(column: pa.Array) -> pa.Array:
        """The part of a document, and the part in which it is the successor of the last one."""
        out = []
        for i in column.to_pylist():
            part = 0 if i is None else int(np.searchsorted(bounds, i, "right"))
            opens = part and bounds[part - 1] == i
            out.append([part, *([part - 1] if opens else []), *([-parts] if i == first else [])])
        return pa.array(out, pa.list_(pa.int32()))

    dealt = docs.select("doc_id", "text", F.posexplode(places(F.col("doc_id"))).alias("copy", "part")).select("doc_id", "text", (F.col("copy") > 0).alias("guard"), F.when(F.col("part") < 0, parts - 1).otherwise(F.col("part")).alias("part"))
    placed = dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("guard", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches):
        held: list[tuple] = []
        size, closed = 0, False
        for batch in batches:
            for i, t, guard in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2))):
                if closed:
                    continue
                held.append((i, t))
                size += len(t)
                closed = guard
                if len(held) > 1 and (size > 1_000_000 or guard):
                    yield from each([x[0] for x in held], [x[1] for x in held])
                    held, size = held[-1:], len(t)

    return placed.select("doc_id", "text", "guard").mapInArrow(run, schema)


FINGERPRINTED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, in_edited double"


def edited_fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the
    next document, in ascending (doc_id, text).  Null texts are empty; rows that repeat follow each
    other; a lone document is its own successor; an empty table gives no rows.
    """

    def each(ids, texts):
        edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, texts[1:])]
        own = sketch_texts(pa.array(texts, pa.large_string()), k, shingle)
        other = sketch_texts(pa.array(edited, pa.large_string()), k, shingle)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids[:-1], pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array([shown(s) for s in own[:-1]], pa.string()),
                pa.array([shown(s) for s in other], pa.string()),
                pa.array([resemblance(a, b, k) for a, b in zip(own, other)], pa.float64()),
                pa.array([resemblance(a, b, k) for a, b in zip(own, own[1:])], pa.float64()),
                pa.array([distinct_count(a, k) for a in own[:-1]], pa.float64()),
                pa.array([containment(a, b, k) for a, b in zip(own, other)], pa.float64()),
            ],
            names=[x.split()[0] for x in FINGERPRINTED.split(", ")],
        )

    return with_next(docs, each, FINGERPRINTED, doc_id=doc_id, text=text)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read_table(spark, sf_dir, "documents"))

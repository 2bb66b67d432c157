"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into two segments, each with a table of its values.  Two fingerprints at
most two bits apart differ by one bit at most in the first segment, or not at all in the second.  So
the first table is probed with the Hamming ball of radius one round a fingerprint's segment, the
second with the segment itself; matches are candidates, and their complete distances are verified.

A value that more than ``CROWD`` fingerprints share is split by the other segment: its fingerprints
are probed by both segments together, each with one bit flipped in either, and the at most 65
fingerprints that meet at a point are linked with the least of them.  Two fingerprints at most two
bits apart meet half-way, so no link is lost, and no value's members are ever paired with each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sumiveil.llm.common import doc_key, fresh, gather_runs, join_by_count, read_table, settle, slices
from sumiveil.llm.components import connected_components
from sumiveil.llm.likeness import like_links, marks, with_text

#: Of each segment: first bit, end bit, and the radius of the ball that is probed.
SEGMENTS = ((0, 32, 1), (32, 64, 0))
DISTANCE = 2
CROWD = 64
#: Up to so many crowded values are broadcast; more of them are joined.
FEW = 10_000


def fingerprints(texts: list[str], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """SimHash of each text: a bit is 1 if set in over half of its shingles' hashes, repeats included."""
    digest = xxhash.xxh64_intdigest
    hashes, counts = [], []
    for t in texts:
        words = t.encode().lower().split()
        n = len(words) - shingle + 1
        if n > 0:
            hashes.extend([digest(b" ".join(s), seed) for s in zip(*(words[i:] for i in range(shingle)))])
        elif words:
            hashes.append(digest(b" ".join(words), seed))
        counts.append(max(n, bool(words)))
    count = np.array(counts, np.int64)
    start = np.cumsum(count) - count
    out = np.zeros(len(texts), np.uint64)
    if not hashes:
        return out
    bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    # eight byte-wide counters are added at once, at most 255 rows at a time
    full = np.flatnonzero(count)
    parts = -(-count[full] // 255)
    sub = np.repeat(start[full], parts) + 255 * gather_runs(np.zeros_like(parts), parts)
    lanes = np.add.reduceat(bits.view(np.uint64), sub, axis=0).view(np.uint8)
    ones = np.add.reduceat(lanes.astype(np.int32), np.cumsum(parts) - parts, axis=0)
    out[full] = np.packbits(2 * ones > count[full, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprint(text: Column | str, shingle: int = 3, seed: int = 42) -> Column:
    """The fingerprint of a text as a long; 0 for null, empty and blank texts."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        out = [fingerprints(some.to_pylist(), shingle, seed).view(np.int64) for _, some in slices(texts)]
        return pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))

    return simhash(text)


def _bit(i: int) -> Column:
    return F.lit(np.uint64(1 << i).astype(np.int64).item())


def segment_table(distinct: DataFrame) -> DataFrame:
    """fp, segment and value: an entry of each segment's table for every fingerprint."""
    entries = [F.struct(F.lit(k).alias("segment"), F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << high - low) - 1)).alias("value")) for k, (low, high, _) in enumerate(SEGMENTS)]
    return distinct.select("fp", F.explode(F.array(*entries)).alias("x")).select("fp", "x.segment", "x.value")


def segment_probes(distinct: DataFrame) -> DataFrame:
    """fp, segment and value: the values of each segment's ball round every fingerprint."""
    own = segment_table(distinct)
    flips = [F.when(F.col("segment") == k, F.array(*[_bit(i - low) for i in range(low, high)])) for k, (low, high, radius) in enumerate(SEGMENTS) if radius]
    return own.select("fp", "segment", F.explode(F.concat(F.array(F.lit(0).cast("long")), F.coalesce(*flips, F.array().cast("array<long>")))).alias("flip"), "value").select("fp", "segment", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))


def point_links(distinct: DataFrame) -> DataFrame:
    """a, b: of the fingerprints that meet at a point (within one bit of each), the least and each other."""
    flips = [F.col("fp").bitwiseXOR(_bit(i)) for low, high, _ in SEGMENTS for i in range(low, high)]
    keys = distinct.select(F.col("fp").alias("a"), F.explode(F.array(F.col("fp"), *flips)).alias("point"))
    stars = keys.withColumn("b", F.min("a").over(Window.partitionBy("point"))).where("a <> b")
    return stars.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE).select("a", "b")


def near_links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """a, b: links among the fingerprints ``fp``, which reach all that are at most two bits apart.

    ``distinct`` has each fingerprint once and must be settled.
    """
    table, probes = segment_table(distinct), segment_probes(distinct)
    at = ["segment", "value"]
    crowded = settle(table.groupBy(at).count().where(F.col("count") > crowd).select(at))
    n = crowded.count()
    if n:
        crowded = F.broadcast(crowded) if n <= FEW else crowded
        members = probes.join(crowded, at, "left_semi").select("fp").distinct()
        table, probes = (x.join(crowded, at, "left_anti") for x in (table, probes))
    a, b = probes.withColumnRenamed("fp", "a"), table.withColumnRenamed("fp", "b")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    links = a.join(b, (a.segment == b.segment) & (a.value == b.value) & close).select("a", "b")
    return links.union(point_links(members)) if n else links


def classes(docs: DataFrame, *, doc_id: str, text: str, shingle: int, alike: bool) -> tuple[DataFrame, DataFrame]:
    """The settled rows (doc_id, key, fp), and of each fingerprint n (its rows), first, stays, root and component_id."""
    extra = [marks(F.col(text)).alias("like")] if alike else []
    marked = settle(docs.select(F.col(doc_id).alias("doc_id"), doc_key(doc_id, text).alias("key"), fingerprint(F.col(text), shingle).alias("fp"), *extra))
    stays = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("key").alias("k"))
    node = settle(marked.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.min(stays).alias("stays")))
    links = near_links(node.select("fp"))
    found = connected_components(like_links(marked, with_text(docs, doc_id, text), links) if alike else links)
    member = found.join(node, found.node == node.fp)
    named = member.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = found.join(named, "root").select(F.col("node").alias("fp"), "root", "component_id", F.lit(True).alias("linked"))
    component = node.join(linked, "fp", "left").select("fp", "n", "stays", F.coalesce("root", "fp").alias("root"), F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first")).alias("component_id"))
    return marked.select("doc_id", "key", "fp"), settle(component)


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, alike: bool = False) -> DataFrame:
    """doc_id, key, fp, root (longs) and component_id of every row: fingerprints at most two bits apart are linked.

    component_id is the least doc_id reachable, the row's own included; root names the component
    itself, key the document (rows that repeat doc_id and text share it).  Null, empty and blank
    texts have fingerprint 0 and are linked like any other; rows that repeat stay apart as rows, in
    one component.  A null doc_id is kept and is least only where a component has no other.  An
    empty table gives no rows; other columns are not looked at.  Copies share a fingerprint and are
    collapsed before any linking; one that very many rows share leaves the shuffle that brings rows
    and components together.  With ``alike``, texts whose five-word shingles have a Jaccard
    similarity of 0.8 or more are linked as well, however far apart their fingerprints are.
    """
    marked, component = classes(docs, doc_id=doc_id, text=text, shingle=shingle, alike=alike)
    return join_by_count(marked, component.drop("stays"), "fp", "n").select("doc_id", "key", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", alike: bool = False) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document of least doc_id (null ids last), once.

    Which stay is settled among fingerprints; texts are moved once, to meet the keys of those.  Null,
    empty and repeated rows, ties and empty tables are as in :func:`near_duplicates`; of rows that
    repeat doc_id and text one stays.  All columns of ``docs`` are kept, whatever their names.
    """
    _, component = classes(docs, doc_id=doc_id, text=text, shingle=3, alike=alike)
    key = fresh(docs) + "key"
    stays = component.groupBy("root").agg(F.min("stays").alias("x")).select(F.col("x.k").alias(key))
    return docs.withColumn(key, doc_key(doc_id, text)).join(stays, key, "left_semi").dropDuplicates([key]).drop(key)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

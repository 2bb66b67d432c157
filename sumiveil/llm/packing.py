"""Best-fit packing of documents into fixed-size sequences, after Martello-Toth dominance reduction.

Only lengths matter to a packing, so the instance is the histogram of piece lengths: at most
``capacity`` numbers, whatever the corpus.  The plan is made from it on the driver in run-length
form and applied to the pieces on the executors by (length, rank within the length).
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sumiveil.llm.common import gather_runs, read_table, release, row_sums, settle, slices
from sumiveil.llm.word_bpe import default_path, loaded

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass
class Plan:
    """Runs of placements: items ``rank .. rank + n`` of a length go ``per`` to a sequence from ``sequence`` on, at ``offset``."""

    capacity: int
    left: dict[int, int]
    rank: dict[int, int] = field(default_factory=dict)
    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    fixed: int = 0

    def take(self, size: int, n: int, sequence: int, per: int, offset: int) -> None:
        at = self.rank.get(size, 0)
        self.runs.append((size, at, n, sequence, per, offset))
        self.rank[size] = at + n
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]

    def fix(self, sizes: list[int], n: int) -> None:
        """``n`` whole sequences of these sizes, for good."""
        offset = 0
        for s in sizes:
            self.take(s, n, self.sequences, 1, offset)
            offset += s
        self.sequences += n
        self.fixed += n


def best_pair(fits: list[int], room: int, has: Callable[..., bool]) -> tuple[int, int] | None:
    """The two pieces (lesser, greater) that together fill most of ``room``."""
    top, pair, hi = 0, None, len(fits) - 1
    for lo in range(len(fits)):
        while hi >= 0 and fits[lo] + fits[hi] > room:
            hi -= 1
        k = hi
        while k >= lo and not (has(fits[lo]) and has(fits[k], fits[k] == fits[lo])):
            k -= 1
        if k >= lo and fits[lo] + fits[k] > top:
            top, pair = fits[lo] + fits[k], (fits[lo], fits[k])
    return pair


def pair_dominates(pair: tuple[int, int], fits: list[int], room: int, has: Callable[..., bool]) -> bool:
    """Whether every piece and every pair that fits can change places with ``pair``, piece by piece.

    A pair (p, q), p >= q, is bettered by (greater, lesser) if p <= greater and q <= lesser, or if both
    together are no longer than the greater piece.
    """
    lesser, greater = pair
    if fits[-1] > greater:
        return False
    for q in fits[bisect.bisect_right(fits, lesser) :]:
        at = bisect.bisect_right(fits, room - q) - 1
        while at >= 0 and fits[at] >= q and not has(fits[at], fits[at] == q):
            at -= 1
        if at >= 0 and fits[at] >= q and fits[at] + q > greater:
            return False
    return True


def dominating_sets(plan: Plan) -> None:
    """Martello-Toth reduction: fix each set of at most three pieces that provably dominates every other use of its largest piece.

    For each piece, longest first: alone if nothing fits beside it; with a piece that fills it
    exactly; with the longest that fits, if no two fit together or no fitting pair is longer; with
    the longest fitting pair, if no four pieces can share the sequence and the pair betters each
    other piece and pair, piece by piece (``pair_dominates``).  A set that dominates can take the
    place of whatever a best packing has beside the piece, so the remaining pieces need as many
    sequences as before less the fixed ones.  Pieces with none of these stay.
    """
    for big in reversed(sorted(plan.left)):
        while n := plan.left.get(big, 0):
            room = plan.capacity - big
            own = sorted(plan.left)
            has = lambda s, used=0: plan.left.get(s, 0) - (s == big) - used > 0
            fits = [s for s in own[: bisect.bisect_right(own, room)] if has(s)]
            if not fits:
                plan.fix([big], n)
                continue
            best = fits[-1]
            least = [s for s in fits[:3] for k in range(3) if has(s, k)][:3]
            pair = best_pair(fits, room, has)
            if best == room or pair is None or best >= sum(pair):
                if best < room and sum(least) <= room and len(least) == 3:
                    break
                plan.fix([big, best], n // 2 if best == big else min(n, plan.left[best]))
            elif not (len(least) == 3 and sum(least) <= room) and pair_dominates(pair, fits, room, has):
                used = Counter([big, *pair])
                plan.fix([big, *pair], min(plan.left[s] // k for s, k in used.items()))
            else:
                break


def best_fit(plan: Plan) -> None:
    """Best-fit decreasing over what the reduction left, a run of equal pieces at a time."""
    room: dict[int, list[tuple[int, int]]] = {}
    keys: list[int] = []

    def put(free: int, sequence: int, n: int) -> None:
        if n and free:
            if free not in room:
                bisect.insort(keys, free)
                room[free] = []
            room[free].append((sequence, n))

    for size in sorted(plan.left, reverse=True):
        while n := plan.left.get(size, 0):
            at = bisect.bisect_left(keys, size)
            if at < len(keys):
                free = keys[at]
                first, m = room[free].pop()
                if not room[free]:
                    del room[free], keys[at]
            else:
                free, first = plan.capacity, plan.sequences
                m = -(-n // (plan.capacity // size))
                plan.sequences += m
            per = free // size
            n = min(n, m * per)
            whole, part = divmod(n, per)
            used = plan.capacity - free
            if whole:
                plan.take(size, whole * per, first, per, used)
                put(free - per * size, first, whole)
            if part:
                plan.take(size, part, first + whole, part, used)
                put(free - part * size, first + whole, 1)
            put(free, first + whole + bool(part), m - whole - bool(part))


def plan_packing(counts: dict[int, int], capacity: int) -> Plan:
    """The plan for ``counts`` pieces of each length (1 to ``capacity``).

    The reduction costs no sequence, but best-fit on what it leaves could, by chance of order; so the
    plan is never one that needs more than best-fit alone.
    """
    plans = [Plan(capacity, {int(s): int(n) for s, n in counts.items() if n}) for _ in range(2)]
    dominating_sets(plans[0])
    for plan in plans:
        best_fit(plan)
    return min(plans, key=lambda plan: plan.sequences)


def cut_pieces(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """The pieces of every document: its ids (by the library's merges) and ``end_id``, cut only where longer than ``capacity``."""
    path = vocabulary or default_path()

    def cut(batches):
        bpe, last = loaded(path), np.array([end_id], np.uint32)
        for batch in batches:
            for at, some in slices(batch.column(1), 3_000_000):
                codes, offsets, ids, lengths = bpe.encode(some, by_library=True)
                store = np.frombuffer(b"".join(ids), bpe.kind)
                flat = store[gather_runs((np.cumsum(lengths) - lengths)[codes], lengths[codes])].astype("<u4")
                own = row_sums(lengths[codes], offsets)
                ends = np.cumsum(own)
                rows = ([], [], [], [], [])
                for k, (to, n) in enumerate(zip(ends.tolist(), own.tolist())):
                    doc = np.concatenate([flat[to - n : to], last])
                    for piece, start in enumerate(range(0, n + 1, capacity)):
                        part = doc[start : start + capacity]
                        for x, v in zip(rows, (k, piece, start, len(part), zlib.crc32(part.tobytes()))):
                            x.append(v)
                k, piece, start, length, crc = rows
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)).take(pa.array(k)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])
            release()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECES)


#: Buckets of a length that are numbered in one go.
GROUP = 4096


def rank_pieces(pieces: DataFrame, counts: dict[int, int], per_bucket: int = 500) -> DataFrame:
    """Adds ``rank``: a number from 0 within each length, without gaps.

    Ranks are counted within buckets of a length and shifted by the buckets before.  A length has as
    many buckets as its count (of ``counts``) asks for, so one that many pieces share is spread over
    tasks, and the shifts are summed in groups of buckets for the same reason.  What is broadcast is
    a row for each length, ``capacity`` at most; ``pieces`` must be settled.
    """
    if not counts:
        return pieces.withColumn("rank", F.lit(0).cast("long"))
    lengths = pieces.sparkSession.createDataFrame([(int(s), -(-int(n) // per_bucket)) for s, n in counts.items()], "length long, buckets long")
    dealt = pieces.join(F.broadcast(lengths), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "buckets")).drop("buckets")
    sizes = dealt.groupBy("length", "bucket").count().withColumn("group", F.floor(F.col("bucket") / GROUP))
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    groups = sizes.groupBy("length", "group").agg(F.sum("count").alias("n")).select("length", "group", F.coalesce(F.sum("n").over(earlier("length").orderBy("group")), F.lit(0)).alias("base"))
    shift = sizes.withColumn("own", F.coalesce(F.sum("count").over(earlier("length", "group").orderBy("bucket")), F.lit(0))).join(groups, ["length", "group"]).select("length", "bucket", (F.col("own") + F.col("base")).alias("shift"))
    local = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    return dealt.withColumn("own", F.row_number().over(local) - 1).join(shift, ["length", "bucket"]).withColumn("rank", (F.col("own") + F.col("shift")).cast("long")).drop("own", "shift", "bucket")


def place(ranked: DataFrame, plan: Plan) -> DataFrame:
    """Adds sequence_id and offset to ranked pieces."""
    table = np.array(sorted(plan.runs), np.int64).reshape(-1, 6)
    key = (table[:, 0] << 40) + table[:, 1]

    def locate(batches):
        for batch in batches:
            size, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            run = table[np.searchsorted(key, (size << 40) + rank, "right") - 1]
            nth, per = rank - run[:, 1], run[:, 4]
            columns = [*batch.columns[2:], pa.array(size), pa.array(run[:, 3] + nth // per), pa.array(run[:, 5] + nth % per * size)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "ids_crc32", "length", "sequence_id", "offset"])

    placed = ranked.select("length", "rank", "doc_id", "piece", "start", "ids_crc32").mapInArrow(locate, "doc_id long, piece int, start long, ids_crc32 long, length long, sequence_id long, offset long")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """Every piece of every document with its sequence and place there.

    A document is its token ids and ``end_id``; null and empty texts are the one id.  Rows that
    repeat are packed each; pieces of equal length are interchangeable, so ties cannot change the
    number of sequences.  An empty table gives no pieces.  Other columns are not looked at.
    """
    pieces = settle(cut_pieces(docs, doc_id=doc_id, text=text, capacity=capacity, vocabulary=vocabulary, end_id=end_id))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    return place(rank_pieces(pieces, counts), plan_packing(counts, capacity))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))

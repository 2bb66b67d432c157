"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sumiveil.session import settle, shared_dir

#: What a word is, for the operators whose contract says so.
SPACE = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def tabled(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` as a table in the shared folder, compressed by columns as :func:`settle` is not, while it is needed."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    try:
        yield df.sparkSession.read.parquet(path)
    finally:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def sweep(spark: SparkSession) -> None:
    """Let the driver drop what nothing refers to any more: Spark removes shuffle files only as their owners are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(column: pa.Array, max_bytes: int = 2_000_000) -> Iterator[tuple[int, pa.Array]]:
    """Cut a string column into runs of whole rows of about ``max_bytes``, with nulls as empty texts.

    The working arrays of the vectorised operators are a multiple of their input, so this bounds a
    worker's memory by the longest single text rather than by the Arrow batch.
    """
    column = pc.fill_null(pa.array(column, pa.large_string()) if not pa.types.is_large_string(column.type) else column, "")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False)) if len(column) else np.zeros(0)
    at = 0
    while at < len(column):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
        yield at, column.slice(at, to - at)
        at = to


def release() -> None:
    """Give a worker's freed memory back to the system, where its C library can; an executor's workers live long."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """ASCII-white-space words of each text: codes into a dictionary, row offsets, dictionary.

    Empty words (from white space at the ends of a text) are left out.
    """
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not full.all():
        before = np.concatenate([[0], np.cumsum(full)])
        offsets = before[offsets]
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets, coded.dictionary


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of runs of ``values``, empty runs included."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def gather_runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of the runs [start, start + length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def doc_key(doc_id: str = "doc_id", text: str = "text"):
    """Key of a document: rows that repeat both id and text are one document."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit("\x1f"), F.coalesce(F.col(text), F.lit("")))


def fresh(df: DataFrame) -> str:
    """A prefix that no column's name starts with, for columns that must not clash with the caller's."""
    prefix = "_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


#: A key with more than one in ``HOT`` of all rows is hot; there are fewer than ``HOT`` such keys.
HOT = 1000


def join_by_count(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` with the columns of ``table``, which has each ``key`` once and in ``count`` how many rows have it.

    Hot keys are broadcast (fewer than ``HOT`` rows, whatever the data) and leave the shuffle; of the
    other keys none has more than one in ``HOT`` of the rows.  Both sides are read more than once, and
    so must be settled or cheap to make.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT > total
    few = F.broadcast(table.where(hot).drop(count))
    rest = rows.join(few.select(key), key, "left_anti").join(table.where(~hot).drop(count), key)
    return rows.join(few, key).unionByName(rest)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, even where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(value: Column) -> Column:
    """The value, fenced: a later filter isn't pushed below it, which would compute it a second time."""
    return F.when(F.rand(0) >= 0, value)

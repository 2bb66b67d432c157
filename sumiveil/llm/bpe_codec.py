"""BPE encoding and decoding by a contiguous rank array per word."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumiveil.llm.common import gather_runs, read_table, row_sums, slices, words_of
from sumiveil.llm.word_bpe import default_path, loaded


def encode_ids(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every row; null and empty texts give an empty array."""
    path = vocabulary or default_path()

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        bpe, out = loaded(path), []
        for _, some in slices(texts):
            codes, offsets, ids, lengths = bpe.encode(some)
            store = np.frombuffer(b"".join(ids), bpe.kind)
            flat = store[gather_runs((np.cumsum(lengths) - lengths)[codes], lengths[codes])].astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(row_sums(lengths[codes], offsets))]).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))

    return docs.select(F.col(doc_id).alias("doc_id"), encode(F.col(text)).alias("ids"))


def decode_ids(encoded: DataFrame, *, doc_id: str = "doc_id", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """doc_id and text: the tokens of the ids, joined as the vocabulary's decoder says.

    The vocabulary names no decoder, for which the library joins tokens by one blank.  A null or
    empty list gives an empty text; an id outside the vocabulary is left out.
    """
    path = vocabulary or default_path()

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        tokens = loaded(path).tokens
        return pa.array([" ".join([tokens[i] for i in x if i in tokens]) if x else "" for x in lists.to_pylist()], pa.string())

    return encoded.select(F.col(doc_id).alias("doc_id"), decode(F.col(ids)).alias("text"))


def codec_digests(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, in one pass over the texts.

    Same ids and texts as :func:`encode_ids` and :func:`decode_ids`; only their digests leave the
    worker.  Null and empty texts have no ids, and the digests of an empty string.
    """
    path = vocabulary or default_path()

    @F.arrow_udf("struct<n:long,i:string,d:string>")
    def digests(texts: pa.Array) -> pa.Array:
        bpe = loaded(path)
        n, i, d = [], [], []
        for _, some in slices(texts):
            codes, offsets, words = words_of(some)
            each = bpe.lookup(words, bpe.digest_word)
            count = np.fromiter((x[0] for x in each), np.int64, len(each))
            n.append(row_sums(count[codes], offsets))
            shown, tokens = [x[1] for x in each], [x[2] for x in each]
            codes = codes.tolist()
            for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
                own = [c for c in codes[a:b] if shown[c]]
                i.append(hashlib.sha256(b" ".join([shown[c] for c in own])).hexdigest())
                d.append(hashlib.sha256(b" ".join([tokens[c] for c in own])).hexdigest())
        return pa.StructArray.from_arrays([pa.array(np.concatenate(n) if n else np.zeros(0, np.int64)), pa.array(i, pa.string()), pa.array(d, pa.string())], ["n", "i", "d"])

    out = docs.select(F.col(doc_id).alias("doc_id"), digests(F.col(text)).alias("x"))
    return out.select("doc_id", F.col("x.n").alias("n_tokens"), F.col("x.i").alias("ids_sha256"), F.col("x.d").alias("decoded_sha256"))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec_digests(read_table(spark, sf_dir, "documents"))

"""Substring dedup by hashing lines, and passages within lines.

Units are normalised (case, white space, punctuation at word ends), their digests are grouped
globally, each keeps its earliest occurrence, by document and place, and all others are removed with
the offsets they had in the original text.  There are two kinds of units:

- whole lines, however short (one of under ``min_words`` words is the same only as a whole line);
- passages of at least ``min_words`` words inside a line, so that one pasted into the middle of a
  paragraph goes too.  A line is cut after every word whose hash is the least of the ``REACH`` words
  on either side, which falls at the same words wherever the passage stands; a unit begins at a cut
  and takes in whole pieces until it has enough words.  It is hashed as one sequence, so all of its
  words stand one after another in the text that it repeats.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sumiveil.llm.common import doc_key, fresh, join_by_count, read_table, settle, slices, words_of

REACH = 4
MIN_WORDS = 10
EDGE = ".,;:!?()[]{}\"'«»¡¿…*_-"
BREAK = "\x00"
TOKENS = re.compile(r"\n|[^\x20\x09-\x0D]+")
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_LINE = np.uint64(0xD6E8FEB86659FD93)


def sequence_digests(words: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A digest of each sequence words[first:end], the same wherever it stands."""
    powers = np.full((2, len(words) + 1), 1, np.uint64)
    powers[0, 1:], powers[1, 1:] = np.uint64(_STEP), np.uint64(_BACK)
    np.cumprod(powers, axis=1, out=powers)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers[0, :-1], out=total[1:])
    h = (total[end] - total[first]) * powers[1, first]  # of odd numbers modulo 2**64, so the division is exact
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD) + (end - first).astype(np.uint64)
    return h ^ (h >> np.uint64(29))


def units(texts: pa.Array, reach: int = REACH, min_words: int = MIN_WORDS) -> dict[str, np.ndarray]:
    """The units of each text in order: row, first token, end token and digest.

    Tokens are words and line breaks, in the order in which ``TOKENS`` finds them.  Lines without a
    letter or digit are no units.
    """
    codes, offsets, vocabulary = words_of(pc.replace_substring(texts, "\n", f" {BREAK} "))
    n = len(codes)
    none = np.zeros(0, np.int64)
    if not n:
        return {"row": none, "first": none, "end": none, "digest": none}
    words = [w.lower().strip(EDGE) for w in vocabulary.to_pylist()]
    word = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))[codes]
    said = np.fromiter((any(c.isalnum() for c in w) for w in words), bool, len(words))[codes]
    is_break = np.fromiter((w == BREAK for w in words), bool, len(words))[codes]
    # a line's number, new with every text
    line = np.cumsum(is_break) + np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = np.flatnonzero(~is_break)
    if not len(inside):
        return {"row": none, "first": none, "end": none, "digest": none}
    least = np.ones(n, bool)
    for k in range(1, reach + 1):
        same = (line[k:] == line[:-k]) & ~is_break[:-k]
        least[k:] &= ~(same & (word[:-k] <= word[k:]))
        least[:-k] &= ~(same & (word[k:] < word[:-k]))
    new_line = np.ones(len(inside), bool)
    new_line[1:] = line[inside[1:]] != line[inside[:-1]]
    begins = new_line.copy()
    begins[1:] |= least[inside[:-1]]
    # lines
    first = inside[new_line]
    end = np.append(inside[np.flatnonzero(new_line)[1:] - 1], inside[-1]) + 1
    heard = np.append(0, np.cumsum(said))
    real = heard[end] > heard[first]
    line_first, line_end = first[real], end[real]
    # passages: from each piece on, until there are words enough, within the line
    at = np.flatnonzero(begins)
    start = inside[at]
    piece_end = np.append(inside[at[1:] - 1], inside[-1]) + 1
    size = np.cumsum(piece_end - start)
    to = np.searchsorted(size, size - (piece_end - start) + min_words)
    fits = to < len(at)
    fits[fits] = line[start[to[fits]]] == line[start[fits]]
    start, piece_end = start[fits], piece_end[to[fits]]
    first, end = np.concatenate([line_first, start]), np.concatenate([line_end, piece_end])
    digest = sequence_digests(word, first, end)
    digest[: len(line_first)][line_end - line_first < min_words] ^= _LINE  # a longer line is a passage as well
    order = np.lexsort((end, first))
    first, end, digest = first[order], end[order], digest[order]
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (end[1:] != end[:-1])
    first, end, digest = first[new], end[new], digest[new]
    row = np.searchsorted(offsets, first, "right") - 1
    return {"row": row, "first": first - offsets[row], "end": end - offsets[row], "digest": digest.view(np.int64)}


def removed_spans(text: str, first: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Code-point spans of the tokens [first, end) of one text, joined where they touch; a line that goes whole takes its break along."""
    tokens = [m.span() for m in TOKENS.finditer(text)]
    spans: list[list[int]] = []
    reached = -1
    for a, b in zip(first.tolist(), end.tolist()):  # in order of their beginnings
        if a <= reached:
            reached = max(reached, b)
            spans[-1][1] = max(spans[-1][1], tokens[b - 1][1])
        else:
            reached = b
            spans.append([tokens[a][0], tokens[b - 1][1]])
    return [(s, e + 1 if (s == 0 or text[s - 1] == "\n") and text[e : e + 1] == "\n" else e) for s, e in spans]


def unit_digests(text: Column, reach: int = REACH, min_words: int = MIN_WORDS) -> Column:
    """The different digests of a text's units."""

    @F.arrow_udf("array<long>")
    def digests(texts: pa.Array) -> pa.Array:
        out = []
        for _, some in slices(texts):
            own = units(some, reach, min_words)
            order = np.lexsort((own["digest"], own["row"]))
            row, digest = own["row"][order], own["digest"][order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (digest[1:] != digest[:-1])
            ends = np.searchsorted(row[new], np.arange(len(some) + 1))
            out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(digest[new])))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int64()))

    return digests(text)


def without(text: Column, later: Column, reach: int = REACH, min_words: int = MIN_WORDS) -> Column:
    """text without the units whose digests are in ``later`` or repeat in the text itself, and the removed spans."""

    @F.arrow_udf("struct<text:string,spans:array<struct<start:int,end:int>>>")
    def cut(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out, gone = [], []
        for at, some in slices(texts):
            own = units(some, reach, min_words)
            bound = np.searchsorted(own["row"], np.arange(len(some) + 1))
            for k, t in enumerate(some.to_pylist()):
                mine = slice(int(bound[k]), int(bound[k + 1]))
                digest = own["digest"][mine]
                goes = np.ones(len(digest), bool)
                goes[np.unique(digest, return_index=True)[1]] = False
                if lists[at + k].is_valid:
                    goes |= np.isin(digest, lists[at + k].values.to_numpy())
                spans = removed_spans(t, own["first"][mine][goes], own["end"][mine][goes]) if goes.any() else []
                for start, end in reversed(spans):
                    t = t[:start] + t[end:]
                out.append(t)
                gone.append([{"start": s, "end": e} for s, e in spans])
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(gone, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["text", "spans"])

    return cut(text, later)


def with_substrings_removed(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", into: str = "dedup", reach: int = REACH, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with a column ``into``: struct of the cleaned text and the removed spans.

    Spans are (start, end) in code points of the original text.  A unit's earliest occurrence is the
    one in the document of least doc_id (null ids are last; documents of one id are told apart and
    put in order by a hash of id and text), the first in that text.  Rows that repeat doc_id and text
    are one document and lose the same.  Null and empty texts are empty texts; a text of which all
    goes stays as an empty one.  An empty table gives no rows.  Other columns stay as they are,
    whatever their names.
    """
    own = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1)).alias("rank"), doc_key(doc_id, text).alias("key"), unit_digests(F.col(text), reach, min_words).alias("digests"))
    found = settle(own).select(F.struct("rank", "key").alias("at"), F.explode("digests").alias("digest"))
    earliest = found.groupBy("digest").agg(F.min("at").alias("least"), F.max("at").alias("most"), F.count("*").alias("n")).where("least < most").select("digest", "least", "n")
    # what a document has to lose; a line that very many documents have leaves the shuffle
    later = join_by_count(found, settle(earliest), "digest", "n").where("at > least").groupBy("at.key").agg(F.collect_set("digest").alias("later"))
    tag = fresh(docs)
    keyed = docs.withColumn(tag + "key", doc_key(doc_id, text)).join(later.select(F.col("key").alias(tag + "key"), F.col("later").alias(tag + "later")), tag + "key", "left")
    return keyed.withColumn(into, without(F.col(text), F.col(tag + "later"), reach, min_words)).drop(tag + "key", tag + "later")


def dedup_substrings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", reach: int = REACH, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text (cleaned), spans (removed, in the original) and n_removed (code points) of every row."""
    out = with_substrings_removed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), reach=reach, min_words=min_words)
    spans = F.col("dedup.spans")
    return out.select("doc_id", F.col("dedup.text").alias("text"), spans.alias("spans"), F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("n_removed"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read_table(spark, sf_dir, "documents"))

"""What models and dictionaries add: morphology over arrays of morphemes, and sources of entity spans.

Neither a model nor a dictionary comes with this package.  A morphology provider is any column of
array<struct<surface string, pos array<string>, reading string, begin int, end int>>; a gate or core
that needs one isn't applied without it.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumiveil.functions import patterns as P
from sumiveil.functions.numbering import with_row
from sumiveil.functions.spans import without_contained
from sumiveil.functions.text import _c, chunks, cut, katakana_to_hiragana, trim

MORPHEMES = "array<struct<surface:string,pos:array<string>,reading:string,begin:int,end:int>>"
RUNS = "array<struct<begin:int,end:int,count:int>>"


def _pos(m: Column, k: int) -> Column:
    return F.coalesce(F.get(m["pos"], F.lit(k)), F.lit(""))


def _runs(morphemes: Column, member: Callable[[Column], Column]) -> Column:
    """Runs of member morphemes as (begin, end, count); blanks within a run are bridged."""
    state = f"struct<runs:{RUNS},open:boolean>"

    def step(s, m):
        last = F.get(s["runs"], F.size(s["runs"]) - 1)
        longer = F.concat(F.slice(s["runs"], F.lit(1), F.greatest(F.size(s["runs"]) - 1, F.lit(0))), F.array(F.struct(last["begin"].alias("begin"), m["end"].alias("end"), (last["count"] + 1).alias("count"))))
        fresh = F.concat(s["runs"], F.array(F.struct(m["begin"].alias("begin"), m["end"].alias("end"), F.lit(1).alias("count"))))
        state_of = lambda runs, is_open: F.struct(runs.alias("runs"), is_open.alias("open")).cast(state)
        return F.when(member(m) & s["open"], state_of(longer, F.lit(True))).when(member(m), state_of(fresh, F.lit(True))).when((_pos(m, 0) == "空白") & s["open"], s).otherwise(state_of(s["runs"], F.lit(False)))

    start = F.struct(F.array().cast(RUNS).alias("runs"), F.lit(False).alias("open")).cast(state)
    return F.aggregate(morphemes, start, step, lambda s: s["runs"])


def _first_greatest(runs: Column, size: Callable[[Column], Column]) -> Column:
    most = F.array_max(F.transform(runs, size))
    return F.get(F.filter(runs, lambda r: size(r) == most), F.lit(0))


def person_core(name, morphemes) -> Column:
    """The longest run of name morphemes (the first on a tie); the name as it is if it has none."""
    n, m = _c(name), _c(morphemes)
    runs = _runs(m, lambda x: _pos(x, 2) == "人名")
    best = _first_greatest(runs, lambda r: r["count"])
    return F.when(F.size(runs) > 0, trim(cut(n, best["begin"], best["end"]))).otherwise(n)


def organisation_core(name, morphemes) -> Column:
    """The longest noun run with a legal form; without one, the name less leading interjections and fillers."""
    n, m = _c(name), _c(morphemes)
    # Fixed values.
    markers = "株式会社|有限会社|合同会社|合名会社|合資会社|一般社団法人|一般財団法人|公益社団法人|公益財団法人|協同組合|（株）|\\(株\\)|（有）|\\(有\\)|㈱|㈲"
    runs = _runs(m, lambda x: _pos(x, 0).isin("名詞", "接頭辞", "形状詞") | x["surface"].isin("・", "&", "＆"))
    marked = F.filter(runs, lambda r: cut(n, r["begin"], r["end"]).rlike(markers))
    best = _first_greatest(marked, lambda r: r["end"] - r["begin"])
    junk = lambda x: _pos(x, 0).isin("感動詞", "空白") | (_pos(x, 1) == "フィラー")
    skip = F.aggregate(m, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.when(s["on"] & junk(x), F.struct((s["n"] + 1).alias("n"), F.lit(True).alias("on"))).otherwise(F.struct(s["n"].alias("n"), F.lit(False).alias("on"))), lambda s: s["n"])
    rest = trim(cut(n, F.get(m, skip)["begin"], F.get(m, F.size(m) - 1)["end"]))
    return F.when(F.size(marked) > 0, trim(cut(n, best["begin"], best["end"]))).when((skip > 0) & (skip < F.size(m)), rest).otherwise(n)


def no_noun(morphemes) -> Column:
    """At least one morpheme, and none is a noun."""
    real = F.filter(_c(morphemes), lambda x: (_pos(x, 0) != "") & (_pos(x, 0) != "空白"))
    return (F.size(real) > 0) & ~F.exists(real, lambda x: _pos(x, 0) == "名詞")


def readings(name, morphemes) -> Column:
    """Readings of a name in both scripts, joined in three ways, other than the name itself."""
    n = _c(name)
    parts = F.transform(F.filter(_c(morphemes), lambda x: (trim(x["surface"]) != "") & (F.coalesce(x["reading"], F.lit("")) != "")), lambda x: x["reading"])
    made = [r for sep in ("", " ", "　") for r in (F.array_join(parts, sep), katakana_to_hiragana(F.array_join(parts, sep)))]
    return F.filter(F.array_distinct(F.array(*made)), lambda r: (r != "") & (r != n))


def reading_terms(terms: DataFrame, analyse: Callable[[Column], Column]) -> DataFrame:
    """Aliases of people's names: alias and canonical text, for readings that have a noun; ``analyse`` gives morphemes."""
    people = terms.where("entity_type = 'PERSON'").withColumn("m", analyse(F.col("text")))
    alias = people.select(F.col("text").alias("canonical"), F.explode(readings("text", "m")).alias("alias")).withColumn("m", analyse(F.col("alias")))
    return alias.where(~no_noun("m")).select("alias", "canonical").dropDuplicates(["alias"])


class NerProvider(Protocol):
    def spans(self, chunks: DataFrame) -> DataFrame:
        """type, begin, end, score of each (doc_id, base, text) chunk, with doc_id and base; offsets within the chunk."""


class NullNer:
    """No model: nothing is found, and nobody should take that for a clean text."""

    def spans(self, chunks: DataFrame) -> DataFrame:
        return chunks.limit(0).select("doc_id", "base", F.lit("").alias("type"), F.lit(0).alias("begin"), F.lit(0).alias("end"), F.lit(0.0).cast("float").alias("score"))


class TableNer:
    """Spans from a table (doc_id, base, type, begin, end, score)."""

    by_id = True

    def __init__(self, table: DataFrame):
        self.table = table

    def spans(self, chunks: DataFrame) -> DataFrame:
        return chunks.select("doc_id", "base").join(self.table, ["doc_id", "base"]).select("doc_id", "base", "type", "begin", "end", "score")


def align_words(tokens: list[dict], text: str) -> None:
    """Touching ASCII letter and digit tokens take the label of the first."""
    plain = [(s := text[t["begin"] : t["end"]]) != "" and s.isascii() and s.isalnum() for t in tokens]
    for k in range(1, len(tokens)):
        if plain[k] and plain[k - 1] and tokens[k]["begin"] == tokens[k - 1]["end"]:
            tokens[k]["label"] = tokens[k - 1]["label"]


def entities(tokens: list[dict]) -> list[dict]:
    """Runs of one label as spans with their mean score; O and unmapped labels give none."""
    out, k = [], 0
    while k < len(tokens):
        j = k + 1
        while j < len(tokens) and tokens[j]["label"] == tokens[k]["label"]:
            j += 1
        if kind := P.LABEL_MAP.get(tokens[k]["label"].rpartition("-")[2]):
            out.append({"type": kind, "begin": tokens[k]["begin"], "end": tokens[j - 1]["end"], "score": float(np.mean([t["score"] for t in tokens[k:j]]))})
        k = j
    return out


_SESSIONS: dict[tuple, tuple] = {}


class OnnxNer:
    """An ONNX token classifier with a ``tokenizers`` file; both are loaded once per worker."""

    def __init__(self, model: str, tokenizer: str, labels: dict[int, str]):
        self.model, self.tokenizer, self.labels = model, tokenizer, labels

    def _load(self):
        key = (self.model, self.tokenizer)
        if key not in _SESSIONS:
            import onnxruntime
            from tokenizers import Tokenizer

            error = None
            for level in ("ORT_ENABLE_ALL", "ORT_ENABLE_EXTENDED", "ORT_ENABLE_BASIC"):
                options = onnxruntime.SessionOptions()
                options.graph_optimization_level = getattr(onnxruntime.GraphOptimizationLevel, level)
                try:
                    _SESSIONS[key] = (onnxruntime.InferenceSession(self.model, options), Tokenizer.from_file(self.tokenizer))
                    break
                except Exception as e:  # a lower optimisation may still load
                    error = e
            else:
                raise error
        return _SESSIONS[key]

    def tag(self, text: str) -> list[dict]:
        session, tokenizer = self._load()
        encoded = tokenizer.encode(text)
        ids = np.array([encoded.ids], np.int64)
        logits = session.run(["logits"], {"input_ids": ids, "attention_mask": np.ones_like(ids)})[0][0].astype(np.float64)
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        tokens = [{"label": self.labels[int(p[k].argmax())], "score": float(p[k].max()), "begin": b, "end": e} for k, (b, e) in enumerate(encoded.offsets) if not encoded.special_tokens_mask[k]]
        align_words(tokens, text)
        return entities(tokens)

    def spans(self, chunks: DataFrame) -> DataFrame:
        def run(batches):
            for batch in batches:
                rows = [{"doc_id": i, "base": b} | s for i, b, t in zip(*(c.to_pylist() for c in batch.columns)) for s in self.tag(t)]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", batch.schema.field(0).type), ("base", pa.int32()), ("type", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float32())]))

        kind = chunks.schema["doc_id"].dataType.simpleString()
        return chunks.select("doc_id", "base", "text").mapInArrow(run, f"doc_id {kind}, base int, type string, begin int, end int, score float")


def model_spans(docs: DataFrame, provider: NerProvider, *, doc_id: str = "doc_id", text: str = "text", size: int = 250) -> DataFrame:
    """doc_id, text and model_spans (array of type, begin, end, value, score) of a provider, over overlapping chunks, without repeats.

    The provider gets a number of the row as doc_id, so rows with a null or a repeated doc_id have
    their own spans; only one that goes by the caller's ids (``by_id``) gets those.
    """
    key = "doc_id" if getattr(provider, "by_id", False) else "row"
    docs = with_row(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    pieces = docs.select(F.col(key).alias("doc_id"), F.explode(chunks("text", size)).alias("c")).select("doc_id", "c.base", "c.text")
    found = provider.spans(pieces).select("doc_id", "base", "type", (F.col("begin") + F.col("base")).alias("begin"), (F.col("end") + F.col("base")).alias("end"), "score")
    each = found.groupBy(F.col("doc_id").alias(key)).agg(F.array_sort(F.collect_list(F.struct("base", "begin", "end", "type", "score"))).alias("s"))
    joined = docs.join(each, key, "left")
    spans = F.transform(without_contained(F.coalesce(F.col("s"), F.array().cast("array<struct<base:int,begin:int,end:int,type:string,score:float>>"))), lambda x: F.struct(x["type"].alias("type"), x["begin"].alias("begin"), x["end"].alias("end"), cut(F.col("text"), x["begin"], x["end"]).alias("value"), x["score"].alias("score")))
    return joined.select("doc_id", "text", spans.alias("model_spans"))

"""Matching confirmed terms, numbering, masking, gates and restoring."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumiveil.functions import patterns as P
from sumiveil.functions.finder import Finder
from sumiveil.functions.numbering import dense_numbers, nulls_last, with_row
from sumiveil.functions.spans import first_taken, matches, splice
from sumiveil.functions.text import _c

#: From so many characters on, a term matches across white space and line breaks.
LOOSE_FROM = 4
#: Terms of one broadcast; longer lists are matched a block at a time.
TERMS_PER_BLOCK = 100_000
HIT = "struct<begin:int,end:int,stage:int,kind:string,value:string,term:string,rank:long>"
HIT_ARROW = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("stage", pa.int32()), ("kind", pa.string()), ("value", pa.string()), ("term", pa.string()), ("rank", pa.int64())]))


class TermMatcher:
    """Hits of every term in a text, by rank, then place; an alias is masked under its canonical text.

    Terms of ``LOOSE_FROM`` characters or more are looked for in the text without its white space,
    and where there are any their places come from the runs between it.
    """

    def __init__(self, terms: list[tuple]):
        import regex

        self.space, self.run = regex.compile(r"\s+"), regex.compile(r"\S+")
        self.terms = sorted((t for t in terms if t[1]), key=lambda t: (-len(t[1]), t[0]))
        cores = ["".join(c for c in t[1] if c not in P.NARROW_SPACE) for t in self.terms]
        self.shown = [t[4] if len(t) > 4 and t[4] else t[1] for t in self.terms]
        self.loose = [k for k, c in enumerate(cores) if len(c) >= LOOSE_FROM]
        self.exact = [k for k, c in enumerate(cores) if len(c) < LOOSE_FROM]
        self.size = [len(c) for c in cores]
        self.in_cores, self.in_text = Finder([cores[k] for k in self.loose]), Finder([self.terms[k][1] for k in self.exact])

    def places(self, text: str) -> list[tuple[int, int, int]]:
        """(term, begin, end) of all hits."""
        out = [(self.exact[k], p, p + len(self.terms[self.exact[k]][1])) for k, p in self.in_text.find(text)]
        found = self.in_cores.find(self.space.sub("", text)) if self.loose else []
        if found:
            runs = [m.span() for m in self.run.finditer(text)]
            begins = np.fromiter((b for b, _ in runs), np.int64, len(runs))
            before = np.cumsum([0, *(e - b for b, e in runs[:-1])])
            last = lambda p: int(np.searchsorted(before, p, "right")) - 1
            at = lambda p: int(begins[last(p)] + p - before[last(p)])
            out += [(self.loose[k], at(p), at(p + self.size[self.loose[k]] - 1) + 1) for k, p in found]
        return sorted(out)

    def hits(self, text: str | None) -> list[dict]:
        text, out = text or "", []
        for k, b, e in self.places(text):
            o, term, kind, whole = self.terms[k][:4]
            if not whole or not touches_word(text, b, e):
                out.append({"begin": b, "end": e, "stage": 3, "kind": P.TOKEN_PREFIX.get(kind, "MASKED"), "value": self.shown[k], "term": self.shown[k], "rank": ((1 << 20) - len(term)) * (1 << 32) + o})
        return out


def _matcher(terms: list[tuple]):
    """An Arrow UDF of a :class:`TermMatcher`."""
    made: list[TermMatcher] = []

    @F.arrow_udf(f"array<{HIT}>")
    def find(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(TermMatcher(terms))
        return pa.array([made[0].hits(t) for t in texts.to_pylist()], HIT_ARROW)

    return find


def touches_word(text: str, begin: int, end: int) -> bool:
    """Whether a word character stands directly before or after [begin, end)."""
    return bool((begin and is_word(text[begin - 1])) or (end < len(text) and is_word(text[end])))


# Ranges of code points that are no part of a word.
NOT_WORD = ((0xA0, 0xBF), (0x2000, 0x206F), (0x2E00, 0x2E7F), (0x3000, 0x303F), (0x30FB, 0x30FB), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65), (0xFFFD, 0xFFFD))


def is_word(char: str) -> bool:
    cp = ord(char)
    return char.isalnum() if cp < 0x80 else not any(a <= cp <= b for a, b in NOT_WORD)


def number_hits(text) -> Column:
    """Hits of e-mail addresses, phone numbers and postal codes, in that order of precedence."""
    made = [F.transform(matches(text, p), _number_hit(stage, kind)) for stage, (kind, p) in enumerate(P.NUMBER_PATTERNS)]
    return F.concat(*made)


def _number_hit(stage: int, kind: str):
    return lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"), F.lit(stage).alias("stage"), F.lit(kind).alias("kind"), s["value"].alias("value"), F.lit("").alias("term"), F.lit(0).cast("long").alias("rank"))


def term_hits(text, terms: list[tuple]) -> Column:
    """Hits of confirmed terms (ord, text, entity type, whole word and, for a reading, the name it stands for), longest term first, then by list order.

    Terms of ``LOOSE_FROM`` characters or more match across white space; shorter ones exactly.
    """
    parts = [_matcher(terms[a : a + TERMS_PER_BLOCK])(_c(text)) for a in range(0, len(terms), TERMS_PER_BLOCK)]
    if not parts:
        return F.array().cast(f"array<{HIT}>")
    return parts[0] if len(parts) == 1 else F.array_sort(F.concat(*parts), _by_rank)


def _by_rank(a, b):
    return F.when(a["rank"] < b["rank"], -1).when(a["rank"] > b["rank"], 1).when(a["begin"] < b["begin"], -1).when(a["begin"] > b["begin"], 1).otherwise(0)


def mask_hits(text, terms: list[tuple] = ()) -> Column:
    """What is masked in a text, by place: numbers first, then terms; nothing overlaps."""
    return first_taken(F.concat(number_hits(text).cast(f"array<{HIT}>"), term_hits(text, list(terms)).cast(f"array<{HIT}>")), HIT)


def preview(docs: DataFrame, terms=(), *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, begin, end, category and term of every place that masking would replace."""
    category = F.create_map(*[F.lit(x) for k, c in (("PERSON", "person"), ("COMPANY", "company"), ("ADDRESS", "address"), ("EMAIL", "email"), ("PHONE", "phone"), ("POSTAL", "postal"), ("ID", "id")) for x in (k, c)])
    out = docs.select(F.col(doc_id).alias("doc_id"), F.explode(mask_hits(text, terms)).alias("h"))
    return out.select("doc_id", "h.begin", "h.end", F.coalesce(F.try_element_at(category, F.col("h.kind")), F.lit("company")).alias("category"), "h.term")


def placeholder(kind, number, reversible: bool = True) -> Column:
    k, n = _c(kind), _c(number).cast("string")
    if reversible:
        return F.concat(F.lit("{{"), k, F.lit("_"), n, F.lit("}}"))
    label = F.create_map(*[F.lit(x) for kv in P.LABEL_JA.items() for x in kv])
    return F.concat(F.lit("["), F.coalesce(F.try_element_at(label, k), k), n, F.lit("]"))


def number_values(hits: DataFrame, reversible: bool = True) -> DataFrame:
    """The mapping: value, kind, n and token, from hits (ord, begin, stage, kind, value, rank).

    A value has one token whatever the kinds it was hit as, that of its first hit.  Within a kind
    numbers are numbered as they appear (by ``ord``, of any type, then place), terms by length and
    list order.
    """
    lead = F.struct("stage", F.when(F.col("stage") < 3, F.col("ord")).alias("ord"), "rank", "begin")
    first = hits.withColumn("lead", lead).groupBy("value").agg(F.min(F.struct("lead", "kind")).alias("f")).select("value", "f.lead", "f.kind")
    numbered = dense_numbers(first, ["kind"], ["lead", "value"], "n")
    return numbered.select("value", "kind", "n", placeholder("kind", "n", reversible).alias("token"))


def spliced(found: DataFrame, pieces: DataFrame, to: str, by: str = "row") -> DataFrame:
    """``found`` with the spans of its column text replaced that ``pieces`` (``by``, begin, end, ``to``) has; texts move once."""
    spans = pieces.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("begin", "end", to))).alias("spans"))
    out = F.when(F.col("spans").isNull(), F.col("text")).otherwise(splice("text", F.col("spans"), lambda s: s[to]))
    return found.join(spans, by, "left").withColumn("text", out).drop("spans")


def mask(docs: DataFrame, terms=(), *, doc_id: str = "doc_id", text: str = "text", then: tuple[str, ...] = (), reversible: bool = True) -> tuple[DataFrame, DataFrame]:
    """(doc_id and masked text, mapping); doc_id gives the order in which numbers appear, nulls last.

    Rows of one doc_id are ordered by the columns of ``then``; what these leave open follows the
    order in which the rows are read, and so the layout of their files.

    Rows are told apart by a number of the engine's own, never by doc_id, so rows with a null or a
    repeated doc_id are masked each.  Texts are searched once; only hits travel: they meet their
    tokens by value and come back to their row.  Null texts are empty; an empty table gives no rows.
    """
    out, mapping = mask_rows(docs, terms, doc_id=doc_id, text=text, then=then, reversible=reversible)
    return out.select("doc_id", "text"), mapping


def mask_rows(docs: DataFrame, terms=(), *, doc_id: str = "doc_id", text: str = "text", then: tuple[str, ...] = (), reversible: bool = True) -> tuple[DataFrame, DataFrame]:
    """As :func:`mask`, with ``existing``: what in the source already looks like a placeholder, and so may be restored wrongly."""
    order = [nulls_last(c).alias(f"then_{k}") for k, c in enumerate(then)]
    found = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *order)
    found = with_row(found.withColumn("hits", mask_hits("text", terms)))
    each = found.select("row", F.struct(nulls_last("doc_id").alias("id"), *[f"then_{k}" for k in range(len(then))], "row").alias("ord"), F.explode("hits").alias("h")).select("row", "ord", "h.begin", "h.end", "h.stage", "h.kind", "h.value", "h.rank")
    mapping = number_values(each, reversible)
    pieces = each.join(mapping.select("value", "token"), "value").select("row", "begin", "end", "token")
    return spliced(found.select("row", "doc_id", "text", existing_placeholders("text").alias("existing")), pieces, "token").select("doc_id", "text", "existing"), mapping


def existing_placeholders(text) -> Column:
    """Distinct token-shaped strings of a text, in order."""
    return F.array_distinct(F.regexp_extract_all(_c(text), F.lit(P.PLACEHOLDER), F.lit(0)))


def unreplaced_tokens(text) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(P.REVERSIBLE), F.lit(0))


def outside_placeholders(spans: Column, text) -> Column:
    inside = matches(text, P.PLACEHOLDER)
    return F.filter(spans, lambda s: ~F.exists(inside, lambda p: (s["begin"] >= p["begin"]) & (s["end"] <= p["end"])))


def gate(text, values: list[str] = (), bounded: list[str] = ()) -> Column:
    """What a masked text still shows: values outside placeholders (``bounded`` ones as whole words), then numbers.

    An empty array means that nothing was found.
    """
    out = []
    for given, whole in ((values, False), (bounded, True)):
        given = [v for v in given if v]
        if given:
            out.append(_names(outside_placeholders(_literal(given, whole)(_c(text)), text), given))
    numbers = F.concat(*[outside_placeholders(matches(text, p), text) for _, p in P.NUMBER_PATTERNS])
    return F.concat(*out, F.transform(numbers, lambda s: s["value"]))


def _names(found: Column, given: list[str]) -> Column:
    names = F.array(*[F.lit(v) for v in given])
    return F.transform(F.array_sort(F.array_distinct(F.transform(found, lambda h: h["ord"]))), lambda o: F.get(names, o.cast("int")))


def _literal(values: list[str], whole: bool):
    finders: list[Finder] = []

    @F.arrow_udf("array<struct<ord:long,begin:int,end:int>>")
    def find(texts: pa.Array) -> pa.Array:
        if not finders:
            finders.append(Finder(values))
        out = []
        for text in texts.to_pylist():
            text = text or ""
            places = [(o, p, p + len(values[o])) for o, p in finders[0].find(text)]
            out.append([{"ord": o, "begin": b, "end": e} for o, b, e in places if not whole or not touches_word(text, b, e)])
        return pa.array(out, pa.list_(pa.struct([("ord", pa.int64()), ("begin", pa.int32()), ("end", pa.int32())])))

    return find


def restore(docs: DataFrame, mapping: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text with tokens replaced by their values, and the tokens left over, of every row.

    Rows with a null or a repeated doc_id are restored each; null texts are empty.
    """
    found = with_row(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    each = found.select("row", F.explode(matches("text", P.PLACEHOLDER)).alias("h")).select("row", "h.begin", "h.end", F.col("h.value").alias("token"))
    pieces = each.join(mapping.select("token", "value").dropDuplicates(["token"]), "token").select("row", "begin", "end", "value")
    return spliced(found, pieces, "value").select("doc_id", "text").withColumn("left_over", unreplaced_tokens("text"))

"""From spans to ranked candidates: trim, group, choose a surface, drop, merge, order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumiveil.functions import patterns as P
from sumiveil.functions.spans import overlap
from sumiveil.functions.text import _c, has_letter, is_file_extension, is_single_kanji, strip_all_whitespace, strip_set, trim
from sumiveil.operators.detection import protected_spans

DELIMITER = "[" + "".join("\\" + c if c in "[]()*/" else c for c in P.ORG_DELIMITERS) + "]"
NOT_DELIMITER = "[^" + DELIMITER[1:]


def _before(text: Column, pattern: str) -> Column:
    """Length of the text before the first match."""
    return F.char_length(F.get(F.split(text, pattern, 2), F.lit(0)))


def cut_before_pii(text) -> Column:
    t = _c(text)
    markers = "|".join(re.escape(m) for m in P.COMPANY_MARKERS)
    return trim(F.substring(t, F.lit(1), F.least(*[_before(t, p) for p in (P.EMAIL, P.PHONE, P.POSTAL, markers)])))


def trim_location(text) -> Column:
    """The address pieces of a span: whole if it has no number to cut at, else each piece from its prefecture on."""
    t = _c(text)
    markers = "|".join(re.escape(m) for m in P.COMPANY_MARKERS)
    first = lambda s: F.concat(F.regexp_extract(s, P.PREFECTURE, 0), F.get(F.split(s, P.PREFECTURE, 2), F.lit(1)))
    pieces = F.transform(F.filter(F.split(t, P.PII_SPLIT), lambda s: s.rlike(P.PREFECTURE)), lambda s: strip_set(F.get(F.split(first(s), markers, 2), F.lit(0)), P.LOCATION_STRIP))
    whole = F.filter(F.array(trim(t)), lambda s: s != "")
    return F.when(t.rlike(P.PII_SPLIT), F.filter(pieces, lambda s: s != "")).otherwise(whole)


def trim_organisation(text) -> Column:
    """The company name around the first legal form; without one, what stands before numbers."""
    t = _c(text)
    out = trim(F.regexp_replace(cut_before_pii(t), P.ORG_HEAD_JUNK, ""))
    for marker in reversed(P.COMPANY_MARKERS):
        at = F.get(F.split(t, re.escape(marker), 2), F.lit(0))
        rest = F.substring(t, F.char_length(at) + len(marker) + 1, F.char_length(t))
        left = F.regexp_extract(at, f"{NOT_DELIMITER}*$", 0)
        right = F.regexp_extract(rest, rf"(?U)^(?:{NOT_DELIMITER}|[ 　](?={NOT_DELIMITER})(?=[^\W\d_]))*", 0)
        out = F.when(F.contains(t, F.lit(marker)), trim(F.concat(left, F.lit(marker), right))).otherwise(out)
    return out


def is_department(name) -> Column:
    n = _c(name)
    has_marker = n.rlike("|".join(re.escape(m) for m in P.COMPANY_MARKERS))
    return ~has_marker & n.rlike("(" + "|".join(P.DEPARTMENT_ENDS) + ")$")


def surfaces(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", spans: str = "spans") -> DataFrame:
    """doc_id, ord, type, surface, begin, end, score of every trimmed span; a span may give several pieces."""
    one = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.posexplode(spans).alias("ord", "s"))
    raw = F.substring(F.col("text"), F.col("s.begin") + 1, F.col("s.end") - F.col("s.begin"))
    kind = F.col("s.type")
    pieces = F.when(kind == "LOCATION", trim_location(raw)).when(kind == "ORGANIZATION", F.array(trim_organisation(raw))).otherwise(F.array(trim(raw)))
    cut = F.transform(pieces, lambda p: trim(F.get(F.split(p, r"[\r\n]", 2), F.lit(0))))
    return one.select("doc_id", "ord", kind.alias("type"), F.posexplode(cut).alias("piece", "surface"), F.col("s.begin").alias("begin"), F.col("s.end").alias("end"), F.col("s.score").alias("score")).where("surface <> ''").withColumn("ord", F.col("ord") * 1000 + F.col("piece")).drop("piece")


def group_candidates(found: DataFrame) -> DataFrame:
    """Per document, whitespace-free surface and type: count, greatest score, places and the shown surface.

    The most frequent surface is shown; on a tie the one of fewest bytes, then the first seen.
    """
    keyed = found.withColumn("key", strip_all_whitespace("surface"))
    by_surface = keyed.groupBy("doc_id", "key", "type", "surface").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"), F.max("score").alias("score"), F.collect_list(F.struct("ord", "begin", "end")).alias("at"))
    shown = F.min_by("surface", F.struct(-F.col("n"), F.octet_length("surface"), F.col("first")))
    return by_surface.groupBy("doc_id", "key", "type").agg(shown.alias("text"), F.sum("n").alias("count"), F.max("score").alias("score"), F.array_sort(F.flatten(F.collect_list("at"))).alias("offsets"), F.min("first").alias("first"))


def dropped(kind: Column, text: Column, offsets: Column, protected: Column, no_noun: Column | None = None) -> Column:
    """Whether a candidate is to go, by the nine gates; the noun gate needs a morphology provider."""
    name = kind.isin("PERSON", "ORGANIZATION")
    markers = "|".join(re.escape(m) for m in P.COMPANY_MARKERS)
    gates = (
        (F.size(offsets) > 0) & F.forall(offsets, lambda o: F.exists(protected, lambda p: overlap(o, p)))
        | (kind == "PERSON") & text.rlike(P.PERSON_ADDRESS_NOISE)
        | name & (F.char_length(text) == 1) & ~is_single_kanji(text)
        | name & is_file_extension(text)
        | ~has_letter(text)
        | (kind == "ORGANIZATION") & is_department(text)
        | (kind == "ORGANIZATION") & ~has_letter(F.regexp_replace(text, markers, ""))
        | (kind == "LOCATION") & ~text.rlike(P.LOCATION_DIGIT)
    )
    return gates if no_noun is None else gates | (name & F.coalesce(no_noun, F.lit(False)))


def document_candidates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", spans: str = "spans") -> DataFrame:
    """doc_id, text, entity_type, count, score, offsets, first of the candidates that stay."""
    grouped = group_candidates(surfaces(docs, doc_id=doc_id, text=text, spans=spans))
    guard = docs.select(F.col(doc_id).alias("doc_id"), protected_spans(text).alias("protected"))
    kept = grouped.join(guard, "doc_id").where(~dropped(F.col("type"), F.col("text"), F.col("offsets"), F.col("protected")))
    return kept.select("doc_id", "text", F.col("type").alias("entity_type"), "count", "score", "offsets", "first")


def type_rank(kind) -> Column:
    k = _c(kind)
    return F.when(k == "PERSON", 0).when(k == "ORGANIZATION", 1).when(k == "LOCATION", 2).otherwise(99)


def merge_candidates(found: DataFrame) -> DataFrame:
    """Across documents: text, entity_type and count; the surface of the document with most, then fewest characters, then the first."""
    keyed = found.withColumn("key", strip_all_whitespace("text"))
    merged = keyed.groupBy("key", "entity_type").agg(F.min_by("text", F.struct(-F.col("count"), F.char_length("text"), F.col("doc_id"))).alias("text"), F.sum("count").alias("count"))
    return merged.select("text", "entity_type", "count")


def in_order(candidates: DataFrame) -> DataFrame:
    return candidates.orderBy(type_rank("entity_type"), F.desc("count"), "text")

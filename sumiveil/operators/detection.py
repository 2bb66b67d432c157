"""Detection of candidate spans: patterns, model output, their union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sumiveil.functions import patterns as P
from sumiveil.functions.spans import matches, without_contained

PATTERN_SCORE = 0.8


def email_spans(text) -> Column:
    return matches(text, P.EMAIL)


def phone_spans(text) -> Column:
    return matches(text, P.PHONE)


def postal_spans(text) -> Column:
    return matches(text, P.POSTAL)


def protected_spans(text) -> Column:
    """Places of e-mail addresses, phone numbers and postal codes."""
    return F.concat(email_spans(text), phone_spans(text), postal_spans(text))


def pattern_spans(text) -> Column:
    """Company names in both forms and addresses, by (begin, end); overlaps are kept."""
    kinds = (("ORGANIZATION", P.COMPANY_BEFORE), ("ORGANIZATION", P.COMPANY_AFTER), ("LOCATION", P.ADDRESS))
    made = [_typed(matches(text, p), kind, rank) for rank, (kind, p) in enumerate(kinds)]
    return F.transform(F.array_sort(F.concat(*made)), lambda s: F.struct(s["type"].alias("type"), s["begin"].alias("begin"), s["end"].alias("end"), s["value"].alias("value"), s["score"].alias("score")))


def _typed(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("type"), s["value"].alias("value"), F.lit(PATTERN_SCORE).cast("float").alias("score")))


def group_entities(tokens: DataFrame) -> DataFrame:
    """Consecutive tokens of one and the same label become an entity; ``tokens`` has doc_id, pos, label, begin, end, score.

    The label's part after ``-`` is mapped to an entity type; O and unmapped labels give nothing; the
    score is the mean of the tokens'.
    """
    by_doc = Window.partitionBy("doc_id").orderBy("pos")
    name = F.element_at(F.split("label", "-"), -1)
    types = F.create_map(*[F.lit(x) for kv in P.LABEL_MAP.items() for x in kv])
    marked = tokens.withColumn("name", name).withColumn("new", (F.lag("label").over(by_doc).isNull() | (F.lag("label").over(by_doc) != F.col("label"))).cast("int"))
    islands = marked.withColumn("island", F.sum("new").over(by_doc)).groupBy("doc_id", "island", "name").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.avg("score").cast("float").alias("score"))
    return islands.withColumn("type", F.try_element_at(types, F.col("name"))).where(F.col("type").isNotNull()).select("doc_id", "type", "begin", "end", "score")


def merge_spans(pattern: Column, model: Column) -> Column:
    """Pattern spans, then the model's without repeats and contained ones."""
    return F.concat(pattern, without_contained(model))

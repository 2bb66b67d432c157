"""The whole way: detect, review, mask, check, restore."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumiveil.operators.candidates import document_candidates, in_order, merge_candidates
from sumiveil.operators.detection import merge_spans, pattern_spans
from sumiveil.operators.masking import gate, mask_rows
from sumiveil.operators.providers import reading_terms


def detect(docs: DataFrame, model: Callable[[DataFrame], DataFrame] | None = None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Candidates for review: text, entity_type, count, in order.

    ``model`` adds a column ``model_spans`` (array of type, begin, end, value, score); without one
    only patterns are looked for, and people's names are not found.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    spans = pattern_spans("text")
    found = model(docs).withColumn("spans", merge_spans(spans, F.col("model_spans"))) if model else docs.withColumn("spans", spans)
    return in_order(merge_candidates(document_candidates(found)))


class LeakError(RuntimeError):
    """A masked table still shows what it should not."""


def mask_checked(docs: DataFrame, terms=(), *, reversible: bool = True) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, existing and leaks; mapping).

    ``leaks`` is what the gate still finds, ``existing`` what in the source looked like a placeholder
    before (restoring would put values there).  Texts are given whatever the gate says;
    :func:`exit_status` and :func:`require_clean` decide.
    """
    out, mapping = mask_rows(docs, terms, reversible=reversible)
    return out.withColumn("leaks", gate("text", [t[1] for t in terms if len(t) < 5])), mapping


def exit_status(masked: DataFrame) -> int:
    """0 if no text of a checked table leaks, 3 otherwise."""
    return 0 if masked.where(F.size("leaks") > 0).isEmpty() else 3


def require_clean(masked: DataFrame) -> DataFrame:
    """The table without ``leaks``, or :class:`LeakError` with the number of texts that leak; the message shows no value."""
    n = masked.where(F.size("leaks") > 0).count()
    if n:
        raise LeakError(f"{n} masked texts still show values")
    return masked.drop("leaks")


def with_readings(terms: list[tuple], aliases: DataFrame) -> list[tuple]:
    """Confirmed terms and the readings of their people, which share the names' tokens.

    ``aliases`` has alias and canonical, as :func:`reading_terms` gives them; both lists are of a size that a person has reviewed.
    """
    known = {t[1] for t in terms}
    first = 1 + max((t[0] for t in terms), default=-1)
    rows = aliases.orderBy("canonical", "alias").collect()
    return [*terms, *((first + k, r["alias"], "PERSON", False, r["canonical"]) for k, r in enumerate(rows) if r["alias"] not in known)]


__all__ = ["LeakError", "detect", "exit_status", "mask_checked", "reading_terms", "require_clean", "with_readings"]

"""Masking a stream with a frozen mapping: values without a token are left and reported by the gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumiveil.functions.spans import splice
from sumiveil.operators.masking import gate, mask_hits


def mask_stream(docs: DataFrame, mapping: dict[str, str], terms=(), *, text: str = "text") -> DataFrame:
    """A streaming (or static) frame with masked text and leaks; stateless, so late rows need no watermark."""
    if not mapping:
        return docs.withColumn("leaks", gate(text))
    tokens = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    hits = F.filter(mask_hits(text, terms), lambda h: F.map_contains_key(tokens, h["value"]))
    return docs.withColumn(text, splice(text, hits, lambda h: F.element_at(tokens, h["value"]))).withColumn("leaks", gate(text))

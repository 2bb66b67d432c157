"""Quality figures: coverage of expected entities, false masks, round trips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sumiveil.functions.text import _c, normalise_entity, strip_spaces


def covered(expected, found: Column) -> Column:
    """Whether an expected entity and one of the found contain one another, normalised."""
    g = normalise_entity(expected)
    return (g != "") & F.exists(found, lambda d: (normalise_entity(d) != "") & (F.contains(normalise_entity(d), g) | F.contains(g, normalise_entity(d))))


def covered_strict(expected, found: Column) -> Column:
    """Whether one of the found contains the whole expected entity."""
    g = normalise_entity(expected)
    return (g != "") & F.exists(found, lambda d: F.contains(normalise_entity(d), g))


def occurrences(text, needle) -> Column:
    t, n = _c(text), _c(needle)
    return F.when(n == "", 0).otherwise(((F.char_length(t) - F.char_length(F.replace(t, n, F.lit("")))) / F.greatest(F.char_length(n), F.lit(1))).cast("int"))


def false_mask(text, masked, needle) -> Column:
    return (occurrences(text, needle) > 0) & (occurrences(masked, needle) < occurrences(text, needle))


def round_trip(text, restored) -> Column:
    t, r = _c(text), _c(restored)
    return F.when(t == r, "exact").when(strip_spaces(t) == strip_spaces(r), "whitespace").otherwise("broken")

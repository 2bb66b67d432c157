"""Matches with code-point offsets, and what is done with arrays of them.

A span is struct(begin, end, ...).  Offsets come from the lengths of the pieces between matches, so
no Python and no UTF-16 position is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sumiveil.functions.text import _c, let


def matches(text, pattern: str, **extra) -> Column:
    """Array of struct(begin, end, value, *extra): all matches of a pattern that can't match nothing."""
    t = F.coalesce(_c(text), F.lit(""))
    names = ["begin", "end", "value", *extra]
    kind = "array<struct<at:int,out:array<struct<begin:int,end:int,value:string>>>>"

    def build(pieces):
        def step(s, x):
            begin = (s["at"] + F.char_length(x["piece"])).cast("int")
            end = (begin + F.char_length(x["match"])).cast("int")
            found = F.struct(begin.alias("begin"), end.alias("end"), x["match"].alias("value"))
            return F.struct(end.alias("at"), F.concat(s["out"], F.array(found)).alias("out"))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(kind[len("array<struct<at:int,out:") : -2]).alias("out"))
        return F.aggregate(F.filter(pieces, lambda x: x["match"].isNotNull()), start, step, lambda s: s["out"])

    pieces = F.arrays_zip(F.split(t, pattern).alias("piece"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("match"))
    out = F.when(t.rlike(pattern), let(pieces, build)).otherwise(F.array().cast("array<struct<begin:int,end:int,value:string>>"))
    if not extra:
        return out
    return F.transform(out, lambda s: F.struct(*[s[n].alias(n) if n in ("begin", "end", "value") else F.lit(extra[n]).alias(n) for n in names]))


def literal_hits(text, term) -> Column:
    """Array of struct(begin, end): places of a term, left to right, not overlapping."""
    t, w = F.coalesce(_c(text), F.lit("")), _c(term)
    n = F.char_length(w)

    def step(s, piece):
        begin = (s["at"] + F.char_length(piece)).cast("int")
        return F.struct((begin + n).cast("int").alias("at"), F.concat(s["out"], F.array(F.struct(begin.alias("begin"), (begin + n).cast("int").alias("end")))).alias("out"))

    pieces = F.split(t, F.concat(F.lit("\\Q"), w, F.lit("\\E")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("out"))
    return F.when(F.contains(t, w) & (n > 0), F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), start, step, lambda s: s["out"])).otherwise(F.array().cast("array<struct<begin:int,end:int>>"))


def overlap(a: Column, b: Column) -> Column:
    return (a["begin"] < b["end"]) & (a["end"] > b["begin"])


def first_taken(spans: Column, kind: str) -> Column:
    """The spans that don't overlap one taken before them, in the array's order; sorted by place."""
    taken = F.aggregate(spans, F.array().cast(f"array<{kind}>"), lambda acc, s: F.when(F.exists(acc, lambda t: overlap(t, s)), acc).otherwise(F.concat(acc, F.array(s))))
    return F.array_sort(taken, lambda a, b: F.when(a["begin"] < b["begin"], -1).when(a["begin"] > b["begin"], 1).otherwise(0))


def without_contained(spans: Column) -> Column:
    """Without exact repeats (the first stays) and spans inside another of their type; order kept."""
    def keep(x, i):
        def beats(y, j):
            same = (y["type"] == x["type"]) & (y["begin"] <= x["begin"]) & (y["end"] >= x["end"])
            equal = (y["begin"] == x["begin"]) & (y["end"] == x["end"])
            return same & (~equal | (j < i))

        return ~F.exists(F.transform(spans, beats), lambda b: b)

    return F.filter(spans, keep)


def splice(text, spans: Column, to) -> Column:
    """The text with ascending, disjoint spans replaced by ``to(span)``."""
    t = _c(text)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda s, x: F.struct(F.concat(s["out"], F.substring(t, s["at"] + 1, x["begin"] - s["at"]), to(x)).alias("out"), x["end"].alias("at"))
    return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(t, s["at"] + 1, F.char_length(t) - s["at"])))

"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

All of it is DataFrame functions.  Words are runs of letters and digits, lower-cased; a shingle is
five words.  For a template of m shingles the windows are m shingles long and start every m/8, so
some window holds a copy but for a sixteenth at either side; with at least 0.8 of the template's
shingles there, its resemblance to the template is 0.6 or more, and with 24 bands of 2 rows the two
share a band with a probability of over 0.9999.

A window can only share a band with a template if it holds the template's minimal shingles (the
anchors), so windows are laid only where an anchor stands: this leaves out no collision.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sumiveil.llm.common import let, once, read_table

SHINGLE = 5
BANDS = 24
ROWS = 2
LEAST = 0.8

# Public license texts and notices.
TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "MIT short notice": "Licensed under the MIT License.",
    "MIT warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "BSD-3-Clause notice": "Licensed under the BSD 3-Clause License.",
    "Apache-2.0 grant": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _chain(values, seed: int = 42) -> int:
    """What the engine's ``xxhash64`` gives for several columns."""
    for v in values:
        seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else v.to_bytes(8, "little", signed=True), seed)
    return _signed(seed)


def template_shingles(text: str) -> list[int]:
    """Distinct shingle hashes of a template, in order."""
    w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    return list(dict.fromkeys(_chain(x.encode() for x in w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)))


def _min_hashes(shingles: list[int]) -> list[tuple[int, int]]:
    """Per hash function, the least hash and the shingle that has it."""
    return [min((_chain([s, k]), s) for s in shingles) for k in range(BANDS * ROWS)]


def shingle_hashes(text: Column) -> Column:
    """The hash of each run of five words, as an array."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    runs = lambda w: F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, SHINGLE)]))
    return let(words, lambda w: F.slice(runs(w), F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(0))))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, *, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """doc_id, license, containment (of the template's shingles in the text's window) and first_word, for every template found.

    Null and empty texts and those of under five words hold no template; a template of under five
    words is refused.  Rows that repeat doc_id and text are one document; the best place of a
    template in a document counts, the earlier on a tie.  An empty table gives no rows; no other
    column is read.
    """
    spark = docs.sparkSession
    known = {name: template_shingles(t) for name, t in (templates or TEMPLATES).items()}
    if bad := [name for name, s in known.items() if not s]:
        raise ValueError(f"templates of under {SHINGLE} words: {bad}")
    minima = {name: _min_hashes(s) for name, s in known.items()}
    anchors = sorted({s for m in minima.values() for _, s in m})
    lengths = sorted({len(s) for s in known.values()})

    docs = docs.select(F.col(doc_id).alias("doc_id"), once(shingle_hashes(F.col(text))).alias("s"))
    found = docs.withColumn("at", F.filter(F.transform("s", lambda h, i: F.when(h.isin(anchors), i)), lambda i: i.isNotNull())).where(F.size("at") > 0)

    def starts(m: int) -> Column:
        """Starts on the grid of the windows of m shingles that hold an anchor."""
        step = max(1, m // 8)
        grid = F.transform("at", lambda p: F.transform(F.sequence(F.floor(F.greatest(p - (m - 1), F.lit(0)) / step), F.floor(p / step)), lambda g: (g * step).cast("int")))
        return F.transform(F.array_distinct(F.flatten(grid)), lambda g: F.struct(F.lit(m).alias("m"), g.alias("start")))

    # a window goes on with its neighbourhood only, so a long text isn't copied into each of its windows
    step = F.greatest(F.lit(1), F.floor(F.col("x.m") / 8)).cast("int")
    begin = F.greatest(F.col("x.start") - step, F.lit(0))
    windows = found.select("doc_id", F.xxhash64("s").alias("key"), "s", F.explode(F.flatten(F.array(*map(starts, lengths)))).alias("x")).select("doc_id", "key", "x.m", "x.start", begin.alias("begin"), F.slice("s", begin + 1, F.col("x.m") + 2 * step).alias("near"))
    win = F.slice("near", F.col("start") - F.col("begin") + 1, F.col("m"))
    mins = let(win, lambda w: F.transform(F.sequence(F.lit(0), F.lit(BANDS * ROWS - 1)), lambda k: F.array_min(F.transform(w, lambda h: F.xxhash64(h, k.cast("long"))))))
    bands = F.array(*[F.xxhash64(*[F.get("mins", F.lit(b * ROWS + r)) for r in range(ROWS)]) for b in range(BANDS)])
    probes = windows.withColumn("mins", mins).select("doc_id", "key", "m", "start", "begin", "near", F.posexplode(bands).alias("band", "band_key"))

    rows = ", ".join(f"({len(known[name])}, {b}, {_chain([m[b * ROWS + r][0] for r in range(ROWS)])}L, '{name}', array({', '.join(f'{s}L' for s in known[name])}))" for name, m in minima.items() for b in range(BANDS))
    table = spark.sql(f"SELECT * FROM VALUES {rows} AS t(m, band, band_key, license, template)".replace("-9223372036854775808L", "long('-9223372036854775808')"))
    met = probes.join(F.broadcast(table), ["m", "band", "band_key"])

    share = F.size(F.array_intersect("template", "near")) / F.size("template")
    first = F.array_min(F.filter(F.transform("near", lambda h, i: F.when(F.array_contains("template", h), i + F.col("begin"))), lambda i: i.isNotNull()))
    checked = met.dropDuplicates(["doc_id", "key", "m", "start", "license"]).withColumn("containment", share).where(F.col("containment") >= least).withColumn("first_word", first)
    return checked.groupBy("doc_id", "key", "license").agg(F.max("containment").alias("containment"), F.min_by("first_word", F.struct(-F.col("containment"), F.col("first_word"))).cast("long").alias("first_word")).drop("key")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))

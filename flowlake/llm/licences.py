"""Licence scans: TF-IDF cosine of lines and whole files to templates, then inheritance along paths.

A template's words are weighed by how rare they are in the corpus.  A file's own licence is the
template closest to one of its lines (headers, notices), to a run of its words as long as the
template, whatever lines and comment signs it goes over, or to its whole text.  A file is a
licence file if it is named like one or its whole text is a licence; its licence holds for its
directory, and a file without a licence of its own takes that of the nearest directory above it.
"""

from __future__ import annotations

import re
from math import log
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.llm.common import stored

_SPDX = ("Apache-2.0", "MIT", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", ("BSD", "BSD-3-Clause"), ("BSD", "BSD-2-Clause"),
         "ISC", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "Unlicense")
_FULL = tuple((f.stem, f.read_text(encoding="utf-8")) for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")))
#: Notices by which licences are declared, and the openings of licence files.  Then the headers
#: of files, the SPDX lines (the name twice, so that the line of another licence stays far) and the full texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Licensed under the BSD License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    *((x, f"SPDX-License-Identifier: {x} {x}") if isinstance(x, str) else (x[0], f"SPDX-License-Identifier: {x[1]} {x[1]}") for x in _SPDX),
    *_FULL,
)
#: Least cosine of a declaration.
LEAST = 0.75
#: Names of licence files.
FILE_NAME = r"(?i)^(un)?licen[sc]e([._-].*)?$|^copying([._-].*)?$"
_IN_WORD = r"A-Za-z0-9\x{80}-\x{10FFFF}"
_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: str) -> list[str]:
    return [w for w in re.split(_GAPS, text.lower()) if w]


def term_list(text: Column) -> Column:
    """Lower-case words of letters and digits; all other ASCII characters separate them."""
    return F.array_remove(F.split(F.lower(text), _GAPS), "")


def document_counts(texts: DataFrame) -> DataFrame:
    """``(term, n)``: in how many texts each word of the corpus is; the empty word has the number of texts."""
    here = F.array_append(F.array_distinct(term_list(F.coalesce("text", F.lit("")))), F.lit(""))
    return texts.select(F.explode(here).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def term_weights(texts: DataFrame, templates=TEMPLATES, counts: DataFrame | None = None) -> dict[str, float]:
    """Inverse document frequency over all texts of every word that a template has; the empty word's is the largest."""
    known = sorted({w for _, t in templates for w in _words(t)})
    counted = (document_counts(texts) if counts is None else counts).where(F.col("term").isin(["", *known]))
    found = {r["term"]: r["n"] for r in counted.collect()}  # one row per template word at most, and the total
    return {w: log((1 + found.get("", 0)) / (1 + found.get(w, 0))) + 1 for w in known} | {"": log(1 + found.get("", 0)) + 1}


def anchors(weights: dict[str, float], templates=TEMPLATES, least: float = LEAST) -> list[str]:
    """Words one of which every text as close as ``least`` to a template must have.

    Without its anchors a template keeps too little weight: even a text made of all its other
    words would stay below the least cosine.
    """
    out: set[str] = set()
    for _, text in templates:
        words = _words(text)
        worth = {w: (words.count(w) * weights[w]) ** 2 for w in set(words)}
        total = sum(worth.values())
        for w in sorted(worth, key=lambda w: (w not in out, -worth[w], w)):
            if sum(x for v, x in worth.items() if v not in out) < (least * 0.999) ** 2 * total:
                break
            out.add(w)
    return sorted(out)


def _template_table(spark: SparkSession, weights: dict[str, float], templates) -> DataFrame:
    """``(licence, template, term, worth)``: unit vectors."""
    rows = []
    for i, (name, text) in enumerate(templates):
        words = _words(text)
        worth = {w: words.count(w) * weights[w] for w in set(words)}
        norm = sum(x * x for x in worth.values()) ** 0.5
        rows += [(name, i, w, x / norm) for w, x in sorted(worth.items())]
    return spark.createDataFrame(rows, "licence string, template int, term string, worth double")


def _runs(some: DataFrame, table: DataFrame, weights: dict[str, float], templates, least: float) -> DataFrame:
    """``(path, own, unit, terms)``: runs of words as long as a template, around its anchors, slid over whole texts.

    A run begins at every eighth of its length, so that the one nearest to a declaration has at least
    15 of 16 of its words.  ``own`` is the template; a text whose words keep too little of a
    template's weight for ``least`` has no runs of it.  A run longer than the text is the whole text.
    """
    spark = some.sparkSession
    sizes = [(i, n := len(_words(t)), max(1, n // 8), anchors(weights, [(name, t)], least)) for i, (name, t) in enumerate(templates)]
    plan = spark.createDataFrame(sizes, "own int, size int, step int, anchors array<string>")  # one row per template
    near = (some.select("path", F.explode(F.array_distinct("words")).alias("term")).join(F.broadcast(table), "term")
            .groupBy("path", F.col("template").alias("own")).agg(F.sum(F.col("worth") * F.col("worth")).alias("most"))
            .where(F.col("most") >= (least * 0.999) ** 2).select("path", "own"))
    rows = some.join(near, "path").join(F.broadcast(plan), "own").where("size < size(words)")
    at = "filter(sequence(0, size(words) - 1), i -> array_contains(anchors, words[i]))"
    begins = (f"array_distinct(flatten(transform({at}, p -> transform("
              "sequence(cast(greatest(0, ceil((p - size + 1) / step)) as int), cast(floor(p / step) as int)), k -> k * step))))")
    runs = F.explode(F.expr(f"transform({begins}, b -> struct(b + 1 as unit, slice(words, b + 1, size) as terms))")).alias("run")
    return rows.select("path", "own", runs).select("path", "own", "run.*")


def declarations(files: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """``(path, licence, score, whole)``: the closest template of each file that reaches ``least``.

    ``whole`` tells that the whole text, not only a part of it, is that close.  All words have the
    weight of their document frequency in ``files``.  Equal scores go to the earlier template.
    """
    spark = files.sparkSession
    files = files.select("path", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = stored(document_counts(files), "frequencies")
    weights = term_weights(files.select("text"), templates, counts)
    pattern = rf"(?i)(?<![{_IN_WORD}])(?:{'|'.join(anchors(weights, templates, least))})(?![{_IN_WORD}])"
    some = stored(files.where(F.col("text").rlike(pattern)).withColumn("words", term_list(F.col("text"))), "anchored")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(pattern))
    units = F.posexplode(F.concat(F.array("text"), lines)).alias("unit", "part")
    parts = some.select("path", units).select("path", F.lit(-1).alias("own"), "unit", term_list(F.col("part")).alias("terms"))
    table = _template_table(spark, weights, templates)
    terms = (parts.unionByName(_runs(some, table, weights, templates, least))
             .select("path", "own", "unit", F.explode("terms").alias("term"))
             .groupBy("path", "own", "unit", "term").agg(F.count("*").alias("n")))
    total = float(weights[""] - 1)  # log(1 + number of texts)
    idf = counts.where("term <> ''").select("term", (F.lit(total) - F.log(F.col("n") + 1.0) + 1.0).alias("idf"))
    weighed = stored(terms.join(idf, "term", "left").select(
        "path", "own", "unit", "term", (F.col("n") * F.coalesce("idf", F.lit(weights[""]))).alias("w")), "terms")
    unit = ["path", "own", "unit"]
    norms = weighed.groupBy(unit).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = (weighed.join(F.broadcast(table), "term").where("own = -1 or own = template").groupBy(*unit, "licence", "template")
            .agg(F.sum(F.col("w") * F.col("worth")).alias("dot")))
    scored = dots.join(norms, unit).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= least)
    best = F.max(F.struct("score", (-F.col("template")).alias("t"), "licence")).alias("best")
    found = scored.groupBy("path").agg(best, F.max((F.col("own") == -1) & (F.col("unit") == 0)).alias("whole"))
    return found.select("path", "best.licence", "best.score", "whole")


def parent(path: Column) -> Column:
    """The directory of a path; the root is the empty path."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """``(path, licence, score, how, licence_dir)`` of every file of ``(path, text)``.

    ``how`` is ``own``, ``inherited`` or null.  Paths are unique and separated by ``/``; a null
    path is the root's.  Null and empty texts declare nothing, an empty table gives no rows.  Of
    several licence files in a directory the highest score holds, then the smaller path.
    """
    files = files.select(F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), "text")
    own = stored(declarations(files, templates, least), "licences")
    named = F.element_at(F.split("path", "/"), -1).rlike(FILE_NAME)
    holds = (own.where(F.col("whole") | named).withColumn("dir", parent(F.col("path")))
             .groupBy("dir").agg(F.min_by(F.struct("licence", "score"), F.struct((-F.col("score")).alias("s"), "path")).alias("has")))
    marked = files.select("path").join(own.select("path", "licence", "score"), "path", "left")
    bare = marked.where(F.col("licence").isNull()).select(parent(F.col("path")).alias("dir")).distinct()
    # every directory with its ancestors, itself first: "a/b" gives "a/b", "a" and ""
    steps = F.split("dir", "/")
    above = F.explode(F.concat(F.transform(F.sequence(F.size(steps), F.lit(1), F.lit(-1)),
                                           lambda k: F.array_join(F.slice(steps, 1, k), "/")), F.array(F.lit("")))).alias("up")
    nearest = (bare.select("dir", above).join(holds.withColumnRenamed("dir", "up"), "up")
               .groupBy("dir").agg(F.max_by(F.struct("up", "has"), F.length("up")).alias("from")))
    rows = marked.withColumn("dir", parent(F.col("path"))).join(nearest, "dir", "left")
    inherited = F.col("licence").isNull() & F.col("from").isNotNull()
    return rows.select(
        "path", F.coalesce("licence", "from.has.licence").alias("licence"), F.coalesce("score", "from.has.score").alias("score"),
        F.when(F.col("licence").isNotNull(), "own").when(inherited, "inherited").alias("how"),
        F.when(inherited, F.col("from.up")).alias("licence_dir"))

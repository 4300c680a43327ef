"""License scan: normalised text against licence templates by Dice coefficient over word bigrams.

Units are the lines of a text and the whole text. Words are maximal runs of a-z and 0-9 after A-Z are lower-cased; with
a and b bigrams in unit and template, and c in common (as multisets), Dice is 2c / (a + b). A pair can only reach t if
t / (2 - t) <= a / b <= (2 - t) / t, and only with c >= t (a + b) / 2. So of any b - c + 1 bigrams of a template a match
must hold one: those with the longest words are chosen, and a unit that has none of their longest words (or, where these
are short, none of the pairs) is dropped by plain substring tests. Of the rest, units that no template's bounds admit are dropped before any bigram is made, pairs
outside their bounds before they are counted. The bigrams left meet the templates' bigrams in a broadcast join (the
template table is a parameter of fixed size).

Defined cases: null texts, and units under two words, match nothing. Repeated rows give repeated results. Of equal
scores the smallest template name wins, whole texts before lines, then the first line. An empty table gives an empty
result. Columns of docs other than id and text are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Notices and texts of common licences: name, words in natural order.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0 header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0 header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def hints(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> tuple[list[str], list[str]]:
    """Words, and patterns of word pairs with short words, one of which is in every unit that reaches the threshold with some template."""
    long, short = set(), set()
    for _, text in templates:
        w = _words(text)
        b = len(w) - 1
        a = math.ceil(b * threshold / (2 - threshold) - 1e-9)
        common = max(1, math.ceil(threshold * (a + b) / 2 - 1e-9))
        pairs = sorted(zip(w, w[1:]), key=lambda p: (-max(map(len, p)), p))
        for p in pairs[: b - common + 1]:
            word = max(p, key=len)
            long.add(word) if len(word) >= 5 else short.add("[^a-z0-9]+".join(p))
    return sorted(x for x in long if not any(y != x and y in x for y in long)), sorted(short)


def words(lower: Column) -> Column:
    return F.split(F.regexp_replace(lower, r"^[^a-z0-9]+|[^a-z0-9]+$", ""), "[^a-z0-9]+")


def template_bigrams(spark: SparkSession, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(license, b, w1, w2, n): bigrams of each template with their counts, and how many it has."""
    rows = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in templates])
    base = spark.range(1).select(F.inline(rows)).select("license", words(F.translate("text", _UPPER, _LOWER)).alias("w"))
    pairs = base.select("license", (F.size("w") - 1).alias("b"), _zipped("w"))
    return pairs.groupBy("license", "b", "w1", "w2").agg(F.count(F.lit(1)).alias("n"))


def _zipped(w: str) -> Column:
    """Generates (w1, w2): neighbouring words; arrays of one word give none."""
    return F.expr(f"inline(slice(arrays_zip({w}, slice({w}, 2, size({w}))), 1, size({w}) - 1))").alias("w1", "w2")


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, dice, line, n_lines): per row with a match its best template, the best line (-1: the whole text), matching lines."""
    least, most = threshold / (2 - threshold), (2 - threshold) / threshold
    sizes = [len(_words(t)) - 1 for _, t in templates]
    admitted = [a for a in range(1, int(max(sizes) * most) + 2) if any(b * least - 1e-9 <= a <= b * most + 1e-9 for b in sizes)]
    body = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), _UPPER, _LOWER)
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.split(body, "\n").alias("lines"))
    # Line -1 is the whole text, if it has several lines.
    all_of = F.when(F.size("lines") > 1, F.array(F.array_join("lines", "\n"))).otherwise(F.array().cast("array<string>"))
    units = base.select("row", "doc_id", F.posexplode(F.concat("lines", all_of)).alias("line", "unit"), F.size("lines").alias("n"))
    units = units.withColumn("line", F.when((F.col("n") > 1) & (F.col("line") == F.col("n")), -1).otherwise(F.col("line")))
    hint = F.lit(False)
    long, short = hints(templates, threshold)
    for w in long:
        hint = hint | F.contains("unit", F.lit(w))
    for p in short:
        hint = hint | F.rlike("unit", F.lit(p))
    units = units.where(hint).where(F.regexp_count("unit", F.lit("[a-z0-9]+")).isin([a + 1 for a in admitted]))
    units = units.withColumn("w", words(F.col("unit"))).withColumn("a", F.size("w") - 1)
    pairs = units.select("row", "doc_id", "line", "a", _zipped("w"))
    met = pairs.join(F.broadcast(template_bigrams(docs.sparkSession, templates)), ["w1", "w2"]).where((F.col("a") >= F.col("b") * least - 1e-9) & (F.col("a") <= F.col("b") * most + 1e-9))
    unit = ["row", "doc_id", "line", "a", "license", "b"]
    common = met.groupBy(*unit, "w1", "w2", "n").agg(F.count(F.lit(1)).alias("m")).groupBy(*unit).agg(F.sum(F.least("m", "n")).alias("c"))
    dice = common.withColumn("dice", 2 * F.col("c") / (F.col("a") + F.col("b"))).where(F.col("dice") >= threshold)
    best = dice.groupBy("row", "doc_id").agg(
        F.min(F.struct((-F.col("dice")).alias("d"), "license", "line")).alias("best"), F.countDistinct(F.when(F.col("line") >= 0, F.col("line"))).alias("n_lines")
    )
    return best.select("doc_id", F.col("best.license").alias("license"), (-F.col("best.d")).alias("dice"), F.col("best.line").alias("line"), "n_lines")

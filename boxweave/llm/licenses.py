"""Licence scans: normalised text against licence templates by Dice coefficient.

Texts and templates are lower-cased (A-Z), cut into runs of ASCII letters and
digits, and compared as sets of word bigrams.  The units compared are the lines
of a text, its paragraphs (between blank lines) and the whole text, so that a notice is
found inside a longer document as well as alone.  Sizes bound the coefficient: a
template whose set is too large or too small for a unit is never counted
against it.  A unit at the threshold lacks so few of a template's bigrams that it
must have one of a few telling words (``required_words``); texts and units without
any are left out before they are cut into words.  Bigrams meet those of the templates in one hash join; the templates
are the fixed list TEMPLATES (or a list given instead), whose bigrams are
broadcast only while there are at most MAX_BROADCAST of them.

DataFrame functions only.  A null text, and a unit or a template of fewer than two
words, match nothing; a unit that two templates match equally well goes to the first
of them in the list; equal units of one text count once, at their first place.  Each row
is scanned on its own: repeated rows give repeated results, rows that share a doc_id
or have none each theirs.  Empty tables and an empty list of templates give no rows;
other columns of the input are not read.
"""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.8
MAX_BROADCAST = 100_000
#: Telling words are looked for as one pattern only while there are so many at most.
MAX_WORDS = 500

# Short notices and first paragraphs of public licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]

# Words too common to tell anything; only the speed of a scan depends on them.
COMMON = frozenset("a all an and any as be by for from general is it may of on or source subject that the this to under version with work you".split())

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit("([a-z0-9]+)"), F.lit(0))


def bigrams(w: Column) -> Column:
    """The distinct pairs of neighbouring words."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b)))


def templates(spark: SparkSession, given: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each bigram of a template: template, license_id, gram, and the
    sizes that a unit must have to reach the threshold."""
    rows = [(k, i, t) for k, (i, t) in enumerate(given if given is not None else TEMPLATES)]
    df = spark.createDataFrame(rows, "template int, license_id string, text string").withColumn("grams", bigrams(words(F.col("text"))))
    size = F.size("grams")
    low, high = F.ceil(size * F.lit(threshold / (2 - threshold)) - F.lit(1e-9)), F.floor(size * F.lit((2 - threshold) / threshold) + F.lit(1e-9))
    return df.select("template", "license_id", size.alias("size"), low.alias("low"), high.alias("high"), F.explode("grams").alias("gram"))


def _plain_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.translate(str.maketrans(_UPPER, _LOWER)))


def required_words(given: list[tuple[str, str]], threshold: float = THRESHOLD) -> set[str]:
    """Words of which a unit has at least one if a template matches it.

    With b bigrams, a template shares at least threshold * (low + b) / 2 of them
    with a unit that it matches; words that touch more bigrams than may then be
    lacking can't all be absent.  Long words that touch many are taken first, and
    common ones last.
    """
    out: set[str] = set()
    for _, text in given:
        w = _plain_words(text)
        left = set(zip(w, w[1:], strict=False))
        b = len(left)
        if not b:
            continue
        low = ceil(b * threshold / (2 - threshold) - 1e-9)
        need = b - ceil(threshold * (low + b) / 2 - 1e-9) + 1
        touched = 0
        while touched < need:
            best = max(sorted({x for pair in left for x in pair}), key=lambda x: min(sum(x in p for p in left), need - touched) * len(x) ** 2 / (1000 if x in COMMON else 1))
            hit = {p for p in left if best in p}
            touched, left = touched + len(hit), left - hit
            out.add(best)
    return out


def telling(text: Column, needed: set[str]) -> Column:
    return text.rlike(f"(?i)(?<![A-Za-z0-9])(?:{'|'.join(sorted(needed))})(?![A-Za-z0-9])")


def units(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """uid (a number of the row), doc_id, unit (its place in the list lines,
    paragraphs, whole) and unit_text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    parts = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, "\n[ \t\r]*\n"), F.array(text)))
    return docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", parts.alias("parts")).select("uid", "doc_id", F.posexplode("parts").alias("unit", "unit_text"))


def scan(docs: DataFrame, *, given: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """doc_id, unit, license_id, dice of each unit that a template matches; the
    best template of each unit."""
    spark = docs.sparkSession
    grams = templates(spark, given, threshold)
    bounds = grams.agg(F.min("low"), F.max("high"), F.count("*")).first()
    if not bounds[2]:
        nothing = {"unit": "int", "license_id": "string", "dice": "double"}
        return docs.limit(0).select("doc_id", *[F.lit(None).cast(t).alias(k) for k, t in nothing.items()])
    needed = required_words(given if given is not None else TEMPLATES, threshold)
    if len(needed) <= MAX_WORDS:
        made = units(docs.where(telling(F.col(text_col).cast("string"), needed)), text_col).where(telling(F.col("unit_text"), needed))
    else:
        made = units(docs, text_col)
    made = made.withColumn("w", words(F.col("unit_text")))
    # repeats only make a set smaller, so few words rule a unit out at once
    made = made.where(F.size("w") > F.lit(int(bounds[0]))).withColumn("g", bigrams(F.col("w")))
    made = made.where(F.size("g").between(int(bounds[0]), int(bounds[1])))
    rows = made.select("uid", "doc_id", "unit", F.size("g").alias("n"), F.explode("g").alias("gram"))
    sides = F.broadcast(grams) if bounds[2] <= MAX_BROADCAST else grams
    met = rows.join(sides, "gram").where(F.col("n").between(F.col("low"), F.col("high")))
    counted = met.groupBy("uid", "doc_id", "unit", "template", "license_id", "n", "size").agg(F.count("*").alias("shared"))
    dice = (F.col("shared") * 2) / (F.col("n") + F.col("size"))
    passed = counted.withColumn("dice", dice.cast("double")).where(F.col("dice") >= threshold)
    best = passed.groupBy("uid", "doc_id", "unit").agg(F.max_by(F.struct("license_id", "dice"), F.struct("dice", -F.col("template"))).alias("b"))
    return best.select("doc_id", "unit", "b.license_id", "b.dice")

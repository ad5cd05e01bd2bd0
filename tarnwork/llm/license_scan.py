"""License scans: MinHash bands over overlapping text windows, then exact containment.

Windows come in size classes of 16, 8, 4, 2 and 1 shingles.  A template has the windows of the
largest class that fits it, at every place; a text has windows of every class, which overlap by
all but their stride.  Each of ``BANDS`` bands is one MinHash of a window; windows of one class
that agree in a band meet.  A band fails a pair of windows of Jaccard similarity J with
probability 1 - J, so all fail with (1 - J) ** BANDS, and what counts is the best window:

- a notice that is there whole has a window with J = 1 in the classes 1, 2 and 4 (stride 1) and in
  the others from one stride more than the class on: it is always retrieved.  One as long as the
  class is off by half a stride at most: J >= 7/9 (class 8) or 14/18 (class 16);
- a notice of which ``CONTAINED`` is left has a template window that is left in at least that
  share; off by half a stride that is J >= 10/22, missed with probability 2e-5.

A band's value is the hash of one of the window's shingles, so a window without any shingle of
a template cannot meet one.  Shingles are looked up in a bitmap of ``BITS`` bits with two
places each, which may let others through but stops none; only texts that pass are kept, and
only windows at such places are hashed, which changes no result.  The windows that meet a
template are verified in blocks of the template's length: ``CONTAINED`` of the template's
distinct five-word shingles must be in the text from one length before the block to one
after it, so the work is in proportion to the text.

Edge cases: null, empty and shorter texts match nothing; rows that repeat, ids included, are
scanned one by one; null ids are kept; an empty table or no templates give an empty result;
ties between windows go to the first; a text of any length is scanned whole; other columns are
dropped at once, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm.common import SPACE_RUN, SPACES, scratch, stored

GRAM = 5
#: Sizes of windows in shingles, the largest first, with the strides of a text's windows.
CLASSES = ((16, 4), (8, 2), (4, 1), (2, 1), (1, 1))
BANDS = 18
#: Size of the bitmap of template shingles, whatever their number.
BITS = 1 << 20
CONTAINED = 0.75
IGNORED = ".,;:()\"'"
#: Public licence notices.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "apache-2.0-disclaimer": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "mit-line": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "agpl-notice": "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced",
}


def shingles(text: str) -> Column:
    """Hashes of the normalised text's word shingles, in order."""
    plain = F.btrim(F.translate(F.lower(F.coalesce(F.col(text), F.lit(""))), IGNORED, ""), F.lit(SPACES))
    words = F.when(plain == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(plain, SPACE_RUN), lambda w: F.xxhash64(w)))

    def grams(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - GRAM), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(GRAM))))
        return F.when(F.size(w) >= GRAM, each).otherwise(F.array().cast("array<bigint>"))

    # a transform of one element binds the words, so that they are split once for each text
    return F.get(F.transform(F.array(words), grams), F.lit(0))


def bands_of(part: Column) -> Column:
    """The MinHash of each band of a window, salted with the band's number."""
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda b: F.array_min(F.transform(part, lambda x: F.xxhash64(x, b))))


def places(x: Column) -> tuple[Column, Column]:
    """The two places of a shingle in the bitmap."""
    return F.pmod(x, F.lit(BITS)), F.pmod(F.shiftright(x, 24), F.lit(BITS))


def bitmap(known: DataFrame) -> Column:
    """The places of all template shingles as a literal of BITS / 64 numbers."""
    at = known.select(F.explode("_sequence").alias("x")).select(F.explode(F.array(*places(F.col("x")))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    out = [0] * (BITS // 64)
    for word, bits in words.collect():  # one row a word at most
        out[word] = bits
    return F.split(F.lit(",".join(map(str, out))), ",").cast("array<bigint>")


def known_places(shingles: str, bits: Column) -> Column:
    """The places of the shingles that the bitmap lets through."""

    def there(at: Column) -> Column:
        word = F.get(bits, F.shiftright(at, 6).cast("int"))
        return F.call_function("shiftright", word, at.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1

    marked = F.transform(shingles, lambda x, i: F.when(reduce(lambda a, b: a & b, map(there, places(x))), i))
    return F.filter(marked, lambda i: i.isNotNull())


def windows_at(marks: str) -> Column:
    """Every window of every class that holds one of the marked places, as 32 * start + size."""

    def of_class(i: Column, size: int, stride: int) -> Column:
        first = F.ceil(F.greatest(i - size + 1, F.lit(0)) / stride).cast("int") * stride
        return F.transform(F.sequence(first, F.floor(i / stride).cast("int") * stride, F.lit(stride)), lambda at: at * 32 + size)

    def around(i: Column) -> Column:
        return F.flatten(F.array(*(of_class(i, *x) for x in CLASSES)))

    return F.array_distinct(F.flatten(F.transform(marks, around)))


def template_windows(known: DataFrame) -> DataFrame:
    """(license, size, value): the bands of every window of each template, of its size class."""
    n = F.size("_sequence")
    size = F.coalesce(*(F.when(n >= size, F.lit(size)) for size, _ in CLASSES))
    starts = F.sequence(F.lit(0), n - F.col("size"))
    bands = F.flatten(F.transform(starts, lambda at: bands_of(F.slice("_sequence", at + 1, F.col("size")))))
    return known.withColumn("size", size).select("license", "size", F.explode(F.array_distinct(bands)).alias("value"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(id, license, containment, window): each document's licences and the first window that found them."""
    spark: SparkSession = docs.sparkSession
    with scratch() as keep:
        known = spark.createDataFrame(list(templates.items()), "license string, text string").select("license", shingles("text").alias("_sequence"))
        known = stored(known.where(F.size("_sequence") > 0), "license-templates")
        told = stored(template_windows(known), "license-windows")
        rows = docs.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), shingles(text_col).alias("_shingles"))
        rows = rows.withColumn("_marks", known_places("_shingles", bitmap(known)))
        rows = stored(rows.where(F.size("_marks") > 0), "license-texts")  # numbers are fixed once written
        size, start = F.col("w.code") % 32, F.floor(F.col("w.code") / 32).cast("int")
        part = lambda code: F.slice("_shingles", F.floor(code / 32).cast("int") + 1, code % 32)
        windows = F.transform(windows_at("_marks"), lambda code: F.struct(code.alias("code"), F.array_distinct(bands_of(part(code))).alias("bands")))
        hit = rows.select("_row", F.explode(windows).alias("w")).select("_row", size.alias("size"), start.alias("window"), F.explode("w.bands").alias("value"))
        known = known.select("license", F.array_distinct("_sequence").alias("_template")).withColumn("reach", F.size("_template"))
        met = hit.join(told, ["size", "value"]).join(known.select("license", "reach"), "license")
        block = F.floor(F.col("window") / F.col("reach")).cast("int")
        met = stored(met.groupBy("_row", "license", block.alias("block")).agg(F.min("window").alias("window")), "license-met")
        first = F.greatest((F.col("block") - 1) * F.col("reach"), F.lit(0))
        around = F.slice("_shingles", first + 1, (F.col("block") + 2) * F.col("reach") + CLASSES[0][0] - first)
        contained = F.size(F.array_intersect(around, "_template")) / F.col("reach")
        tried = met.join(rows.select("_row", "_id", "_shingles"), "_row").join(known, "license")
        found = tried.select("_id", "_row", "license", "window", contained.alias("containment")).where(F.col("containment") >= CONTAINED)
        best = found.groupBy("_id", "_row", "license").agg(F.max("containment").alias("containment"), F.min("window").alias("window"))
        out = keep(stored(best.select(F.col("_id").alias(id_col), "license", "containment", "window"), "license-found"))
    return out

"""License scans (native: DataFrame functions only).

Templates of similar length share a level; a document is cut into windows of twice the level's length
that overlap by half, so every run as long as a template lies whole within a window. Windows and
templates that agree in one of 64 MinHash bands are candidates: a window that holds 80 % of a
template has a Jaccard similarity of 0.19 or more to it, and misses all the bands with a probability under
2e-6. Candidates are verified by exact containment of the template's five-word shingles. A window can
only meet a template in a band if it holds the template's smallest shingle there, so windows
without any such shingle are not hashed; that loses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, materialize, pick
from .decontam import _gram_hashes, split_words

SHINGLE_WORDS = 5
BANDS = 64
MIN_CONTAINMENT = 0.8

#: Notices and headers of public licenses.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "GPL-3.0 notice": "GNU General Public License, version 3",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
        "express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT permission": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "BSD conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in "
        "binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution."
    ),
    "ISC permission": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ),
    "GPL header": "under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL header": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL header": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "MPL-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
        "obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "MIT disclaimer": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD disclaimer": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"
    ),
    "BSD-3-Clause endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission."
    ),
    "BSD notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MIT file notice": "Licensed under the MIT License. See LICENSE file in the project root for license information.",
    "GPL-2.0 notice": "GNU General Public License, version 2",
    "Zlib conditions": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions"
    ),
    "BSL-1.0 permission": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered "
        'by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software'
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "EPL-2.0 notice": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0"
    ),
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 full notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-4.0 short notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 short notice": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0 notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Apache-2.0 identifier": "SPDX-License-Identifier: Apache-2.0",
    "GPL-2.0 identifier": "SPDX-License-Identifier: GPL-2.0",
    "GPL-3.0 identifier": "SPDX-License-Identifier: GPL-3.0",
    "LGPL-2.1 identifier": "SPDX-License-Identifier: LGPL-2.1",
    "AGPL-3.0 identifier": "SPDX-License-Identifier: AGPL-3.0",
    "MPL-2.0 identifier": "SPDX-License-Identifier: MPL-2.0",
    "BSD-2-Clause identifier": "SPDX-License-Identifier: BSD-2-Clause",
    "BSD-3-Clause identifier": "SPDX-License-Identifier: BSD-3-Clause",
}


def template_table(spark: SparkSession, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """license, hashes (of its shingles, distinct), shingles, level (a power of two of at least as many)."""
    rows = spark.createDataFrame(list(templates.items()), "license string, text string")
    rows = rows.select("license", split_words(F.col("text")).alias("words")).where(F.size("words") >= SHINGLE_WORDS)
    n = F.size("words") - (SHINGLE_WORDS - 1)
    return rows.select(
        "license",
        F.array_distinct(_gram_hashes(F.col("words"), SHINGLE_WORDS)).alias("hashes"),
        F.array_distinct(_shingles(F.col("words"))).alias("shingles"),
        F.pow(F.lit(2), F.ceil(F.log2(n))).cast("int").alias("level"),
    )


def _shingles(words: Column) -> Column:
    return F.slice(
        F.transform(words, lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + k) for k in range(1, SHINGLE_WORDS)])),
        1,
        F.greatest(F.size(words) - (SHINGLE_WORDS - 1), F.lit(0)),
    )


def _minhashes(hashes: Column) -> Column:
    """Array of (band, least), where least has the band's smallest value and the shingle hash that it is of."""
    one = lambda k: F.array_min(F.transform(hashes, lambda h: F.struct(F.xxhash64(h, F.lit(k)).alias("low"), h.alias("of"))))
    return F.array(*[F.struct(F.lit(k).alias("band"), one(k).alias("least")) for k in range(BANDS)])


def scan_licenses(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES,
    min_containment: float = MIN_CONTAINMENT,
) -> DataFrame:
    """One row per row of `df`: doc_id, row_hash, found (array of (license, containment, at), sorted).

    `at` is the first word of the first window that holds the license. Null or empty texts hold none, repeated
    rows get equal results each. Templates under five words cannot be searched and are left out. `templates`
    is a parameter of the job, not data: its bands are broadcast.
    """
    spark = df.sparkSession
    known = materialize(template_table(spark, templates), "templates")
    bands = materialize(known.select("license", "level", F.explode(_minhashes(F.col("hashes"))).alias("m")), "bands")
    bands = bands.select("license", "level", "m.band", "m.least.low", "m.least.of")
    anchors = [r["of"] for r in bands.select("of").distinct().collect()]  # at most 64 for each template
    levels = [r.level for r in known.select("level").distinct().collect()]
    docs = pick(df, doc_id=id_col, text=text_col)
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_hash"), split_words(F.col("text")).alias("words"))
    hashed = docs.withColumn("hashes", let(F.col("words"), lambda w: _gram_hashes(w, SHINGLE_WORDS)))
    marked = F.transform("hashes", lambda h, i: F.when(h.isin(anchors), i))
    hashed = hashed.withColumn("at", F.filter(marked, lambda i: i.isNotNull())).where(F.size("at") > 0)
    starts = [
        F.transform(
            F.array_distinct(F.flatten(F.transform("at", lambda p: F.array(F.floor(p / n), F.greatest(F.floor(p / n) - 1, F.lit(0)))))),
            lambda j: F.struct(F.lit(n).alias("level"), (j * n).cast("int").alias("start")),
        )
        for n in sorted(levels)
    ] or [F.array().cast("array<struct<level: int, start: int>>")]
    windows = hashed.select("doc_id", "row_hash", "words", "hashes", F.explode(F.concat(*starts)).alias("w"))
    windows = windows.select(
        "doc_id", "row_hash", "w.level", "w.start",
        F.slice("hashes", F.col("w.start") + 1, 2 * F.col("w.level")).alias("hashes"),
        F.slice("words", F.col("w.start") + 1, 2 * F.col("w.level") + (SHINGLE_WORDS - 1)).alias("words"),
    )
    lows = windows.select("doc_id", "row_hash", "level", "start", "words", F.explode(_minhashes(F.col("hashes"))).alias("m"))
    lows = lows.select("doc_id", "row_hash", "level", "start", "words", "m.band", "m.least.low")
    # A window of a few words that meets a template in many bands is one candidate: the first band counts.
    pairs = lows.join(F.broadcast(bands.drop("of")), ["level", "band", "low"])
    pairs = pairs.groupBy("doc_id", "row_hash", "license", "start", "level").agg(F.first("words").alias("words"))
    pairs = pairs.join(F.broadcast(known.select("license", "shingles")), "license")
    share = F.size(F.array_intersect("shingles", _shingles(F.col("words")))) / F.size("shingles")
    exact = pairs.select("doc_id", "row_hash", "license", "start", share.alias("containment")).where(F.col("containment") >= min_containment)
    best = exact.groupBy("doc_id", "row_hash", "license").agg(F.max("containment").alias("containment"), F.min("start").alias("at"))
    per_doc = best.groupBy("doc_id", "row_hash").agg(F.array_sort(F.collect_list(F.struct("license", "containment", "at"))).alias("found"))
    per_doc = per_doc.select(F.col("doc_id").alias("hit_id"), F.col("row_hash").alias("hit_hash"), "found")
    base = pick(df, doc_id=id_col, text=text_col).select("doc_id", F.xxhash64("doc_id", "text").alias("row_hash"))
    same = base["doc_id"].eqNullSafe(per_doc["hit_id"]) & (base["row_hash"] == per_doc["hit_hash"])
    none = F.array().cast("array<struct<license: string, containment: double, at: int>>")
    return base.join(per_doc, same, "left").select("doc_id", "row_hash", F.coalesce("found", none).alias("found"))

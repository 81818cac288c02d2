"""License scans: templates found in documents by MinHash bands over overlapping windows.

Texts are lower-cased and cut into runs of letters and digits. A template with n
five-word shingles belongs to a size class; each class cuts a document into windows
of 2S shingles that start every S shingles, S at least 1.25 times the largest n of the class, so a passage
of the template's length lies whole in some window. If a window has at least 0.8 of
the template's shingles, their Jaccard similarity is at least
``0.8 n / (2S + 0.2 n)``; each class takes as many one-row bands as it needs to miss
such a window with a probability of at most 1e-4. Candidates are verified by exact
shingle containment.

A window's band can equal a template's only if the shingle that gives the template's
band value is in the window. So the hashes of all documents first stream past these few
shingles (broadcast, in generated code, without a shuffle), which loses no
collision, and only windows around such places are signed.

Defined cases: null texts and texts under five words match nothing, nor do such
templates; a null or repeated doc_id counts as one document, with its best window;
repeated template names are one license, with its best text; ties take the first
window; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowatlas.llm import scratch
from rowatlas.llm import shingles as S

SHARE = (4, 5)
MISS = 1e-4
CLASS_RATIO = 1.25
#: Rows of template bands, and of documents with places to look at, that are broadcast at most.
BROADCAST_ROWS = 500_000

#: Usual short notices and headers of licenses.
TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ISC text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD-2-Clause conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
}


#: Whole texts of licenses, one file each, named by the license.
TEXTS = Path(__file__).with_name("license_texts")


def size_classes(most: int) -> list[tuple[int, int, int]]:
    """(largest n, S, bands) of the classes up to ``most`` shingles."""
    out, low = [], 1
    while True:
        up = max(low, math.floor(low * CLASS_RATIO))
        stride = math.ceil(up * 1.25)
        share = SHARE[0] / SHARE[1]
        least = share * low / (2 * stride + (1 - share) * low)
        out.append((up, stride, math.ceil(math.log(MISS) / math.log(1 - least))))
        if up >= most:
            return out
        low = up + 1


def templates(spark: SparkSession) -> DataFrame:
    """Short notices, headers, and whole texts."""
    whole = [(f"{f.stem} text", f.read_text("utf-8")) for f in sorted(TEXTS.glob("*.txt"))]
    return spark.createDataFrame([*TEMPLATES.items(), *whole], "license string, text string")


def _signed(hs: Column, bands: Column) -> Column:
    """Minimum of each of the first ``bands`` hash functions."""
    return F.transform(F.sequence(F.lit(1), bands), lambda j: F.array_min(F.transform(hs, lambda h: F.xxhash64(h, j))))


def _prepared(known: DataFrame, tables: scratch.Tables) -> DataFrame:
    """``license, shingles, n, up, stride, bands, hs`` of templates with a shingle."""
    # Written, or filters on shingles would cut the text again for each of them.
    cut = tables.write(known.select("license", S.split_normal_words(F.col("text")).alias("w")), "template-words").where(F.size("w") >= S.WORDS)
    own = cut.select("license", F.array_distinct(S.texts(F.col("w"))).alias("shingles"), F.array_distinct(S.hashes(F.col("w"))).alias("hs"))
    most = own.agg(F.max(F.size("hs"))).first()[0] or 1
    rows = F.array(*(F.struct(F.lit(u).alias("up"), F.lit(s).alias("stride"), F.lit(b).alias("bands")) for u, s, b in size_classes(most)))
    own = own.withColumn("c", F.element_at(F.filter(rows, lambda c: c["up"] >= F.size("hs")), 1))
    return own.select("license", "shingles", F.size("shingles").cast("long").alias("n"), "c.up", "c.stride", "c.bands", "hs")


def scan(spark: SparkSession, docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``doc_id, license, n_template, n_shared, containment, at_word`` for every license in every document.

    ``at_word`` is the word at which the best window starts.
    """
    tables = scratch.Tables(spark)
    # Rows are told apart by id and digest of the text: a null or repeated id gathers nothing.
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("tk"), "text")
    ready = tables.write(_prepared(known if known is not None else templates(spark), tables), "templates")
    giving = F.transform(F.sequence(F.lit(1), F.col("bands")), lambda j: F.array_min(F.transform("hs", lambda h: F.struct(F.xxhash64(h, j).alias("v"), h.alias("h")))))
    bands = tables.write(ready.select("license", "up", "stride", "bands", F.posexplode(giving).alias("j", "m")).select("license", "up", "stride", "bands", "j", "m.v", "m.h"), "template-bands")
    n = bands.count()
    parts = [bands.where(F.pmod("h", F.lit(k)) == b) for k in [max(1, math.ceil(n / BROADCAST_ROWS))] for b in range(k)]
    words = S.split_normal_words(F.col("text"))

    def places(part: DataFrame) -> DataFrame:
        probe = part.select("h", "up", "stride", "bands").distinct()
        hit = S.streamed(docs, words, "doc_id", "tk").join(F.broadcast(probe), "h")
        k = F.floor(F.col("at") / F.col("stride")).cast("int")
        return hit.select("doc_id", "tk", F.explode(F.array(k, k - 1)).alias("k"), "up", "stride", "bands").where("k >= 0")

    windows = reduce(DataFrame.unionByName, map(places, parts)).groupBy("doc_id", "tk").agg(F.collect_set(F.struct("up", "stride", "bands", "k")).alias("ws"))
    windows = tables.write(windows.withColumnsRenamed({"doc_id": "_d", "tk": "_t"}), "windows")
    few = windows.agg(F.coalesce(F.sum(F.size("ws")), F.lit(0))).first()[0] <= BROADCAST_ROWS
    near = docs.join(F.broadcast(windows) if few else windows, (F.col("tk") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d"))).select("doc_id", "tk", words.alias("w"), "ws")
    near = near.select("doc_id", "tk", "w", F.explode("ws").alias("c")).select("doc_id", "tk", "c.*", F.slice("w", F.col("c.k") * F.col("c.stride") + 1, 2 * F.col("c.stride") + S.WORDS - 1).alias("w"))
    signed = near.where(F.size("w") >= S.WORDS).withColumn("hs", S.hashes(F.col("w"))).select("doc_id", "tk", "k", "up", "w", F.posexplode(_signed(F.col("hs"), F.col("bands"))).alias("j", "v"))
    held = bands.select("up", "j", "v", "license").distinct()
    found = signed.join(F.broadcast(held) if n <= BROADCAST_ROWS else held, ["up", "j", "v"])
    found = found.groupBy("doc_id", "tk", "k", "up", "license").agg(F.first("w").alias("w"))
    own = ready.select("license", "up", "stride", "n", "shingles")
    pairs = found.join(F.broadcast(own) if n <= BROADCAST_ROWS else own, ["license", "up"])
    checked = pairs.select("doc_id", "license", F.col("n").alias("n_template"), F.size(F.array_intersect("shingles", S.texts(F.col("w")))).cast("long").alias("n_shared"), (F.col("k") * F.col("stride")).cast("long").alias("at"))
    checked = checked.where(F.col("n_shared") * SHARE[1] >= F.col("n_template") * SHARE[0])
    best = F.max(F.struct((F.col("n_shared") / F.col("n_template")).alias("containment"), "n_shared", "n_template", (-F.col("at")).alias("before"))).alias("b")
    return checked.groupBy("doc_id", "license").agg(best).select("doc_id", "license", "b.n_template", "b.n_shared", "b.containment", (-F.col("b.before")).alias("at_word"))

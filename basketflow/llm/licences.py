"""Licence notices in documents: MinHash bands over overlapping windows retrieve templates, exact shingle
containment verifies them. Native: only DataFrame functions.

Words are runs of letters and digits in lower case, shingles five words. Windows as long as a template
are proposed wherever a shingle of one lies in line (overlapping, at every offset). `BANDS` bands of
`ROWS` minima each: where a template's shingles are contained by 0.8 in a window of its length, their
Jaccard similarity is 2/3 or more, and no band meets with a chance of (1 - (2/3)**ROWS)**BANDS < 1e-6.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketflow.llm.anchored import bag, prepared, proposed_windows
from basketflow.llm.common import bounded_broadcast, stored, table

ROWS, BANDS = 2, 24
#: containment in percent
CONTAINED = 80
MOST_ENTRIES = 1_000_000

# fixed values: licence notices and the paragraphs of licence texts as they are written, by their short name
TEMPLATES = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a "
                   "copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
                   "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations "
                   "under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
            "and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
                     "without specific prior written permission."),
    ("BSD", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
            "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
                "Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
                "Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
            "FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Distributed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or "
            "sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
            "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
            "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Proprietary", "All rights reserved. No part of this publication may be reproduced"),
    ("Proprietary", "All rights reserved"),
    *[(name, f"SPDX-License-Identifier: {name}") for name in (
        "AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-3.0", "ISC",
        "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense")],
)


def alnum_hashes(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.transform(F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def templates(spark: SparkSession, rows=TEMPLATES) -> DataFrame:
    return spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(rows)], "template_id long, licence string, text string")


def bands(shingles: Column) -> Column:
    """The key of each band: a hash of the band's minima under as many hash functions."""
    least = lambda seed: F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, F.lit(seed))))
    return F.array(*[F.xxhash64(F.lit(b), *[least(b * ROWS + r) for r in range(ROWS)]) for b in range(BANDS)])


def scan_licences(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, template_id, start_word, n_words, found and total shingles of every window of ``docs``
    (doc_id, text) that holds a template of ``known`` (template_id, text).

    Null and empty texts hold none; templates of fewer than five words count as one shingle. Repeated
    rows (same doc_id and text) are reported once. Of the templates that fit at one place (versions of
    a notice differ by a word) the best contained ones are reported, equals all. A name without a version (GPL,
    BSD) stands for words that several versions share."""
    items = prepared(known.select(F.col("template_id").alias("id"), "text"), alnum_hashes(F.col("text")))
    windows = proposed_windows(docs, items, alnum_hashes).distinct()
    windows = stored(windows.withColumn("bag", bag(F.col("window"))).drop("window").filter(F.size("bag") > 0), "windows")
    keyed = windows.withColumn("bands", bands(F.col("bag"))).select("doc_id", "doc_key", "start", "n", "bag", F.posexplode("bands").alias("band", "key"))
    entries = stored(items.select("id", "n", F.col("bag").alias("item_bag"), F.posexplode(bands(F.col("bag"))).alias("band", "key")), "entries")
    entries = bounded_broadcast(entries, entries.count(), MOST_ENTRIES)
    found = F.size(F.array_intersect("bag", "item_bag"))
    met = keyed.join(entries, ["n", "band", "key"]).withColumn("found", found).filter(100 * F.col("found") >= CONTAINED * F.size("item_bag"))
    met = met.select("doc_id", "doc_key", F.col("id").alias("template_id"), F.col("start").cast("long").alias("start_word"), F.col("n").cast("long").alias("n_words"),
                     F.col("found").cast("long").alias("found"), F.size("item_bag").cast("long").alias("total")).distinct()
    place = Window.partitionBy("doc_id", "doc_key", "start_word")
    share = F.col("found") / F.col("total")
    return met.withColumn("best", F.max(share).over(place)).filter(share == F.col("best")).drop("best", "doc_key")


def op9_minhash_licences(spark, sf_dir: str) -> DataFrame:
    known = templates(spark)
    got = scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"), known.select("template_id", "text"))
    return got.join(F.broadcast(known.select("template_id", "licence")), "template_id").select("doc_id", "licence", "template_id", "start_word", "n_words", "found", "total")

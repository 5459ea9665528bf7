"""License scans: normalised text against licence templates by Dice coefficient over word bigrams (DataFrame functions only).

Normalised text is the lower-cased runs of letters and digits.  Units of comparison are the lines of a text, its
paragraphs (parts between blank lines) where they have several lines, the whole text where it has several paragraphs, and
windows: any run of words, over the ends of lines and paragraphs too, with no more bigrams than a template's size bounds admit.
A window is given where the other units leave something out: it overlaps no line, paragraph or text that carries its
licence, nor one with a coefficient as high.  Of windows of one licence that overlap, and of any in one place (more than half of the
longer in common), the one that shares most bigrams with its template stays.  ``unit_no`` of a window is the number of its first word.
Dice is 2 |A n B| / (|A| + |B|) over sets of bigrams.  Pruning is exact: the sizes of both sets bound the coefficient,
and a unit must hold one of the bigrams that :func:`marks` names, so texts without any of their words are passed over before
they are cut.  No template is compared with a unit that fails either.

Defined cases: null, empty and blank texts, and units of less than two words, match nothing; equal coefficients go to the
smaller licence name; repeated rows each give a row; an empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, stage

# Licence texts and notices as they are published.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR '
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "ISC": [
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of "
        "the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "BSD-2-Clause": [
        "Released under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "CC0-1.0": ["Released under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
}


PARAGRAPH = "\n[ \t]*(?:\n[ \t]*)+"


def template_bigrams(templates=None) -> list[tuple[str, list[str]]]:
    """(licence, sorted distinct bigrams) of each template."""
    out = []
    for name, texts in (templates or TEMPLATES).items():
        for t in texts:
            w = re.findall(r"[^\W_]+", t.lower())
            out.append((name, sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})))
    return out


def marks(rows: list[tuple[str, list[str]]], threshold: float) -> tuple[list[str], list[str]]:
    """(words, bigrams with one of them) such that any unit with the coefficient has one of the bigrams.

    A unit with the coefficient shares at least t b / (2 - t) of a template's b bigrams (o >= t (a + b) / 2 and a >= o), so it has one of any
    set that leaves out fewer.  Words are taken greedily until each template has that many bigrams with one of them, long words
    before short ones.
    """
    need = [len(b) - max(1, math.ceil(threshold * len(b) / (2 - threshold) - 1e-9)) + 1 for _, b in rows]
    left, words = [{tuple(x.split(" ")) for x in b} for _, b in rows], []
    while any(n > 0 for n in need):
        gain: dict[str, int] = {}
        for n, pairs in zip(need, left, strict=True):
            if n > 0:
                own: dict[str, int] = {}
                for p in pairs:
                    for w in set(p):
                        own[w] = own.get(w, 0) + 1
                for w, c in own.items():
                    gain[w] = gain.get(w, 0) + min(n, c)
        best = max(gain, key=lambda w: (len(w) > 4, gain[w] * (len(w) > 6) + gain[w], len(w), w))
        words.append(best)
        for i, pairs in enumerate(left):
            with_it = {p for p in pairs if best in p}
            need[i] -= len(with_it)
            left[i] = pairs - with_it
    return sorted(words), sorted({x for _, b in rows for x in b if set(x.split(" ")) & set(words)})


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _bigrams(own_words: Column) -> Column:
    return F.transform(F.array(own_words), lambda w: F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))),
                                                                lambda x, y: F.concat(x, F.lit(" "), y)))[0]


def scan(docs: DataFrame, threshold: float = 0.8, templates=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, unit (line, paragraph, text, window), unit_no, license, dice, n_bigrams`` for each unit's best template of at least ``threshold``."""
    rows = template_bigrams(templates)
    words, wanted = marks(rows, threshold)
    least = min(math.ceil(threshold * len(b) / (2 - threshold) - 1e-9) for _, b in rows)
    most = max(math.floor((2 - threshold) * len(b) / threshold + 1e-9) for _, b in rows)
    # A text without any of these words has no unit with a wanted bigram.
    likely = F.lower(F.coalesce(F.col(text_col), F.lit(""))).rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(map(re.escape, words)) + r")(?![\p{L}\p{N}])")
    likely_docs = docs.where(likely).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.regexp_replace(text_col, "\r\n?", "\n").alias("text"))
    # A text without a wanted bigram across its whole words has none in a unit.
    texts = stage(likely_docs.where(F.exists(_bigrams(_words(F.col("text"))), lambda x: x.isin(*wanted))))
    text = F.col("text")
    kind = lambda units, name: F.transform(units, lambda u, i: F.struct(F.lit(name).alias("unit"), i.cast("long").alias("unit_no"), u.alias("own")))
    empty = F.array().cast("array<struct<unit:string,unit_no:bigint,own:string>>")
    # A unit of n bigrams has more than n words, each of a letter and a separator at least, so shorter ones need no splitting.
    units = F.concat(
        kind(F.split(text, "\n"), "line"),
        F.filter(kind(F.split(text, PARAGRAPH), "paragraph"), lambda u: u["own"].contains("\n")),
        F.when(text.rlike("\n[ \t]*\n"), kind(F.array(text), "text")).otherwise(empty))
    units = F.filter(units, lambda u: F.length(u["own"]) >= 2 * least + 1)
    cut = texts.select("row", "id", F.explode(units).alias("u")).select("row", "id", "u.*")
    found = cut.select("row", "id", "unit", "unit_no", _bigrams(_words(F.col("own"))).alias("b")).where((F.size("b") >= least) & F.exists("b", lambda x: x.isin(*wanted)))
    found = found.withColumn("b", F.array_distinct("b")).where(F.size("b").between(least, most))
    score = F.filter(F.array(*[_against(name, bigrams, threshold) for name, bigrams in rows]), lambda x: x.isNotNull())
    best = F.reduce(score, F.struct(F.lit(0.0).alias("dice"), F.lit(None).cast("string").alias("license")), _better)
    found = stage(found.withColumn("s", best).where(F.col("s.license").isNotNull()).select(
        "row", "id", "unit", "unit_no", F.col("s.license").alias("license"), F.col("s.dice").alias("dice"), F.size("b").cast("long").alias("n_bigrams")))
    out = found.unionByName(windows(texts, found, threshold, templates)).drop("row")
    names = out.columns
    return (out if id_col in names else out.withColumn(id_col, F.col("id"))).select(*names)  # filters may name the id as the documents do


def windows(texts: DataFrame, found: DataFrame, threshold: float, templates=None) -> DataFrame:
    """Windows of ``texts`` (``row, id, text``) beside the units that are found."""
    known = []
    for number, ((name, bigrams), raw) in enumerate(zip(template_bigrams(templates), [t for ts in (templates or TEMPLATES).values() for t in ts], strict=True)):
        b = len(bigrams)
        repeats = max(0, len(re.findall(r"[^\W_]+", raw.lower())) - 1 - b)
        need, room = math.ceil(threshold * b / (2 - threshold) - 1e-9), math.floor((2 - threshold) * b / threshold + 1e-9) + repeats
        known += [(x, number, k, name, b, need, room) for k, x in enumerate(bigrams)]
    known = texts.sparkSession.createDataFrame(known, "b string, template int, g int, license string, size int, need int, room int")
    # Words of lines and of paragraphs are those of the text in the same order.
    number = lambda units: F.flatten(F.transform(units, lambda u, i: F.transform(_words(u), lambda w: i)))
    whole = texts.select("row", "id", _bigrams(_words(F.col("text"))).alias("all"), number(F.split("text", "\n")).alias("lines"), number(F.split("text", PARAGRAPH)).alias("paragraphs"))
    hits = whole.select("row", F.posexplode("all").alias("at", "b")).join(F.broadcast(known), "b")
    hits = hits.groupBy("row", "template", "license", "size", "need", "room").agg(F.sort_array(F.collect_list(F.struct("at", "g"))).alias("hits")).where("size(hits) >= need")
    # A window that ends in bigrams of the template is no worse than one with more around it; from a start, so many must come in the room.
    starts = F.filter(F.sequence(F.lit(0), F.size("hits") - F.col("need")), lambda i: F.get("hits", i + F.col("need") - 1)["at"] - F.get("hits", i)["at"] < F.col("room"))
    begun = hits.withColumn("starts", starts).where("size(starts) > 0").join(whole, "row").select(
        "row", "id", "template", "license", "size", "need", "room", F.explode(F.transform("starts", lambda i: F.struct(
            F.get("hits", i)["at"].alias("start"), F.slice("hits", i + 1, F.col("room")).alias("hits"),
            F.slice("all", F.get("hits", i)["at"] + 1, F.col("room")).alias("all"),
            F.slice("lines", F.get("hits", i)["at"] + 1, F.col("room") + 1).alias("lines"),
            F.slice("paragraphs", F.get("hits", i)["at"] + 1, F.col("room") + 1).alias("paragraphs")))).alias("s")).select("row", "id", "template", "license", "size", "need", "room", "s.*")
    begun = begun.withColumn("hits", F.filter("hits", lambda h: h["at"] - F.col("start") < F.col("room"))).where("size(hits) >= need")

    def one(k):
        long = F.get("hits", k - 1)["at"] - F.col("start") + 1
        shared = F.size(F.array_distinct(F.transform(F.slice("hits", F.lit(1), k), lambda h: h["g"])))
        n = F.size(F.array_distinct(F.slice("all", F.lit(1), long)))
        return F.struct((2.0 * shared / (n + F.col("size"))).alias("dice"), (-long).alias("less"), shared.alias("shared"), n.cast("long").alias("n_bigrams"))

    best = begun.withColumn("w", F.array_max(F.transform(F.sequence("need", F.size("hits")), one))).where(F.col("w.dice") >= threshold)
    best = best.select("row", "id", "license", "template", "start", (F.col("start") - F.col("w.less")).alias("end"), F.col("w.dice").alias("dice"), F.col("w.shared").alias("shared"), F.col("w.n_bigrams").alias("n_bigrams"),
                       *[F.get(c, at).cast("long").alias(f"{c}_{side}") for c in ("lines", "paragraphs") for side, at in (("from", F.lit(0)), ("to", -F.col("w.less")))])
    units = found.groupBy("row").agg(F.collect_list(F.struct("unit", "unit_no", "license", "dice")).alias("units"))
    told = F.exists("units", lambda u: ((u["license"] == F.col("license")) | (u["dice"] >= F.col("dice"))) & (
        (u["unit"] == "text") | ((u["unit"] == "line") & u["unit_no"].between(F.col("lines_from"), F.col("lines_to")))
        | ((u["unit"] == "paragraph") & u["unit_no"].between(F.col("paragraphs_from"), F.col("paragraphs_to")))))
    left = best.join(units, "row", "left").where(~F.coalesce(told, F.lit(False)))
    item = F.struct((-F.col("shared")).alias("less"), (-F.col("dice")).alias("worse"), "license", "start", "end", "dice", "n_bigrams")
    each = left.groupBy("row", "id").agg(F.sort_array(F.collect_list(item)).alias("w"))

    def clash(a, b):  # words start to end (the last bigram ends one word on)
        common = F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]) + 1
        longer = F.greatest(a["end"] - a["start"], b["end"] - b["start"]) + 1
        return (common > 0) & ((a["license"] == b["license"]) | (2 * common > longer))

    kept = F.reduce("w", F.slice("w", 1, 0), lambda kept, x: F.when(F.exists(kept, lambda k: clash(k, x)), kept).otherwise(F.concat(kept, F.array(x))))
    return each.select("row", "id", F.explode(kept).alias("w")).select(
        "row", "id", F.lit("window").alias("unit"), F.col("w.start").cast("long").alias("unit_no"), "w.license", "w.dice", "w.n_bigrams")


def _against(name: str, bigrams: list[str], threshold: float) -> Column:
    own = F.array(*[F.lit(x) for x in bigrams])
    n, m = F.size("b"), len(bigrams)
    possible = 2.0 * F.least(n, F.lit(m)) >= threshold * (n + m)
    dice = F.when(possible, 2.0 * F.size(F.array_intersect("b", own)) / (n + m))
    return F.when(dice >= threshold, F.struct(dice.alias("dice"), F.lit(name).alias("license")))


def _better(a: Column, b: Column) -> Column:
    return F.when((b["dice"] > a["dice"]) | ((b["dice"] == a["dice"]) & (b["license"] < a["license"])), b).otherwise(a)


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    """All units of all documents that carry a licence: ``doc_id, unit, unit_no, license, dice, n_bigrams``."""
    return scan(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")

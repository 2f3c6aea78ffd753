"""Licence scan: Dice coefficient over word bigrams, in DataFrame expressions only.

Texts are normalised (lower case, every other run of characters is one space)
and each line, and the whole text, is compared to each licence template as
sets of word bigrams: dice = 2 |A & B| / (|A| + |B|).

Two exact bounds prune. Dice >= t needs t/(2-t) <= |A|/|B| <= (2-t)/t, so only
templates of a fitting size are compared. And it needs at least t/(2-t) of a
template's bigrams, so one of any larger rest: ``gate_words`` chooses few rare
words that occur in so many bigrams of every template that a unit without any
of them can't reach t, and such units are dropped by one pattern search.

With ``windows`` every run of words is a unit as well, across lines and inside
them, so wrapped texts and notices within a sentence are found: a template of s
bigrams meets all runs of up to s(2-t)/t bigrams, and its best one is taken;
one that overlaps another that shares more bigrams is dropped. A
best run starts with one of the template's bigrams and needs t/(2-t) of them,
so only starts with that many ahead are measured; from a start, one pass gives
the scores of all its ends.

Defined results: a null or empty text, or one without a match, has a null
licence, score 0 and no matches; ties go to the first template by name, then
to the first line; texts of any length are scanned whole; rows sharing an id
stay separate rows; extra columns are ignored; an empty table gives an empty
table.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphquarry.llm.pii import _bind

THRESHOLD = 0.8

# The usual notices and short full texts of licences.
TEMPLATES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0 (notice)": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD (notice)": "Released under the BSD License.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0 (notice)": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-SA-4.0 (notice)": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-2.0 (notice)": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT (notice)": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
}
#: Too common to gate by.
COMMON = frozenset("a above all an and any are as at be but by can do for form from if in is it not of on one or other see shall that the this to use was will with without work you".split())


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def bigrams_of(text: str) -> set[str]:
    w = words_of(text)
    return {f"{a} {b}" for a, b in zip(w, w[1:])}


def gate_words(templates: dict[str, str], t: float) -> list[str]:
    """Few words of which every text that reaches ``t`` has at least one.

    A text at Dice >= t lacks fewer than ``need`` bigrams of the template; once
    the chosen words occur in that many, one of those bigrams is in the text.
    """
    chosen: set[str] = set()
    for text in sorted(templates.values(), key=len):
        grams = bigrams_of(text)
        need = len(grams) - math.ceil(t * len(grams) / (2 - t) - 1e-9) + 1
        while sum(bool(chosen & set(g.split())) for g in grams) < need:
            left = [g.split() for g in grams if not chosen & set(g.split())]
            words = {w for g in left for w in g}
            best = min(words, key=lambda w: (w in COMMON or len(w) < 3, -sum(w in g for g in left), w))
            chosen.add(best)
    return sorted(chosen)


def _normal(text: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.trim(F.regexp_replace(F.translate(text, upper, lower), "[^a-z0-9]+", " "))


def _bigrams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.when(F.size(words) >= 2, pairs).otherwise(F.array().cast("array<string>")))


def _windows(lines: Column, known: Column, threshold: float) -> Column:
    """Best runs of templates that don't overlap: -shared bigrams, -score, name, first and last bigram and line."""
    low, high = threshold / (2 - threshold) - 1e-9, (2 - threshold) / threshold + 1e-9

    def words_in(x, i):
        return F.transform(F.filter(F.split(_normal(x), " "), lambda w: w != ""), lambda w: F.struct(w.alias("word"), (i + 1).alias("line")))

    def pairs(words):
        n = F.greatest(F.size(words) - 1, F.lit(0))
        return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.struct(F.concat_ws(" ", a["word"], b["word"]).alias("gram"), a["line"].alias("line"), b["line"].alias("last")))

    def with_before(seen):
        """For every bigram of the text, where it stood the last time before, or -1."""
        ordered = F.array_sort(F.transform(seen, lambda g, i: F.struct(g["gram"].alias("gram"), i.alias("at"))))
        linked = _bind(ordered, lambda o: F.transform(o, lambda x, i: F.struct(x["at"].alias("at"), F.when(F.get(o, i - 1)["gram"] == x["gram"], F.get(o, i - 1)["at"]).otherwise(-1).alias("before"))))
        grams = F.transform(seen, lambda g: g["gram"])
        return F.struct(seen.alias("seen"), grams.alias("grams"), F.array_distinct(grams).alias("own"), F.transform(F.array_sort(linked), lambda x: x["before"]).alias("before"))

    def best_of(t, text):
        need, longest = F.ceil(low * t["size"]).cast("int"), F.floor(high * t["size"]).cast("int")

        def from_hits(is_in):
            def from_starts(hits):
                starts = F.filter(F.transform(hits, lambda h, k: F.struct(h.alias("at"), F.get(hits, k + need - 1).alias("end"))), lambda x: x["end"] - x["at"] < longest)

                def measured(x):
                    at = x["at"]

                    def step(acc, p):
                        new = F.get(text["before"], p) < at
                        size, shared = acc["size"] + F.when(new, 1).otherwise(0), acc["shared"] + F.when(new & F.get(is_in, p), 1).otherwise(0)
                        return F.struct(size.alias("size"), shared.alias("shared"), F.greatest(acc["best"], F.struct((2.0 * shared / (size + t["size"])).alias("score"), shared.alias("shared"), (-p).alias("end"))).alias("best"))

                    zero = F.struct(F.lit(0).alias("size"), F.lit(0).alias("shared"), F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("shared"), F.lit(0).alias("end")).alias("best"))
                    best = F.aggregate(F.sequence(at, F.least(at + longest, F.size(is_in)) - 1), zero, step, lambda acc: acc["best"])
                    return _bind(best, lambda y: F.struct((-F.round(y["score"], 6)).alias("minus"), (-y["shared"]).alias("shared"), at.alias("at"), (-y["end"]).alias("end")))

                return F.array_min(F.transform(starts, measured))

            return _bind(F.filter(F.sequence(F.lit(0), F.size(is_in) - 1), lambda p: F.get(is_in, p)), from_starts)

        top = _bind(F.transform(text["grams"], lambda g: F.array_contains(t["grams"], g)), from_hits)
        return _bind(top, lambda w: F.struct(w["shared"].alias("shared"), w["minus"].alias("minus"), t["name"].alias("name"), w["at"].alias("at"), w["end"].alias("end"), F.get(text["seen"], w["at"])["line"].alias("line"), F.get(text["seen"], w["end"])["last"].alias("last")))

    def found(text):
        fitting = F.filter(known, lambda t: F.size(F.array_intersect(text["own"], t["grams"])) >= low * t["size"])
        runs = F.array_sort(F.filter(F.transform(fitting, lambda t: best_of(t, text)), lambda w: F.coalesce(-w["minus"] >= threshold, F.lit(False))))

        def one_more(kept, w):
            return F.when(F.exists(kept, lambda x: (x["at"] <= w["end"]) & (w["at"] <= x["end"])), kept).otherwise(F.concat(kept, F.array(w)))

        return _bind(runs, lambda r: F.aggregate(r, F.filter(r, lambda w: F.lit(False)), one_more))

    return _bind(_bind(_bind(F.flatten(F.transform(lines, words_in)), pairs), with_before), found)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, windows: bool = False) -> DataFrame:
    """doc_id, licence, score, line (0 is the whole text), n_matches and matches.

    ``matches`` lists "line:template:score" of every unit's best template. With
    ``windows`` it goes on with the best runs of words of templates, but not with
    those in lines whose own template is as large as what the run shares; and
    licence, score and line are those of the first run if it shares more bigrams
    than the best line's or whole text's template has.
    """
    templates = TEMPLATES if templates is None else templates
    gate = "(?i)(?<![a-z0-9])(?:" + "|".join(gate_words(templates, threshold)) + ")(?![a-z0-9])"
    known = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(len(bigrams_of(t))).alias("size"), F.array(*map(F.lit, sorted(bigrams_of(t)))).alias("grams")) for n, t in sorted(templates.items())))
    low, high = threshold / (2 - threshold) - 1e-9, (2 - threshold) / threshold + 1e-9
    smallest = min(len(bigrams_of(t)) for t in templates.values())

    lines = F.split("text", "\n", -1)
    numbered = F.concat(F.array(F.struct(F.lit(0).alias("line"), F.col("text").alias("unit"))), F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), x.alias("unit"))))
    units = F.filter(numbered, lambda u: u["unit"].rlike(gate) & ((u["line"] != 0) | (F.size(lines) > 1)))

    def measured(u):
        return F.struct(u["line"].alias("line"), _bigrams(F.split(_normal(u["unit"]), " ")).alias("grams"))

    def best_of(u):
        n = F.size(u["grams"])
        fitting = F.filter(known, lambda t: (n >= low * t["size"]) & (n <= high * t["size"]))
        scored = F.transform(fitting, lambda t: F.struct((-F.round(2.0 * F.size(F.array_intersect(u["grams"], t["grams"])) / (n + t["size"]), 6)).alias("minus"), t["name"].alias("name"), t["size"].alias("size")))
        return F.struct(u["line"].alias("line"), F.array_min(scored).alias("best"))

    sized = F.filter(F.transform(units, measured), lambda u: F.size(u["grams"]) >= low * smallest)
    hits = F.filter(F.transform(sized, best_of), lambda u: F.coalesce(-u["best"]["minus"] >= threshold, F.lit(False)))
    gated = F.col("text").rlike(gate)
    if windows:
        return _merged(docs.select("doc_id", F.when(gated, hits).alias("hits"), F.when(gated, _windows(lines, known, threshold)).alias("runs")))
    found = docs.select("doc_id", F.when(gated, hits).alias("hits"))
    top = F.array_min(F.transform("hits", lambda h: F.struct(h["best"]["minus"].alias("minus"), h["best"]["name"].alias("name"), h["line"].alias("line"))))
    listed = F.transform("hits", lambda h: F.concat_ws(":", h["line"], h["best"]["name"], F.format_number(-h["best"]["minus"], 6)))
    return found.select("doc_id", top.alias("top"), F.coalesce(F.size("hits"), F.lit(0)).alias("n"), listed.alias("listed")).select(
        "doc_id",
        F.col("top.name").alias("licence"),
        F.coalesce(-F.col("top.minus"), F.lit(0.0)).alias("score"),
        F.col("top.line").alias("line"),
        F.greatest("n", F.lit(0)).cast("long").alias("n_matches"),
        F.coalesce(F.array_join("listed", ";"), F.lit("")).alias("matches"),
    )


def _merged(found: DataFrame) -> DataFrame:
    """The columns of ``scan`` from the hits of units and the best runs of templates."""
    top = F.array_min(F.transform("hits", lambda h: F.struct(h["best"]["minus"].alias("minus"), h["best"]["name"].alias("name"), h["line"].alias("line"), h["best"]["size"].alias("size"))))
    listed = F.transform("hits", lambda h: F.struct(h["line"].alias("line"), h["best"]["name"].alias("name"), h["best"]["minus"].alias("minus")))

    def held(h, r):
        return ((h["line"] == 0) | h["line"].between(r["line"], r["last"])) & (h["best"]["size"] >= -r["shared"])

    runs = F.filter("runs", lambda r: ~F.exists("hits", lambda h: held(h, r)))
    more = F.transform(runs, lambda r: F.struct(r["line"].alias("line"), r["name"].alias("name"), r["minus"].alias("minus")))
    first = F.get(runs, F.lit(0))
    best_run = F.struct(first["minus"].alias("minus"), first["name"].alias("name"), first["line"].alias("line"))
    best_unit = F.when(top.isNotNull(), F.struct(top["minus"].alias("minus"), top["name"].alias("name"), top["line"].alias("line")))
    chosen = F.when(first.isNotNull() & (-first["shared"] > F.coalesce(top["size"], F.lit(0))), best_run).otherwise(best_unit)
    out = found.select("doc_id", chosen.alias("top"), F.coalesce(F.concat(listed, more), F.array().cast("array<struct<line:int,name:string,minus:double>>")).alias("listed"))
    return out.select(
        "doc_id",
        F.col("top.name").alias("licence"),
        F.coalesce(-F.col("top.minus"), F.lit(0.0)).alias("score"),
        F.col("top.line").alias("line"),
        F.size("listed").cast("long").alias("n_matches"),
        F.array_join(F.transform("listed", lambda h: F.concat_ws(":", h["line"], h["name"], F.format_number(-h["minus"], 6))), ";").alias("matches"),
    )

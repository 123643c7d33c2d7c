"""Licence scans: Dice coefficient over word bigrams, DataFrame functions only.

Every line, and every text of several lines as a whole, is compared with the
templates whose number of bigrams lies within the bounds that the threshold
leaves; all others are pruned unseen. Notices wrapped over lines are found by
windows of consecutive lines, in texts with a word that no hit can do without.
Rows never meet, so nothing is shuffled.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name
from .decontamination import let, words

#: Least Dice coefficient of a hit.
THRESHOLD = 0.8

# Notices and short texts of well-known licences.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
]

# Whole licences, which only windows and whole texts are compared with.
FULL_TEXTS = [
    ("bsd-2-clause", f"{_BSD[0]} {_BSD[2]}"),
    ("bsd-3-clause", " ".join(_BSD)),
    ("isc", TEMPLATES[10][1] + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("mit", f"{TEMPLATES[13][1]} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
]


def templates_from(folder: str) -> list[tuple[str, str]]:
    """Templates from the ``.txt`` files of a folder, each named for its licence:
    for whole texts too long to be kept here."""
    return [(f.stem, f.read_text(encoding="utf-8")) for f in sorted(Path(folder).glob("*.txt"))]


def template_bigrams(text: str) -> list[str]:
    """Distinct bigrams of a normalised text, as the scan makes them."""
    ws = _words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(ws, ws[1:])))


def size_bounds(n: int, threshold: float) -> tuple[float, float]:
    """Bigrams of a text that can reach the threshold with a template of ``n``."""
    return threshold / (2 - threshold) * n, (2 - threshold) / threshold * n


def _words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))


#: Words of any prose, taken as keys only where no others are left.
_COMMON = set("a all an and are as at be by do for from in is it no not of on or that the this to was with".split())


def key_words(templates: list[tuple[str, str]], threshold: float) -> list[str]:
    """Words of which every hit has one: the longest of each template, common ones
    last, until the bigrams without them are too few for the threshold."""
    out = set()
    for _, t in templates:
        grams, own = template_bigrams(t), set()
        for w in sorted(set(_words(t)), key=lambda w: (w in _COMMON, -len(w), w)):
            # a text that shares c of n bigrams has a coefficient of 2c / (c + n) at most
            c = sum(not own & set(g.split(" ")) for g in grams)
            if 2 * c < (threshold - 1e-9) * (c + len(grams)):
                break
            own.add(w)
        out |= own
    return sorted(out)


def _best(ws: Column, templates: list[tuple[str, str]], threshold: float) -> Column:
    """struct(minus, license, shared) of the best template for an array of words, or null."""
    rows = []
    for name, t in templates:
        grams = template_bigrams(t)
        lo, hi = size_bounds(len(grams), threshold)
        rows.append(F.struct(F.lit(name).alias("license"), F.lit(lo - 1e-9).alias("lo"), F.lit(hi + 1e-9).alias("hi"), F.split(F.lit("|".join(grams)), r"\|").alias("grams")))
    least, most = (f(size_bounds(len(template_bigrams(t)), threshold)[k] for _, t in templates) for k, f in ((0, min), (1, max)))
    dice = lambda b: lambda t: let(F.size(F.array_intersect(b, t["grams"])), lambda c: F.struct((2.0 * c / (F.size(b) + F.size(t["grams"]))).alias("dice"), t["license"].alias("license"), c.alias("shared")))
    fits = lambda b: F.filter(F.array(*rows), lambda t: (F.size(b) >= t["lo"]) & (F.size(b) <= t["hi"]))
    # the best coefficient; of several templates with it the first name
    best = lambda ds: F.array_min(F.transform(F.filter(ds, lambda d: d["dice"] >= threshold), lambda d: F.struct((-d["dice"]).alias("minus"), d["license"].alias("license"), d["shared"].alias("shared"))))
    bigrams = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.slice(w, i, 2))))
    # a text of w words has w - 1 bigrams at most; with fewer than the least bound it needs no look
    scan = lambda w: F.when((F.size(w) >= 2) & (F.size(w) - 1 >= least - 1e-9), let(bigrams(w), lambda b: F.when(F.size(b) <= most + 1e-9, let(F.transform(fits(b), dice(b)), best))))
    return scan(ws)


_HIT = "struct<line:int,license:string,dice:double,last:int,shared:int>"


def _windows(lines: Column, found: Column, templates: list[tuple[str, str]], threshold: float) -> Column:
    """Hits of runs of two and more ``lines``, (line, words) without empty ones,
    but not of all: those that share most bigrams first, none that overlaps an
    earlier one or holds a line that is a hit sharing as many or of the same licence."""
    least = min(size_bounds(len(template_bigrams(t)), threshold)[0] for _, t in templates)
    most = int(max(size_bounds(len(_words(t)), threshold)[1] for _, t in templates)) + 1
    keys = F.array(*map(F.lit, key_words(templates, threshold)))
    # (words so far, whether one is a key word, the last lines of windows that may be hits)
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("key"), F.array().cast("array<int>").alias("ends"))
    add = lambda acc, x: F.when(acc["n"] > most, acc).otherwise(let(F.struct((acc["n"] + F.size(x["words"])).alias("n"), (acc["key"] | x["key"]).alias("key")), lambda y: F.struct(y["n"].alias("n"), y["key"].alias("key"), F.when(y["key"] & (y["n"] <= most) & (y["n"] - 1 >= least - 1e-9), F.array_append(acc["ends"], x["at"])).otherwise(acc["ends"]).alias("ends"))))
    marked = F.transform(lines, lambda x, i: F.struct(x["line"].alias("line"), x["words"].alias("words"), F.arrays_overlap(x["words"], keys).alias("key"), i.alias("at")))

    def of_start(ls: Column, p: Column) -> Column:
        ends = F.aggregate(F.slice(ls, p + 1, most), start, add, lambda acc: F.filter(acc["ends"], lambda e: (e > p) & ((p > 0) | (e < F.size(ls) - 1))))
        ws = lambda e: F.flatten(F.transform(F.slice(ls, p + 1, e - p + 1), lambda x: x["words"]))
        at = lambda i: F.element_at(ls, i + 1)["line"]
        hit = lambda e: let(ws(e), lambda w: let(_best(w, templates, threshold), lambda m: F.when(m.isNotNull(), F.struct((-m["shared"]).alias("less"), m["minus"].alias("minus"), at(p).alias("line"), at(e).alias("last"), m["license"].alias("license")))))
        return F.filter(F.transform(ends, hit), lambda h: h.isNotNull())

    own = lambda h: F.exists(found, lambda o: (o["line"] >= h["line"]) & (o["line"] <= h["last"]) & ((o["license"] == h["license"]) | (o["shared"] >= -h["less"])))
    every = let(marked, lambda ls: F.array_sort(F.filter(F.flatten(F.transform(ls, lambda x: of_start(ls, x["at"]))), lambda h: ~own(h))))
    free = lambda out, h: ~F.exists(out, lambda o: (o["line"] <= h["last"]) & (o["last"] >= h["line"]))
    as_hit = lambda h: F.struct(h["line"].alias("line"), h["license"].alias("license"), (-h["minus"]).alias("dice"), h["last"].alias("last"), (-h["less"]).alias("shared")).cast(_HIT)
    return F.aggregate(every, F.array().cast(f"array<{_HIT}>"), lambda out, h: F.when(free(out, h), F.array_append(out, as_hit(h))).otherwise(out))


def license_hits(documents: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with ``hits``, an array of (line, license, dice, last,
    shared bigrams): the best template of each line that has one, line numbers
    from 0; of runs of several lines, from ``line`` to ``last``, those that share
    most, do not overlap and hold no line that is a hit sharing as many or of the
    same licence; and of the whole text as line -1 if it has
    several lines. Empty lines count for nothing in a run. Whole licences are
    looked for in runs and whole texts, if no ``templates`` are given.

    Null and empty texts and texts without two words have no hits; texts of any
    length are scanned whole; ties go to
    the licence first by name; repeated rows come out once each; an empty table
    gives no rows; all columns are kept, and where one is named hits, the new
    one gets underscores appended.
    """
    long = [*TEMPLATES, *FULL_TEXTS] if templates is None else templates
    templates = TEMPLATES if templates is None else templates
    hit = lambda line, m: F.struct(line.cast("int").alias("line"), m["license"].alias("license"), (-m["minus"]).alias("dice"), line.cast("int").alias("last"), m["shared"].alias("shared")).cast(_HIT)
    some = lambda hs: F.filter(hs, lambda h: h.isNotNull())
    none = F.array().cast(f"array<{_HIT}>")
    of_lines = lambda ls: some(F.transform(ls, lambda w, i: let(_best(w, templates, threshold), lambda m: F.when(m.isNotNull(), hit(i, m)))))
    of_all = lambda ws: some(F.array(let(_best(ws, long, threshold), lambda m: F.when(m.isNotNull(), hit(F.lit(-1), m)))))
    keys = F.array(*map(F.lit, key_words(long, threshold)))
    numbered = lambda ls: F.filter(F.transform(ls, lambda w, i: F.struct(i.alias("line"), w.alias("words"))), lambda x: F.size(x["words"]) > 0)
    runs = lambda ls, ws, found: F.when(F.arrays_overlap(ws, keys), let(numbered(ls), lambda ns: _windows(ns, found, long, threshold))).otherwise(none)
    several = lambda ls, found: let(F.flatten(ls), lambda ws: F.concat(found, runs(ls, ws, found), of_all(ws)))
    scan = lambda ls: let(of_lines(ls), lambda found: F.when(F.size(ls) > 1, several(ls, found)).otherwise(found))
    split = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), words)
    return documents.withColumn(free_name("hits", documents.columns), let(split, scan))

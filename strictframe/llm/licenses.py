"""License scans: Dice coefficient over word bigrams against licence templates.

A text's words are its runs of letters and digits, lower case, in one sequence:
line breaks, comment marks and other punctuation don't part them, so a notice
may be wrapped, commented or inside a longer sentence.  Two word sequences are
as like as the Dice coefficient of their sets of adjacent word pairs.  With
threshold t, a template of m pairs can only match n pairs if ``t/(2-t) <= n/m <=
(2-t)/t``: the size bound.  A match also shares at least ``t*m/(2-t)`` of the
template's pairs, so it holds one of any ``m - ceil(t*m/(2-t)) + 1`` of them: the
anchors, taken as the longest.

Each anchor in a text calls for the window, as long as the template, that has it
at the template's place (cut off at the ends of the text); a window within the
size bound that reaches the threshold is a match.  In order of their start,
matches that overlap compete, and the best stays: the most shared pairs, then the
greatest coefficient, then the first name.  A text without the longer word of any
anchor has none; that prunes most texts before any pair is made.

Everything is DataFrame expressions in one pass without a shuffle; templates are
constants of the plan.

Defined cases: a null text has no words; a very long text is scanned whole, in
time that grows with its length and its anchors; repeated rows and null ids are
scanned row by row; of equal coefficients (ties) the first name is listed; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD
TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_TWO = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution. """
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission. """
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising
from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote
the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed
or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute
this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
_GPL = """This program is free software{1} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
Software Foundation, either {0} This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""

#: Licence notices and texts by identifier; several wordings may share one.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "This project is released under the Apache License 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty."),
    ("Proprietary", "All rights reserved."),
    ("Apache-2.0", _APACHE_HEADER),
    ("MIT", _MIT),
    ("ISC", _ISC),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TWO + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_TWO + _BSD_THIRD + _BSD_TAIL),
    ("Zlib", _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("GPL-3.0", _GPL.format("version 3 of the License, or (at your option) any later version.", ":")),
    ("GPL-2.0", _GPL.format("version 2 of the License, or (at your option) any later version.", ";")),
)


@dataclass(frozen=True)
class Template:
    name: str
    pairs: tuple[str, ...]
    anchors: tuple[tuple[str, int], ...]  # each with its place, once for each place
    size: int  # pairs with those that repeat: the length of a window
    least: int
    most: int


def normal_words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9À-ɏ]+", " ", text.lower()).split()


def word_pairs(text: str) -> list[str]:
    w = normal_words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def compiled(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> list[Template]:
    """Templates with their pairs, anchors and size bounds; a template needs two words at least."""
    out = []
    for name, text in sorted(templates):
        pairs, words = word_pairs(text), normal_words(text)
        places = [f"{a} {b}" for a, b in zip(words, words[1:])]
        m, t = len(pairs), threshold
        shared = math.ceil(t * m / (2 - t) - 1e-9)
        anchors = set(sorted(pairs, key=lambda p: (-len(p), p))[: m - shared + 1])
        out.append(Template(name, tuple(pairs), tuple((p, i) for i, p in enumerate(places) if p in anchors), len(places), shared, math.floor(m * (2 - t) / t + 1e-9)))
    return out


def _strings(values: tuple[str, ...] | list[str]) -> Column:
    """An array of strings (of words and spaces) as one constant, not one for each string."""
    return F.split(F.lit("|".join(values)), r"\|")


def _numbers(values: list[int]) -> Column:
    return _strings([str(v) for v in values]).cast("array<bigint>")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _pairs(words: Column) -> Column:
    """Adjacent word pairs in order; none for a single word."""
    follow = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.filter(F.zip_with(words, follow, lambda a, b: F.concat(a, F.lit(" "), b)), lambda p: p.isNotNull())


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9À-ɏ]+", " "))


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``id_col``, ``n_matches`` (units), the best ``license`` and ``dice``, and all ``licenses`` found."""
    known = compiled(templates, threshold)
    pairs_of = sorted({p for t in known for p, _ in t.anchors})
    called = [(p, i, k) for k, t in enumerate(known) for p, i in t.anchors]
    call_pairs = _strings([p for p, _, _ in called])
    library = F.array(*(F.struct(F.lit(t.name).alias("name"), _strings(t.pairs).alias("pairs"), F.lit(t.size).alias("size"), F.lit(t.least).alias("least"), F.lit(t.most).alias("most")) for t in known))
    longest = max(t.size for t in known)
    marks = _strings(sorted({max(p.split(), key=len) for p in pairs_of}))

    # Words and pairs are made in steps, so that each is one column and made once.
    words = F.split(_normal(F.coalesce(F.col(text_col), F.lit(""))), " ")
    some = docs.select(F.col(id_col), words.alias("__words")).select(id_col, F.when(F.arrays_overlap("__words", marks), _pairs(F.col("__words"))).otherwise(F.array().cast("array<string>")).alias("__pairs"))
    pairs = F.col("__pairs")
    # Places from 0 of the pairs that are anchors; then the windows they call for, each once.
    at = F.filter(F.transform(pairs, lambda p, i: F.when(p.isin(pairs_of), F.struct(p.alias("pair"), i.alias("i")))), lambda x: x.isNotNull())
    # A window is one number, as only numbers and strings are told apart by hashing: its start, then the template.
    call_codes = _numbers([(longest - i) * len(known) + k for _, i, k in called])
    windows = F.array_distinct(F.flatten(F.transform(at, lambda x: F.transform(F.filter(call_codes, lambda _, j: F.get(call_pairs, j) == x["pair"]), lambda c: c + x["i"].cast("long") * len(known)))))

    def scored(w: Column) -> Column:
        begin, k = (F.call_function("div", w, F.lit(len(known))) - longest).cast("int"), F.pmod(w, F.lit(len(known))).cast("int")
        return _bound(F.struct(begin.alias("start"), k.alias("k"), F.get(library, k).alias("t")), of_template)

    def of_template(w: Column) -> Column:
        first = F.greatest(w["start"], F.lit(0))
        own = F.array_distinct(F.slice(pairs, first + 1, w["start"] + w["t"]["size"] - first))
        return _bound(own, lambda o: _bound(F.size(F.array_intersect(o, w["t"]["pairs"])), lambda shared: result(w, F.size(o), shared)))

    def result(w: Column, n: Column, shared: Column) -> Column:
        fits = (n >= w["t"]["least"]) & (n <= w["t"]["most"])
        dice = F.when(fits, F.round(2.0 * shared / (n + F.size(w["t"]["pairs"])), 6)).otherwise(-1.0)
        return F.struct(w["start"].alias("start"), w["k"].alias("k"), dice.alias("dice"), shared.alias("shared"), w["t"]["name"].alias("name"), (w["start"] + w["t"]["size"]).alias("end"))

    matches = F.array_sort(F.filter(F.transform(windows, scored), lambda m: m["dice"] >= threshold))
    none = F.struct(*(F.lit(v).alias(c) for c, v in (("dice", -1.0), ("shared", 0), ("name", ""), ("end", -(1 << 30)))))
    start = F.struct(none.alias("now"), F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("names"), F.struct(F.lit(-1.0).alias("dice"), F.lit("").alias("name")).alias("top"))

    def closed(acc: Column) -> Column:
        """The state after the current match, if there is one, is counted."""
        now, top = acc["now"], acc["top"]
        better = (now["dice"] > top["dice"]) | ((now["dice"] == top["dice"]) & (now["name"] < top["name"]))
        counted = F.struct(none.alias("now"), (acc["n"] + 1).alias("n"), F.array_union(acc["names"], F.array(now["name"])).alias("names"), F.when(better, F.struct(now["dice"].alias("dice"), now["name"].alias("name"))).otherwise(top).alias("top"))
        return F.when(now["dice"] >= 0, counted).otherwise(acc)

    def step(acc: Column, x: Column) -> Column:
        now, new = acc["now"], F.struct(*(x[c].alias(c) for c in ("dice", "shared", "name", "end")))
        wins = (x["shared"] > now["shared"]) | ((x["shared"] == now["shared"]) & ((x["dice"] > now["dice"]) | ((x["dice"] == now["dice"]) & (x["name"] < now["name"]))))
        kept = F.struct(F.when(wins, new).otherwise(now).alias("now"), acc["n"].alias("n"), acc["names"].alias("names"), acc["top"].alias("top"))
        done = closed(acc)
        moved = F.struct(new.alias("now"), done["n"].alias("n"), done["names"].alias("names"), done["top"].alias("top"))
        return F.when(x["start"] < now["end"], kept).otherwise(moved)

    found = some.select(id_col, F.aggregate(matches, start, step, closed).alias("f"))
    return found.select(
        id_col,
        F.col("f.n").alias("n_matches"),
        F.nullif(F.col("f.top.name"), F.lit("")).alias("license"),
        F.when(F.col("f.top.dice") >= 0, F.col("f.top.dice")).alias("dice"),
        F.array_join(F.array_sort("f.names"), ",").alias("licenses"),
    )


def license_sql(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same scan of ``documents`` in DuckDB SQL, over all pairs of words of all texts."""
    known = compiled(templates, threshold)
    rows = ", ".join(f"({k}, '{p}')" for k, t in enumerate(known) for p in t.pairs)
    calls = ", ".join(f"({k}, '{p}', {i})" for k, t in enumerate(known) for p, i in t.anchors)
    names = ", ".join(f"({k}, '{t.name}', {len(t.pairs)}, {t.size}, {t.least}, {t.most})" for k, t in enumerate(known))
    return rf"""
WITH RECURSIVE lib(k, pair) AS (VALUES {rows}),
anchors(k, pair, place) AS (VALUES {calls}),
templates(k, name, m, size, least, most) AS (VALUES {names}),
d AS (SELECT row_number() OVER () AS r, doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9À-ɏ]+', ' ', 'g')), ' ') AS w FROM documents),
pairs AS (SELECT r, i - 1 AS i, w[i] || ' ' || w[i + 1] AS pair FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM d)),
windows AS (SELECT DISTINCT r, k, i - place AS start FROM pairs JOIN anchors USING (pair)),
own AS (SELECT DISTINCT r, w.k, start, pair FROM windows w JOIN templates t USING (k) JOIN pairs USING (r) WHERE i >= start AND i < start + size),
sizes AS (SELECT r, own.k, start, count(*) AS n, count(lib.pair) AS shared FROM own LEFT JOIN lib ON lib.k = own.k AND lib.pair = own.pair GROUP BY ALL),
scored AS (
  SELECT r, start, k, name, shared, start + size AS until, round(2.0 * shared / (n + m), 6)::DOUBLE AS dice FROM sizes JOIN templates USING (k) WHERE n BETWEEN least AND most
),
matches AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY start, k) AS q FROM scored WHERE dice >= {threshold}),
fold AS (
  SELECT r, q, dice, shared, name, until, NULL::DOUBLE AS done_dice, NULL::VARCHAR AS done_name FROM matches WHERE q = 1
  UNION ALL
  SELECT f.r, x.q,
    CASE WHEN keep THEN f.dice ELSE x.dice END, CASE WHEN keep THEN f.shared ELSE x.shared END, CASE WHEN keep THEN f.name ELSE x.name END, CASE WHEN keep THEN f.until ELSE x.until END,
    CASE WHEN x.start >= f.until THEN f.dice END, CASE WHEN x.start >= f.until THEN f.name END
  FROM fold f JOIN matches x ON x.r = f.r AND x.q = f.q + 1,
    LATERAL (SELECT x.start < f.until AND NOT (x.shared > f.shared OR x.shared = f.shared AND (x.dice > f.dice OR x.dice = f.dice AND x.name < f.name)) AS keep)
),
kept AS (
  SELECT r, done_dice AS dice, done_name AS name FROM fold WHERE done_name IS NOT NULL
  UNION ALL
  SELECT r, dice, name FROM fold WHERE (r, q) IN (SELECT (r, max(q)) FROM matches GROUP BY r)
),
by_row AS (SELECT r, count(*) AS n_matches, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, arg_min(name, (-dice, name)) AS license, max(dice) AS dice FROM kept GROUP BY r)
SELECT doc_id, coalesce(n_matches, 0) AS n_matches, license, dice, coalesce(licenses, '') AS licenses
FROM d LEFT JOIN by_row USING (r)
"""

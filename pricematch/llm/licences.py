"""Licence notices in texts: Dice coefficient over word bigrams against templates; built-in expressions alone."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Public licence notices, by SPDX id.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: The notices that ``windows`` looks for: those above and more.
NOTICES = TEMPLATES + (
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _template_bigrams(text: str) -> list[str]:
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def normal(text: Column) -> Column:
    """A-Z in lower case; everything but a-z and 0-9 is a gap of one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+", " "))


def bigrams(words: Column) -> Column:
    """The distinct pairs of neighbouring words."""
    return F.array_distinct(F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1))))


def scan(docs: DataFrame, percent: int = 80, templates: tuple[tuple[str, str], ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, licence, passage, n_shared, n_passage, n_template``: a row for each distinct passage of a text
    and template with ``200 * shared >= percent * (passage + template)`` distinct word bigrams.

    Passages are the text's lines, its paragraphs (cut at empty lines) and the whole text. A passage is
    compared with a template only if their sizes allow such a score: the smaller holds at least
    ``percent / (200 - percent)`` of the larger. No row leaves its task; templates are literals.

    Null or blank text: no passage. Null and repeated ids: a row each. Several templates of one licence can
    match one passage: a row each. Very long texts are compared whole. No rows: none. Other columns are not read.
    """
    sets = [(name, _template_bigrams(text)) for name, text in templates]
    low = min(-(-percent * len(b) // (200 - percent)) for _, b in sets)
    high = max(len(b) * (200 - percent) // percent for _, b in sets)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    passages = F.array_distinct(F.concat(F.split("t", "\n"), F.split("t", "\n\n"), F.array("t")))

    def compared(passage: Column) -> Column:
        """A struct for each template that matches, else null."""

        def against(pairs: Column) -> Column:
            found = []
            for k, (name, template) in enumerate(sets):
                size, n = len(template), F.size(pairs)
                fits = (n >= -(-percent * size // (200 - percent))) & (n <= size * (200 - percent) // percent)
                shared = F.when(fits, F.size(F.array_intersect(pairs, F.array(*map(F.lit, template))))).otherwise(F.lit(0))
                found.append(F.struct(F.lit(k).alias("k"), F.lit(name).alias("licence"), passage.alias("passage"), shared.cast("long").alias("n_shared"), n.cast("long").alias("n_passage"), F.lit(size).cast("long").alias("n_template")))
            return F.filter(F.array(*found), lambda m: 200 * m["n_shared"] >= percent * (m["n_passage"] + m["n_template"]))

        def sized(words: Column) -> Column:
            return F.when(F.size(words) > low, let(bigrams(words), lambda p: F.when(F.size(p).between(low, high), against(p))))

        return let(F.split(normal(passage), " "), sized)

    matches = F.flatten(F.filter(F.transform(passages, compared), lambda m: m.isNotNull()))
    rows = rows.select("doc_id", F.explode(matches).alias("m"))
    return rows.select("doc_id", "m.licence", "m.passage", "m.n_shared", "m.n_passage", "m.n_template")


def windows(docs: DataFrame, percent: int = 80, templates: tuple[tuple[str, str], ...] = NOTICES, widths: tuple[float, ...] = (1.0, 1.25, 1.5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, licence, template, start, passage, n_shared, n_passage, n_template``: notices wherever they are in a
    text, whatever its lines and paragraphs.

    A window starts at a word pair of the template, holds at most a ``widths`` multiple of the template's pairs and ends
    at its last pair of the template. It is scored as a passage of ``scan``. Of a template's windows that reach
    ``percent``, the best is taken, of equals the first, then the best of those that share no pair with it, and so on.
    ``template`` is the template's number, ``start`` the window's first word, counted from 0 over the text in lower case
    with everything but a-z and 0-9 as gaps, and ``passage`` its words.

    Such a window shares at least ``percent / (200 - percent)`` of the template's distinct pairs, so only texts with that
    many of them anywhere are cut into windows. No row leaves its task; templates are literals.

    Null or blank text: no row. Null and repeated ids: rows for each. A notice in a text several times: a row for each
    place. Notices that differ in a word, or hold another, can match in one place: a row each. Very long texts are read
    whole. No rows: none. Other columns are not read.
    """
    sets = [(name, _template_bigrams(text), len(re.sub("[^a-z0-9]+", " ", text.lower()).split()) - 1) for name, text in templates]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    literals = lambda pairs: F.array(*map(F.lit, pairs))
    least = lambda pairs: -(-percent * len(pairs) // (200 - percent))

    def pairs_of(words: Column) -> Column:
        return F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))

    def likely(known: Column) -> Column:
        return F.array_compact(F.array(*(F.when(F.size(F.array_intersect(known, literals(pairs))) >= least(pairs), F.lit(k)) for k, (_, pairs, _) in enumerate(sets))))

    every = sorted({p for _, pairs, _ in sets for p in pairs})
    known = let(F.split(normal(F.col("t")), " "), lambda w: F.array_intersect(pairs_of(w), literals(every)))
    # An outer explode, as the optimizer would add a filter to an inner one that computes its input again.
    rows = rows.select("doc_id", "t", F.explode_outer(let(known, likely)).alias("k")).where("k IS NOT NULL")
    fixed = F.array(*(F.struct(F.lit(name).alias("licence"), literals(pairs).alias("pairs"), F.lit(len(pairs)).alias("size"), F.lit(least(pairs)).alias("least"), F.array(*(F.lit(int(c * n)) for c in widths)).alias("widths")) for name, pairs, n in sets))

    def found(w: Column, p: Column, of: Column) -> Column:
        def at(hits: Column) -> Column:
            def scored(j: Column, width: Column) -> Column:
                s = F.get(hits, j)

                def window(inside: Column) -> Column:
                    shared = F.size(F.array_distinct(F.transform(inside, lambda x: F.get(p, x))))
                    n = F.size(F.array_distinct(F.slice(p, s + 1, F.element_at(inside, -1) - s + 1)))
                    return let(F.struct(shared.alias("shared"), n.alias("n")), lambda c: F.when(
                        200 * c["shared"] >= percent * (c["n"] + of["size"]),
                        F.struct((-c["shared"] / (c["n"] + of["size"])).alias("order"), s.alias("s"), F.element_at(inside, -1).alias("e"), c["shared"].alias("shared"), c["n"].alias("n")),
                    ))

                reach = F.get(hits, j + of["least"] - 1)
                return F.when(reach < s + width, let(F.filter(F.slice(hits, j + 1, width), lambda x: x < s + width), window))

            numbers = F.transform(hits, lambda _, j: j)
            return F.array_distinct(F.array_compact(F.flatten(F.transform(numbers, lambda j: F.transform(of["widths"], lambda width: scored(j, width))))))

        def best(windows: Column) -> Column:
            clear = lambda taken, x: ~F.exists(taken, lambda a: (a["s"] <= x["e"]) & (x["s"] <= a["e"]))
            return F.aggregate(windows, F.slice(windows, 1, 0), lambda taken, x: F.when(clear(taken, x), F.concat(taken, F.array(x))).otherwise(taken))

        hits = F.array_compact(F.transform(p, lambda x, i: F.when(F.array_contains(of["pairs"], x), i)))
        return F.transform(
            let(F.sort_array(let(hits, at)), best),
            lambda m: F.struct(of["licence"].alias("licence"), m["s"].cast("long").alias("start"), F.array_join(F.slice(w, m["s"] + 1, m["e"] - m["s"] + 2), " ").alias("passage"), m["shared"].cast("long").alias("n_shared"), m["n"].cast("long").alias("n_passage"), of["size"].cast("long").alias("n_template")),
        )

    matches = let(F.split(normal(F.col("t")), " "), lambda w: let(pairs_of(w), lambda p: let(F.get(fixed, "k"), lambda of: found(w, p, of))))
    rows = rows.select("doc_id", F.col("k").alias("template"), F.explode_outer(matches).alias("m")).where("m IS NOT NULL")
    return rows.select("doc_id", "m.licence", "template", "m.start", "m.passage", "m.n_shared", "m.n_passage", "m.n_template")


def _templates_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return ",\n  ".join(f"({quote(name)}, [{', '.join(map(quote, _template_bigrams(text)))}])" for name, text in TEMPLATES)


SCAN_SQL = f"""
WITH templates(licence, pairs) AS (VALUES
  {_templates_sql()}
), passages AS (
  SELECT doc_id, unnest(list_distinct(string_split(t, chr(10)) || string_split(t, chr(10) || chr(10)) || [t])) AS passage
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
), cut AS (
  SELECT doc_id, passage, string_split(trim(regexp_replace(translate(passage, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM passages
), paired AS (
  SELECT doc_id, passage, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS p FROM cut
)
SELECT doc_id, licence, passage, CAST(len(list_intersect(p, pairs)) AS BIGINT) AS n_shared, CAST(len(p) AS BIGINT) AS n_passage, CAST(len(pairs) AS BIGINT) AS n_template
FROM paired JOIN templates ON 120 * len(p) >= 80 * len(pairs) AND 120 * len(pairs) >= 80 * len(p)
WHERE 200 * len(list_intersect(p, pairs)) >= 80 * (len(p) + len(pairs))
"""

"""License scans: Dice coefficient over word bigrams against licence templates.

A text is compared as a whole, by paragraph, by line, by sentence and by run of
paragraphs: for each template of several paragraphs, the longest stretches of
consecutive paragraphs that share at least half their bigrams with it. A unit is
normalised: lower case, everything but letters and digits a single space. Its set
A of word bigrams is compared to a template's set B where sizes allow it:
2|A∩B| / (|A|+|B|) >= t needs |A| between |B| t / (2-t) and |B| (2-t) / t. Sizes
thus rule out most templates, and most units altogether, before any intersection.
A coefficient of t also needs |A∩B| >= |B| t / (2-t): words that are in so many of
B's bigrams that the others are fewer than that are B's anchors, one of which every
matching unit must hold. Texts and units without an anchor of any template are passed
over before bigrams are made.

Everything is a projection of each row by built-in functions: no shuffle, no
Python. A text is normalised once, and bigrams are 64-bit hashes. The templates, a
fixed list, are one folded literal. Whole licences that run over pages (GPL,
Apache, MPL, Creative Commons) have their notices as templates, not their terms.

Defined results: null text has no licence (license null, dice null, n_licenses
0); of templates with equal best dice the first name by code point is named;
null or repeated doc_ids are rows like others; an empty table gives an empty
result. Only the named column is read.
"""

from __future__ import annotations

import json
import math
import re

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.llm.shared import packed, text_of, unpacked

DICE = 0.8

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_END = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"""
_BSD_1_2 = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""


def gnu_notice(name: str, version: str, work: str = "program") -> str:
    """The notice that the GNU licences ask for in every file."""
    return f"""This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.

This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.

You should have received a copy of the GNU {name} along with this {work}. If not, see https://www.gnu.org/licenses/."""


# Licence texts and notices (name, text).
TEMPLATES = (
    ("AGPL-3.0", gnu_notice("Affero General Public License", "3")),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    ("BSD-2-Clause", f"{_BSD}\n\n{_BSD_1_2}"),
    ("BSD-2-Clause", f"{_BSD}\n\n{_BSD_1_2}\n\n{_BSD_END}"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", f"{_BSD}\n\n{_BSD_1_2}\n\n{_BSD_3}"),
    ("BSD-3-Clause", f"{_BSD}\n\n{_BSD_1_2}\n\n{_BSD_3}\n\n{_BSD_END}"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", gnu_notice("General Public License", "2")),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", gnu_notice("General Public License", "3")),
    ("ISC", _ISC),
    ("ISC", f"{_ISC}\n\n{_ISC_END}"),
    ("LGPL-2.1", gnu_notice("Lesser General Public License", "2.1", "library")),
    ("LGPL-3.0", gnu_notice("Lesser General Public License", "3")),
    ("LGPL-3.0", gnu_notice("Lesser General Public License", "3", "library")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", f"{_MIT}\n\n{_MIT_END}\n\n{_AS_IS}"),
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", _UNLICENSE),
    ("Zlib", _ZLIB),
)


def hash_of(data: bytes, seed: int = 42) -> int:
    return xxhash.xxh64_intdigest(data, seed)


def template_words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def template_grams(text: str) -> list[int]:
    """The set of hashed bigrams, as xxhash64(xxhash64(a), xxhash64(b)) has them."""
    words = [hash_of(w.encode()).to_bytes(8, "little") for w in template_words(text)]
    pairs = dict.fromkeys(hash_of(b, hash_of(a)) for a, b in zip(words, words[1:], strict=False))
    return [p - (1 << 64) if p >> 63 else p for p in pairs]


def template_rows(dice: float) -> list[dict]:
    """name, bigrams, the sizes of sets that can reach the coefficient, and whether
    there are several paragraphs."""
    rows = []
    for name, text in TEMPLATES:
        grams = template_grams(text)
        lo, hi = math.floor(len(grams) * dice / (2 - dice)), math.ceil(len(grams) * (2 - dice) / dice)
        rows.append({"name": name, "grams": grams, "lo": lo, "hi": hi, "several": "\n\n" in text})
    return rows


#: Words that are anchors only where no others are left.
COMMON = {"at", "by", "for", "in", "is", "of", "the", "this", "to", "under", "work"}


def anchors(dice: float) -> list[str]:
    """Words of which every unit that reaches the coefficient with a template holds one:
    of each template its longest words, until too few bigrams are left without them."""
    found: set[str] = set()
    for _, text in TEMPLATES:
        words = template_words(text)
        left = set(zip(words, words[1:], strict=False))
        least = math.ceil(len(left) * dice / (2 - dice) - 1e-9)
        chosen = {w for w in found if any(w in pair for pair in left)}
        left = {pair for pair in left if not chosen & set(pair)}
        for word in sorted(set(words), key=lambda w: (w in COMMON, -len(w), w)):
            if len(left) < least:
                break
            if any(word in pair for pair in left):
                found.add(word)
                left = {pair for pair in left if word not in pair}
    return sorted(found)


# Marks of a normalised text, where a paragraph, a line or a sentence ends.
PARAGRAPH, LINE, SENTENCE = "\x01", "\x02", "\x03"


def normalised(text: Column) -> Column:
    """Lower case, every run of other characters than letters and digits a space,
    paragraphs, lines and sentences set apart by marks."""
    out = F.regexp_replace(F.lower(text), "[\x01-\x03]", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"\n(?:[ \t\r]*\n)+", PARAGRAPH), r"\n", LINE)
    out = F.regexp_replace(out, r"[.!?][ \t]+", SENTENCE)
    return F.regexp_replace(out, r"[^\p{L}\p{N}\x01-\x03]+", " ")


def cut(norm: str, at: str) -> Column:
    """A normalised text in pieces at the marks in `at`; other marks are spaces."""
    pieces = F.regexp_replace(norm, f"[^{at}\\p{{L}}\\p{{N}}]+", " ")
    return F.split(pieces, f"[{at}]") if at else F.array(pieces)


def grams_of(unit: Column) -> Column:
    """The set of hashed word bigrams of a unit."""
    hashes = F.transform(F.split(F.trim(unit), " +"), lambda w: F.xxhash64(w))
    # The hashes are bound once, as the only element of an array.
    paired = F.transform(F.array(hashes), lambda h: F.zip_with(F.slice(h, 1, F.size(h) - 1), F.slice(h, 2, F.size(h)), lambda a, b: F.xxhash64(a, b)))
    return F.array_distinct(F.element_at(paired, 1))


def runs_of(paragraphs: str, grams: Column) -> Column:
    """The sets of the stretches of two or more paragraphs that share at least half
    their bigrams with a template each."""
    fits = lambda s: (F.size(s) > 0) & (2 * F.size(F.array_intersect(s, grams)) >= F.size(s))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<bigint>").alias("open"), F.array().cast("array<array<bigint>>").alias("done"))
    close = lambda x: F.when(x["n"] > 1, F.concat(x["done"], F.array(x["open"]))).otherwise(x["done"])
    grown = lambda x, s: F.struct((x["n"] + 1).alias("n"), F.array_union(x["open"], s).alias("open"), x["done"].alias("done"))
    closed = lambda x: F.struct(F.lit(0).alias("n"), F.array().cast("array<bigint>").alias("open"), close(x).alias("done"))
    return F.aggregate(paragraphs, start, lambda x, s: F.when(fits(s), grown(x, s)).otherwise(closed(x)), close)


def with_license(docs: DataFrame, *, text_col: str = "text", dice: float = DICE) -> DataFrame:
    """docs with license, dice and n_licenses (different licences found); these
    replace columns of the same names."""
    rows = template_rows(dice)
    least, most = min(r["lo"] for r in rows), max(r["hi"] for r in rows)
    kind = "array<struct<name:string,grams:array<bigint>,lo:int,hi:int,several:boolean>>"
    templates = F.from_json(F.lit(json.dumps(rows)), kind)
    every = F.from_json(F.lit(json.dumps(sorted({g for r in rows if r["several"] for g in r["grams"]}))), "array<bigint>")
    one_of = "|".join(anchors(dice))
    wanted = F.lower(text_of("text")).rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{one_of})(?![\p{{L}}\p{{N}}])")
    out = packed(docs, text_col).withColumn("_norm", normalised(F.when(wanted, text_of("text")).otherwise("")))
    out = out.withColumn("_paragraphs", F.transform(cut("_norm", PARAGRAPH), grams_of))
    units = F.array_distinct(F.concat(cut("_norm", ""), cut("_norm", PARAGRAPH + LINE), cut("_norm", PARAGRAPH + LINE + SENTENCE)))
    units = F.filter(units, lambda u: u.rlike(rf"(?:^| )(?:{one_of})(?: |$)"))
    out = out.withColumn("_sets", F.concat("_paragraphs", F.transform(units, grams_of)))
    # Runs are looked for only where two paragraphs or more are half made of licences' bigrams.
    several = F.size(F.filter("_paragraphs", lambda s: (F.size(s) > 0) & (2 * F.size(F.array_intersect(s, every)) >= F.size(s)))) > 1
    runs = F.flatten(F.transform(F.filter(templates, lambda t: t["several"]), lambda t: runs_of("_paragraphs", t["grams"])))
    out = out.withColumn("_sets", F.filter("_sets", lambda s: F.size(s).between(least, most)))
    out = out.withColumn("_runs", F.when(several, F.filter(runs, lambda s: F.size(s).between(least, most)))).drop("_paragraphs", "_norm")
    out = out.withColumn("_sets", F.when(F.col("_runs").isNull(), F.col("_sets")).otherwise(F.concat("_sets", "_runs"))).drop("_runs")

    def hits(grams: Column) -> Column:
        fitting = F.filter(templates, lambda t: F.size(grams).between(t["lo"], t["hi"]))
        value = lambda t: 2 * F.size(F.array_intersect(grams, t["grams"])) / (F.size(grams) + F.size(t["grams"]))
        return F.transform(fitting, lambda t: F.struct(value(t).alias("dice"), t["name"].alias("name")))

    found = F.filter(F.flatten(F.transform("_sets", hits)), lambda h: h["dice"] >= dice)
    out = out.withColumn("_found", found).drop("_sets")
    out = out.withColumn("dice", F.array_max(F.transform("_found", lambda h: h["dice"])))
    out = out.withColumn("license", F.array_min(F.transform(F.filter("_found", lambda h: h["dice"] == F.col("dice")), lambda h: h["name"])))
    out = out.withColumn("n_licenses", F.size(F.array_distinct(F.transform("_found", lambda h: h["name"]))).cast("long"))
    return unpacked(out, docs.columns, ["license", "dice", "n_licenses"])


def oracle(table: str, dice: float = DICE) -> str:
    """DuckDB SQL for doc_id, license, dice, n_licenses of a table."""
    values = ", ".join("('{}', '{}', {})".format(n, " ".join(template_words(t)), "\n\n" in t) for n, t in TEMPLATES)
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    words = r"string_split(trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"
    sentences = r"string_split(regexp_replace(t, '[.!?][ \t]+', chr(10), 'g'), chr(10))"
    return rf"""
WITH templates AS (SELECT name, several, {grams} AS tg FROM (SELECT name, several, string_split(body, ' ') AS w FROM (VALUES {values}) v(name, body, several))),
docs AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM {table}),
units AS (SELECT r, unnest(list_distinct([t] || string_split(t, chr(10)) || {sentences})) AS u FROM docs),
cuts AS (SELECT r, string_split_regex(t, '
([ 	
]*
)+') AS ps FROM docs),
paragraphs AS (SELECT r, unnest(ps) AS u, generate_subscripts(ps, 1) AS pos FROM cuts),
own AS (SELECT r, pos, {grams} AS g FROM (SELECT r, pos, {words.format("u")} AS w FROM paragraphs) x WHERE len(w) > 1),
inside AS (
  SELECT r, pos, g, name, tg, pos - row_number() OVER (PARTITION BY r, tg ORDER BY pos) AS island
  FROM own JOIN templates ON several AND 2 * len(list_intersect(g, tg)) >= len(g)),
runs AS (SELECT r, list_distinct(flatten(list(g ORDER BY pos))) AS g FROM inside GROUP BY r, tg, island HAVING count(*) > 1),
sets AS (SELECT r, {grams} AS g FROM (SELECT r, {words.format("u")} AS w FROM units) x WHERE len(w) > 1
  UNION ALL SELECT r, g FROM own UNION ALL SELECT r, g FROM runs),
hits AS (
  SELECT r, name, 2 * len(list_intersect(g, tg)) / (len(g) + len(tg))::DOUBLE AS dice
  FROM sets JOIN templates ON len(g) <= 3 * len(tg) WHERE dice >= {dice}),
best AS (SELECT r, max(dice) AS dice, count(DISTINCT name) AS n_licenses FROM hits GROUP BY r),
named AS (SELECT b.r, b.dice, b.n_licenses, min(h.name) AS license FROM best b JOIN hits h ON h.r = b.r AND h.dice = b.dice GROUP BY ALL)
SELECT doc_id, license, dice, coalesce(n_licenses, 0) AS n_licenses FROM docs LEFT JOIN named USING (r)
"""

"""Licence scans: passages compared with licence templates by the Dice coefficient of their word bigrams.

The passages of a text are its lines, its paragraphs (parted by blank lines) and the whole.
Two bigram sets can only reach a coefficient of t if neither has more than (2 - t) / t times
as many as the other, so by its size a passage is compared with few templates, mostly none.
Notices that stand within a longer line are found by runs of words around a licence word.

A passage that reaches t has at least t / (2 - t) of a template's bigrams. So some words
that more than the rest of each template's bigrams have in them are looked for first: a
text without any of these words matches nothing.

All is done row by row with array functions; nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Most words of a template that is looked for within lines, and what every one of them has.
NOTICE_WORDS, LICENCE_WORD = 24, "licen[cs][a-z0-9]*|domain|reserved"
#: Words that say little, which are chosen last to tell which texts may have a licence.
_COMMON = frozenset("0 1 2 3 4 5 6 7 8 9 10 a all an and any are as at be by can copy for form free from if in including is it may must no not of on or other out provided shall that the their this to under use we with you your".split())
#: Fewest bigrams of a paragraph that stands for its licence.
_PARAGRAPH = 8


@dataclass(frozen=True)
class Template:
    license: str
    kind: str
    text: str


# Published licence texts, with their paragraphs, and the usual notices.
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT = f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

{_AS_IS}"""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""
_GNU = """This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} License as
published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version.

This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} License for more details.

You should have received a copy of the GNU {1} License along with this {0}. If not, see https://www.gnu.org/licenses/."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_BSL = f"""Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the
following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the
Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source
language processor.

{_AS_IS.replace("AND NONINFRINGEMENT", "TITLE AND NON-INFRINGEMENT")}"""
_UNLICENSE = f"""This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in
the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs
and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to
this software under copyright law.

{_AS_IS}"""
_CC = "Creative Commons {0} 4.0 International"
_TEXTS = (
    Template("MIT", "permissive", _MIT),
    Template("ISC", "permissive", _ISC),
    Template("BSD-2-Clause", "permissive", _BSD_GRANT + _BSD_END),
    Template("BSD-3-Clause", "permissive", _BSD_GRANT + _BSD_NAMES + _BSD_END),
    Template("Zlib", "permissive", _ZLIB),
    Template("BSL-1.0", "permissive", _BSL),
    Template("Apache-2.0", "permissive", _APACHE),
    Template("MPL-2.0", "weak copyleft", _MPL),
    Template("GPL-2.0", "copyleft", _GNU.format("program", "General Public", "2")),
    Template("GPL-3.0", "copyleft", _GNU.format("program", "General Public", "3")),
    Template("LGPL-3.0", "weak copyleft", _GNU.format("library", "Lesser General Public", "3")),
    Template("AGPL-3.0", "copyleft", _GNU.format("program", "Affero General Public", "3")),
    Template("Unlicense", "permissive", _UNLICENSE),
)
_NOTICES = (
    Template("MIT", "permissive", "Released under the MIT License."),
    Template("MIT", "permissive", "Licensed under the MIT License."),
    Template("MIT", "permissive", "This project is licensed under the terms of the MIT license."),
    Template("ISC", "permissive", "Licensed under the ISC License."),
    Template("BSL-1.0", "permissive", "Distributed under the Boost Software License, Version 1.0."),
    Template("BSD-3-Clause", "permissive", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    Template("BSD-3-Clause", "permissive", "Licensed under the BSD 3-Clause License."),
    Template("BSD-2-Clause", "permissive", "Licensed under the BSD 2-Clause License."),
    Template("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    Template("Apache-2.0", "permissive", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    Template("MPL-2.0", "weak copyleft", "Licensed under the Mozilla Public License, version 2.0."),
    Template("MPL-2.0", "weak copyleft", "Mozilla Public License Version 2.0"),
    Template("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3."),
    Template("GPL-3.0", "copyleft", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    Template("GPL-2.0", "copyleft", "This work is licensed under the GNU General Public License, version 2."),
    Template("GPL-2.0", "copyleft", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    Template("LGPL-3.0", "weak copyleft", "This work is licensed under the GNU Lesser General Public License, version 3."),
    Template("LGPL-3.0", "weak copyleft", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    Template("AGPL-3.0", "copyleft", "This work is licensed under the GNU Affero General Public License, version 3."),
    Template("AGPL-3.0", "copyleft", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    Template("CC-BY-4.0", "permissive", "Licensed under CC BY 4.0."),
    Template("CC-BY-4.0", "permissive", f"This work is licensed under a {_CC.format('Attribution')} License."),
    Template("CC-BY-SA-4.0", "copyleft", "Licensed under CC BY-SA 4.0."),
    Template("CC-BY-SA-4.0", "copyleft", f"This work is licensed under a {_CC.format('Attribution-ShareAlike')} License."),
    Template("CC-BY-NC-4.0", "restricted", "Licensed under CC BY-NC 4.0."),
    Template("CC-BY-NC-4.0", "restricted", f"This work is licensed under a {_CC.format('Attribution-NonCommercial')} License."),
    Template("CC-BY-ND-4.0", "restricted", "Licensed under CC BY-ND 4.0."),
    Template("CC-BY-ND-4.0", "restricted", f"This work is licensed under a {_CC.format('Attribution-NoDerivatives')} License."),
    Template("CC0-1.0", "permissive", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    Template("All-Rights-Reserved", "restricted", "All rights reserved."),
)


def bigrams_of(text: str) -> list[str]:
    """Distinct word bigrams of a normalised text, in order."""
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def with_paragraphs(template: Template) -> list[Template]:
    """A template, and those of its paragraphs that are long enough, each as a template of the same licence."""
    parts = [Template(template.license, template.kind, p) for p in template.text.split("\n\n")]
    return [template, *(p for p in parts if len(parts) > 1 and len(bigrams_of(p.text)) >= _PARAGRAPH)]


def _unique(templates: list[Template]) -> tuple[Template, ...]:
    """Each set of bigrams once: a paragraph that several licences have tells that it's one of them."""
    same: dict[frozenset[str], list[Template]] = {}
    for t in templates:
        same.setdefault(frozenset(bigrams_of(t.text)), []).append(t)
    names = [sorted({t.license for t in of}) for of in same.values()]
    return tuple(Template(n[0] if len(n) == 1 else f"({' OR '.join(n)})", of[0].kind, of[0].text) for n, of in zip(names, same.values(), strict=True))


TEMPLATES = _unique([*(p for t in _TEXTS for p in with_paragraphs(t)), *_NOTICES])


def telling_words(templates: tuple[Template, ...], threshold: float = THRESHOLD) -> list[str]:
    """Words of which any passage that reaches the threshold with a template has one.

    They are in so many of each template's bigrams that those without them are too few; chosen one by one, the one
    that helps most first.
    """
    left = {i: (set(b), len(b) - math.ceil(len(b) * threshold / (2 - threshold) - 1e-9)) for i, t in enumerate(templates) if (b := bigrams_of(t.text))}
    chosen: list[str] = []
    while left:
        helps = Counter(w for grams, _ in left.values() for g in grams for w in set(g.split()))
        word = min(helps, key=lambda w: (w in _COMMON, -helps[w], w))
        chosen.append(word)
        for i, (grams, spare) in list(left.items()):
            gone = {g for g in grams if word in g.split()}
            if spare < len(gone):
                del left[i]
            else:
                left[i] = grams - gone, spare - len(gone)
    return chosen


def size_bounds(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Fewest and most bigrams of a passage that can reach the threshold with a template of ``n``."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


def _sizes(templates: tuple[Template, ...], threshold: float) -> list[tuple[Template, list[str], int, int]]:
    return [(t, b, *size_bounds(len(b), threshold)) for t in templates if (b := bigrams_of(t.text))]


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per input row: ``doc_id, n_passages, matches array<struct<dice, license, kind, passage>>``.

    Texts are normalised: A-Z lower-cased, all but ASCII letters and digits parts words.
    ``n_passages`` counts the distinct normalised passages; a passage matches with the
    template of the largest coefficient if that is at least ``threshold``, and of equal ones
    the last licence by name. Passages of fewer than two words match nothing. A line that
    matches nothing and has a licence word can have a notice in it: of all its runs of words
    around such a word that are as long as a short template, the one of the largest coefficient
    is its match. A null or empty text has one empty passage. Repeated rows give repeated
    results; an empty table gives an empty one; other columns are not looked at.
    """
    normal = F.lower(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "[^A-Za-z0-9\n]+", " "))
    paragraphs = F.transform(F.split("t", "\n\n+"), lambda p: F.replace(p, F.lit("\n"), F.lit(" ")))
    whole = F.regexp_replace("t", "\n+", " ")
    passages = F.array_distinct(F.transform(F.concat(F.split("t", "\n"), paragraphs, F.array(whole)), lambda p: F.trim(p)))
    sizes = _sizes(templates, threshold)
    most = max((high for *_, high in sizes), default=0)
    telling = rf"\b(?:{'|'.join(telling_words(templates, threshold)) or '(?!)'})\b"

    def bigrams(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))
        # Words that differ make at least as many bigrams that differ, but for one.
        return F.when(F.size(F.array_distinct(w)) <= most + 1, F.array_distinct(pairs))

    def best(grams: Column) -> Column:
        options = []
        for t, own, low, high in sizes:
            common = F.size(F.array_intersect(grams, F.array(*map(F.lit, own))))
            dice = 2.0 * common / (F.size(grams) + len(own))
            options.append(F.when(F.size(grams).between(low, high), F.struct(dice.alias("dice"), F.lit(t.license).alias("license"), F.lit(t.kind).alias("kind"))))
        return F.array_max(F.array(*options))

    def scored(texts: Column) -> Column:
        """(dice, license, kind, passage) of texts that reach the threshold."""
        of = F.transform(texts, lambda p: F.struct(F.when(p.rlike(telling), p).alias("p")))
        grams = F.transform(F.filter(of, lambda x: x["p"].isNotNull()), lambda x: F.struct(x["p"].alias("p"), bigrams(F.split(x["p"], " ")).alias("g")))
        found = F.transform(grams, lambda x: F.struct(x["p"].alias("p"), best(x["g"]).alias("b")))
        found = F.filter(found, lambda x: x["b"]["dice"] >= threshold)
        return F.transform(found, lambda x: F.struct(x["b"]["dice"].alias("dice"), x["b"]["license"].alias("license"), x["b"]["kind"].alias("kind"), x["p"].alias("passage")))

    lengths = notice_lengths(templates)

    def runs(line: Column) -> Column:
        """Runs of words around a licence word."""

        def around(w: Column) -> Column:
            n = F.size(w)
            at = F.filter(F.sequence(F.lit(1), n), lambda i: F.get(w, i - 1).rlike(f"^(?:{LICENCE_WORD})$"))

            def of_length(p: Column, k: Column) -> Column:
                low, high = F.greatest(F.lit(1), p - k + 1), F.least(p, n - k + 1)
                return F.when((n > k) & (low <= high), F.transform(F.sequence(low, F.greatest(low, high)), lambda i: F.array_join(F.slice(w, i, k), " "))).otherwise(F.array().cast("array<string>"))

            return F.array_distinct(F.flatten(F.transform(at, lambda p: F.flatten(F.transform(F.array(*map(F.lit, lengths)), lambda k: of_length(p, k))))))

        return F.transform(F.array(F.split(line, " ")), around)[0]

    rows = docs.select(F.col(id_col).alias("doc_id"), F.regexp_replace(normal, " ?\n ?", "\n").alias("t")).select("doc_id", "t", passages.alias("p"))
    none = F.array().cast("array<struct<dice double, license string, kind string, passage string>>")
    rows = rows.withColumn("m", F.when(F.col("t").rlike(telling), scored(F.col("p"))).otherwise(none))
    licensed = F.array_distinct(F.transform(F.filter(F.split("t", "\n"), lambda x: x.rlike(rf"\b(?:{LICENCE_WORD})\b")), lambda x: F.trim(x)))
    other = F.array_except(licensed, F.transform("m", lambda x: x["passage"]))
    notices = F.filter(F.transform(other, lambda x: F.array_max(scored(runs(x)))), lambda x: x.isNotNull()) if lengths else none
    rows = rows.withColumn("notices", F.when(F.col("t").rlike(rf"\b(?:{LICENCE_WORD})\b"), notices).otherwise(none))
    return rows.select("doc_id", F.size("p").cast("long").alias("n_passages"), F.concat("m", "notices").alias("matches"))


def digests(scanned: DataFrame) -> DataFrame:
    """``doc_id, n_passages, n_matches, licenses, best_license, best_dice`` of the rows of :func:`license_scan`."""
    top = F.array_max("matches")
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",")
    return scanned.select(
        "doc_id", "n_passages", F.size("matches").cast("long").alias("n_matches"), names.alias("licenses"), top["license"].alias("best_license"), F.round(top["dice"], 6).alias("best_dice")
    )


def notice_lengths(templates: tuple[Template, ...]) -> list[int]:
    """Words of the short templates that have a licence word."""
    words = [re.sub("[^a-z0-9]+", " ", t.text.lower()).split() for t in templates]
    return sorted({len(w) for w in words if 2 <= len(w) <= NOTICE_WORDS and any(re.fullmatch(LICENCE_WORD, x) for x in w)})


def oracle_sql(templates: tuple[Template, ...] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The digests over the table ``documents``, as DuckDB SQL without size bounds."""
    rows = ", ".join(f"('{t.license}', [{', '.join(f"'{g}'" for g in own)}])" for t, own, _, _ in _sizes(templates, threshold))
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH templates(license, grams) AS (VALUES {rows}),
norm AS (SELECT doc_id, regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\\n]+', ' ', 'g') AS t FROM documents),
parts AS (SELECT doc_id, t, list_distinct(list_transform(list_concat(string_split(t, chr(10)), string_split_regex(t, '\\n ?(?:\\n ?)+'), [t]), lambda p: trim(regexp_replace(p, '[ \\n]+', ' ', 'g')))) AS ps FROM norm),
one AS (SELECT doc_id, unnest(ps) AS p FROM parts),
words AS (SELECT doc_id, p, string_split(p, ' ') AS w FROM one WHERE contains(p, ' ')),
grams AS (SELECT doc_id, p, {grams} AS g FROM words),
scored AS (SELECT doc_id, p, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice, license FROM grams, templates WHERE list_has_any(g, grams)),
best AS MATERIALIZED (SELECT doc_id, p, max({{'dice': dice, 'license': license}}) AS b FROM scored WHERE dice >= {threshold} GROUP BY doc_id, p),
lines AS (SELECT DISTINCT doc_id, trim(l) AS l FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM norm) WHERE regexp_matches(l, '\\b({LICENCE_WORD})\\b')),
others AS (SELECT doc_id, l, string_split(l, ' ') AS ws FROM lines ANTI JOIN best ON best.doc_id = lines.doc_id AND best.p = lines.l),
starts AS (SELECT doc_id, l, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM others, (SELECT unnest({notice_lengths(templates)}) AS k) WHERE len(ws) > k),
runs AS (SELECT DISTINCT doc_id, l, ws[i:i + k - 1] AS w FROM starts WHERE len(list_filter(ws[i:i + k - 1], lambda x: regexp_full_match(x, '{LICENCE_WORD}'))) > 0),
run_grams AS (SELECT doc_id, l, {grams} AS g FROM runs),
run_scored AS (SELECT doc_id, l, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice, license FROM run_grams, templates WHERE list_has_any(g, grams)),
matches AS (SELECT doc_id, b FROM best UNION ALL SELECT doc_id, max({{'dice': dice, 'license': license}}) AS b FROM run_scored WHERE dice >= {threshold} GROUP BY doc_id, l),
found AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT b.license, ',' ORDER BY b.license) AS licenses, max(b) AS top FROM matches GROUP BY doc_id)
SELECT doc_id, len(ps)::BIGINT AS n_passages, coalesce(n, 0)::BIGINT AS n_matches, coalesce(licenses, '') AS licenses, top.license AS best_license, round(top.dice, 6) AS best_dice
FROM parts LEFT JOIN found USING (doc_id)"""

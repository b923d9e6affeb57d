"""License scans: lines and paragraphs compared with licence templates by Dice coefficient over word bigrams.

Texts are normalised (lower case, runs of anything but letters and digits are one space). Each line, and each paragraph of
more than one line (what blank lines part), is a unit. A unit and a template are sets of word bigrams; their Dice coefficient is twice the
common ones by the sum of both sizes. For a coefficient of t, the sizes can differ by a factor of (2 - t) / t at most, so for
each unit only templates of a fitting size are compared, mostly none. The best template of a unit from ``LEAST`` on is a hit.

Everything is one projection: templates are constant arrays of bigram hashes, units are handled with array functions inside
the row, and nothing is shuffled. Work is linear in the text.

Cases: null and empty texts have no units; a unit of one word has no bigram and never hits; equal coefficients go to the
alphabetically first template; rows that repeat are scanned each; other columns pass through; an empty table gives an empty
table; with no templates there are no hits.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import table, whole

LEAST = 0.8

#: Notices as their licences word them, the paragraphs that blank lines part them into, and some customary short forms.
#: Paragraphs that several licences or versions share bear the family's name. name -> (licence, text)
TEMPLATES = {
    "apache-2.0-notice": ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    "apache-2.0-notice-1": ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    "apache-2.0-notice-3": ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    "apache-2.0-short": ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    "bsd-2-clause-terms": ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    "bsd-clauses": ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    "bsd-clauses-1": ("BSD", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    "bsd-clauses-2": ("BSD", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    "bsd-short": ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    "cc-by-4.0-short": ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc-4.0-short": ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    "cc-by-sa-4.0-short": ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "gpl-3.0-notice": ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "gpl-3.0-notice-1": ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "gpl-notice-2": ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "gpl-3.0-short": ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    "isc": ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    "isc-1": ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "mit": ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    "mit-short": ("MIT", "Released under the MIT License."),
    "mpl-2.0-notice": ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
}

OTHER = r"[^\p{L}\p{N}\n]+"


def bigrams(words: Column) -> Column:
    """Distinct bigrams of an array of words, as hashes."""
    some = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, 1, some), F.slice(words, 2, some), lambda a, b: F.xxhash64(a, b)))


def template_bigrams(text: str) -> list[int]:
    """The same of a template, on the driver."""
    import regex
    from xxhash import xxh64_intdigest as xx

    words = regex.findall(r"[\p{L}\p{N}]+", text.lower())
    made = {xx(b.encode(), xx(a.encode(), 42)) for a, b in zip(words, words[1:], strict=False)}
    return sorted(x - (1 << 64) if x >> 63 else x for x in made)


def size_bounds(size: int, least: float) -> tuple[int, int]:
    """Sizes of units that can reach the coefficient with a template of this size."""
    return math.ceil(size * least / (2 - least) - 1e-9), math.floor(size * (2 - least) / least + 1e-9)


def _best(grams: Column, templates: dict, least: float) -> Column:
    """The best template of a unit as struct(dice, k), k the negative place of the name; null: none reaches ``least``."""
    found = []
    for k, name in enumerate(sorted(templates)):
        mine = template_bigrams(templates[name][1])
        low, high = size_bounds(len(mine), least)
        common = F.size(F.array_intersect(grams, F.array(*map(F.lit, mine)).cast("array<bigint>")))
        dice = 2.0 * common / (F.size(grams) + len(mine))
        found.append(F.when(F.size(grams).between(low, high), F.struct(dice.alias("dice"), F.lit(-k).alias("k"))))
    best = F.array_max(F.array(*found))
    return F.when(best["dice"] >= least, best)


def _hits(units: str, kind: str, templates: dict, least: float) -> Column:
    names = sorted(templates)
    name_of = F.array(*map(F.lit, names))
    scored = F.transform(F.transform(units, lambda u: bigrams(F.array_remove(F.split(u, " "), ""))), lambda g: _best(g, templates, least))
    placed = F.transform(scored, lambda b, i: F.when(b.isNotNull(), F.struct(F.lit(kind).alias("unit"), i.alias("at"), F.get(name_of, -b["k"]).alias("template"), b["dice"].alias("dice"))))
    return F.filter(placed, lambda h: h.isNotNull())


def scan(docs: DataFrame, templates: dict[str, tuple[str, str]] | None = None, least: float = LEAST, text_col: str = "text") -> DataFrame:
    """docs with ``hits``: array of (unit 'line' or 'paragraph', at: its number from 0, template, dice)."""
    templates = TEMPLATES if templates is None else templates
    if not templates:
        return docs.withColumn("hits", F.array().cast("array<struct<unit:string,at:int,template:string,dice:double>>"))
    rows = docs.withColumn("__n", F.regexp_replace(F.lower(whole(text_col)), OTHER, " "))
    rows = rows.withColumns({"__l": F.split("__n", "\n"), "__p": F.transform(F.split("__n", r"\n *\n[ \n]*"), lambda p: F.when(p.contains("\n"), F.regexp_replace(p, "\n", " ")).otherwise(""))})
    return rows.withColumn("hits", F.concat(_hits("__l", "line", templates, least), _hits("__p", "paragraph", templates, least))).drop("__n", "__l", "__p")


def summary(scanned: DataFrame, templates: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """scanned with n_hits, template, license and dice of the best hit (null: none; ties go to the first name)."""
    templates = TEMPLATES if templates is None else templates
    names = sorted(templates)
    if not names:
        blank = F.lit(None).cast("string")
        return scanned.withColumns({"n_hits": F.lit(0).cast("bigint"), "template": blank, "license": blank, "dice": F.lit(None).cast("double")})
    place = F.array(*map(F.lit, names))
    best = F.array_max(F.transform("hits", lambda h: F.struct(h["dice"].alias("dice"), (-F.array_position(place, h["template"])).alias("k"))))
    at = (-best["k"] - 1).cast("int")
    license_of = F.array(*[F.lit(templates[n][0]) for n in names])
    return scanned.withColumns({"n_hits": F.size("hits").cast("bigint"), "template": F.get(place, at), "license": F.get(license_of, at), "dice": best["dice"]})


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return summary(scan(docs)).select("doc_id", "n_hits", "template", "license", "dice")


def _values() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({quote(n)}, {quote(lic)}, {quote(t)})" for n, (lic, t) in TEMPLATES.items())


_GRAMS = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
QUERIES = {"op4_license_scan": op4_license_scan}
ORACLES = {
    "op4_license_scan": rf"""
WITH tpl AS (
  SELECT name, license, {_GRAMS} AS g
  FROM (SELECT name, license, regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+') AS w FROM (VALUES {_values()}) v(name, license, t))),
norm AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS n FROM documents),
unit AS (
  SELECT doc_id, u FROM (SELECT doc_id, unnest(string_split(n, chr(10))) AS u FROM norm)
  UNION ALL
  SELECT doc_id, replace(p, chr(10), ' ') AS u FROM (SELECT doc_id, unnest(regexp_split_to_array(n, '\n *\n[ \n]*')) AS p FROM norm) WHERE contains(p, chr(10))),
grams AS (
  SELECT doc_id, g FROM (SELECT doc_id, {_GRAMS} AS g FROM (SELECT doc_id, regexp_extract_all(u, '[\p{{L}}\p{{N}}]+') AS w FROM unit))
  WHERE len(g) > 0),
scored AS (
  SELECT grams.doc_id, tpl.name, tpl.license, 2.0::DOUBLE * len(list_intersect(grams.g, tpl.g)) / (len(grams.g) + len(tpl.g)) AS dice,
         row_number() OVER (PARTITION BY grams.doc_id, grams.rid ORDER BY 2.0::DOUBLE * len(list_intersect(grams.g, tpl.g)) / (len(grams.g) + len(tpl.g)) DESC, tpl.name) AS r
  FROM (SELECT *, row_number() OVER () AS rid FROM grams) grams JOIN tpl
    ON len(grams.g) * {LEAST} <= (2 - {LEAST}) * len(tpl.g) + 1e-6 AND len(tpl.g) * {LEAST} <= (2 - {LEAST}) * len(grams.g) + 1e-6),
hit AS (
  SELECT doc_id, name, license, dice, count(*) OVER (PARTITION BY doc_id) AS n_hits,
         row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, name) AS r2
  FROM scored WHERE r = 1 AND dice >= {LEAST})
SELECT d.doc_id, coalesce(h.n_hits, 0) AS n_hits, h.name AS template, h.license, h.dice
FROM documents d LEFT JOIN hit h ON h.doc_id = d.doc_id AND h.r2 = 1"""
}

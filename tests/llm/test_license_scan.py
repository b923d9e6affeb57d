import random

import pytest
import regex

from tidemark.llm import license_scan as S


def grams(text):
    w = regex.findall(r"[\p{L}\p{N}]+", text.lower())
    return set(zip(w, w[1:], strict=False))


def brute(text, templates):
    lines = (text or "").split("\n")
    paragraphs = regex.split(r"\n[^\p{L}\p{N}\n]*\n(?:[^\p{L}\p{N}])*", text or "")
    hits = []
    for kind, units in (("line", lines), ("paragraph", paragraphs)):
        for i, u in enumerate(units):
            g = grams(u)
            if kind == "paragraph" and "\n" not in u:
                continue
            best = max(((2 * len(g & t) / (len(g) + len(t)), -k, n) for k, (n, t) in enumerate(sorted((n, grams(x[1])) for n, x in templates.items()))), default=(0,))
            if best[0] >= S.LEAST:
                hits.append((kind, i, best[2], best[0]))
    return hits


def test_against_brute_force(spark):
    rng, rows = random.Random(6), [(0, None), (1, ""), (2, "\n\n"), (3, "License"), (4, "RELEASED   under the\tMIT license!!"), (5, "Released under the GPL License."), (6, "x é " * 50_000)]
    names = sorted(S.TEMPLATES)
    for i in range(10, 130):
        words = S.TEMPLATES[rng.choice(names)][1].split(" ")
        for _ in range(rng.choice([0, 0, 1, 3, 20])):
            words[rng.randrange(len(words))] = rng.choice(["", "other", "the"])
        cut = rng.choice([" ", " ", "\n"])
        text = "".join(w + (cut if rng.random() < 0.15 else " ") for w in words)
        rows.append((i, rng.choice(["", "Some line before.\n", "First.\n \t\n"]) + text + rng.choice(["", "\nafter", "\n\nafter it\nmore"])))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, dice string").repartition(4)
    got = {r.doc_id: r for r in S.summary(S.scan(df)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        want = brute(text, S.TEMPLATES)
        assert [(h.unit, h["at"], h.template) for h in got[i].hits] == [w[:3] for w in want], text
        assert [h.dice for h in got[i].hits] == pytest.approx([w[3] for w in want])
        assert got[i].n_hits == len(want) and (got[i].license is None) == (not want)
    assert got[4].license == "MIT" and got[5].license is None
    assert sum(r.n_hits > 0 for r in got.values()) > 40


def test_size_bounds_lose_nothing():
    for m in range(1, 120):
        low, high = S.size_bounds(m, S.LEAST)
        for n in range(1, 250):
            if 2 * min(m, n) / (m + n) >= S.LEAST:
                assert low <= n <= high


def test_no_templates_and_empty_table(spark):
    df = spark.createDataFrame([(None, "Released under the MIT License.")] * 2, "doc_id long, text string")
    assert [r.n_hits for r in S.summary(S.scan(df, {}), {}).collect()] == [0, 0]
    assert [r.template for r in S.summary(S.scan(df)).collect()] == ["mit-short"] * 2
    assert S.scan(df.limit(0)).count() == 0


# Notices in their published layout, with blank lines between paragraphs. licence -> text
PUBLISHED = {
    "Apache-2.0": """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.""",
    "BSD": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.""",
    "GPL-3.0": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
}


def test_published_notices_of_several_paragraphs(spark):
    rows = [(i, lic, mark.join(f"\n{text}\n".splitlines(True))) for i, (lic, text) in enumerate(PUBLISHED.items()) for mark in ("", "# ")]
    got = S.summary(S.scan(spark.createDataFrame(rows, "doc_id long, want string, text string"))).collect()
    assert [r.license for r in got] == [r.want for r in got]
    notice = [h.template for r in got if r.want == "Apache-2.0" for h in r.hits if h.unit == "paragraph"]
    assert notice == ["apache-2.0-notice-1", "apache-2.0-notice-3"] * 2

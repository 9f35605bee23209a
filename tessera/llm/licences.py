"""Licence scan: normalised passages compared with licence templates by Dice coefficient over word bigrams.

A text's passages are its lines, its paragraphs (what blank lines separate) and the whole text. Notices that fill no
passage, in the midst of a line or over several paragraphs of a longer text, are found as runs of consecutive words: of
every template, runs are extended from each bigram that it shares, as long as they can still match. Two bigram sets of
sizes a and b can reach the coefficient t only if b lies between a*t/(2-t) and a*(2-t)/t, so templates, sorted by
size, are pruned by size before any bigram is compared; passages beyond the largest template's reach are not even
cut into bigrams. Shared bigrams are then counted for the remaining templates.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left, bisect_right, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.decontaminate import _WORDS, words

#: Least Dice coefficient of a match, in percent.
PERCENT = 85
_BLANK = re.compile(rb"\n[ \t\r]*\n")

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
    "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies."
)
#: (licence, text): the notices by which licences are usually granted, and short licences in full.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in "
        "the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY,
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the '
        "License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing '
        "permissions and limitations under the License.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of "
        "source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    ("ISC", _ISC),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def bigrams(w: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(w, w[1:], strict=False))


class Templates:
    """Licence templates by the size of their bigram sets, with the templates of every bigram."""

    def __init__(self, templates=TEMPLATES, percent: int = PERCENT):
        sets = sorted(((len(b), name, b) for name, text in templates if (b := bigrams(words(text.encode())))), key=lambda x: (x[0], x[1], sorted(x[2])))
        self.percent = percent
        self.sizes, self.names, self.sets = [s for s, _, _ in sets], [n for _, n, _ in sets], [b for _, _, b in sets]
        self.of: dict[tuple[bytes, bytes], list[int]] = {}
        for i, (_, _, b) in enumerate(sets):
            for g in b:
                self.of.setdefault(g, []).append(i)
        self.every = self.of.keys()
        self.largest = self.sizes[-1] * (200 - percent) // percent if sets else 0

    def best(self, w: list[bytes]) -> tuple[float, str] | None:
        """The coefficient and licence of the best template of a passage, ties to the first licence by name."""
        if len(w) < 2:
            return None
        b = bigrams(w)
        n, p = len(b), self.percent
        lo = bisect_left(self.sizes, -(-n * p // (200 - p)))
        hi = bisect_right(self.sizes, n * (200 - p) // p)
        if lo >= hi:
            return None
        shared: dict[int, int] = {}
        for g in self.every & b:
            for i in self.of[g]:
                if lo <= i < hi:
                    shared[i] = shared.get(i, 0) + 1
        found = [(-2 * k / (n + self.sizes[i]), self.names[i]) for i, k in shared.items() if 200 * k >= p * (n + self.sizes[i])]
        if not found:
            return None
        score, name = min(found)
        return -score, name

    def scan(self, text: bytes | None) -> list[tuple[str, int, int, str, float]]:
        """(kind, first byte, end, licence, coefficient) of every passage that matches."""
        if not text:
            return []
        out = []

        def look(kind, a, b):
            w = words(text[a:b])
            # distinct bigrams may be far fewer than words, so only the count of distinct ones prunes
            if len(w) > self.largest + 1 and len(bigrams(w)) > self.largest:
                return
            if hit := self.best(w):
                out.append((kind, a, b, hit[1], hit[0]))

        at = 0
        for line in text.split(b"\n"):
            look("line", at, at + len(line))
            at += len(line) + 1
        at, cuts = 0, [m.span() for m in _BLANK.finditer(text)]
        for a, b in [*cuts, (len(text), len(text))] if cuts else ():
            look("paragraph", at, a)
            at = b
        if b"\n" in text:
            look("text", 0, len(text))
        return out

    def runs(self, text: bytes | None, passages=()) -> list[tuple[str, int, int, str, float]]:
        """(kind, first byte, end, licence, coefficient) of the runs of consecutive words that match, wherever lines end.

        The best run comes first, ties to the shorter, the earlier and the first licence by name; then the best of those
        that share no word with it, and so on. A run is left out where one of ``passages`` (of ``scan``) says the same: if its
        coefficient is as high and at least half of the run's shared bigrams lie in it and in a template of its licence.
        """
        if not text:
            return []
        w = words(text)
        gs = list(zip(w, w[1:], strict=False))
        at: dict[int, list[int]] = {}
        for i, g in enumerate(gs):
            if g in self.every:
                for t in self.of[g]:
                    at.setdefault(t, []).append(i)
        heap = []
        for t, starts in at.items():
            # shared bigrams that a match needs at least: those of a run without any others
            if len(starts) * (200 - self.percent) >= self.percent * self.sizes[t] and len({gs[i] for i in starts}) * (200 - self.percent) >= self.percent * self.sizes[t]:
                heap += [x for i in starts if (x := self._run(gs, t, i, len(gs)))]
        if not heap:
            return []
        heapq.heapify(heap)
        chosen: list[tuple[int, int, int, float]] = []
        while heap:
            d, _, i, _, t, j = heapq.heappop(heap)
            k = bisect_left(chosen, (i,))
            if (k and i <= chosen[k - 1][1] + 1) or (k < len(chosen) and chosen[k][0] == i):
                continue
            if k < len(chosen) and j + 1 >= chosen[k][0]:
                if x := self._run(gs, t, i, chosen[k][0] - 1):
                    heapq.heappush(heap, x)
                continue
            insort(chosen, (i, j, t, -d))
        spans = [m.span() for m in re.finditer(rb"[^\t-\r ]+", text.translate(_WORDS))]
        begins = [a for a, _ in spans]
        said = []
        for _, a, b, name, d in passages:
            own = set().union(*(g for n, g in zip(self.names, self.sets, strict=True) if n == name))
            said.append((bisect_left(begins, a), bisect_left(begins, b) - 1, own, d))
        out = []
        for i, j, t, d in chosen:
            hits = [x for x in range(i, j + 1) if gs[x] in self.sets[t]]
            if not any(e >= d and 2 * sum(a <= x < b and gs[x] in own for x in hits) >= len(hits) for a, b, own, e in said):
                out.append(("run", spans[i][0], spans[j + 1][1], self.names[t], d))
        return out

    def matches(self, text: bytes | None) -> list[tuple[str, int, int, str, float]]:
        """The passages that match, and the runs that they do not tell of."""
        found = self.scan(text)
        return found + self.runs(text, found)

    def _run(self, gs, t: int, i: int, limit: int) -> tuple[float, int, int, str, int, int] | None:
        """The best run of template ``t`` from bigram ``i`` on that ends before bigram ``limit``, as (-coefficient, length, i, licence, t, end).

        It ends where its first bigram comes again: without the first, the run would have the same bigrams.
        """
        own, size, p = self.sets[t], self.sizes[t], self.percent
        first, seen, k, best = gs[i], set(), 0, None
        most = size * (200 - 2 * p) // p
        for j in range(i, limit):
            g = gs[j]
            if g in seen:
                if g == first:
                    break
                continue
            seen.add(g)
            if g in own:
                k += 1
                n = len(seen)
                if 200 * k >= p * (n + size) and (best is None or -2 * k / (n + size) < best[0]):
                    best = (-2 * k / (n + size), j - i, i, self.names[t], t, j)
            elif len(seen) - k > most:
                break
        return best


def _scanner(templates, percent):
    def run(batches):
        t = Templates(templates, percent)
        for batch in batches:
            found = [t.matches(x) for x in batch.column("text").cast(pa.binary()).to_pylist()]
            rows = [[{"kind": k, "start": a, "end": b, "licence": n, "dice": d} for k, a, b, n, d in f] for f in found]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("licence", pa.string()), ("dice", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "matches"])

    return run, "doc_id bigint, matches array<struct<kind:string,start:bigint,end:bigint,licence:string,dice:double>>"


def scan(docs: DataFrame, templates=TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """``doc_id, matches`` per row of ``docs``: passages and runs of words (byte spans) whose coefficient reaches ``percent`` / 100.

    Null and empty texts, and passages of one word, match nothing. Ids may be null or repeat; other columns are
    ignored; no rows give no rows.
    """
    run, schema = _scanner(tuple(templates), percent)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op4_licence_scan(spark, sf_dir: str) -> DataFrame:
    m = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return m.select(
        "doc_id", F.size("matches").cast("bigint").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct("matches.licence")), ",").alias("licences"),
        F.round(F.coalesce(F.array_max("matches.dice"), F.lit(0.0)), 6).alias("best_dice"),
    )


def _sql() -> str:
    """Passages only: equal to the query where no notice is a run inside a passage, as in the tables of sf0.01."""
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    w = lambda e: f"regexp_extract_all(translate({e}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    grams = lambda e: f"list_distinct(list_transform(range(1, len({e})), lambda i: {e}[i] || ' ' || {e}[i + 1]))"
    return f"""
with t as (select row_number() over () k, name, {grams("w")} g from (select name, {w("text")} w from (values {", ".join(f"({lit(a)}, {lit(b)})" for a, b in TEMPLATES)}) v(name, text))),
p as (
  select doc_id, unnest(string_split(text, chr(10))) x from documents
  union all select doc_id, unnest(string_split_regex(text, '\\n[ \\t\\r]*\\n')) from documents where regexp_matches(text, '\\n[ \\t\\r]*\\n')
  union all select doc_id, text from documents where contains(text, chr(10))),
b as (select row_number() over () pid, doc_id, {grams("w")} g from (select doc_id, {w("x")} w from p) where len(w) > 1),
tg as (select k, unnest(g) g from t), bg as (select pid, unnest(g) g from b where len(g) <= (select max(len(g)) * {200 - PERCENT} / {PERCENT} from t)),
s as (select pid, k, count(*) c from bg join tg using (g) group by all),
d as (select b.pid, b.doc_id, t.name, 2 * c / (len(b.g) + len(t.g)) dice, row_number() over (partition by b.pid order by 2 * c / (len(b.g) + len(t.g)) desc, t.name) r
      from s join b using (pid) join t using (k) where 200 * c >= {PERCENT} * (len(b.g) + len(t.g))),
m as (select doc_id, count(*) n, string_agg(distinct name, ',' order by name) l, max(dice) dice from d where r = 1 group by doc_id)
select doc_id, coalesce(n, 0) n_matches, coalesce(l, '') licences, round(coalesce(dice, 0.0), 6) best_dice from documents left join m using (doc_id)
"""


OP4_SQL = _sql()

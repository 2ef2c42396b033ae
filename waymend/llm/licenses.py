"""License scans: normalised text against license templates by the Dice
coefficient over word bigrams, with size bounds that prune templates.

A unit of text (a line, a paragraph between empty lines, a whole text) with u
distinct bigrams can reach a coefficient d with a template of t only if
t >= u * d / (2 - d) and t <= u * (2 - d) / d; other templates are not counted.

A notice may also stand within a longer line or run over several: windows of at
most t * (2 - d) / d bigrams that begin and end with a bigram of the template
are further units. Only where t * d / (2 - d) of the template's bigrams stand
that close together are they counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .kernels import IS_ALNUM, LOWER, Prints, Words, chunks, ranges
from .names import ddl
from .session import table

LEAST_DICE = 0.8

#: The notices of common licenses.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

#: Whole licenses without their copyright lines.
TEMPLATES |= {
    "bsd-2-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "zlib-text": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


class Templates:
    def __init__(self, texts: dict[str, str], least_dice: float):
        self.names = sorted(texts)
        self.least = least_dice
        _, values, offsets = next(chunks(pa.array([texts[n] for n in self.names]), 1 << 40))
        words = Words(LOWER[values], offsets, IS_ALNUM)
        prints = Prints(words.prints())
        sets = []
        for a, b in zip(words.bounds[:-1], words.bounds[1:]):
            at = np.arange(a, max(a, b - 1))
            sets.append(np.unique(prints.of(at, at + 2)))
        self.sizes = np.array([len(s) for s in sets])
        self.vocabulary = np.unique(np.concatenate(sets))
        self.member = np.stack([np.isin(self.vocabulary, s) for s in sets], axis=1)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def scores(self, bigrams: np.ndarray, known: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, template, coefficient) of the units of words from first to stop that reach the least coefficient."""
        before = np.concatenate([[0], np.cumsum(known)])
        end = np.maximum(stop - 1, first)
        some = np.flatnonzero(before[end] > before[first])
        none = np.zeros(0, np.int64)
        if not len(some):
            return none, none, np.zeros(0)
        size = (end - first)[some]
        unit, value = np.repeat(np.arange(len(some)), size), bigrams[ranges(first[some], size)]
        order = np.lexsort((value, unit))
        unit, value = unit[order], value[order]
        fresh = np.ones(len(unit), bool)
        fresh[1:] = (unit[1:] != unit[:-1]) | (value[1:] != value[:-1])
        unit, value = unit[fresh], value[fresh]
        n = np.bincount(unit, minlength=len(some))
        fits = (self.sizes * (2 - self.least) >= n[:, None] * self.least) & (self.sizes * self.least <= n[:, None] * (2 - self.least))
        at = np.minimum(np.searchsorted(self.vocabulary, value), len(self.vocabulary) - 1)
        hit = (self.vocabulary[at] == value) & fits.any(axis=1)[unit]
        shared = np.zeros((len(some), len(self.sizes)), np.int64)
        np.add.at(shared, unit[hit], self.member[at[hit]])
        dice = np.where(fits, 2 * shared / np.maximum(n[:, None] + self.sizes, 1), 0)
        u, t = np.nonzero(dice >= self.least)
        return some[u], t, dice[u, t]

    def windows(self, bigrams: np.ndarray, known: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Template, rows, coefficients, first words and numbers of words of the best windows, for each template that any reaches."""
        place = np.flatnonzero(known)
        at = np.minimum(np.searchsorted(self.vocabulary, bigrams[place]), len(self.vocabulary) - 1)
        row = np.searchsorted(bounds, place, "right") - 1
        real = (self.vocabulary[at] == bigrams[place]) & (place + 1 < bounds[row + 1])
        place, at, row = place[real], at[real], row[real]
        before = None
        for t, size in enumerate(self.sizes.tolist()):
            fewest = int(np.ceil(size * self.least / (2 - self.least) - 1e-9))
            most = int(size * (2 - self.least) / self.least + 1e-9)
            held = self.member[at, t]
            own, own_row = place[held], row[held]
            if not size or len(own) < fewest:
                continue
            last = len(own) - fewest + 1
            dense = np.flatnonzero((own[fewest - 1 :] - own[:last] < most) & (own_row[fewest - 1 :] == own_row[:last]))
            if not len(dense):
                continue
            if before is None:
                # Where each bigram stood before; -1 where nowhere.
                order = np.argsort(bigrams, kind="stable")
                before = np.full(len(bigrams), -1)
                same = bigrams[order[1:]] == bigrams[order[:-1]]
                before[order[1:][same]] = order[:-1][same]
            mine = np.zeros(len(bigrams), bool)
            mine[own] = True
            found = []
            for k in range(0, len(dense), 1 << 13):
                start, r = own[dense[k : k + (1 << 13)]], own_row[dense[k : k + (1 << 13)]]
                cells = start[:, None] + np.arange(most)
                inside = cells + 1 < bounds[r + 1][:, None]
                cells = np.minimum(cells, len(bigrams) - 1)
                fresh = before[cells] < start[:, None]
                n, shared = np.cumsum(fresh, axis=1), np.cumsum(fresh & mine[cells], axis=1)
                dice = np.where(inside & mine[cells], 2 * shared / (n + size), 0)
                a, b = np.nonzero(dice >= self.least)
                order = np.lexsort((b, start[a], -dice[a, b], r[a]))
                a, b = a[order], b[order]
                one = np.unique(r[a], return_index=True)[1]
                found.append((r[a[one]], dice[a[one], b[one]], start[a[one]], b[one] + 2))
            r, dice, start, words = map(np.concatenate, zip(*found))
            yield t, r, dice, start, words


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, least_dice: float = LEAST_DICE) -> DataFrame:
    """doc_id, license, dice, first_word, n_words: the best unit of each row for each license that reaches least_dice.

    Words are runs of a-z, 0-9 and characters outside ASCII after A-Z are
    lower-cased; word positions count from 0 in the row. Units are lines,
    paragraphs (split at two newlines), the whole text, and windows of up to
    a template's size bound that begin and end with a bigram of it; of equal
    coefficients the earliest, then shortest unit is named. Units of under two
    words, null and empty texts match nothing and give no row. Repeated rows
    each give theirs, null ids are kept, an empty table gives an empty table.
    Other columns are not read.
    """
    known = Templates(TEMPLATES if templates is None else templates, least_dice)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, values, offsets in chunks(batch["text"]):
                words = Words(LOWER[values], offsets, IS_ALNUM)
                if len(words.starts) < 2:
                    continue
                bigrams = np.append(Prints(words.prints()).grams(2), np.uint64(0))
                sieved = known.sieve[(bigrams >> np.uint64(44)).astype(np.int64)]
                sieved[-1] = False
                breaks = np.flatnonzero(values == 0x0A)
                # Pairs of newlines of one row, taken from the left: in a run of newlines each second one ends a pair.
                inner = np.concatenate([[0], np.flatnonzero((np.diff(breaks) > 1) | (np.searchsorted(offsets, breaks[1:], "right") != np.searchsorted(offsets, breaks[:-1], "right"))) + 1]) if len(breaks) else np.zeros(0, np.int64)
                within = ranges(np.zeros(len(inner), np.int64), np.diff(np.append(inner, len(breaks)))) if len(breaks) else np.zeros(0, np.int64)
                pairs = breaks[within % 2 == 1] - 1
                best: dict[tuple[int, int], tuple] = {}
                for cuts in (breaks + 1, pairs + 2, np.zeros(0, np.int64)):
                    edges = np.unique(np.concatenate([offsets, cuts]))
                    first = np.searchsorted(words.starts, edges[:-1])
                    stop = np.searchsorted(words.starts, edges[1:])
                    unit, template, dice = known.scores(bigrams, sieved, first, stop)
                    for u, t, d in zip(unit.tolist(), template.tolist(), dice.tolist()):
                        r = int(np.searchsorted(words.bounds, first[u], "right")) - 1
                        found = (-d, int(first[u] - words.bounds[r]), int(stop[u] - first[u]))
                        best[r, t] = min(best.get((r, t), found), found)
                for t, *cells in known.windows(bigrams, sieved, words.bounds):
                    for r, d, f, n in zip(*(c.tolist() for c in cells)):
                        found = (-d, int(f - words.bounds[r]), n)
                        best[r, t] = min(best.get((r, t), found), found)
                if not best:
                    continue
                keys = sorted(best)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].take(pa.array([r + row for r, _ in keys])), pa.array([known.names[t] for _, t in keys]),
                        pa.array([-best[k][0] for k in keys]), pa.array([best[k][1] for k in keys], pa.int64()), pa.array([best[k][2] for k in keys], pa.int64()),
                    ],
                    names=["doc_id", "license", "dice", "first_word", "n_words"],
                )

    kind = ddl(docs.schema[id_col].dataType)
    source = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    return source.mapInArrow(scan, f"doc_id {kind}, license string, dice double, first_word long, n_words long")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", "license", "dice", "first_word", "n_words")


_VALUES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))
SQL = f"""
WITH t0 (license, text) AS (VALUES {_VALUES}),
tw AS (SELECT license, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM t0),
t AS (SELECT DISTINCT license, w[i] || ' ' || w[i + 1] AS g FROM (SELECT license, w, unnest(range(1, len(w))) AS i FROM tw)),
ts AS (SELECT license, count(*) AS n FROM t GROUP BY license),
d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
parts AS (
  SELECT doc_id, kind, k, regexp_extract_all(p[k], '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM (SELECT doc_id, kind, p, unnest(range(1, len(p) + 1)) AS k FROM (
    SELECT doc_id, 'line' AS kind, string_split(x, chr(10)) AS p FROM d UNION ALL
    SELECT doc_id, 'paragraph', string_split(x, chr(10) || chr(10)) FROM d UNION ALL SELECT doc_id, 'text', [x] FROM d))
), u AS (
  SELECT *, CAST(coalesce(sum(len(w)) OVER (PARTITION BY doc_id, kind ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_word FROM parts
), g AS (
  SELECT DISTINCT doc_id, kind, k, first_word, CAST(len(w) AS BIGINT) AS n_words, w[i] || ' ' || w[i + 1] AS g FROM (SELECT *, unnest(range(1, len(w))) AS i FROM u)
), s AS (SELECT doc_id, kind, k, count(*) AS n FROM g GROUP BY ALL),
m AS (SELECT doc_id, kind, k, first_word, n_words, license, count(*) AS shared FROM g JOIN t USING (g) GROUP BY ALL),
f AS (SELECT m.*, 2.0::DOUBLE * shared / (s.n + ts.n) AS dice FROM m JOIN s USING (doc_id, kind, k) JOIN ts USING (license))
SELECT doc_id, license, dice, first_word, n_words FROM f WHERE dice >= {LEAST_DICE}
QUALIFY row_number() OVER (PARTITION BY doc_id, license ORDER BY dice DESC, first_word, n_words) = 1
"""

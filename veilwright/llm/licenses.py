"""License scans by patience alignment.

Where a document has many of a template's words close together, the stretch is aligned with the template:
words unique to both are anchors, the longest increasing subsequence of them is kept, and the gaps between are
aligned in the same way; the share of the template's words that are aligned is its coverage. Documents are
read where they are; only templates, a fixed and small set, are sent to them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwright.llm.runtime import ship

WORD = re.compile(r"[^\W_]+")
FOUND = "array<struct<license:string,template:int,start:int,n_words:int,matched:int,coverage:double>>"

#: Wordings of public licenses, by SPDX identifier.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
        "so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You "
        "may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


@dataclass(frozen=True)
class Params:
    """min_coverage: share of a template's words that must be aligned; exact_words: templates shorter than this must
    be aligned whole; slack: a stretch may be longer than its template by this share (and by 4 words)."""

    min_coverage: float = 0.8
    exact_words: int = 10
    slack: float = 0.25


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, which rise in their first numbers, whose second numbers rise too."""
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tails, y)
        if k == len(tails):
            tails.append(y)
            at.append(i)
        else:
            tails[k], at[k] = y, i
        before[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Patience alignment: pairs of positions of equal words, rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: i for i, w in enumerate(b[b0:b1], b0) if nb[w] == 1}
        anchors = _increasing([(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if na[w] == 1 and w in where])
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(x0 + 1, x1, y0 + 1, y1) for (x0, y0), (x1, y1) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, params: Params = Params()):
        self.params, self.names = params, [n for n, _ in templates]
        self.texts = [words(t) for _, t in templates]
        self.number: dict[str, int] = {}
        for t in self.texts:
            for w in t:
                self.number.setdefault(w, len(self.number) + 1)
        self.ids = [[self.number[w] for w in t] for t in self.texts]
        self.has = np.zeros((len(self.ids), len(self.number) + 1), dtype=bool)
        for k, t in enumerate(self.ids):
            self.has[k, t] = True
        self.least = [len(t) if len(t) < params.exact_words else int(np.ceil(params.min_coverage * len(t))) for t in self.texts]

    def scan(self, text: str | None) -> list[tuple[str, int, int, int, int, float]]:
        """Licenses in the whole text, by place; of overlapping finds the one with more words matched (then the
        greater coverage, then the earlier template) counts."""
        w = words(text)
        if not w:
            return []
        ids = np.fromiter(map(self.number.get, w, (0,) * len(w)), dtype=np.int64, count=len(w))
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        found = []
        for k, t in enumerate(self.ids):
            least, size = self.least[k], min(len(w), int(len(t) * (1 + self.params.slack)) + 4)
            if len(w) < least or (known[size:] - known[:-size]).max() < least:
                continue
            hits = np.concatenate([[0], np.cumsum(self.has[k][ids])])
            hits = hits[size:] - hits[:-size]
            first, full = 0, -1
            for s in np.flatnonzero(hits >= least).tolist():
                if s < first:
                    continue
                # the first stretch that is dense enough may end before the license does: one that begins later, where the
                # license can begin, may have more of the template's words. The one that aligns better counts; a stretch
                # that was aligned isn't looked at again
                best = s + int(hits[s : s + size - least + 1].argmax())
                at, pairs = s, align(ids[s : s + size].tolist(), t)
                if best not in (s, full):
                    full = best
                    if len(later := align(ids[best : best + size].tolist(), t)) > len(pairs):
                        at, pairs = best, later
                if len(pairs) >= least:
                    a, b = at + pairs[0][0], at + pairs[-1][0] + 1
                    found.append((len(pairs), len(pairs) / len(t), -k, a, b))
                    first = b
        out, taken = [], []
        for n, share, k, a, b in sorted(found, key=lambda x: (-x[0], -x[1], -x[2], x[3])):
            if all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                out.append((self.names[-k], -k, a, b - a, n, share))
        return sorted(out, key=lambda x: x[2])


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, params: Params = Params()) -> DataFrame:
    """doc_id, license, template, start (word), n_words, matched, coverage of each license found in docs (doc_id, text).

    Null and empty texts have none; repeated rows and null doc_ids give rows of their own; an empty table gives
    an empty result; other columns aren't read.
    """
    ship(docs.sparkSession)
    scanner = Scanner(templates, params)
    names = "license", "template", "start", "n_words", "matched", "coverage"

    @F.pandas_udf(FOUND)
    def scanned(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(names, x, strict=True)) for x in scanner.scan(t)] for t in texts], dtype=object)

    return docs.select("doc_id", F.explode(scanned(F.col("text"))).alias("x")).select("doc_id", "x.*")

"""License scans by a trained paragraph classifier.

Sparse logistic regression over word n-grams gives each paragraph (a line, or neighbouring lines
of a hard-wrapped one, without comment marks) a licence family or none. It is trained on titles,
headers, clauses and notices of each family, varied by dropped and added words, against ordinary
prose about the same words and the notices' words without their order. A temperature fitted on
held-out variants calibrates the probabilities, so a paragraph that resembles no family ends in the
unknown class. A prediction counts only if a template of its family, compared by shared n-grams,
confirms it.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomtrace.llm._common import lean

NGRAM = 3
LEAST_CHANCE, LEAST_LIKENESS = 0.5, 0.6
UNKNOWN = "unknown"

#: Notices that each family is learned from and confirmed by.
TEMPLATES = {
    "MIT": [
        "License: MIT",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT", "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction."],
    "Apache-2.0": [
        "License: Apache-2.0",
        "Apache License Version 2.0, January 2004",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "GPL": [
        "GNU GENERAL PUBLIC LICENSE",
        "License: GPL-3.0",
        "License: GPLv2",
        "You should have received a copy of the GNU General Public License along with this program; if not, see https://www.gnu.org/licenses/.",
        "This work is licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License version 2.",
        "Licensed under the GPL v3.", "Licensed under GPLv3.", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-2.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."],
    "LGPL": [
        "GNU LESSER GENERAL PUBLIC LICENSE",
        "License: LGPL-2.1",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, see https://www.gnu.org/licenses/.",
        "Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only", "Released under the LGPL v2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License."],
    "AGPL": [
        "GNU AFFERO GENERAL PUBLIC LICENSE",
        "License: AGPL-3.0",
        "You should have received a copy of the GNU Affero General Public License along with this program; if not, see https://www.gnu.org/licenses/.",
        "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "Released under the AGPL v3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."],
    "BSD": [
        "License: BSD-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Released under the BSD License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Licensed under the 3-clause BSD license.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "MPL": [
        "Mozilla Public License Version 2.0",
        "License: MPL-2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY": [
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under CC BY-SA 3.0."],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Shared under CC BY-NC-SA 4.0."],
    "CC0": [
        "License: CC0-1.0",
        "Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0", "This is free and unencumbered software released into the public domain."],
    "ISC": [
        "License: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "proprietary": ["All rights reserved.", "Copyright 2024 Example Corporation. All rights reserved.", "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited."],
}
#: Prose that shares words with notices and is none.
PROSE = [
    "She renewed her driver license at the office last week.", "The general public may visit the version of the work shown here.", "A license to fish is sold under the bridge.",
    "The work of the foundation was released to the public.", "You can use this file and modify the source later.", "Apache helicopters landed near the creative commons garden.",
    "MIT researchers released a new paper.", "Free software is a matter of liberty.", "The terms of the deal were published in version two.", "All rights come with duties.",
    "The library is open to any person.", "He was granted permission to copy the map.", "The public domain of mathematics is wide.", "This is subject to change without notice.",
    "The conditions were met and the form was filed.", "Attribution of the painting is unclear.", "The license plate was covered in mud.", "Under the old law, no one paid.",
]
_WORD = re.compile(r"[0-9a-z]+(?:\.[0-9]+)*")
_COMMON = frozenset("a an and any are as at be by can for from in is it of on or that the this to under was with you your".split())


def _words(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def _grams(words: list[str]) -> list[str]:
    """Word n-grams that hold a word that is not a common one."""
    rare = [w not in _COMMON for w in words]
    return [" ".join(words[i : i + n]) for n in range(1, NGRAM + 1) for i in range(len(words) - n + 1) if any(rare[i : i + n])]


def _is_title(template: str) -> bool:
    return template.isupper() or template.startswith("License:")


@dataclass
class Classifier:
    families: list[str]
    index: dict[str, int]
    weight: np.ndarray
    bias: np.ndarray
    temperature: float
    templates: dict[str, list[frozenset]]
    #: accuracy on the held-out variants, and the mean gap between chance and accuracy in ten bins of chance
    held_out: tuple[float, float] = (0.0, 0.0)
    #: templates that must be most of their paragraph
    titles: frozenset = frozenset()

    def __post_init__(self) -> None:
        self.cues = frozenset(g for g in self.index if " " not in g)
        self.notices = [t for ts in self.templates.values() for t in ts]
        # a missing word loses a template at least its share of the n-grams that hold it
        self.shares: list[dict[int, float]] = []
        bits: dict[str, int] = {}
        for t in self.notices:
            share: dict[int, float] = {}
            for g in t:
                rare = {w for w in g.split(" ") if w not in _COMMON}
                for w in rare:
                    bit = bits.setdefault(w, 1 << len(bits))
                    share[bit] = share.get(bit, 0.0) + 1 / len(rare) / len(t)
            self.shares.append(share)
        self.bits = bits
        self.longest = max((sum(" " not in g for g in t) for t in self.notices), default=0)

    def likeness(self, mine: frozenset, template: frozenset) -> float:
        """Share of the template's n-grams that are there; a title must be most of its paragraph."""
        return len(mine & template) / (max(len(template), min(len(mine), 2 * len(template))) if template in self.titles else len(template))

    def chances(self, words: list[str]) -> np.ndarray:
        at = sorted({self.index[g] for g in _grams(words) if g in self.index})
        z = (self.weight[at].sum(0) / np.sqrt(max(1, len(at))) + self.bias) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()

    def judge(self, paragraph: str) -> tuple[str, float, float]:
        """(family or unknown, its chance, likeness to the family's nearest template)."""
        words = _words(paragraph)
        p = self.chances(words)
        k = int(p.argmax())
        if self.families[k] == UNKNOWN or p[k] < LEAST_CHANCE:
            return UNKNOWN, float(p[self.families.index(UNKNOWN)]), 0.0
        mine = frozenset(_grams(words))
        like = max(self.likeness(mine, t) for t in self.templates[self.families[k]])
        return (self.families[k] if like >= LEAST_LIKENESS else UNKNOWN), float(p[k]), like

    def mask(self, words: list[str]) -> int:
        """Which words of the templates are there, as bits."""
        m = 0
        for w in words:
            m |= self.bits.get(w, 0)
        return m

    def near(self, mask: int) -> list[frozenset]:
        """The templates that words of this mask may be like enough to."""
        return [t for t, share in zip(self.notices, self.shares, strict=True) if sum(s for b, s in share.items() if b & mask) >= LEAST_LIKENESS - 1e-9]

    def wrapped(self, lines: list[str], single: dict[int, str]) -> list[tuple[int, str, float, float]]:
        """(first line, family, chance, likeness) of the notices that several lines of a paragraph
        hold together. single: families of the lines that are notices by themselves; a window with
        one of its own family is that line's. Of windows that overlap, the likest, then the shortest
        holds. Windows end once the lines after the first hold five times the rare words of the longest template."""
        split = [_words(x) for x in lines]
        masks = [self.mask(ws) for ws in split]
        got = []
        for i, first in enumerate(split):
            words, mask, more = list(first), masks[i], 0
            if not masks[i]:
                continue
            for j in range(i + 1, len(lines)):
                words, mask, more = words + split[j], mask | masks[j], more + len(split[j])
                if masks[j] and (some := self.near(mask)):
                    mine = frozenset(_grams(words))
                    if any(self.likeness(mine, t) >= LEAST_LIKENESS for t in some):
                        family, p, like = self.judge(" ".join(lines[i : j + 1]))
                        if family != UNKNOWN and all(single.get(k) != family for k in range(i, j + 1)):
                            got.append((-like, j - i, i, j, family, p))
                if more > 5 * self.longest:
                    break
        out: list[tuple[int, int, str, float, float]] = []
        for like, _, i, j, family, p in sorted(got):
            if all(j < a or b < i for a, b, *_ in out):
                out.append((i, j, family, p, -like))
        return [(i, family, p, like) for i, _, family, p, like in sorted(out)]


def train(templates: dict[str, list[str]] = TEMPLATES, prose: list[str] = PROSE, seed: int = 5, rounds: int = 60) -> Classifier:
    """Fit on variants of the templates; a fifth of the variants is held out for the temperature."""
    r = random.Random(seed)
    families = [*templates, UNKNOWN]
    pool = [w for t in prose for w in _words(t)]
    rows: list[tuple[list[str], int]] = []
    for k, family in enumerate(families):
        for text in templates.get(family, prose):
            words = _words(text)
            rows.append((words, k))
            for _ in range(8):
                v = [w for w in words if r.random() > 0.08] or words
                if r.random() < 0.5:
                    v = r.choices(pool, k=r.randint(1, 6)) + v
                if r.random() < 0.5:
                    v = v + r.choices(pool, k=r.randint(1, 6))
                rows.append((v, k))
    words = [w for t in templates.values() for x in t for w in _words(x)]
    rows += [([w for w in r.choices(words, k=r.randint(3, 12))], len(families) - 1) for _ in range(200)]  # the words without their order
    r.shuffle(rows)
    grams = [(sorted(set(_grams(ws))), k) for ws, k in rows]
    grams = [(g, k) for g, k in grams if g]
    index = {g: i for i, g in enumerate(sorted({g for gs, _ in grams for g in gs}))}
    size = np.array([len(g) for g, _ in grams])
    flat = np.array([index[g] for gs, _ in grams for g in gs])  # sparse rows: columns, one after another
    row, first, value = np.repeat(np.arange(len(grams)), size), np.cumsum(size) - size, np.repeat(1 / np.sqrt(size), size).astype(np.float32)[:, None]
    y = np.eye(len(families), dtype=np.float32)[[k for _, k in grams]]
    fit = (np.arange(len(grams)) % 5 != 0)[:, None]
    w, b = np.zeros((len(index), len(families)), np.float32), np.zeros(len(families), np.float32)
    b[-1] = 1.0

    def soft(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def logits() -> np.ndarray:
        return np.add.reduceat(w[flat] * value, first) + b

    for step in range(rounds):
        d = (soft(logits()) - y) * fit / fit.sum()
        g = np.zeros_like(w)
        np.add.at(g, flat, d[row] * value)
        rate = 40.0 / (1 + step / 60)
        w -= rate * (g + 1e-4 * w)
        b -= rate * 0.1 * d.sum(0)
    out = ~fit[:, 0]
    z, y = logits()[out], y[out]
    t, step = 1.0, 0.5
    loss = lambda t: -float(np.log(np.maximum((soft(z / t) * y).sum(1), 1e-9)).mean())
    while step > 0.01:  # the loss has one valley
        t, step = min(((loss(x), x, s) for x, s in ((t, step / 2), (t * (1 + step), step), (t / (1 + step), step))))[1:]
    p = soft(z / t)
    top, hit = p.max(1), p.argmax(1) == y.argmax(1)
    bins = np.minimum((top * 10).astype(int), 9)
    gap = sum(abs(top[bins == k].sum() - hit[bins == k].sum()) for k in range(10)) / len(top)
    used = np.flatnonzero(np.abs(w).max(1) > 1e-3)
    names = sorted(index, key=index.get)
    return Classifier(families, {names[i]: k for k, i in enumerate(used)}, w[used], b, t,
                      {f: [frozenset(_grams(_words(t))) for t in ts] for f, ts in templates.items()}, (float(hit.mean()), float(gap)),
                      frozenset(frozenset(_grams(_words(t))) for ts in templates.values() for t in ts if _is_title(t)))


def scan(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """(doc_id, n_paragraphs, n_licensed, families, findings) of every whole text.

    A notice is sought in each line and, hard-wrapped, in windows of neighbouring lines between blank
    lines. findings are (paragraph, family, chance, likeness) by number of the (first) line from 0; families are the
    distinct ones, sorted, comma-joined. Lines of white space alone are no paragraphs but count in
    the numbering. A paragraph without any word the classifier knows is unknown by its bias, and
    each distinct paragraph is judged once for each batch. Of equally likely families the first of
    the list holds. Null texts have no paragraphs; very long ones are read whole. Null ids stay null,
    repeated rows get equal results, an empty table an empty one; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    found_type = pa.list_(pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("chance", pa.float64()), ("likeness", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        judge, cues, hopes = model.judge, model.cues, {}
        for batch in batches:
            known: dict[str, tuple] = {}
            out: list[list] = [[], [], [], []]
            for t in batch.column(1):
                t = t.as_py()
                lines = t.split("\n") if t else []
                found, runs, at = [], [], None
                for k, line in enumerate(lines):
                    got = known.get(line)
                    if got is None:
                        low = line.lower()
                        got = judge(line) if not cues.isdisjoint(_WORD.findall(low)) else (UNKNOWN, 1.0, 0.0)
                        got = known[line] = (*got, model.mask(_words(line)))
                    if not line.strip():
                        at = None
                    elif at is None:
                        at = [k, k + 1, got[3]]
                        runs.append(at)
                    else:
                        at[1], at[2] = k + 1, at[2] | got[3]
                    if got[0] != UNKNOWN:
                        found.append({"paragraph": k, "family": got[0], "chance": round(got[1], 6), "likeness": round(got[2], 6)})
                for a, b, mask in runs:
                    if b - a > 1:
                        may = hopes.get(mask)
                        if may is None:
                            if len(hopes) > 100_000:
                                hopes.clear()
                            may = hopes[mask] = bool(model.near(mask))
                        if may:
                            single = {f["paragraph"] - a: f["family"] for f in found if a <= f["paragraph"] < b}
                            found += [{"paragraph": a + k, "family": f, "chance": round(p, 6), "likeness": round(like, 6)} for k, f, p, like in model.wrapped(lines[a:b], single)]
                found.sort(key=lambda f: (f["paragraph"], f["family"]))
                out[0].append(sum(1 for x in lines if x.strip()))
                out[1].append(len(found))
                out[2].append(",".join(sorted({f["family"] for f in found})))
                out[3].append(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], found_type)], ["doc_id", "n_paragraphs", "n_licensed", "families", "findings"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(lean(run), f"doc_id {key}, n_paragraphs long, n_licensed long, families string, findings array<struct<paragraph:long,family:string,chance:double,likeness:double>>")

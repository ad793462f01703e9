"""License scans: a trained paragraph classifier with template comparison.

A paragraph (a line of a text, or a window of a block of lines) is a sparse vector of word n-grams (1 to 3). A softmax regression over the families and an
unknown class is trained in numpy on noisy copies of the public notices below and on a bounded sample of the corpus's own
paragraphs (unknown). Its temperature and the least probability of a family are set on paragraphs kept from the fit.
A prediction counts only if the paragraph holds at least CONFIRM of the word pairs of a notice. Notices of different families
differ in a version or a word, so the family is that of the notice whose word pairs are most like the paragraph's (Jaccard index: what
either has more counts against it), and the classifier must give that family its least probability, or rank it first.

Only paragraphs with a cue word (any longer word of a notice) reach the classifier; the others cannot be confirmed, as
every notice has over 1 - CONFIRM of its word pairs with a cue word (checked when the model is made).

Blocks: lines up to the next one without a word (comment marks are none) are joined. Where a notice of a family that no
line of the block shows has CONFIRM of its word pairs in the block, the windows of the notice's length that begin at one of
these pairs are classified, so that a wrapped notice and one inside a long line count too, once a block and family.

Defined cases: null and empty texts have no paragraphs; repeated rows keep a row each; without documents the unknown class
is trained on shuffled notices only.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import fit_on_sample, table, with_text_columns

# Public notices by licence family: short ones, the standard headers and the identifying paragraphs of the texts.
NOTICES = {
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. The ASF licenses this file to You under the Apache License, Version 2.0",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0 Universal public domain dedication.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the terms of the GNU General Public License version 2 or later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "LGPL-2.1": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "Proprietary": ["Copyright. All rights reserved.", "No part of this work may be reproduced without written permission of the copyright holder."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}
# Identifiers of the families in short marks.
IDENTIFIERS = {
    "AGPL-3.0": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"], "Apache-2.0": ["Apache-2.0"], "BSD": ["BSD-2-Clause", "BSD-3-Clause"], "CC-BY-4.0": ["CC-BY-4.0"], "CC-BY-NC-4.0": ["CC-BY-NC-4.0"], "CC-BY-SA-4.0": ["CC-BY-SA-4.0"], "CC0-1.0": ["CC0-1.0"],
    "GPL-2.0": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"], "GPL-3.0": ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"], "ISC": ["ISC"], "LGPL-2.1": ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"], "LGPL-3.0": ["LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "MIT": ["MIT"], "MPL-2.0": ["MPL-2.0"], "Unlicense": ["Unlicense"],
}
for _family, _ids in IDENTIFIERS.items():
    NOTICES[_family] += [f"SPDX-License-Identifier: {x}" for x in _ids]

COPIES, UNKNOWN, LONGEST, CONFIRM, STEPS = 60, 4000, 400, 0.8, 250
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)?")


def words(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def grams(w: list[str]) -> set[tuple[str, ...]]:
    return {tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}


def pairs(w: list[str]) -> set[tuple[str, ...]]:
    return {tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))}


def is_cue(word: str) -> bool:
    return len(word) >= 5 or word in ("spdx", "mit", "bsd", "isc", "gnu", "cc", "cc0")


@dataclass
class Model:
    families: list[str]  # the last class, unknown, is not named
    features: dict[tuple[str, ...], np.ndarray]
    bias: np.ndarray
    temperature: float
    least: float

    def __post_init__(self):
        self.templates = {f: [pairs(words(t)) for t in NOTICES[f]] for f in self.families}
        self.lengths = {f: [len(words(t)) for t in NOTICES[f]] for f in self.families}
        self.cues = {w for ts in NOTICES.values() for t in ts for w in words(t) if is_cue(w)}
        for ts in self.templates.values():
            for t in ts:
                if sum(not any(is_cue(w) for w in p) for p in t) >= CONFIRM * len(t):
                    raise ValueError("a notice could be confirmed without a cue word")

    def probabilities(self, w: list[str]) -> np.ndarray:
        z = self.bias.copy()
        for g in grams(w):
            if (x := self.features.get(g)) is not None:
                z += x
        z = z / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()

    def paragraph(self, text: str) -> tuple[str, float, float] | None:
        """(family, probability, share of the notice's word pairs), or None for unknown."""
        return self.classified(words(text))

    def classified(self, w: list[str]) -> tuple[str, float, float] | None:
        h = self.compared(w)
        return h and h[:3]

    def compared(self, w: list[str]) -> tuple[str, float, float, float] | None:
        """As classified(), and the Jaccard index of w's word pairs and the notice's."""
        if self.cues.isdisjoint(w):
            return None
        p = self.probabilities(w)
        k = int(p.argmax())
        if k == len(self.families) or p[k] < self.least:
            return None
        own, best = pairs(w), (-1.0, 0.0, 0)
        for i, f in enumerate(self.families):
            for t in self.templates[f]:
                common = len(t & own)
                if common >= CONFIRM * len(t):
                    best = max(best, (common / (len(t) + len(own) - common), common / len(t), i))
        like, share, i = best
        return (self.families[i], float(p[i]), share, like) if share and (i == k or p[i] >= self.least) else None

    def block(self, w: list[str]) -> list[tuple[int, tuple[str, float, float]]]:
        """(place of the first word, hit) of notices anywhere in w, one a family; of overlapping ones the most similar."""
        if self.cues.isdisjoint(w):
            return []
        own, every = pairs(w), []
        for f in self.families:
            for t, n in zip(self.templates[f], self.lengths[f]):
                if len(t & own) < CONFIRM * len(t):
                    continue
                for at in range(len(w)):
                    if tuple(w[at : at + 2]) in t and len(t & pairs(w[at : at + n + 2])) >= CONFIRM * len(t):
                        for end in (n, n + 2):
                            if (h := self.compared(w[at : at + end])) and h[0] == f:
                                every.append((at, at + n, h))
        kept: list[tuple[int, int, tuple[str, float, float, float]]] = []
        # long notices first among the equally complete: a short one may be like a part of another family's long one
        for x in sorted(every, key=lambda x: (x[2][3] < 0.9, x[0] - x[1] if x[2][3] >= 0.9 else 0, -x[2][3], -x[2][1], x[0])):
            if all(x[1] <= k[0] or x[0] >= k[1] for k in kept):
                kept.append(x)
        first = {x[2][0]: x for x in sorted(kept, key=lambda x: -x[0])}
        return [(x[0], x[2][:3]) for x in first.values()]

    def found(self, lines: list[str]) -> list[tuple[int, tuple[str, float, float]]]:
        """(number of the line, hit), in order."""
        hits, block, owner, seen = [], [], [], set()
        for i, x in enumerate([*lines, ""]):
            w = words(x)
            if w:
                if h := self.paragraph(x):
                    hits.append((i, h))
                    seen.add(h[0])
                block += w
                owner += [i] * len(w)
            elif block:
                hits += [(owner[at], h) for at, h in self.block(block) if h[0] not in seen]
                block, owner, seen = [], [], set()
        return sorted(hits)


def train(unknown: list[str], *, seed: int = 3) -> Model:
    r, families = random.Random(seed), sorted(NOTICES)
    filler = [w for u in unknown for w in words(u)][:50_000] or ["lorem", "ipsum", "dolor"]
    rows: list[tuple[list[str], int]] = []
    for k, f in enumerate(families):
        for t in NOTICES[f]:
            for i in range(COPIES):
                w = [x for x in words(t) if r.random() > 0.06 * (i > 0)]
                pre, post = (([r.choice(filler) for _ in range(r.randrange(9))] if i > 4 else []) for _ in "ab")
                rows.append((pre + w + post, k))
    unk = len(families)
    known = [pairs(words(t)) for ts in NOTICES.values() for t in ts]
    for u in unknown:
        w = words(u)
        own = pairs(w)
        if w and not any(len(t & own) >= CONFIRM / 2 * len(t) for t in known):
            rows.append((w, unk))
    for ts in NOTICES.values():  # the notices' words out of order are no licence
        for t in ts:
            for _ in range(COPIES // 6):
                w = words(t)
                r.shuffle(w)
                rows.append((w + [r.choice(filler) for _ in range(6)], unk))
    r.shuffle(rows)
    counts: dict[tuple[str, ...], int] = {}
    for w, k in rows:
        for g in grams(w):
            counts[g] = counts.get(g, 0) + 1
    names = {g: i for i, g in enumerate(sorted(g for g, c in counts.items() if c >= 8))}
    ids = [np.array([names[g] for g in grams(w) if g in names], np.int64) for w, _ in rows]
    y = np.array([k for _, k in rows])
    cut = len(rows) * 4 // 5
    weights, bias = np.zeros((len(names), unk + 1)), np.zeros(unk + 1)
    owner = np.repeat(np.arange(cut), [len(x) for x in ids[:cut]])
    flat = np.concatenate([*ids[:cut], np.array([], np.int64)])
    eye = np.eye(unk + 1)[y[:cut]]
    g2 = np.full_like(weights, 1e-3)
    order = np.argsort(flat, kind="stable")
    f_sorted, o_sorted = flat[order], owner[order]
    first = np.flatnonzero(np.diff(f_sorted, prepend=-1)) if len(flat) else np.array([], int)
    def logits(rows_: list[np.ndarray]) -> np.ndarray:
        return np.array([weights[x].sum(0) + bias for x in rows_]).reshape(-1, unk + 1)
    starts = np.searchsorted(owner, np.arange(cut))
    filled = np.array([len(x) > 0 for x in ids[:cut]])
    for _ in range(STEPS if len(flat) else 0):
        z = np.zeros((cut, unk + 1)) + bias
        z[filled] += np.add.reduceat(weights[flat], starts[filled], axis=0)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (p - eye) / cut
        grad = np.zeros_like(weights)
        grad[f_sorted[first]] = np.add.reduceat(d[o_sorted], first, axis=0)
        g2 += grad**2
        weights -= 0.5 * grad / np.sqrt(g2)
        weights[:] = np.sign(weights) * np.maximum(np.abs(weights) - 2e-4, 0)  # lasso step: sparse weights
        bias -= 0.5 * d.sum(0)
    z, truth = logits(ids[cut:]), y[cut:]
    best = (np.inf, 1.0)
    for t in (0.5, 0.7, 1.0, 1.4, 2.0, 3.0):  # calibration on what was kept from the fit
        p = np.exp(z / t - (z / t).max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = min(best, (float(-np.log(p[np.arange(len(truth)), truth] + 1e-9).mean()), t))
    p = np.exp(z / best[1] - (z / best[1]).max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    top = p[:, :unk].max(1)[truth == unk]
    least = float(np.clip(np.quantile(top, 0.995) if len(top) else 0.5, 0.3, 0.6))
    kept = {g: weights[i] for g, i in names.items() if np.abs(weights[i]).max() > 0}
    return Model(families, kept, bias, best[1], least)


def learn(docs: DataFrame, unknown: int = UNKNOWN) -> Model:
    """unknown: bound of the corpus's paragraphs that the unknown class is fitted on, one each of documents chosen by a hash: the
    line of the whole text that another hash chooses, up to LONGEST words of it. The fit runs in one task of an executor; the
    driver has the chosen ids and the model."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(x) > 0)
    rows = docs.select("doc_id", F.lit(0).alias("all"), lines.alias("l")).where("size(l) > 0").select("doc_id", "all", F.get("l", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.size("l")).cast("int")).alias("p"))
    return fit_on_sample(rows, "all", unknown, ("p",), lambda got, _: train([" ".join(words(r["p"])[:LONGEST]) for r in got]))


def scan(docs: DataFrame, model: Model, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, n_paragraphs and found: (paragraph number, family, probability, similarity) of confirmed paragraphs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def compute(texts: list[str | None]) -> list[list]:
            n, found = [], []
            for t in texts:
                lines = (t or "").split("\n")
                n.append(sum(x != "" for x in lines))
                number = np.cumsum([x != "" for x in lines]) - 1
                found.append([{"paragraph": int(number[i]), "family": h[0], "probability": h[1], "similarity": h[2]} for i, h in m.found(lines)])
            return [n, found]

        return compute

    return with_text_columns(docs, list(keep), make, "n_paragraphs long, found array<struct<paragraph:int,family:string,probability:double,similarity:double>>")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    f = scan(docs, learn(docs))
    return f.select("doc_id", "n_paragraphs", F.size("found").cast("long").alias("n_licensed"), F.array_join(F.array_sort(F.array_distinct("found.family")), ",").alias("families"))

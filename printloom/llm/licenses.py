"""Licence scan: a paragraph classifier finds licence families, templates confirm them.

A sparse multinomial logistic regression over word n-grams (one to three) is trained here, on statements, headings and
notices of each family with words dropped and headed by notices, against statements that merely sound alike and a
bounded, hash-chosen sample of NEGATIVES pieces of the corpus as the unknown class. A part kept apart calibrates the
scores. A piece of text belongs to a family if the family's calibrated score reaches MIN_SCORE and one of the family's
templates stands in it for the most part (MIN_SHARE of its word pairs).

Paragraphs end at blank lines. In each, lines are classified on their own; what is left is joined where lines follow
each other whose words are mostly those of templates, so that wrapped notices are read as one, whatever marks of
comments stand before their lines. Spans are places in the text as given.

Because of the templates, a text that holds none of a set of anchor words cannot pass; such texts skip the classifier,
with the same result.

Cases: a null text is an empty one, without paragraphs; whole texts are read; repeated rows give repeated results; ties
go to the family listed first; an empty table gives an empty one; rows with null ids are scanned; other columns are not
read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from printloom.llm.common import chunks
from printloom.llm.langid import fit_temperature, softmax

#: Statements, headings and notices by which texts name their licence.
STATEMENTS = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the MIT license.",
        "MIT License",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "SPDX-License-Identifier: MIT",
    ),
    "bsd": (
        "Released under the BSD License.",
        "BSD 3-Clause License",
        "BSD 2-Clause License",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "isc": (
        "Released under the ISC License.",
        "ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "SPDX-License-Identifier: ISC",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GPL, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "gpl": (
        "GNU GENERAL PUBLIC LICENSE",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License.",
        "GNU LESSER GENERAL PUBLIC LICENSE",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-3.0-only",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "agpl": (
        "This program is licensed under the GNU Affero General Public License.",
        "GNU AFFERO GENERAL PUBLIC LICENSE",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "public-domain": (
        "This work is dedicated to the public domain under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "proprietary": (
        "All rights reserved.",
        "This document is confidential and proprietary; unauthorized copying is prohibited.",
    ),
}
#: Sentences of the unknown class that share words with the statements.
ALIKE = (
    "He renewed his driving license before the version of the law changed.",
    "The public library is open, free of charge, to any person.",
    "All seats are reserved for the general public.",
    "Permission to enter the building is granted by the guard.",
    "The software was released in version 3 under a new name.",
    "They copied the source of the river on the map.",
    "The commons of the town is a place for all people of good will.",
    "Apache helicopters and a public school bus were seen in the area.",
    "The following conditions are met by the use of a binary star.",
    "Rights of way are marked on this international work of reference.",
)
UNKNOWN = "unknown"

#: The bounds of the corpus sample of the unknown class, in pieces and in characters of a piece (scanning has no such bounds); variants of each statement.
NEGATIVES, SAMPLE_CHARS, VARIANTS = 2000, 2000, 20
#: Share of a line's word pairs that stand in templates, from which it may be part of a wrapped notice.
FAMILIAR = 0.6
#: Calibrated score, and share of a statement's word pairs, that a paragraph must reach.
MIN_SCORE, MIN_SHARE = 0.5, 0.6
#: Proximal gradient: steps, rate, L1, L2.
STEPS, RATE, L1, L2 = 200, 8.0, 2e-5, 1e-5

_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
#: Words too common to tell anything.
COMMON = frozenset("a an and any are as by for free from in is it of on or other that the this to under use with without not may you your all work file program".split())


def words_of(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def ngrams(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def pairs(words: list[str]) -> frozenset[tuple[str, str]]:
    return frozenset(zip(words, words[1:]))


TEMPLATES = {family: [pairs(words_of(s)) for s in own] for family, own in STATEMENTS.items()}
ALL_PAIRS = frozenset().union(*(t for own in TEMPLATES.values() for t in own))
ALL_WORDS = frozenset(w for p in ALL_PAIRS for w in p)


def familiar(words: list[str]) -> bool:
    """May a line of these words be part of a wrapped template?"""
    own = pairs(words)
    return sum(p in ALL_PAIRS for p in own) >= FAMILIAR * len(own) if own else bool(words) and words[0] in ALL_WORDS


def share(family: str, words: list[str]) -> float:
    """The greatest part of the pairs of one of the family's statements that a paragraph holds."""
    own = pairs(words)
    return max(len(t & own) / len(t) for t in TEMPLATES[family])


def anchors() -> frozenset[str]:
    """Words so chosen that a paragraph without any of them holds less than MIN_SHARE of every statement's pairs."""
    chosen: set[str] = set()
    for templates in TEMPLATES.values():
        for t in templates:
            rare = sorted({w for p in t for w in p} - COMMON, key=lambda w: (w not in chosen, -len(w), w))
            for w in rare:
                if sum(not chosen.intersection(p) for p in t) < MIN_SHARE * len(t):
                    break
                chosen.add(w)
            else:
                if sum(not chosen.intersection(p) for p in t) >= MIN_SHARE * len(t):
                    chosen.update(w for p in t for w in p)
    return frozenset(chosen)


@dataclass
class Model:
    families: list[str]  # the last is the unknown class
    vocabulary: dict[tuple[str, ...], int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    anchors: tuple[str, ...]

    def vector(self, words: list[str]) -> tuple[np.ndarray, float]:
        at = np.array([i for g in ngrams(words) if (i := self.vocabulary.get(g)) is not None], np.int64)
        return at, 1 / np.sqrt(max(1, len(words)))

    def classify(self, piece: str) -> tuple[str, float]:
        """Family, or unknown, and its score."""
        return self.of_words(words_of(piece))

    def of_words(self, words: list[str]) -> tuple[str, float]:
        at, x = self.vector(words)
        p = softmax((self.weights[at].sum(0) * x + self.bias) / self.temperature)
        best = int(p.argmax())
        name = self.families[best]
        if name == UNKNOWN or p[best] < MIN_SCORE or share(name, words) < MIN_SHARE:
            return UNKNOWN, float(p[-1])
        return name, float(p[best])

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, int, int, float]]]:
        """Number of paragraphs, and (family, start, end, score) of what is licensed, in order."""
        lines = (text or "").split("\n")
        blank = [not x.strip() for x in lines]
        paragraphs = sum(not b and (i == 0 or blank[i - 1]) for i, b in enumerate(blank))
        found: list[tuple[str, int, int, float]] = []
        if self._anchored(text or ""):
            starts = list(accumulate((len(x) + 1 for x in lines), initial=0))
            run: list[int] = []  # lines that follow each other in a paragraph, familiar, and not licensed on their own
            for i, line in enumerate([*lines, ""]):
                words = words_of(line)
                family, score = self.of_words(words) if words and self._anchored(line) else (UNKNOWN, 0.0)
                if family == UNKNOWN and familiar(words):
                    run.append(i)
                    continue
                if len(run) > 1:
                    joined, share_of = self.of_words([w for j in run for w in words_of(lines[j])])
                    if joined != UNKNOWN:
                        found.append((joined, starts[run[0]], starts[run[-1]] + len(lines[run[-1]]), share_of))
                run = []
                if family != UNKNOWN:
                    found.append((family, starts[i], starts[i] + len(line), score))
        return paragraphs, found

    def _anchored(self, text: str) -> bool:
        low = text.lower()
        return any(a in low for a in self.anchors)


def _examples(sample: list[str], seed: int = 5) -> list[tuple[list[str], int]]:
    rng = random.Random(seed)
    families = list(STATEMENTS)
    out = []
    heads = ("", "Copyright (c) 2021 the authors. ", "License: ", "Notice. ")
    for i, family in enumerate(families):
        for s in STATEMENTS[family]:
            for v in range(VARIANTS):
                words = words_of(rng.choice(heads) + s)
                own = [w for w in words if v < 4 or rng.random() > 0.12] or words
                if v % 5 == 4 and len(own) > 30:  # a part of a long notice
                    own = own[rng.randrange(len(own) // 3) :]
                out.append((own, i))
    unknown = len(families)
    for s in ALIKE:
        for v in range(VARIANTS):
            words = words_of(s)
            out.append(([w for w in words if v < 4 or rng.random() > 0.2] or words, unknown))
    texts = [w for p in sample if (w := words_of(p)) and all(share(f, w) < MIN_SHARE for f in families)]
    out += [(w, unknown) for w in texts] + [([], unknown)] * 8
    rng.shuffle(out)
    return out


def train(sample: list[str]) -> Model:
    """Fit on the statements and the given paragraphs of the unknown class."""
    families = [*STATEMENTS, UNKNOWN]
    found = sorted({g for own in (*STATEMENTS.values(), ALIKE) for s in own for g in ngrams(words_of(s))})
    model = Model(families, {g: i for i, g in enumerate(found)}, np.zeros((len(found), len(families)), np.float32), np.zeros(len(families), np.float32), 1.0, tuple(sorted(anchors())))
    examples = _examples(sample)
    x = np.zeros((len(examples), len(found)), np.float32)
    for i, (words, _) in enumerate(examples):
        at, value = model.vector(words)
        x[i, at] = value
    y = np.array([label for _, label in examples])
    apart = np.arange(len(y)) % 5 == 0
    fx, fy = x[~apart], np.eye(len(families), dtype=np.float32)[y[~apart]]
    w, b = model.weights, model.bias
    ahead, last, t = w.copy(), w, 1.0
    for _ in range(STEPS):  # accelerated proximal gradient; the soft threshold makes the weights sparse
        error = (softmax(fx @ ahead + b) - fy) / len(fy)
        step = ahead - RATE * (fx.T @ error + L2 * ahead)
        new = np.sign(step) * np.maximum(np.abs(step) - RATE * L1, 0)
        b = b - error.sum(0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, last, t = new + np.float32((t - 1) / t2) * (new - last), new, t2
    model.weights, model.bias = last, b
    model.temperature = fit_temperature(x[apart] @ last + b, y[apart])
    return model


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", negatives: int = NEGATIVES) -> Model:
    """Train with a sample of about ``negatives`` paragraphs of the corpus, chosen by hash: one line each of documents chosen by their hash."""
    n = docs.count()
    near = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(29)), F.lit(1 << 30)) < int(min(1.0, negatives / max(1, n)) * (1 << 30))
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    line = F.get(lines, F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(31)), F.size(lines)).cast("int"))
    rows = docs.where(near).select(F.substring(line, 1, SAMPLE_CHARS).alias("line")).orderBy("line").limit(2 * negatives).collect()
    return train(sorted(r["line"] for r in rows))


def scan_licenses(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n_paragraphs, n_licensed, families (sorted, joined by commas), spans (family:start:end) and least score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in chunks(batches, "k", "t"):
            rows = [shared.value.scan(t) for t in texts]
            yield pa.record_batch({
                "k": pa.array(keys),
                "n_paragraphs": pa.array([n for n, _ in rows], pa.int64()),
                "n_licensed": pa.array([len(f) for _, f in rows], pa.int64()),
                "families": pa.array([",".join(sorted({x[0] for x in f})) for _, f in rows], pa.string()),
                "spans": pa.array([",".join(f"{x[0]}:{x[1]}:{x[2]}" for x in f) for _, f in rows], pa.string()),
                "least_score": pa.array([min((x[3] for x in f), default=None) for _, f in rows], pa.float64()),
            })

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, n_paragraphs long, n_licensed long, families string, spans string, least_score double")
    return out.withColumnRenamed("k", key)

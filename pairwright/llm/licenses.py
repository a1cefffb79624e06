"""Licence scan: a trained paragraph classifier, confirmed by templates.

A paragraph goes on from line to line until a blank line, or a line that ends with a mark; so
wrapped lines are one paragraph.  Paragraphs are classified by a softmax regression over sparse word n-grams of one to
three words.  It is trained on the templates below: each family's sentences, whole, cut and with
words changed, against ordinary lines of the corpus and licence-like ones of no family.  Its
temperature and the least probability for naming a family are chosen on what models say about
sentences that none of their examples came from: of those of no family at most one in a hundred may be
named.  Under that probability a licence-like paragraph is of the class "unknown".  A named family is confirmed if the paragraph holds enough of one of its
templates' words in order, and is unknown otherwise.  In a paragraph of several lines that as a whole is
not confirmed each line is a paragraph of its own, so that a licence line amid other text is found.

Defined cases: null and empty texts and paragraphs without a known word have no licence; a
paragraph has one family at most, a document the families of its paragraphs; very long texts and
paragraphs are read whole; repeated rows get the same result, and a doc_id counts once in the sample;
with an empty table the ordinary class is learnt from the templates alone.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.common import doc_texts, slices, table

WORDS = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")
NONE, UNKNOWN = "none", "unknown"
MARKS = ".!?:;"
#: A bounded sample is taken for fitting: documents (the first by a hash of doc_id), of at most so many code points, and lines of them.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_PARAGRAPHS = 400, 20_000, 4_000
#: Models that are trained without a part of the sentences, to calibrate; their steps, and those of the final one.
FOLDS, FOLD_STEPS, STEPS = 4, 150, 400
#: Part of a template's word pairs that a paragraph must hold for its family to be confirmed.
CONFIRM = 0.6

#: Sentences that name or state each licence (fixed texts).
TEMPLATES = {
    "MIT": (
        "Released under the MIT License",
        "Licensed under the MIT license",
        "This project is licensed under the terms of the MIT License",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Released under the Apache License 2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "you may not use this file except in compliance with the License",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
        "See the License for the specific language governing permissions and limitations under the License",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License version 2",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "either version 3 of the License, or (at your option) any later version",
        "You should have received a copy of the GNU General Public License along with this program",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License",
        "Licensed under the BSD 2-Clause license",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    ),
    "ISC": (
        "Licensed under the ISC License",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0",
        "Licensed under CC BY-NC-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "CC0": (
        "Dedicated to the public domain under CC0 1.0 Universal",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
        "SPDX-License-Identifier: Unlicense",
    ),
}

#: Licence-like sentences of no family above.
OTHERS = (
    "Licensed under the terms stated in the accompanying file",
    "Released under a custom license agreement",
    "This work is licensed under the terms of the company license",
    "All rights reserved. No part of this publication may be reproduced without permission",
    "Use of this software is governed by the end user license agreement",
    "Copyright holders retain all rights to this work",
    "Licensed under the Example Source License, version 1.1",
    "Redistribution of this material is prohibited without written permission",
    "This software is proprietary and confidential",
    "Licensed for internal use only",
)


def grams(words: list[str]) -> list[str]:
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    return words + pairs + [f"{p} {c}" for p, c in zip(pairs, words[2:], strict=False)]


def tokens(text: str) -> list[str]:
    return WORDS.findall(text.lower())


@dataclass(frozen=True)
class LicenseModel:
    classes: tuple[str, ...]
    index: dict[str, int]
    weights: np.ndarray  # n-grams x classes
    bias: np.ndarray
    temperature: float
    least: float


def _examples(rng: random.Random, ordinary: list[list[str]]) -> list[tuple[list[str], str, int]]:
    """Templates whole, cut, joined with ordinary words, and with words changed: words, class, fold of the sentence."""
    found: list[tuple[list[str], str, int]] = []
    noise = [w for p in ordinary for w in p] or ["text"]
    for family, sentences in [*TEMPLATES.items(), (UNKNOWN, OTHERS)]:
        for number, sentence in enumerate(sentences):
            words = tokens(sentence)
            found.append((words, family, number % FOLDS))
            for _ in range(12):
                own = list(words)
                if len(own) > 12 and rng.random() < 0.5:
                    lo = rng.randrange(len(own) - 10)
                    own = own[lo : lo + rng.randint(10, len(own))]
                if len(own) > 6 and rng.random() < 0.4:
                    own[rng.randrange(len(own))] = rng.choice(noise)
                if rng.random() < 0.3:
                    extra = [rng.choice(noise) for _ in range(rng.randint(1, 8))]
                    own = extra + own if rng.random() < 0.5 else own + extra
                found.append((own, family, number % FOLDS))
    found += [(p, NONE, i % FOLDS) for i, p in enumerate(ordinary) if p]
    return found


def _train(rows: list[tuple[list[str], str, int]], classes: tuple[str, ...], index: dict[str, int], steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Full-batch softmax regression with momentum; classes weigh alike."""
    at = [np.array(sorted({index[g] for g in grams(w) if g in index}), int) for w, _, _ in rows]
    y = np.array([classes.index(c) for _, c, _ in rows])
    share = 1 / np.bincount(y, minlength=len(classes)).clip(1)[y] / len(set(y.tolist()))
    flat, owner = np.concatenate(at), np.repeat(np.arange(len(rows)), [len(a) for a in at])
    weights, bias = np.zeros((len(index), len(classes))), np.zeros(len(classes))
    speed_w, speed_b = np.zeros_like(weights), np.zeros_like(bias)
    hot = np.eye(len(classes))[y]
    for _ in range(steps):
        z = np.zeros((len(rows), len(classes)))
        np.add.at(z, owner, weights[flat])
        p = _softmax(z + bias)
        gap = (p - hot) * share[:, None]
        slope = np.zeros_like(weights)
        np.add.at(slope, flat, gap[owner])
        speed_w = 0.9 * speed_w + slope + 1e-5 * weights
        speed_b = 0.9 * speed_b + gap.sum(axis=0)
        weights -= 0.6 * speed_w
        bias -= 0.6 * speed_b
    return weights, bias


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def sample(docs: DataFrame) -> list[str]:
    """Texts of the first SAMPLE_DOCS documents by a hash, one row (the least text) of each doc_id.

    Only rows whose hash is in the lowest part of its range leave the scan: some eight times as many as are taken.
    """
    rows = docs.count()  # from the files' footers
    share = min(1.0, 8 * SAMPLE_DOCS / max(1, rows))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 33)
    few = doc_texts(docs).where(F.col("doc_id").isNotNull() & (place <= int(share * 2**31)) & (F.length("text") <= SAMPLE_CHARS))
    return [r.text for r in few.groupBy("doc_id").agg(F.min("text").alias("text")).orderBy(place, "doc_id").limit(SAMPLE_DOCS).collect()]


def fit(docs: DataFrame) -> LicenseModel:
    """Train on the templates and on lines of a bounded sample of documents."""
    rng = random.Random(5)
    marks = set(tokens("license licensed copyright permission permitted redistribution rights warranty domain spdx"))
    lines = [w for t in sample(docs) for w in map(tokens, t.split("\n")) if w and not marks.intersection(w)]
    ordinary = rng.sample(lines, min(len(lines), SAMPLE_PARAGRAPHS))
    rows = _examples(rng, ordinary)
    rng.shuffle(rows)
    classes = (NONE, UNKNOWN, *TEMPLATES)
    known = {g for s in (*OTHERS, *(s for f in TEMPLATES.values() for s in f)) for g in grams(tokens(s))}
    index = {g: i for i, g in enumerate(sorted(known))}
    z, y, words = [], [], []
    for fold in range(FOLDS):  # no variant of a sentence is on both sides
        part = LicenseModel(classes, index, *_train([r for r in rows if r[2] != fold], classes, index, FOLD_STEPS), 1.0, 0.0)
        apart = [r for r in rows if r[2] == fold]
        z += [_logits(part, w) for w, _, _ in apart]
        y += [classes.index(c) for _, c, _ in apart]
        words += [w for w, _, _ in apart]
    z, y = np.array(z), np.array(y)
    apart = y < 2  # texts of no family are always new ones; a family's sentences are those that the final model knows
    losses = {t: -np.log(_softmax(z / t)[apart, y[apart]].clip(1e-12)).mean() for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)}
    temperature = min(losses, key=losses.__getitem__)
    p = _softmax(z / temperature)
    top, best = p[:, 2:].max(axis=1), p[:, 2:].argmax(axis=1) + 2
    other = y == classes.index(UNKNOWN)
    named = np.array([o and q[0] < 0.5 and confirmed(w, classes[c]) > 0 for o, q, w, c in zip(other, p, words, best, strict=True)])
    least = next((t for t in np.arange(0.3, 0.96, 0.05) if (named & (top >= t)).sum() <= 0.01 * other.sum()), 0.95)
    weights, bias = _train(rows, classes, index, STEPS)
    return LicenseModel(classes, index, weights, bias, temperature, float(least))


def _logits(model: LicenseModel, words: list[str]) -> np.ndarray:
    rows = sorted({i for i in map(model.index.get, grams(words)) if i is not None})
    return model.weights[rows].sum(axis=0) + model.bias


_PAIRS = {family: [set(zip(t, t[1:], strict=False)) for t in map(tokens, sentences)] for family, sentences in TEMPLATES.items()}


def confirmed(words: list[str], family: str, at_least: float = CONFIRM) -> float:
    """Greatest part of a template's word pairs, or of the paragraph's own, that the two share; 0 if too small."""
    own = set(zip(words, words[1:], strict=False))
    best = max((len(own & pairs) / min(len(pairs), max(len(own), 4)) for pairs in _PAIRS[family]), default=0.0)
    return best if best >= at_least else 0.0


class Scanner:
    def __init__(self, model: LicenseModel):
        self.model = model
        #: Words of templates that are no ordinary ones: a paragraph without any is of the class none.
        spread = model.weights[:, 0] < 0
        self.telling = {w for w, i in model.index.items() if " " not in w and spread[i]}

    def classified(self, text: str) -> tuple[str, float, float] | None:
        """Family or "unknown", probability and template likeness of one paragraph; None if it is no licence."""
        words = tokens(text)
        if self.telling.isdisjoint(words):
            return None
        p = _softmax(_logits(self.model, words) / self.model.temperature)
        best = int(p[2:].argmax()) + 2
        if p[0] >= 0.5:
            return None
        family, chance = self.model.classes[best], float(p[best])
        alike = confirmed(words, family)
        return (family, chance, alike) if alike and chance >= self.model.least else (UNKNOWN, float(p[1]), alike)

    def paragraphs(self, text: str) -> list[tuple[str, float, float, int, int]]:
        """Family or "unknown", probability, template likeness, start and end of each licence paragraph."""
        found = []
        for lines in blocks(text):
            start, end = lines[0][0], lines[-1][1]
            whole = self.classified(text[start:end])
            if len(lines) > 1 and (whole is None or whole[0] == UNKNOWN):
                own = [(*c, a, b) for a, b in lines if (c := self.classified(text[a:b])) is not None]
                if own or whole is None:
                    found += own
                    continue
            if whole is not None:
                found.append((*whole, start, end))
        return found


def blocks(text: str) -> list[list[tuple[int, int]]]:
    """Start and end of the lines of every paragraph."""
    found, now, start = [], [], 0
    for line in text.split("\n"):
        end = start + len(line)
        if line.strip():
            now.append((start, end))
        if now and (not line.strip() or line.rstrip()[-1] in MARKS):
            found.append(now)
            now = []
        start = end + 1
    return [*found, now] if now else found


def scan(docs: DataFrame, model: LicenseModel) -> DataFrame:
    """doc_id, paragraphs array<struct<family,probability,likeness,start,end>>; no shuffle."""
    shape = pa.struct([("family", pa.string()), ("probability", pa.float64()), ("likeness", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model)
        keys = [shape.field(i).name for i in range(5)]
        for part in slices(batches):
            rows = [[dict(zip(keys, p, strict=True)) for p in scanner.paragraphs(t)] for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(shape))], names=["doc_id", "paragraphs"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, paragraphs array<struct<family:string,probability:double,likeness:double,start:int,end:int>>")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, fit(docs))
    families = F.array_sort(F.array_distinct(F.transform("paragraphs", lambda p: p["family"])))
    spans = F.array_join(F.transform("paragraphs", lambda p: F.concat_ws(":", p["family"], p["start"], p["end"])), ",")
    return found.select("doc_id", F.size("paragraphs").alias("n_paragraphs"), F.array_join(families, ",").alias("families"), spans.alias("spans"), F.round(F.array_max(F.transform("paragraphs", lambda p: p["probability"])), 6).alias("probability"))

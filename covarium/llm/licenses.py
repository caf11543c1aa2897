"""Licence scans: a trained paragraph classifier whose findings templates confirm.

A sparse logistic regression over word 1- to 3-grams, one weight vector for each
licence family and one for "unknown", is trained on the templates below in many
altered forms, and as unknown on near misses and on a bounded sample of the corpus's
own windows. The bar over which a family counts is calibrated on held-out altered
templates and windows. Paragraphs are the stretches of a text around words that
tell a family: of a line or a part of it, or of some lines in a row, as notices are
wrapped. What passes is compared with its family's templates and kept if enough of
a template's words and word pairs are in it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covarium.llm.common import text_or_empty, thinned

WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")
#: Bound of the sample of windows that are learnt as unknown, characters of each, and the share of them that may pass the bar.
SAMPLE_PARAGRAPHS, SAMPLE_CHARS, FALSE_RATE = 4000, 600, 1e-3
#: Words between telling words of one stretch, words and lines of a paragraph at most, words around one that a template may begin or end with.
GAP, LONGEST, LINES, AROUND = 12, 80, 6, 30
LEAST_LIKENESS = 0.5
ALTERED = 60
UNKNOWN = "unknown"

# Well-known licence statements, by family.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "Released under the GNU GPL version 2.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "BSD": [
        "Released under the 3-clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"],
    "Proprietary": ["All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited.", "This document is proprietary and confidential."],
}
# Sentences near the subject that state no licence.
NEAR_MISSES = [
    "He was issued a driving licence by the county office.",
    "The licence fee rose again this year for every household.",
    "The general public was invited to the free concert.",
    "Version 2.0 of the program was released in March.",
    "Permission was granted to build the house by the lake.",
    "You may not use the pool without a towel.",
    "The apache people lived in the southwest.",
    "Students at MIT built a new robot.",
    "Copyright law differs between countries.",
    "The fishing license must be renewed each spring.",
    "Conditions of the road were poor and the work was stopped.",
    "A copy of the letter was found in the library.",
]


def words_of(paragraph: str) -> list[str]:
    return WORD.findall(paragraph.lower())


def _grams(words: list[str]) -> set[str]:
    """1- to 3-grams of words, and the parts of hyphenated ones, which name a family in many identifiers."""
    parts = [p for w in words if "-" in w for p in w.split("-")]
    return {*words, *parts, *map(" ".join, zip(words, words[1:])), *map(" ".join, zip(words, words[1:], words[2:]))}


def _altered(rng: np.random.Generator, template: str, filler: list[str]) -> str:
    """A template with words lost, swapped or put in, within words of the corpus."""
    words = template.split()
    keep = [w for w in words if rng.random() > 0.06] or words
    for _ in range(rng.integers(0, 3)):
        keep.insert(int(rng.integers(0, len(keep) + 1)), str(rng.choice(filler)))
    around = [str(w) for w in rng.choice(filler, rng.integers(0, 6))]
    return " ".join([*around[:2], *keep, *around[2:]])


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    bar: float

    def probabilities(self, words: list[str]) -> np.ndarray:
        z = np.array(self.bias)
        get = self.weights.get
        rows = [w for g in _grams(words) if (w := get(g)) is not None]
        if rows:
            z = z + np.sum(rows, axis=0) / max(1, len(words)) ** 0.5
        e = np.exp(z - z.max())
        return e / e.sum()


def likeness(words: list[str], family: str) -> float:
    """The best share of a template's word pairs, weighted to its words, that a paragraph has."""
    own = {*words, *zip(words, words[1:])}
    return max(len(own & t) / len(t) for t in _template_grams[family])


_template_grams = {f: [{*w, *zip(w, w[1:])} for t in ts if (w := words_of(t))] for f, ts in TEMPLATES.items()}


def fit(windows: list[str], seed: int = 5, rounds: int = 300, left_out: frozenset[str] = frozenset()) -> Model:
    """Train on altered templates against ``windows`` of the corpus and near misses; a fifth of each is held out for the bar.

    Windows that a template confirms are no unknown ones and not used. ``left_out``
    are templates that aren't learnt from, to measure what is found of unseen ones.
    """
    rng = np.random.default_rng(seed)
    plain = [w for p in windows if (w := words_of(p)) and all(likeness(w, f) < LEAST_LIKENESS for f in TEMPLATES)]
    filler = sorted({w for p in plain[:200] for w in p})[:500] or ["text", "page", "note"]
    families = (*TEMPLATES, UNKNOWN)
    texts, labels = [], []
    for k, family in enumerate(TEMPLATES):
        for template in TEMPLATES[family]:
            if template not in left_out:
                texts += [template, *(_altered(rng, template, filler) for _ in range(ALTERED))]
                labels += [k] * (ALTERED + 1)
    pieces = []
    for p in plain:
        start = int(rng.integers(0, len(p)))
        pieces.append(" ".join(p[start : start + int(rng.integers(2, 60))]))
    misses = [*pieces, *NEAR_MISSES, *(_altered(rng, m, filler) for m in NEAR_MISSES for _ in range(ALTERED // 2)), ""]
    texts += misses
    labels += [len(families) - 1] * len(misses)
    grams = [_grams(words_of(t)) for t in texts]
    size = np.array([max(1, len(words_of(t))) ** 0.5 for t in texts], np.float32)
    y = np.array(labels)
    held = rng.random(len(y)) < 0.2
    seen: dict[str, int] = {}
    for g, h in zip(grams, held):
        if not h:
            for x in g:
                seen[x] = seen.get(x, 0) + 1
    stated = {x for ts in TEMPLATES.values() for t in ts for x in _grams(words_of(t))} | {x for t in NEAR_MISSES for x in _grams(words_of(t))}
    vocabulary = {x: i for i, x in enumerate(sorted(x for x, n in seen.items() if n >= 3 and x in stated))}
    # some thousands of texts by some thousands of grams
    x = np.zeros((len(y), len(vocabulary)), np.float32)
    for i, g in enumerate(grams):
        x[i, [vocabulary[w] for w in g if w in vocabulary]] = 1 / size[i]
    train = np.flatnonzero(~held)
    x, target = x[train], np.eye(len(families), dtype=np.float32)[y[train]]
    balance = (1 / np.bincount(y[train], minlength=len(families)).clip(1))[y[train]].astype(np.float32)[:, None]
    w, b = np.zeros((len(vocabulary), len(families)), np.float32), np.zeros(len(families), np.float32)
    gw, gb = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    for _ in range(rounds):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = (p - target) * balance
        grad = x.T @ d + 1e-5 * w
        gw += grad**2
        gb += d.sum(axis=0) ** 2
        w -= 0.5 * grad / np.sqrt(gw)
        b -= 0.5 * d.sum(axis=0) / np.sqrt(gb)
    model = Model(families, {g: tuple(map(float, w[i])) for g, i in vocabulary.items()}, tuple(map(float, b)), 0.5)
    top = [1 - model.probabilities(words_of(t))[-1] for t, h, k in zip(texts, held, labels) if h and k == len(families) - 1]
    return Model(model.families, model.weights, model.bias, float(np.quantile(top, 1 - FALSE_RATE)) if top else 0.5)


def learn(docs: DataFrame, sample: int = SAMPLE_PARAGRAPHS) -> Model:
    """Fit on the corpus's own windows: the first ``sample`` documents by a hash of their doc_id give one each, from anywhere in the text."""
    text = text_or_empty()
    start = 1 + F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.greatest(F.lit(1), F.length(text) - SAMPLE_CHARS))
    few = docs.where(thinned(F.xxhash64("doc_id"), docs.count(), sample))
    rows = few.select(F.xxhash64("doc_id").alias("h"), F.substring(text, start.cast("int"), F.lit(SAMPLE_CHARS)).alias("window")).where("window <> ''").orderBy("h", "window").limit(sample)
    return fit([r["window"] for r in rows.collect()])


def _telling(model: Model) -> set[str] | None:
    """Words of which a paragraph must have one to be nearer a family than "unknown"; None if the bias alone may be."""
    if max(model.bias[:-1]) > model.bias[-1]:
        return None
    out: set[str] = set()
    for gram in sorted(model.weights, key=lambda g: g.count(" ")):
        w = model.weights[gram]
        if max(w[:-1]) > w[-1] and out.isdisjoint(parts := gram.split()):
            out.add(max(parts, key=len))
    return out


def paragraphs(words: list[str], lines: list[int], telling: set[str] | None) -> Iterator[tuple[int, int]]:
    """Spans of words that may state a licence, around telling words at most ``GAP`` words apart.

    Of each stretch of one line or of some in a row, windows of ``LONGEST`` words
    that overlap by half where it is longer.
    """
    at = [i for i, w in enumerate(words) if telling is None or w in telling]
    cuts = [0, *(k for k in range(1, len(at)) if at[k] - at[k - 1] > GAP), len(at)]
    for a, b in zip(cuts, cuts[1:]):
        own = at[a:b]
        starts = [k for k in range(len(own)) if not k or lines[own[k]] != lines[own[k - 1]]] + [len(own)]
        for i in range(len(starts) - 1):
            for j in range(i + 1, min(i + LINES, len(starts) - 1) + 1):
                first, last = own[starts[i]], own[starts[j] - 1]
                if last - first < LONGEST:
                    yield first, last + 1
                elif j == i + 1 or j == min(i + LINES, len(starts) - 1):
                    for k in range(first, last + 1, LONGEST // 2):
                        yield k, min(last + 1, k + LONGEST)


def statements(text: str, model: Model, telling: set[str] | None) -> list[tuple[int, int, str, float, float]]:
    """``line, last line, family, probability, likeness`` of each statement in a text, in order; of overlapping paragraphs the likest, shortest one."""
    lowered = text.lower()
    words = WORD.findall(lowered)
    if telling is not None and telling.isdisjoint(words):
        return []
    ends = [m.start() for m in re.finditer("\n", lowered)]
    lines = [bisect_left(ends, m.start()) for m in WORD.finditer(lowered)]
    found = []
    for a, b in dict.fromkeys(paragraphs(words, lines, telling)):
        p = model.probabilities(words[max(0, a - 2) : b + 2])
        k = int(p[:-1].argmax())
        if 1 - p[-1] > model.bar and p[k] > p[-1]:
            alike = likeness(words[max(0, a - AROUND) : b + AROUND], model.families[k])
            if alike >= LEAST_LIKENESS:
                found.append((-alike, b - a, a, b, k, float(p[k])))
    taken: list[tuple[int, int]] = []
    out = []
    for minus, _, a, b, k, p in sorted(found):
        if all(b <= c or a >= d for c, d in taken):
            taken.append((a, b))
            out.append((a, lines[a], lines[b - 1], model.families[k], p, -minus))
    return [row[1:] for row in sorted(out)]


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """Licence statements in whole texts, one row for each.

    Returns ``doc_id, paragraph, last_paragraph`` (line numbers from 0), ``family,
    probability, template_likeness``. Null, empty and licence-free texts give no
    rows; repeated rows and null doc_ids give theirs; an empty table gives an empty
    one; other columns are not read. Lines of any length are looked at whole.
    """
    schema = "doc_id long, paragraph int, last_paragraph int, family string, probability double, template_likeness double"
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64()]
    telling = _telling(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, *row) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)) for row in statements(text.as_py(), model, telling)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)

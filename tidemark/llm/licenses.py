"""Licence scans: a trained paragraph classifier, an unknown class, and templates that confirm what it says.

A paragraph is a line, or several that a notice is wrapped over: consecutive lines that each share a pair of words with a
template, up to one that ends a sentence. Its features are its words and pairs of words; a multinomial logistic regression with L2 penalty
tells licence families and ``unknown`` apart. It is trained here: paragraphs of each family are made from its notices
(whole, in parts, with words dropped or put in, with other wording around its names); paragraphs of ``unknown`` are made
from sentences about licences of other kinds and, unlabelled, from whole lines that name no licence: at most ``SAMPLE_LINES``,
those with the least hashes, of ``sample_rows`` documents. Both are bounds of the training sample only. Probabilities are calibrated by a temperature on a part held back from training. A prediction stands where its
probability reaches ``least`` and the paragraph has most of its pairs in common with one of the family's templates.

Only what a template confirms stands, so paragraphs that share no pair of words with any template are unknown without
being classified; that changes no result.

Defined cases: null, empty and blank texts have no licence; equal rows get equal results; several families in one
document are all listed, one for each paragraph, the first of the most probable is ``family``; n_paragraphs counts lines and a
paragraph's number is that of its first line; an empty table gives an empty result. Only doc_id
and text are read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

UNKNOWN = "unknown"
SAMPLE_ROWS, SAMPLE_LINES = 1000, 4000
LEAST, LEAST_SHARED = 0.7, 0.6
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+(?:[.-][a-z0-9]+)*")

# Names and customary notices of public licences.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license", "Apache 2.0 License"],
    "MIT": ["MIT License", "MIT license", "Expat License"],
    "GPL": ["GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL v3", "GNU GPL version 2 or later", "GPL-3.0", "GPL-2.0"],
    "LGPL": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License, version 2.1", "GNU LGPL v3", "LGPL-2.1"],
    "AGPL": ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0"],
    "BSD": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD license", "BSD-3-Clause license"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, version 2.0", "EPL-2.0"],
    "ISC": ["ISC License", "ISC license"],
    "CC0": ["CC0 1.0 Universal", "CC0 1.0", "Creative Commons Zero 1.0"],
    "CC-BY": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0"],
    "CC-BY-SA": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0", "CC BY-SA 3.0"],
    "CC-BY-NC": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"],
    "CC-BY-ND": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License", "CC-BY-ND-4.0"],
    "CC-BY-NC-SA": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "Unlicense": ["Unlicense", "The Unlicense"],
}
NOTICES = {
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "MIT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "AGPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Proprietary": ["All rights reserved.", "Copyright holder. All rights reserved.", "No part of this publication may be reproduced or transmitted in any form without the prior written permission of the copyright owner.", "This document is confidential and proprietary."],
}
FRAMES = ["Released under the {}.", "Licensed under the {}.", "Licensed under {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "Distributed under the terms of the {}.", "This project is available under the {}.", "SPDX-License-Identifier: {}", "License: {}", "The code is covered by the {}."]
OTHER = [
    "His license to drive was taken away last year.", "You need a license to fish in this lake.", "The restaurant lost its liquor license.",
    "Please read the terms of service before you use the site.", "The distribution of the sample is shown in the figure.", "The general public was not admitted to the hearing.",
    "Students at MIT built the machine over the summer.", "The Apache tribes lived in the Southwest.", "The public domain of the city was sold.", "All rights come with duties.",
    "A copy of the report was distributed to the members.", "The software was released on the first of May.", "The state issued the licence under the new act.",
    "Version 2.0 of the program is faster than version 1.0.", "She has permission to use the library.", "Creative work needs common sense.",
]


def templates() -> dict[str, list[str]]:
    """The notices of each family, the frames filled in with its names."""
    made = {f: [x.format(name) for name in names for x in FRAMES] for f, names in NAMES.items()}
    for family, notices in NOTICES.items():
        made[family] = [*made.get(family, []), *notices]
    return made


def _words(line: bytes) -> list[bytes]:
    return _WORD.findall(line.lower())


def _pairs(words: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(words, words[1:]))


def _features(words: list[bytes]) -> set:
    return {*words, *_pairs(words)}


def _spoilt(text: str, rng: random.Random, fillers: list[str]) -> str:
    """A notice as it may be found: a part of it, a few words lost, some others before or after."""
    words = text.split()
    if len(words) > 8 and rng.random() < 0.5:
        n = rng.randint(max(6, len(words) // 2), len(words))
        begin = rng.randint(0, len(words) - n)
        words = words[begin : begin + n]
    words = [w for w in words if rng.random() > 0.03] or words
    if rng.random() < 0.3:
        around = rng.choice(fillers).split()[: rng.randint(1, 4)]
        words = around + words if rng.random() < 0.5 else words + around
    made = " ".join(words)
    return made.upper() if rng.random() < 0.1 else made


@dataclass
class Classifier:
    """Weights by feature (a row for each) over the families, the temperature, and the templates' pairs."""

    families: list[str]
    place: dict
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    shapes: list[list[set]]

    def __post_init__(self) -> None:
        self.anchors = frozenset(p for some in self.shapes for pairs in some for p in pairs)

    def probabilities(self, words: list[bytes]) -> np.ndarray:
        at = sorted(self.place[f] for f in _features(words) if f in self.place)
        z = (self.weights[at].sum(0) + self.bias) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()

    def shared(self, words: list[bytes], family: int) -> float:
        """Greatest share of pairs that the paragraph and one of the family's templates have in common, of the shorter of them."""
        own, best = _pairs(words), 0.0
        for shape in self.shapes[family]:
            both = len(own & shape)
            if both:
                best = max(best, both / max(3, min(len(own), len(shape))) if min(len(own), len(shape)) > 2 else both / min(len(own), len(shape)))
        return best

    def anchored(self, line: bytes) -> bool:
        """Whether a line shares a pair of words with any template."""
        words = _words(line)
        return not self.anchors.isdisjoint(zip(words, words[1:]))

    def classify(self, line: bytes, least: float = LEAST, least_shared: float = LEAST_SHARED) -> tuple[str, float, float] | None:
        """(family, probability, share) of a paragraph that is a licence; None where it is unknown."""
        words = _words(line)
        if len(words) < 2:
            return None
        p = self.probabilities(words)
        best = int(p.argmax())
        if self.families[best] == UNKNOWN or p[best] < least:
            return None
        shared = self.shared(words, best)
        return (self.families[best], float(p[best]), shared) if shared >= least_shared else None


def _fit(rows: list[list[int]], target: np.ndarray, n_features: int, n_classes: int, rounds: int = 300, rate: float = 0.1, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression on sparse 0/1 rows, by gradient steps with momentum (Adam)."""
    counts = np.array([len(r) for r in rows])
    flat = np.fromiter((i for r in rows for i in r), np.int64, int(counts.sum()))
    owner = np.repeat(np.arange(len(rows)), counts)
    by_feature = np.argsort(flat, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], np.diff(flat[by_feature]) > 0]))
    touched = flat[by_feature][head]
    theta = np.zeros((n_features + 1, n_classes))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    first = np.cumsum(counts) - counts
    for step in range(1, rounds + 1):
        z = np.add.reduceat(theta[flat], first, axis=0) + theta[-1]
        z = np.exp(z - z.max(1, keepdims=True))
        error = z / z.sum(1, keepdims=True)
        error[np.arange(len(rows)), target] -= 1
        error /= len(rows)
        grad = ridge * theta
        grad[touched] += np.add.reduceat(error[owner[by_feature]], head, axis=0)
        grad[-1] = error.sum(0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], theta[-1]


_ABOUT = re.compile(r"licen|copyright|permission|warrant|rights|redistribut|public domain|creative|gnu|mozilla|apache", re.IGNORECASE)


def train(lines: list[str], *, seed: int = 11, per_notice: int = 3, held_back: float = 0.25) -> Classifier:
    """Fit on made paragraphs and on ``lines`` of ordinary text."""
    rng, known = random.Random(seed), templates()
    families = [UNKNOWN, *sorted(known)]
    fillers = [x for x in lines if x.strip()][:200] or OTHER
    examples = [(x, f) for f, notices in known.items() for notice in notices for x in [notice, *(_spoilt(notice, rng, fillers) for _ in range(per_notice * (1 + 4 * (len(notice.split()) > 12))))]]
    plain = [x for x in lines if not _ABOUT.search(x)]
    examples += [(x, UNKNOWN) for x in [*(_spoilt(o, rng, OTHER) for o in OTHER for _ in range(8)), *OTHER, *plain]]
    rng.shuffle(examples)
    words = [_words(x.encode()) for x, _ in examples]
    target = np.array([families.index(f) for _, f in examples])
    cut = int(len(examples) * held_back)
    seen: dict = {}
    for w in words[cut:]:
        for f in _features(w):
            seen[f] = seen.get(f, 0) + 1
    place = {f: i for i, f in enumerate(sorted((f for f, n in seen.items() if n >= 2), key=repr))}
    rows = [sorted(place[f] for f in _features(w) if f in place) or [len(place)] for w in words]
    weights, bias = _fit(rows[cut:], target[cut:], len(place) + 1, len(families))
    z = np.array([weights[r].sum(0) + bias for r in rows[:cut]])

    def loss(temperature: float) -> float:
        x = z / temperature
        x = x - x.max(1, keepdims=True)
        return float((np.log(np.exp(x).sum(1)) - x[np.arange(cut), target[:cut]]).mean())

    temperature = min((2 ** (k / 4) for k in range(-8, 13)), key=loss)
    shapes = [[], *([_pairs(_words(x.encode())) for x in known[f]] for f in families[1:])]
    return Classifier(families, place, weights, bias, temperature, shapes)


def sample_lines(docs: DataFrame, rows: int, most: int = SAMPLE_LINES) -> list[str]:
    """At most ``most`` distinct lines of about ``rows`` documents, each by least hashes."""
    chosen = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    lines = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.explode(F.split("text", "\n")).alias("line"))
    return [r["line"] for r in lines.filter("line <> ''").distinct().orderBy(F.xxhash64("line"), "line").limit(most).collect()]


def paragraphs(lines: list[bytes], anchored: Callable[[bytes], bool]) -> Iterator[tuple[int, bytes]]:
    """(number of the first line, text) of what may be a notice: lines that are ``anchored``, those of a sentence joined."""
    held: list[bytes] = []
    for i, line in enumerate(lines):
        if not anchored(line):
            if held:
                yield i - len(held), b" ".join(held)
            held = []
            continue
        held.append(line)
        if line.rstrip()[-1:] in b".!?":
            yield i + 1 - len(held), b" ".join(held)
            held = []
    if held:
        yield len(lines) - len(held), b" ".join(held)


def scan(docs: DataFrame, *, sample_rows: int = SAMPLE_ROWS, least: float = LEAST) -> DataFrame:
    """(doc_id, n_paragraphs, found) of each row; found lists (paragraph, family, probability, shared), paragraphs from 0."""
    model = docs.sparkSession.sparkContext.broadcast(train(sample_lines(docs, sample_rows)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ("paragraph", "family", "probability", "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier, types = model.value, (pa.int32(), pa.string(), pa.float64(), pa.float64())
        for ids, texts in common.text_slices(batches, "doc_id"):
            sizes, ends, rows = [], [0], []
            for text in texts:
                lines = text.split(b"\n") if text else []
                sizes.append(len(lines))
                for i, paragraph in paragraphs(lines, classifier.anchored):
                    if found := classifier.classify(paragraph, least):
                        rows.append((i, *found))
                ends.append(len(rows))
            values = pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=fields)
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), found], names=["doc_id", "n_paragraphs", "found"])

    schema = f"doc_id {kind}, n_paragraphs long, found array<struct<paragraph:int,family:string,probability:double,shared:double>>"
    return common.in_arrow(docs.select("doc_id", "text"), run, schema)


def licenses(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_paragraphs, n_licensed, family, families, probability) of each row; family is null where no licence was found."""
    rows = scan(docs, **options)
    best = F.element_at(F.sort_array(F.transform("found", lambda x: F.struct(-x["probability"], x["paragraph"], x["family"], x["probability"]))), 1)
    some = F.size("found") > 0
    return rows.select(
        "doc_id",
        "n_paragraphs",
        F.size("found").cast("long").alias("n_licensed"),
        F.when(some, best["family"]).alias("family"),
        F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"]))).alias("families"),
        F.when(some, best["probability"]).alias("probability"),
    )

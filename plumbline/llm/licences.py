"""License scans (4): a trained classifier of paragraphs, confirmed against templates.

A paragraph is a run of lines without a blank one between, comment signs apart; a line that ends a sentence ends it too,
unless the next starts with a small letter. So wrapped lines are joined. A paragraph is read in windows of ``WINDOW`` words,
every half window, and each window is judged. Word 1- and 2-grams of the templates are the features of a logistic
regression over licence families and an unknown class, fitted with an L1 penalty, so most weights are zero. It learns from
the templates, cut and blurred, and for the unknown class from phrases that only sound alike and from windows of the
corpus that share word pairs with templates without being any. A temperature and a threshold are set on templates that
the scoring model did not see (each template is held out once); then a template of the predicted family must share
enough word pairs with the window to confirm it. A window that shares fewer than two word pairs with all templates can't be
confirmed and counts as unknown without being scored; no other gate decides what the classifier sees.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import small_batches, table

#: What licences say, by family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "BSD": [
        "Distributed under the 3-Clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0": [
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "Zlib": [
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        "SPDX-License-Identifier: Zlib",
    ],
}
#: Phrases that are no licence.
NO_LICENCE = [
    "She lost her driving license in March and had to take the bus.", "The restaurant applied for a liquor license last year.",
    "He was granted permission to enter the building.", "The warranty on the fridge has expired.",
    "A copyright dispute between two publishers went to court.", "Poetic license allows for such liberties.",
    "The land was released into the public domain of the city.", "Fishing without a license is not allowed here.",
    "You need permission from the owner to park here.", "The redistribution of income was debated at length.",
    "All staff hold a license to operate the crane, version two of the form.", "The pilot showed a valid license at the gate.",
    "Copyright is a topic of the next chapter.", "GNU is a recursive name, and Mozilla was a mascot.",
]
UNKNOWN = "unknown"
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
#: Comment signs and blanks before a line's text.
LEAD = re.compile(r"^[\s#*/;%!>|-]*")
#: Words of a window.
WINDOW = 64
#: Bounds of the training sample: documents looked at (about), windows of them taken as examples of the unknown class.
SAMPLE_DOCS, NEGATIVES = 2000, 1000
#: Blurred examples for a family; the share of word pairs that confirms, of templates of up to ``SHORT`` pairs and of longer ones.
EXAMPLES, SHORT, CONFIRM_SHORT, CONFIRM = 80, 8, 0.8, 0.5


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams(ws: list[str]) -> list[str]:
    return ws + [f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)]


def pairs(ws: list[str]) -> set[tuple[str, str]]:
    return set(zip(ws, ws[1:], strict=False))


#: The word pairs of each template, by family, and of all templates.
OWN = {family: [pairs(words(t)) for t in own] for family, own in TEMPLATES.items()}
PAIRS = frozenset().union(*(p for own in OWN.values() for p in own))


def paragraphs(text: str) -> list[str]:
    """The paragraphs of a text, wrapped lines joined by blanks."""
    out: list[str] = []
    open_ = False
    for line in text.split("\n"):
        own = line[LEAD.match(line).end() :].rstrip()
        if not own:
            open_ = False
        elif open_ and (out[-1][-1] not in ".!?:" or own[0].islower()):
            out[-1] += " " + own
        else:
            out.append(own)
            open_ = True
    return out


def windows(ws: list[str], size: int = WINDOW) -> list[list[str]]:
    """The words in windows of ``size``, each starting half a window behind the one before; the last may be shorter."""
    return [ws[i : i + size] for i in range(0, max(1, len(ws) - size // 2), size // 2)]


@dataclass
class Model:
    """families and the unknown class (last), grams with weights, the temperature and the threshold."""

    classes: list[str]
    index: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, texts: list[list[str]]) -> np.ndarray:
        return _softmax(self._logits(texts) / self.temperature)

    def _logits(self, texts: list[list[str]]) -> np.ndarray:
        out = np.tile(self.bias, (len(texts), 1))
        for i, ws in enumerate(texts):
            at = {self.index[g] for g in grams(ws) if g in self.index}
            if at:
                out[i] += self.weights[sorted(at)].sum(axis=0)
        return out

    def predict(self, texts: list[list[str]]) -> list[tuple[str, float]]:
        """(family or unknown, calibrated probability) of each window, given as words."""
        p = self.probabilities(texts) if texts else np.zeros((0, len(self.classes)))
        best = p.argmax(axis=1)
        return [(self.classes[b] if p[i, b] >= self.threshold else UNKNOWN, float(p[i, b])) for i, b in enumerate(best)]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def confirmed(family: str, ws: list[str]) -> bool:
    """Whether a template of the family and the window share enough of the word pairs of the shorter one."""
    own = pairs(ws)
    for other in OWN[family]:
        both = len(own & other)
        if both >= 2 and both >= (CONFIRM_SHORT if len(other) <= SHORT else CONFIRM) * min(len(own), len(other)):
            return True
    return False


def like_none(ws: list[str]) -> bool:
    """Whether no template shares a quarter of its word pairs with the window."""
    own = pairs(ws)
    return all(len(own & other) < 0.25 * len(other) for family in OWN.values() for other in family)


def _examples(templates: dict[str, list[str]], negatives: list[list[str]], rng: np.random.Generator, n: int) -> tuple[list[list[str]], list[str]]:
    texts, labels = [], []
    pick = lambda x: x[int(rng.integers(0, len(x)))]
    phrases = [words(t) for t in NO_LICENCE]
    filler = [w for ws in negatives for w in ws] or ["text"]
    for family, own in templates.items():
        for k in range(n if own else 0):
            ws = words(own[k % len(own)])
            if len(ws) > 10 and rng.random() < 0.5:  # a part of a long one
                size = int(rng.integers(8, len(ws)))
                at = int(rng.integers(0, len(ws) - size + 1))
                ws = ws[at : at + size]
            if len(ws) > 6:
                ws = [w for w in ws if rng.random() > 0.08]
            if rng.random() < 0.4:
                around = [pick(filler) for _ in range(int(rng.integers(1, 40)))]
                at = int(rng.integers(0, len(around) + 1))
                ws = around[:at] + ws + around[at:]
            texts.append(ws)
            labels.append(family)
    for k in range(n * 4):
        ws = list(pick(phrases if k % 2 or not negatives else negatives))
        if rng.random() < 0.5:  # words of licences that make none
            ws += [pick(pick(phrases)) for _ in range(5)]
        texts.append(ws)
        labels.append(UNKNOWN)
    return texts, labels


def _trained(templates: dict[str, list[str]], negatives: list[list[str]], rng: np.random.Generator, rounds: int, rate: float, l1: float) -> Model:
    classes = [*TEMPLATES, UNKNOWN]
    index = {g: i for i, g in enumerate(sorted({g for own in [*templates.values(), NO_LICENCE] for t in own for g in grams(words(t))}))}
    model = Model(classes, index, np.zeros((len(index), len(classes)), np.float32), np.zeros(len(classes), np.float32), 1.0, 0.5)
    texts, labels = _examples(templates, negatives, rng, EXAMPLES)
    x = np.zeros((len(texts), len(index)), np.float32)
    for i, ws in enumerate(texts):
        x[i, [index[g] for g in grams(ws) if g in index]] = 1
    target = np.eye(len(classes), dtype=np.float32)[[classes.index(c) for c in labels]]
    back = np.ascontiguousarray(x.T)
    for _ in range(rounds):
        err = (_softmax(x @ model.weights + model.bias) - target) / len(x)
        w = model.weights - rate * 20 * (back @ err)
        model.weights = np.sign(w) * np.maximum(np.abs(w) - rate * 20 * l1, 0)
        model.bias -= rate * err.sum(axis=0)
    used = np.flatnonzero(np.abs(model.weights).sum(axis=1))
    names = list(index)
    model.index, model.weights = {names[i]: k for k, i in enumerate(used)}, model.weights[used]
    return model


def fit(negatives: list[list[str]], seed: int = 11, rounds: int = 200, rate: float = 0.5, l1: float = 2e-4, folds: int = 3) -> Model:
    """Fit and calibrate; ``negatives`` are windows of the corpus, as words, that are no licence.

    Template k of a family and every third negative are in fold k mod ``folds``; a fold's examples are scored by a model that saw
    neither, and the temperature and the threshold are set on all of these scores. The model returned saw all.
    """
    rng = np.random.default_rng(seed)
    classes = [*TEMPLATES, UNKNOWN]
    logits, y = [], []
    for f in range(folds):
        seen = {c: [t for k, t in enumerate(own) if k % folds != f] for c, own in TEMPLATES.items()}
        held = {c: [t for k, t in enumerate(own) if k % folds == f] for c, own in TEMPLATES.items()}
        model = _trained(seen, [x for k, x in enumerate(negatives) if k % folds != f], rng, rounds, rate, l1)
        texts, labels = _examples(held, negatives[f::folds], rng, EXAMPLES // 4)
        logits.append(model._logits(texts))
        y += [classes.index(c) for c in labels]
    scores, y = np.concatenate(logits), np.array(y)
    loss = lambda t: -np.log(_softmax(scores / t)[np.arange(len(y)), y] + 1e-12).mean()
    model = _trained(TEMPLATES, negatives, rng, rounds, rate, l1)
    model.temperature = float(min(np.geomspace(0.1, 10, 80), key=loss))
    p = _softmax(scores / model.temperature)
    # the least threshold from which nine of ten predicted families are right
    best, right = p.max(axis=1), p.argmax(axis=1) == y
    family = p.argmax(axis=1) != len(classes) - 1
    good = [t for t in np.arange(0.3, 0.96, 0.05) if not (sure := family & (best >= t)).any() or right[sure].mean() >= 0.9]
    model.threshold = float(min(good, default=0.95))
    return model


def fit_on(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, negatives: int = NEGATIVES) -> Model:
    """Fit with negatives from about ``sample_docs`` documents of ``docs``, by a hash of doc_id.

    Executors cut them into windows; the driver gets ``negatives`` windows like no template at most, those that share word
    pairs with templates first.
    """
    n = docs.count()
    share = min(1.0, sample_docs / max(n, 1))
    chosen = docs.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))).select(F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(0).to_pylist():
                own = [w for p in paragraphs(text) for w in windows(words(p)) if w and like_none(w)]
                yield pa.RecordBatch.from_arrays([pa.array([" ".join(w) for w in own], pa.string()), pa.array([bool(pairs(w) & PAIRS) for w in own], pa.bool_())], names=["words", "shares"])

    small_batches(docs.sparkSession)
    found = chosen.mapInArrow(run, "words string, shares boolean").distinct()
    rows = found.orderBy(F.desc("shares"), F.xxhash64("words"), "words").limit(negatives).collect()
    return fit([r["words"].split(" ") for r in rows])


SCHEMA = "doc_id long, found array<struct<paragraph:int,family:string,score:double,confirmed:boolean>>"


def judged(text: str, model: Model) -> list[tuple[int, str, float, bool]]:
    """(paragraph, family, score, confirmed) of each family that a window of the paragraph is predicted to be of.

    The windows of a family in a paragraph count once, a confirmed one before others, then by score.
    """
    own = [(i, w) for i, p in enumerate(paragraphs(text)) if not PAIRS.isdisjoint(zip(ws := words(p), ws[1:], strict=False)) for w in windows(ws) if len(PAIRS & pairs(w)) >= 2]
    best: dict[tuple[int, str], tuple[bool, float]] = {}
    for (i, w), (family, score) in zip(own, model.predict([w for _, w in own]), strict=True):
        if family != UNKNOWN:
            best[i, family] = max(best.get((i, family), (False, 0.0)), (confirmed(family, w), score))
    return [(i, family, score, sure) for (i, family), (sure, score) in best.items()]


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, found) of every row: the families of its paragraphs, these by number from 0.

    Null and empty texts have none. Null ids and repeated rows keep their rows; an empty table gives none; other
    columns, whatever their names, play no part. A very long text is read whole, window by window.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("score", pa.float64()), ("confirmed", pa.bool_())]))
        for b in batches:
            out = [[dict(zip(("paragraph", "family", "score", "confirmed"), x, strict=True)) for x in judged(text.as_py() or "", shared.value)] for text in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=["doc_id", "found"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the licence families of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, fit_on(docs))
    sure = F.filter("found", lambda x: x["confirmed"])
    return found.select(
        "doc_id", F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
        F.size(sure).cast("long").alias("n_paragraphs"), (F.size("found") - F.size(sure)).cast("long").alias("n_unconfirmed"),
        F.array_max(F.transform(sure, lambda x: F.round(x["score"], 6))).alias("best_score"),
    )

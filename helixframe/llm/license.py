"""Licence notices: a trained paragraph classifier over word n-grams, with a calibrated unknown class, confirmed by comparison with templates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.textvec import PLAIN, Words, flat, mix64, slices

# Wordings by which the families are granted. The first class is "no licence".
TEMPLATES: dict[str, tuple[str, ...]] = {
    "unknown": (
        "you need a driving license to rent a car in this country", "the version of the story she released under her own name", "all visitors have the right to use the public garden",
        "the work was reserved for another day", "this general rule does not apply to the public", "copyright law is taught in the second year", "the foundation was licensed to sell wine and beer",
        "please read the terms before you sign the contract", "a new version of the report was released this morning", "the software is used by many schools", "permission to enter was granted by the guard",
        "the warranty on this washing machine ended last year", "they reserved two rooms under the name of the director", "he works for the free public library",
    ),
    "Apache": (
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is licensed under the Apache 2.0 license", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "MIT": (
        "Released under the MIT License.", "This project is licensed under the MIT License", "SPDX-License-Identifier: MIT", "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.", "Licensed under the BSD license", "SPDX-License-Identifier: BSD-3-Clause", "Distributed under the 2-clause BSD license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GPL v3", "SPDX-License-Identifier: GPL-3.0-or-later", "GNU GENERAL PUBLIC LICENSE Version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under the LGPL", "SPDX-License-Identifier: LGPL-2.1-only", "GNU LESSER GENERAL PUBLIC LICENSE Version 3",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "AGPL": ("This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the AGPL v3", "SPDX-License-Identifier: AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3"),
    "MPL": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "CC": (
        "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-NC-SA 4.0.", "SPDX-License-Identifier: CC-BY-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "This work is licensed under the Creative Commons Attribution-NonCommercial 3.0 Unported License",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
    ),
    "Public-Domain": (
        "This is free and unencumbered software released into the public domain.", "Released into the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ),
    "ISC": ("Released under the ISC License.", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "Proprietary": ("All rights reserved.", "Copyright 2020 Example Corporation. All rights reserved.", "This document is confidential and proprietary; no part of it may be reproduced without prior written permission.", "Unauthorized copying of this file, via any medium, is strictly prohibited."),
    # A licence of no family above is reported under this name.
    "Other": (
        "Licensed under the Boost Software License, Version 1.0.", "Distributed under the Boost Software License", "Licensed under the Eclipse Public License 2.0", "Released under the zlib license",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0", "Licensed under the Artistic License 2.0", "Available under the SIL Open Font License, Version 1.1.",
        "Licensed under the European Union Public License, version 1.2", "Distributed under the terms of the Common Development and Distribution License", "Released under the Do What The Fuck You Want To Public License",
        "SPDX-License-Identifier: BSL-1.0", "SPDX-License-Identifier: EPL-2.0", "SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: OFL-1.1",
        "Licensed under the Open License, version 1", "Released under the Community License", "Distributed under the terms of the Shared Source License",
    ),
}

SLOTS = 1 << 16
FOUND = "array<struct<paragraph: int, family: string, confidence: double, similarity: double, line: string>>"
_FOUND = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("confidence", pa.float64()), ("similarity", pa.float64()), ("line", pa.string())]))
_TOKEN = re.compile(r"[^\W_]+")


@dataclass
class LicenseModel:
    families: list[str]
    weights: np.ndarray  # slots x families, float32; the last row is the constant
    scale: float  # of the logits: how sure the held-out paragraphs say they may be
    least: float  # confidence below which a family is unknown
    doubt: float = 0.95  # confidence from which a paragraph is no ordinary text


def _grams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text and slot of the runs of one, two and three words."""
    doc, slot = [], []
    h = w.hash
    for n in (1, 2, 3):
        if len(h) < n:
            continue
        m = len(h) - n + 1
        x = h[:m] * np.uint64(n)
        for k in range(1, n):
            x = x * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m]
        inside = w.doc[:m] == w.doc[n - 1 :]
        doc.append(w.doc[:m][inside])
        slot.append((mix64(x[inside]) >> np.uint64(48)).astype(np.int32))
    doc, slot = (np.concatenate(doc), np.concatenate(slot)) if doc else (np.zeros(0, np.int64), np.zeros(0, np.int32))
    order = np.argsort(doc, kind="stable")
    return doc[order], slot[order]


def _logits(model: LicenseModel, w: Words, n: int) -> np.ndarray:
    """Of each text: the sum of its features' weights over the root of their number, and the constant."""
    doc, slot = _grams(w)
    out = np.zeros((n, len(model.families)), np.float32)
    if len(doc):
        new = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        out[doc[new]] = np.add.reduceat(model.weights[slot], new)
        out /= np.sqrt(np.maximum(np.bincount(doc, minlength=n), 1))[:, None]
    return out + model.weights[-1]


def paragraphs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the sentences of each line, all of some texts, and the text of each."""
    n = len(data)
    cut = data == 0x0A
    cut[:-1] |= ((data[:-1] == 0x2E) | (data[:-1] == 0x21) | (data[:-1] == 0x3F)) & (data[1:] == 0x20)
    at = np.unique(np.r_[offsets, np.flatnonzero(cut) + 1])
    at = at[at <= n]
    return at, np.searchsorted(offsets, at[:-1], "right") - 1


#: The family of notices that no known family's templates confirm, and what they say.
UNKNOWN = "unknown"
_NAMED = re.compile(r"(?i)\b(?:un|sub)?licen[sc](?:e|es|ed|ing)\b")


def _unit_words(units: list[str]) -> Words:
    data, offsets = flat(pa.array(units, pa.string()))
    return Words(data, offsets, PLAIN)


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


class _Grams:
    """Paragraphs as sparse rows of n-grams, with what a descent needs of them."""

    def __init__(self, units: list[str]):
        self.n = len(units)
        self.doc, slot = _grams(_unit_words(units))
        self.norm = (1 / np.sqrt(np.maximum(np.bincount(self.doc, minlength=self.n), 1))).astype(np.float32)
        self.seen, self.column = np.unique(slot, return_inverse=True)
        order = np.argsort(self.column, kind="stable")
        self.by_col, self.col_new = self.doc[order], np.flatnonzero(np.r_[True, np.diff(self.column[order]) > 0])
        self.row_new = np.flatnonzero(np.r_[True, np.diff(self.doc) > 0])

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, x.shape[1]), np.float32)
        out[self.doc[self.row_new]] = np.add.reduceat(x[self.column], self.row_new)
        return out * self.norm[:, None] + x[-1]

    def descend(self, y: np.ndarray, families: int, use: np.ndarray, rounds: int) -> np.ndarray:
        """Weights of a multinomial logistic regression on the rows in ``use``, by steps scaled by past gradients."""
        x = np.zeros((len(self.seen) + 1, families), np.float32)
        speed, target = np.zeros_like(x), np.eye(families, dtype=np.float32)[y]
        share = np.maximum(np.bincount(y[use], minlength=families), 1).astype(float)
        weight = np.where(use, 1 / np.sqrt(share[y]), 0).astype(np.float32)  # rare families count
        weight /= weight.sum()
        for _ in range(rounds):
            g = (_softmax(self.logits(x)) - target) * weight[:, None]
            grad = np.vstack([np.add.reduceat((g * self.norm[:, None])[self.by_col], self.col_new), g.sum(0)]) + 1e-6 * x
            speed += grad * grad
            x -= 0.5 * grad / np.sqrt(speed + 1e-12)
        return x


def train(ordinary: list[str], *, seed: int = 5, copies: int = 16, rounds: int = 80) -> LicenseModel:
    """Fits families by worked-over templates, the unknown class by ``ordinary`` paragraphs too.

    Confidence is calibrated by a first fit that sees neither a fourth of the
    templates, with all their copies, nor a fifth of the ordinary paragraphs;
    the model is a second fit to all of them.
    """
    rng = np.random.default_rng(seed)
    families = list(TEMPLATES)
    filler = [t for u in ordinary for t in _TOKEN.findall(u)] or ["text"]
    plain = [u for u in ordinary if not re.search(r"licen[sc]|copyright|rights? reserved|apache|\bMIT\b|\bgnu\b|\bgpl|creative commons|\bspdx|\bcc by|public domain", u, re.I)]
    units, label, held = list(plain), [0] * len(plain), [bool(x) for x in rng.random(len(plain)) < 0.2]
    for k, f in enumerate(families):
        for nth, t in enumerate(TEMPLATES[f]):
            for c in range(copies):
                w = t.split()
                if c % 4 == 1 and len(w) > 5:
                    w.pop(int(rng.integers(len(w))))
                if c % 4 >= 2:
                    extra = [filler[int(x)] for x in rng.integers(len(filler), size=int(rng.integers(1, 5)))]
                    w = extra + w if rng.random() < 0.5 else w + extra
                units.append(re.sub(r"\d+(\.\d+)?", lambda m: str(int(rng.integers(1, 5))) if c % 2 and rng.random() < 0.3 else m[0], " ".join(w)))
                label.append(k)
                held.append(nth % 4 == 1)
    y, test, grams = np.array(label), np.array(held), _Grams(units)
    z, true = grams.logits(grams.descend(y, len(families), ~test, rounds))[test], y[test]
    scale = min(np.linspace(0.3, 4, 38), key=lambda s: -np.mean(np.log(np.maximum(_softmax(s * z)[np.arange(len(true)), true], 1e-12))))
    other = _softmax(scale * z)[true == 0, 1:].max(1)
    least = float(np.clip(np.quantile(other, 0.999) if len(other) else 0.5, 0.5, 0.9))
    plainly = 1 - _softmax(scale * z)[true == 0, 0]
    doubt = float(np.clip(np.quantile(plainly, 0.999) if len(plainly) else 0.5, 0.5, 0.95))
    x = grams.descend(y, len(families), np.ones(len(y), bool), rounds)
    full = np.zeros((SLOTS + 1, len(families)), np.float32)
    full[grams.seen], full[-1] = x[:-1], x[-1]
    return LicenseModel(families, full, float(scale), least, doubt)


def fit(texts: DataFrame, *, text_col: str = "text", sample: int = 48) -> LicenseModel:
    """A model whose ordinary paragraphs are all those of some ``sample`` whole texts (the bound), with the smallest hash.

    The count of the texts gives the hash below which so many are expected:
    nothing is sorted, and little comes to the driver at any size. Copies of a
    text count once.
    """
    rank = F.shiftrightunsigned(F.xxhash64(F.lit("licence"), "t"), 1)
    rows = texts.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"))
    below = (1 << 63) - 1
    below = min(below, below * sample // max(rows.count(), 1))
    rows = sorted(r["t"] for r in rows.where(rank <= F.lit(below)).distinct().collect())
    return train([u for t in rows for line in t.split("\n") for u in re.split(r"(?<=[.!?]) ", line) if _TOKEN.search(u)])


def _shares(family: str) -> list[tuple[set, int]]:
    out = []
    for t in TEMPLATES[family]:
        w = [x.lower() for x in _TOKEN.findall(t)]
        out.append(({tuple(w[k : k + 2]) for k in range(len(w) - 1)} or {tuple(w)}, len(w)))
    return out


def similarity(unit: str, templates: list[tuple[set, int]]) -> float:
    """Largest share, over the templates, of a template's word pairs that the paragraph has, or of the paragraph's that the template has."""
    w = [x.lower() for x in _TOKEN.findall(unit)]
    own = {tuple(w[k : k + 2]) for k in range(len(w) - 1)} or {tuple(w)}
    return max((len(own & t) / max(1, min(len(t), max(len(own), 3))) for t, _ in templates), default=0.0)


def scan(text: Column, model: LicenseModel, *, confirm: float = 0.6) -> Column:
    """Licence notices of a whole text: ``paragraph`` (its number in the text), ``family``, ``confidence``, ``similarity``, ``line``.

    A paragraph is a sentence of a line. One of a family with calibrated
    confidence of ``model.least`` or more is compared with the family's
    templates. What no family's templates confirm is ``unknown`` if it names a
    licence and is no ordinary text with a calibrated confidence of
    ``model.doubt``, which stands for it then; else it is left out. ``Other``
    is a wording for licences in general. Null and empty texts have none.
    """

    @F.arrow_udf(FOUND)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        templates = [_shares(f) for f in model.families]
        for column in batches:
            data, offsets = flat(column)
            out: list[list] = [[] for _ in range(len(column))]
            for a, b in slices(offsets, 1 << 20):
                own, base = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                at, text_of = paragraphs(own, base)
                if len(at) < 2:
                    continue
                z = model.scale * _logits(model, Words(own, at, PLAIN), len(at) - 1)
                for k in np.flatnonzero(z[:, 1:].max(1) > z[:, 0]):
                    p = np.exp(z[k] - z[k].max())
                    p /= p.sum()
                    f = int(p[1:].argmax()) + 1
                    if p[f] < model.least and 1 - p[0] < model.doubt:
                        continue
                    line = own[at[k] : at[k + 1]].tobytes().decode(errors="replace").strip()
                    close = similarity(line, templates[f])
                    if p[f] >= model.least and close >= confirm:
                        family, sure = model.families[f], float(p[f])
                    elif 1 - p[0] >= model.doubt and _NAMED.search(line):
                        family, sure = UNKNOWN, float(1 - p[0])
                    else:
                        continue
                    doc = int(text_of[k])
                    out[a + doc].append({"paragraph": int(k - np.searchsorted(text_of, doc)), "family": family, "confidence": sure, "similarity": close, "line": line})
            yield pa.array(out, _FOUND)

    return run(text)


def notices(docs: DataFrame, model: LicenseModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per notice found in ``docs``; rows with equal or null ids are read each for itself; no documents, no rows."""
    return docs.select(F.col(id_col), F.explode(scan(F.col(text_col), model)).alias("m")).select(id_col, "m.*")

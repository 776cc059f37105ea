"""License scans: a trained paragraph classifier names licence families; template comparison confirms.

A paragraph is a line; of a line of more than UNIT words every stretch of UNIT words, half overlapping, is judged, and the
best one of each family counts: a confirmed one before others, then the more probable one.  Features are hashed runs of one to three words, each
counted and divided by the root of their number, so that the scores of all stretches come from running sums.  The classifier is multinomial logistic
regression over the families and the class `unknown`, trained on variations of the templates and on prose, notices and shuffled words that are
no licence; a held-out part sets the temperature that calibrates its probabilities and the least probability of a
family, below which a paragraph is unknown.  Every stretch is classified.  A prediction is confirmed if the stretch has LEAST_SHARE of the pairs of neighbouring words of a template of
that family, or if that share of the stretch's own pairs come from it; one with less than LEAST_HINT of either is refuted, and the stretch unknown.

Defined results: a row for each line and each known family found in it: doc_id, line, family, probability, template similarity, confirmed.
Null and empty texts give nothing; rows of null doc_id are scanned and reported with null.  Repeated rows are
reported as often as they stand.  Of equal probabilities the earlier stretch counts.  Extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import textcore as tc
from .common import small_batches, table

UNIT = 24
BITS = 14
LEAST_SHARE = 0.6
LEAST_HINT = 0.2
#: Share of held-out texts without a licence that may pass as a family.
FALSE_ALARMS = 0.002

TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license. See the LICENSE file in the project root.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GNU GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Distributed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "Public-Domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "Proprietary": [
        "Copyright. All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ],
}
FAMILIES = [*TEMPLATES, "unknown"]

_PLAIN = """the driver showed a license to the officer and went on | a fishing license costs twelve dollars in this state | the public library is open to any person on weekdays
the software reads the file and writes a copy to disk | you can find the source code of the parser below | this version of the program fixes two errors | the general manager wrote to the public
the foundation gave a grant to the work of the author | any warranty claim must be made within a year of purchase | distribution of the samples was uneven | see the documentation for the conditions of use
the university has a common room and a creative writing class | permission to enter was granted by the guard | the notice on the door said closed | all copies of the book were sold
the party shall notify the other party in writing | the license plate of the car was lost | attribution of the painting to the master is in doubt | international flights were cancelled
terms of the contract were agreed in the second version | restriction enzymes cut the strand at a known site | the court granted the motion without a hearing | he modified the design and published it""".replace("\n", " | ").split(" | ")


def _tokens(text: str) -> tc.Tokens:
    data, offsets = tc.buffers(pc.utf8_lower(pa.array([text], pa.large_string())))
    return tc.Tokens(data, offsets)


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    x = h[: len(h) - n + 1]
    for k in range(1, n):
        x = tc.mix(x * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return x


def vector(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the words with these hashes."""
    places, count = np.unique(np.concatenate([_runs(h, n) for n in (1, 2, 3) if len(h) >= n] or [h]) >> np.uint64(64 - BITS), return_counts=True)
    return places.astype(np.int64), count / np.sqrt(max(1, count.sum()))


class Model:
    """Weights, temperature and threshold, trained once on the driver; every training gives the same."""

    def __init__(self):
        rng = np.random.default_rng(5)
        texts, labels = self._examples(rng)
        x = np.zeros((len(texts), 1 << BITS), np.float32)
        for i, t in enumerate(texts):
            p, v = vector(_tokens(t).hash)
            x[i, p] = v
        y = np.array(labels)
        used = np.flatnonzero(x.any(0))
        part = rng.permutation(len(y))
        fit, held = part[: len(y) * 3 // 4], part[len(y) * 3 // 4 :]
        w, b = self._fit(x[fit][:, used], y[fit])
        self.w = np.zeros((1 << BITS, len(FAMILIES)), np.float32)
        self.w[used], self.b = w, b
        score = x[held] @ self.w + self.b
        self.temperature = min((self._loss(score / t, y[held]), t) for t in np.geomspace(0.1, 4, 40))[1]
        unknown = y[held] == len(FAMILIES) - 1
        p = self._softmax(score[unknown] / self.temperature)[:, :-1].max(1)
        self.least = max(0.5, float(np.quantile(p, 1 - FALSE_ALARMS)))
        self.held_out = float(((score.argmax(1) == y[held])).mean())
        self.pairs = [[(k, np.unique(_runs(_tokens(t).hash, 2))) for k, t in enumerate(TEMPLATES[f])] for f in TEMPLATES]

    @staticmethod
    def _examples(rng: np.random.Generator) -> tuple[list[str], list[int]]:
        texts, labels = [], []
        every = [w for ts in TEMPLATES.values() for t in ts for w in t.split()]
        plain = [w for t in _PLAIN for w in t.split()]
        syllables = "the er in an re tion en ha st ou nd ed ing ly de la que ment eau aux le sch ver ung keit ción ado os el un und der die".split()

        def prose(n: int) -> list[str]:
            kind = rng.integers(3)
            if kind == 0:
                return list(rng.choice(plain, n))
            if kind == 1:
                return ["".join(rng.choice(syllables, rng.integers(1, 5))) for _ in range(n)]
            return rng.choice(_PLAIN).split()

        for c, ts in enumerate(TEMPLATES.values()):
            for t in ts:
                words = t.split()
                for k in range(24):
                    own = [w for w in words if k == 0 or rng.random() > 0.06]
                    if len(words) > 18 and k % 3 == 1:  # an excerpt
                        a = rng.integers(0, len(words) - 12)
                        own = words[a : a + rng.integers(12, len(words) - a + 1)]
                    if k % 4 == 2:
                        own = ["Copyright", "(c)", str(rng.integers(1990, 2030)), *prose(rng.integers(1, 4)), *own]
                    if k % 4 == 3:
                        own = [*prose(rng.integers(0, 14)), *own, *prose(rng.integers(0, 14))]
                    texts.append(" ".join(own))
                    labels.append(c)
        for k in range(len(texts)):
            n = int(rng.integers(2, 40))
            own = prose(n)
            if k % 3 == 1:
                own = list(rng.choice(every, n))
            if k % 3 == 2:
                own = [*own, *rng.choice(every, max(1, n // 5))]
            texts.append(" ".join(own))
            labels.append(len(FAMILIES) - 1)
        return texts, labels

    @staticmethod
    def _softmax(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    @classmethod
    def _loss(cls, s: np.ndarray, y: np.ndarray) -> float:
        return float(-np.log(cls._softmax(s)[np.arange(len(y)), y] + 1e-12).mean())

    @classmethod
    def _fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
        w, b = np.zeros((x.shape[1], len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
        gw, gb = np.full_like(w, 1e-6), np.full_like(b, 1e-6)
        goal = np.eye(len(FAMILIES), dtype=np.float32)[y]
        for _ in range(rounds):
            g = (cls._softmax(x @ w + b) - goal) / len(y)
            dw, db = x.T @ g + 1e-5 * w, g.sum(0)
            gw += dw * dw
            gb += db * db
            w -= 0.5 * dw / np.sqrt(gw)
            b -= 0.5 * db / np.sqrt(gb)
        return w, b

    def judge_all(self, h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """judge() of each range of hashes, in one go."""
        score, runs = np.zeros((len(start), len(FAMILIES))), np.zeros(len(start))
        for n in (1, 2, 3):
            if len(h) < n:
                break
            upto = np.zeros((len(h) - n + 2, len(FAMILIES)))
            np.cumsum(self.w[(_runs(h, n) >> np.uint64(64 - BITS)).astype(np.int64)], axis=0, out=upto[1:])
            last = np.maximum(start, stop - n + 1)
            score += upto[last] - upto[start]
            runs += last - start
        p = self._softmax((score / np.sqrt(np.maximum(1, runs))[:, None] + self.b) / self.temperature)
        best = p[:, :-1].argmax(1)
        top, none = p[np.arange(len(p)), best], p[:, -1]
        sure = (top >= self.least) & (top > none) & (runs > 0)
        return np.where(sure, best, len(FAMILIES) - 1), np.where(sure, top, none)

    def judge(self, h: np.ndarray) -> tuple[int, float]:
        """The family (the last is unknown) of words with these hashes, and its probability."""
        p, v = vector(h)
        s = self._softmax(((v @ self.w[p] + self.b) / self.temperature)[None])[0]
        best = int(s[:-1].argmax())
        return (best, float(s[best])) if s[best] >= self.least and s[best] > s[-1] else (len(FAMILIES) - 1, float(s[-1]))

    def similarity(self, h: np.ndarray, family: int) -> float:
        own = np.unique(_runs(h, 2)) if len(h) > 1 else h[:0]
        best = 0.0
        for _, t in self.pairs[family]:
            both = len(np.intersect1d(own, t, assume_unique=True))
            best = max(best, both / len(t), both / len(own) if len(own) >= 4 else 0.0)
        return best


@lru_cache(1)
def model() -> Model:
    return Model()


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of all lines of a chunk, and of each the row and its number in the row."""
    bounds = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
    row = np.searchsorted(offsets, bounds[:-1], "right") - 1
    return bounds, row, np.arange(len(row)) - np.searchsorted(row, row)


def scan_column(column: pa.Array, m: Model | None = None) -> Iterator[tuple[int, int, str, float, float]]:
    """(row, line, family, probability, similarity) of all lines and each known family in them."""
    m = m or model()
    data, offsets = tc.buffers(pc.utf8_lower(column))
    for a, e in tc.chunks(offsets):
        own = data[offsets[a] : offsets[e]]
        bounds, row, number = _lines(own, offsets[a : e + 1] - offsets[a])
        if len(bounds) < 2:
            continue
        t = tc.Tokens(own, bounds)
        units = np.maximum(1, -(-(t.count - UNIT) // (UNIT // 2)) + 1)
        line = np.repeat(np.arange(len(units)), units)
        k = np.arange(len(line)) - np.repeat(np.cumsum(units) - units, units)
        start = t.first[line] + k * (UNIT // 2)
        stop = np.minimum(start + UNIT, t.first[line + 1])
        best: dict[tuple[int, int], tuple[bool, float, float]] = {}
        family_of, p_of = m.judge_all(t.hash, start, stop)
        for u in np.flatnonzero(family_of < len(FAMILIES) - 1).tolist():
            h, family, p = t.hash[start[u] : stop[u]], int(family_of[u]), float(p_of[u])
            s = m.similarity(h, family)
            if s >= LEAST_HINT:
                have = best.get((line[u], family))
                if have is None or (round(s, 6) >= LEAST_SHARE, p) > have[:2]:
                    best[line[u], family] = (round(s, 6) >= LEAST_SHARE, p, s)
        for (i, family), (_, p, s) in sorted(best.items()):
            yield int(row[i]) + a, int(number[i]), FAMILIES[family], round(p, 6), round(s, 6)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, line, family, probability, similarity, confirmed); one pass without a shuffle."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"]
    held = docs.sparkSession.sparkContext.broadcast(model())  # 1 MB whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(zip(*scan_column(b.column("text"), held.value))) or [[]] * 5
            sim = np.array(got[4], float)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(got[0], pa.int64())), pa.array(got[1], pa.int32()), pa.array(got[2], pa.string()), pa.array(got[3], pa.float64()), pa.array(sim), pa.array(sim >= LEAST_SHARE)],
                names=["doc_id", "line", "family", "probability", "similarity", "confirmed"],
            )

    rest = [("line", T.IntegerType()), ("family", T.StringType()), ("probability", T.DoubleType()), ("similarity", T.DoubleType()), ("confirmed", T.BooleanType())]
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([kind, *[T.StructField(n, k) for n, k in rest]]))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))

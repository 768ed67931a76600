"""Licence scan: a trained paragraph classifier whose finds a template confirms.

Lines are read one by one, longer ones in overlapping windows; so are paragraphs, lines up to one
without words, across the ends of their lines, for notices that are wrapped. A notice is known by the
line on which it, or the window that it was found in, begins. Features are single words and
pairs of neighbours that occur in the templates below; a multinomial logistic regression tells
the licence families and an unknown class apart. It learns from templates as they are, cut,
mangled and wrapped in other words, against paragraphs of the corpus that share little with any
template. A temperature, fitted to examples held back, calibrates the probabilities; notices of licences that are in
no family are among the unknown ones. A predicted family counts if a template of that family is found in the paragraph for
the most part, and half at least of those of its pairs that no other family has. Where several
families are confirmed so, all that are not unlikely count. An SPDX expression is read one identifier at a time.

Defined results: null and empty texts have no licence; a text with several licences names
them all, the likeliest first; without corpus paragraphs the unknown class learns from made-up mixtures
alone; repeated rows get equal results; an empty table gives no rows; other columns of
the input are not read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledger_mart.llm.common import extended, schema_of
from ledger_mart.llm.learning import by_chance, chance

UNKNOWN = "unknown"
SAMPLE = 3000  # corpus paragraphs learned from, at most
WINDOW, STEP = 64, 32
CONFIRMED = 0.6  # share of a template's word pairs that a paragraph must hold
LIKELY = 0.5
BESIDE = 0.1  # least probability of a family beside others that are confirmed
PARAGRAPH = 2000  # characters of a paragraph that is learned from, at most
_WORD = re.compile(r"[a-z0-9]+(?:[.'-][a-z0-9]+)*")

# Notices by which texts name the public licences, and the licences' opening words.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Apache-2.0 license",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "GNU GPL v3",
        "GPLv3",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1 or later.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "GNU Lesser General Public License, version 3",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "SPDX-License-Identifier: LGPL-3.0-only",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "agpl-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "mpl-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "SPDX-License-Identifier: ISC",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Creative Commons Attribution 4.0",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Creative Commons Attribution-ShareAlike 4.0",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Creative Commons Attribution-NonCommercial 4.0",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc-by-nd": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Creative Commons Attribution-NoDerivatives 4.0",
        "SPDX-License-Identifier: CC-BY-ND-4.0",
    ],
    "cc0": [
        "Released under CC0 1.0 Universal, public domain dedication.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ],
}
# Notices of licences of no family above, which the unknown class learns from.
OTHERS = [
    "SPDX-License-Identifier: EPL-2.0",
    "SPDX-License-Identifier: Zlib",
    "Licensed under the Eclipse Public License, version 2.0.",
    "Distributed under the zlib License, version 1.2.",
    "This work is licensed under the Open Software License, version 3.0.",
    "Released under the Artistic License 2.0.",
    "Licensed under the Common Development and Distribution License, version 1.0.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
]
_JOINS = frozenset(["or", "and", "with"])
_IDENTIFIER = r"\(*\s*[a-z0-9][a-z0-9.+-]*(?:\s*\))*"
_SPDX = re.compile(rf"spdx-license-identifier\s*:?\s*({_IDENTIFIER}(?:\s+(?:or|and|with)\s+{_IDENTIFIER})*)")


def words_of(text: str) -> list[str]:
    """Words in lower case; each identifier of an SPDX expression is one word with what it stands behind."""
    text = text.lower()
    if "spdx-license-identifier" in text:
        text = _SPDX.sub(lambda m: " ".join(f"spdx.{w}" for w in _WORD.findall(m[1]) if w not in _JOINS), text)
    return _WORD.findall(text)


@dataclass
class Model:
    families: list[str]  # the unknown class last
    words: dict[str, int]  # from 1; 0 is any other word
    pairs: np.ndarray  # sorted codes of neighbouring words
    weights: np.ndarray  # features x classes: words, pairs, then the bias
    temperature: float
    templates: list[tuple[int, np.ndarray, np.ndarray]]  # family, its feature numbers, and those of no other family

    def features(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place, the feature of its word and of the pair that begins there, -1 if none."""
        code = ids[:-1] * (len(self.words) + 1) + ids[1:]
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        pair = np.where((ids[:-1] > 0) & (ids[1:] > 0) & (self.pairs[at] == code), at + len(self.words), -1)
        return np.where(ids > 0, ids - 1, -1), np.r_[pair, -1] if len(ids) else pair

    def scores(self, segments: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the classes, and for each template's family the share of it that is there."""
        get = self.words.get
        length = np.array([len(s) for s in segments])
        ids = np.fromiter((get(w, 0) for s in segments for w in s), np.int64, length.sum())
        word, pair = self.features(ids)
        ends = np.cumsum(length)
        pair[ends[length > 0] - 1] = -1  # no pair across segments
        row = np.repeat(np.arange(len(segments)), length)
        rows, found = np.r_[row[word >= 0], row[pair >= 0]], np.r_[word[word >= 0], pair[pair >= 0]]
        key = np.unique(rows * len(self.weights) + found)  # present or not
        rows, found = key // len(self.weights), key % len(self.weights)
        logits = np.zeros((len(segments), len(self.families)))
        np.add.at(logits, rows, self.weights[found])
        logits = (logits + self.weights[-1]) / self.temperature
        chance = np.exp(logits - logits.max(axis=1, keepdims=True))
        chance /= chance.sum(axis=1, keepdims=True)
        held = np.zeros((len(segments), len(self.families)))
        some = np.flatnonzero(chance[:, :-1].sum(axis=1) >= LIKELY)
        starts = np.searchsorted(rows, np.arange(len(segments) + 1))
        for i in some:
            own = found[starts[i] : starts[i + 1]]
            for family, features, only in self.templates:
                if not len(only) or np.isin(only, own).mean() >= 0.5:
                    held[i, family] = max(held[i, family], np.isin(features, own).mean())
        return chance, held

    def confirmed(self, segments: list[list[str]]) -> Iterator[tuple[int, int, float]]:
        """(segment, family, probability) of the families that a template confirms."""
        chance, held = self.scores(segments)
        sure = (held >= CONFIRMED) & (chance >= BESIDE)
        sure[:, -1] = False
        sure &= (np.where(sure, chance, 0).sum(axis=1) >= LIKELY)[:, None]
        yield from ((i, f, float(chance[i, f])) for i, f in zip(*(x.tolist() for x in np.nonzero(sure))))


def segments_of(text: str | None) -> Iterator[tuple[int, list[str]]]:
    """(line, words): lines, and windows of long ones."""
    for number, line in enumerate((text or "").split("\n")):
        words = words_of(line)
        if identifiers := [w for w in words if w.startswith("spdx.")]:
            yield from ((number, [w]) for w in identifiers)
            words = [w for w in words if w not in identifiers]
        for at in _window_starts(len(words)):
            yield number, words[at : at + WINDOW]


def _window_starts(n: int) -> range:
    return range(0, max(1, n - WINDOW + STEP), STEP) if n > WINDOW else range(min(n, 1))


def wrapped_segments_of(text: str | None) -> Iterator[tuple[int, int, list[str]]]:
    """(first line, last line, words): windows of paragraphs that lie on several lines."""
    words: list[str] = []
    numbers: list[int] = []
    for number, line in enumerate([*(text or "").split("\n"), ""]):
        if own := [w for w in words_of(line) if not w.startswith("spdx.")]:
            words += own
            numbers += [number] * len(own)
            continue
        for at in _window_starts(len(words)):
            first, last = numbers[at], numbers[min(at + WINDOW, len(numbers)) - 1]
            if first < last:
                yield first, last, words[at : at + WINDOW]
        words, numbers = [], []


def _variants(words: list[str], filler: list[str], rng: random.Random, lost: float = 0.08) -> Iterator[list[str]]:
    """The template itself, mangled, and amid other words."""
    some = lambda n: [rng.choice(filler) for _ in range(rng.randint(0, n))]
    yield words
    for _ in range(12):
        own = [w for w in words if rng.random() > lost] or words
        yield some(12) + own + some(12)


def _fit(x: np.ndarray, y: np.ndarray, cost: np.ndarray, classes: int, steps: int = 250, decay: float = 3e-4) -> np.ndarray:
    """Gradient descent with momentum on the weighted log loss."""
    w, m, v = (np.zeros((x.shape[1], classes), np.float32) for _ in range(3))
    truth = np.eye(classes, dtype=np.float32)[y]
    cost = (cost / cost.sum())[:, None].astype(np.float32)
    for step in range(1, steps + 1):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = x.T @ (cost * (p - truth)) + decay * w / len(w) ** 0.5
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float(-(z[np.arange(len(y)), y] - np.log(np.exp(z).sum(axis=1))).mean())

    return min((1.25**i for i in range(-4, 13)), key=loss)


def fit(paragraphs: list[list[str]], seed: int = 7) -> Model:
    """``paragraphs``: of the corpus, for the unknown class."""
    rng = random.Random(seed)
    families = [*TEMPLATES, UNKNOWN]
    texts = [(i, words_of(t)) for i, name in enumerate(TEMPLATES) for t in TEMPLATES[name]]
    words = {w: i + 1 for i, w in enumerate(sorted({w for _, t in texts for w in t}))}
    code = lambda t: {words[a] * (len(words) + 1) + words[b] for a, b in zip(t, t[1:])}
    pairs = np.array(sorted(set().union(*(code(t) for _, t in texts))), np.int64)
    # a name of one word is that word
    of_text = [np.array([words[w] - 1 for w in t]) if len(t) == 1 else len(words) + np.searchsorted(pairs, sorted(code(t))) for _, t in texts]
    of_family = [np.concatenate([f for (j, _), f in zip(texts, of_text) if j != i]) for i in range(len(TEMPLATES))]
    templates = [(i, f, f[~np.isin(f, of_family[i])]) for (i, _), f in zip(texts, of_text)]
    model = Model(families, words, pairs, np.zeros((len(words) + len(pairs) + 1, len(families)), np.float32), 1.0, templates)
    filler = sorted({w for p in paragraphs for w in p})[:5000] or ["and", "it", "was", "then", "here"]
    examples = [(i, v) for i, t in texts for v in _variants(t, filler, rng)]
    known = sorted(words)
    unknown = [p[:WINDOW] for p in paragraphs if not any(len(code_of(model, p) & set(f.tolist())) > 0.3 * len(f) for _, f, _ in templates)]
    unknown += [v for t in OTHERS for v in _variants(words_of(t), filler, rng)]
    # words of the licences in no licence's order
    unknown += [[rng.choice(known if rng.random() < 0.5 else filler) for _ in range(rng.randint(1, 30))] for _ in range(600)]
    examples += [(len(families) - 1, p) for p in unknown]
    rng.shuffle(examples)
    x = np.zeros((len(examples), len(model.weights)), np.float32)
    for row, (_, t) in enumerate(examples):
        x[row, [f for f in feature_set(model, t)]] = 1
    x[:, -1] = 1
    y = np.array([i for i, _ in examples])
    cost = 1 / np.bincount(y, minlength=len(families))[y]
    cost[y == len(families) - 1] *= 3
    back = np.arange(len(y)) % 5 == 0
    # calibrated on notices that are mangled more than those it learns from
    for row in np.flatnonzero(back & (y < len(families) - 1)):
        x[row] = 0
        *_, worse = _variants(examples[row][1], filler, rng, 0.2)
        x[row, list(feature_set(model, worse))] = 1
    x[:, -1] = 1
    model.weights = _fit(x[~back], y[~back], cost[~back], len(families))
    model.temperature = _temperature(x[back] @ model.weights, y[back])
    return model


def feature_set(model: Model, words: list[str]) -> set[int]:
    ids = np.array([model.words.get(w, 0) for w in words], np.int64)
    if not len(ids):
        return set()
    word, pair = model.features(ids)
    return set(word[word >= 0].tolist()) | set(pair[pair >= 0].tolist())


def code_of(model: Model, words: list[str]) -> set[int]:
    return {f for f in feature_set(model, words) if f >= len(model.words)}


def learn(docs: DataFrame, most: int = SAMPLE) -> Model:
    """From the last lines, up to PARAGRAPH characters of each, of at most about ``most`` documents chosen by hash."""
    n = docs.count()
    rows = docs.where(chance("doc_id") < (most / n if n else 1)).select("doc_id", F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(-1)).alias("line"))
    got = by_chance(rows.select("doc_id", F.substring("line", 1, PARAGRAPH).alias("line")).collect(), "doc_id")
    return fit([w for r in got if (w := words_of(r["line"]))])


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, families, score, paragraph, found): the confirmed licences of each document, the
    likeliest first, its probability and its paragraph, and how many paragraphs name one."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**sent.value)
        for batch in batches:
            out = []
            for at in range(0, len(batch), 128):
                texts = batch.column("text")[at : at + 128].to_pylist()
                owner, number, until, segments = [], [], [], []
                for i, text in enumerate(texts):
                    for n, m, words in chain(((n, n, w) for n, w in segments_of(text)), wrapped_segments_of(text)):
                        owner.append(i)
                        number.append(n)
                        until.append(m)
                        segments.append(words)
                best: list[dict[str, tuple[float, int]]] = [{} for _ in texts]
                many: list[set[int]] = [set() for _ in texts]
                spans: list[dict[str, list[tuple[int, int]]]] = [{} for _ in texts]
                if segments:
                    for j, f, p in model.confirmed(segments):
                        family = model.families[f]
                        seen = spans[owner[j]].setdefault(family, [])
                        if number[j] < until[j] and any(a <= until[j] and number[j] <= z for a, z in seen):
                            continue  # a line in the window, or the window before it, holds the notice
                        seen.append((number[j], until[j]))
                        many[owner[j]].add(number[j])
                        if p > best[owner[j]].get(family, (0.0, 0))[0]:
                            best[owner[j]][family] = (p, number[j])
                for found, lines in zip(best, many):
                    names = sorted(found, key=lambda f: (-found[f][0], f))
                    first = found[names[0]] if names else (0.0, None)
                    out.append((names, first[0], first[1], len(lines)))
            families, score, paragraph, many = zip(*out) if out else ((), (), (), ())
            yield extended(
                batch, ["doc_id"], families=pa.array(families, pa.list_(pa.string())), score=pa.array(score, pa.float64()),
                paragraph=pa.array(paragraph, pa.int32()), found=pa.array(many, pa.int32()),
            )

    schema = schema_of(docs, ["doc_id"], "families array<string>, score double, paragraph int, found int")
    return docs.select("doc_id", "text").mapInArrow(scanned, schema)


def licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, license, families, score, paragraph, found) of every document."""
    found = scan(docs, learn(docs))
    name = F.coalesce(F.get("families", 0), F.lit(UNKNOWN))
    return found.select("doc_id", name.alias("license"), F.array_join("families", ",").alias("families"), "score", "paragraph", "found")

"""Licence scans: a trained paragraph classifier with an unknown class, confirmed by templates.

Scoring is DataFrame expressions alone; the model is trained on the driver,
from notices that the names and sentences below make, and a bounded number of
ordinary paragraphs.
"""

from __future__ import annotations

import json
import random
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
# The usual names of licence families.
NAMES: dict[str, tuple[str, ...]] = {
    "agpl-3.0": ("GNU Affero General Public License", "GNU Affero General Public License version 3", "AGPLv3", "AGPL-3.0", "GNU AGPL"),
    "all-rights-reserved": ("All rights reserved", "No part may be reproduced without permission", "Proprietary and confidential"),
    "apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0"),
    "bsd": ("BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "New BSD License"),
    "cc-by-4.0": ("Creative Commons Attribution 4.0 International", "Creative Commons BY 4.0", "CC BY 4.0", "CC-BY-4.0"),
    "cc-by-nc-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International", "Creative Commons BY-NC 4.0", "CC BY-NC 4.0", "CC-BY-NC-4.0"),
    "cc-by-sa-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International", "Creative Commons BY-SA 4.0", "CC BY-SA 4.0", "CC-BY-SA-4.0"),
    "cc0-1.0": ("Creative Commons Zero 1.0 Universal", "CC0 1.0 Universal", "CC0 1.0", "CC0-1.0", "public domain dedication"),
    "gpl": ("GNU General Public License", "GNU General Public License version 3", "GNU General Public License version 2", "GPLv3", "GPLv2", "GPL-3.0", "GNU GPL"),
    "lgpl": ("GNU Lesser General Public License", "GNU Lesser General Public License version 2.1", "LGPL-2.1", "LGPLv3", "GNU LGPL"),
    "mit": ("MIT License", "MIT-style license", "Expat License", "SPDX MIT"),
    "mpl-2.0": ("Mozilla Public License", "Mozilla Public License version 2.0", "MPL 2.0", "MPL-2.0"),
}
# Sentences of the licences themselves.
SENTENCES: dict[str, tuple[str, ...]] = {
    "agpl-3.0": ("This program is free software under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",),
    "all-rights-reserved": ("Unauthorized copying of this file, via any medium, is strictly prohibited.", "No part of this publication may be reproduced or transmitted without the prior written permission of the publisher."),
    "apache-2.0": ("You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0.",),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",),
    "cc0-1.0": ("The person who associated a work with this deed has dedicated the work to the public domain by waiving all rights to the work worldwide under copyright law.",),
    "gpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",),
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}
# What a notice says around a name; the held-back ones only choose the temperature.
FRAMES = (
    "{}", "This project is covered by the {}.", "The code is made available under the terms of the {}.", "Use of this software is governed by the {}.", "See the {} for details.",
    "SPDX-License-Identifier: {}", "Copyright 2019 by the authors, {}.", "You can copy and change this file under the {}.", "License: {}", "Published under {}", "The text is licensed under a {} license.", "SPDX {}", "Free to use ({}).",
)
HELD_BACK = ("This package is offered under the {}.", "Everything here falls under the {}, see the file.", "Licence of the data: {}.")
TEMPLATES = {family: (*names, *SENTENCES.get(family, ())) for family, names in NAMES.items()}
# Sentences with the words of licences that are none.
ORDINARY = (
    "The driver showed his license at the gate.", "She renewed the fishing licence in spring.", "The museum rights were reserved a table near the door.", "Permission to land was given by the tower.",
    "A lecture on copyright law was held on Monday.", "The public domain of the village ends at the river.", "The warranty covers the engine for two years.", "All seats are reserved for the guests of the house.",
    "He works on a version of the song.", "The general public may visit the garden.", "The software was released in May.", "Redistribution of land was debated in the council.",
    "Er kam mit dem Zug und mit seinem Hund.", "Wir fahren mit der Bahn zu MIT.", "The creative people of the commons sold bread.", "A new version 2.0 of the game is out.", "Please see the file for details.",
    "The authors of this project met in 2019.", "You can use the code at the door.", "It is free to use for all guests, see the text.", "Apache helicopters flew over the town.", "No part of the house was warm.",
    "Public transport is free of charge for any person under six.", "The terms of the loan are strict, the identifier is on the card.",
)
_WORD = r"[a-z0-9]+"


@dataclass(frozen=True)
class LicenseConfig:
    """buckets of hashed word 1- and 2-grams; ordinary: corpus paragraphs learnt from, at most, out of so many texts."""

    buckets: int = 16_384
    ordinary: int = 600
    texts: int = 1000
    copies: int = 3
    steps: int = 250
    penalty: float = 1e-3
    long_line: int = 400
    least_probability: float = 0.5
    least_similarity: float = 0.5


def grams(text: str) -> list[str]:
    words = re.findall(_WORD, text.lower())
    return sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))})


def buckets_of(text: str, size: int) -> list[int]:
    return sorted({xxhash.xxh64_intdigest(g.encode(), 42) % size for g in grams(text)})


@dataclass
class LicenseModel:
    """Weights by class and bucket, biases, and the temperature that calibrates probabilities.

    Weights are sparse: only buckets of n-grams that notices have are features.
    """

    classes: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    config: LicenseConfig

    def probabilities(self, text: str) -> np.ndarray:
        """The same as the expressions below, for one paragraph."""
        z = np.array([self.bias[c] + sum(self.weights[c, b] for b in buckets_of(text, self.config.buckets)) for c in range(len(self.classes))]) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def notices(frames: tuple[str, ...], r: random.Random, filler: list[str], copies: int) -> list[tuple[str, str]]:
    """(text, family): names in frames and sentences of licences, whole and with words lost and others around them."""
    plain = [(frame.format(name), family) for family, names in NAMES.items() for name in names for frame in frames]
    plain += [(sentence, family) for family, sentences in SENTENCES.items() for sentence in sentences for _ in frames]
    out = []
    for text, family in plain:
        for i in range(copies):
            words = text.split()
            kept = [w for w in words if i == 0 or len(words) < 6 or r.random() > 0.1]
            around = [r.choice(filler) for _ in range(r.randrange(0, 6) if i else 0)]
            out.append((" ".join([*kept, *around] if r.random() < 0.5 else [*around, *kept]), family))
    return out


def train(ordinary: list[str], config: LicenseConfig | None = None, seed: int = 7) -> LicenseModel:
    """Softmax regression on notices against ordinary paragraphs, with words of licences among them.

    Kept back are notices in frames of their own and a fifth of the others; on
    them the temperature is chosen by likelihood, which calibrates the
    probabilities, the unknown class's too.
    """
    config = config or LicenseConfig()
    r = random.Random(seed)
    plain = [*ORDINARY, *sorted(ordinary)]
    filler = [w for p in plain for w in p.split()]
    classes = [*sorted(NAMES), UNKNOWN]
    taught, held = notices(FRAMES, r, filler, config.copies), notices(HELD_BACK, r, filler, config.copies)
    spare = sorted({w for ts in TEMPLATES.values() for t in ts for w in t.split()} | {w for f in FRAMES for w in f.split() if w.isalpha()})
    others = [p for p in plain for _ in range(1 if p not in ORDINARY else 5 * config.copies)]
    for _ in range(100 * config.copies):  # single words of licences, and frames without a name, among others
        words = [r.choice(spare), *(r.choice(filler) for _ in range(r.randint(4, 12)))]
        r.shuffle(words)
        others += [" ".join(words), r.choice(FRAMES).format(" ".join(r.choice(filler) for _ in range(3)))]
    r.shuffle(others)
    cut = len(others) // 5
    features = sorted({b for text in (*(t for ts in TEMPLATES.values() for t in ts), *(f.format(n) for f in FRAMES for ns in NAMES.values() for n in ns)) for b in buckets_of(text, config.buckets)})
    column = {b: i for i, b in enumerate(features)}

    def table(examples: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(examples), len(features)))
        for i, (text, _) in enumerate(examples):
            x[i, [column[b] for b in buckets_of(text, config.buckets) if b in column]] = 1
        return x, np.array([classes.index(c) for _, c in examples])

    x, y = table([*taught, *((p, UNKNOWN) for p in others[cut:])])
    w, b, momentum, target = np.zeros((len(classes), len(features))), np.zeros(len(classes)), 0.0, np.eye(len(classes))[y]
    for _ in range(config.steps):
        z = x @ w.T + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        error = (p / p.sum(axis=1, keepdims=True) - target) / len(target)
        momentum = 0.9 * momentum + error.T @ x + config.penalty * w
        w -= 1.0 * momentum
        b -= 1.0 * error.sum(axis=0)
    x, y = table([*held, *((p, UNKNOWN) for p in others[:cut])])
    z = x @ w.T + b

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float(-(s[np.arange(len(y)), y] - np.log(np.exp(s).sum(axis=1))).mean())

    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    full = np.zeros((len(classes), config.buckets))
    full[:, features] = np.round(w, 5)
    return LicenseModel(classes, full, np.round(b, 5), temperature, config)


def paragraphs(text: Column, config: LicenseConfig) -> Column:
    """Lines; long ones cut at the ends of sentences."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.flatten(F.transform(lines, lambda p: F.when(F.length(p) > config.long_line, F.split(p, r"(?<=[.!?]) +")).otherwise(F.array(p))))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _grams(paragraph: Column) -> Column:
    """Word 1- and 2-grams of a paragraph, repeats included."""
    words = F.regexp_extract_all(F.lower(paragraph), F.lit(_WORD), 0)
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return _let(words, lambda w: F.when(F.size(w) > 1, F.concat(w, pairs(w))).otherwise(w))


def _constant(values: object, kind: str) -> Column:
    """A value as one foldable literal."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def similar(found: Column, templates: list[list[str]]) -> Column:
    """The largest share of a template's n-grams that is found."""
    return F.coalesce(F.array_max(F.transform(_constant(templates, "array<array<string>>"), lambda t: F.size(F.array_intersect(t, found)) / F.size(t))), F.lit(0.0))


def classified(paragraph: Column, model: LicenseModel) -> Column:
    """struct(family, probability, similarity, confirmed) of one paragraph.

    Of the paragraph's n-grams, those whose bucket is a feature are looked up
    in every class's weights; the others weigh nothing.
    """
    c = model.config
    used = np.flatnonzero(model.weights.any(axis=0))
    place = np.full(c.buckets, -1)
    place[used] = np.arange(len(used))
    index = _constant(place.tolist(), "array<int>")
    weights = [_constant([float(v) for v in row], "array<double>") for row in model.weights[:, used]]
    unknown = lambda p: F.struct(F.lit(UNKNOWN).alias("family"), p.alias("probability"), F.lit(0.0).alias("similarity"), F.lit(False).alias("confirmed"))

    def judge(held: Column) -> Column:
        logit = lambda w, b: F.aggregate(held, F.lit(float(b)), lambda a, i: a + F.get(w, i)) / model.temperature
        logits = F.array(*[logit(w, b) for w, b in zip(weights, model.bias, strict=True)])

        def softmax(z: Column) -> Column:
            powers = F.transform(z, lambda v: F.exp(v - F.array_max(z)))
            return _let(powers, lambda e: F.struct(F.array_position(e, F.array_max(e)).cast("int").alias("at"), (F.array_max(e) / F.aggregate(e, F.lit(0.0), lambda a, v: a + v)).alias("p")))

        return _let(_let(logits, softmax), named)

    def named(best: Column) -> Column:
        family = F.element_at(_constant(model.classes, "array<string>"), best["at"])

        def confirm(found: Column) -> Column:
            likeness = F.coalesce(*[F.when(family == f, similar(found, [grams(t) for t in TEMPLATES[f]])) for f in model.classes if f != UNKNOWN])
            return _let(likeness, lambda s: F.struct(family.alias("family"), best["p"].alias("probability"), s.alias("similarity"), (s >= c.least_similarity).alias("confirmed")))

        return F.when((family != UNKNOWN) & (best["p"] >= c.least_probability), _let(F.array_distinct(_grams(paragraph)), confirm)).otherwise(unknown(best["p"]))

    bucket = lambda g: F.get(index, F.pmod(F.xxhash64(g), F.lit(c.buckets)).cast("int"))
    held = F.array_distinct(F.filter(F.transform(_grams(paragraph), bucket), lambda i: i >= 0))
    bare = model.probabilities("")  # of a paragraph without any feature
    if model.classes[int(bare.argmax())] != UNKNOWN:
        return _let(held, judge)
    return _let(held, lambda h: F.when(F.size(h) == 0, unknown(F.lit(float(bare.max())))).otherwise(judge(h)))


def ordinary_paragraphs(docs: DataFrame, text_col: str, config: LicenseConfig) -> list[str]:
    """At most config.ordinary paragraphs, none of which holds most of a template, of the documents first by a hash.

    Half of them are those with the most n-grams of templates, so that the
    unknown class knows what it must reject.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("t")).where(F.length("t") > 0).withColumn("h", F.xxhash64("t"))
    chosen = texts.select("h").distinct().orderBy("h").limit(config.texts)  # hashes alone meet in one task
    rows = texts.join(F.broadcast(chosen), "h", "left_semi").dropDuplicates(["h"])
    own = [set(grams(t)) for ts in TEMPLATES.values() for t in ts]
    held = set().union(*(buckets_of(t, config.buckets) for ts in TEMPLATES.values() for t in ts))
    index = _constant([b in held for b in range(config.buckets)], "array<boolean>")
    count = F.size(F.filter(_grams(F.col("p")), lambda g: F.get(index, F.pmod(F.xxhash64(g), F.lit(config.buckets)).cast("int"))))
    parts = rows.select(F.explode(paragraphs(F.col("t"), config)).alias("p")).where(F.length("p") > 0).select("p", count.alias("n"), F.xxhash64("p").alias("h")).distinct()

    def some(order: list, most: int) -> list[str]:
        found = [r.p for r in parts.orderBy(*order).limit(4 * most).collect()]
        plain = [p for p in found if all(len(t & set(grams(p))) < config.least_similarity * len(t) for t in own)]
        return plain[:most]

    half = config.ordinary // 2
    return sorted({*some([F.col("n").desc(), "h", "p"], half), *some(["h", "p"], config.ordinary - half)})


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: LicenseConfig | None = None, model: LicenseModel | None = None) -> DataFrame:
    """(doc_id, n_paragraphs, licenses) for every row; licenses: (paragraph, family, probability, similarity, confirmed).

    Every paragraph is classified by hashed word 1- and 2-grams; the most
    probable family counts from half a probability on, else the paragraph is
    unknown and not listed. A family is confirmed if half the n-grams of one of
    its templates (a name, or a sentence of the licence) stand in the
    paragraph. Null and empty texts have one empty paragraph and no licences;
    very long texts and lines are read whole, in time proportional to their
    length; rows repeat as they come; null ids stay; an empty table gives no
    rows; other columns are not read, whatever their names.
    """
    config = config or LicenseConfig()
    model = model or train(ordinary_paragraphs(docs, text_col, config), config)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("p", paragraphs(F.col("text"), config))

    def judged(p: Column, i: Column) -> Column:
        return _let(classified(p, model), lambda c: F.struct((i + 1).alias("paragraph"), c["family"].alias("family"), c["probability"].alias("probability"), c["similarity"].alias("similarity"), c["confirmed"].alias("confirmed")))

    found = F.filter(F.transform("p", judged), lambda x: x["family"] != UNKNOWN)
    return rows.select("doc_id", F.size("p").cast("long").alias("n_paragraphs"), found.alias("licenses"))


def families(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_paragraphs, n_candidates, n_unknown, families, best_probability): confirmed families of each row.

    n_candidates paragraphs were given a family, n_unknown none.
    """
    sure = F.filter("licenses", lambda x: x["confirmed"])
    return scanned.select(
        "doc_id", "n_paragraphs", F.size("licenses").cast("long").alias("n_candidates"), (F.col("n_paragraphs") - F.size("licenses")).cast("long").alias("n_unknown"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"), F.coalesce(F.array_max(F.transform(sure, lambda x: x["probability"])), F.lit(0.0)).alias("best_probability"),
    )

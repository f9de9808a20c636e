import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import licenses as L


@pytest.fixture(scope="module")
def model():
    r = random.Random(4)
    return L.train([" ".join(r.choice(["thon", "er", "anst", "of", "the", "and", "ouble"]) for _ in range(12)) for _ in range(200)])


NEW = ("Released under the {}.", "Distributed under {} or later.", "Licensed under {}.", "This work is licensed under the {}.", "available under {}", "Terms: {}", "We chose the {} for this repository.", "Released under {} terms, without warranty")


def best(model, text):
    p = model.probabilities(text)
    family = model.classes[int(p.argmax())]
    return (family if p.max() >= 0.5 else L.UNKNOWN), float(p.max())


def likeness(text, family):
    return max((len(set(L.grams(text)) & set(L.grams(t))) / len(L.grams(t)) for t in L.TEMPLATES.get(family, ())), default=0.0)


def test_notices_in_new_words(model):
    """Notices whose wording no training example has: a recall of 0.9 or more."""
    assert not set(NEW) & {*L.FRAMES, *L.HELD_BACK}
    notices = [(frame.format(name), family) for family, names in L.NAMES.items() for name in names for frame in NEW]
    right = [best(model, text)[0] == family and likeness(text, family) >= 0.5 for text, family in notices]
    assert sum(right) >= 0.9 * len(right)
    for text, family in (("Distributed under GPLv3 or later.", "gpl"), ("SPDX: MIT", "mit"), ("available under Apache 2.0", "apache-2.0"), ("Released under Creative Commons BY 4.0", "cc-by-4.0")):
        assert best(model, text)[0] == family


def test_what_is_no_notice(model):
    strange = [
        "We value your license to speak about the weather and the sea.", "Permission was asked twice by the clerk of the court.", "Sie kam mit 2 Kindern und mit 4 Hunden.", "version 2.0 of the text",
        "the terms of the general public", "The GNU is a large animal of the public park.", "All the rights of the town were reserved a day later.", "License plates cost 3.0 more.",
    ]
    assert all(best(model, s)[0] == L.UNKNOWN for s in (*L.ORDINARY, *strange))
    r = random.Random(99)
    spare = [w for ts in L.TEMPLATES.values() for t in ts for w in t.split()]
    mixed = [" ".join([r.choice(spare), *(r.choice(["thon", "er", "anst", "ouble", "garden"]) for _ in range(9))]) for _ in range(200)]
    assert sum(best(model, m)[0] == L.UNKNOWN for m in mixed) >= 190


def test_expressions_match_the_model(spark, model, empty):
    texts = [t for ts in L.TEMPLATES.values() for t in ts] + list(L.ORDINARY) + ["", None, "Thon er.\nReleased under the MIT License.\nonst", "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0", "licen " * 500, "MIT " * 300 + ". Apache 2.0"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    scanned = L.scan_licenses(rows, model=model)
    assert not re.search("Python|Pandas|Arrow", scanned._jdf.queryExecution().toString())
    got = {r.doc_id: r for r in scanned.collect()}
    for i, text in enumerate(texts):
        lines = (text or "").split("\n")
        flat = [s for p in lines for s in (re.split(r"(?<=[.!?]) +", p) if len(p) > 400 else [p])]
        assert got[i].n_paragraphs == len(flat)
        expected = [(n, p, *best(model, p)) for n, p in enumerate(flat, 1) if best(model, p)[0] != L.UNKNOWN]
        assert [(x.paragraph, x.family) for x in got[i].licenses] == [(n, f) for n, _, f, _ in expected]
        for x, (_, p, family, q) in zip(got[i].licenses, expected, strict=True):
            assert x.probability == pytest.approx(q, abs=1e-9) and x.similarity == pytest.approx(likeness(p, family)) and x.confirmed == (likeness(p, family) >= 0.5)
    for family, templates in L.TEMPLATES.items():
        first = got[texts.index(templates[0])].licenses[0]
        assert first.family == family and first.confirmed
    out = {r.doc_id: r for r in L.families(scanned).collect()}
    mixed = out[texts.index("Thon er.\nReleased under the MIT License.\nonst")]
    assert (mixed.families, mixed.n_paragraphs, mixed.n_candidates, mixed.n_unknown) == ("mit", 3, 1, 2) and out[texts.index("")].families == ""
    assert L.scan_licenses(empty).count() == 0
    odd = spark.createDataFrame([(None, "All rights reserved.", 1), (1, "x", 1), (1, "x", 1)], "doc_id long, text string, p int")
    assert L.families(L.scan_licenses(odd)).where(F.col("families") == "all-rights-reserved").count() == 1


def test_corpus_paragraphs_teach_what_to_reject(spark):
    texts = ["Licensed under the MIT License.", "He lost the license of the public house.\nThe sea was calm.", "", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert L.ordinary_paragraphs(frame, "text", L.LicenseConfig()) == ["He lost the license of the public house.", "The sea was calm."]


def test_very_long_lines(spark, model):
    long = "the general word of it " * 450_000 + "Released under the MIT License"
    got = L.scan_licenses(spark.createDataFrame([(1, long), (2, "x\n" * 200_000 + "MIT License")], "doc_id long, text string"), model=model)
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].n_paragraphs == 1 and rows[2].n_paragraphs == 200_001 and [(x.paragraph, x.family) for x in rows[2].licenses] == [(200_001, "mit")]

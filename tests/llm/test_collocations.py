import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import collocations

SCHEMA = "text string, lang string, block long, n long, code int, word string"


def brute(rows, max_words=3, min_count=10, percent=50, top=2000):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = (text or "").encode().lower().decode()
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    key = (lang, tuple(words[i : i + k]))
                    f[key] = f.get(key, 0) + 1
    able = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    gone = {(lang, w[i : i + k]) for (lang, w), longer in able.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if 100 * longer >= percent * f[lang, w[i : i + k]]}
    out = {}
    for (lang, w), a in able.items():
        if (lang, w) not in gone:
            score, _, left, right = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    found = []
    for lang, phrases in out.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(phrases)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(found)


def mined(spark, rows, parts=3, **more):
    df = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in collocations.collocations(df, **more).collect())


def texts(seed, n=120):
    r = random.Random(seed)
    vocabulary = ["a", "B", "the", "É", "zu", "new", "york", "city", "x y", "\x1c"]
    out = [(None, "en"), ("", None), (" \t ", "en"), ("..,,", "de"), ("one", "en")]
    for _ in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randrange(1, 60))]
        text = "".join(w + r.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "; "]) for w in words)
        out.append((text + "New York City", r.choice(["en", "en", "de", None, "und"])))
    return out


@pytest.mark.parametrize(("seed", "words"), [(1, 3), (2, 2), (3, 4)])
def test_random_texts(spark, seed, words):
    rows = texts(seed)
    found = mined(spark, rows, max_words=words)
    assert found == brute(rows, words) and found


def test_small_blocks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "PART", 16)
    rows = texts(4)
    assert mined(spark, rows, block_bytes=500, min_count=3) == brute(rows, min_count=3)


def test_top_and_ties(spark):
    rows = [("a b c d e f g h", "en")] * 12 + [("a b, c d, e f", "en")] * 40
    found = mined(spark, rows, top=3)
    assert found == brute(rows, top=3) and len(found) == 3


def test_nothing_repeats(spark):
    assert mined(spark, [("a b c", "en"), (None, None)]) == []
    assert mined(spark, []) == []


def test_very_long_text(spark):
    rows = [("Ab cd ef. " * 200_000, "en"), ("q r", "en")]
    assert mined(spark, rows) == brute(rows)


def test_scores_beyond_64_bits(spark):
    a, l, r = 3 * 10**12, 5 * 10**12, 7 * 10**12  # noqa: E741
    df = spark.createDataFrame([(a, l, r)], "a long, l long, r long")
    assert df.selectExpr(collocations._score("a", "l", "r")).first()[0] == 10**6 * a * a // (l * r)


def test_words_and_pieces_of_one_buffer():
    words, of, ends = collocations.cut(pa.array(["A b.C", "", "  d", ",e f"], pa.large_string()))
    assert words.to_pylist() == ["a", "b", "c", "d", "e", "f"]
    assert of.tolist() == [0, 0, 0, 2, 3, 3]
    assert ends.tolist() == [True, False, True, True, True, False]
    assert collocations.runs_only(np.array([-1, 4, -1, 5, 6, -1, -1, 7, 8])).tolist() == [5, 6, -1, 7, 8]

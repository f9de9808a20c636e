import math
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import toxicity
from lodestone.llm.toxicity import Scorer, ToxicityConfig, decay_of, fit_curve, segments, tokens

BAD = ["grizzly", "snarkle", "vombat", "lopperish"]


def brute_segments(scores):
    """Maximal segments by their definition: the best one, then the best of what is left of and right of it."""

    def best(a, b):
        found = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 0 and (found is None or total > found[2] + 1e-12):
                    found = (i, j + 1, total)
        return found

    def cut(a, b):
        s = best(a, b)
        return [] if s is None else [*cut(a, s[0]), s, *cut(s[1], b)]

    return cut(0, len(scores))


def test_segments_are_the_maximal_ones():
    r = random.Random(2)
    for _ in range(200):
        scores = np.array([r.choice([-3, -1, -0.5, 2, 1.5]) + r.random() / 100 for _ in range(r.randint(0, 25))])
        got = segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(scores)]
        assert all(s == pytest.approx(scores[a:b].sum()) for a, b, s in got)


def test_tokens_and_words():
    owner, found = tokens(pa.array(["Ab,", "thonder", "éß"]))
    pairs = sorted(zip(owner.tolist(), found.to_pylist(), strict=True))
    assert pairs == sorted([(0, "^ab$"), (2, "^éß$"), *((1, g) for g in ("^thon", "thond", "honde", "onder", "nder$"))])
    scorer = Scorer({"thond": 3.0, "onder": 4.0, "^ab$": 1.0}, -0.1)
    assert scorer.words(pa.array(["Ab,", "thonder", "éß"]))[0].tolist() == [1.0, 4.0, -0.1]
    signed = Scorer({"thond": 3.0, "onder": -4.0, "^ab$": -1.0}, -0.1)
    scores, known = signed.words(pa.array(["Ab,", "thonder", "éß"]))
    assert scores.tolist() == [-1.0, -4.0, -0.1] and known.tolist() == [True, True, False]


def test_long_words_take_linear_time():
    r = random.Random(4)
    for n in (0, 1, 3, 4, 58, 59, 60, 61, 62, 63, 64, 65, 119, 120, 121, 122, 123, 124, 125, 300):
        word = "".join(r.choice("abc") for _ in range(n))
        padded = f"^{word}$"
        grams = [padded[i : i + 5] for i in range(len(padded) - 4)] or [padded]
        grams = set(grams) if len(padded) > 64 else grams
        owner, found = tokens(pa.array(["xy", word, "z"]))
        assert sorted(t for o, t in zip(owner.tolist(), found.to_pylist(), strict=True) if o == 1) == sorted(grams)
    began = time.perf_counter()
    owner, _ = tokens(pa.array(["x" * 1_000_000, "".join(chr(97 + i * i % 23) for i in range(1_000_000)), *(f"word{i}" for i in range(5000))]))
    assert (owner == 0).sum() == 3 and (owner == 1).sum() > 3 and time.perf_counter() - began < 10


def brute_scores(rows, labels, hashes, config):
    """Scores by their definition, from Python alone; hashes are xxhash64(doc_id) and the calibrating ids."""
    order, calibrating = hashes
    known = dict(labels)
    chosen = sorted(known, key=lambda i: (order[i], i))[: config.train_rows]
    held = [i for i in chosen if i in calibrating]
    split = min(sum(known[i] for i in held), sum(1 - known[i] for i in held)) >= config.enough
    teach, curve = ([i for i in chosen if i not in calibrating], held) if split else (chosen, chosen)

    def grams(word):
        padded = "^" + word.lower().strip(".,;:!?\"'()[]") + "$"
        found = [padded[i : i + 5] for i in range(len(padded) - 4)] or [padded]
        return set(found) if len(padded) > 64 else found

    counts = defaultdict(lambda: [0, 0, 0])
    for i, text in rows:
        kind = known[i] if i in teach else 2
        for word in set(text.split()):
            for g in grams(word):
                counts[g][kind] += 1
    clean_all, toxic_all, others_all = (sum(c[k] for c in counts.values()) for k in range(3))
    weight = config.prior * (clean_all + toxic_all)
    odds = {}
    for g, (c, t, o) in counts.items():
        if c + t:
            prior = (c + t + o) / (clean_all + toxic_all + others_all) * weight
            value = math.log((t + prior) / (toxic_all + weight - t - prior)) - math.log((c + prior) / (clean_all + weight - c - prior))
            if abs(value) >= config.least_odds and abs(value) / math.sqrt(1 / (t + prior) + 1 / (c + prior)) >= config.least_z:
                odds[g] = value

    def word_scores(text):
        out = []
        for word in text.split():
            values = [odds[g] for g in grams(word) if g in odds]
            high, low = max([*values, 0.0]), min([*values, 0.0])
            out.append(((high if high >= -low else low) or config.rest, high != 0 or low != 0))
        return out

    scored = {i: word_scores(text) for i, text in rows}
    found = {i: sorted((s for _, _, s in segments(np.array([x for x, _ in w])) if s >= config.segment_score), reverse=True) for i, w in scored.items()}
    clean = [i for i in curve if not known[i]]
    words = sum(len(scored[i]) for i in clean)
    spread = np.zeros(48)
    for i in clean:
        for x, k in scored[i]:
            if k:
                spread[min(47, max(0, math.floor(2 * x) + 24))] += 1
    decay = decay_of(float(words), spread[24:], config.rest, spread[:24][::-1])
    k = max(1e-6, (sum(len(found[i]) for i in clean) + 0.5) / max(1.0, words) * math.exp(decay * config.segment_score))

    def evidence(i):
        total = best = 0.0
        for r, s in enumerate(found[i]):
            total += decay * s - math.log(k * max(1, len(scored[i])) + 1) + math.log(r + 1)
            best = max(best, total)
        return math.log1p(best)

    points = defaultdict(lambda: [0, 0])
    for i in curve:
        points[round(evidence(i), 2)][known[i]] += 1
    x = sorted(points)
    slope, bias = fit_curve(np.array(x), np.array([points[v][1] for v in x], float), np.array([points[v][0] for v in x], float))
    return {i: 1 / (1 + math.exp(-(slope * evidence(i) + bias))) for i, _ in rows}


@pytest.mark.parametrize("enough", [5, 1000])
def test_scores_against_their_definition(spark, enough):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    config = ToxicityConfig(least_z=2.0, enough=enough)
    hashed = docs.select("doc_id", F.xxhash64("doc_id").alias("h"), (F.pmod(F.xxhash64("doc_id", F.lit("calibrates")), F.lit(config.calibrating)) == 0).alias("c")).collect()
    known = labels[:250]
    expected = brute_scores(rows, known, ({r.doc_id: r.h for r in hashed}, {r.doc_id for r in hashed if r.c}), config)
    got = {r.doc_id: r.score for r in toxicity.score(docs, spark.createDataFrame(known, "doc_id long, toxic int"), config).collect()}
    assert got == pytest.approx(expected, abs=1e-6)


def test_long_texts_and_clashing_columns(spark):
    rows, labels = corpus(200)
    rows.append((1000, " ".join(t for _, t in rows * 40) + " " + "x" * 200_000))
    frame = spark.createDataFrame([(*r, 1, "s", 0.5) for r in rows], "doc_id long, text string, toxic int, segments string, score double")
    got = toxicity.score(frame, spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, toxic int, text string"))
    assert got.columns == ["doc_id", "th", "n_words", "score", "passages"]
    long = got.where("doc_id = 1000").first()
    assert long.n_words == sum(len(t.split()) for _, t in rows[:-1]) * 40 + 1 and long.passages


def test_calibration_parts():
    counts = np.zeros(24)
    counts[8] = 10
    decay = decay_of(10_000.0, counts, -0.1)
    assert 9990 / 10_000 * np.exp(-0.1 * decay) + 10 / 10_000 * np.exp(4.25 * decay) == pytest.approx(1, abs=1e-3)
    slope, bias = fit_curve(np.array([0.0, 10.0]), np.array([5.0, 95.0]), np.array([95.0, 5.0]))
    assert slope > 0 > bias


def corpus(n=600):
    r = random.Random(11)
    vocabulary = ["".join(r.choice(["th", "on", "er", "an", "ing", "ed", "re"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(20, 300))]
        bad = i % 6 == 0
        if bad:
            at = r.randrange(len(words))
            words[at:at] = [x for _ in range(4) for x in (r.choice(BAD), r.choice(vocabulary))]
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_documents(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    learnt = marks.where(~toxicity.held_out(F.col("doc_id")))
    got = {r.doc_id: r for r in toxicity.score(docs, learnt).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()}
    assert len(got) == len(rows)
    wrong = 0
    for i, bad in labels:
        assert got[i].held == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i].score <= 1
        if got[i].held:
            wrong += (got[i].score >= 0.5) != bool(bad)
            if bad and got[i].passages:
                words = rows[i][1].split()
                p = max(got[i].passages, key=lambda p: p.score)
                assert any(w in BAD for w in words[p.begin : p.end])
    assert wrong <= 2


def test_odd_tables(spark, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.score(empty, labels).count() == 0
    docs = spark.createDataFrame([(None, "a b"), (1, None), (1, "x y"), (2, ""), (2, "")], "doc_id long, text string")
    for marks in (labels, labels.limit(0)):
        got = toxicity.score(docs, marks).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 and r.passages == [] for r in got)
    small = toxicity.score(docs, labels, ToxicityConfig(train_rows=1)).collect()
    assert len(small) == 5

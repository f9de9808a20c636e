import hashlib
import random
import re

import numpy as np
import pytest

from lodestone.llm import recompression


def brute(rows, window):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][p : p + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone |= set(range(p, p + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("window", [50, 20, 3])
def test_against_brute_force(docs, rows, window):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in recompression.remove_repeats(docs, window=window).collect()}
    expected = brute([r[:2] for r in rows], window)
    assert got == expected
    assert sum(e[1] for e in expected.values()) > 0


@pytest.mark.parametrize("kept", [1, 3, 8])
def test_names_that_collide(monkeypatch, rows, kept):
    """With names of few values, symbols, stretches and anchors collide everywhere; words still decide."""
    import pyarrow as pa

    monkeypatch.setattr(recompression, "word_ids", lambda words, real=recompression.word_ids: real(words) % np.uint64(kept))
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([0] * len(rows)), pa.array([r[1] for r in rows])], names=["doc_id", "th", "text"])
    (parsed,) = recompression._parse(20)(iter([batch]))
    texts = {r[0]: re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows}
    told, count = {}, 0
    for r in parsed.to_pylist():
        for k1, k2, p0, p1 in zip(r["k1"], r["k2"], r["p0"], r["p1"], strict=True):
            stretch = tuple(texts[r["doc_id"]][p0 : p1 + 20])
            assert told.setdefault((k1, k2), stretch) == stretch
            count += p1 - p0 + 1
    assert count == sum(max(0, len(t) - 19) for t in texts.values()) and len(set(told.values())) == len(told)


@pytest.mark.parametrize("window", [50, 8])
def test_result_with_colliding_names(spark, docs, rows, monkeypatch, window):
    def few(words):
        return (np.arange(len(words)) * 0 + [len(w) % 3 for w in words.to_pylist()]).astype(np.uint64) if len(words) else np.zeros(0, np.uint64)

    monkeypatch.setattr(recompression, "word_ids", few)
    expected = brute([r[:2] for r in rows], window)
    parse, windows = recompression._parse(window), recompression._windows(window)

    def patched(run):
        def inner(batches):
            from lodestone.llm import recompression as r

            real, r.word_ids = r.word_ids, few  # in the worker, which later tests use as well
            try:
                yield from run(batches)
            finally:
                r.word_ids = real

        return inner

    monkeypatch.setattr(recompression, "_parse", lambda _: patched(parse))
    monkeypatch.setattr(recompression, "_windows", lambda _: patched(windows))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in recompression.remove_repeats(docs, window=window).collect()} == expected


def test_rounds_grow_with_the_window():
    assert [recompression.rounds(w) for w in (1, 3, 20, 50, 500)] == [1, 1, 2, 3, 5]


def test_very_long_text_and_clashing_columns(spark):
    r = random.Random(8)
    words = [f"w{r.randrange(10**6)}" for _ in range(150_000)]
    rows = [(1, " ".join(words), "n", 0), (2, "\n".join(words[50_000:50_100]) + " end", "n", 0), (3, " ".join(["head", *words]), "n", 0)]
    got = recompression.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, name string, n_words int"))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got.collect()) == [(1, 150_000, 0), (2, 101, 100), (3, 150_001, 150_000)]


def test_equal_windows_have_equal_anchors():
    r = random.Random(3)
    for trial in range(60):
        size = r.choice([2, 3, 50])
        docs = [[r.randrange(size) for _ in range(r.randint(0, 150))] for _ in range(6)]
        docs.append([1] * 90 + docs[0][:60] + [1] * 70)
        docs.append(docs[0] * 2)
        flat = recompression.mix(np.array([w for d in docs for w in d], dtype=np.uint64))
        bounds = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
        window = r.choice([5, 12, 50])
        seen, runs = {}, zip(*recompression.anchored(flat, bounds, window), strict=True)
        count = 0
        for p0, p1, anchor in runs:
            for p in range(p0, p1 + 1):
                count += 1
                assert seen.setdefault(tuple(flat[p : p + window]), anchor) == anchor, trial
        assert count == sum(max(0, len(d) - window + 1) for d in docs)


def test_odd_tables(spark, empty):
    assert recompression.remove_repeats(empty).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    odd = spark.createDataFrame([(None, text), (2, text), (2, text), (3, text + " tail"), (4, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in recompression.remove_repeats(odd).collect()), key=str)
    assert got == sorted([(None, 60, 0), (2, 60, 0), (2, 60, 0), (3, 61, 60), (4, 0, 0)], key=str)

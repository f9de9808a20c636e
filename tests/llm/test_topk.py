import math

import numpy as np
import pytest

from lodestone.llm import topk


@pytest.mark.parametrize(("n", "dims", "kind"), [(700, 16, "normal"), (900, 4, "ties"), (60, 8, "copies"), (3, 2, "normal")])
def test_against_brute_force(spark, monkeypatch, n, dims, kind):
    for name, value in {"FIRST_ROWS": 32, "SHARD_ROWS": 128, "BLOCK_QUERIES": 8, "PASS_QUERIES": 50, "TASK_ROWS": 300}.items():
        monkeypatch.setattr(topk, name, value)
    r = np.random.default_rng(n)
    x = r.normal(size=(n, dims)) if kind == "normal" else r.integers(-2, 3, size=(n, dims)) / 4 if kind == "ties" else np.repeat(r.normal(size=(1, dims)), n, axis=0)
    ids = r.permutation(3 * n)[:n]
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    whole = np.array([[math.floor(1024 * float(np.float32(c))) for c in v] for v in x], dtype=np.int64)
    expected = topk.brute_force(ids, whole, 10, 5)
    got = topk.search(frame, 10, 5).toPandas().sort_values(["query_id", "rank"]).reset_index(drop=True)
    assert list(map(tuple, got.to_numpy().tolist())) == list(map(tuple, expected.sort_values(["query_id", "rank"]).to_numpy().tolist()))


def test_bounds_prune():
    r = np.random.default_rng(0)
    x = (r.exponential(size=(4096, 6)).round(2) * 1000).astype(np.int64)
    query, scores = np.array([[5, 0, 0, 1, 0, 0]]), x @ np.array([5, 0, 0, 1, 0, 0])
    shares = []
    for floor in (None, [int(np.sort(scores)[-10])], [int(scores.max())]):
        lists = topk.Lists(np.arange(4096), x)
        ids, found = lists.search(query, np.array([-1]), 10, floor)[0]
        assert set(np.flatnonzero(scores >= (floor or [np.sort(scores)[-10]])[0])) <= set(ids) and all(scores[i] == s for i, s in zip(ids, found, strict=True))
        shares.append(lists.read / lists.held)
    assert shares[0] < 1 and shares[1] <= shares[0] and shares[2] <= shares[1] and shares[2] <= 0.5


@pytest.mark.parametrize("size", [2**20, 2**28, 2**40, 2**62])
def test_sums_are_exact_at_any_size(size):
    r = np.random.default_rng(size % 1000)
    x = np.array([[int(c) for c in row] for row in r.integers(-size, size, size=(300, 5))], dtype=np.int64)
    lists = topk.Lists(np.arange(300), x)
    for q in range(0, 300, 50):
        exact = sorted(((-sum(int(a) * int(b) for a, b in zip(x[q], v, strict=True)), i) for i, v in enumerate(x) if i != q))[:10]
        ids, scores = lists.search(x[q : q + 1], np.array([q]), 10)[0]
        assert sorted((-int(s), int(i)) for s, i in zip(scores, ids, strict=True)) == exact


def test_numbers_that_fit_in_no_long(spark):
    schema = "vec_id long, embedding array<double>"
    big = spark.createDataFrame([(0, [3e9, 3e9]), (1, [3e9, 3e9])], schema)
    with pytest.raises(Exception, match="does not fit in a long"):
        topk.search(big).collect()
    with pytest.raises(Exception, match="does not fit in a long"):
        topk.search(spark.createDataFrame([(0, [1e300]), (1, [1.0])], schema)).collect()
    near = spark.createDataFrame([(0, [2.0**20, 1.0]), (1, [2.0**20, 1.0]), (2, [2.0**20, 1.0 + 1 / 1024])], schema)
    assert [(r.query_id, r.vec_id, r.score) for r in topk.search(near).orderBy("rank").collect()] == [(0, 2, 2**60 + 1024 * 1025), (0, 1, 2**60 + 1024 * 1024)]


def test_passes_hold_few_queries_whatever_the_ids(spark, monkeypatch):
    """All ids are queries: passes go by the number of queries, not of rows."""
    monkeypatch.setattr(topk, "PASS_QUERIES", 100)
    asked = []
    real = topk._against

    def counted(queries, k):
        asked.append(sum(len(own) for own, _ in queries.values()))
        return real(queries, k)

    monkeypatch.setattr(topk, "_against", counted)
    rows = [(100 * i, [float(i % 17), 1.0]) for i in range(500)]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 2)
    assert sum(asked) == 500 and len(asked) == 10 and max(asked) <= 100
    assert got.count() == 1000


def test_lists_that_cannot_prune_are_left_early():
    r = np.random.default_rng(5)
    x = r.integers(-1000, 1000, size=(2000, 64))
    lists = topk.Lists(np.arange(2000), x)
    found = lists.search(x[:5], np.arange(5), 10)
    for q, (ids, scores) in enumerate(found):
        exact = sorted(((-int(s), i) for i, s in enumerate(x @ x[q]) if i != q))[:10]
        assert sorted((-int(s), int(i)) for s, i in zip(scores, ids, strict=True)) == exact
    assert lists.read <= 0.1 * lists.held


def test_one_vector_that_repeats_most(spark):
    rows = [(7, [1.0, 2.0])] * 600 + [(i, [float(i), 1.0]) for i in range(100, 400)]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 3)
    assert [(r.query_id, r["rank"], r.vec_id) for r in got.orderBy("query_id", "rank").collect()] == [(q, i + 1, v) for q in (100, 200, 300) for i, v in enumerate([399, 398, 397])]


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<double>, score string"
    assert topk.search(spark.createDataFrame([], schema)).count() == 0
    rows = [(0, [1.0, 0.5], "x"), (1, None, "x"), (2, [1.0, None], "x"), (3, [1.0, float("nan")], "x"), (4, [float("inf"), 0.0], "x"), (5, [0.5, -0.25], "x"), (5, [0.5, -0.25], "x"), (100, [1.0], "x"), (None, [1.0, 1.0], "x"), (7, [0.0001, -0.0001], "x"), (200, [], "x"), (201, [], "x"), (300, [], "x")]
    got = [tuple(r) for r in topk.search(spark.createDataFrame(rows, schema)).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 5, 512 * 1024 - 256 * 512), (0, 2, 5, 512 * 1024 - 256 * 512), (0, 3, 7, -512), (200, 1, 201, 0), (200, 2, 300, 0), (300, 1, 200, 0), (300, 2, 201, 0)]

import hashlib
import re

from lodestone.llm import mixing


def brute(rows, cycle=(5, 2, 1), most=3.0):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    sources = sorted({r[3] for r in rows if r[3] is not None}) + [None] * any(r[3] is None for r in rows)
    held = {s: sum(size[r[0]] for r in rows if r[3] == s) for s in sources}
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(sources)}
    target, clamped, total = {}, set(), sum(held.values())
    while True:
        left = total - sum(most * held[s] for s in clamped)
        open_ = [s for s in sources if s not in clamped]
        share = {s: weight[s] * (left / sum(weight[x] for x in open_)) for s in open_}
        over = {s for s in open_ if share[s] > most * held[s]}
        if not over:
            target = {s: most * held[s] for s in clamped} | share
            break
        clamped |= over
    taken = {}
    for s in sources:
        own = sorted((int(hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()[:8], 16), r[0]) for r in rows if r[3] == s)
        whole = int(target[s] // held[s]) if held[s] else 0
        part, total = target[s] - whole * held[s], 0
        for _, i in own:
            total += size[i]
            taken[i] = size[i] * (whole + (part > 0 and total - size[i] / 2 <= part))
    return {i: (size[i], held[r[3]], target[r[3]], taken[i]) for r in rows for i in [r[0]]}


def test_against_brute_force(docs, rows):
    got = {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in mixing.mix(docs).collect()}
    assert got == brute(rows)
    assert all(t <= 3 * s for s, _, _, t in got.values())


def test_weights_of_a_table(spark, docs, rows):
    weights = spark.createDataFrame([(None, 1), ("a", 1), ("b", 1), ("é", 7)], "source string, weight int")
    got = mixing.mix(docs, weights, max_epochs=2.0).groupBy("source").agg({"target": "max", "source_size": "max", "taken": "sum"}).collect()
    longest = max(len((r[1] or "").split()) for r in rows)
    for r in got:
        assert r["max(target)"] <= 2 * r["max(source_size)"] and abs(r["sum(taken)"] - r["max(target)"]) <= longest


def test_odd_tables(spark, empty):
    assert mixing.mix(empty).count() == 0
    odd = spark.createDataFrame([(None, None, None), (1, "", "a"), (1, "x y", "b"), (1, "x y", "b")], "doc_id long, text string, source string")
    got = [(r.source, r["size"], r.source_size) for r in mixing.mix(odd).collect()]
    assert sorted(got, key=str) == sorted([(None, 0, 0), ("a", 0, 0), ("b", 2, 4), ("b", 2, 4)], key=str)


def test_many_sources_that_clamp_in_turn(spark):
    """Small sources clamp round by round, each raising the share of the others."""
    rows = [(i, "w " * (2 ** (i % 12)), f"s{i % 12:02}", None) for i in range(120)] + [(1000 + i, "x y z", None, None) for i in range(5)]
    rows = [(i, t, None, s) for i, t, s, _ in rows]
    frame = spark.createDataFrame(rows, "doc_id long, text string, cap string, source string").repartition(4)
    got = {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in mixing.mix(frame).collect()}
    assert got == brute(rows)
    fixed = mixing.mix(frame, max_epochs=1.0, total=10**9).select("source_size", "target").distinct().collect()
    assert all(r.target == r.source_size for r in fixed)


def test_long_texts_and_clashing_columns(spark):
    rows = [(1, "ab " * 2_000_000, "a", 1.0), (2, "ab", "a", 2.0), (3, "c d", "b", 3.0)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, target double"))
    assert sorted((r.doc_id, r["size"]) for r in got.collect()) == [(1, 2_000_000), (2, 1), (3, 2)]

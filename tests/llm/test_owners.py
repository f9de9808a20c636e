import hashlib
import random

import pytest

from lodestone.llm import owners

SCHEMA = "doc_id long, text string, lang string, grp long, size long, final boolean, into long"


def brute(rows, largest=False):
    groups = {}
    lower = lambda t: (t or "").encode().lower().decode()
    for r in rows:
        groups.setdefault(lower(r[1]), []).append(r[0])
    out = []
    for r in rows:
        text = lower(r[1])
        ids = [i for i in groups[text] if i is not None]
        keep = (max(ids) if largest else min(ids)) if ids else None
        out.append((r[0], keep, len(groups[text]), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows, keep="smallest", parts=3, **more):
    df = spark.createDataFrame([(*r[:2], "x", 1, 2, False, 3) for r in rows], SCHEMA).repartition(parts)
    found = owners.owners(df, keep=keep, **more)
    got = found.members.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(rows, keep == "largest")
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)
    texts = found.texts.collect()
    assert len(texts) == len(kept)
    assert all(hashlib.sha256(t.text.encode()).hexdigest() == t.text_sha256 for t in texts)


def test_nulls_ties_repeated_rows_and_case(spark):
    rows = [(1, "Ab"), (2, "aB"), (2, "aB"), (3, None), (4, ""), (None, ""), (None, "q"), (None, "Q"), (5, "É"), (6, "é"), (7, "ab "), (-9, "x\ny"), (2**62, "X\ny")]
    check(spark, rows)
    check(spark, rows, "largest")


def test_empty_table(spark, empty):
    found = owners.owners(empty)
    assert found.members.collect() == [] and found.texts.collect() == []
    assert found.members.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_corpus(spark, rows):
    check(spark, rows, "largest")


@pytest.mark.parametrize("limit", [1, 3000, 60_000])
def test_spilled_subtrees_lose_nothing(spark, limit):
    r = random.Random(limit)
    base = "".join(r.choice("abc ") for _ in range(400))
    texts = [base[:i] + r.choice("xyz") + base[i + 1 :] for i in range(0, 400, 9)] + ["".join(r.choice("ab") for _ in range(r.randrange(8))) for _ in range(60)] + [base]
    rows = [(i, r.choice(texts)) for i in range(300)] + [(1000 + i, base) for i in range(150)]
    check(spark, rows, "largest", trie_bytes=limit)


def test_very_long_text(spark):
    long = "Lorem ipsum " * 250_000
    check(spark, [(1, long), (2, long.upper()), (3, long + "x"), (4, "x")])


def test_tries_share_prefixes():
    tries = owners.Tries()
    for text in (b"abcd", b"abce", b"abxx", b"zzzz"):
        node, way = tries.reach(text)
        node.terminal = owners.Terminal(0, 0)
        tries.grow(way, 0, 1)
    assert sorted(t for t, _ in tries.all()) == [b"abcd", b"abce", b"abxx", b"zzzz"]
    assert sorted(tries.roots[4].kids[ord("a")].kids) == [ord("c"), ord("x")]
    weight = sum(node.weight for node in tries.roots.values())
    assert weight == tries.weight
    gone = [t for t, _ in tries.spill(seal=True)]
    assert gone and tries.texts == 4 - len(gone)
    assert tries.reach(gone[0])[0].sealed


def test_wrong_keep(spark, empty):
    with pytest.raises(ValueError):
        owners.owners(empty, keep="first")

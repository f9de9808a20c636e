import hashlib
import random
import zlib

import pytest

from lodestone.llm import prefixtrie
from lodestone.staging import Staging

SCHEMA = "conv_id long, turn long, role string, text string, name string, part long, depth long"


def brute(rows, block=100, shared=6):
    """Every node by all prefixes of all rebuilt conversations."""
    own = {}
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0), tie, (role, text)))
    own = {c: [t[2] for t in sorted(v, key=lambda t: t[:2])] for c, v in own.items()}
    trunc = lambda c: c - int(abs(c) % block) * (1 if c >= 0 else -1)
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % shared
        whole[c] = tuple(own.get(trunc(c), [])[:h] + turns[h:])
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in below) if below else 1
        saved[node] = sum(saved[k] for k in below) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    out = []
    for node, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if len(whole[c]) == len(node))
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(kids.get(node, [])), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(spark, rows, parts=3, **more):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(parts)
    if not more:
        return sorted((tuple(r) for r in prefixtrie.conversation_trie(df).collect()), key=repr)
    staging = Staging(spark, "test")
    return sorted((tuple(r) for r in prefixtrie.prefix_trie(prefixtrie.rebuilt(df, staging), staging, **more).collect()), key=repr)


def conversations(seed, n=90):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-150, 450), n):
        for t in range(r.choice([1, 2, 3, 5, 8])):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(["hi", "é ü", "x" * 50, ""])))
    for c in range(1000, 1040):  # alike, and beyond the block's own ids
        rows += [(c, t, "user", f"same {t}") for t in range(7)]
    rows += [(5000, t, "user", f"deep {t}") for t in range(40)] + [(5001, t, "user", f"deep {t}") for t in range(60)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    rows = conversations(seed)
    assert trie(spark, rows) == brute(rows)


def test_many_small_runs_and_ranges(spark):
    rows = conversations(3)
    assert trie(spark, rows, run_bytes=800, range_bytes=2000) == brute(rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "a", "user"), (2, None, "", ""), (2, 5, "usera", ""), (None, 0, "user", "x"), (100, 0, None, "q"), (101, 0, "user", "own"), (-7, 3, "user", "n"), (2**60, 0, "user", "far")]
    assert trie(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert trie(spark, []) == []


def test_turnless_conversations_stay_at_the_root(spark):
    rows = [(c, 0, "user", "only") for c in range(201, 260)]
    found = trie(spark, rows)
    assert found == brute(rows)
    root = next(r for r in found if r[1] == 0)
    assert root[3] == 59 and root[7] != prefixtrie.NOBODY


def test_very_long_text(spark):
    rows = [(c, t, "user", "long " * 300_000) for c in (1, 2) for t in range(2)]
    assert trie(spark, rows) == brute(rows)


def test_long_list_of_members_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "PIECE", 60)
    rows = [(c, t, "user", f"t{t}") for c in range(300, 400) for t in range(6)]
    assert trie(spark, rows) == brute(rows)


def test_merge_compares_no_shared_turn_again():
    r = random.Random(9)
    names = [bytes([i]) * prefixtrie.TURN for i in range(3)]
    rows = [(b"".join(r.choice(names) for _ in range(r.randrange(7))), i) for i in range(200)]
    runs = [sorted(rows[i::7]) for i in range(7)]
    flat, bounds = [x for run in runs for x in run], [0]
    lcps = []
    for run in runs:
        bounds.append(bounds[-1] + len(run))
        lcps += [0] + [prefixtrie.common(a[0], b[0], 0) for a, b in zip(run, run[1:], strict=False)]
    out = list(prefixtrie.merged([f[0] for f in flat], [f[1] for f in flat], lcps, bounds))
    assert [flat[i] for i, _ in out] == sorted(rows)
    want = [0] + [prefixtrie.common(a[0], b[0], 0) for a, b in zip(sorted(rows), sorted(rows)[1:], strict=False)]
    assert [same for _, same in out] == want

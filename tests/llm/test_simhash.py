import random
import re

import pytest
import xxhash

from lodestone.llm import simhash
from lodestone.staging import Staging


def brute_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_against_brute_force(docs, rows):
    prints = {r[0]: brute_print(r[1]) for r in rows}
    roots = brute_components(prints)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (prints[i], roots[i]) for i in prints}


@pytest.mark.parametrize("bucket", [2, 5, 16])
def test_links_join_what_is_near(spark, bucket):
    r = random.Random(bucket)
    prints = set()
    for _ in range(6):
        base = r.getrandbits(64)
        prints |= {base ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(40)}
    prints = sorted(prints)
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    links = simhash.links(spark.createDataFrame(signed, "fp long"), Staging(spark, "t"), bucket).collect()
    parent = {s[0]: s[0] for s in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        assert ((a ^ b) % 2**64).bit_count() <= 2
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    expected = brute_components(dict(enumerate(prints)))
    groups = {}
    for i, s in enumerate(signed):
        groups.setdefault(expected[i], set()).add(find(s[0]))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_odd_tables(spark, empty):
    assert simhash.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (7, None)], "doc_id long, text string")
    got = sorted(map(tuple, simhash.near_duplicates(odd).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(None, 5), (5, 5), (5, 5), (7, 7)], key=str)

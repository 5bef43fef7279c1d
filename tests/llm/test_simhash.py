import random
import re

import cases
import pytest
import xxhash

from tallygrain.llm import simhash as S
from tallygrain.llm.links import components


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(values, radius=3):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {v: frozenset(w for w in values if find(w) == find(v)) for v in values}


@pytest.mark.parametrize("text", [t for _, t in cases.texts()] + ["A b", "ÀB c D e"])
def test_fingerprint(text):
    assert S.fingerprint(None if text is None else text.encode(), chunk=50) == brute_fingerprint(text)


@pytest.mark.parametrize(("blocks", "tree_size"), [(4, 4096), (4, 5), (6, 3)])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, blocks, tree_size):
    rng = random.Random(blocks)
    base = [rng.getrandbits(64) for _ in range(40)] + [0, 2**64 - 1]
    values = set(base)
    for _ in range(200):
        v = rng.choice(sorted(values))
        for _ in range(rng.randint(1, 4)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    monkeypatch.setattr(S, "blocks_for", lambda n, r=3: blocks)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    found = components(S.links(df, tree_size=tree_size)).collect()
    root = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in found}
    groups = brute_groups(values)
    for v in values:
        assert groups[v] == frozenset(w for w in values if root.get(w, w) == root.get(v, v))


def test_every_choice_of_blocks_is_covered():
    for blocks in range(4, 10):
        masks = S.block_masks(blocks)
        for _ in range(200):
            x = 0
            for _ in range(3):
                x ^= 1 << random.randrange(64)
            assert any(x & m == 0 for m in masks)


def test_long_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(0, 120)] + [(1000, 2000 + i) for i in range(300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(121)) and all(got[2000 + i] == 1000 for i in range(300)) and got[1000] == 1000


def test_edges(spark):
    docs = cases.documents(spark)
    rows = S.simhash_components(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["component_id"] == -13 == by[2][0]["component_id"]  # the smallest id of the copies
    assert {by[i][0]["component_id"] for i in (4, 5, 6)} == {4} and by[4][0]["fingerprint"] == "0" * 16
    assert S.simhash_components(docs.limit(0)).collect() == []
    kept = S.one_of_each_group(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None).count(9) <= 1 and 2 not in ids and -13 in ids and 5 not in ids
    assert S.one_of_each_group(docs.limit(0)).collect() == []

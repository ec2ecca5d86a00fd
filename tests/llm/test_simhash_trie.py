import random
import re
import string

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm import simhash_trie as m
from loomspan.llm.simhash_trie import connected_components, fingerprint, keep_one_per_group, op8_simhash, trie_forest, trie_links
from tests.llm.conftest import prose


def fingerprint_by_hand(text):
    t = (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(keys, budget):
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            if bin(keys[i] ^ keys[j]).count("1") <= budget:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(keys))]


def clusters(rng, n, spread):
    out = set()
    for _ in range(n):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            x = base
            for _ in range(rng.randint(0, spread)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("budget", [1, 2, 3])
def test_trie_walk_joins_like_all_pairs(seed, budget, monkeypatch):
    monkeypatch.setattr(m, "FRONTIER", 50)
    keys = clusters(random.Random(seed), 12, 6)
    edges = trie_forest(np.array(keys, np.uint64), 0, budget)
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        assert bin(keys[a] ^ keys[b]).count("1") <= budget
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(keys))] == components(keys, budget)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aBc \n\t\x0b é", max_size=40))
def test_fingerprint(text):
    assert fingerprint(text) == fingerprint_by_hand(text)


@pytest.mark.parametrize(("shard", "blocks"), [(10_000, 4), (8, 4), (10_000, 6), (3, 6)])
def test_links_over_blocks_and_shards(spark, shard, blocks):
    keys = clusters(random.Random(11), 15, 5)
    signed = [k - (1 << 64) if k >> 63 else k for k in keys]
    edges = trie_links(spark.createDataFrame([(k,) for k in signed], "fp long"), 3, shard, blocks)
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    want = components(keys, 3)
    groups = {}
    for k, w in zip(signed, want):
        groups.setdefault(w, []).append(k)
    for own in groups.values():
        assert {got.get(k, k) for k in own} == {min(own)}


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_every_row(documents, no_documents):
    rows = documents.collect()
    fps = [fingerprint_by_hand(r["text"]) for r in rows]
    root = components(fps, 3)
    least = {}
    for r, w in zip(rows, root):
        if r["doc_id"] is not None:
            least[w] = min(least.get(w, r["doc_id"]), r["doc_id"])
    want = sorted(str((r["doc_id"], f"{f:016x}", least.get(w))) for r, f, w in zip(rows, fps, root))
    assert sorted(str((r["doc_id"], r["fingerprint"], r["component_id"])) for r in op8_simhash(documents).collect()) == want
    assert op8_simhash(no_documents).count() == 0
    kept = keep_one_per_group(documents)
    assert kept.columns == documents.columns
    mine = sorted(str((r["doc_id"], r["text"])) for r in kept.collect())
    first = {}
    for r, w in zip(rows, root):
        key = (r["doc_id"] is None, r["doc_id"])
        if w not in first or key < first[w][0]:
            first[w] = (key, str((r["doc_id"], r["text"])))
    assert len(mine) == len(first) and {x.split(",")[0] for x in mine} == {v[1].split(",")[0] for v in first.values()}


def test_near_copies_of_long_texts_meet(spark):
    rng = random.Random(8)
    text = prose(rng, 300)
    rows = [(1, text), (2, text.replace("stone", "stone", 1) + " end"), (3, prose(rng, 300))]
    got = {r["doc_id"]: r["component_id"] for r in op8_simhash(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}

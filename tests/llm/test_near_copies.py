import random

import numpy as np
import pytest
from loomspan.llm import near_copies as m
from loomspan.llm.common import first_of_group
from loomspan.llm.near_copies import keep_one_near_copy, near_copy_groups, similarity
from loomspan.llm.simhash_trie import shingle_hashes, simhash_groups
from tests.llm.conftest import prose


def by_words(a, b, width=5):
    """The similarity from the words themselves."""

    def runs(words):
        if not words:
            return []
        return [tuple(words[k : k + width]) for k in range(max(len(words) - width + 1, 1))]

    x, y = ((t or "").lower().split() for t in (a, b))
    if not x or not y:
        return float(x == y)

    def covered(own, other):
        seen, hit = set(runs(other)), set()
        for k, run in enumerate(runs(own)):
            if run in seen:
                hit.update(range(k, k + len(run)))
        return len(hit) / len(own)

    return min(covered(x, y), covered(y, x))


def closure(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return [find(i) for i in range(n)]


def groups_by_hand(texts, least):
    return closure(len(texts), lambda i, j: by_words(texts[i], texts[j]) >= least)


def edited(rng, text, share):
    words = text.split()
    for _ in range(max(1, int(share * len(words)))):
        words[rng.randrange(len(words))] = rng.choice(["amber", "cobalt", "violet", "umber"])
    return " ".join(words)


def first_members(spark, texts, **how):
    got = {r["doc_id"]: r["root"] for r in near_copy_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **how).collect()}
    first = {}
    for i in sorted(got):
        first.setdefault(got[i], i)
    return [first[got[i]] for i in range(len(texts))]


@pytest.mark.parametrize("shard", [10_000, 6])
def test_groups_like_all_pairs(spark, shard):
    rng = random.Random(3)
    texts = []
    for _ in range(40):
        base = prose(rng, 60)
        texts += [base] + [edited(rng, base, rng.choice([0.002, 0.02, 0.05, 0.07])) for _ in range(rng.randint(0, 6))]
    hot = prose(rng, 60)
    texts += [edited(rng, hot, 0.04) for _ in range(60)]
    assert first_members(spark, texts, shard=shard) == groups_by_hand(texts, m.SIMILARITY)


def test_every_row(documents, no_documents):
    kept = keep_one_near_copy(documents)
    assert kept.columns == documents.columns
    rows = documents.collect()
    want = groups_by_hand([r["text"] for r in rows], m.SIMILARITY)
    least = {}
    for r, w in zip(rows, want):
        key = (r["doc_id"] is None, r["doc_id"] or 0)
        least[w] = min(least.get(w, key), key)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted(least.values())
    assert keep_one_near_copy(no_documents).count() == 0


def test_among_restricts_the_rows(documents):
    first = first_of_group(simhash_groups(documents))
    kept = keep_one_near_copy(documents, among=first)
    assert kept.columns == documents.columns and kept.count() <= first.count() < documents.count()


def test_similarity_and_sketch():
    def of(a, b):
        return similarity(shingle_hashes(a, m.WIDTH), shingle_hashes(b, m.WIDTH))

    pairs = [(None, "  "), ("a b", "A  b"), ("a b c d e f", "a b c d e g"), ("", "a"), ("a b c", "a b d"), ("a b c d e", "a b c d e f g h i j k")]
    rng = random.Random(2)
    for _ in range(200):
        base = prose(rng, rng.randint(1, 12))
        pairs.append((base, edited(rng, base, rng.choice([0.01, 0.05, 0.2])) + rng.choice(["", " " + prose(rng, 3)])))
    for a, b in pairs:
        assert of(a, b) == pytest.approx(by_words(a, b)), (a, b)
    values = np.random.default_rng(1)
    base = np.unique(values.integers(1 << 63, size=9000, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    near = np.r_[base[:8000], np.unique(values.integers(1 << 63, size=1000, dtype=np.uint64))]
    one, two = m.sketch_of(np.sort(base)), m.sketch_of(np.sort(near))
    assert abs((one == two).mean() - 0.8) < 0.2 and one.all() and not m.sketch_of(base[:0]).any() and np.count_nonzero(m.sketch_of(base[:1])) == 1


@pytest.mark.parametrize("shard", [10_000, 50])
def test_template_group_keeps_no_tested_away_pair(spark, shard):
    """Most pairs lie just below 0.8: links that fall must not hide true ones, however cells are dealt."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for i in range(160):
        own = list(base)
        for at in rng.sample(range(200), 13):
            own[at] = f"x{i}y{at}"
        texts.append(" ".join(own))
    ordered = [shingle_hashes(t, m.WIDTH) for t in texts]
    made = [m.describe(np.unique(x)) for x in ordered]
    sketches = np.stack([np.frombuffer(x[3], np.uint8) for x in made])

    def agree(i, j):
        filled = (sketches[i] > 0) | (sketches[j] > 0)
        return (sketches[i] == sketches[j])[filled].mean()

    cells = [{x[2][k : k + 8] for k in range(0, 8 * m.BANDS, 8)} for x in made]

    def linked(i, j):
        near = cells[i] & cells[j] and (made[i][1] ^ made[j][1]).bit_count() <= m.BUDGET and agree(i, j) >= m.FLOORS[-1]
        return bool(near) and similarity(ordered[i], ordered[j]) >= m.SIMILARITY

    tests = [similarity(ordered[i], ordered[j]) >= m.SIMILARITY for i in range(160) for j in range(i)]
    assert 0.02 < np.mean(tests) < 0.5
    assert first_members(spark, texts, shard=shard) == closure(160, linked)


def test_a_hub_is_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(m, "HUB", 8)
    rng = random.Random(4)
    base = prose(rng, 40)
    texts = [base] + [edited(rng, base, 0.02) for _ in range(50)] + [prose(rng, 10) for _ in range(5)]
    assert first_members(spark, texts) == groups_by_hand(texts, m.SIMILARITY)


def test_clashing_columns_pass_through(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", "y", 1), (2, "A b c", "z", "w", 2), (3, "q", None, None, 3)], "doc_id long, text string, k1 string, node string, root int")
    out = keep_one_near_copy(docs)
    assert out.columns == docs.columns
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a b c", "x", "y", 1), (3, "q", None, None, 3)]

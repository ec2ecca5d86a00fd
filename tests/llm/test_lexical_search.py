import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from loomspan.llm import lexical_search as m

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items, k=m.TOP):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    total, df = sum(sum(c.values()) for _, c in counts), Counter(t for _, c in counts for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, own in asked.items():
        scored = []
        for doc, c in counts:
            norm = 100 - 50 + (50 * sum(c.values()) * len(counts)) // total
            score = sum(math.floor(1000 * math.log((2 * len(counts) + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * norm)) for t in own if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(map(str, out))


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(str, map(tuple, df.collect())))


ITEMS = [(1, "Stone river LAMP window"), (2, "quiet copper; quiet copper\x0bmeadow"), (2, "harbour"), (3, None), (4, "..."), (None, "naïve 漢字 ١٢ d"), (5, "nowhere to be found zzz"), (6, "x" * 5000 + " word")]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, 1, "r") for i, t in ITEMS], "item_id long, text string, rank int, score string")


def test_matches_brute_force(documents, items):
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert got(m.op13_lexical_search(documents, items)) == by_hand(docs, ITEMS)


def test_many_segments_prune_and_still_agree(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(rng.randrange(2_500), " ".join(rng.choices(words, weights, k=rng.randint(1, 60)))) for _ in range(3_000)] + [(5_000 + i, "w1 w7 w7 w20") for i in range(400)]
    asked = [(i, " ".join(rng.choices(words, k=rng.randint(1, 25)))) for i in range(40)] + [(99, "w1 w7 w20 w299")]
    frame, queries = spark.createDataFrame(docs, "doc_id long, text string").repartition(6), spark.createDataFrame(asked, "item_id long, text string")
    want = by_hand(docs, asked, 10)
    for size in (1, 3_000, 1 << 24):
        own = frame.limit(300) if size == 1 else frame
        index = m.build_index(own, segment_bytes=size)
        if size == 3_000:
            assert index.select("segment").distinct().count() > 50
        expected = by_hand([tuple(r) for r in own.collect()], asked, 10) if size == 1 else want
        assert got(m.search(index, m.query_terms(queries), 10)) == expected


def test_blocks_of_queries(spark, documents, items, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    monkeypatch.setattr(m, "BLOCK_TERMS", 3)
    assert got(m.search(m.build_index(documents), m.query_terms(items))) == by_hand(docs, ITEMS)


def test_empty_tables(spark, documents, no_documents, items):
    assert got(m.op13_lexical_search(no_documents, items)) == [] == got(m.op13_lexical_search(documents, items.limit(0)))


def test_postings_round_trip():
    rng = np.random.default_rng(1)
    values = np.r_[0, 1, 127, 128, (1 << 62) - 1, rng.integers(0, 1 << 40, 1000), rng.integers(0, 300, 1000)]
    data, ends = m.packed(values)
    assert (m.unpacked(data.tobytes()) == values).all() and ends[-1] == len(data)
    assert len(m.unpacked(b"")) == 0 and len(m.packed(np.empty(0, np.int64))[0]) == 0


def test_sql_agrees(documents, items):
    con = duckdb.connect()
    for name, frame, key in (("documents", documents, "doc_id"), ("benchmark", items, "item_id")):
        own = frame.select(key, "text").toPandas()
        con.register(name, own.astype(object).where(own.notna(), None).astype({key: "Int64"}))
    want = con.sql(f"SELECT item_id, rank, doc_id, score FROM ({m.oracle_sql()})").fetchall()
    assert sorted(map(str, want)) == got(m.op13_lexical_search(documents, items))

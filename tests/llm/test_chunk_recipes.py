import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np

from loomspan.llm import chunk_recipes as m


def by_hand(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["text"] or ""].append(r["doc_id"])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        first = True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and first, hashlib.sha256(text.encode()).hexdigest()))
            first = first and i != keep
    return sorted(map(str, out))


def test_groups_match_brute_force(documents):
    assert sorted(map(str, map(tuple, m.op11_chunk_recipes(documents).collect()))) == by_hand(documents.collect())


def test_long_texts_share_chunks(spark):
    rng = random.Random(1)
    body = "".join(rng.choice("abcdefghij \n") for _ in range(300_000))
    texts = [body, body + "x", "x" + body, body, body[:-1], "a" * 200_000, "a" * 200_001, "a" * 200_000, "é" * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert sorted(map(str, map(tuple, m.op11_chunk_recipes(docs).collect()))) == by_hand(docs.collect())
    distinct = m.chunks(docs).select("id").distinct().count()
    assert distinct < 300  # the four variants of one body share nearly all chunks


def test_chunks_join_to_the_text_and_keep_their_bounds():
    rng = np.random.default_rng(3)
    for data in (rng.integers(97, 120, 3_000_000).astype(np.uint8), np.zeros(100_000, np.uint8), np.arange(600, dtype=np.int64).astype(np.uint8)):
        places = m.cut_places(data)
        ends = list(m.chunk_ends(places, 0, len(data)))
        sizes = np.diff([0, *ends])
        assert ends[-1] == len(data) and sizes.max() <= m.MOST and (sizes[:-1] >= m.LEAST).all()
        assert [e + 700 for e in ends] == list(m.chunk_ends(m.cut_places(np.r_[np.full(700, 7, np.uint8), data]), 700, len(data) + 700))


def test_clashing_identifiers_are_found_and_replaced(documents):
    rows, groups = m.copy_groups(documents)
    plain = sorted(map(str, map(tuple, m.op11_chunk_recipes(documents).collect())))
    again = m.exact_copies(documents, widths=(2, 3, 128)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(str, map(tuple, again.collect()))) == plain
    narrow = m.recipes(documents, width=2)
    shared = narrow.groupBy("key").count().where("count > 1").select("key")
    assert not m.is_verified(m.chunks(documents, width=2), shared)
    assert m.is_verified(m.chunks(documents), groups.where("group_size > 1").join(m.recipes(documents).select("recipe", "key").distinct(), "recipe"))


def test_without_filter_and_with_hot_groups(spark, documents, monkeypatch):
    docs = spark.createDataFrame([(i % 700, ["copy " * 400, "other", f"own {i}"][min(2, i % 3)]) for i in range(2_000)], "doc_id long, text string").repartition(5)
    want = by_hand(docs.collect())
    assert sorted(map(str, map(tuple, m.op11_chunk_recipes(docs).collect()))) == want
    monkeypatch.setattr(m, "FILTER_KEYS", 0)
    assert sorted(map(str, map(tuple, m.op11_chunk_recipes(docs).collect()))) == want


def test_empty_table_and_clashing_columns(spark, no_documents):
    assert m.op11_chunk_recipes(no_documents).collect() == []
    docs = spark.createDataFrame([(1, "a", 1, "r", True), (2, "a", 2, "s", False), (2, "a", 2, "s", False), (None, "b", 3, None, None)], "doc_id long, text string, keep_id int, recipe string, kept boolean")
    out = m.without_copies(docs)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, [docs.collect()[1], docs.collect()[3]]))


def test_sql_agrees(documents):
    docs = documents.select("doc_id", "text").toPandas()
    con = duckdb.connect()
    con.register("documents", docs.astype(object).where(docs.notna(), None).astype({"doc_id": "Int64"}))
    want = con.sql(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({m.oracle_sql()})").fetchall()
    assert sorted(map(str, want)) == sorted(map(str, map(tuple, m.op11_chunk_recipes(documents).collect())))

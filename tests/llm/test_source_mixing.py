import re
from collections import Counter, defaultdict

import duckdb
import pytest

from loomspan.llm import source_mixing as m
from loomspan.llm.source_mixing import mix, mixed_documents, op4_mixing, oracle_sql


def targets_by_hand(sizes):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        share = sum(w[s] for s in sizes if s not in capped)
        t = {s: 3 * sizes[s] if s in capped else left * w[s] / share for s in sizes}
        over = {s for s in sizes if s not in capped and t[s] > 3 * sizes[s]}
        if not over:
            return t
        capped |= over


def check(rows, got):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    want = targets_by_hand(sizes)
    by_total = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by_total[(r["source_size"], round(r["target"], 6))] += r["taken"]
    for (_, target), taken in by_total.items():
        assert abs(taken - int(target + 1e-9)) <= 1 or sum(1 for t in want.values() if abs(t - target) < 1e-6) > 1
    assert {round(r["target"], 6) for r in got} == {round(t, 6) for t in want.values()}


def test_targets_and_budgets(documents, monkeypatch):
    rows = documents.collect()
    got = op4_mixing(documents).collect()
    assert len(got) == len(rows)
    check(rows, got)
    for ranges in (1, 23):  # the same mix, however many ranges
        monkeypatch.setattr("loomspan.operators.ranges.range_count", lambda _: ranges)
        assert sorted(map(str, op4_mixing(documents).collect())) == sorted(map(str, got))


def test_many_sources(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), f"host{i % 300}") for i in range(900)], "doc_id long, text string, source string")
    check(docs.collect(), op4_mixing(docs).collect())


def test_clashing_columns_pass_through(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", "p", 1, {"m": 1}), (1, "a b c", "x", "q", 2, None), (2, "d e f g", "y", "r", 3, None)], "doc_id long, text string, source string, k1 string, taken int, Size map<string,int>")
    out = mixed_documents(docs)
    assert out.columns == docs.columns and {r["k1"] for r in out.collect()} <= {"p", "q", "r"}


def test_sql_agrees(documents):
    con = duckdb.connect()
    con.register("documents", documents.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    want = con.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({oracle_sql()})").fetchall()
    assert sorted(map(str, map(tuple, op4_mixing(documents).collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("sizes", [{"a": 1, "b": 100, "c": 3}, {"a": 5}, {"a": 0, "b": 0}, {"a": 1000, "b": 1, "c": 1, None: 7}, {}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in m.source_targets(df).collect()}
    assert got == pytest.approx(targets_by_hand(sizes) if sum(sizes.values()) else {k: 0.0 for k in sizes})


def test_mixed_texts_have_the_taken_words(documents):
    def count(t):
        return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))

    plan = Counter()
    for r in mix(documents).collect():
        plan[r["doc_id"]] += r["taken"]
    out = mixed_documents(documents)
    assert out.columns == documents.columns
    mine = Counter()
    originals = defaultdict(set)
    for r in documents.collect():
        originals[r["doc_id"]].add(r["text"] or "")
    for r in out.collect():
        mine[r["doc_id"]] += count(r["text"])
        assert any(t.startswith(r["text"]) for t in originals[r["doc_id"]])
        assert r["n_chars"] == len(r["text"])
    assert +plan == +mine


def test_empty(no_documents):
    assert op4_mixing(no_documents).count() == 0
    assert mixed_documents(no_documents).count() == 0


@pytest.mark.parametrize("few", [0, 10_000])
def test_many_repeated_rows(spark, monkeypatch, few):
    """Groups of one id, text and source that the cut runs through, by sums of the group alone."""
    monkeypatch.setattr(m, "FEW", few)
    rows = [(7, "a b c d e", "x", i) for i in range(400)] + [(i, "f g h", "x", 0) for i in range(100, 130)] + [(1, "k l", "y", i) for i in range(60)] + [(None, "m n o", None, 5)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, k1 int")
    check(docs.collect(), op4_mixing(docs).collect())
    plan, mine = Counter(), Counter()
    for r in mix(docs).collect():
        plan[(r["doc_id"], r["source"])] += r["taken"]
    out = mixed_documents(docs).collect()
    for r in out:
        mine[(r["doc_id"], r["source"])] += len(r["text"].split())
    assert +plan == +mine
    assert sum(r["text"] not in {t for _, t, _, _ in rows} for r in out) <= 3  # at most one text a source is cut


def test_repeated_rows_fill_many_ranges(spark, monkeypatch):
    """Rows repeated whole are no hot range."""
    monkeypatch.setattr("loomspan.operators.ranges.range_count", lambda _: 8)
    seen = []
    own = m.prefix_sums
    monkeypatch.setattr(m, "prefix_sums", lambda rows, order, *a: seen.append(rows.repartitionByRange(8, *order).groupBy(m.F.spark_partition_id()).count().collect()) or own(rows, order, *a))
    docs = spark.createDataFrame([(1, "a b", "x")] * 4000, "doc_id long, text string, source string")
    assert sum(r["taken"] for r in op4_mixing(docs).collect()) == 8000
    assert max(n for _, n in seen[-1]) < 2000

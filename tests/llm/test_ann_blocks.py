import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomspan.llm.ann_blocks import FINE, coded, nearest, op1_ann_blocks, quantise, refine, surviving


def brute(rows, is_query, k):
    found = {}
    for q, v in rows:
        if is_query(q):
            scored = sorted(((float(np.dot(v, w)), -i) for i, w in rows if i != q), reverse=True)[:k]
            found[q] = [(-i, s) for s, i in scored]
    return found


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def agree(mine, theirs):
    assert mine.keys() == theirs.keys()
    for q in theirs:
        assert [i for i, _ in mine[q]] == [i for i, _ in theirs[q]]
        assert np.allclose([s for _, s in mine[q]], [s for _, s in theirs[q]], rtol=0, atol=1e-12)


@pytest.fixture
def vectors():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((150, 8)).round(3)
    x[30:60] = x[7]  # a common vector
    return [(i, x[i].tolist()) for i in range(150)]


def test_matches_brute_force(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    agree(got(op1_ann_blocks(df)), brute(vectors, lambda i: i % 20 == 0, 20))


def test_many_cells(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    agree(got(nearest(df, F.col("vec_id") % 3 == 0, 5, block=40)), brute(vectors, lambda i: i % 3 == 0, 5))


def test_error_bound_holds():
    rng = np.random.default_rng(1)
    q, c = rng.standard_normal((20, 16)), rng.standard_normal((30, 16)) * 100
    q8, qs, _, qe = quantise(q)
    c8, cs, cn, ce = quantise(c)
    near = (q8.astype(float) * qs[:, None]) @ (c8.astype(float) * cs[:, None]).T
    bound = qe[:, None] * cn[None] + np.linalg.norm(q, axis=1)[:, None] * ce[None]
    assert (np.abs(near - q @ c.T) <= bound + 1e-9).all()


def coded_rows(x):
    return pd.DataFrame({"vec_id": np.arange(len(x)), "same": [v.tobytes().hex() for v in x], **coded(x)})


def test_second_level_bound_holds():
    rng = np.random.default_rng(4)
    q, c = rng.standard_normal((20, 16)) + 3, rng.standard_normal((30, 16)) * 0.01 + 1
    (q8, qs, _, qe), (c8, cs, _, _) = quantise(q), quantise(c)
    (q2, _, qe2), (c2, cn2, ce2) = refine(q, q8, qs), refine(c, c8, cs)
    near = ((q8 * float(FINE) + q2) * (qs / FINE)[:, None]) @ ((c8 * float(FINE) + c2) * (cs / FINE)[:, None]).T
    bound = qe2[:, None] * cn2[None] + np.linalg.norm(q, axis=1)[:, None] * ce2[None]
    assert (np.abs(near - q @ c.T) <= bound + 1e-12).all() and (qe2 < qe / 100).all()


@pytest.mark.parametrize("spread, share", [(0.01, 0.02), (0.003, 0.05)])
def test_clusters_leave_few_pairs(spread, share):
    """All vectors lie around one centre of norm 8: the first level alone would keep every pair."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal(64) + spread * rng.standard_normal((4000, 64))
    rows = coded_rows(x)
    pairs = surviving(rows, rows[:200], 20)
    left = set(zip(pairs["query_id"], pairs["vec_id"]))
    for q in range(200):
        score = x @ x[q]
        score[q] = -np.inf
        assert {(q, int(i)) for i in np.argsort(-score)[:20]} <= left
    assert len(left) < share * 200 * 3999


def test_cells_of_clusters(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3, 8))[rng.integers(0, 3, 240)] * 4 + 0.01 * rng.standard_normal((240, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit("x"), "code": F.lit(b"y"), "n": F.lit(1), "low": F.lit(None)})
    agree(got(nearest(df, F.col("vec_id") % 6 == 0, 7, block=30)), brute(rows, lambda i: i % 6 == 0, 7))


def test_small_tiles_agree(monkeypatch):
    import loomspan.llm.ann_blocks as m

    monkeypatch.setattr(m, "TILE_ROWS", 64)
    monkeypatch.setattr(m, "TILE_QUERIES", 16)
    rng = np.random.default_rng(9)
    x = rng.standard_normal((500, 12)) * 10.0 ** rng.integers(-3, 4, (500, 1))
    x[100:140] = x[3]
    rows = coded_rows(x)
    pairs = surviving(rows, rows[:50], 20)
    left = set(zip(pairs["query_id"], pairs["vec_id"]))
    want = brute(list(enumerate(x)), lambda i: i < 50, 20)
    assert {(q, i) for q, best in want.items() for i, _ in best} <= left and len(left) < 50 * 100
    exact = {(q, i): float(x[q] @ x[i]) for q, i in left}
    assert all(lo <= exact[q, i] <= hi for q, i, lo, hi in pairs.itertuples(index=False))


def test_huge_and_mixed_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(4 + 2 * (i % 2)) * 10.0 ** rng.integers(-120, 120)).tolist()) for i in range(80)]
    by_length = {}
    for i, v in rows:
        by_length.setdefault(len(v), []).append((i, v))
    mine = got(op1_ann_blocks(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    want = {}
    for own in by_length.values():
        want |= brute(own, lambda i: i % 20 == 0, 20)
    assert {q: [i for i, _ in best] for q, best in mine.items()} == {q: [i for i, _ in best] for q, best in want.items()}


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 0.0]), (6, [0.5, 0.5]), (None, [1.0, 1.0]), (20, [0.0, 2.0]), (20, [0.0, 2.0]), (40, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("dim", F.lit(2))
    assert got(op1_ann_blocks(df)) == {0: [(6, 0.5), (20, 0.0)], 20: [(6, 1.0), (0, 0.0)]}


def test_empty(spark):
    assert op1_ann_blocks(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0

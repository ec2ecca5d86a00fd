"""Nearest neighbours by a block matrix join with int8 product tiles.

Vectors are quantised to int8 (one scale a row) and dealt into blocks by a hash of their id: queries into Q blocks, candidates into C blocks,
and each of the Q x C cells is one task. Only int8 rows travel, with their scale and norms. A cell multiplies tiles; int8 products are summed exactly, as all partial sums
stay below 2**24 in float32 for up to 1,000 dimensions (beyond, tiles are float64). With q = s_q q' + e_q and c = s_c c' + e_c the product obeys

    |q.c - s_q s_c q'.c'| <= |e_q| |s_c c'| + |q| |e_c|,

so a pair whose upper bound lies below the k-th best lower bound of its query cannot be among the k best and
is dropped. What is left of a tile is refined by a second level: the remainder e is quantised to int8 too, in steps of a 254th of s, and
products of 254 q' + q'' have the same bound with remainders 254 times smaller. So vectors that share a large offset, whose products all lie within the first
bound, still leave few pairs. Pairs are dropped within the cell, then among all cells, where the k best lower bounds of a query are found in two steps: among pairs of
a hash, then among what those keep. Only surviving pairs fetch the original components; their
product is recomputed in double precision, and a bounded heap per query merges them. The
result is exact: recall is 1 by construction.

Equal vectors of a cell are one tile row that carries its k + 1 smallest ids: only those can be in a
result, so copies cost nothing.

Defined cases: a vector that is null, zero or holds a null or non-finite component takes no part; so
does a null id; an empty table gives an empty result; rows repeated under one id are one vector (the smallest by components); vectors of
different lengths are never compared; very long vectors are taken whole; fewer candidates than k: all are returned; ties go to the smaller id; other columns
do not matter, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.storage import materialize

K = 20
#: Candidates of a cell at most, and at least where there are tasks enough.
BLOCK, SMALL_BLOCK = 131_072, 8_192
QUERY_BLOCK = 8_192
TILE_QUERIES = 512
TILE_ROWS = 4_096
#: Steps of the second level in one of the first.
FINE = 254
#: A tile is multiplied whole at the second level where more than one pair in so many is left.
DENSE = 16
#: Buckets in which a query's best lower bounds are found first.
FLOOR_BUCKETS = 64
#: Rounding of bounds, norms and products, relative to the product of the norms.
SLACK = 1e-9


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, scales, and the norms of what the rows stand for and of what they miss."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1
    q = np.rint(x / scale[:, None]).clip(-127, 127)
    stands = q * scale[:, None]
    return q.astype(np.int8), scale, np.linalg.norm(stands, axis=1), np.linalg.norm(x - stands, axis=1)


def refine(x: np.ndarray, code: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows of what the first level misses, in steps of ``scale / FINE``, and the norms of what both levels stand for and miss."""
    step = scale[:, None] / FINE
    fine = np.rint((x - code * scale[:, None]) / np.where(step == 0, 1, step)).clip(-127, 127)
    both = (code.astype(np.float64) * FINE + fine) * step
    return fine.astype(np.int8), np.linalg.norm(both, axis=1), np.linalg.norm(x - both, axis=1)


def coded(x: np.ndarray) -> dict[str, object]:
    """The columns ``code, fine (int8 bytes), scale, stands, miss, stands2, miss2`` for rows of equal length."""
    code, scale, stands, miss = quantise(x)
    fine, stands2, miss2 = refine(x, code, scale)
    return {"code": [c.tobytes() for c in code], "fine": [c.tobytes() for c in fine], "scale": scale, "stands": stands, "miss": miss, "stands2": stands2, "miss2": miss2}


def quantised(rows: DataFrame) -> DataFrame:
    """``vec_id, dim, same`` and the columns of ``coded`` for ``vec_id, v``; ``same`` names equal vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, own in pdf.groupby("dim", sort=False):
                yield pd.DataFrame({"vec_id": own["vec_id"], "dim": dim, "same": own["same"], **coded(np.stack(own["v"].to_list()))})

    same = F.concat(F.hex(F.xxhash64("v")), F.hex(F.xxhash64(F.lit(1), "v")))
    return rows.select("vec_id", "v", F.size("v").alias("dim"), same.alias("same")).mapInPandas(run, "vec_id long, dim int, same string, code binary, fine binary, scale double, stands double, miss double, stands2 double, miss2 double")


def _collapse(rows: pd.DataFrame, keep: int) -> tuple[pd.DataFrame, list[np.ndarray]]:
    """One row per distinct vector, and the ``keep`` smallest ids of each."""
    order = rows.sort_values(["same", "vec_id"])
    head = (order["same"] != order["same"].shift()).to_numpy()
    cuts = [*np.flatnonzero(head).tolist(), len(order)]
    ids = order["vec_id"].to_numpy()
    return order[head], [ids[a : min(a + keep, b)] for a, b in zip(cuts[:-1], cuts[1:])]


def surviving(cand: pd.DataFrame, query: pd.DataFrame, k: int = K) -> pd.DataFrame:
    """``query_id, vec_id, low, high``: the pairs of a cell that may be among the k best of their query, with their bounds."""
    none = pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("query_id", "int64"), ("vec_id", "int64"), ("low", "float64"), ("high", "float64"))})
    if not len(cand) or not len(query):
        return none
    uniq, members = _collapse(cand, k + 1)
    own, askers = _collapse(query, len(query))
    kind = np.float32 if len(uniq["code"].iat[0]) <= 1000 else np.float64

    def codes(rows: pd.DataFrame, column: str) -> np.ndarray:
        return np.frombuffer(b"".join(rows[column]), np.int8).reshape(len(rows), -1)

    def numbers(rows: pd.DataFrame) -> list[np.ndarray]:
        return [rows[c].to_numpy() for c in ("scale", "stands", "miss", "stands2", "miss2")]

    def bounds(mid: np.ndarray, qn: np.ndarray, qe: np.ndarray, cn: np.ndarray, ce: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        error = qe * cn + (qn + qe) * ce + SLACK * (qn + qe) * (cn + ce)
        # beyond the range of doubles a bound says nothing
        return np.nan_to_num(mid - error, nan=-np.inf, neginf=-np.inf, posinf=np.inf), np.nan_to_num(mid + error, nan=np.inf, neginf=-np.inf, posinf=np.inf)

    c8, f8, (cs, cn, ce, cn2, ce2) = codes(uniq, "code"), codes(uniq, "fine"), numbers(uniq)
    q8, g8, (qs, qn, qe, qn2, qe2) = codes(own, "code"), codes(own, "fine"), numbers(own)
    wide = k + 1  # one more: the query's own id may be among them
    out: list[pd.DataFrame] = []
    for a in range(0, len(own), TILE_QUERIES):
        qa = slice(a, min(a + TILE_QUERIES, len(own)))
        left, n = q8[qa].astype(kind), qa.stop - a
        left2 = q8[qa].astype(np.float64) * FINE + g8[qa]
        floor = np.full(n, -np.inf)
        best = np.empty((n, 0))
        kept: list[tuple[np.ndarray, ...]] = []

        def raise_floor(low: np.ndarray, best: np.ndarray) -> np.ndarray:
            best = np.concatenate([best, low if low.shape[1] <= wide else np.partition(low, low.shape[1] - wide, axis=1)[:, -wide:]], axis=1)
            return best if best.shape[1] <= wide else np.partition(best, best.shape[1] - wide, axis=1)[:, -wide:]

        for b in range(0, len(uniq), TILE_ROWS):
            cb = slice(b, min(b + TILE_ROWS, len(uniq)))
            mid = (left @ c8[cb].astype(kind).T).astype(np.float64)
            mid *= qs[qa][:, None] * cs[cb][None, :]
            low, high = bounds(mid, qn[qa][:, None], qe[qa][:, None], cn[cb], ce[cb])
            first = raise_floor(low, best)
            may = high >= (np.maximum(floor, first.min(axis=1)) if first.shape[1] == wide else floor)[:, None]
            at_q, at_c = np.nonzero(may)
            if not len(at_q):
                continue
            # the second level, for the pairs that are left; sums stay below 2**53
            right2 = c8[cb].astype(np.float64) * FINE + f8[cb]
            if len(at_q) * DENSE > may.size:
                sums = (left2 @ right2.T)[at_q, at_c]
            else:
                sums = np.concatenate([np.einsum("ij,ij->i", left2[at_q[i : i + TILE_ROWS]], right2[at_c[i : i + TILE_ROWS]]) for i in range(0, len(at_q), TILE_ROWS)])
            low, high = bounds(sums * ((qs[qa] / FINE)[at_q] * (cs[cb] / FINE)[at_c]), qn2[qa][at_q], qe2[qa][at_q], cn2[cb][at_c], ce2[cb][at_c])
            # pairs come by query: side by side, they are a narrow table of lower bounds
            each = np.bincount(at_q, minlength=n)
            lows = np.full((n, each.max()), -np.inf)
            lows[at_q, np.arange(len(at_q)) - np.repeat(np.cumsum(each) - each, each)] = low
            best = raise_floor(lows, best)
            if best.shape[1] == wide:
                floor = best.min(axis=1)
            stay = high >= floor[at_q]
            kept.append((at_q[stay], at_c[stay] + b, low[stay], high[stay]))
        at_q, at_c, low, high = (np.concatenate(x) for x in zip(*kept)) if kept else (np.empty(0, np.int64),) * 4
        last = high >= floor[at_q]
        for i, j, lo, hi in zip(at_q[last].tolist(), at_c[last].tolist(), low[last].tolist(), high[last].tolist()):
            out.append((askers[a + i], members[j], lo, hi))
    if not out:
        return none
    size = np.array([len(q) * len(m) for q, m, _, _ in out])
    ids = np.concatenate([np.stack(np.meshgrid(q, m, indexing="ij"), -1).reshape(-1, 2) for q, m, _, _ in out])
    pairs = pd.DataFrame({"query_id": ids[:, 0], "vec_id": ids[:, 1], "low": np.repeat([x[2] for x in out], size), "high": np.repeat([x[3] for x in out], size)})
    return pairs[pairs["query_id"] != pairs["vec_id"]]


def vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v (array<double>)``: the rows that take part, one per id."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x)), F.lit(False)) & F.exists(v, lambda x: x != 0)
    return table.where(sound & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("vec_id")).agg(F.min(v).alias("v"))


def nearest(table: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of largest inner product for each row where ``is_query``.

    ``is_query`` is a condition on the column ``vec_id``.
    """
    spark = table.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = materialize(vectors(table, id_col, vector_col))
    codes = materialize(quantised(rows))
    sizes = codes.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    q_blocks = sizes["q"] // QUERY_BLOCK + 1
    c_blocks = max(sizes["n"] // block + 1, min(parts, sizes["n"] // min(block, SMALL_BLOCK) + 1))

    def dealt(of: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        at = F.pmod(F.xxhash64("vec_id"), F.lit(n_own)).cast("int").alias(own)
        return of.select("*", at, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))

    cells = dealt(codes, "cb", c_blocks, "qb", q_blocks).groupBy("dim", "qb", "cb").cogroup(dealt(codes.where(is_query), "qb", q_blocks, "cb", c_blocks).groupBy("dim", "qb", "cb"))

    def cell(cand: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        return surviving(cand, query, k)

    pairs = materialize(cells.applyInPandas(cell, "query_id long, vec_id long, low double, high double"))
    # the k-th best lower bound over all cells; a query's own id is no pair any more. However many cells there are, a query's second window has k rows a bucket
    bucket = F.pmod(F.xxhash64("vec_id"), F.lit(FLOOR_BUCKETS)).alias("bucket")
    few = pairs.select("query_id", "low", bucket).withColumn("n", F.row_number().over(Window.partitionBy("query_id", "bucket").orderBy(F.desc("low")))).where(F.col("n") <= k)
    kth = few.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("low")))).where(F.col("n") == k).select("query_id", F.col("low").alias("floor"))
    left = materialize(pairs.join(kth, "query_id", "left").where("floor is null or high >= floor").select("query_id", "vec_id"))
    sides = left.join(rows.select("vec_id", F.col("v").alias("c")), "vec_id").join(rows.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    product = F.aggregate(F.zip_with("q", "c", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    scored = sides.select("query_id", "vec_id", product.alias("score"))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by query: one heap at a time."""
        now, heap, out = None, [], []

        def close() -> None:
            for rank, (score, neg) in enumerate(sorted(heap, reverse=True), 1):
                out.append((now, rank, -neg, score))

        for pdf in batches:
            for query, vec, score in zip(pdf["query_id"].tolist(), pdf["vec_id"].tolist(), pdf["score"].tolist()):
                if query != now:
                    if now is not None:
                        close()
                    now, heap = query, []
                if len(heap) < k:
                    heapq.heappush(heap, (score, -vec))
                elif (score, -vec) > heap[0]:
                    heapq.heapreplace(heap, (score, -vec))
            if out:
                yield pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])
                out = []
        if now is not None:
            close()
            yield pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])

    return scored.repartition(parts, "query_id").sortWithinPartitions("query_id").mapInPandas(merge, "query_id long, rank int, vec_id long, score double")


def op1_ann_blocks(embeddings: DataFrame) -> DataFrame:
    """The 20 nearest of every row whose id is divisible by 20, against all rows."""
    return nearest(embeddings, F.col("vec_id") % 20 == 0)


def oracle_sql(k: int = K) -> str:
    """All pairs in DuckDB SQL, products summed in the order of the components."""
    return f"""
WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
v AS (SELECT vec_id, min(v) AS v FROM s WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0 GROUP BY vec_id),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]), lambda a, b: a + b) AS score
      FROM v q JOIN v c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p QUALIFY rank <= {k}
"""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.operators import packing


def fold(rows, target, output_limit, ratio=1.65, floor=0.85, correct=1.12, most=packing.BLOCK):
    """Next fit in order: rows ``tokens, source, overhead, starts, {term: tokens}`` of one book. Gives (batch, estimate) for each."""
    def estimate(t):
        return math.ceil((t + 128) * correct) + 64

    def size(a, b):
        terms = {}
        for r in rows[a:b]:
            terms.update(r[4])
        return sum(r[0] for r in rows[a:b]) + sum(terms.values())

    def fits(a, b):
        return b - a <= most and estimate(size(a, b)) <= target and math.ceil(sum(r[1] for r in rows[a:b]) * ratio) + sum(r[2] for r in rows[a:b]) + 2048 <= output_limit * 0.9

    out, at, no = [], 0, 0
    while at < len(rows):
        end = at + 1
        while end < len(rows) and fits(at, end + 1):
            end += 1
        if end < len(rows) and end - at < most:
            border = max((k for k in range(at + 1, end + 1) if rows[k][3]), default=None)
            if border and estimate(size(at, border)) >= target * floor:
                end = border
        out += [(no, estimate(size(at, end)))] * (end - at)
        at, no = end, no + 1
    return out


def book(rng, n, hard=False):
    words = [(f"t{k}", rng.randint(5, 60)) for k in range(12)]
    return [(rng.choice([1, 5, 20, 20, 40, 90] + [900] * hard), rng.choice([3, 10, 30]), rng.randint(0, 9), k == 0 or rng.random() < 0.2, dict(rng.sample(words, rng.choice([0, 0, 1, 3])))) for k in range(n)]


@pytest.mark.parametrize("block", [8, 64, 4096])
def test_equals_a_fold(spark, block):
    rng = random.Random(block)
    books = {"a": book(rng, 500, True), "b": book(rng, block), "c": book(rng, 2 * block + 1 if block < 4096 else 30), "d": book(rng, 1), None: book(rng, 200)}
    rows = [(name, 3 * k, *r[:4], [(t, n) for t, n in r[4].items()]) for name, own in books.items() for k, r in enumerate(own)]
    rng.shuffle(rows)
    units = spark.createDataFrame(rows, "book string, unit_ord long, tokens long, source_tokens long, overhead_tokens long, starts_paragraph boolean, terms array<struct<term:string,tokens:bigint>>")
    for target, limit in ((800, 65_536), (3_000, 3_500)):
        got = {}
        for r in packing.pack(units, target, limit, block=block).collect():
            got.setdefault(r["book"], []).append((r["unit_ord"], r["batch_no"], r["est_input"]))
        for name, own in books.items():
            assert [x[1:] for x in sorted(got[name])] == fold(own, target, limit, most=block), (name, target)


def test_one_long_book(spark):
    n = 1_000_000
    units = spark.range(n, numPartitions=4).select(F.lit("b").alias("book"), F.col("id").alias("unit_ord"), (F.pmod(F.xxhash64("id"), F.lit(90)) + 1).alias("tokens"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)) == 0).alias("starts_paragraph"))
    got = packing.pack(units, 2_000, 65_536).groupBy("batch_no").agg(F.min("unit_ord").alias("a"), F.max("unit_ord").alias("b"), F.first("est_input").alias("est")).toPandas().sort_values("batch_no")
    own = units.orderBy("unit_ord").toPandas()
    sums = np.r_[0, np.cumsum(own["tokens"].to_numpy() + 12)]
    border = np.maximum.accumulate(np.where(np.r_[own["starts_paragraph"].to_numpy(), True], np.arange(n + 1), -1))
    starts, at = [], 0
    most = next(t for t in range(2_000, 0, -1) if math.ceil((t + 128) * 1.12) + 64 <= 2_000)
    while at < n:  # the fold, with the same sums
        starts.append(at)
        end = max(int(np.searchsorted(sums, sums[at] + most, side="right")) - 1, at + 1)
        cut = int(border[end])
        if end < n and cut > at and math.ceil((sums[cut] - sums[at] + 128) * 1.12) + 64 >= 1_700:
            end = cut
        at = end
    assert got["a"].tolist() == starts and got["batch_no"].tolist() == list(range(len(starts)))
    assert got["b"].tolist() == [*(s - 1 for s in starts[1:]), n - 1]


def test_paragraph_marks_look_over_blocks(spark):
    rows = [("b", i, "d", f"k{i // 3}", f"u{i}", f"u{i}") for i in range(40)] + [(None, i, f"d{i // 7}", None, f"u{i}", f"s{i // 2}") for i in range(40)]
    df = spark.createDataFrame(rows, "book string, unit_ord long, document string, block_key string, unit_id string, run_stem string").repartition(3)
    want = {(b, i): i % 3 == 0 if b else i % 7 == 0 or i % 2 == 0 for b, i, *_ in rows}
    for block in (1, 6, 4096):
        assert {(r["book"], r["unit_ord"]): r["starts_paragraph"] for r in packing.paragraph_marks(df, block).collect()} == want


def test_empty_table(spark):
    units = spark.createDataFrame([], "book string, unit_ord long, tokens long, starts_paragraph boolean")
    assert packing.pack(units, 800, 16_000).collect() == []

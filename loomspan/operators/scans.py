"""Ordered recurrences as associative scans.

A step ``x -> clamp(slope * x + offset, low, high)`` with ``slope >= 0`` is a map of four numbers, and so is any chain of such steps. Maps
compose in any grouping: rows are range-partitioned in order, each range is composed for itself, the ranges' maps (as many rows as
ranges) are chained, and every range is run again from what comes in. A step of slope 0 forgets all before it: it begins a new
chain, so one group of any length lies in as many ranges as it fills, and no window is partitioned by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators.ranges import range_count
from loomspan.storage import materialize

STEP = ["_slope", "_offset", "_low", "_high"]


def composed(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Maps (rows: slope, offset, low, high; one column each) of ``first``, followed by ``then``."""
    (a, b, lo, hi), (c, d, lo2, hi2) = first, then
    return np.stack([a * c, c * b + d, np.clip(c * lo + d, lo2, hi2), np.clip(c * hi + d, lo2, hi2)])


def running(maps: np.ndarray) -> np.ndarray:
    """For each column, the composition of it and all columns before it: spans of 1, 2, 4, ... are joined."""
    out, span = maps.copy(), 1
    while span < out.shape[1]:
        out[:, span:] = composed(out[:, :-span], out[:, span:])
        span *= 2
    return out


def applied(maps: np.ndarray, x: float) -> np.ndarray:
    return np.clip(maps[0] * x + maps[1], maps[2], maps[3])


def _maps(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.float64) for c in STEP])


def clamped_scan(rows: DataFrame, order: list[Column], name: str, start: float = 0.0) -> DataFrame:
    """``rows`` without their columns ``_slope, _offset, _low, _high``, plus ``name``: the value after each row's step, in ``order`` over the
    whole table. ``start`` is the value before the first row."""
    own = materialize(rows.repartitionByRange(range_count(rows), *order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, None
        for batch in batches:
            ranges = batch.column(0).to_numpy()
            maps = _maps(batch)
            cuts = [0, *(np.flatnonzero(ranges[1:] != ranges[:-1]) + 1).tolist(), len(ranges)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                last = running(maps[:, a:b])[:, -1:]
                if ranges[a] == number:
                    held = composed(held, last)
                    continue
                if held is not None:
                    yield _one(number, held)
                number, held = int(ranges[a]), last
        if held is not None:
            yield _one(number, held)

    def _one(number: int, held: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array([number], pa.int32()), *[pa.array(x) for x in held]], ["_range", *STEP])

    # one row per range comes to the driver
    sorted_rows = own.select("_range", *STEP, F.struct(*order).alias("_at")).repartition("_range").sortWithinPartitions("_range", "_at")
    maps = sorted_rows.select("_range", *STEP).mapInArrow(whole, "_range int, _slope double, _offset double, _low double, _high double").orderBy("_range").collect()
    begins, value = {}, start
    for m in maps:
        begins[m["_range"]] = value
        value = float(applied(np.array([[m[c]] for c in STEP]), value)[0])

    kept = [c for c in rows.columns if c not in STEP]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, now = None, start
        for batch in batches:
            ranges, maps = batch.column(batch.schema.get_field_index("_range")).to_numpy(), _maps(batch)
            values = np.empty(len(ranges))
            cuts = [0, *(np.flatnonzero(ranges[1:] != ranges[:-1]) + 1).tolist(), len(ranges)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if ranges[a] != number:
                    number, now = ranges[a], begins[int(ranges[a])]
                values[a:b] = applied(running(maps[:, a:b]), now)
                now = values[b - 1]
            yield pa.record_batch([*[batch.column(batch.schema.get_field_index(c)) for c in kept], pa.array(values)], [*kept, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept) + f", `{name}` double"
    ready = own.withColumn("_at", F.struct(*order)).repartition("_range").sortWithinPartitions("_range", "_at").drop("_at")
    return ready.mapInArrow(run, schema)

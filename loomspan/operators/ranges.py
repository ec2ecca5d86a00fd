"""Order over a whole table without a task that holds it: distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.storage import materialize


def range_count(rows: DataFrame) -> int:
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def prefix_sums(rows: DataFrame, order: list[Column], sums: dict[str, str], within: list[str] | None = None) -> DataFrame:
    """``rows`` plus, for each ``column: name`` of ``sums``, the sum of the column over all rows before in ``order``.

    Rows are range-partitioned by ``order`` and numbered by range; each range is summed for itself, the sums of
    ranges are scanned into offsets (as many rows as ranges), and both are added. ``within`` (columns without nulls, first in the order) starts
    the sums anew for each group; a group of any size lies in as many ranges as it fills. Rows that are equal in ``order`` share a range.
    """
    within = within or []
    own = materialize(rows.repartitionByRange(range_count(rows), *order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = own.groupBy("_range", *within).agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
    offsets = totals.select("_range", *within, *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_from_{c}") for c in sums])
    inside = Window.partitionBy("_range", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = own.join(offsets, ["_range", *within])
    named = placed.withColumns({name: F.col(f"_from_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c, name in sums.items()})
    return named.drop("_range", *[f"_from_{c}" for c in sums])


def parted(column: str) -> tuple[Column, Column]:
    """``_none, _name``: a nullable text column as two without nulls, in the same order with null last."""
    return F.col(column).isNull().alias("_none"), F.coalesce(F.col(column), F.lit("")).alias("_name")

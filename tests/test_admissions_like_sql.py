"""w4_admissions against its SQL on events with what the given tables lack: ties, negative values, nulls, scopes longer than a batch."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from loomspan.plans.registry import ORACLES, QUERIES
from loomspan.streaming import ledger as live


def _events(spark, path, values, nulls):
    rng = random.Random(7)
    none = lambda share, x: None if nulls and rng.random() < share else x
    rows = [(i, none(0.02, 100 * rng.randrange(8_000)), none(0.02, rng.randrange(12)), none(0.1, rng.choice(values))) for i in range(600)]
    given = spark.createDataFrame(rows, "event_id long, s long, user_id long, value double")
    given.select("event_id", (F.timestamp_seconds(1_704_067_200 + F.col("s"))).cast("timestamp_ntz").alias("ts"), "user_id", F.lit("view").alias("event_type"), "value", F.lit("{}").alias("props")).coalesce(1).write.parquet(f"{path}/events.parquet")


@pytest.mark.parametrize("values, nulls", [((0.0, 0.5, 20.0, 50.0, 100.0, 100.01), False), ((-60.0, -3.0, 20.0, 50.0, 100.0, 100.01), False), ((-60.0, 0.0, 35.5, 100.0, 100.01), True)])
def test_replay_like_its_sql(spark, tmp_path, values, nulls):
    _events(spark, tmp_path, values, nulls)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    columns = ["scope", "at", "tokens", "admitted", "waited"]
    want = con.sql(f'SELECT scope, "at", tokens, admitted, waited FROM ({ORACLES["w4_admissions"]})').fetchall()
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = QUERIES["w4_admissions"](spark, str(tmp_path)).select(columns).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert len(want) > 550 and sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_sums_that_fall_again():
    own = live.Minute(9, 100)
    assert [own.admit(at, n) for at, n in ((0, 90), (1, -85), (2, 85), (3, 20))] == [0, 1, 2, 60]

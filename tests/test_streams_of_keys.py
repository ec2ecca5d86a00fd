import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from loomspan.operators import ledger
from loomspan.streaming import keys

NOW = datetime(2024, 5, 1, 12, tzinfo=timezone.utc)
EVENTS = "scope string, event_id long, at double, kind string, key string, tokens long, until double"


@pytest.fixture
def several_states(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_a_pool_hands_over():
    pool = keys.Pool(["a", "b"], 2, 100, 3)
    assert [pool.admit(0, 0, 10) for _ in range(3)] == [("a", 0), ("b", 0), ("a", 0)]
    pool.told("cooling", "b", 0, 500.0)
    assert pool.admit(1, 0, 10) == ("a", 60)  # b cools; a has two in its minute
    assert pool.admit(70, 0, 10) == ("b", 500)  # a is used up for the day: b, when it has cooled
    pool.told("refused", "b", 0, None)
    assert pool.admit(600, 0, 10) == (None, keys.NEVER) and pool.admit(90_000, 86_400, 10)[0] in ("a", "b")
    assert pool.admit(90_001, 86_400, 101) == (None, keys.NEVER)


def test_stream_of_keys_equals_the_replay(spark, tmp_path, several_states):
    rng, start, rows, at = random.Random(4), NOW.timestamp(), [], NOW.timestamp()
    for i in range(160):
        at += rng.choice([0.5, 3.0, 20.0, 45.0])
        kind = rng.choice(["request"] * 8 + ["cooling", "refused"])
        rows.append((rng.choice("pq"), i, at, kind, rng.choice("abc") if kind != "request" else None, rng.choice([10, 40, 90, 200]), at + rng.choice([5.0, 90.0]) if kind == "cooling" else None))
    rows += [("end", 1_000, start + 400_000, "request", None, 1, None), ("end", 1_001, start + 800_000, "request", None, 1, None)]
    df = spark.createDataFrame(rows, EVENTS)
    for k in range(0, len(rows), 54):  # three micro-batches and two that only move the watermark
        spark.createDataFrame(rows[k : k + 54], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = keys.grants(stream, ["a", "b", "c"], 3, 200, 12).writeStream.outputMode("append").format("memory").queryName("granted").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    key = lambda found: sorted((r["scope"], r["event_id"], r["key"] or "", round(r["admitted"], 3)) for r in found)
    want = key(keys.grants_replay(df, ["a", "b", "c"], 3, 200, 12).collect())
    assert key(spark.table("granted").collect()) == want and len({k for _, _, k, _ in want}) == 4
    left = spark.read.format("statestore").option("stateVarName", "minute").option("path", str(tmp_path / "c")).load()
    assert {r["scope"] for r in left.select("key.scope").collect()} <= {"end"}  # p and q are gone after the retention


def test_late_corrections(spark, tmp_path):
    def at(minutes):
        return NOW + timedelta(minutes=minutes)

    sent = "request_id long, scope string, sent timestamp, tokens long"
    told = "request_id long, version long, told timestamp, tokens long"
    batches = [
        ([(i, "s", at(i), 100 + i) for i in range(6)] + [(2, "s", at(2), 102)], [(0, 1, at(1), 7), (1, 1, at(2), 8), (1, 2, at(3), 9)]),
        ([(2, "s", at(2), 102), (6, "s", at(30), 106)], [(1, 2, at(3), 9), (3, 1, at(20), 11), (4, 1, at(30), 12)]),
        ([(7, "s", at(600), 107)], [(7, 1, at(600), 13)]),
        ([(8, "s", at(1200), 108)], [(5, 1, at(9), 99), (8, 1, at(1200), 14)]),  # a number for 5 that comes behind the watermark
        ([(9, "s", at(1800), 109)], [(9, 1, at(1800), 15)]),
    ]
    for a, b in batches:
        spark.createDataFrame(a, sent).coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
        spark.createDataFrame(b, told).coalesce(1).write.mode("append").parquet(str(tmp_path / "m"))
    read = lambda schema, at: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / at))
    q = keys.corrected_stream(read(sent, "r"), read(told, "m")).writeStream.outputMode("append").format("memory").queryName("corrections").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        late = keys.late_rows(q)
    finally:
        q.stop()
    got = sorted((r["request_id"], r["tokens"]) for r in spark.table("corrections").collect())
    whole = spark.createDataFrame([r for a, _ in batches for r in a], sent).distinct()
    in_time = spark.createDataFrame([r for _, b in batches for r in b if r[0] != 5], told)
    want = sorted((r["request_id"], r["tokens"]) for r in ledger.corrected(whole, in_time).collect())
    assert got == [w for w in want if w[0] < 9] and late == 1  # 9 waits for the watermark

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from loomspan.operators import ledger
from loomspan.streaming import ledger as live

NOW = datetime(2024, 5, 1, 12, tzinfo=timezone.utc)


def requests(spark, rows):
    data = [(i, s, NOW + timedelta(seconds=at), n) for i, (s, at, n) in enumerate(rows)]
    return spark.createDataFrame(data, "request_id long, scope string, sent timestamp, tokens long")


def test_window_is_open_on_the_left(spark):
    df = requests(spark, [("a", 0, 1), ("a", 30, 2), ("a", 60, 4), ("b", 60, 8)])
    got = [(r["window_requests"], r["window_tokens"]) for r in ledger.rolling_usage(df).orderBy("request_id").collect()]
    assert got == [(1, 1), (2, 3), (2, 6), (1, 8)]
    assert {r["scope"]: r["requests"] for r in ledger.usage_at(df, "2024-05-01 12:01:00").collect()} == {"a": 2, "b": 1}


def test_waits(spark):
    df = requests(spark, [("a", 0, 50), ("a", 10, 40), ("a", 20, 30), ("a", 100, 10)])
    assert [r["wait"] for r in ledger.rpm_waits(df, 2).orderBy("request_id").collect()] == [0, 0, 40, 0]
    assert [r["wait"] for r in ledger.tpm_waits(df, 100, 100).orderBy("request_id").collect()] == [0, 0, 40, 0]


def test_days_corrections_keys(spark):
    df = requests(spark, [("a", 0, 1), ("a", -86400, 1), ("b", 5, 1)])
    daily = ledger.daily_usage(df)
    assert sorted((r["scope"], r["used"]) for r in daily.collect()) == [("a", 1), ("a", 1), ("b", 1)]
    stated = daily.where("scope = 'b'").selectExpr("scope", "day_start", "6 as offset")
    assert ledger.adjusted_usage(daily, stated).where("scope = 'b'").first()["used"] == 7
    keys = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "key_no long, scope string")
    used = spark.createDataFrame([("a", 5), ("b", 1)], "scope string, used long")
    assert [ledger.next_key(keys, used, 5, k).first()["scope"] for k in (0, 1, 2)] == ["b", "b", "c"]
    assert ledger.next_key(keys, used, 0, 0).first()["scope"] is None and ledger.keys_available(keys, used, 5).first()["available"] == 2


def test_token_waits_like_a_scan(spark):
    rng = random.Random(7)
    rows = [(rng.choice("ab"), rng.choice([0, 0.5, 1]) * rng.randint(0, 400), rng.choice([0, 5, 20, 60, 130])) for _ in range(300)]
    df = requests(spark, rows)
    sent = sorted((s, at, i, n) for i, (s, at, n) in enumerate(rows))
    want = {}
    for s, at, i, n in sent:
        past = [(t, m) for r, t, j, m in sent if r == s and at - 60 < t and (t, j) < (at, i)]
        soft, total, wait = min(120, max(n, int(100 + min(2.0, n * 0.05)))), sum(m for _, m in past), 0
        for t, m in past:
            if total + n <= soft:
                break
            total, wait = total - m, t + 60 - at
        want[i] = max(0, wait)
    got = {r["request_id"]: r["wait"] for r in ledger.tpm_waits(df, 100, 120).collect()}
    assert got == pytest.approx(want)


def test_admissions_keep_both_limits():
    own = live.Minute(2, 100)
    assert own.admit(0, 60) == 0 and own.admit(1, 30) == 1
    assert own.admit(2, 20) == 60 and own.admit(2, 101) == float("inf")
    rng = random.Random(3)
    own, out, at = live.Minute(5, 100), [], 0.0
    for _ in range(400):
        at += rng.choice([0, 1, 4, 30])
        n = rng.choice([1, 10, 40, 90])
        out.append((own.admit(at, n), n, at))
    for when, n, at in out:
        assert when >= at
        inside = [m for t, m, _ in out if when - 60 < t <= when]
        assert len(inside) <= 5 and sum(inside) <= 100


def test_controller(spark):
    def end(events, **more):
        rows = [("s", i, *e, *([None] * (6 - len(e)))) for i, e in enumerate(events)]
        df = spark.createDataFrame(rows, "scope string, at long, event string, kind string, source long, output long, overhead long, size long")
        r = live.controller_replay(df, **{"ceiling_tpm": 1000, "ceiling_rpm": 10, "ceiling_workers": 4, "batch": 2000, "max_batch": 4000, **more}).first()
        return (r["tpm"], r["rpm"], r["workers"], r["batch"]), r["ratio"]

    good = ("success", None, 100, 300, 0, 2000)
    assert end([("quota", "tpm")]) == ((900, 10, 4, 2000), pytest.approx(1.65))
    assert end([("quota", "tpm"), ("quota",)])[0] == (810, 8, 3, 2000)
    state, ratio = end([("quota", "tpm"), ("quota",)] + [good] * 20)
    assert state == (843, 9, 4, 4000) and ratio == pytest.approx(3.3)
    assert end([("quota", "daily"), ("invalid",)])[0] == (1000, 10, 4, 1800)
    # without tuning errors of quota still count, and what they took comes back; batches and free limits rest
    assert end([("invalid",)] + [good] * 30, auto_tune=False)[0] == (1000, 10, 4, 2000)
    assert end([("quota", "rpm")] + [good] * 20, auto_tune=False)[0] == (1000, 9, 4, 2000)
    low = ("success", None, 100, 100, 0, 0)
    assert end([good] + [low] * 5)[1] == pytest.approx(3.3 * 0.98**5) and end([low])[1] == pytest.approx(1.65 * 0.98)


def test_calibration(spark):
    rows = spark.createDataFrame([(1.0, 100, 150), (1.0, 100, 50), (1.0, 0, 5000)], "factor double, estimated long, actual long")
    got = [r[0] for r in rows.select(live.calibrated(F.col("factor"), F.col("estimated"), F.col("actual"))).collect()]
    assert got == pytest.approx([1.5, 0.95, 10.0])


def test_calibration_is_a_scan(spark, monkeypatch):
    from loomspan.operators import scans

    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.choice([0, 100, 300]), rng.choice([None, 0, -5, 20, 90, 150, 9_000])) for i in range(1_500)]

    def fold(saved):
        out, state = {}, {k: (v, 1) for k, v in saved.items()}
        for scope, at, raw, actual in rows:
            factor, n = state.get(scope, (1.0, 0))
            if actual and actual > 0 and raw > 0:
                r = actual / raw
                factor, n = max(0.1, min(10.0, r if not n else max(r, factor * 0.9 + r * 0.1))), n + 1
            state[scope] = factor, n
            out[at] = factor
        return out

    df = spark.createDataFrame(rows, "scope string, at long, raw long, actual long").repartition(3)
    saved = spark.createDataFrame([("hot", 4.0)], "scope string, factor double")
    for ranges in (1, 5, 60):
        monkeypatch.setattr(scans, "range_count", lambda _, n=ranges: n)
        got = ledger.calibration(df)
        assert got.columns == [*df.columns, "factor"]
        assert {r["at"]: r["factor"] for r in got.collect()} == pytest.approx(fold({}))
    assert {r["at"]: r["factor"] for r in ledger.calibration(df, saved).collect()} == pytest.approx(fold({"hot": 4.0}))
    assert ledger.calibration(df.limit(0)).count() == 0


def test_minutes_of_one_scope_stand_apart(spark):
    rng = random.Random(9)
    rows, at = [], 0
    for i in range(600):
        at += rng.choice([0, 0, 1, 7, 20, 59, 60, 61, 200])
        rows.append(("s", at, rng.choice([1, 40, 300, 900, 1500])))
    df = requests(spark, rows)
    times = [r[1] for r in rows]
    rolling = {r["request_id"]: (r["window_requests"], r["window_tokens"]) for r in ledger.rolling_usage(df).collect()}
    rpm = {r["request_id"]: r["wait"] for r in ledger.rpm_waits(df, 3).collect()}
    tpm = {r["request_id"]: r["wait"] for r in ledger.tpm_waits(df, 1_000, 1_200).collect()}
    spent = {r["request_id"]: (r["spent"], r["paused"]) for r in ledger.budget_stop(df, 50_000).collect()}
    for i, (_, at, n) in enumerate(rows):
        inside = [k for k in range(len(rows)) if at - 60 < times[k] <= at]
        assert rolling[i] == (len(inside), sum(rows[k][2] for k in inside))
        assert rpm[i] == (max(0.0, times[i - 3] + 60 - at) if i >= 3 else 0.0)
        before = [k for k in range(i) if times[k] > at - 60]
        soft = min(1_200, max(n, int(1_000 + min(20.0, n * 0.05))))
        wait, held = 0.0, sum(rows[k][2] for k in before)
        for k in before:
            if held + n <= soft:
                break
            held -= rows[k][2]
            wait = max(0.0, times[k] + 60 - at)
        assert tpm[i] == pytest.approx(wait), i
        before = sum(r[2] for r in rows[:i])
        assert spent[i] == (before, before + n > 50_000)


def test_stream_counts_like_the_table(spark, tmp_path):
    df = requests(spark, [("a", i * 7, i) for i in range(30)] + [("b", i * 90, 1) for i in range(5)])
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.minute_usage(stream).writeStream.outputMode("update").format("memory").queryName("minutes").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["w"], r["scope"]): r["n"] for r in spark.sql("select window.start as w, scope, max(requests) as n from minutes group by all").collect()}
    want = {(r["w"], r["scope"]): r["n"] for r in df.groupBy(F.window("sent", "1 minute")["start"].alias("w"), "scope").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_stateful_admissions_like_the_replay(spark, tmp_path):
    df = spark.createDataFrame([("a", 1e6 + i, 30) for i in range(6)] + [("b", 1e6, 30)], "scope string, at double, tokens long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = live.admissions(stream, 2, 100).writeStream.outputMode("append").format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda rows: sorted((r["scope"], r["at"], round(r["admitted"], 3)) for r in rows)
    assert key(spark.table("admitted").collect()) == key(live.admission_replay(df, 2, 100).collect())


def test_stored_state_and_keys(spark):
    state = spark.createDataFrame([("m", "local-rpd-limits", '{"gemma": "250", "x": 20}'), ("m", "other", "junk")], "scope string, key string, payload string")
    assert {r["name"]: r["value"] for r in ledger.stored_limits(state, "m").collect()} == {"gemma": 250, "x": 20}
    assert ledger.stored_state(state, "m", "other").where("size(payload) > 0").count() == 0 and ledger.stored_limits(state, "n").count() == 0
    df = requests(spark, [("a", 0, 1), ("a", -86400, 1), ("b", 5, 1)])
    row = ledger.stored_usage(df, "a", "2024-05-01 13:00:00").first()
    assert row["used"] == 1 and str(row["resets"]) == "2024-05-02 07:00:00"
    daily = spark.createDataFrame([("a", 3), ("b", 1)], "scope string, used long")
    assert {r["scope"]: r["used"] for r in ledger.exhausted(daily, "b", 20).collect()} == {"a": 3, "b": 20}
    assert {r["scope"]: r["used"] for r in ledger.exhausted(daily, "c", 20).collect()} == {"a": 3, "b": 1, "c": 20}
    more = df.where("request_id > 1").withColumn("request_id", F.col("request_id") + 1).union(df.where("request_id = 0"))
    assert sorted(r["request_id"] for r in ledger.append(df, more).collect()) == [0, 1, 2, 3]

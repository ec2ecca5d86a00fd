import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspan.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def tokens_by_hand(text):
    total = 0
    for w in re.findall(r"\w+|[^\w\s]", text):
        total += math.ceil(len(w.encode()) / 2) if not w.isascii() else math.ceil(len(w) / 5) if w[0].isalnum() or w[0] == "_" else 1
    return max(1, total + text.count("\n") // 4)


def test_token_estimate(spark):
    texts = ["", "a", "hello world, I am", "naïve café", "漢字 x", "a\n" * 9, "_under score_ 12345678901", "!?"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.text_tokens("t").alias("n"), T.word_count("t").alias("w")).collect()
    assert [r["n"] for r in rows] == [tokens_by_hand(r["t"]) for r in rows]
    assert [r["w"] for r in rows] == [len(re.findall(r"\b\w+(?:['’-]\w+)*\b", r["t"])) for r in rows]


@pytest.mark.parametrize("header, delays, now, want", [("30", None, 0.0, 30), (None, ["5s"], 0.0, 5), ("10", ["25s"], 0.0, 25), ("junk", None, 0.0, 0), (None, None, 0.0, 0), ("Wed, 21 Oct 2015 07:28:00 GMT", None, 1445412470.0, 10)])
def test_retry_after(spark, header, delays, now, want):
    df = spark.createDataFrame([(header, delays, now)], "h string, d array<string>, n double")
    assert df.select(T.retry_after("h", "d", "n")).first()[0] == want


@pytest.mark.parametrize("labels, zero, want", [(["GenerateRequestsPerDay"], False, "daily"), (["x"], True, "zero"), (["input_token_count"], False, "tpm"), (["RequestsPerMinute"], False, "rpm"), ([], False, None)])
def test_quota_kind(spark, labels, zero, want):
    assert spark.createDataFrame([("", labels, zero)], "m string, l array<string>, z boolean").select(T.quota_kind("m", "l", "z")).first()[0] == want


def test_json(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ('{"a": 1, "a": 2}',), ('{"a": NaN}',), ('{"a": ',), (None,)], "x string")
    assert [r[0] is not None for r in rows.select(T.strict_json("x")).collect()] == [True, False, False, False, False]
    assert one(spark, T.unfenced("x"), x='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, T.repaired_json("x"), x='{"a": "he said "no"\nand left"}') == '{"a": "he said \\"no\\"\\nand left"}'


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet='ab\\"\n,:{}[]\t ', max_size=30))
def test_sound_json_stays(text):
    import json

    assert T.close_quotes(json.dumps({"k": text})) in (json.dumps({"k": text}),)


@pytest.mark.parametrize("source, target, want", [("a", " ", "empty"), ("a", None, "empty"), ("a", "b" * 301, "too_long"), ("a" * 161, "b" * 40, "too_short"), ("a", "b\x01", "illegal_character"), ("a", "🙂", None)])
def test_text_fault(spark, source, target, want):
    assert spark.createDataFrame([(source, target)], "s string, t string").select(T.text_fault("s", "t")).first()[0] == want


def test_midnights_follow_daylight_saving(spark):
    from datetime import datetime, timedelta, timezone
    from zoneinfo import ZoneInfo

    zone = ZoneInfo("America/Los_Angeles")
    stamps = [1728700000, 1710064800, 1730624400, 1704067200]
    rows = spark.createDataFrame([(s,) for s in stamps], "s long").withColumn("t", F.timestamp_seconds("s")).select("s", F.unix_timestamp(T.pacific_midnight("t")).alias("a"), F.unix_timestamp(T.pacific_midnight("t", 1)).alias("b")).collect()
    for r in rows:
        day = datetime.fromtimestamp(r["s"], timezone.utc).astimezone(zone).date()
        assert r["a"] == datetime(day.year, day.month, day.day, tzinfo=zone).timestamp()
        nxt = day + timedelta(days=1)
        assert r["b"] == datetime(nxt.year, nxt.month, nxt.day, tzinfo=zone).timestamp()


def test_others(spark):
    assert one(spark, T.similarity("a", "b"), a="wulin", b="wuling") == pytest.approx(10 / 11)
    assert one(spark, T.keep_list("x"), x=" a, b\n\n a ,c") == ["a", "b", "c"]
    assert one(spark, T.known_from("x"), x="bab 2-5") == 2
    assert spark.createDataFrame([(200, "429", "x"), (200, None, "rate limit"), (200, None, "odd"), (500, None, None), (200, None, None)], "s int, c string, m string").select(T.effective_status("s", "c", "m")).toPandas().iloc[:, 0].tolist() == [429, 429, 502, 500, 200]
    assert one(spark, T.adds_markup("a", "b"), a="x", b="<b>x</b>") is True
    assert T.output_driven_target(65_536, 1.65) == int((65_536 * 0.9 - 6144) / 1.65)


def test_matching_ratio_is_the_reference_one():
    import random
    from difflib import SequenceMatcher

    from loomspan.functions.text import matching_ratio

    rng = random.Random(1)
    for letters, most in (("ab", 30), ("abcdefghijklmnopqrstuvwxyzé", 30), ("ab", 420), ("abcdefghij", 420), ("".join(map(chr, range(97, 247))), 420)):
        for _ in range(40):
            a, b = ("".join(rng.choices(letters, k=rng.randint(0, most))) for _ in range(2))
            assert matching_ratio(a, b) == SequenceMatcher(None, a, b).ratio(), (a, b)

"""Steps that several queries share: decoded once, compared in tasks of bounded size."""

from loomspan.operators import cache, matching, responses


def test_coverage_deals_ids_to_as_many_tasks_as_they_fill(spark, monkeypatch):
    monkeypatch.setattr(cache, "TASK_IDS", 10, raising=False)
    runs = spark.createDataFrame([(f"r{i}",) for i in range(50)] + [("r1",), (None,)], "run_id string")
    targets = spark.createDataFrame([(f"r{i}",) for i in range(1, 52)] + [("r2",), (None,)], "run_id string")
    got = cache.coverage(runs, targets)
    assert sorted(map(tuple, got.collect())) == [("missing", "r0"), ("unknown", "r50"), ("unknown", "r51")]
    assert got.rdd.getNumPartitions() == 105 // 10 + 1


def test_answers_are_decoded_once(spark):
    raw = spark.createDataFrame([("a", '{"note": "he said "no"", "data": [{"id": "u", "runs": [{"id": "r", "text": "t"}]}]}')], "batch string, body string")
    expected = spark.createDataFrame([("a", "u", "r", "s"), ("a", "v", "w", "s")], "batch string, unit_id string, run_id string, text string")
    judged = responses.reconciled(expected, responses.decoded(raw))
    assert sorted(map(tuple, judged.select("run_id", "target", "fault").collect())) == [("r", "t", None), ("w", None, "unit_missing")]
    assert "repaired_json" not in judged._jdf.queryExecution().optimizedPlan().toString()


def test_places_of_phrases_are_no_lambdas(spark):
    units = spark.createDataFrame([("u", "The cat, the  cat sat. Cat!"), ("v", ""), ("w", None), ("x", "cat")], "unit_id string, text string")
    known = matching.phrases(spark.createDataFrame([("the cat",), ("cat",), ("sat. cat",), ("gone",)], "term string"))
    found = matching.occurrences(units, known)
    want = [("u", "cat", 1, 2), ("u", "cat", 1, 7), ("u", "cat", 1, 12), ("u", "sat. cat", 4, 9), ("u", "the cat", 3, 0), ("u", "the cat", 3, 5), ("x", "cat", 1, 0)]
    assert sorted(map(tuple, found.collect())) == want
    assert "lambdafunction" not in found._jdf.queryExecution().optimizedPlan().toString()

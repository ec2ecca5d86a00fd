import json
import re

import pytest
from pyspark.sql import functions as F

from loomspan.plans import chapters
from loomspan.sources.store import Store

RUNS = "chapter int, book string, unit_ord long, unit_id string, run_id string, run_ord int, text string, context string"
TEXTS = {1: ["Toto ran", "rain fell", "a dog"], 2: ["Toto slept", "Wu came", "more rain"], 3: ["Toto and Wu", "the end"]}
FOUND = {1: [("Toto", "T1")], 2: [("Wu", "W2"), ("Toto", "late")]}
WANT = {1: ["Toto ran", "rain fell", "a dog"], 2: ["T1 slept", "Wu came", "more rain"], 3: ["T1 and W2", "the end"]}


def texts(spark):
    rows = [(n, "b", 10 * n + i, f"u{n}.{i}", f"r{n}.{i}", 0, t, None) for n, own in TEXTS.items() for i, t in enumerate(own)]
    return spark.createDataFrame(rows, RUNS)


def discover(n, targets):
    assert set(targets.columns) == {"unit_id", "run_id", "text", "target"}
    return targets.sparkSession.createDataFrame(FOUND[n], "term string, translation string") if n in FOUND else None


def counting(spark):
    asked = spark.sparkContext.accumulator(0)

    def call(units, glossary):
        asked.add(sum(len(u["runs"]) for u in units))

        def said(text):
            for term, to in glossary.items():
                text = re.sub(rf"\b{term}\b", to, text)
            return text

        return json.dumps([{"id": u["id"], "runs": [{"id": r["id"], "text": said(r["text"])} for r in u["runs"]]} for u in units])

    return call, asked


def result(job):
    out = {}
    for r in job.targets().collect():
        out.setdefault(r["chapter"], {})[r["unit_id"]] = r["target"]
    return {n: [own[f"u{n}.{i}"] for i in range(len(own))] for n, own in out.items()}


def test_terms_of_a_chapter_change_later_targets(spark, tmp_path):
    call, asked = counting(spark)
    store = Store(spark, str(tmp_path / "s"))
    job = chapters.Chapters(texts(spark), call, store, "j", discover)
    assert job.publish() == [1, 2, 3] and result(job) == WANT and asked.value == 8
    again = chapters.Chapters(texts(spark), call, store, "j", discover)
    assert again.publish() == [] and asked.value == 8 and result(again) == WANT
    # a manual entry wins over the found one, and only units that hold a changed term are asked again
    manual = spark.createDataFrame([(0, "toto", "M"), (1, "rain", "wet")], "ord long, term string, translation string")
    more = chapters.Chapters(texts(spark), call, store, "j", discover, manual)
    assert more.publish() == [1, 2, 3]
    assert result(more) == {1: ["Toto ran", "wet fell", "a dog"], 2: ["Toto slept", "Wu came", "more wet"], 3: ["Toto and W2", "the end"]}
    assert asked.value == 8 + 2 + 2 + 1
    log = {(r["chapter"], r["seq"] > 2): (r["inherited"], r["terms"]) for r in more._log().collect()}
    assert log == {(1, False): (0, 1), (2, False): (0, 2), (3, False): (0, 0), (1, True): (1, 0), (2, True): (1, 0), (3, True): (1, 0)}


def test_a_kill_between_commits_loses_and_doubles_nothing(spark, tmp_path):
    for stop_at in (3, 4):  # one commit a round, one a chapter: within chapter 2
        call, asked = counting(spark)
        store = Store(spark, str(tmp_path / f"s{stop_at}"))
        plain, left = store.commit, [stop_at]

        def commit(group, name, **tables):
            left[0] -= 1
            if left[0] == 0:
                raise KeyboardInterrupt
            return plain(group, name, **tables)

        store.commit = commit
        with pytest.raises(KeyboardInterrupt):
            chapters.Chapters(texts(spark).where("chapter < 3"), call, store, "j", discover).publish()
        before = asked.value
        fresh = chapters.Chapters(texts(spark).where("chapter < 3"), call, Store(spark, store.path), "j", discover)
        fresh.publish()
        assert result(fresh) == {n: WANT[n] for n in (1, 2)}
        lost = len(TEXTS[(stop_at + 1) // 2]) if stop_at % 2 else 0  # only answers of a round that was not committed are asked again
        assert asked.value == 6 + lost and before >= lost
        terms = fresh.store.read("terms", chapters.TERMS, "chapters")
        assert sorted((r["source_chapter"], r["term"]) for r in terms.collect()) == [(1, "Toto"), (2, "Toto"), (2, "Wu")]


def test_chapters_follow_a_stream(spark, tmp_path):
    call, asked = counting(spark)
    job = chapters.Chapters(texts(spark), call, Store(spark, str(tmp_path / "s")), "j", discover)
    heard = str(tmp_path / "in")
    for n in (2, 1, 3):  # a chapter is published after those before it, in whatever order they are announced
        spark.createDataFrame([(n,)], "chapter int").coalesce(1).write.mode("append").parquet(heard)
    stream = spark.readStream.schema("chapter int").option("maxFilesPerTrigger", 1).parquet(heard)
    for _ in range(2):  # the second run finds nothing left
        query = job.follow(stream, str(tmp_path / "c"), availableNow=True)
        query.awaitTermination()
        assert query.exception() is None and result(job) == WANT and asked.value == 8


def test_runs_without_answer_stop_the_book(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))

    def broken(units, glossary):
        return json.dumps([{"id": u["id"], "runs": u["runs"]} for u in units if u["id"] != "u2.1"])

    job = chapters.Chapters(texts(spark).where("chapter < 3"), broken, store, "j", discover)
    with pytest.raises(chapters.Unfinished):
        job.publish()
    assert set(result(job)) == {1}
    call, asked = counting(spark)
    assert chapters.Chapters(texts(spark).where("chapter < 3"), call, store, "j", discover).publish() == [2] and asked.value == 1


def test_a_store_has_whole_commits_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = spark.range(3)
    bad = rows.select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        store.commit("g", "a", one=rows, two=bad)
    assert store.names("g") == [] and store.read("one", "id long", "g").count() == 0
    assert store.commit("g", "a", one=rows) and not store.commit("g", "a", one=rows) and store.commit("g", "b", one=rows)
    assert store.names("g") == ["a", "b"] and store.read("one", "id long", "g").count() == 6 and store.read("one", "id long", "g", "b").count() == 3

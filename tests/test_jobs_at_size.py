"""What whole jobs move and leave behind: texts are dealt once a step, and the tables and shuffle files of a step go with it."""

import os
import time

from pyspark.sql import functions as F

from loomspan.operators import packing, responses
from loomspan.plans import chapters, jobs
from loomspan.storage import materialize, tables_dir

RUNS = "book string, unit_ord struct<doc:long,line:int>, unit_id string, run_id string, run_ord int, text string, context string"


def tables(spark):
    path = tables_dir(spark).removeprefix("file:")
    return set(os.listdir(path)) if os.path.isdir(path) else set()


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def runs(spark, n=12):
    rows = [("a" if i % 2 else None, (i // 4 if i > 3 else None, i % 4), f"u{i}", f"u{i}", 0, f"text number {i}", None) for i in range(n)]
    return spark.createDataFrame(rows, RUNS)


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    own = materialize(spark.range(1000).withColumn("k", F.col("id") % 7).repartition(5, "k"))
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before and own.count() == 1000


def test_a_job_keeps_its_runs_and_answers_only(spark):
    before = tables(spark)
    done, kept = jobs.run_job(runs(spark), jobs.echo, "j", target=700)
    assert len(tables(spark) - before) <= 3  # the runs, the answers of the one round, and what is left to ask: nothing
    assert sorted(map(tuple, done.collect())) == sorted((f"u{i}", f"«text number {i}»") for i in range(12))
    assert kept.count() == 12 and kept.where("length(fingerprint) = 64").count() == 12


def test_published_chapters_keep_their_commits_only(spark):
    own = runs(spark).withColumn("chapter", F.col("unit_ord.line") % 2)
    store = chapters.job_store(spark)
    job = chapters.Chapters(own, lambda units, glossary: jobs.echo(units), store, "j", lambda n, t: None)
    before = tables(spark)
    assert job.publish() == [0, 1] and not tables(spark) - before - {os.path.basename(store.path)}
    assert os.listdir(f"{store.path.removeprefix('file:')}/committed") == ["chapters"]  # rounds go once they are published
    assert sorted((r["run_id"], r["target"]) for r in job.targets().collect()) == sorted((f"u{i}", f"«text number {i}»") for i in range(12))


def test_texts_asked_do_not_travel_to_be_judged(spark):
    expected = spark.createDataFrame([("b", "u", "r", "x" * 400), ("b", None, "s", "x"), (None, "v", "t", "x"), ("b", "u", None, "x"), ("b", "u", "r", "x")], "batch string, unit_id string, run_id string, text string")
    raw = spark.createDataFrame([("b", '[{"id": "u", "runs": [{"id": "r", "text": " y "}, {"text": "z"}]}, {"runs": [{"id": "s", "text": "y"}]}]'), (None, '[{"id": "v", "runs": [{"id": "t", "text": "y"}]}]')], "batch string, body string")
    judged = responses.reconciled(expected, responses.decoded(raw))
    got = sorted((str(r["unit_id"]), str(r["run_id"]), len(r["text"]), r["target"], r["fault"]) for r in judged.collect())
    assert got == [("None", "s", 1, None, "unit_missing"), ("u", "None", 1, None, "run_missing"), ("u", "r", 1, "y", None), ("u", "r", 400, None, "too_short"), ("v", "t", 1, None, "unit_missing")]
    plan = judged.select("run_id", "fault")._jdf.queryExecution().optimizedPlan().toString()
    dealt = [line for line in plan.split("\n") if "Join" in line or "Repartition" in line]
    assert len(dealt) == 1 and "RepartitionByExpression" in dealt[0]


def test_single_runs_are_measured_alike(spark):
    fields = "book string, document string, unit_ord long, unit_id string, run_ord int, run_id string, text string, style string, prefix string, suffix string, context string"
    texts = ["plain", "", None, 'q"x\\y', "tab\there", "a\n\n\n\nb", "é à 𝒳 «ü» ", '"]']
    rows = [("b", "d", i, f"u{i}", 0, f"r{i}", t, *own) for i, t in enumerate(texts) for own in [[("i", " ", "", "context é"), (None, None, None, None)][i % 2]]]
    own = spark.createDataFrame(rows, fields)
    said = packing.payloads(own, single=True)
    from loomspan.functions import text as T

    assert said.exceptAll(packing.payloads(own)).count() == 0 and said.count() == len(texts)
    assert said.where((T.text_tokens("payload") != F.col("tokens")) | (T.text_tokens("text") != F.col("source_tokens"))).count() == 0

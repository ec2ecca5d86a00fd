import json
import threading
import time

from loomspan.plans import jobs


def slow(folder):
    def call(units, glossary=None):
        """The first batch answers at once, all others only when told to."""
        import os
        import time

        if any(u["id"] == "u0" for u in units):
            return json.dumps([{"id": u["id"], "runs": [{"id": r["id"], "text": r["text"] + "!"} if u["id"] == "u0" else {"id": r["id"]} for r in u["runs"]]} for u in units])
        open(f"{folder}/asked", "a").close()
        until = time.time() + 120
        while not os.path.exists(f"{folder}/go") and time.time() < until:
            time.sleep(0.1)
        return json.dumps([{"id": u["id"], "runs": [{"id": r["id"], "text": r["text"] + "!"} for r in u["runs"]]} for u in units])

    return call


def test_a_running_call_is_interrupted(spark, tmp_path):
    """One batch of four runs: one run is good in the first round; the second round hangs and is interrupted; the next job asks for the rest only."""
    rows = [("b", i, f"u{i}", f"r{i}", 0, f"text {i}", None) for i in range(4)]
    runs = spark.createDataFrame(rows, "book string, unit_ord long, unit_id string, run_id string, run_ord int, text string, context string")
    kept, failed = [], []

    def commit(fresh):
        kept.extend(fresh.collect())

    def work():
        try:
            with jobs.tagged(spark, "job-1"):
                jobs.run_job(runs, slow(str(tmp_path)), "j", commit=commit)
        except Exception as e:
            failed.append(e)

    thread = threading.Thread(target=work)
    thread.start()
    until = time.time() + 90
    while not (tmp_path / "asked").exists() and time.time() < until:
        time.sleep(0.1)
    assert (tmp_path / "asked").exists()
    jobs.interrupt(spark, "another")
    time.sleep(1)
    assert thread.is_alive() and not failed
    began = time.time()
    jobs.interrupt(spark, "job-1")
    thread.join(30)
    assert not thread.is_alive() and failed and time.time() - began < 10
    assert [(r["run"], r["target"]) for r in kept] == [("r0", "text 0!")]
    assert not spark.sparkContext.getJobTags()
    (tmp_path / "go").touch()
    stored = spark.createDataFrame(kept)
    done, _ = jobs.run_job(runs, slow(str(tmp_path)), "j", stored=stored)
    assert {r["run_id"]: r["target"] for r in done.collect()} == {f"r{i}": f"text {i}!" for i in range(4)}

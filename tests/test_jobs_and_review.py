import json

from pyspark.sql import functions as F

from loomspan.operators import cache, packing, responses, review
from loomspan.plans import chapters, jobs


def runs(spark, texts, chapter=None):
    rows = [("book", i, f"u{i}", f"u{i}-0", 0, t, None, chapter(i) if chapter else 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "book string, unit_ord long, unit_id string, run_id string, run_ord int, text string, context string, chapter int")


def test_job_resumes_and_salvages(spark):
    df = runs(spark, [f"text number {i}" for i in range(12)])

    def flaky(units):
        rows = json.loads(jobs.echo(units))
        rows = [r for r in rows if r["id"] != "u3" or len(rows) < 6]  # only small batches bring u3
        if len(rows) > 1:
            rows.append(rows[0])  # a duplicate unit, and one nobody asked for
        return json.dumps([*rows, {"id": "odd", "runs": []}])

    done, kept = jobs.run_job(df, flaky, "j", target=700)
    assert sorted(tuple(r) for r in done.collect()) == sorted((f"u{i}-0", f"«text number {i}»") for i in range(12)) and kept.count() == 12  # no run is lost
    again, _ = jobs.run_job(df, lambda units: "[]", "j", kept)  # nothing new is learnt: all from the cache
    assert sorted(map(str, again.collect())) == sorted(map(str, done.collect()))
    other, _ = jobs.run_job(df, lambda units: "no json", "k", kept)
    assert other.count() == 0 and cache.coverage(df, other).count() == 12


def test_chapters_publish_in_order(spark):
    df = runs(spark, ["a", "b", "c"], lambda i: i + 1)
    found = {1: [("Toto", "T")], 2: [("Wu", "W"), ("Toto", "other")]}
    job = chapters.Chapters(df, jobs.echo, chapters.job_store(spark), "j", lambda n, t: spark.createDataFrame(found[n], "term string, translation string") if n in found else None)
    assert job.publish() == [1, 2, 3] and {n: job.known(n).count() for n in job.numbers} == {1: 0, 2: 1, 3: 2}


def test_reconcile_faults(spark):
    expected = spark.createDataFrame([("b", u, r, "x") for u, r in [("u0", "r0"), ("u0", "r1"), ("u1", "r2"), ("u2", "r3"), ("u3", "r4"), ("u3", "r5")]], "batch string, unit_id string, run_id string, text string")
    body = [{"id": "u0", "runs": [{"id": "r0", "text": "ok"}, {"id": "r1", "text": " "}]}, {"id": "u1", "runs": [{"id": "r2", "text": "a"}]}, {"id": "u1", "runs": []}, {"id": "u3", "runs": [{"id": "r4", "text": "a"}, {"id": "r4", "text": "b"}]}, {"id": "zz", "runs": []}]
    raw = spark.createDataFrame([("b", "```json\n" + json.dumps({"results": body}) + "\n```")], "batch string, body string")
    got = responses.decoded(raw)
    judged = responses.reconciled(expected, got)
    assert {r["run_id"]: r["fault"] for r in judged.collect()} == {"r0": None, "r1": "empty", "r2": "unit_duplicate", "r3": "unit_missing", "r4": "run_duplicate", "r5": "run_missing"}
    good, bad = responses.salvaged(judged)
    assert good.count() == 1 and bad.count() == 5
    assert [r["unit_id"] for r in responses.unknown_units(expected, got).collect()] == ["zz"]
    assert set(responses.reasons(judged).first()["reasons"]) == {"empty", "unit_duplicate", "unit_missing", "run_duplicate", "run_missing"}
    none = spark.createDataFrame([], "batch string")
    assert responses.recovery(judged, none).first()["action"] == "retry_reversed" and responses.recovery(judged, judged.select("batch")).first()["action"] == "split"


def test_recovery_turns_then_halves(spark):
    """Seven units of one batch; one of them is never answered, and any answer with it is no JSON."""
    df = runs(spark, [f"text {i}" for i in range(7)])
    asked = spark.sparkContext.accumulator(0)

    def spoilt(units):
        asked.add(1)
        ids = [u["id"] for u in units]
        return "nothing" if "u5" in ids else jobs.echo(units)

    done, _ = jobs.run_job(df, spoilt, "j")
    assert sorted(r["run_id"] for r in done.collect()) == [f"u{i}-0" for i in range(7) if i != 5]
    assert asked.value >= 8  # 7 whole and turned, halves whole and turned, down to the one unit

    def ordered(units):  # answers only what comes in reversed order
        ids = [u["id"] for u in units]
        return jobs.echo(units) if ids == sorted(ids, reverse=True) else "[]"

    done, _ = jobs.run_job(df, ordered, "j")
    assert done.count() == 7


def test_a_unit_splits_between_its_runs(spark):
    rows = [("b", "u", 0, k, f"r{k}", "x", 1, True, True) for k in range(5)]
    batched = spark.createDataFrame(rows, "batch string, unit_id string, unit_ord long, run_ord int, run_id string, text string, tokens long, starts_paragraph boolean, backwards boolean")
    judged = batched.select("batch", "unit_id", "run_id", "text", F.lit("unit_missing").alias("fault"))
    again, lost = jobs.recovered(judged, batched)
    assert {(r["batch"], r["run_id"]) for r in again.collect()} == {("b.0", "r0"), ("b.0", "r1"), ("b.1", "r2"), ("b.1", "r3"), ("b.1", "r4")} and lost.count() == 0
    again, lost = jobs.recovered(judged.where("run_id = 'r0'"), batched.where("run_id = 'r0'"))
    assert again.count() == 0 and [tuple(r) for r in lost.collect()] == [("r0", "unit_missing")]


def test_packing(spark):
    rows = [("b", i, "d", f"k{i // 3}", f"u{i}", f"u{i}", 100) for i in range(12)] + [("c", 0, "d", "k", "v", "v", 5000)]
    df = spark.createDataFrame(rows, "book string, unit_ord long, document string, block_key string, unit_id string, run_stem string, tokens long")
    marked = packing.paragraph_marks(df)
    assert [r["starts_paragraph"] for r in marked.where("book = 'b'").orderBy("unit_ord").collect()] == [True, False, False] * 4
    got = packing.pack(marked, 800, 16_000).where("book = 'b'").orderBy("unit_ord").collect()
    assert [r["batch_no"] for r in got] == sorted(r["batch_no"] for r in got) and max(r["est_input"] for r in got) <= 800
    assert packing.pack(marked, 800, 16_000).where("book = 'c'").count() == 1
    halves = packing.halves(marked.where("book = 'b'").withColumn("batch", F.lit(1))).orderBy("unit_ord").collect()
    assert [r["half"] for r in halves] == [0] * 6 + [1] * 6


def test_rules_and_router(spark):
    fields = "ord long, chapter int, source_term string, proposed string, supporting_text string, category string"
    rows = [
        (0, 1, "D", "D", "met D today", "person"), (1, 1, "Vampire Hunter D", "Pemburu Vamper D", "the Vampire Hunter D", "person"), (2, 1, "kraken coin", "koin kraken emas", "a kraken coin", "artifact"),
        (3, 1, "D", "D", "never said", "person"), (4, 1, "Toto", "Tono", "Toto spoke", "person"), (5, 1, "Hunter", "pemburu", "something else here", "person"),
    ]
    chapters = spark.createDataFrame([(1, "They met D today, the Vampire Hunter D. A kraken coin. Toto spoke. Something else here.")], "chapter int, text string")
    approved = spark.createDataFrame([("toto", "Nama")], "term string, translation string")
    judged = review.findings(spark.createDataFrame(rows, fields), chapters, approved)
    got = {r["ord"]: r["rules"] for r in judged.collect()}
    assert got[0] == [] and {"R2", "R6"} & set(got[1]) and got[2] == ["R3"] and {"R1", "R4", "R8"} == set(got[3]) and {"R5", "R6"} <= set(got[4]) and {"R7", "R8"} == set(got[5])
    verdicts = spark.createDataFrame([(0, "D", "provisional", None), (1, "D", "verified", None), (0, "kraken coin", "verified", None)], "ord long, source_term string, verdict string, corrected string")
    routed = review.routed(review.with_verdicts(judged, verdicts), spark.createDataFrame([("hunter",)], "key string"))
    decision = {r["ord"]: r["decision"] for r in routed.collect()}
    assert decision[0]["approved"] and decision[0]["origin"] == "auto" and not decision[2]["approved"] and decision[4]["status"] == "ambiguous" and decision[5]["status"] == "rejected"
    review_first = review.routed(review.with_verdicts(judged, verdicts), spark.createDataFrame([], "key string"), "review_first")
    assert review_first.where("decision.approved").count() == 0
    assert review.discovery_counts(routed).first()["auto_approved"] == 1
    assert review.discovery_text(spark.createDataFrame([(1, "one\n\ntwo")], "chapter int, text string")).first()["paragraphs"] == "[P1] one\n\n[P2] two"


def test_identities(spark):
    assert cache.job_id("h", a=1, b=None) == cache.job_id("h", a=1) != cache.job_id("h", a=2)
    assert cache.inheritance_source("old", "new", "c", "c") == "old" and cache.inheritance_source("old", "new", "c", "d") is None
    terms = spark.createDataFrame([(2, "a", "x")], "chapter int, term string, translation string")
    got = {r["chapter"]: r["namespace"] for r in cache.namespaces(spark.createDataFrame([(1,), (2,)], "chapter int"), "j", terms).collect()}
    assert got[1] != got[2]


def test_registry_is_whole():
    from loomspan.plans import registry

    assert registry.FLAGSHIP in registry.QUERIES and set(registry.ORACLES) <= set(registry.QUERIES) 
    without_sql = set(registry.QUERIES) - set(registry.ORACLES)
    assert without_sql <= {"v_rules"}, without_sql


def test_request_payloads_and_glossary_once(spark):
    fields = "book string, document string, unit_ord long, unit_id string, run_ord int, run_id string, text string, style string, prefix string, suffix string, context string"
    rows = [("b", "d", 0, "u0", 0, "r0", "A noble", "i", " ", "", "A noble D"), ("b", "d", 0, "u0", 1, "r1", "D", None, "", None, None), ("b", "d", 1, "u1", 0, "r2", "part", "", "", "", "the whole part")]
    got = {r["unit_id"]: r for r in packing.payloads(spark.createDataFrame(rows, fields)).collect()}
    assert json.loads(got["u0"]["payload"]) == {"id": "u0", "runs": [{"id": "r0", "text": "A noble", "format": "i", "space_before": True}, {"id": "r1", "text": "D"}], "context": "A noble D"}
    assert json.loads(got["u1"]["payload"])["context"] == "the whole part" and got["u0"]["text"] == " A nobleD" and got["u0"]["overhead_tokens"] < got["u0"]["tokens"]
    units = spark.createDataFrame([("b", i, f"u{i}", 100, 50, 10, True) for i in range(6)], "book string, unit_ord long, unit_id string, tokens long, source_tokens long, overhead_tokens long, starts_paragraph boolean")
    terms = spark.createDataFrame([("Noble", "Bangsawan " * 40)], "term string, translation string")
    found = spark.createDataFrame([(f"u{i}", "Noble") for i in range(6)], "unit_id string, term string")
    with_terms = packing.with_terms(units, found, terms)
    entry = with_terms.first()["terms"][0]["tokens"]
    need = -int(-(128 + 3 * 100 + entry) * 1.12 // 1) + 64
    batches = [r["batch_no"] for r in packing.pack(with_terms, need, 65_536).orderBy("unit_ord").collect()]
    assert batches == [0, 0, 0, 1, 1, 1]  # the entry counts once a batch
    assert packing.pack(with_terms, need, 65_536).first()["est_input"] <= need
    assert [r["batch_no"] for r in packing.pack(with_terms, 10**6, int((2048 + 2 * 95) / 0.9) + 1).orderBy("unit_ord").collect()] == [0, 0, 1, 1, 2, 2]  # the answer's bound


def test_progress_and_cancel(spark):
    df = runs(spark, [f"text {i}" for i in range(4)])
    heard = []
    done, _ = jobs.run_job(df, jobs.echo, "j", progress=lambda *x: heard.append(x))
    assert heard[0][:3] == (0, 4, 0) and heard[-1] == (4, 4, 1, "done") and done.count() == 4
    none, _ = jobs.run_job(df, jobs.echo, "j", cancelled=lambda: True)
    assert none.count() == 0


def test_only_verified_terms_are_published(spark):
    df = runs(spark, ["a", "b"], lambda i: i + 1)
    found = spark.createDataFrame([("Toto", "T"), ("Wu", "W"), ("Odd", "O")], "term string, translation string")

    def verify(rows):
        return [("verified", "Better" if r["source_term"] == "Wu" else None) if r["source_term"] != "Odd" else ("ambiguous", None) for r in rows]

    job = chapters.Chapters(df, jobs.echo, chapters.job_store(spark), "j", lambda n, t: found if n == 1 else None, verify=verify)
    job.publish()
    assert {n: job.known(n).count() for n in job.numbers} == {1: 0, 2: 2}
    asked = found.select(F.monotonically_increasing_id().alias("ord"), F.lit(1).alias("chapter"), F.col("term").alias("source_term"), "translation")
    assert {r["verdict"] for r in review.verified(asked, lambda rows: [("verified", None)]).collect()} == {"provisional"}  # too short an answer
    assert review.effective_policy("auto_safe", False) == "review_first" and review.effective_policy("auto_safe", True) == "auto_safe"


def test_lists_under_any_name_and_first_seen_reasons(spark):
    raw = spark.createDataFrame([("b", '{"n": 3, "answers": [{"id": "u", "runs": []}]}'), ("c", '{"n": 3}')], "batch string, body string")
    got = {r["batch"]: r["rows"] for r in responses.decoded(raw).collect()}
    assert got["b"][0]["id"] == "u" and not got["c"]
    judged = spark.createDataFrame([("b", 1, "a", "r", "empty"), ("b", 0, "z", "s", "too_long"), ("b", 2, "c", "t", None)], "batch string, unit_ord int, unit_id string, run_id string, fault string")
    assert responses.reasons(judged).first()["reasons"] == ["too_long", "empty"]


def test_instructions_and_bounds(spark):
    texts = spark.createDataFrame([("short", "Keep names.")], "name string, text string")
    got = {r["profile"]: (r["instruction"], r["instruction_tokens"] > 0) for r in review.with_instructions(spark.createDataFrame([("short",), ("none",), (None,)], "profile string"), texts).collect()}
    assert got == {"short": ("Keep names.", True), "none": ("", False), None: ("", False)}
    row = cache.bounded(spark.createDataFrame([("abcdef", [1, 2, 3])], "error string, ids array<int>"), error=3, ids=2).first()
    assert tuple(row) == ("abc", [1, 2])
    jobs_seen = cache.recent_jobs(spark.createDataFrame([("a", 1.0, '{"rpm": 5}'), ("b", 2.0, "junk")], "id string, updated double, settings string"))
    assert {r["id"]: r["settings"] for r in jobs_seen.collect()}["a"] == {"rpm": "5"}

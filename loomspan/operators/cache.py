"""Content-addressed results: identities, lookup, upsert, pending work and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators.ranges import range_count
from loomspan.storage import materialize

#: Ids that one task compares: their number sets that of the tasks.
TASK_IDS = 500_000


def fingerprints(runs: DataFrame) -> DataFrame:
    """Adds ``fingerprint`` to ``unit_id, run_id, text, context``: the digest of the unit's payload, then of the run's."""
    unit = T.digest(T.canonical(F.col("context"), F.col("unit_id").alias("id")))
    run = T.canonical(F.col("run_id").alias("id"), F.col("text"))
    return runs.withColumn("fingerprint", T.digest(F.concat(unit, run)))


def job_id(source_hash: str, **settings) -> str:
    """Identity of a run over a source; settings that are None take no part."""
    import hashlib
    import json

    stated = json.dumps({k: v for k, v in settings.items() if v is not None}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256((source_hash + stated).encode()).hexdigest()


def namespaces(chapters: DataFrame, base: str, terms: DataFrame) -> DataFrame:
    """``chapter, namespace``: depends on the job, the chapter and the terms the chapter may use (``chapter, term, translation``)."""
    pairs = F.to_json(F.array_sort(F.collect_list(F.array(F.lower("term"), "translation"))))
    own = terms.groupBy("chapter").agg(pairs.alias("_g"))
    named = chapters.select("chapter").distinct().join(own, "chapter", "left")
    key = F.concat(F.lit(f"{base}|"), F.col("chapter").cast("string"), F.lit("|"), F.coalesce("_g", F.lit("")))
    return named.select("chapter", F.concat(F.lit("ch"), F.left(T.digest(key), F.lit(16))).alias("namespace"))


def lookup(runs: DataFrame, cache: DataFrame, job: str, *more: str) -> DataFrame:
    """``run_id, target`` (and the columns ``more`` of ``runs``) for runs whose row in ``cache`` has the same fingerprint, an intact checksum and a sound text."""
    own = cache.where((F.col("job") == job) & (T.digest("target") == F.col("checksum"))).select(F.col("run").alias("run_id"), "fingerprint", "target")
    asked = runs.select("run_id", "fingerprint", F.length("text").alias("_length"), *[c for c in more if c != "fingerprint"])  # texts do not travel
    return asked.join(own, ["run_id", "fingerprint"]).where(T.length_fault("_length", "target").isNull()).select("run_id", "target", *more)


def upsert(current: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` with the rows of ``fresh`` in place of those of equal keys; the last by ``version`` wins."""
    both = current.withColumn("_side", F.lit(0)).unionByName(fresh.withColumn("_side", F.lit(1)))
    newest = Window.partitionBy(*keys).orderBy(F.desc("_side"), F.desc("version"))
    return both.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "_side")


def pending_runs(runs: DataFrame, targets: DataFrame) -> DataFrame:
    return runs.join(targets.select("run_id"), "run_id", "left_anti")


def coverage(runs: DataFrame, targets: DataFrame) -> DataFrame:
    """``side, run_id``: runs without a target and targets without a run; empty when both sets are equal."""
    own = runs.select("run_id", F.lit(True).alias("_run")).unionByName(targets.select("run_id", F.lit(False).alias("_run")))
    both = materialize(own)
    n = max(range_count(both), both.count() // TASK_IDS + 1)
    seen = both.repartition(n, "run_id").groupBy("run_id").agg(F.bool_and("_run").alias("_runs"), F.bool_or("_run").alias("_any"))
    return seen.where(F.col("_runs") | ~F.col("_any")).select(F.when(F.col("_runs"), "missing").otherwise("unknown").alias("side"), "run_id")


def overlap(a: DataFrame, b: DataFrame, key: str = "run_id") -> DataFrame:
    """Keys on both sides: must be empty before a commit."""
    return a.select(key).intersect(b.select(key))


def inheritance_source(previous_job: str | None, job: str, previous_config: str | None, config: str) -> str | None:
    """The job to inherit from: another one of the same configuration, else none."""
    return previous_job if previous_job and previous_job != job and previous_config == config else None


def recent_jobs(jobs: DataFrame, n: int = 30) -> DataFrame:
    """The ``n`` newest jobs; ``settings``, where there are any, decoded from JSON to a map (null if it is none)."""
    newest = jobs.orderBy(F.desc("updated"), "id").limit(n)
    return newest.withColumn("settings", F.from_json("settings", "map<string,string>")) if "settings" in jobs.columns else newest


def failure_rows(failures: DataFrame) -> DataFrame:
    """Log rows cut to their bounds: 300 characters of error, five sample ids."""
    return bounded(failures, error=300, sample_ids=5)


def bounded(rows: DataFrame, **most: int) -> DataFrame:
    """Columns cut to at most so many characters, or elements of an array."""
    array = {f.name for f in rows.schema if f.dataType.typeName() == "array"}
    return rows.withColumns({c: F.slice(c, 1, n) if c in array else F.left(F.col(c), F.lit(n)) for c, n in most.items()})


def failure_stats(failures: DataFrame) -> DataFrame:
    return failures.groupBy("kind").agg(F.count("*").alias("failures"), F.sum("units").alias("units"), F.sum("runs").alias("runs"), F.sum("est_input_tokens").alias("est_input_tokens"))

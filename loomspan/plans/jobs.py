"""Whole jobs: units through an injectable batch function, with glossary, cache, packing and salvage."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators import cache, matching, packing, responses
from loomspan.storage import delete, materialize, new_path, scratch

#: Takes the units of one batch, ``[{"id": ..., "runs": [{"id": ..., "text": ...}]}]``, and gives the response text. In a job with a glossary it
#: also takes the entries, ``{term: translation}``, that occur in the batch.
BatchFunction = Callable[..., str]
#: Runs of an Arrow batch that are Python objects at a time.
ROWS = 256
#: Takes runs done, all runs, calls so far and a message.
Progress = Callable[[int, int, int, str], None]


def echo(units: list[dict], glossary: dict[str, str] | None = None) -> str:
    """The offline stand-in for a remote model: every run between guillemets."""
    import json

    return json.dumps([{"id": u["id"], "runs": [{"id": r["id"], "text": f"«{r['text']}»"} for r in u["runs"]]} for u in units], ensure_ascii=False)


def responded(batched: DataFrame, call: BatchFunction, entries: DataFrame | None = None) -> DataFrame:
    """``batch, body`` for the runs ``batch, unit_id, run_id, unit_ord, run_ord, text`` (and ``backwards``, if the units go in reversed
    order): one call per batch, and its answer leaves the task at once. ``entries`` (``batch, glossary`` as JSON): what else each call is given."""
    turned = F.col("backwards") if "backwards" in batched.columns else F.lit(False)
    rows = batched.select("batch", "unit_id", "run_id", F.when(turned, -F.col("unit_ord")).otherwise(F.col("unit_ord")).cast("long").alias("place"), F.col("run_ord").cast("int").alias("run_ord"), "text")
    if entries is not None:  # comes before the batch's runs
        none = F.lit(None)
        rows = rows.unionByName(entries.select("batch", none.cast("string").alias("unit_id"), none.cast("string").alias("run_id"), none.cast("long").alias("place"), none.cast("int").alias("run_ord"), F.col("glossary").alias("text")))
    given = entries is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        now, units, glossary = None, [], {}

        def answer() -> pa.RecordBatch:
            return pa.record_batch([pa.array([now], pa.string()), pa.array([call(units, glossary) if given else call(units)], pa.string())], ["batch", "body"])

        for part in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            for batch, unit, run_id, text in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("batch", "unit_id", "run_id", "text"))):
                if batch != now:
                    if units:
                        yield answer()
                    now, units, glossary = batch, [], {}
                if run_id is None:
                    glossary = json.loads(text)
                    continue
                if not units or units[-1]["id"] != unit:
                    units.append({"id": unit, "runs": []})
                units[-1]["runs"].append({"id": run_id, "text": text})
        if units:
            yield answer()

    return rows.repartition("batch").sortWithinPartitions("batch", F.col("place").isNotNull(), "place", "unit_id", "run_ord").mapInArrow(run, "batch string, body string")


@contextlib.contextmanager
def tagged(spark: SparkSession, tag: str) -> Iterator[None]:
    """What this thread begins inside can be ended by ``interrupt``, also in the middle of a round. What ``commit`` has taken by then
    stays, so that the next run of the job goes on from there."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def interrupt(spark: SparkSession, tag: str) -> None:
    """Ends what runs under a tag, calls included, from any thread; the thread that began it gets an exception."""
    spark.sparkContext.cancelJobsWithTag(tag)


def recovered(judged: DataFrame, batched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is asked again, and the runs that are given up (``run_id, fault``).

    The bad runs of a batch that brought some good ones are a smaller batch. A batch without any good run is sent once more with its units
    in reversed order; failing again, it is halved. A single run that fails both ways is given up.
    """
    seen = judged.groupBy("batch").agg(F.count_if(F.col("fault").isNull()).alias("_good"), F.count_if(F.col("fault").isNotNull()).alias("_bad"))
    faults = materialize(judged.where("fault is not null").select("batch", "run_id", "fault").join(seen, "batch"))  # no texts, and few rows as a rule
    bad = materialize(batched.join(faults, ["batch", "run_id"]))
    if "tokens" not in batched.columns:
        bad = bad.withColumn("tokens", T.text_tokens("text"))
    progress = bad.where("_good > 0").withColumns({"batch": F.concat("batch", F.lit("+")), "backwards": F.lit(False)})
    turned = bad.where("_good = 0 and not backwards").withColumn("backwards", F.lit(True))
    stuck = bad.where("_good = 0 and backwards")
    cut = packing.split_batches(stuck.where("_bad > 1")).withColumns({"batch": F.concat("batch", F.lit("."), F.col("half").cast("string")), "backwards": F.lit(False)})
    again = progress.select(*batched.columns).unionByName(turned.select(*batched.columns)).unionByName(cut.select(*batched.columns))
    return again, stuck.where("_bad = 1").select("run_id", "fault")


def _requests(left: DataFrame, glossary: DataFrame | None, path: str) -> tuple[DataFrame, DataFrame | None]:
    """What a request would say of each unit of ``left``, as sizes for packing, and which entries (``unit_id, term``, written to ``path``) it needs."""
    blank = {c: F.lit(None).cast("string") for c in ("style", "prefix", "suffix") if c not in left.columns}
    several = left.groupBy("unit_id", "book", "unit_ord").count().where("count > 1")  # of ids; texts are gathered only where a unit has several runs
    said = packing.payloads(left.withColumns({**blank, "document": F.col("book")}), single=several.isEmpty())
    sized = said.select("book", "unit_ord", "unit_id", "tokens", "source_tokens", "overhead_tokens")
    needed = None
    if glossary is not None:
        needed = materialize(matching.matches(said.select("unit_id", "text"), glossary), path=path)
        sized = packing.with_terms(sized, needed, glossary)
    return materialize(sized), needed


def _entries(batched: DataFrame, needed: DataFrame, glossary: DataFrame) -> DataFrame:
    """``batch, glossary``: the entries that occur in a batch, as JSON; a batch's size bounds them."""
    own = batched.select("batch", "unit_id").distinct().join(needed, "unit_id").select("batch", "term").distinct().join(glossary.select("term", "translation"), "term")
    return own.groupBy("batch").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "translation"))))).alias("glossary"))


def answered(
    runs: DataFrame, call: BatchFunction, job: str, stored: DataFrame | None = None, target: int = 2000, output_limit: int = 16_000, progress: Progress | None = None, cancelled: Callable[[], bool] | None = None,
    glossary: DataFrame | None = None, commit: Callable[[DataFrame], None] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The targets of ``run_job`` as ``unit_id, run_id, target``, and the runs as they were written; both have the ``fingerprint`` where rows are stored or
    committed. ``runs`` with a ``fingerprint`` are a table already, and not written again.

    A text is dealt to its batch and to the call and, as an answer, to its run: everything else moves ids and sizes. Tables of a step go with it.
    """
    spark = runs.sparkSession
    kept = stored is not None or commit is not None or "fingerprint" in runs.columns
    marked = runs if "fingerprint" in runs.columns else materialize(cache.fingerprints(runs) if kept else runs)
    own = ["unit_id", "run_id", *(["fingerprint"] if kept else [])]
    done, left = [], marked
    if stored is not None and not stored.isEmpty():
        done = [materialize(cache.lookup(marked, stored, job, *own[::2]).select(*own, "target"))]
        left = materialize(cache.pending_runs(marked, done[0]))
    given = glossary is not None
    glossary = glossary if given and not glossary.isEmpty() else None
    path, terms_path = new_path(spark), new_path(spark)
    with scratch(spark):
        sized, needed = _requests(left, glossary, terms_path)
        numbered = packing.placed(sized).withColumn("starts_paragraph", F.lit(True))  # a unit is a paragraph
        packed = packing.pack(numbered, target, output_limit)
        named = packed.select(F.col("book").alias("_b"), F.col("unit_ord").alias("_o"), F.col("unit_id").alias("_u"), "place", "starts_paragraph", F.concat_ws("#", F.coalesce("book", F.lit("")), F.col("batch_no").cast("string")).alias("batch"))
        met = (F.col("unit_id") == F.col("_u")) & F.col("book").eqNullSafe(F.col("_b")) & (F.col("unit_ord") == F.col("_o"))
        batched = materialize(left.join(named, met).select("batch", *own, F.col("place").alias("unit_ord"), "run_ord", "text", "starts_paragraph", F.lit(False).alias("backwards")), path=path)
    total, calls = marked.count() if progress else 0, 0
    none = spark.createDataFrame([], "batch string, glossary string") if given else None

    while not batched.isEmpty() and not (cancelled and cancelled()):
        if progress:
            state = batched.agg(F.countDistinct("batch").alias("batches"), F.count("*").alias("runs")).first()
            progress(total - state["runs"], total, calls, f"{state['batches']} batches to ask")
            calls += state["batches"]
        judged_path, rest_path = new_path(spark), new_path(spark)
        with scratch(spark):
            entries = none if glossary is None else _entries(batched, needed, glossary)
            bodies = materialize(responded(batched, call, entries))  # whatever fails behind it, nothing is called twice
            found = responses.judged(batched.select("batch", *own, "text"), responses.answered(responses.decoded(bodies)))
            judged = materialize(found.drop("text"), path=judged_path)
        good = responses.salvaged(judged)[0].select(*own, "target")
        if commit and not good.isEmpty():
            commit(cache_rows(good, job))
        done.append(good)
        with scratch(spark):
            rest = materialize(recovered(judged, batched)[0].select(*batched.columns), path=rest_path)
        delete(spark, path)
        batched, path = rest, rest_path
    if progress:
        progress(total - batched.count(), total, calls, "done")
    every = marked.select(*own, F.lit("").alias("target")).limit(0)
    for more in done:
        every = every.unionByName(more)
    return every, marked


def cache_rows(targets: DataFrame, job: str) -> DataFrame:
    """The rows that ``answered`` takes as ``stored``, for what it gave."""
    return targets.select(F.lit(job).alias("job"), F.col("run_id").alias("run"), "fingerprint", "target", T.digest("target").alias("checksum"))


def run_job(runs: DataFrame, call: BatchFunction, job: str, *args, **options) -> tuple[DataFrame, DataFrame]:
    """Targets ``run_id, target`` and the cache rows to keep, for ``book, unit_ord, unit_id, run_id, run_ord, text, context``.

    Runs with a valid cache row of ``stored`` are not sent again. What is pending is packed once (to ``target`` and ``output_limit``), by what its requests say; then each round calls,
    judges every run for itself, keeps the good ones and asks for the others as ``recovered`` says, until none is left but those given up: see ``cache.coverage``.
    ``unit_ord`` orders the units of a book; it may be a struct.
    ``glossary`` (``term, translation``, each term once): a call is given the entries that occur in its batch, and packing counts them.
    ``commit`` takes the cache rows of each round as soon as they are judged, so that a job that is killed goes on from there.
    ``progress`` hears of the runs done, all runs, the calls so far and what comes; between rounds ``cancelled`` may end the job: what is done is kept.
    Options are those of ``answered``.
    """
    every, marked = answered(runs, call, job, *args, **options)
    kept = every if "fingerprint" in every.columns else every.join(cache.fingerprints(marked).select("run_id", "fingerprint"), "run_id")
    return every.select("run_id", "target"), cache_rows(kept, job)

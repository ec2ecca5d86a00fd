"""Responses of a batch function: decoding, reconciling with what was asked, salvage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.storage import materialize

RESPONSE = "array<struct<id:string,runs:array<struct<id:string,text:string>>>>"
WRAPPERS = ("units", "data", "translations", "results", "items")


def decoded(raw: DataFrame, column: str = "body") -> DataFrame:
    """Adds ``rows`` (the response, null if it is no strict JSON list of units) and ``repaired``.

    Fences go first; a body that fails strict parsing gets one try with its quotes repaired; a list may be wrapped: under
    one of the usual names, else the first list among the values of the object.
    """
    plain = raw.withColumn("_plain", T.unfenced(column))
    # a Python function runs for every row, whatever stands around it: sound bodies are nulls to it
    broken = F.when(F.col("_strict").isNull(), F.col("_plain"))
    fixed = plain.withColumn("_strict", T.strict_json("_plain")).withColumn("_fixed", T.strict_json(T.repaired_json(broken)))
    body = F.coalesce("_strict", "_fixed")
    inner = F.when(body.startswith("["), body).otherwise(F.coalesce(*[F.get_json_object(body, f"$.{w}") for w in WRAPPERS], F.get(F.filter(F.map_values(F.from_json(body, "map<string,string>")), lambda v: v.startswith("[")), F.lit(0))))
    rows = F.from_json(inner, RESPONSE)
    return fixed.withColumn("rows", F.when(inner.startswith("["), rows)).withColumn("repaired", F.col("_fixed").isNotNull()).drop("_plain", "_strict", "_fixed")


def answered(responses: DataFrame) -> DataFrame:
    """``batch, unit_id, run_id, target``: one row per returned run, in no particular trust."""
    units = responses.select("batch", F.posexplode_outer("rows").alias("u_no", "u"))
    return units.select("batch", "u_no", F.col("u.id").alias("unit_id"), F.posexplode_outer("u.runs").alias("r_no", "r")).select("batch", "u_no", "unit_id", F.col("r.id").alias("run_id"), F.col("r.text").alias("target"))


def reconciled(expected: DataFrame, responses: DataFrame) -> DataFrame:
    """``batch, unit_id, run_id, target, fault`` for each expected run (``batch, unit_id, run_id, text``).

    A unit that is missing or returned twice fails with all its runs; other runs are judged one by one.
    """
    rows = materialize(answered(responses))  # decoded once, whatever reads the result
    return judged(expected.select("batch", "unit_id", "run_id", "text"), rows)


def judged(expected: DataFrame, answers: DataFrame) -> DataFrame:
    """``target, fault`` beside the columns of each expected run, from the rows of ``answered``.

    Both sides are dealt to units once, and lie side by side there. Of the texts asked only the lengths are compared: where the result's ``text`` is not
    used, it does not travel.
    """
    asked = expected.withColumns({"_length": F.length("text"), "_asked": F.lit(True)})
    said = answers.where("batch is not null and unit_id is not null").select("batch", "unit_id", "run_id", "u_no", "target", F.lit(False).alias("_asked"))
    both = asked.unionByName(said, allowMissingColumns=True).repartition("batch", "unit_id")
    unit, run = Window.partitionBy("batch", "unit_id"), Window.partitionBy("batch", "unit_id", "run_id")
    met = both.withColumns({"_runs": F.count_if(~F.col("_asked") & F.col("run_id").isNotNull()).over(run), "_said": F.max("target").over(run)})
    met = met.withColumns({"_first": F.min("u_no").over(unit), "_last": F.max("u_no").over(unit)}).where("_asked")
    fault = (
        F.when(F.col("_first").isNull(), "unit_missing")
        .when(F.col("_first") < F.col("_last"), "unit_duplicate")
        .when(F.col("_runs") == 0, "run_missing")
        .when(F.col("_runs") > 1, "run_duplicate")
        .otherwise(T.length_fault("_length", "_said"))
    )
    found = met.select(*expected.columns, "_said", fault.alias("fault"))
    return found.select(*expected.columns, F.when(F.col("fault").isNull(), T.trimmed("_said")).alias("target"), "fault")


def salvaged(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to commit and rows to ask for again."""
    return judged.where("fault is null").drop("fault"), judged.where("fault is not null").drop("target")


def unknown_units(expected: DataFrame, responses: DataFrame) -> DataFrame:
    """Returned units that nobody asked for."""
    return answered(responses).where("unit_id is not null").select("batch", "unit_id").distinct().join(expected.select("batch", "unit_id").distinct(), ["batch", "unit_id"], "left_anti")


def reasons(judged: DataFrame) -> DataFrame:
    """``batch, reasons``: the distinct faults of a batch, first seen first: in the order of ``unit_ord`` and ``run_ord`` where the
    rows have them, else of the ids."""
    place = [c for c in ("unit_ord", "run_ord") if c in judged.columns]
    order = F.array_sort(F.collect_list(F.struct(*place, "unit_id", "run_id", "fault")))
    return judged.where("fault is not null").groupBy("batch").agg(F.array_distinct(F.transform(order, lambda x: x["fault"])).alias("reasons"))


def aliases(runs: DataFrame) -> DataFrame:
    """Adds the short names ``u0, u1, …`` and ``r0, r1, …`` that stand for ids in a request."""
    by_unit = Window.partitionBy("batch").orderBy("unit_ord")
    by_run = Window.partitionBy("batch").orderBy("unit_ord", "run_ord")
    return runs.withColumns({"unit_alias": F.concat(F.lit("u"), (F.dense_rank().over(by_unit) - 1).cast("string")), "run_alias": F.concat(F.lit("r"), (F.row_number().over(by_run) - 1).cast("string"))})


def recovery(judged: DataFrame, tried: DataFrame) -> DataFrame:
    """``batch, action``: done, retry (once per batch, in reversed order), split, or fail (one run left)."""
    left = judged.groupBy("batch").agg(F.count_if(F.col("fault").isNotNull()).alias("bad"), F.count("*").alias("runs"))
    seen = left.join(tried.select("batch", F.lit(True).alias("_tried")).distinct(), "batch", "left")
    action = F.when(F.col("bad") == 0, "done").when(F.col("_tried").isNull(), "retry_reversed").when(F.col("bad") > 1, "split").otherwise("fail")
    return seen.select("batch", "bad", "runs", action.alias("action"))

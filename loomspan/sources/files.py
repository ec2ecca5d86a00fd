"""Text and JSON sources, and the sinks of the same tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import glossary
from loomspan.operators.cache import bounded
from loomspan.operators.ranges import prefix_sums

HISTORY = "array<struct<translation:string,approved:boolean,status:string,at:string,by:string>>"
TERM = f"term string, translation string, approved boolean, note string, updated_at string, status string, origin string, source_chapter int, evidence string, suggested_fix string, history {HISTORY}"
MEMORY = f"book_id string, title string, terms array<struct<{TERM.replace(' string', ':string').replace(' boolean', ':boolean').replace(' int', ':int').replace('history ', 'history:')}>>, reader_progress int, show_all_terms boolean, rejected_terms array<string>"

#: The keys of a failure event, with their types.
FAILURE = {"ts": "double", "job": "string", "title": "string", "kind": "string", "units": "bigint", "runs": "bigint", "est_input_tokens": "bigint", "error": "string", "sample_ids": "array<string>"}


def _object(x: Column) -> Column:
    return x.cast("map<string,variant>")


def unknown_keys(value: Column, known: tuple[str, ...]) -> Column:
    """What an object (VARIANT) holds besides the keys ``known``, as a VARIANT; an empty object for anything else."""
    own = F.when(F.schema_of_variant(value).startswith("OBJECT"), _object(value))
    return F.to_variant_object(F.map_filter(F.coalesce(own, F.create_map().cast("map<string,variant>")), lambda k, _: ~k.isin(*known)))


def failure_events(failures: DataFrame, extra: str | None = None) -> DataFrame:
    """``value``: each failure, within its bounds, as one line of JSON. Keys of the VARIANT column ``extra`` come after the
    keys of an event and never take the place of one, not even of one that is null."""
    names = [c for c in FAILURE if c in failures.columns]
    cut = bounded(failures, **{c: n for c, n in (("error", 300), ("sample_ids", 5)) if c in names})
    core = _object(F.to_variant_object(F.struct(*[F.col(c).cast(FAILURE[c]).alias(c) for c in names])))
    more = _object(unknown_keys(F.col(extra), tuple(FAILURE))) if extra else F.create_map().cast("map<string,variant>")
    return cut.select(F.to_json(F.to_variant_object(F.map_concat(core, more))).alias("value"))


def read_failures(lines: DataFrame) -> DataFrame:
    """The keys of an event in their types, and ``extra`` (VARIANT) with all others, for lines ``value`` of JSON.

    Lines of any version go together: a key that is missing, or of another type, is null. A line that holds no object is passed over.
    """
    parsed = lines.select(F.try_parse_json("value").alias("_v")).where(F.schema_of_variant("_v").startswith("OBJECT"))
    return parsed.select(*[F.try_variant_get("_v", f"$.{c}", t).alias(c) for c, t in FAILURE.items()], unknown_keys(F.col("_v"), tuple(FAILURE)).alias("extra"))


def glossary_text(spark: SparkSession, path: str) -> DataFrame:
    """Parsed lines of a glossary file, numbered from 1 per file."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r\n|[\n\r]")).alias("i", "value"))
    return glossary.parse_lines(whole.select((F.col("i") + 1).alias("line_no"), "value"))


def glossary_json(spark: SparkSession, path: str) -> DataFrame:
    """``ord, term, translation`` of a list of pairs, or of an object that holds it as ``terms``."""
    raw = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    body = F.when(F.col("v").startswith("["), F.col("v")).otherwise(F.get_json_object("v", "$.terms"))
    return raw.select(F.posexplode(F.from_json(body, "array<struct<term:string,translation:string>>")).alias("ord", "t")).select("ord", "t.term", "t.translation")


def book_memory(spark: SparkSession, path: str) -> DataFrame:
    """Stored books: unknown keys are ignored, missing ones take their defaults, corrupt files are passed over."""
    raw = spark.read.schema(f"{MEMORY}, _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return raw.where("_corrupt is null and book_id is not null").drop("_corrupt").withColumns({
        "terms": F.coalesce("terms", F.expr("filter(array(), x -> false)").cast(raw.schema["terms"].dataType)),
        "show_all_terms": F.coalesce("show_all_terms", F.lit(False)),
        "rejected_terms": F.coalesce("rejected_terms", F.array().cast("array<string>")),
    })


def memory_extras(spark: SparkSession, path: str) -> DataFrame:
    """``book_id, extra``: the keys of stored books that this version does not know, as a VARIANT, so that a rewrite can keep them."""
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("_v"))
    known = ("book_id", "title", "terms", "reader_progress", "show_all_terms", "rejected_terms")
    own = raw.where(F.schema_of_variant("_v").startswith("OBJECT"))
    return own.select(F.try_variant_get("_v", "$.book_id", "string").alias("book_id"), unknown_keys(F.col("_v"), known).alias("extra")).where("book_id is not null")


def catalog(memory: DataFrame) -> DataFrame:
    return memory.select("book_id", "title", F.size("terms").alias("n_terms")).orderBy("book_id")


def terms_of(memory: DataFrame) -> DataFrame:
    return memory.select("book_id", F.posexplode("terms").alias("ord", "t")).select("book_id", "ord", "t.*")


def append_failures(failures: DataFrame, path: str, extra: str | None = None) -> None:
    failure_events(failures, extra).write.mode("append").text(path)


def write_once(df: DataFrame, path: str) -> None:
    """Publishes a table; an existing one is never replaced."""
    df.write.mode("errorifexists").parquet(path)


def write_glossary(terms: DataFrame, path: str) -> None:
    """``term = translation`` lines in order, one file: a glossary is small."""
    glossary.export_lines(terms).orderBy("ord").select("line").coalesce(1).write.mode("errorifexists").text(path)


def report(metrics: DataFrame) -> DataFrame:
    """All columns of one row as one JSON text."""
    return metrics.select(F.to_json(F.struct(*sorted(metrics.columns)), {"ignoreNullFields": "false"}).alias("report"))


def preferences(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``settings``, a map of the JSON object in it, empty if it holds anything else."""
    raw = spark.read.text(path, wholetext=True)
    plain = F.regexp_replace("value", r"^\s+|\s+$", "")
    return raw.select(F.coalesce(F.when(plain.startswith("{"), F.from_json(plain, "map<string,string>")), F.create_map().cast("map<string,string>")).alias("settings"))


def save_preferences(settings: DataFrame, path: str) -> None:
    """Replaces the stored settings (one row with a map ``settings``)."""
    settings.select(F.to_json("settings")).coalesce(1).write.mode("overwrite").text(path)


def numbered(lines: DataFrame, order: str) -> DataFrame:
    """Adds ``ord`` from 0 in the order of a column, counted range by range."""
    return prefix_sums(lines.withColumn("_one", F.lit(1)), [F.col(order)], {"_one": "ord"}).drop("_one")

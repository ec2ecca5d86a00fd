"""Terms in texts: an index join on tokens, and what builds on it.

Texts and terms are cut into the same tokens (whole words, and every other character by itself; blanks are one space).
A term stands where its tokens follow each other, so an occurrence is an equality of token runs: the runs of a text, one per
place and phrase length, are joined to the phrases. No regex is tried per term and each text is read once. A glossary of at most
``BROADCAST_TERMS`` phrases is sent to where the texts lie; for a larger one the runs are shuffled, texts never. Whether and how often a few phrases stand in a
text needs no places: then each is a constant pattern of one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions import text as T

#: Distinct phrases that may be sent to every executor.
BROADCAST_TERMS = 50_000
#: Distinct first tokens that may stand in the plan, to pass over places where no phrase begins.
FILTER_FIRSTS = 2_000


#: Phrases that may stand in the plan as constant patterns.
CONSTANT_TERMS = 64


def phrases(rows: DataFrame, column: str = "term", keep_blanks: bool = False) -> DataFrame:
    """``phrase, tokens, width, first`` of the distinct phrases of a column; blank ones have no tokens and are left out."""
    known = rows.select(F.col(column).alias("phrase")).distinct().withColumn("tokens", T.phrase_tokens("phrase", keep_blanks)).where(F.size("tokens") > 0)
    return known.select("phrase", "tokens", F.size("tokens").alias("width"), F.get("tokens", F.lit(0)).alias("first"))


def _is_word(token: Column) -> Column:
    return F.coalesce(token.rlike(f"^[{T.WORD_CHARS}]"), F.lit(False))


def _patterns(known: DataFrame, keep_blanks: bool, most: int) -> list[tuple[str, str, str]] | None:
    """``phrase, longest token, pattern`` of at most ``most`` phrases; None if there are more."""
    rows = known.select("phrase", "tokens").limit(most + 1).collect()
    if len(rows) > most:
        return None
    edge = f"[{T.WORD_CHARS}]"
    return [(r["phrase"], max(r["tokens"], key=len), f"(?<!{edge}){''.join(T.BLANKS if t == ' ' and not keep_blanks else chr(92) + 'Q' + t + chr(92) + 'E' for t in r['tokens'])}(?!{edge})") for r in rows]


def phrase_counts(units: DataFrame, known: DataFrame, unit: str = "unit_id", keep_blanks: bool = False, most: int | None = None) -> DataFrame:
    """``unit, phrase, n``: how many places of a phrase, none overlapping another, a text has. Each unit is one row."""
    few = _patterns(known, keep_blanks, CONSTANT_TERMS if most is None else most)
    if few is None:
        return placed(units, known, unit=unit, keep_blanks=keep_blanks).select(unit, "phrase", F.size("places").cast("long").alias("n"))
    low = units.select(unit, F.lower(F.coalesce("text", F.lit(""))).alias("_low"))

    def one(phrase: str, token: str, pattern: str) -> Column:
        n = F.when(F.contains("_low", F.lit(token)), F.regexp_count("_low", F.lit(pattern))).otherwise(0)
        return F.struct(F.lit(phrase).alias("phrase"), n.cast("long").alias("n"))

    every = F.array(*[one(*p) for p in few]) if few else F.array().cast("array<struct<phrase:string,n:bigint>>")
    return low.select(unit, F.inline(every)).where("n > 0")


def occurrences(units: DataFrame, known: DataFrame, text: str = "text", unit: str = "unit_id", keep_blanks: bool = False, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """``unit, phrase, width, at``: every place (token number from 0) of every phrase of ``known`` in the texts,
    overlapping ones of one phrase included."""
    cut = units.select(unit, T.phrase_tokens(text, keep_blanks).alias("_t"))
    # as many rows as phrase lengths
    sizes = known.groupBy("width").agg(F.count("*").alias("n"), F.count_distinct("first").alias("firsts")).collect()
    n, few = sum(r["n"] for r in sizes), sum(r["firsts"] for r in sizes) <= FILTER_FIRSTS
    firsts: dict[int, list[str]] = {}
    for r in known.select("width", "first").distinct().collect() if few else ():
        firsts.setdefault(r["width"], []).append(r["first"])

    def run(width: int) -> Column:
        begins = firsts.get(width)
        here = F.col("at") + width <= F.size("_t")
        if begins:
            here &= F.col("own").isin(begins)
        own = F.col("own") if width == 1 else F.concat(*[F.get("_t", F.col("at") + k) for k in range(width)])
        return F.when(here, F.struct(F.lit(width).alias("width"), own.alias("run"), F.get("_t", F.col("at") - 1).alias("before"), F.get("_t", F.col("at") + width).alias("after")))

    # a row per token, passed over in compiled code where no phrase begins
    begun = F.col("own").isin(sorted({t for own in firsts.values() for t in own})) if firsts else F.col("own") != " "
    every = [run(w) for w in sorted(r["width"] for r in sizes)] or [run(1)]
    places = cut.select(unit, "_t", F.posexplode("_t").alias("at", "own")).where(begun)
    opened = places.select(unit, "at", F.explode(F.array(*every)).alias("r") if len(every) > 1 else every[0].alias("r")).where("r is not null").select(unit, "at", "r.*")
    last = F.get("tokens", F.col("width") - 1)
    keyed = known.select("phrase", "width", F.array_join("tokens", "").alias("run"), _is_word(F.col("first")).alias("opens"), _is_word(last).alias("closes"))
    met = opened.join(F.broadcast(keyed) if n <= broadcast_terms else keyed, ["width", "run"])
    # whole words only: next to a phrase that begins or ends with a mark stands no word; words are whole as tokens
    apart = (F.col("opens") | ~_is_word(F.col("before"))) & (F.col("closes") | ~_is_word(F.col("after")))
    return met.where(apart).select(unit, "phrase", "width", "at")


def _apart_places(places: Column, width: Column) -> Column:
    """Places in order, without those that overlap one taken before."""
    taken = F.array().cast("array<int>")
    return F.aggregate(F.array_sort(places), taken, lambda got, at: F.when((F.size(got) == 0) | (F.element_at(got, -1) + width <= at), F.array_append(got, at)).otherwise(got))


def placed(units: DataFrame, known: DataFrame, text: str = "text", unit: str = "unit_id", keep_blanks: bool = False) -> DataFrame:
    """``unit, phrase, width, places``: the places of a phrase in a text, none overlapping another."""
    found = occurrences(units, known, text, unit, keep_blanks).groupBy(unit, "phrase").agg(F.min("width").alias("width"), F.collect_list("at").alias("_at"))
    return found.select(unit, "phrase", "width", F.when(F.col("width") == 1, F.array_sort("_at")).otherwise(_apart_places(F.col("_at"), F.col("width"))).alias("places"))


def matches(units: DataFrame, terms: DataFrame, text: str = "text", unit: str = "unit_id") -> DataFrame:
    """``unit, term`` for every unit that holds a term as whole words, in any case."""
    return _holding(units, phrases(terms), text, unit).select(unit, F.col("phrase").alias("term"))


def _holding(units: DataFrame, known: DataFrame, text: str, unit: str) -> DataFrame:
    """``unit, phrase``, each pair once."""
    few = _patterns(known, False, CONSTANT_TERMS)
    if few is None:
        return occurrences(units, known, text, unit).select(unit, "phrase").distinct()
    low = units.select(unit, F.lower(F.coalesce(text, F.lit(""))).alias("_low"))
    held = [F.when(F.contains("_low", F.lit(token)) & F.regexp_like("_low", F.lit(pattern)), F.lit(phrase)) for phrase, token, pattern in few]
    return low.select(unit, F.explode(F.array_compact(F.array(*held)) if held else F.array().cast("array<string>")).alias("phrase")).distinct()


def relevant_glossary(units: DataFrame, terms: DataFrame, batch: str = "batch") -> DataFrame:
    """``batch, terms``: the sorted distinct terms that any unit of a batch holds."""
    own = _holding(units, phrases(terms), "text", batch)
    return own.groupBy(batch).agg(F.sort_array(F.collect_set("phrase")).alias("terms"))


def affected_units(units: DataFrame, watched: DataFrame) -> DataFrame:
    """Units that hold any of the terms ``term``."""
    return units.join(matches(units, watched).select("unit_id").distinct(), "unit_id", "left_semi")


def inheritance(targets: DataFrame, runs: DataFrame, affected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Old ``targets`` (``run_id``) that stay valid, and the runs to be made anew; ``runs``: ``run_id, unit_id``."""
    redo = runs.join(affected.select("unit_id").distinct(), "unit_id", "left_semi").select("run_id")
    return targets.join(redo, "run_id", "left_anti"), redo


def occurrence_counts(units: DataFrame, terms: DataFrame) -> DataFrame:
    """``unit_id, term, n`` for the terms that occur."""
    return phrase_counts(units, phrases(terms)).select("unit_id", F.col("phrase").alias("term"), "n")


def violations(units: DataFrame, targets: DataFrame, terms: DataFrame) -> DataFrame:
    """``unit_id, term, expected, src_count, tgt_count``: terms of a unit whose translation stands less often in its target.

    A place of a term counts unless it lies within a place of a longer term (of equally long ones, of an earlier one).
    Texts are read once on either side; only places and counts are joined.
    """
    own = terms.select("ord", "term", "translation", (-F.length("term")).alias("size"))
    found = placed(units, phrases(terms)).withColumnRenamed("phrase", "term").join(own, "term")
    every = found.groupBy("unit_id").agg(F.collect_list(F.struct("size", "ord", "term", "translation", "width", "places")).alias("_all"))

    def inside(one: Column, at: Column) -> Column:
        return F.exists("_all", lambda o: (F.struct(o["size"], o["ord"]) < F.struct(one["size"], one["ord"])) & F.exists(o["places"], lambda b: (b <= at) & (at + one["width"] <= b + o["width"])))

    left = F.transform("_all", lambda one: F.struct(one["term"].alias("term"), one["translation"].alias("expected"), F.size(F.filter(one["places"], lambda at: ~inside(one, at))).cast("long").alias("src_count")))
    counted = every.select("unit_id", F.inline(left)).where("src_count > 0")
    answered = targets.where("target <> ''").select("unit_id", F.col("target").alias("text"))
    there = phrase_counts(answered, phrases(terms, "translation", keep_blanks=True), keep_blanks=True).select("unit_id", F.col("phrase").alias("expected"), F.col("n").alias("_n"))
    met = counted.join(answered.select("unit_id"), "unit_id", "left_semi").join(there, ["unit_id", "expected"], "left").withColumn("tgt_count", F.coalesce("_n", F.lit(0)))
    return met.where("tgt_count < src_count").select("unit_id", "term", "expected", "src_count", "tgt_count")


def aligned(source: DataFrame, output: DataFrame) -> DataFrame:
    """One row ``status, source_units, output_units``: verified if both books (``unit_ord, document, text``) have
    the same documents at the same places, else unverifiable."""
    both = source.select("unit_ord", F.col("document").alias("a"), F.lit(1).alias("in_a")).join(output.select("unit_ord", F.col("document").alias("b"), F.lit(1).alias("in_b")), "unit_ord", "full_outer")
    same = both.agg(F.count_if(~(F.col("a").eqNullSafe(F.col("b")) & F.col("in_a").isNotNull() & F.col("in_b").isNotNull())).alias("off"), F.count("in_a").alias("source_units"), F.count("in_b").alias("output_units"))
    return same.select(F.when(F.col("off") == 0, "verified").otherwise("unverifiable").alias("status"), "source_units", "output_units")


def audit_pair(source: DataFrame, output: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The alignment row and the violations, which are empty where the books do not align."""
    status = aligned(source, output)
    units = source.select(F.col("unit_ord").cast("string").alias("unit_id"), "text")
    targets = output.select(F.col("unit_ord").cast("string").alias("unit_id"), F.col("text").alias("target"))
    return status, violations(units, targets, terms).where(F.lit(status.first()["status"] == "verified"))


def audit_summary(status: DataFrame, found: DataFrame, units: DataFrame, terms: DataFrame) -> DataFrame:
    """One row over an audit: its status, units checked, occurrences of terms, of those the ones without their translation,
    and the share that has it (null where there are none)."""
    counted = occurrence_counts(units, terms).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences"))
    missed = found.agg(F.countDistinct("unit_id").alias("units_at_fault"), F.countDistinct("term").alias("terms_at_fault"), F.coalesce(F.sum(F.col("src_count") - F.col("tgt_count")), F.lit(0)).alias("missed"))
    row = status.join(counted).join(missed)
    return row.withColumn("compliance", F.when(F.col("occurrences") > 0, 1 - F.col("missed") / F.col("occurrences")))


def unchanged_long(pairs: DataFrame, over: int = 100) -> DataFrame:
    """Rows of ``text, target`` that are long and equal."""
    return pairs.where((F.length("text") > over) & (F.col("text") == F.col("target")))

"""Candidate terms: eight local rules, the approval router, the merge of verdicts and the discovery log."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from loomspan.functions import text as T

# Titles, the standard mapping of words, stop words and the categories that may pass unseen.
HONORIFICS = ("mr", "mrs", "ms", "dr", "sir", "lady", "professor")
TITLES = {"mr": "tn", "mrs": "ny", "ms": "ny", "dr": "dr", "professor": "profesor", "sir": "sir", "lady": "lady"}
WORD_MAP = {
    "mr": "tn", "mrs": "ny", "ms": "ny", "dr": "dr", "professor": "profesor", "hunter": "pemburu", "coin": "koin",
    "shop": "toko", "bronze": "perunggu", "hounds": "anjing", "hound": "anjing", "dragon": "naga", "fire": "api",
    "beasts": "binatang", "beast": "buas", "weeds": "gulma", "weed": "gulma", "capital": "ibu kota", "horse": "kuda",
    "curio": "barang kuno", "frontier": "perbatasan", "vampire": "vampir",
}
STOPWORDS = ("yang", "di", "ke", "dari", "dan", "atau", "untuk", "dengan", "pada", "adalah", "ini", "itu", "sebuah", "para", "sang", "si", "nya")
SAFE_CATEGORIES = ("person", "place")
RULES = ("R1", "R2", "R3", "R4", "R5", "R6", "R7", "R8")


#: Words are close beyond this ratio.
CLOSE = 0.6


@F.pandas_udf(BooleanType())
def any_close(pairs: pd.Series) -> pd.Series:
    """Whether any pair ``a, b`` of a row is close, but not the same."""
    ratio = lru_cache(1 << 14)(T.matching_ratio)
    return pd.Series([own is not None and any(CLOSE < ratio(x["a"], x["b"]) < 1 for x in own) for own in pairs])


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def _names(term: str) -> Column:
    """Capitalised words of a term, without titles."""
    words = F.regexp_extract_all(F.coalesce(F.col(term), F.lit("")), F.lit("([A-Za-zÀ-ÿ']+)"), 1)
    return F.filter(words, lambda w: (F.left(w, F.lit(1)) == F.upper(F.left(w, F.lit(1)))) & (F.left(w, F.lit(1)) != "'") & ~F.lower(w).isin(*HONORIFICS))


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def findings(candidates: DataFrame, chapter_texts: DataFrame, approved: DataFrame) -> DataFrame:
    """``candidates`` (``ord, chapter, source_term, proposed, supporting_text``) plus ``rules``, the sorted names of the
    rules each one breaks.

    R1 the quote is not in the chapter; R2 a name is neither kept nor mapped; R3 the proposal adds words;
    R4 the term came before; R5 it contradicts an approved one; R6 a word is close to a name but not the same;
    R7 a name was translated; R8 the term is not in its quote.
    """
    prop = F.coalesce("proposed", F.lit(""))
    words = candidates.withColumns({
        "_key": T.plain_text("source_term"), "_names": _names("source_term"), "_src": T.plain_tokens("source_term"), "_prop": T.plain_tokens(prop),
        "_words": F.regexp_extract_all(F.lower(prop), F.lit("([a-zà-ÿ']+)"), 1), "_quote": T.plain_text("supporting_text"),
    })
    texts = chapter_texts.select("chapter", T.plain_text("text").alias("_chapter"))
    known = approved.select(T.plain_text("term").alias("_key"), F.lower(F.trim("translation")).alias("_approved")).groupBy("_key").agg(F.min("_approved").alias("_approved"))
    met = words.join(texts, "chapter", "left").join(known, "_key", "left")
    mapped = _lookup(WORD_MAP)

    def is_mapped(w: Column) -> Column:
        to = F.try_element_at(mapped, F.lower(w))
        return to.isNotNull() & (F.size(F.array_except(T.plain_tokens(to), "_prop")) == 0)

    allowed = F.flatten(F.transform("_src", lambda w: F.coalesce(T.plain_tokens(F.try_element_at(mapped, w)), _no_strings())))
    loose = F.filter("_names", lambda w: ~F.array_contains("_words", F.lower(w)) & ~is_mapped(w))
    title = _lookup(TITLES)
    seen = F.row_number().over(Window.partitionBy("_key").orderBy("ord"))
    close = F.flatten(F.transform(loose, lambda w: F.transform("_words", lambda p: F.struct(F.lower(w).alias("a"), p.alias("b")))))
    judged = met.withColumns({
        "_r1": (F.col("_quote") == "") | F.col("_chapter").isNull() | ~F.contains(F.col("_chapter"), F.col("_quote")),
        "_r2": F.exists("_names", lambda w: ~F.array_contains("_prop", F.lower(w)) & ~is_mapped(w)),
        "_r3": F.size(F.array_except(F.array_except(F.array_except("_prop", F.array(*map(F.lit, STOPWORDS))), "_src"), allowed)) > 0,
        "_r4": seen > 1,
        "_r5": F.coalesce(F.col("_approved") != F.lower(F.trim(prop)), F.lit(False)),
        "_r7": F.exists("_names", lambda w: ~F.array_contains("_words", F.lower(w)) & ~F.coalesce(F.contains(F.lower(prop), F.try_element_at(title, F.lower(w))), F.lit(False))),
        "_r8": (F.trim("source_term") != "") & ~F.regexp_like(F.coalesce("supporting_text", F.lit("")), T.term_pattern("source_term")),
        "_close": close,
    })

    # only pairs whose lengths allow a ratio beyond the bound reach Python
    sized = F.filter("_close", lambda x: (x["a"] != x["b"]) & (2 * F.least(F.length(x["a"]), F.length(x["b"])) > CLOSE * (F.length(x["a"]) + F.length(x["b"]))))
    judged = judged.withColumn("_close", sized).withColumn("_r6", F.when(F.size("_close") > 0, any_close("_close")).otherwise(F.lit(False)))
    broken = F.array_compact(F.array(*[F.when(F.col(f"_r{n}"), F.lit(f"R{n}")) for n in range(1, 9)]))
    return judged.select(*candidates.columns, broken.alias("rules"))


def with_verdicts(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Adds ``verdict, corrected``: the last verdict of each term, provisional without one."""
    own = verdicts.groupBy("source_term").agg(F.max_by(F.struct("verdict", "corrected"), "ord").alias("_v"))
    return candidates.join(own, "source_term", "left").withColumns({"verdict": F.coalesce("_v.verdict", F.lit("provisional")), "corrected": F.col("_v.corrected")}).drop("_v")


def routed(judged: DataFrame, rejected: DataFrame, policy: str = "auto_safe") -> DataFrame:
    """Adds ``decision``: struct ``approved, status, origin, reasons``. ``judged`` has ``source_term, category, rules,
    verdict, corrected``; ``rejected`` has ``key`` in plain form (words in lower case, single blanks)."""
    marked = judged.withColumn("_key", T.plain_text("source_term")).join(rejected.select(F.col("key").alias("_key"), F.lit(True).alias("_no")).distinct(), "_key", "left")

    def decision(approved: bool, status, origin: str, reasons: Column) -> Column:
        return F.struct(F.lit(approved).alias("approved"), (status if isinstance(status, Column) else F.lit(status)).alias("status"), F.lit(origin).alias("origin"), reasons.alias("reasons"))

    usual = F.when(F.col("verdict").isin("verified", "provisional"), F.col("verdict")).otherwise("provisional")
    doubts = F.array_compact(F.array(
        F.when(F.size("rules") > 0, F.concat(F.lit("findings: "), F.array_join("rules", ", "))),
        F.when(F.col("verdict") != "verified", F.concat(F.lit("verdict: "), F.col("verdict"))),
        F.when(~F.coalesce(F.lower("category").isin(*SAFE_CATEGORIES), F.lit(False)), F.concat(F.lit("category: "), F.lower(F.coalesce("category", F.lit(""))))),
        F.when(F.coalesce("corrected", F.lit("")) != "", F.lit("correction suggested")),
    ))
    held = F.when(F.col("verdict") != "verified", F.col("verdict")).otherwise("provisional")
    review = F.lit(policy == "review_first")
    out = (
        F.when(F.coalesce("_no", F.lit(False)), decision(False, "rejected", "pending", F.array(F.lit("rejected before"))))
        .when(F.array_contains("rules", "R5"), decision(False, "ambiguous", "pending", F.array(F.lit("contradicts an approved term"))))
        .when(F.col("verdict") == "ambiguous", decision(False, "ambiguous", "pending", F.array(F.lit("verdict: ambiguous"))))
        .when(review, decision(False, usual, "pending", F.array(F.lit("review first"))))
        .when(F.size(doubts) > 0, decision(False, held, "pending", doubts))
        .otherwise(decision(True, "verified", "auto", F.array(F.lit("all conditions met"))))
    )
    return marked.withColumn("decision", out).drop("_key", "_no")


def effective_policy(policy: str, verifies: bool) -> str:
    """Nothing is approved by itself without a verifier."""
    return policy if verifies else "review_first"


def verified(candidates: DataFrame, verify, batch: int = 50) -> DataFrame:
    """``ord, source_term, verdict, corrected`` from an injected function: it takes the rows of a chapter (dicts), at most ``batch`` at a
    time, and gives as many ``(verdict, corrected)``. An answer of another length, or an error, leaves its rows provisional."""
    from collections.abc import Iterator

    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for _, own in pdf.groupby("chapter", sort=False):
                for at in range(0, len(own), batch):
                    part = own.iloc[at : at + batch]
                    try:
                        answers = list(verify(part.to_dict("records")))
                    except Exception:  # a remote verifier may fail in any way; its rows wait for a person
                        answers = []
                    if len(answers) != len(part):
                        answers = [("provisional", None)] * len(part)
                    yield pd.DataFrame({"ord": part["ord"], "source_term": part["source_term"], "verdict": [a for a, _ in answers], "corrected": [b for _, b in answers]})

    dealt = candidates.repartition("chapter").sortWithinPartitions("chapter", "ord")
    return dealt.mapInPandas(run, "ord long, source_term string, verdict string, corrected string")


def with_instructions(rows: DataFrame, texts: DataFrame, name: str = "profile") -> DataFrame:
    """Adds ``instruction`` and ``instruction_tokens`` from a table ``name, text``; an unknown or null name adds nothing."""
    own = texts.select(F.col("name").alias(name), F.col("text").alias("instruction"))
    met = rows.join(own, name, "left").withColumn("instruction", F.coalesce("instruction", F.lit("")))
    return met.withColumn("instruction_tokens", F.when(F.col("instruction") != "", T.text_tokens("instruction")).otherwise(F.lit(0)))


def discovery_counts(decided: DataFrame) -> DataFrame:
    """``chapter, discovered, auto_approved, pending, rejected``."""
    d = F.col("decision")
    return decided.groupBy("chapter").agg(
        F.count("*").alias("discovered"), F.count_if(d["approved"]).alias("auto_approved"),
        F.count_if(~d["approved"] & (d["status"] != "rejected")).alias("pending"), F.count_if(d["status"] == "rejected").alias("rejected"),
    )


def unpublished(chapters: DataFrame, log: DataFrame) -> DataFrame:
    """Chapters whose stage has not been logged as published: the rest need not run again."""
    return chapters.join(log.where("status = 'published'").select("chapter"), "chapter", "left_anti")


def discovery_text(texts: DataFrame, most: int = 60_000) -> DataFrame:
    """``chapter, paragraphs``: the head of a chapter, cut at its last empty line, as numbered paragraphs without blanks around."""
    short = F.left("text", F.lit(most))
    last = F.length(F.substring_index(short, "\n\n", -1))
    cut = F.when((F.length("text") > most) & F.contains(short, F.lit("\n\n")), F.left(short, F.length(short) - last - 2)).otherwise(short)
    parts = F.filter(F.transform(F.split(cut, r"\n\n"), lambda p: F.regexp_replace(p, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), lambda p: p != "")
    return texts.select("chapter", F.array_join(F.transform(parts, lambda p, i: F.concat(F.lit("[P"), (i + 1).cast("string"), F.lit("] "), p)), "\n\n").alias("paragraphs"))

"""Glossaries as rows: parsing, visibility in time, conflicts, differences and what they affect.

Columns: ``ord`` (first wins), ``term``, ``translation``, and where needed ``approved``, ``status``,
``source_chapter``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import text as T


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``line_no, term, translation, fault`` from rows ``line_no, value`` of ``term = translation`` or ``term => translation``.

    Comments and blank lines vanish; ``fault`` is null, ``form``, ``empty`` or ``duplicate``.
    """
    line = F.regexp_replace(column, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    mark = F.when(F.contains(F.col("line"), F.lit("=>")), F.lit("=>")).otherwise(F.lit("="))
    kept = lines.select("line_no", line.alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    cut = kept.withColumn("at", F.locate("=", F.col("line"))).withColumn("at", F.when(mark == "=>", F.instr(F.col("line"), F.lit("=>"))).otherwise(F.instr(F.col("line"), F.lit("="))))

    def trimmed(x):
        return F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")

    term = F.when(F.col("at") > 0, trimmed(F.substr(F.col("line"), F.lit(1), F.col("at") - 1)))
    translation = F.when(F.col("at") > 0, trimmed(F.substr(F.col("line"), F.col("at") + F.length(mark))))
    parsed = cut.select("line_no", term.alias("term"), translation.alias("translation"))
    seen = F.row_number().over(Window.partitionBy("term").orderBy("line_no"))
    fault = F.when(F.col("term").isNull(), "form").when((F.col("term") == "") | (F.col("translation") == ""), "empty").when(seen > 1, "duplicate")
    return parsed.withColumn("fault", fault)


def export_lines(terms: DataFrame) -> DataFrame:
    return terms.select("ord", F.concat_ws(" = ", "term", "translation").alias("line"))


def usable(terms: DataFrame, approved_only: bool = True) -> DataFrame:
    """Terms with both sides, first occurrence of each."""
    own = terms.where("coalesce(term, '') <> '' and coalesce(translation, '') <> ''")
    if approved_only:
        own = own.where("approved")
    return own.withColumn("_n", F.row_number().over(Window.partitionBy("term").orderBy("ord"))).where("_n = 1").drop("_n")


def as_of(chapters: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms that each ``chapter`` may use: usable ones without a source chapter or from an earlier one.

    The distinct chapter numbers of a book are few; each term is opened into those it may serve.
    """
    numbers = sorted(r["chapter"] for r in chapters.select("chapter").distinct().collect() if r["chapter"] is not None)
    own = terms.where("approved and coalesce(term, '') <> '' and coalesce(translation, '') <> ''")
    every = F.array(*[F.lit(n) for n in numbers]).cast(f"array<{chapters.schema['chapter'].dataType.simpleString()}>")
    met = own.select("ord", "term", "translation", "source_chapter", F.explode(F.filter(every, lambda c: F.col("source_chapter").isNull() | (F.col("source_chapter") < c))).alias("chapter"))
    first = F.row_number().over(Window.partitionBy("chapter", "term").orderBy("ord"))
    return met.withColumn("_n", first).where("_n = 1").select("chapter", "ord", "term", "translation", "source_chapter")


def pending(terms: DataFrame, rejected: DataFrame) -> DataFrame:
    """Neither approved nor rejected, and not among the rejected keys ``key``."""
    own = terms.where("not approved and status <> 'rejected'").withColumn("key", T.norm_term("term"))
    return own.join(rejected.select("key").distinct(), "key", "left_anti").drop("key")


def visible(terms: DataFrame, progress: int | None = None, show_all: bool = False) -> DataFrame:
    """What a reader may see. Without a stated progress, anything beyond chapter 1 hides as soon as there is any."""
    if show_all:
        return terms
    if progress is not None:
        return terms.where(F.col("source_chapter").isNull() | (F.col("source_chapter") <= progress))
    return terms.where(F.col("source_chapter").isNull() | (F.col("source_chapter") <= 1))


def spoiler_safe_export(terms: DataFrame, progress: int | None = None) -> DataFrame:
    return export_lines(usable(visible(terms, progress)))


def notes_for_chapter(notes: DataFrame, chapter: int | None) -> DataFrame:
    """Notes known by ``chapter``; ``warning`` where the note's start cannot be read (it then stays)."""
    start = T.known_from("known_from")
    unreadable = (F.trim(F.coalesce("known_from", F.lit(""))) != "") & start.isNull()
    own = notes.withColumn("warning", unreadable)
    return own if chapter is None else own.where(start.isNull() | (start <= chapter))


def character_block(notes: DataFrame, head: str, most: int = 1500, cut_mark: str = "…(cut)") -> DataFrame:
    """One row ``block``: the head and a line per note, cut at a line end if that keeps half.

    A line has more than one character, so the first ``most`` notes fill the block: no more of them meet in the row.
    """
    parts = F.concat_ws(
        "; ", "name",
        F.when(F.size("aliases") > 0, F.concat(F.lit("alias: "), F.array_join("aliases", ", "))),
        *[F.when(F.col(c) != "", F.concat(F.lit(f"{label}: "), F.col(c))) for c, label in (("title", "title"), ("relationships", "relations"), ("register_note", "register"))],
    )
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.lit("- "), parts).alias("line")))), lambda x: x["line"])
    whole = notes.orderBy("ord").limit(most + 1).agg(F.when(F.count("*") > 0, F.concat_ws("\n", F.array(F.lit(head)), lines)).otherwise("").alias("whole"))
    short = F.left("whole", F.lit(most))
    kept = F.regexp_replace(short, "(?s)\n[^\n]*$", "")
    cut = F.when(F.length(kept) < most // 2, short).otherwise(kept)
    return whole.select(F.when(F.length("whole") > most, F.concat(cut, F.lit("\n" + cut_mark))).otherwise(F.col("whole")).alias("block"))


def _is_word(token: Column) -> Column:
    return F.coalesce(token.rlike(f"^[{T.WORD_CHARS}]"), F.lit(False))


def conflicts(terms: DataFrame) -> DataFrame:
    """``kind, term_a, term_b``: later rows with the key of a first one (same or other translation), and keys
    that stand as whole words inside another key.

    Overlaps are found by an index: each run of tokens of a key is looked up among the keys by equality, so no pair of
    keys is formed that does not overlap, however many keys share a word.
    """
    keyed = terms.withColumn("key", T.norm_term("term")).where("key <> ''").withColumn("_t", T.norm_term("translation"))
    order = Window.partitionBy("key").orderBy("ord")
    marked = keyed.withColumns({"_n": F.row_number().over(order), "_first": F.first("term").over(order), "_same": F.first("_t").over(order)})
    kind = F.when(F.col("_same").eqNullSafe(F.col("_t")), "duplicate").otherwise("translation_mismatch")
    repeats = marked.where("_n > 1").select(kind.alias("kind"), F.col("_first").alias("term_a"), F.col("term").alias("term_b"))
    firsts = marked.where("_n = 1").select("key", "term", "ord")
    whole = firsts.withColumn("_w", T.phrase_tokens("key"))
    # a short key is looked up among the runs of tokens, of the lengths that keys have, of each longer one
    widths = sorted(r["n"] for r in whole.select(F.size("_w").alias("n")).distinct().collect())  # as many rows as lengths
    inner = whole.select(F.col("key").alias("short"), F.col("term").alias("s_term"), F.col("ord").alias("s_ord"), F.array_join("_w", "").alias("_run"), F.size("_w").alias("_n"), _is_word(F.get("_w", F.lit(0))).alias("_opens"), _is_word(F.element_at("_w", -1)).alias("_closes"))
    starts = F.sequence(F.lit(0), F.size("_w") - 1)
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.filter(F.array(*map(F.lit, widths or [1])), lambda n: i + n <= F.size("_w")), lambda n: F.struct(F.array_join(F.slice("_w", i + 1, n), "").alias("run"), n.alias("n"), F.get("_w", i - 1).alias("before"), F.get("_w", i + n).alias("after")))))
    outer = whole.select(F.col("key").alias("long"), F.col("term").alias("l_term"), F.col("ord").alias("l_ord"), F.explode(F.array_distinct(runs)).alias("_r")).select("long", "l_term", "l_ord", F.col("_r.run").alias("_run"), F.col("_r.n").alias("_n"), "_r.before", "_r.after")
    apart = (F.col("_opens") | ~_is_word(F.col("before"))) & (F.col("_closes") | ~_is_word(F.col("after")))
    met = outer.join(inner, ["_run", "_n"]).where((F.col("short") != F.col("long")) & apart).dropDuplicates(["short", "long"])
    before = F.col("s_ord") < F.col("l_ord")
    overlaps = met.select(F.lit("overlap").alias("kind"), F.when(before, F.col("s_term")).otherwise(F.col("l_term")).alias("term_a"), F.when(before, F.col("l_term")).otherwise(F.col("s_term")).alias("term_b"))
    return repeats.unionByName(overlaps)


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """``change, ord, term``: rows added, removed or changed (translation or approval) between two glossaries.

    Of equal keys the last row speaks for the key; all original rows of a differing key are named.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        own = df.where("coalesce(term, '') <> ''").withColumn("key", T.norm_term("term")).withColumn("sig", F.struct(T.norm_term("translation").alias("t"), F.coalesce("approved", F.lit(False)).alias("a")))
        rows = F.array_sort(F.collect_list(F.struct("ord", "term")))
        return own.groupBy("key").agg(F.max_by("sig", "ord").alias(f"{name}_sig"), rows.alias(f"{name}_rows"))

    both = side(old, "old").join(side(new, "new"), "key", "full_outer")
    change = F.when(F.col("old_rows").isNull(), "added").when(F.col("new_rows").isNull(), "removed").when(~F.col("old_sig").eqNullSafe(F.col("new_sig")), "changed")
    named = both.withColumn("change", change).where("change is not null")
    return named.select("change", F.explode(F.coalesce("new_rows", "old_rows")).alias("r")).select("change", "r.ord", "r.term")


def fingerprint(terms: DataFrame) -> DataFrame:
    """One row: 16 hex digits over the sorted pairs."""
    pairs = F.array_sort(F.collect_list(F.array(F.lower("term"), "translation")))
    return usable(terms, False).agg(F.left(F.sha2(F.to_json(pairs), 256), F.lit(16)).alias("fingerprint"))


def manual_wins(auto: DataFrame, manual: DataFrame) -> DataFrame:
    """Automatic rows whose key, in any case, no manual row has, and all manual rows."""
    free = auto.withColumn("_k", F.lower("term")).join(manual.select(F.lower("term").alias("_k")).distinct(), "_k", "left_anti").drop("_k")
    return free.unionByName(manual)


def unknown_candidates(candidates: DataFrame, terms: DataFrame) -> DataFrame:
    """Candidates whose key no term has; first of each key."""
    own = candidates.withColumn("key", T.norm_term("source_term")).join(terms.select(T.norm_term("term").alias("key")).distinct(), "key", "left_anti")
    return own.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("ord"))).where("_n = 1").drop("_n", "key")


def reviewed(terms: DataFrame, decisions: DataFrame, at: str) -> DataFrame:
    """Applies ``term, action`` (approve, reject, suggest): the state before is appended to ``history``."""
    joined = terms.join(decisions.select("term", "action"), "term", "left")
    past = F.struct(F.col("translation"), F.col("approved"), F.col("status"), F.lit(at).alias("at"), F.lit("review").alias("by"))
    acted = F.col("action").isNotNull()
    history = F.when(acted, F.concat(F.coalesce("history", F.array().cast("array<struct<translation:string,approved:boolean,status:string,at:string,by:string>>")), F.array(past))).otherwise(F.col("history"))
    return joined.withColumn("history", history).withColumns({
        "translation": F.when((F.col("action") == "suggest") & (F.coalesce("suggested_fix", F.lit("")) != ""), F.col("suggested_fix")).otherwise(F.col("translation")),
        "approved": F.when(F.col("action").isin("approve", "suggest"), True).when(F.col("action") == "reject", False).otherwise(F.col("approved")),
        "status": F.when(F.col("action").isin("approve", "suggest"), "verified").when(F.col("action") == "reject", "rejected").otherwise(F.col("status")),
    }).drop("action")

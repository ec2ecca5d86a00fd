"""Mixing sources to target weights.

Sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ... and share the size of the whole
table; a target stops at ``MOST`` times its source's size and the excess is shared anew by weight, that
is, all sources below their cap get the same amount per unit of weight. Each document gets a
hash-random key. Documents are range-sorted by source and key, so a source of any size lies in as many ranges as it fills;
sums of the ranges are scanned into offsets, and offset plus running
sum is the document's place in its source's stream. The stream is repeated for whole epochs and cut at
the exact word where the budget ends; the one document at the cut is taken in part. Sources are ranked and their
targets found by the same distributed prefix sums: their number may grow with the table.

Sizes and places are integers, hence reruns agree. Texts do not move for the plan: only (source, key, id, size)
rows are shuffled. ``mixed_documents`` shuffles them once.

Defined cases: null text has size 0; a null source is a source of its own, last in order; a source of
size 0 has target 0; very long texts are counted whole and may be cut at the budget's end; equal keys go by id (nulls last), then by text; rows repeated
under one id take consecutive places (which of them share a range does not matter: places of whole repeats are interchangeable); an empty table gives an
empty result; other columns of the input do not matter, whatever their names, and pass through ``mixed_documents``
(where ``n_chars`` follows the text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from loomspan.llm.common import free_names, row_keys, text_key
from loomspan.operators.ranges import prefix_sums
from loomspan.storage import materialize

WEIGHTS = (1, 2, 3)
MOST = 3
#: Up to so many sources are ranked in one window, and so many texts at a cut broadcast; more go by ranges and joins.
FEW = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column) -> Column:
    """128 bits of hash as 32 hex digits; the same for every run and engine."""
    return F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def _exact(x: str, digits: int) -> Column:
    return F.col(x).cast(f"decimal({digits},0)")


def _sums_before(rows: DataFrame, order: list[Column], sums: dict[str, str], few: bool) -> DataFrame:
    """``prefix_sums``; a ``few`` rows, as counted, are summed in one window."""
    if not few:
        return prefix_sums(rows, order, sums)
    before = Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({name: F.coalesce(F.sum(c).over(before), F.lit(0)) for c, name in sums.items()})


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from one row ``source, source_size`` per source.

    Sources fill up in the order of cap per weight: with the first k capped, the rest share what is
    left by weight; k is the least number for which no other source is above its cap. From there on none is.
    """
    known = sizes.select("source", "source_size", F.col("source").isNull().alias("_none"), F.lit(1).cast("long").alias("_one"))
    few = sizes.limit(FEW + 1).count() <= FEW
    ranked = _sums_before(known, [F.col("_none"), F.col("source")], {"_one": "_rank"}, few)
    weigh = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    weighed = ranked.withColumn("w", weigh).withColumn("cap", F.col("source_size") * most).withColumn("_fill", F.col("cap") / F.col("w"))
    filled = materialize(_sums_before(weighed, [F.col("_fill"), F.col("_none"), F.col("source")], {"cap": "_capped", "w": "_lighter"}, few))
    whole = filled.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
    if whole["size"] is None:
        return sizes.select("source", "source_size", F.lit(0.0).alias("target"))
    # uncapped: its share of what the sources before it leave is within its cap
    shared = filled.withColumns({"_left": F.lit(whole["size"]) - F.col("_capped"), "_weights": F.lit(whole["w"]) - F.col("_lighter")})
    free = shared.withColumn("_free", _exact("_left", 20) * _exact("w", 17) <= _exact("cap", 20) * _exact("_weights", 17))
    cut = free.where("_free").agg(F.min_by(F.struct("_left", "_weights"), F.struct("_fill", "_none", "source")).alias("at")).first()["at"]
    level = F.lit(None).cast("double") if cut is None else (F.col("w") * cut["_left"]).cast("double") / cut["_weights"]
    return free.select("source", "source_size", F.when(F.col("_free"), level).otherwise(F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, text_key, source, size, source_size, target, taken, epochs, partial`` for each row of ``docs``.

    ``taken = epochs * size + partial``: how often the mix takes the whole text, and how many of its
    first words once more.
    """
    source = F.col(source_col).cast("string")
    narrow = docs.select(
        source.isNull().alias("none"),
        F.coalesce(source, F.lit("")).alias("name"),
        F.col(id_col).cast("long").alias("doc_id"),
        text_key(F.col(text_col)).alias("text_key"),
        word_count(F.col(text_col)).alias("size"),
        random_key(F.col(id_col)).alias("key"),
    )
    # rows repeated whole differ in their place in the file only: by it they fill as many ranges as they need
    rows = materialize(narrow).select("*", F.col("_metadata.row_index").alias("tie"))
    sizes = materialize(rows.groupBy("none", "name").agg(F.sum("size").alias("source_size")))
    targets = source_targets(sizes.select(F.when(~F.col("none"), F.col("name")).alias("source"), "source_size"))
    targets = targets.select(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"), "source_size", "target")
    order = [F.col("none"), F.col("name"), F.col("key"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"), F.col("size"), F.col("tie")]
    joined = prefix_sums(rows, order, {"size": "place"}, ["none", "name"]).join(targets, ["none", "name"])
    budget = F.floor(F.col("target")).cast("long")
    placed = (
        joined.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0)).cast("long"))
        .withColumn("left", budget - F.col("epochs") * F.col("source_size"))
        .withColumn("partial", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("place"))))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.col("partial"))
    )
    return placed.select("doc_id", "text_key", F.when(~F.col("none"), F.col("name")).alias("source"), "size", "source_size", "target", "taken", "epochs", "partial")


def op4_mixing(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every document."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def _mix_keys(doc_id: Column, key: Column, source: Column) -> list[Column]:
    k1, k2 = row_keys(doc_id, key)
    return [k1, F.xxhash64(k2, source.isNull(), source)]


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each text once per epoch, and once more, cut after ``partial`` words, at the budget's end.

    Columns as in ``docs``; documents that the mix does not reach are not in it. Of rows that share id, text and source
    any may be the one whose further copies stand at the cut. A row learns from its group's sums how often it is
    taken, so groups of any size are neither listed nor numbered, and a join that meets a large one can be split.
    """
    k1, k2, own, copies, words = free_names(docs, "k1", "k2", "own", "copies", "words")
    plan = mix(docs, id_col, text_col, source_col)
    keys = [c.alias(k) for c, k in zip(_mix_keys(F.col("doc_id"), F.col("text_key"), F.col("source")), (k1, k2))]
    sums = plan.groupBy(*keys).agg(F.first("epochs").alias("epochs"), F.first("size").alias("size"), F.sum("partial").alias("rest"), F.count("*").alias("members")).where("size > 0 and (epochs > 0 or rest > 0)")
    # the last epoch takes all rows of a group, or none, or ends among them: that happens once a source
    groups = materialize(sums.select(k1, k2, F.struct("epochs", "size", "rest", F.expr("rest > 0 and rest < members * size").alias("ends")).alias(own)))
    keyed = docs.withColumns(dict(zip((k1, k2), _mix_keys(F.col(id_col), text_key(F.col(text_col)), F.col(source_col).cast("string")))))

    def repeated(rows: DataFrame, whole: Column, begun: Column) -> DataFrame:
        """Each row ``whole`` times, and once more with its first ``begun`` words, where these are any."""
        cut = F.when(begun > 0, F.array(begun.cast("int"))).otherwise(F.array().cast("array<int>"))
        opened = rows.withColumn(words, F.explode(F.concat(F.array_repeat(F.lit(-1), whole.cast("int")), cut)))
        first = F.slice(F.regexp_extract_all(F.col(text_col), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1), F.lit(1), F.greatest(F.col(words), F.lit(0)))
        return opened.withColumn(text_col, F.when(F.col(words) >= 0, F.array_join(first, "")).otherwise(F.col(text_col))).select(*docs.columns)

    more = F.when((F.col(f"{own}.rest") > 0) & ~F.col(f"{own}.ends"), 1).otherwise(0)
    even = repeated(keyed.join(groups, [k1, k2]), F.col(f"{own}.epochs") + more, F.lit(0))
    ends = groups.where(F.col(f"{own}.ends"))
    ends = F.broadcast(ends) if ends.limit(FEW + 1).count() <= FEW else ends
    plain = [F.col(f.name) for f in docs.schema if not isinstance(f.dataType, (MapType, VariantType))]
    one = keyed.join(ends, [k1, k2]).groupBy(k1, k2).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*plain)).alias(copies), F.first(own).alias(own))
    last = repeated(one.select(f"{copies}.*", own), F.expr(f"`{own}`.rest div `{own}`.size"), F.col(f"{own}.rest") % F.col(f"{own}.size"))
    out = even.unionByName(last)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(F.col(text_col)).cast(docs.schema["n_chars"].dataType))
    return out


def oracle_sql(weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> str:
    """The same mix in DuckDB SQL."""
    cases = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return f"""
WITH d AS (SELECT doc_id, source, length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 'x', 'g'), '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS size,
                  md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(weights)} {cases} END AS w, source_size * {most} AS cap FROM s),
f AS (SELECT *, row_number() OVER o AS k, sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM w WINDOW o AS (ORDER BY cap::DOUBLE / w, source IS NULL, source)),
c AS (SELECT min(k) AS cut FROM f WHERE rest * w <= cap * share),
l AS (SELECT rest AS r, share AS h, k AS cut FROM f WHERE k = (SELECT cut FROM c)),
t AS (SELECT f.source, f.source_size, CASE WHEN l.cut IS NULL OR f.k < l.cut THEN f.cap::DOUBLE ELSE (f.w * l.r)::DOUBLE / l.h::DOUBLE END AS target FROM f LEFT JOIN l ON true),
p AS (SELECT d.*, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN (budget // source_size) * size + greatest(0, least(size, budget % source_size - place)) ELSE 0 END)::BIGINT AS taken FROM p
"""

"""Token-bounded batches of units in reading order.

Where a batch ends depends only on where it begins. So every unit is asked for the end of a batch that would begin there (a search on
prefix sums, block by block), and the batches of a book are what its first unit reaches. Inside a block the jumps are doubled in
arrays; the few places at which a chain can enter a block are doubled as rows, in as many rounds as the number of blocks has bits. No task holds a
book, and no fold runs along it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators.ranges import parted, prefix_sums
from loomspan.storage import checkpointed, materialize

#: Units of a block, and the most that one request takes.
BLOCK = 4096


def placed(units: DataFrame, *order: str) -> DataFrame:
    """Adds ``place`` to ``book`` and the columns ``order`` (else ``unit_ord``): the number of the unit in its book, from 0."""
    own = units.select("*", *parted("book"), F.lit(1).cast("long").alias("_one"))
    by = [F.col("_none"), F.col("_name"), *map(F.col, order or ("unit_ord",))]
    return prefix_sums(own, by, {"_one": "place"}, ["_none", "_name"]).drop("_none", "_name", "_one")


def payloads(runs: DataFrame, single: bool = False) -> DataFrame:
    """One row per unit of ``book, document, unit_ord, unit_id, run_ord, run_id, text, style, prefix, suffix, context``: what a request
    says of it. ``payload`` (JSON with ids, texts, formats, blanks around, and the context where it says more than the unit), ``tokens`` of it, ``source_tokens`` of its texts,
    ``overhead_tokens`` of an answer without texts, and the unit's whole ``text``. ``single``: every unit is one run, so nothing need be gathered.
    """
    run = F.struct("run_ord", F.struct(F.col("run_id").alias("id"), "text", F.when(F.col("style") != "", F.col("style")).alias("format"), F.when(F.col("prefix") != "", True).alias("space_before"), F.when(F.col("suffix") != "", True).alias("space_after")).alias("r"), "prefix", "suffix")
    unit = ["book", "document", "unit_ord", "unit_id"]
    if single:
        own = runs.select(*unit, F.array(run).alias("_runs"), "context")
    else:
        own = runs.groupBy(*unit).agg(F.array_sort(F.collect_list(run)).alias("_runs"), F.first("context", ignorenulls=True).alias("context"))
    text = F.array_join(F.transform("_runs", lambda x: F.concat(F.coalesce(x["prefix"], F.lit("")), x["r"]["text"], F.coalesce(x["suffix"], F.lit("")))), "")

    def plain(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(x, T.BLANKS, " "), "^ | $", "")

    context = F.when(plain(F.col("context")) != plain(F.col("_text")), F.col("context"))
    payload = F.to_json(F.struct(F.col("unit_id").alias("id"), F.transform("_runs", lambda x: x["r"]).alias("runs"), context.alias("context")))
    empty = F.to_json(F.struct(F.col("unit_id").alias("id"), F.transform("_runs", lambda x: F.struct(x["r"]["id"].alias("id"), F.lit("").alias("text"))).alias("runs")))
    # the payload is measured as its frame and its texts, which quotes keep apart; most frames are the empty answer, and most texts the unit's own
    frame = F.to_json(F.struct(F.col("unit_id").alias("id"), F.transform("_runs", lambda x: x["r"].withField("text", F.when(x["r"]["text"].isNotNull(), F.lit("")))).alias("runs"), context.alias("context")))
    texts = F.transform(F.filter("_runs", lambda x: x["r"]["text"].isNotNull()), lambda x: x["r"]["text"])
    quoted = own.withColumn("_text", text).withColumns({"_empty": empty, "_frame": frame, "_texts": F.to_json(texts), "_marks": F.greatest(3 * F.size(texts) + 1, F.lit(2))})
    said = quoted.withColumns({"_empty_n": T.token_pieces("_empty"), "_text_n": T.token_pieces("_text")})
    frame_n = F.when(F.col("_frame") == F.col("_empty"), F.col("_empty_n")).otherwise(T.token_pieces("_frame"))
    texts_n = F.when(F.col("_texts") == F.concat(F.lit('["'), "_text", F.lit('"]')), F.col("_text_n")).otherwise(T.token_pieces("_texts") - F.col("_marks"))
    sizes = {"tokens": frame_n + texts_n, "source_tokens": T.tokens_of(F.col("_text_n"), "_text"), "overhead_tokens": F.col("_empty_n")}
    return said.select("book", "document", "unit_ord", "unit_id", F.col("_text").alias("text"), payload.alias("payload"), *[n.alias(name) for name, n in sizes.items()])


def with_terms(units: DataFrame, found: DataFrame, terms: DataFrame) -> DataFrame:
    """Adds ``terms`` (``array<struct<term, tokens>>``): the glossary entries that a request needs for the unit.
    ``found``: ``unit_id, term``; ``terms``: ``term, translation``."""
    entry = T.text_tokens(F.to_json(F.struct("term", "translation"))).alias("tokens")
    own = found.join(terms.select("term", entry), "term").groupBy("unit_id").agg(F.collect_set(F.struct("term", "tokens")).alias("terms"))
    return units.join(own, "unit_id", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<struct<term:string,tokens:bigint>>")))


def paragraph_marks(units: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds ``starts_paragraph`` to ``book, unit_ord, document, block_key, unit_id, run_stem``: whether a paragraph border lies before the unit; and
    ``place``, unless the units have it. A block of places is looked at with the last unit of the block before."""
    numbered = units if "place" in units.columns else placed(units)
    own = F.floor(F.col("place") / block)
    last = F.col("place") % block == block - 1
    dealt = numbered.select("*", *parted("book"), F.explode(F.when(last, F.array(own, own + 1)).otherwise(F.array(own))).alias("_block"))
    order = Window.partitionBy("_none", "_name", "_block").orderBy("place")

    def before(c: str):
        return F.lag(c).over(order)

    both = (F.coalesce("block_key", F.lit("")) != "") & (F.coalesce(before("block_key"), F.lit("")) != "")
    border = (
        F.when(before("unit_id").isNull(), True)
        .when(~F.col("document").eqNullSafe(before("document")), True)
        .when(both, F.col("block_key") != before("block_key"))
        .when(F.col("run_stem").eqNullSafe(before("run_stem")), False)
        .otherwise(F.col("unit_id") != before("unit_id"))
    )
    return dealt.withColumn("starts_paragraph", border).where(F.col("_block") == own).drop("_none", "_name", "_block")


class Limits:
    """What a request may hold: estimates over arrays of summed sizes."""

    def __init__(self, target: int, output_limit: int, ratio: float, base: int, floor: float, factor: float, samples: int) -> None:
        self.target, self.output_limit, self.ratio, self.base, self.floor = target, output_limit, ratio, base, floor
        self.correct = factor * (1.05 if samples else 1.12)

    def estimate(self, tokens: np.ndarray) -> np.ndarray:
        return np.ceil((self.base + tokens + 128) * self.correct).astype(np.int64) + 64

    def fits(self, tokens: np.ndarray, source: np.ndarray, overhead: np.ndarray) -> np.ndarray:
        return (self.estimate(tokens) <= self.target) & (np.ceil(source * self.ratio).astype(np.int64) + overhead + 2048 <= self.output_limit * 0.9)


class _Entries:
    """Glossary entries of the units of a block, each at the units that need it; ``before``: the unit that needed it last (-1: none here)."""

    def __init__(self, unit: np.ndarray, term: np.ndarray, tokens: np.ndarray, units: int) -> None:
        order = np.lexsort((unit, term))
        before = np.where(np.r_[False, term[order][1:] == term[order][:-1]], np.r_[-1, unit[order][:-1]], -1)
        back = np.argsort(unit[order], kind="stable")
        self.unit, self.before, self.tokens = unit[order][back], before[back], tokens[order][back]
        self.cuts = np.searchsorted(self.unit, np.arange(units + 1))  # the entries before each unit
        self.sums = np.r_[0, np.cumsum(self.tokens)]
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def fresh(self, start: np.ndarray, frm: np.ndarray, step: int) -> np.ndarray:
        """Tokens of the entries of units ``frm`` to ``frm + step`` (a multiple of ``step``) that no unit from ``start`` to ``frm`` needed;
        for units before ``start``, of all entries."""
        if not len(self.unit):
            return np.zeros(len(start), np.int64)
        if step not in self.levels:  # within each stretch of ``step`` units, by the unit before
            width = len(self.cuts) + 1
            keys = self.unit // step * width + self.before + 1
            order = np.argsort(keys, kind="stable")
            self.levels[step] = keys[order], np.r_[0, np.cumsum(self.tokens[order])]
        keys, sums = self.levels[step]
        stretch = frm // step * (len(self.cuts) + 1)
        return sums[np.searchsorted(keys, stretch + start + 1)] - sums[np.searchsorted(keys, stretch)]


def next_starts(tokens: np.ndarray, source: np.ndarray, overhead: np.ndarray, starts: np.ndarray, entries: _Entries, limits: Limits, own: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the first ``own`` units: where the batch that begins there ends, and its estimated size.

    The last fitting unit is found bit by bit for all units at once: the sizes up to a place are prefix sums, and an entry counts where the unit that needed it before lies
    before the batch. If that end lies in a paragraph and the whole paragraphs fill the request well, the batch ends with them.
    """
    n = len(tokens)
    t, s, o = (np.r_[0, np.cumsum(x)] for x in (tokens, source, overhead))
    start = np.arange(own)
    gone = entries.sums[entries.cuts[start]]
    at, seen = np.zeros(own, np.int64), np.zeros(own, np.int64)
    for bit in range(max(n, 1).bit_length(), -1, -1):
        step = 1 << bit
        to = at + step
        can = to <= np.minimum(n, start + block)
        end = np.minimum(to, n)
        more = seen + entries.fresh(start, at, step)
        can &= (to <= start) | limits.fits(t[end] - t[start] + more - gone, s[end] - s[start], o[end] - o[start])
        at, seen = np.where(can, to, at), np.where(can, more, seen)
    end = np.maximum(at, start + 1)
    border = np.maximum.accumulate(np.where(np.r_[starts, True], np.arange(n + 1), -1))[end]
    border = np.where((end == n) | (end - start == block), end, border)
    full = limits.estimate(_held(t, entries, start, np.maximum(border, start)))
    end = np.where((border > start) & ((border == end) | (full >= limits.target * limits.floor)), border, end)
    return end, limits.estimate(_held(t, entries, start, end))


def _held(t: np.ndarray, entries: _Entries, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Tokens of the units from ``start`` to ``end``, each glossary entry once."""
    at, seen = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    for bit in range(int(end.max(initial=0)).bit_length(), -1, -1):
        step = 1 << bit
        can = at + step <= end
        seen = np.where(can, seen + entries.fresh(start, at, step), seen)
        at = np.where(can, at + step, at)
    return t[end] - t[start] + seen - entries.sums[entries.cuts[start]]


def _doubled(jump: np.ndarray, size: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From each unit of a block: where its chain leaves the block, after how many batches, and the size of the last of them."""
    out, count, last = jump.copy(), np.ones(len(jump), np.int64), size.copy()
    while len(inside := np.flatnonzero(out < own)):
        via = out[inside]
        count[inside], last[inside], out[inside] = count[inside] + count[via], last[via], out[via]
    return out, count, last


KEYS = ["_none", "_name", "_block"]
BLOCKS = "_none boolean, _name string, _block long, places array<long>, jump array<int>, size array<long>, leaves array<int>, count array<long>, last array<long>, images array<int>"


def _blocks(sized: DataFrame, limits: Limits, block: int) -> DataFrame:
    """One row per block of places, with the units of the next block at hand: the jump from each unit, its chain out of the block, and where chains arrive."""
    own = F.floor(F.col("place") / block)
    dealt = sized.select("*", F.explode(F.when(own > 0, F.array(own, own - 1)).otherwise(F.array(own))).alias("_block"))

    def solve(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place").combine_chunks()
        place = rows["place"].to_numpy()
        number = rows["_block"][0].as_py()
        mine = int(np.searchsorted(place, (number + 1) * block))
        sizes = [rows[c].to_numpy().astype(np.int64) for c in ("_t", "_s", "_o")]
        terms = rows["_g"].combine_chunks()
        flat = terms.flatten()
        unit = np.repeat(np.arange(len(place)), terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        term = flat.field("term").dictionary_encode().indices.to_numpy(zero_copy_only=False) if len(flat) else np.empty(0, np.int64)
        cost = flat.field("tokens").to_numpy(zero_copy_only=False).astype(np.int64) if len(flat) else np.empty(0, np.int64)
        entries = _Entries(unit, term, cost, len(place))
        jump, size = next_starts(*sizes, rows["starts_paragraph"].to_numpy(zero_copy_only=False).astype(bool), entries, limits, mine, block)
        leaves, count, last = _doubled(jump, size, mine)
        images = np.unique(leaves) - mine
        images = images[(images < len(place) - mine) & (mine == block)]
        one = {"_none": [rows["_none"][0].as_py()], "_name": [rows["_name"][0].as_py()], "_block": [number], "places": [place[:mine]], "jump": [jump.astype(np.int32)], "size": [size], "leaves": [leaves.astype(np.int32)], "count": [count], "last": [last], "images": [images.astype(np.int32)]}
        return pa.table(one)

    return materialize(dealt.groupBy(*KEYS).applyInArrow(solve, BLOCKS))


def _entered(blocks: DataFrame, block: int) -> DataFrame:
    """``_none, _name, _block, entry, before, crossing``: where the chain from the book's first unit enters each block, how many batches begin
    before that, and the size of the one that reaches into it. Jumps of 1, 2, 4, ... blocks: as many rounds as the largest number of blocks has bits."""
    first = blocks.where("_block = 0").select(*KEYS, F.lit(0).alias("entry"))
    arriving = blocks.select("_none", "_name", (F.col("_block") + 1).alias("_block"), F.explode("images").alias("entry"))
    at = F.col("entry")
    one = blocks.join(arriving.unionByName(first), KEYS).select(*KEYS, "entry", (F.get("leaves", at) - block).alias("to"), F.get("count", at).alias("n"), F.get("last", at).alias("last"))
    jumps = checkpointed(one)
    reached = checkpointed(first.select(*KEYS, "entry", F.lit(0).cast("long").alias("before"), F.lit(None).cast("long").alias("crossing")))
    blocks_n = (blocks.agg(F.max("_block")).first()[0] or 0) + 1
    for bit in range((blocks_n - 1).bit_length()):
        span = 1 << bit
        ahead = reached.join(jumps, [*KEYS, "entry"]).select("_none", "_name", (F.col("_block") + span).alias("_block"), F.col("to").alias("entry"), (F.col("before") + F.col("n")).alias("before"), F.col("last").alias("crossing"))
        reached = checkpointed(reached.unionByName(ahead.join(blocks.select(*KEYS), KEYS, "left_semi")))
        then = jumps.select("_none", "_name", (F.col("_block") - span).alias("_block"), F.col("entry").alias("to"), F.col("to").alias("_to"), F.col("n").alias("_n"), F.col("last").alias("_last"))
        jumps = checkpointed(jumps.join(then, [*KEYS, "to"]).select(*KEYS, "entry", F.col("_to").alias("to"), (F.col("n") + F.col("_n")).alias("n"), F.col("_last").alias("last")))
    return reached


def pack(units: DataFrame, target: int, output_limit: int, ratio: float = 1.65, base: int = 0, unit_overhead: int = 12, floor: float = 0.85, factor: float = 1.0, samples: int = 0, block: int = BLOCK) -> DataFrame:
    """Adds ``batch_no, est_input`` to ``book, unit_ord, tokens, starts_paragraph``: next fit in order, over a book of any length.

    The size of a request is that of its parts: ``base`` for the instruction, the units' ``tokens``, and each glossary entry of ``terms`` once; the
    estimate is corrected like ``text.estimated_input``. Its answer is predicted from ``source_tokens`` and ``overhead_tokens``. Where the
    input has none of these columns, the tokens and ``unit_overhead`` stand for them. A batch takes whole paragraphs while they fit both the
    input target and nine tenths of the output limit. A batch below ``floor`` of its target is filled from the next paragraph as far as that fits; a unit
    that fits nowhere is a batch of its own, and ``block`` units are the most. Books are independent. Sizes are not negative.
    """
    has = set(units.columns)
    plain = "tokens" not in has or "overhead_tokens" not in has
    numbered = units if "place" in has else placed(units)
    none = F.array().cast("array<struct<term:string,tokens:bigint>>")
    sized = numbered.select(
        *parted("book"), "place", "starts_paragraph", (F.col("tokens") + (unit_overhead if plain else 0)).cast("long").alias("_t"), F.col("source_tokens" if "source_tokens" in has else "tokens").cast("long").alias("_s"),
        (F.lit(unit_overhead) if plain else F.col("overhead_tokens")).cast("long").alias("_o"), (F.coalesce("terms", none) if "terms" in has else none).alias("_g"),
    )
    blocks = _blocks(sized, Limits(target, output_limit, ratio, base, floor, factor, samples), block)
    met = blocks.join(_entered(blocks, block), KEYS).select("_none", "_name", "places", "jump", "size", "entry", "before", "crossing")

    def number(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                none_, name, places, jump, size, entry, before, crossing = (batch.column(c)[at] for c in range(8))
                jump, size, n = jump.values.to_numpy(), size.values.to_numpy(), len(places)
                begins, to = np.zeros(n, bool), np.minimum(jump, n)
                if entry.as_py() < n:  # else the batch before takes the whole block
                    begins[entry.as_py()] = True
                ways = np.r_[to, n]
                while True:  # what is reached in 1, 2, 4, ... jumps
                    again = np.r_[begins, False]
                    again[ways[:-1][begins]] = True
                    ways = ways[ways]
                    if (again[:-1] == begins).all():
                        break
                    begins = again[:-1]
                no = np.cumsum(begins) - 1
                est = np.where(no < 0, crossing.as_py() or 0, size[np.maximum(np.maximum.accumulate(np.where(begins, np.arange(n), -1)), 0)])
                yield pa.record_batch([pa.array([none_.as_py()] * n), pa.array([name.as_py()] * n), places.values, pa.array(no + before.as_py()), pa.array(est)], ["_none", "_name", "_place", "batch_no", "est_input"])

    named = met.mapInArrow(number, "_none boolean, _name string, _place long, batch_no long, est_input long")
    keyed = numbered.select("*", *parted("book"))
    out = keyed.join(named.withColumnsRenamed({"_none": "_n", "_name": "_b"}), (F.col("_none") == F.col("_n")) & (F.col("_name") == F.col("_b")) & (F.col("place") == F.col("_place")))
    return out.select(*units.columns, F.col("batch_no").cast("int").alias("batch_no"), "est_input")


def halves(units: DataFrame) -> DataFrame:
    """Adds ``half`` (0 or 1) to ``batch, unit_ord, tokens, starts_paragraph``: cut at the paragraph border nearest
    half of the tokens, without one right after half is reached; a batch of one unit stays whole."""
    order = Window.partitionBy("batch").orderBy("unit_ord")
    whole = Window.partitionBy("batch")
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = units.withColumns({"_before": before, "_i": F.row_number().over(order), "_all": F.sum("tokens").over(whole), "_n": F.count("*").over(whole)})
    off = F.abs(F.col("_before") - F.col("_all") / 2)
    border = (F.col("_i") > 1) & F.col("starts_paragraph")
    by_paragraph = F.min(F.when(border, F.struct(off.alias("off"), F.col("_i").alias("i")))).over(whole)["i"]
    reached = (F.col("_i") > 1) & (F.col("_before") >= F.col("_all") / 2)
    by_half = F.coalesce(F.min(F.when(reached, F.col("_i"))).over(whole), F.col("_n"))
    cut = F.coalesce(by_paragraph, by_half)
    return placed.withColumn("_cut", cut).withColumn("half", F.when((F.col("_n") > 1) & (F.col("_i") >= F.col("_cut")), 1).otherwise(0)).drop("_before", "_i", "_all", "_n", "_cut")


def split_batches(runs: DataFrame) -> DataFrame:
    """Adds ``half`` to the runs ``batch, unit_id, unit_ord, run_ord, tokens, starts_paragraph``: units are kept whole where the batch
    has several, and a single unit is cut in the middle of its runs. A batch of one run stays whole."""
    units = halves(runs.groupBy("batch", "unit_id", "unit_ord").agg(F.sum("tokens").alias("tokens"), F.max("starts_paragraph").alias("starts_paragraph")))
    cut = units.select("batch", "unit_id", F.col("half").alias("_half"), F.count("*").over(Window.partitionBy("batch")).alias("_units"))
    own = Window.partitionBy("batch", "unit_id")
    late = F.row_number().over(own.orderBy("run_ord")) > F.floor(F.count("*").over(own) / 2)
    runs_n = F.count("*").over(own)
    met = runs.join(cut, ["batch", "unit_id"])
    return met.withColumn("half", F.when(F.col("_units") > 1, F.col("_half")).otherwise((late & (runs_n > 1)).cast("int"))).drop("_half", "_units")

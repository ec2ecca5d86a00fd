"""Near copies at a stated similarity: the trie self-join of ``simhash_trie`` with a wide error budget.

The similarity of two texts is taken over their five-word shingles: the share of a text's words that stand in
a shingle which the other text has too, the lesser of both directions. Two texts are near copies at 0.8 or more. (A text
with one word in ten replaced has a Jaccard similarity of shingle sets near 0.5, but 0.85 of its words still stand in
shared shingles.)

Fingerprints of such pairs differ in about 17 of 64 bits, beyond what equal 16-bit blocks can find. So the
tries are built below other nodes: a *cell* is one band of ``ROWS`` min-hashes of the shingle set, and of
``BANDS`` bands a pair with Jaccard 0.45 shares at least one with probability 0.998. In each cell pairs of trie nodes
are walked together within a budget of ``BUDGET`` differing bits, likely links first (those whose sketches agree
most, down to ``FLOORS[-1]``), and pruned once everything below is one component; a forest leaves the task, never all pairs. A sketch holds the
least hash of each of ``BINS`` bins of the shingle set; the share of equal bins among those filled on either side estimates the Jaccard similarity
with a deviation near 0.04, which tells near copies from texts that merely share a long passage.

Every link is then settled by the exact similarity of the two whole texts. As a link may fall, each cell gives ``FORESTS``
forests without a common pair, which settle most groups. A cell with candidates beyond those forests is walked again from the
components found; where two of them still have a candidate between them, the cell is *open*: every such pair
is tested exactly before it may link. So no pair of one cell is pruned by a link that falls, however the cell is dealt.
Texts with equal shingle sets are one node from the start. Cells with
more than ``SHARD`` nodes are dealt as pairs of shards, and the text of a node with many links is dealt in parts.

Defined cases: null or blank texts have the empty set and are copies of each other; fewer than five words
are one shingle; very long texts are taken whole; ties go to the smallest id (nulls last), then the smaller text key; rows repeated whole
are copies; an empty table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import first_of_group, keep_rows, map_arrow, row_keys, small_batches, text_key
from loomspan.llm.simhash_trie import connected_components, shingle_hashes, trie_forest
from loomspan.storage import checkpointed, materialize

WIDTH = 5
SIMILARITY = 0.8
BANDS = 28
ROWS = 2
BUDGET = 28
#: Bins of a sketch.
BINS = 128
#: Agreement of sketches from which on a pair is a candidate, one walk each.
FLOORS = (0.5, 0.33)
FORESTS = 2
#: Nodes of a cell beyond which it is cut into shards of about this size.
SHARD = 10_000
#: Links of one node that meet in one task.
HUB = 4_096
#: Node pairs of a walk that advance at once.
FRONTIER = 1 << 14

_MIX = np.random.default_rng(42).integers(1 << 63, size=(2, BANDS * ROWS, 1), dtype=np.uint64)
_XOR, _ODD = _MIX[0], _MIX[1] | np.uint64(1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def similarity(a: np.ndarray, b: np.ndarray, distinct_a: np.ndarray | None = None, distinct_b: np.ndarray | None = None) -> float:
    """Share of words in common shingles, the lesser of both directions; of two empty texts 1.

    ``a`` and ``b``: shingle hashes in the order of the texts; their sorted distinct values may be given.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    distinct_a = np.unique(a) if distinct_a is None else distinct_a
    distinct_b = np.unique(b) if distinct_b is None else distinct_b
    return min(_covered(a, distinct_b), _covered(b, distinct_a))


def _covered(own: np.ndarray, other: np.ndarray) -> float:
    at = np.minimum(np.searchsorted(other, own), len(other) - 1)
    hit = other[at] == own
    # a word is covered if one of the up to WIDTH shingles over it is shared
    upto = np.r_[0, np.cumsum(hit)]
    n = len(own)
    word = np.arange(n + WIDTH - 1)
    return float((upto[np.minimum(word + 1, n)] > upto[np.maximum(word - WIDTH + 1, 0)]).mean())


def describe(found: np.ndarray) -> tuple[int, int, bytes, bytes]:
    """Node, fingerprint, bands (8 bytes each) and sketch (one byte a bin, 0 for an empty one) of a shingle set."""
    least = np.full((BANDS * ROWS, 1), np.iinfo(np.uint64).max)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 2048):
        part = found[at : at + 2048]
        mixed = (part ^ _XOR) * _ODD
        mixed ^= mixed >> np.uint64(29)
        mixed *= _SPREAD
        least = np.minimum(least, mixed.min(axis=1, keepdims=True))
        ones += np.add.reduce(np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64), axis=0, dtype=np.uint32)
    fp = int(np.packbits(2 * ones > len(found), bitorder="little").view(np.uint64)[0])
    plain = least.tobytes()
    bands = b"".join(xxhash.xxh64_digest(plain[b * ROWS * 8 : (b + 1) * ROWS * 8], b) for b in range(BANDS))
    return xxhash.xxh64_intdigest(found.tobytes(), 42), fp, bands, sketch_of(found).tobytes()


def sketch_of(found: np.ndarray) -> np.ndarray:
    """One byte, never 0, of the least hash of each bin; 0 for an empty bin."""
    mixed = np.sort((found ^ _XOR[0]) * _ODD[0])
    bins = (mixed >> np.uint64(57)).astype(np.int64)  # sorted: the bin is the leading bits
    at = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]]) if len(bins) else bins
    out = np.zeros(BINS, np.uint8)
    out[bins[at]] = 1 + (mixed[at] * _SPREAD >> np.uint64(40)) % np.uint64(255)
    return out


def described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text_key, node, fp, bands, sketch`` for each row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [describe(np.unique(shingle_hashes(t, WIDTH))) for t in batch.column(1).to_pylist()]
        nodes, fps = (pa.array(np.array([r[i] for r in rows], np.uint64).view(np.int64)) for i in (0, 1))
        cells = np.frombuffer(b"".join(r[2] for r in rows), ">i8").astype(np.int64)
        bands = pa.ListArray.from_arrays(np.arange(0, len(cells) + 1, BANDS, dtype=np.int32), cells)
        return pa.record_batch([batch.column(0), batch.column(2), nodes, fps, bands, pa.array([r[3] for r in rows], pa.binary())], ["doc_id", "text_key", "node", "fp", "bands", "sketch"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("text_key"))
    return map_arrow(narrow, run, "doc_id long, text_key long, node long, fp long, bands array<long>, sketch binary")


def dealt_cells(nodes: DataFrame, shard: int = SHARD) -> DataFrame:
    """``node, cell, i, j``: the cells of two nodes or more, as pairs of shards."""
    dealt = nodes.select("node", F.explode("bands").alias("cell"))
    shared = checkpointed(dealt.groupBy("cell").count().where("count > 1").select("cell", F.ceil(F.col("count") / shard).cast("int").alias("shards")))
    own = F.pmod(F.xxhash64("node"), F.col("shards")).cast("int")
    met = dealt.join(shared, "cell").withColumn("own", own)
    # every pair of shards is a cell of its own; a cell of n shards sends each node to n - 1 of them
    others = F.when(F.col("shards") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("shards") - 1), lambda x: x != F.col("own")))
    opened = met.withColumn("other", F.explode(others))
    return opened.select("node", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


class _Cells:
    """Rows ``node, cell, i, j, fp, sketch`` as arrays, sorted by cell and fingerprint."""

    def __init__(self, whole: pa.Table) -> None:
        cell, node, i, j = (whole[c].to_numpy().astype(np.int64) for c in ("cell", "node", "i", "j"))
        fp = whole["fp"].to_numpy().view(np.uint64)
        self.order = order = np.lexsort((fp, j, i, cell))
        self.cell, self.node, self.i, self.j, self.fp = cell[order], node[order], i[order], j[order], fp[order]
        self.sketch = np.frombuffer(b"".join(whole["sketch"].to_pylist()), np.uint8).reshape(-1, BINS)[order]
        change = (self.cell[1:] != self.cell[:-1]) | (self.i[1:] != self.i[:-1]) | (self.j[1:] != self.j[:-1])
        self.cuts = np.flatnonzero(np.r_[True, change, True])

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Share of equal bins among those that either row fills; of two empty rows 1."""
        out = np.empty(len(a))
        for at in range(0, len(a), 1 << 14):
            part = slice(at, at + (1 << 14))
            x, y = self.sketch[a[part]], self.sketch[b[part]]
            filled = np.count_nonzero(x | y, axis=1)
            same = np.count_nonzero((x == y) & (x > 0), axis=1)
            out[part] = np.where(filled > 0, same / np.maximum(filled, 1), 1.0)
        return out

    def joined(self, root: np.ndarray) -> np.ndarray:
        """Components known before, each for its cell."""
        own = np.repeat(np.arange(len(self.cuts) - 1), np.diff(self.cuts))
        return np.unique(np.stack([own, root[self.order]]), axis=1, return_inverse=True)[1].reshape(-1)

    def forest(self, steps: list, joined: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        edges = np.array(trie_forest(self.fp, 0, BUDGET, self.cuts, steps, joined, FRONTIER), np.int64).reshape(-1, 2)
        return edges.min(axis=1), edges.max(axis=1)

    def ends(self, a: np.ndarray, b: np.ndarray) -> list[pa.Array]:
        x, y = self.node[a], self.node[b]
        return [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))]

    def named(self, rows: np.ndarray) -> list[pa.Array]:
        """``cell, i, j`` of the cells that hold the given rows."""
        at = self.cuts[np.unique(np.searchsorted(self.cuts, rows, side="right") - 1)]
        return [pa.array(self.cell[at]), pa.array(self.i[at]), pa.array(self.j[at])]


def _partitions(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got).combine_chunks() if got else None


def candidate_links(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidate edges ``a, b`` of forests of each cell; besides, with null ``a`` and ``b``, the ``cell, i, j``
    that hold candidates beyond these forests."""
    full = cells.join(nodes.select("node", "fp", "sketch"), "node")
    names = ["a", "b", "cell", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = _whole(batches)
        if whole is None:
            return
        own = _Cells(whole)
        n, used = len(own.node), np.empty(0, np.int64)
        for forest in range(FORESTS + 1):
            steps = [(BUDGET, lambda a, b, floor=floor: (own.agree(a, b) >= floor) & ~np.isin(np.minimum(a, b) * n + np.maximum(a, b), used)) for floor in FLOORS]
            a, b = own.forest(steps)
            if not len(a):
                return
            if forest == FORESTS:  # not tested: it says where untested links are left
                at = own.named(a)
                yield pa.record_batch([pa.nulls(len(at[0]), pa.int64()), pa.nulls(len(at[0]), pa.int64()), *at], names)
            else:
                used = np.union1d(used, a * n + b)
                yield pa.record_batch([*own.ends(a, b), *[pa.nulls(len(a), pa.int64())] * 3], names)

    return full.repartition(_partitions(full), "cell", "i", "j").mapInArrow(run, "a long, b long, cell long, i long, j long").distinct()


def still_open(rows: DataFrame) -> DataFrame:
    """``cell, i, j`` of those cells of ``node, cell, i, j, root, fp, sketch`` that hold a candidate between two roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = _whole(batches)
        if whole is None:
            return
        own = _Cells(whole)
        a, _ = own.forest([(BUDGET, lambda a, b: own.agree(a, b) >= FLOORS[-1])], own.joined(whole["root"].to_numpy()))
        yield pa.record_batch(own.named(a), ["cell", "i", "j"])

    return rows.repartition(_partitions(rows), "cell", "i", "j").mapInArrow(run, "cell long, i long, j long")


def open_cell_links(rows: DataFrame, least: float) -> DataFrame:
    """Edges ``a, b`` that join all links of each cell of ``node, cell, i, j, root, fp, sketch, text``, every candidate between
    two roots tested exactly. One cell is held at a time."""

    def links(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks()
        own = _Cells(whole)
        ordered = [shingle_hashes(t, WIDTH) for t in whole["text"].to_pylist()]
        ordered = [ordered[k] for k in own.order.tolist()]
        distinct = [np.unique(x) for x in ordered]

        def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            near = own.agree(a, b) >= FLOORS[-1]
            near[near] = [similarity(ordered[x], ordered[y], distinct[x], distinct[y]) >= least for x, y in zip(a[near].tolist(), b[near].tolist())]
            return near

        return pa.record_batch(own.ends(*own.forest([(BUDGET, exact)], own.joined(whole["root"].to_numpy()))), ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in small_batches(batches):
            keys = np.stack([batch.column(c).to_numpy() for c in ("cell", "i", "j")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                key = tuple(keys[a].tolist())
                if key != now and held:
                    yield links(held)
                    held = []
                now = key
                held.append(batch.slice(a, b - a))
        if held:
            yield links(held)

    dealt = rows.repartition(_partitions(rows), "cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _with_text(pairs: DataFrame, texts: DataFrame, end: str, other: str) -> DataFrame:
    """``pairs`` and the text of one end; the text of a node with many pairs goes to several tasks."""
    hubs = checkpointed(pairs.groupBy(F.col(end).alias("node")).count().where(F.col("count") > HUB).select("node", F.ceil(F.col("count") / HUB).cast("int").alias("parts")))
    named = f"text_{end}"
    if hubs.isEmpty():
        return pairs.join(texts.toDF(end, named), end)
    parts = F.coalesce("parts", F.lit(1))
    dealt = pairs.join(hubs.withColumnRenamed("node", end), end, "left").withColumn("part", F.pmod(F.xxhash64(other), parts)).drop("parts")
    spread = texts.join(hubs, "node", "left").select(F.col("node").alias(end), F.col("text").alias(named), F.explode(F.sequence(F.lit(0).cast("long"), (parts - 1).cast("long"))).alias("part"))
    return dealt.join(spread, [end, "part"]).drop("part")


def exact_links(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs ``a, b`` whose texts are at least ``least`` similar. ``texts``: ``node, text``."""
    both = _with_text(_with_text(pairs, texts, "a", "b"), texts, "b", "a").select("a", "b", "text_a", "text_b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        near = [similarity(shingle_hashes(x, WIDTH), shingle_hashes(y, WIDTH)) >= least for x, y in zip(left, right)]
        return pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    return map_arrow(both, run, "a long, b long")


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, shard: int = SHARD, among: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text_key, root``; rows with one ``root`` are one group.

    ``among`` (``doc_id, text_key``, one row each) restricts this to some of the rows.
    """
    rows = described(docs, id_col, text_col)
    if among is not None:
        rows = _keyed(rows).join(_keyed(among).select("k1", "k2"), ["k1", "k2"], "left_semi").drop("k1", "k2")
    rows = materialize(rows)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("first")
    nodes = materialize(rows.groupBy("node").agg(first, F.min("fp").alias("fp"), F.min("bands").alias("bands"), F.min("sketch").alias("sketch")))
    cells = materialize(dealt_cells(nodes, shard))
    walked = materialize(candidate_links(cells, nodes))
    pairs = walked.where("a is not null").select("a", "b")
    spokes = _keyed(nodes.select("node", "first.doc_id", "first.text_key")).select("node", "k1", "k2")
    keyed = docs.select(F.col(text_col).alias("text"), *row_keys(F.col(id_col), text_key(F.col(text_col))))

    def texts_of(some: DataFrame) -> DataFrame:
        return materialize(keyed.join(spokes.join(some, "node", "left_semi"), ["k1", "k2"]).groupBy("node").agg(F.min("text").alias("text")))

    edges = materialize(exact_links(pairs, texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), least))
    roots = connected_components(edges)
    beyond = walked.where("a is null").select("cell", "i", "j")
    if not beyond.isEmpty():
        placed = materialize(cells.join(beyond, ["cell", "i", "j"]).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
        apart = placed.groupBy("cell", "i", "j").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("cell", "i", "j")
        marked = placed.join(nodes.select("node", "fp", "sketch"), "node").select("node", "cell", "i", "j", "root", "fp", "sketch")
        left = materialize(still_open(marked.join(apart, ["cell", "i", "j"], "left_semi")))
        if not left.isEmpty():
            again = materialize(marked.join(left, ["cell", "i", "j"]))
            rows_left = again.join(texts_of(again.select("node").distinct()), "node").select("node", "cell", "i", "j", "root", "fp", "sketch", "text")
            roots = connected_components(edges.union(materialize(open_cell_links(rows_left, least))))
    return rows.select("doc_id", "text_key", "node").join(roots, "node", "left").select("doc_id", "text_key", F.coalesce("root", "node").alias("root"))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select("*", *row_keys(F.col("doc_id"), F.col("text_key")))


def keep_one_near_copy(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, among: DataFrame | None = None) -> DataFrame:
    """``docs`` (or those rows of it that ``among`` names) with one row of each group of near copies: the one of smallest id."""
    return keep_rows(docs, first_of_group(near_copy_groups(docs, id_col, text_col, least, among=among)), id_col, text_col)

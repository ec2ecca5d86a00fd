"""SimHash near-duplicate groups by a binary-trie self-join.

Fingerprints are 64-bit majorities over XXH64 (seed 42) of word shingles. Distinct fingerprints are
dealt by blocks of bits: of ``blocks`` blocks, fingerprints that differ in at most three bits agree on all but three
at least. With the bits of such blocks in front each link lies below one trie node (four blocks: depth 16, 4 ways; six blocks,
for more than ``MANY`` rows: depth 31 to 33, 20 ways). Below such nodes the join
walks *pairs of trie nodes* together, adds the bits in which their prefixes differ and prunes a pair
as soon as the error budget is exceeded. A trie node is a range of a sorted array, so one level of all
pairs advances in a few numpy calls.

Only a spanning forest leaves a task: a pair of nodes is also pruned when everything below both is
already one component, hence a dense group of near copies costs about its size, not its square.
Blocks with very many fingerprints are cut into shards; each pair of shards is one cell, so no task
holds more than two shards. The forests of all cells meet in a star-contraction of the edge list.

Defined cases: null or blank text has fingerprint 0 and links like any other; very long texts are hashed whole, in parts of
bounded memory; rows repeated under one id stay rows; a null id never wins as component id unless the whole component is null;
of equal ids the smaller text key comes first; an empty table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import first_of_group, keep_rows, map_arrow, text_key
from loomspan.storage import checkpointed, materialize

SEED = 42
#: Differing bits that the blocks leave room for.
MOST = 3
BLOCKS = 4
#: Rows from which on six blocks deal smaller cells; links are the same either way.
MANY = 1 << 30
#: Fingerprints that share one block value beyond which the block is cut into shards of about this size.
SHARD = 40_000
#: Node pairs that advance at once; bounds a task's memory.
FRONTIER = 1 << 18


def shingle_hashes(text: str | None, width: int = 3) -> np.ndarray:
    """XXH64 of every run of ``width`` lower-cased words (fewer words: the whole run), repeats kept."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[:-1])]
    runs = map(joined.__getitem__, map(slice, starts, ends[width - 1 :]))
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, runs, repeat(SEED))), ">u8").astype(np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit majority of the shingle hashes; 0 for a text without words."""
    hashes = shingle_hashes(text, width)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        bits = np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``doc_id, fp (signed 64 bits), text_key`` for each row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((fingerprint(t, width) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        return pa.record_batch([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2)], ["doc_id", "fp", "text_key"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("text_key"))
    return map_arrow(narrow, run, "doc_id long, fp long, text_key long")


class _Forest:
    """Union-find whose labels are also kept as a flat array for vectorised tests."""

    def __init__(self, n: int, joined: np.ndarray | None = None) -> None:
        # keys of one value of ``joined`` are one component from the start, named by the first of them
        self.label = np.arange(n) if joined is None else np.unique(joined, return_index=True)[1][np.unique(joined, return_inverse=True)[1]]
        self.parent = self.label.tolist()
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def link(self, a: np.ndarray, b: np.ndarray) -> bool:
        fresh = self.label[a] != self.label[b]
        before = len(self.edges)
        for x, y in zip(a[fresh].tolist(), b[fresh].tolist()):
            p, q = self.find(x), self.find(y)
            if p != q:
                self.parent[max(p, q)] = min(p, q)
                self.edges.append((x, y))
        if len(self.edges) == before:
            return False
        up = np.array(self.parent)
        while not np.array_equal(up, nxt := up[up]):
            up = nxt
        self.label, self.parent = up, up.tolist()
        return True


Accept = Callable[[np.ndarray, np.ndarray], np.ndarray]


def trie_forest(keys: np.ndarray, depth: int, budget: int, cuts: np.ndarray | None = None, steps: Sequence[tuple[int, Accept | None]] = (), joined: np.ndarray | None = None, frontier: int | None = None) -> list[tuple[int, int]]:
    """Spanning forest of the links (at most ``budget`` differing bits) between keys with equal ``depth`` leading bits.

    ``keys``: sorted distinct uint64. A trie node of depth d is the range of keys with one d-bit prefix.
    With ``cuts`` the ranges between them are tries of their own, each sorted, keys may recur, and only keys of one range link.
    ``steps`` lists the walks: a budget and a further test of the pairs within it, made only of pairs still apart.
    ``joined`` names components that are known before; ``frontier`` node pairs advance at once (the fewer, the sooner what is joined is pruned).
    """
    n = len(keys)
    if n < 2:
        return []
    frontier = frontier or FRONTIER
    forest = _Forest(n, joined)
    whole = cuts is None
    if cuts is None:
        heads = keys >> np.uint64(64 - depth) if depth else np.zeros(n, np.uint64)
        cuts = np.flatnonzero(np.r_[True, heads[1:] != heads[:-1], True])
    roots = np.stack([cuts[:-1], cuts[1:]], axis=1)
    roots = roots[roots[:, 1] - roots[:, 0] > 1]
    # near links first: what they join is pruned in the wider walks
    for limit, accept in steps or [(limit, None) for limit in range(1, budget + 1)]:
        start = np.concatenate([roots, roots, np.zeros((len(roots), 1), np.int64)], axis=1)
        stack = [(depth, start)]
        run = np.cumsum(np.r_[0, forest.label[1:] != forest.label[:-1]])
        while stack:
            d, pairs = stack.pop()
            if len(pairs) > frontier:
                stack.append((d, pairs[frontier:]))
                pairs = pairs[:frontier]
            lo1, hi1, lo2, hi2, diff = pairs.T
            one = (run[lo1] == run[hi1 - 1]) & (run[lo2] == run[hi2 - 1]) & (forest.label[lo1] == forest.label[lo2])
            pairs = pairs[~one]
            if not len(pairs):
                continue
            lo1, hi1, lo2, hi2, diff = pairs.T
            small = ((hi1 - lo1) * (hi2 - lo2) <= 16) | (d >= 64)
            if small.any():
                a, b = _leaves(pairs[small])
                near = (np.bitwise_count(keys[a] ^ keys[b]) <= limit) & (forest.label[a] != forest.label[b])
                a, b = a[near], b[near]
                if accept is not None:
                    near = accept(a, b)
                    a, b = a[near], b[near]
                if forest.link(a, b):
                    run = np.cumsum(np.r_[0, forest.label[1:] != forest.label[:-1]])
                pairs = pairs[~small]
            if len(pairs):
                stack.append((d + 1, _children(keys, pairs, d, limit, whole)))
    return forest.edges


def _leaves(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All key pairs below small node pairs; below a node paired with itself, each pair once."""
    lo1, hi1, lo2, hi2, _ = pairs.T
    w1, w2 = hi1 - lo1, hi2 - lo2
    count = w1 * w2
    owner = np.repeat(np.arange(len(pairs)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    a, b = lo1[owner] + k // w2[owner], lo2[owner] + k % w2[owner]
    keep = (lo1[owner] != lo2[owner]) | (a < b)
    return a[keep], b[keep]


def _children(keys: np.ndarray, pairs: np.ndarray, d: int, limit: int, whole: bool = True) -> np.ndarray:
    """Node pairs one level down, without the empty ones and those beyond the error budget.

    ``whole``: the keys are sorted as a whole, not only within each range.
    """
    bit = np.uint64(1 << (63 - d))
    below = np.uint64((1 << (64 - d)) - 1 if d else 0xFFFFFFFFFFFFFFFF)

    def split(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if whole:
            return np.clip(np.searchsorted(keys, (keys[lo] & ~below) | bit), lo, hi)
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            one = (keys[np.minimum(mid, len(keys) - 1)] & bit) != 0
            hi = np.where(open_ & one, mid, hi)
            lo = np.where(open_ & ~one, mid + 1, lo)
        return lo

    lo1, hi1, lo2, hi2, diff = pairs.T
    m1, m2 = split(lo1, hi1), split(lo2, hi2)
    own = lo1 == lo2
    out = [
        np.stack([lo1, m1, lo2, m2, diff], 1),
        np.stack([m1, hi1, m2, hi2, diff], 1),
        np.stack([lo1, m1, m2, hi2, diff + 1], 1),
        np.stack([m1, hi1, lo2, m2, diff + 1], 1)[~own],
    ]
    grown = np.concatenate(out)
    return grown[(grown[:, 0] < grown[:, 1]) & (grown[:, 2] < grown[:, 3]) & (grown[:, 4] <= limit)]


def _fields(blocks: int) -> list[tuple[int, int]]:
    """``(shift, bits)`` of each block, from the highest bits down."""
    sizes = [64 // blocks + (k < 64 % blocks) for k in range(blocks)]
    return [(64 - end, bits) for end, bits in zip(accumulate(sizes), sizes)]


def _in_front(fp: np.ndarray, chosen: tuple[int, ...], fields: list[tuple[int, int]]) -> np.ndarray:
    """The same bits with the chosen blocks before the others."""
    out = np.zeros_like(fp)
    for k in (*chosen, *(k for k in range(len(fields)) if k not in chosen)):
        shift, bits = fields[k]
        out = (out << np.uint64(bits)) | ((fp >> np.uint64(shift)) & np.uint64((1 << bits) - 1))
    return out


def trie_links(distinct: DataFrame, budget: int = MOST, shard: int = SHARD, blocks: int = BLOCKS) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints ``fp`` that connect all links of at most ``budget`` bits (0 to 3)."""
    if not 0 <= budget <= MOST < blocks:
        raise ValueError("budget must lie between 0 and 3")
    spark = distinct.sparkSession
    fields = _fields(blocks)
    ways = list(combinations(range(blocks), blocks - MOST))

    def value(chosen: tuple[int, ...]):
        mask = sum(((1 << bits) - 1) << shift for shift, bits in (fields[k] for k in chosen))
        return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))

    dealt = distinct.select("fp", F.posexplode(F.array(*[value(w) for w in ways])).alias("way", "value"))
    hot = checkpointed(dealt.groupBy("way", "value").count().where(F.col("count") > shard).select("way", "value", F.ceil(F.col("count") / shard).cast("int").alias("shards")))
    if hot.isEmpty():
        cells = dealt.select("fp", "way", "value", F.lit(0).alias("i"), F.lit(0).alias("j"))
    else:
        # every pair of shards is a cell; a block of n shards sends each fingerprint to n - 1 cells
        own = F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int")
        joined = dealt.join(hot, ["way", "value"], "left").withColumn("own", F.when(F.col("shards") > 1, own))
        others = F.when(F.col("own").isNull(), F.array(F.lit(-1))).otherwise(F.filter(F.sequence(F.lit(0), F.col("shards") - 1), lambda s: s != F.col("own")))
        opened = joined.withColumn("other", F.explode(others))
        cells = opened.select("fp", "way", "value", F.coalesce(F.least("own", "other"), F.lit(0)).alias("i"), F.when(F.col("own").isNull(), 0).otherwise(F.greatest("own", "other")).alias("j"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        whole = pa.Table.from_batches(got)
        fp = whole["fp"].to_numpy().view(np.uint64)
        value = whole["value"].to_numpy().view(np.uint64)
        way, i, j = (whole[c].to_numpy().astype(np.int64) for c in ("way", "i", "j"))
        # plain cells of one way are walked at once, each shard pair for itself
        hot = np.where(j > 0, value, np.uint64(0))
        order = np.lexsort((hot, j, i, way))
        change = [x[order][1:] != x[order][:-1] for x in (way, i, j, hot)]
        for at in np.split(order, np.flatnonzero(np.logical_or.reduce(change)) + 1):
            chosen = ways[way[at[0]]]
            keys = _in_front(fp[at], chosen, fields)
            own = np.argsort(keys)
            edges = trie_forest(keys[own], sum(fields[k][1] for k in chosen), budget)
            if edges:
                pairs = np.array(edges)
                plain = fp[at][own].view(np.int64)
                yield pa.record_batch([pa.array(plain[pairs[:, 0]]), pa.array(plain[pairs[:, 1]])], ["a", "b"])

    return cells.repartition(parts, "way", "value", "i", "j").mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of an edge list ``a, b``; the root is the smallest node of its component.

    Alternates large-star and small-star contraction until the edge list rests; every round is
    checkpointed in the shared folder. The minima of a round are checkpointed too: the join then has plain exchanges on
    either side, and Spark may split the edges of a hub.
    """

    def rest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    stars = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = rest(stars)
    while seen[0]:
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # after the large star each node points at smaller ones only: few, as all of a hub's neighbours point at its minimum
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), "m"), F.struct("a", "m"))).alias("e")).select(F.col("e.a").alias("a"), F.col("e.m").alias("b"))
        stars = checkpointed(small.where("a <> b").distinct())
        now = rest(stars)
        if now == seen:
            break
        seen = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select("b", "b").distinct())


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = MOST, blocks: int | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text_key, fp, root, component_id``.

    ``component_id`` is the smallest id reachable over links of at most ``budget`` bits, ``root`` the
    smallest fingerprint (signed) of that component.
    """
    rows = materialize(with_fingerprints(docs, id_col, text_col, width))
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    blocks = blocks or (BLOCKS if rows.count() < MANY else 6)
    roots = connected_components(trie_links(distinct.select("fp"), budget, blocks=blocks)) if budget else None
    if roots is None:
        member = distinct.withColumn("root", F.col("fp"))
    else:
        member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    member = checkpointed(member)
    # both names are written before they are joined: a giant component and a fingerprint of many copies can then be split
    ids = checkpointed(member.groupBy("root").agg(F.min("least").alias("component_id")))
    named = checkpointed(member.join(ids, "root").select("fp", "root", "component_id"))
    return rows.join(named, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def op8_simhash(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every document."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return simhash_groups(docs).select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = MOST) -> DataFrame:
    """``docs`` with one row of each group: the one of smallest id, ties to the smaller text key."""
    return keep_rows(docs, first_of_group(simhash_groups(docs, id_col, text_col, width, budget)), id_col, text_col)

"""Ranked lexical search over an inverted index in segments.

``build_index``: each task reads its documents and writes *segments*, one for about ``SEGMENT_BYTES`` of text: documents in the order of doc_id, and
for every term a list of postings (gaps of places and frequencies as variable-length bytes). Texts and terms are not shuffled; a
segment is a few thousand rows of a table.

``search``: document frequencies are summed over segments; the posting lists of the terms that are asked for are dealt to shards. A shard goes through its
segments one by one and answers each query document at a time: the cursors of its terms meet in a heap by document, the documents' scores
in a heap of at most ``k``, keyed by score, then doc_id. A cursor whose best weight, with those of all lower ones, can't lift a document over the
least score of the full heap leaves the merge and is only looked up. The shards' results meet in one ranking per query.

Queries go in blocks of a bounded number of terms (``BLOCK_TERMS`` on average), so what a task holds of them does not grow with their number.

Defined cases: null and empty texts have no terms and do not count; rows that share a doc_id are documents of their own; equal scores go by doc_id, null
ids last; rows that share an item_id (null is one id) are one query, each term once; texts of any length are read whole (one text is at most one
segment); an empty table gives an empty result; other columns do not matter, whatever their names.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import small_batches
from loomspan.storage import materialize

#: Results of a query.
TOP = 50
#: Bytes of text of a segment, about.
SEGMENT_BYTES = 16 << 20
#: Terms of a block of queries, about.
BLOCK_TERMS = 200_000
#: Parts of a unit weight, and of the length norm: fixed values of the score.
UNIT, SCALE, NORM, HALF = 1_000_000_000, 1_000, 20, 50
#: Stands for a null doc_id: after every other.
LAST = (1 << 63) - 1

#: Letters and digits as they are (A-Z as a-z), bytes beyond ASCII as they are, all else a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return (text or "").encode().translate(_FOLD).split()


# ---- variable-length bytes ---------------------------------------------------------------------------


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, low ones first, the high bit says that more follow. Returns the bytes and where each value ends."""
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        sizes += values >= 1 << bits
    ends = np.cumsum(sizes)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    starts, left, at = ends - sizes, values, np.arange(len(values))
    for _ in range(9):
        if not len(at):
            break
        more = sizes[at] > 1
        out[starts[at]] = (left & 127) | (more << 7)
        starts[at] += 1
        sizes[at] -= 1
        at, left = at[more], left[more] >> 7
    return out, ends


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.int64)
    ends = np.flatnonzero(raw < 128)
    starts = np.r_[0, ends[:-1] + 1]
    shift = 7 * (np.arange(len(raw)) - np.repeat(starts, ends - starts + 1))
    return np.add.reduceat((raw & 127).astype(np.int64) << shift, starts)


# ---- index -------------------------------------------------------------------------------------------

INDEX = "segment string, term binary, df long, tokens long, postings binary"


class _Segment:
    """Documents gathered until they are written out as rows of ``INDEX``."""

    def __init__(self) -> None:
        self.terms: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.ids: list[int] = []
        self.found: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str) -> None:
        terms = terms_of(text)
        self.size += len(text)
        if terms:
            self.ids.append(LAST if doc_id is None else doc_id)
            self.found.append(np.fromiter(map(self.terms.__getitem__, terms), np.int64, len(terms)))

    def written(self) -> pa.RecordBatch:
        """The first row, of no term, has the ids and lengths of all documents; the others one term each."""
        ids = np.array(self.ids, np.int64)
        lengths = np.array([len(f) for f in self.found], np.int64)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        n = len(ids)
        keys, tf = np.unique(np.concatenate(self.found) * n + np.repeat(place, lengths), return_counts=True)
        term, doc = keys // n, keys % n
        starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        gaps = np.diff(doc, prepend=0)
        gaps[starts] = doc[starts]
        data, ends = packed(np.stack([gaps, tf], axis=1).reshape(-1))
        df = np.diff(np.r_[starts, len(term)])
        cuts = np.r_[0, ends[2 * (starts + df) - 1]].astype(np.int64)
        head = ids[order].tobytes() + lengths[order].tobytes()
        lists = pa.concat_arrays([pa.array([head], pa.large_binary()), pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(df), [None, pa.py_buffer(cuts), pa.py_buffer(data)])]).cast(pa.binary())
        names = pa.array([None, *self.terms], pa.binary())  # numbered in the order of their coming, as ``term`` is
        tokens = np.add.reduceat(tf, starts)
        return pa.record_batch([pa.array([uuid.uuid4().hex] * len(names)), names, pa.array(np.r_[n, df]), pa.array(np.r_[lengths.sum(), tokens]), lists], ["segment", "term", "df", "tokens", "postings"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The index as a written table: ``segment, term, df, tokens, postings``; a segment's row without term describes its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Segment()
        for batch in small_batches(batches, 64):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own.ids and own.size + len(text) > segment_bytes:
                    yield own.written()
                    own = _Segment()
                own.add(doc_id, text)
        if own.ids:
            yield own.written()

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text <> ''")
    return materialize(narrow.mapInArrow(run, INDEX))


# ---- search ------------------------------------------------------------------------------------------


def query_terms(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, term``, each pair once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 64):
            rows = [(i, t) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t in set(terms_of(text))]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["item_id", "term"])

    return queries.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).mapInArrow(run, "item_id long, term binary").distinct()


class Shard:
    """Answers of one shard: for each query a heap of its best documents so far."""

    def __init__(self, queries: list[list[bytes]], k: int, docs: int, tokens: int) -> None:
        self.queries, self.k, self.docs, self.tokens = queries, k, docs, tokens
        self.best: list[list[tuple[int, int]]] = [[] for _ in queries]  # (score, -doc_id), the worst first
        self.asked: defaultdict[bytes, list[int]] = defaultdict(list)
        for q, terms in enumerate(queries):
            for t in terms:
                self.asked[t].append(q)

    def segment(self, head: bytes, lists: list[tuple[bytes, int, bytes]]) -> None:
        """One segment: its documents, and ``term, weight, postings`` of the terms that are asked for."""
        ids, lengths = np.frombuffer(head, np.int64).reshape(2, -1)
        norm = NORM * (100 - HALF + (HALF * lengths * self.docs) // self.tokens)
        of_query: defaultdict[int, list] = defaultdict(list)
        for term, weight, postings in lists:
            pairs = unpacked(postings).reshape(-1, 2)
            place, tf = np.cumsum(pairs[:, 0]), pairs[:, 1]
            gain = weight * ((UNIT * tf) // (SCALE * tf + norm[place]))
            cursor = (int(gain.max()), place.tolist(), gain.tolist())
            if cursor[0] > 0:
                for q in self.asked[term]:
                    of_query[q].append(cursor)
        names = ids.tolist()
        for q, cursors in of_query.items():
            self._merge(self.best[q], sorted(cursors, key=lambda c: c[0]), names)

    def _merge(self, best: list[tuple[int, int]], cursors: list, names: list[int]) -> None:
        """Document at a time over ``cursors`` (best weight, places, weights), the weakest first."""
        k, n = self.k, len(cursors)
        bounds = np.cumsum([c[0] for c in cursors]).tolist()  # what the weakest i + 1 can add at most
        floor = best[0][0] if len(best) == k else 0
        lead = bisect_left(bounds, floor) if floor else 0  # weaker cursors can't make a result alone
        heap = [(cursors[i][1][0], i, 0) for i in range(lead, n)]
        heapify(heap)
        while heap:
            place = heap[0][0]
            score = 0
            while heap and heap[0][0] == place:
                _, i, at = heap[0]
                _, places, gains = cursors[i]
                score += gains[at]
                at += 1
                if at < len(places):
                    heapreplace(heap, (places[at], i, at))
                else:
                    heappop(heap)
            for i in range(lead - 1, -1, -1):
                if score + bounds[i] < floor:
                    break
                _, places, gains = cursors[i]
                at = bisect_left(places, place)
                if at < len(places) and places[at] == place:
                    score += gains[at]
            else:
                found = (score, -names[place])
                if score <= 0:
                    continue
                if len(best) < k:
                    heappush(best, found)
                elif found > best[0]:
                    heapreplace(best, found)
                else:
                    continue
                if len(best) == k and best[0][0] > floor:
                    floor = best[0][0]
                    if (more := bisect_left(bounds, floor)) > lead:
                        lead = more
                        heap = [x for x in heap if x[1] >= lead]
                        heapify(heap)


def search(index: DataFrame, terms: DataFrame, k: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score`` for the queries ``item_id, term``: each one's ``k`` best documents with a score above 0."""
    spark = index.sparkSession
    terms = materialize(terms)
    n_terms, n_items = terms.agg(F.count("*"), F.countDistinct(F.coalesce("item_id", F.lit(LAST)))).first()
    docs, tokens = index.where("term is null").agg(F.sum("df"), F.sum("tokens")).first()
    if not n_terms or not docs:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    blocks = min(-(-n_terms // BLOCK_TERMS), n_items)
    found = None
    for block in range(blocks):
        own = terms.where(F.pmod(F.xxhash64(F.col("item_id")), F.lit(blocks)) == block)
        part = _searched(index, own, k, docs, tokens)
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _searched(index: DataFrame, terms: DataFrame, k: int, docs: int, tokens: int) -> DataFrame:
    """``item_id, doc_id, score``: the best of each shard, for one block of queries, which goes to every shard."""
    spark = index.sparkSession
    asked: defaultdict[int | None, list[bytes]] = defaultdict(list)
    for batch in terms.toArrow().to_batches():
        for item, term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            asked[item].append(term)
    items, queries = list(asked), spark.sparkContext.broadcast(list(asked.values()))
    lists = materialize(index.join(terms.select("term").distinct(), "term"))
    ratio = (F.lit(2) * docs + 2).cast("double") / (F.lit(2) * F.sum("df") + 1).cast("double")
    weights = lists.groupBy("term").agg(F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("weight")).where("weight > 0")
    heads = index.where("term is null").select("segment", "term", F.lit(None).cast("long").alias("weight"), "postings")
    rows = lists.join(weights, "term").select("segment", "term", "weight", "postings").unionByName(heads)
    dealt = rows.repartition("segment").sortWithinPartitions("segment", F.col("term").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(queries.value, k, docs, tokens)
        segment, head, held = None, None, []
        for batch in small_batches(batches):
            for name, term, weight, postings in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if name != segment:
                    if held:
                        shard.segment(head, held)
                    segment, held = name, []
                if term is None:
                    head = postings
                else:
                    held.append((term, weight, postings))
        if held:
            shard.segment(head, held)
        for at in range(0, len(items), 512):
            rows = [(item, -neg, score) for item, best in zip(items[at : at + 512], shard.best[at : at + 512]) for score, neg in best]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([None if r[1] == LAST else r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["item_id", "doc_id", "score"])

    return dealt.mapInArrow(run, "item_id long, doc_id long, score long")


def op13_lexical_search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``item_id, rank, doc_id, score``: the 50 best documents for each benchmark item."""
    return search(build_index(docs), query_terms(benchmark))


def oracle_sql() -> str:
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({lower}, '{term}') AS terms FROM documents),
own AS (SELECT row, doc_id, len(terms) AS n, terms FROM d WHERE len(terms) > 0),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS tokens FROM own),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({lower}, '{term}')) AS term FROM benchmark),
places AS (SELECT row, unnest(terms) AS term FROM own),
tf AS (SELECT row, term, count(*) AS tf FROM places SEMI JOIN asked USING (term) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), whole),
gains AS (SELECT row, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // tokens))) AS gain FROM tf JOIN weights USING (term) JOIN own USING (row), whole),
scores AS (SELECT item_id, row, sum(gain)::BIGINT AS score FROM gains JOIN asked USING (term) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank, doc_id, score FROM scores JOIN own USING (row) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50"""

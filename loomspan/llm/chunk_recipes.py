"""Exact dedup by content-defined chunk recipes.

A text is cut where a rolling hash of its last bytes says so, hence equal texts are cut alike wherever they stand. Each chunk has an
identifier, a text is the ordered list of its chunks' identifiers (its *recipe*, about 8 bytes a KiB), and texts are compared by
their recipes: long documents do not travel.

Identifiers are verified, not trusted: of all documents whose recipes meet, the chunks are deduplicated by identifier *and* bytes,
combined on the map side, so a group of copies of any size sends each chunk once per task. If an
identifier stands for two different chunks, the next numbering (another seed) is taken until none does; then equal recipes are equal texts.
Where recipes differ, texts differ without any test.

Defined cases: a null text counts as empty; empty texts have the empty recipe and are copies of each other; texts of any length are read whole; the largest
doc_id stays (null ids below all others); of rows that share doc_id and text exactly one is kept; an empty table gives an empty result;
other columns do not matter and pass through ``without_copies``, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import join_hot, keep_rows, small_batches, text_key
from loomspan.storage import materialize

#: Bytes of a chunk: at least, at most (but for the last one); about 2,048 beyond the least in the mean.
LEAST, MOST = 512, 16_384
_BITS = 11
#: Bytes that the rolling hash sees.
WINDOW = 16
#: Bytes hashed at once.
BLOCK = 1 << 20
#: Width in bits of the identifiers of each numbering that is tried.
WIDTHS = (128,) * 8
#: Shared recipes up to which their keys (8 bytes each) are broadcast to pass over chunks that need no test.
FILTER_KEYS = 1 << 20

_GEAR = np.random.default_rng(42).integers(1 << 32, size=256, dtype=np.uint32)


def cut_places(data: np.ndarray) -> list[int]:
    """Ends of chunks that the rolling hash allows, over the whole buffer, in order."""
    found = []
    for at in range(0, len(data), BLOCK):
        lead = min(at, WINDOW - 1)
        rolled = _GEAR[data[at - lead : at + BLOCK]]
        step = 1
        while step < WINDOW:  # each round doubles the bytes that a value covers
            rolled[step:] += rolled[:-step] << np.uint32(step)
            step *= 2
        found.append(np.flatnonzero(rolled[lead:] >> np.uint32(32 - _BITS) == 0) + (at + 1))
    return np.concatenate(found).tolist() if found else []


def chunk_ends(places: Sequence[int], start: int, end: int) -> Iterator[int]:
    """Ends of the chunks of the bytes from ``start`` to ``end``, by the allowed places of the whole buffer."""
    while start < end:
        i = bisect_left(places, start + LEAST)
        start = min(places[i] if i < len(places) else end, start + MOST, end)
        yield start


def _texts(batch: pa.RecordBatch) -> tuple[memoryview, np.ndarray, list[int]]:
    """All bytes of the last column, the offset of each text, and the allowed places."""
    texts = batch.column(batch.num_columns - 1).cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = memoryview(data)[offsets[0] : offsets[-1]] if data is not None else memoryview(b"")
    return whole, offsets - offsets[0], cut_places(np.frombuffer(whole, np.uint8))


def _named(chunk: memoryview, seed: int, width: int) -> bytes:
    return (xxhash.xxh3_128_intdigest(chunk, seed) >> (128 - width)).to_bytes(16, "big")


def _key(recipe: bytes) -> int:
    return xxhash.xxh64_intdigest(recipe) - (1 << 63)


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, width: int = 128) -> DataFrame:
    """``doc_id, text_key, recipe, key, sha256`` for each row; ``key`` is 64 bits of the recipe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            whole, offsets, places = _texts(batch)
            made, digests = [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                ends = list(chunk_ends(places, a, b))
                made.append(b"".join([_named(whole[s:e], seed, width) for s, e in zip([a, *ends], ends)]))
                digests.append(hashlib.sha256(whole[a:b]).digest())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(made, pa.binary()), pa.array(map(_key, made), pa.int64()), pa.array(digests, pa.binary())], ["doc_id", "text_key", "recipe", "key", "sha256"])

    text = F.col(text_col)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text).alias("text_key"), text.alias("text"))
    return narrow.mapInArrow(run, "doc_id long, text_key long, recipe binary, key long, sha256 binary")


def chunks(docs: DataFrame, text_col: str = "text", seed: int = 0, width: int = 128) -> DataFrame:
    """``key, id, chunk`` of every text: the key of its recipe, and each chunk with its identifier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            whole, offsets, places = _texts(batch)
            keys, ids, parts = [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                ends = list(chunk_ends(places, a, b))
                own = [_named(whole[s:e], seed, width) for s, e in zip([a, *ends], ends)]
                keys += [_key(b"".join(own))] * len(own)
                ids += own
                parts += [bytes(whole[s:e]) for s, e in zip([a, *ends], ends)]
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(ids, pa.binary()), pa.array(parts, pa.binary())], ["key", "id", "chunk"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "key long, id binary, chunk binary")


def is_verified(found: DataFrame, shared: DataFrame) -> bool:
    """Whether no identifier among the chunks ``key, id, chunk`` of the recipes ``shared`` (``key``) stands for two different chunks.

    The semi-join only passes over chunks without need of a test; where its keys are too many to broadcast, all chunks are tested.
    """
    keys = shared.select("key").distinct()
    if keys.count() <= FILTER_KEYS:
        found = found.join(F.broadcast(keys), "key", "left_semi")
    contents = found.select("id", "chunk").distinct()
    return contents.groupBy("id").count().where("count > 1").isEmpty()


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", widths: Sequence[int] = WIDTHS) -> tuple[DataFrame, DataFrame]:
    """Rows ``doc_id, text_key, recipe, n`` (equal ones counted) and groups ``recipe, keep_id, group_size, sha256``, by verified identifiers."""
    for seed, width in enumerate(widths):
        rows = materialize(recipes(docs, id_col, text_col, seed, width))
        groups = materialize(rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.first("key").alias("key"), F.first("sha256").alias("sha256")))
        if is_verified(chunks(docs, text_col, seed, width), groups.where("group_size > 1")):
            return rows.groupBy("doc_id", "text_key", "recipe").agg(F.count("*").alias("n")), groups.drop("key")
    raise ValueError("no numbering of the chunks is free of clashes")


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", widths: Sequence[int] = WIDTHS) -> DataFrame:
    """``doc_id, text_key, keep_id, group_size, kept, text_sha256`` for each row of ``docs``."""
    rows, groups = copy_groups(docs, id_col, text_col, widths)
    met = join_hot(rows, groups, ["recipe"], "group_size")
    each = met.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"))
    return each.select("doc_id", "text_key", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"), F.lower(F.hex("sha256")).alias("text_sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", widths: Sequence[int] = WIDTHS) -> DataFrame:
    """``docs`` with one row of each group of equal texts: the one of largest id."""
    keep = exact_copies(docs, id_col, text_col, widths).where("kept").select("doc_id", "text_key")
    return keep_rows(docs, keep, id_col, text_col)


def op11_chunk_recipes(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every document."""
    return exact_copies(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def oracle_sql() -> str:
    return """WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM t"""

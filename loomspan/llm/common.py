"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.storage import spread

#: Rows handled at once in a worker. Spark bounds the bytes of a batch, this bounds the Python objects made of it.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; documents in fewer splits than cores are dealt to all cores."""
    own = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(own) if name == "documents" else own


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = ARROW_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``rows``; empty batches are passed over."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``fn`` to each small Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(fn, small_batches(batches))

    return df.mapInArrow(run, schema)


def hash_sample(known: DataFrame, id_col: str, rows: int) -> DataFrame:
    """The ``rows`` rows of smallest id hash (all, if fewer). A threshold on the hash goes first, so that about
    twice as many rows meet in one task, not that many from each partition."""
    own = F.pmod(F.xxhash64(id_col), F.lit(1 << 40))
    n = known.count()
    if n > 4 * rows:
        known = known.where(own < int((1 << 40) * (2 * rows + 1000) / n))
    return known.orderBy(own, id_col).limit(rows)


def one_text_each(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text`` and the other columns of the bounded ``sample`` (``doc_id`` first): of rows that share an id
    one text, the smallest, so that no id brings more than one row."""
    label_id = "_sample_id"
    wanted = sample.select(F.col(sample.columns[0]).alias(label_id), *sample.columns[1:])
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(wanted), F.col("doc_id") == F.col(label_id))
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), *[F.first(c).alias(c) for c in sample.columns[1:]])


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted``, each with as many leading underscores as it takes not to clash with a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def text_key(text: Column) -> Column:
    """64 bits of the text; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def row_keys(doc_id: Column, key: Column) -> list[Column]:
    """``k1, k2``, never null: rows share them only if their id and text key are equal."""
    return [F.coalesce(doc_id.cast("long"), F.lit(0)).alias("k1"), F.xxhash64(doc_id.isNull(), key).alias("k2")]


def first_of_group(groups: DataFrame) -> DataFrame:
    """``doc_id, text_key`` of the smallest row of each ``root``: by id, nulls last, then by text key."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("first")
    return groups.groupBy("root").agg(first).select("first.doc_id", "first.text_key")


#: A key with at least this share of all rows is hot: there are at most that many of them.
HOT_SHARE = 200


def join_hot(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` with the columns of their group; ``keys`` are never null, ``groups`` has one row for each key and the number of its rows in ``size``.

    Groups that hold 1 / ``HOT_SHARE`` of all rows or more are at most ``HOT_SHARE`` rows: they are broadcast, so that no task gets all
    rows of one group; the others are joined by their keys. Both inputs are read twice.
    """
    most = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.where(F.col(size) * HOT_SHARE >= most)
    cold = groups.where(F.col(size) * HOT_SHARE < most)
    met = rows.join(F.broadcast(hot), keys)
    return met.unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))


def keep_rows(docs: DataFrame, keep: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that ``keep`` (``doc_id, text_key``) names; of rows that share both, one.

    One shuffle of the texts: both steps go by the same keys.
    """
    k1, k2 = free_names(docs, "k1", "k2")
    named = keep.select(*[c.alias(k) for c, k in zip(row_keys(F.col("doc_id"), F.col("text_key")), (k1, k2))])
    keyed = docs.withColumns(dict(zip((k1, k2), row_keys(F.col(id_col), text_key(F.col(text_col))))))
    return keyed.join(named, [k1, k2], "left_semi").dropDuplicates([k1, k2]).select(*docs.columns)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(col, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

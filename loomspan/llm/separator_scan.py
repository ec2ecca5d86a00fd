"""Token counts by a separator scan over flat token files.

A flat token file is a run of little-endian unsigned ids, 16 bits wide (32 for a vocabulary that needs it), without any
index; each document ends with the end-of-document id. Workers write such files to the shared folder, one per partition, and
workers read them back by ranges of bytes, blocks of a fixed number of ids, wherever these fall. A block is searched for the separator
at once, which gives the lengths of the documents inside it and two open ends: the ids before its first separator and those after
its last. A prefix scan over the blocks of a file stitches them: a document that spans blocks gets the
open tail, all blocks without separator, and the head of the block that ends it; the same scan numbers
the documents. It runs in two levels, inside stretches of ``STRETCH`` blocks and over the stretches, so that a file of any
length is no single task. Only one small row per block is shuffled.

A file counts only if the manifest of the job names it: the file of a lost or repeated task attempt has another name and is not read.

Defined cases: an empty file has no documents; a block without a separator only passes its length on; ids
after a file's last separator are an unfinished document and reported with ``complete`` false; an empty
or null text is a document of 0 tokens; very long texts span blocks; rows repeated under one id are documents of their own; a null id stays null; an
empty table gives an empty result; an id equal to the separator inside a text, or beyond the width, is an error; a file whose length is no
multiple of the width is an error; other columns of the input do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm.bpe_codec import BpeCodec, load_codec
from loomspan.llm.common import small_batches
from loomspan.storage import materialize, new_path

BLOCK_IDS = 1 << 17
#: Blocks of one stretch of the prefix scan.
STRETCH = 1024
END = 50_256
#: Ids held in a worker before they go to its file.
BUFFER = 1 << 20


def width_of(codec: BpeCodec, end: int) -> int:
    """Bytes of an id: 2, or 4 where the vocabulary or the separator needs them."""
    return 2 if max(end, *codec.pieces) < 1 << 16 else 4


def open_path(path: str) -> tuple[FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return FileSystem.from_uri(path)


def packed_ids(ids: np.ndarray, end: int, width: int) -> bytes:
    """Ids of one text in the width of the file; raises where the file could not be read back."""
    if len(ids) and (int(ids.max()) >> (8 * width) or (ids == end).any()):
        raise ValueError(f"an id of the text is the separator {end} or does not fit {8 * width} bits")
    return ids.astype(f"<u{width}").tobytes()


def write_token_files(docs: DataFrame, codec: BpeCodec | None = None, end: int = END, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write flat files of the tokenised texts to ``folder`` (default: a new one in the shared folder).

    Returns the manifest ``file, width, doc_no, doc_id``: one row per document, in the order of the files.
    """
    spark = docs.sparkSession
    codec = codec or load_codec()
    width = width_of(codec, end)
    shared = spark.sparkContext.broadcast(codec)
    folder = folder or new_path(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, task = shared.value, TaskContext.get()
        name = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}.bin"
        mark = np.array([end], f"<u{width}").tobytes()
        out, parts, held, written = None, [], 0, 0
        for batch in small_batches(batches):
            for text in batch.column(1).to_pylist():
                parts += [packed_ids(np.frombuffer(own.encode_packed(text), "<u4"), end, width), mark]
                held += len(parts[-2]) // width + 1
                if held >= BUFFER:
                    out = out or _create(name)
                    out.write(b"".join(parts))
                    parts, held = [], 0
            n = batch.num_rows
            yield pa.record_batch([pa.array([name] * n), pa.array(np.full(n, width, np.int32)), pa.array(np.arange(written, written + n)), batch.column(0)], ["file", "width", "doc_no", "doc_id"])
            written += n
        if written:
            out = out or _create(name)
            out.write(b"".join(parts))
            out.close()

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return materialize(narrow.mapInArrow(run, "file string, width int, doc_no long, doc_id long"))


def _create(name: str):
    system, path = open_path(name)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path)


def token_blocks(files: DataFrame, block_ids: int = BLOCK_IDS) -> DataFrame:
    """``file, width, block, at, size``: the byte ranges of the files ``file, width, length``."""
    step = F.col("width") * block_ids
    last = F.floor((F.col("length") - 1) / step).cast("long")
    opened = files.where("length > 0").select("file", "width", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    return opened.select("file", "width", "block", (F.col("block") * step).alias("at"), F.least(step, F.col("length") - F.col("block") * step).alias("size"))


def listed(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """``file, width, length`` of all files of a folder; no content is read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.lit(width).alias("width"), "length")


def scan_blocks(blocks: DataFrame, end: int = END) -> DataFrame:
    """``file, block, separators, head, tail, inner``: one row per block of ``token_blocks``.

    ``head``: ids before the first separator (all, where there is none); ``tail``: ids after the last;
    ``inner``: lengths of the documents that lie wholly inside.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        systems: dict[str, tuple] = {}
        for batch in small_batches(batches):
            out = []
            for file, width, at, size in zip(*(batch.column(c).to_pylist() for c in ("file", "width", "at", "size"))):
                if size % width:
                    raise ValueError(f"{file}: its length is no multiple of {width} bytes")
                if file not in systems:
                    systems = {file: open_path(file)}
                system, path = systems[file]
                with system.open_input_file(path) as data:
                    ids = np.frombuffer(data.read_at(size, at), f"<u{width}")
                found = np.flatnonzero(ids == end)
                if len(found):
                    out.append((len(found), int(found[0]), len(ids) - int(found[-1]) - 1, (np.diff(found) - 1).tolist()))
                else:
                    out.append((0, len(ids), len(ids), []))
            n, head, tail, inner = zip(*out)
            yield pa.record_batch([batch.column("file"), batch.column("block"), pa.array(n, pa.int64()), pa.array(head, pa.int64()), pa.array(tail, pa.int64()), pa.array(inner, pa.list_(pa.int64()))], ["file", "block", "separators", "head", "tail", "inner"])

    parts = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = blocks.repartition(parts, "file", "block").sortWithinPartitions("file", "block")
    return dealt.mapInArrow(run, "file string, block long, separators long, head long, tail long, inner array<long>")


def _scan(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Adds ``no`` (separators before) and ``carry`` (open ids before) to rows ``separators, tail`` of each key in order."""
    before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("no", F.coalesce(F.sum("separators").over(before), F.lit(0)))
    # rows without separator pass their whole length on, up to the next one that has some
    stretch = Window.partitionBy(*keys, "no").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    open_tail = F.coalesce(F.last(F.when(F.col("separators") > 0, F.col("tail")), ignorenulls=True).over(before), F.lit(0))
    passed = F.coalesce(F.sum(F.when(F.col("separators") == 0, F.col("tail"))).over(stretch), F.lit(0))
    return numbered.withColumn("carry", open_tail + passed)


def count_tokens(blocks: DataFrame, end: int = END) -> DataFrame:
    """``file, block, doc_no, n_tokens, complete``: every document, numbered from 0 in its file, in the
    block that ends it."""
    scanned = materialize(scan_blocks(blocks, end).withColumn("stretch", F.floor(F.col("block") / STRETCH)))
    inside = _scan(scanned, ["file", "stretch"], "block")
    # a stretch as one row: its separators, and what it leaves open
    left_open = F.when(F.col("separators") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail"))
    whole = inside.groupBy("file", "stretch").agg(F.sum("separators").alias("separators"), F.max_by(left_open, "block").alias("tail"), F.max("block").alias("last"))
    over = _scan(whole, ["file"], "stretch").select("file", "stretch", F.col("no").alias("_no"), F.col("carry").alias("_carry"), F.max("last").over(Window.partitionBy("file")).alias("last"))
    known = inside.join(over, ["file", "stretch"]).withColumns({"carry": F.col("carry") + F.when(F.col("no") == 0, F.col("_carry")).otherwise(0), "no": F.col("no") + F.col("_no")})
    lengths = F.when(F.col("separators") > 0, F.concat(F.array(F.col("carry") + F.col("head")), F.col("inner"))).otherwise(F.array().cast("array<bigint>"))
    done = known.select("file", "block", "no", F.posexplode(lengths).alias("i", "n_tokens")).select("file", "block", (F.col("no") + F.col("i")).alias("doc_no"), "n_tokens", F.lit(True).alias("complete"))
    rest: Column = F.when(F.col("separators") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("head"))
    open_end = known.where("block = last").select("file", "block", (F.col("no") + F.col("separators")).alias("doc_no"), rest.alias("n_tokens"), F.lit(False).alias("complete")).where("n_tokens > 0")
    return done.unionByName(open_end)


def file_lengths(manifest: DataFrame) -> DataFrame:
    """``file, width, length`` of the files that a manifest names."""
    names = manifest.select("file", "width").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sizes = [system.get_file_info(path).size for system, path in map(open_path, batch.column(0).to_pylist())]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["file", "width", "length"])

    return names.mapInArrow(run, "file string, width int, length long")


def op9_separator_scan(docs: DataFrame) -> DataFrame:
    """``doc_id, file, doc_no, n_tokens`` of every document, counted in flat token files. ``file`` names the partition
    that wrote it, without the number of the attempt, so that reruns agree."""
    manifest = write_token_files(docs)
    counted = count_tokens(token_blocks(materialize(file_lengths(manifest))))
    return counted.join(manifest.drop("width"), ["file", "doc_no"]).select("doc_id", F.regexp_extract("file", r"(part-\d+)-\d+\.bin$", 1).alias("file"), "doc_no", "n_tokens")

"""E-book archives as a data source: ``spark.read.format("book_archives")`` and ``df.write.format("book_archives")``.

Reading, an archive is listed by the driver and opened by a task; archives are dealt to partitions by size. Only what is selected is read: with ``columns`` that
lack ``content``, no member is unpacked. Writing, each task stages one file per archive beside its place, under a name that only it uses; the driver
renames them when all tasks are done, and an abort removes them. An archive that exists is never replaced.

The folder is opened by ``pyarrow.fs`` in driver and workers: a path or URI that all of them reach.
"""

from __future__ import annotations

import io
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from loomspan.sources.books import MAX_ARCHIVE, opened

NAME = "book_archives"
SCHEMA = "path string, ord int, name string, size long, crc long, content binary, fault string"
#: Bytes of archives that one partition reads, and rows of a batch.
PARTITION_BYTES, BATCH = 64 << 20, 256
STAGED = ".staged-"


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
    return system, path.rstrip("/")


@dataclass
class Archives(InputPartition):
    files: list[tuple[str, int]]


@dataclass
class Staged(WriterCommitMessage):
    """``staged name, final name`` of what a task has written."""

    files: list[tuple[str, str]]


class BookArchives(DataSource):
    """Options: ``path``, the folder; for reading also ``columns``, the columns wanted (all by default)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        fields = dict(f.split(" ") for f in SCHEMA.split(", "))
        if not set(wanted) <= set(fields):
            raise ValueError(f"columns must be among {', '.join(fields)}")
        return ", ".join(f"{c} {fields[c]}" for c in wanted) if wanted else SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("archives are never replaced: write with mode append")
        if not {"path", "ord", "name", "content"} <= set(schema.names):
            raise ValueError("archives are written from the columns path, ord, name and content")
        return ArchiveWriter(self.options["path"])


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, schema: StructType) -> None:
        self.folder, self.names = folder, schema.names
        self.arrow = pa.schema([(f.name, {"string": pa.string(), "integer": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[f.dataType.typeName()]) for f in schema])

    def partitions(self) -> list[Archives]:
        """Archives in order of name, as many to a partition as fill it; what a writer has staged is no archive yet."""
        system, path = _open(self.folder)
        found = sorted((f.path, f.size) for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.type == fs.FileType.File and f.path.endswith(".epub") and STAGED not in f.path)
        parts: list[Archives] = []
        filled = PARTITION_BYTES
        for name, size in found:
            if filled + size > PARTITION_BYTES:
                parts.append(Archives([]))
                filled = 0
            parts[-1].files.append((name, size))
            filled += size
        return parts or [Archives([])]

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.folder)
        rows: list[dict] = []
        filled = 0
        for name, size in partition.files:
            for row in self._members(system, name, size):
                rows.append(row)
                filled += len(row["content"] or b"")
                if len(rows) == BATCH or filled > PARTITION_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, self.arrow)
                    rows, filled = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, self.arrow)

    def _members(self, system: fs.FileSystem, name: str, size: int) -> Iterator[dict]:
        """One row a member; an archive that does not pass the guards is one row with its fault."""
        path = name.rsplit("/", 1)[-1]
        fault = {"path": path, "ord": -1, "name": None, "size": None, "crc": None, "content": None}
        if size > MAX_ARCHIVE:
            yield fault | {"fault": "archive: size"}
            return
        with system.open_input_file(name) as data:
            whole = data.read()
        try:
            archive = opened(whole)
        except (ValueError, KeyError, zipfile.BadZipFile, zlib.error, SyntaxError) as e:
            yield fault | {"fault": str(e)[:200] or type(e).__name__}
            return
        for no, info in enumerate(archive.infolist()):
            row = {"path": path, "ord": no, "name": info.filename, "size": info.file_size, "crc": info.CRC, "content": None, "fault": None}
            if "content" in self.names:
                try:
                    row["content"] = archive.read(info)
                except (zipfile.BadZipFile, zlib.error) as e:
                    row["fault"] = str(e)[:200]
            yield row


class ArchiveWriter(DataSourceWriter):
    """Rows of an archive must stand together in a partition, in the order of ``ord``: see ``write_archives``."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, rows: Iterator[Row]) -> Staged:
        system, root = _open(self.folder)
        system.create_dir(root, recursive=True)
        done: list[tuple[str, str]] = []
        now: str | None = None
        buffer, archive = io.BytesIO(), None

        def close() -> None:
            if archive is not None:
                archive.close()
                staged = f"{root}/{STAGED}{uuid.uuid4().hex}-{now}"
                done.append((staged, f"{root}/{now}"))
                with system.open_output_stream(staged) as out:
                    out.write(buffer.getbuffer())

        try:
            for row in rows:
                if row["path"] is None or "/" in row["path"] or not row["path"].endswith(".epub"):
                    raise ValueError(f"no name of an archive: {row['path']}")
                if row["path"] != now:
                    close()
                    if any(final == f"{root}/{row['path']}" for _, final in done):
                        raise ValueError(f"rows of {row['path']} do not stand together")
                    now, buffer = row["path"], io.BytesIO()
                    archive = zipfile.ZipFile(buffer, "w")
                kind = zipfile.ZIP_STORED if row["name"] == "mimetype" else zipfile.ZIP_DEFLATED
                archive.writestr(zipfile.ZipInfo(row["name"]), bytes(row["content"] or b""), kind)
            close()
        except BaseException:
            _remove(system, done)  # a task that fails hands nothing on: it clears up for itself
            raise
        return Staged(done)

    def commit(self, messages: list[Staged | None]) -> None:
        system, _ = _open(self.folder)
        files = [f for m in messages if m for f in m.files]
        names = [final for _, final in files]
        there = [f.path for f in system.get_file_info(names) if f.type != fs.FileType.NotFound] if names else []
        if there or len(set(names)) < len(names):
            _remove(system, files)
            raise FileExistsError(f"archives are never replaced: {there[:5] or 'a name comes from two tasks'}")
        for staged, final in files:
            system.move(staged, final)

    def abort(self, messages: list[Staged | None]) -> None:
        system, _ = _open(self.folder)
        _remove(system, [f for m in messages if m for f in m.files])


def _remove(system: fs.FileSystem, files: list[tuple[str, str]]) -> None:
    for staged, _ in files:
        if system.get_file_info(staged).type != fs.FileType.NotFound:
            system.delete_file(staged)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BookArchives)


def write_archives(members, folder: str) -> None:
    """Writes ``path, ord, name, content`` (one row a member) as archives: the type entry first, all others in the order of ``ord``."""
    from pyspark.sql import functions as F

    register(members.sparkSession)
    placed = members.select("path", "ord", "name", "content").repartition("path")
    ordered = placed.sortWithinPartitions("path", F.col("name") != "mimetype", "ord")
    ordered.write.format(NAME).mode("append").option("path", folder).save()

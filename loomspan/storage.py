"""Where intermediate results live.

Every helper writes to the folder that the session names in ``spark.checkpoint.dir``; all executors
share it, so a lost executor costs a re-read and never the result. Tables are grouped by application: those written inside
``scratch`` go at its end, all others with ``release`` or when the driver's process ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextvars import ContextVar
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_written: ContextVar[list[str] | None] = ContextVar("written", default=None)
_to_release: set[str] = set()

#: With it, the shuffle files of a query go at its end instead of with the driver's garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once per application: functions that run there are found by name."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent.parent
    if not root.is_dir():  # imported from an archive: it was shipped before
        return
    archive = f"{tempfile.mkdtemp(prefix='loomspan-')}/loomspan.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((root / "loomspan").rglob("*.py")):
            out.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(archive)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session. Where none is set and the master is local, a temporary one is made."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomspan-"))
    return sc.getCheckpointDir().rstrip("/")


def tables_dir(spark: SparkSession) -> str:
    """The folder of this application's tables; it is emptied when the driver's process ends."""
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"
    if path not in _to_release:
        _to_release.add(path)
        atexit.register(_delete_at_exit, spark, path)
    return path


def new_path(spark: SparkSession) -> str:
    """A fresh folder among this application's tables, with the lifetime of a table."""
    path = f"{tables_dir(spark)}/{uuid.uuid4().hex}"
    own = _written.get()
    if own is not None:
        own.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    # the JVM may be gone already: then the folder stays for the cluster's own cleaning
    with contextlib.suppress(Py4JError, OSError, AttributeError):
        delete(spark, path)


def release(spark: SparkSession) -> None:
    """Delete all tables that this application has written; frames that read them end with it."""
    delete(spark, tables_dir(spark))


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end; a result must be written outside of it, or by ``materialize(..., stays=True)``."""
    token = _written.set([])
    try:
        yield
    finally:
        for path in _written.get() or ():
            delete(spark, path)
        _written.reset(token)


@contextlib.contextmanager
def without_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that are run inside leave no shuffle files: for writers, whose result is in the table."""
    held = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_GO, held)


def materialize(df: DataFrame, stays: bool = False, path: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends here.

    ``stays``: the table outlives the ``scratch`` around it. ``path``: a ``new_path`` of an outer scope, with which the table goes.
    """
    spark = df.sparkSession
    path = path or (f"{tables_dir(spark)}/{uuid.uuid4().hex}" if stays else new_path(spark))
    with without_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt to all cores where it is read in fewer splits than cores: a small file is one row group, hence one task.
    Tables of as many splits stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint for small iterative state; Spark cleans the files when the frame goes."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)

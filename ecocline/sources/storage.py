"""Shared-folder storage: lineage cuts and written tables that outlive a lost executor."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []
#: Remove the shuffle files of a query at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What a batch of rows on its way to Python holds at most: ten thousand long texts, Spark's own bound, are
#: tens of MB, several times over, in either process of a task.
_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only where it is unset, a folder under the warehouse, which all executors share; a warehouse on
    a local disk is accepted from a local master alone.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"
        local = context._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(
            context._jsc.hadoopConfiguration()
        )
        if local.getUri().getScheme() == "file" and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later stages restart from files, not from the whole history."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder; what is written there is removed at the end."""
    if not _WRITTEN:
        atexit.register(remove_written)
    _WRITTEN.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write as Parquet and read back, so that several consumers scan one stored result.

    Once the table is written, its shuffle files are of no more use: Spark is asked to remove them
    then, not whenever the driver collects its garbage.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with _set(spark, _CLEANUP, "true"), small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting inside the ``with`` block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def small_batches(spark: SparkSession):
    """Inside the ``with`` block rows go to Python in batches of a few MB, or less where so set."""
    key, most = _BATCH
    own = spark.conf.get(key, None) or ""
    return _set(spark, key, min(own, most, key=int) if own.isdigit() and int(own) > 0 else most)


@contextmanager
def collected() -> Iterator[list[str]]:
    """The paths that are written inside the ``with`` block, for ``release``."""
    paths: list[str] = []
    before = len(_WRITTEN)
    try:
        yield paths
    finally:
        paths.extend(_WRITTEN[before:])


def _roots(df: DataFrame) -> str:
    """Paths of the tables that a plan reads, also where their rows are cached."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found = []
    for i in range(leaves.size()):
        try:
            found.append(leaves.apply(i).relation().location().rootPaths().mkString(" "))
        except (Py4JError, TypeError):  # not a table in files
            continue
    return " ".join(found)


def release(spark: SparkSession, paths: list[str], *readers: DataFrame) -> list[str]:
    """Delete stored tables at once, but for those that one of ``readers`` still reads; returns these."""
    read = " ".join(_roots(df) for df in readers)
    kept = [p for p in paths if p.rsplit("/", 1)[-1] in read]
    _delete(spark, [p for p in paths if p not in kept])
    return kept


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
        if name in _WRITTEN:
            _WRITTEN.remove(name)


def remove_written() -> None:
    """Delete the tables this session wrote under ``new_path``, while the session still lives."""
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    _delete(spark, list(_WRITTEN))

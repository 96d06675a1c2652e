"""Cutting points of long plans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's switch for deleting shuffle files when the action that wrote them ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Where what is staged lies.
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where none is set, a temporary one is on a local master, as in tests; elsewhere it is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of actions inside go when their action ends; the session's own setting is put back."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder, its lineage cut, so that what comes next neither plans nor computes it again; a lost executor loses nothing.

    Written as Parquet: a checkpoint is neither compressed nor read by columns, and has no size of its own.
    """
    out, path = rewritten(df)
    _folders[out] = path
    return out


def staged_apart(df: DataFrame, flag: str) -> tuple[DataFrame, DataFrame]:
    """Rows of df where flag, which is never null, is false, and those where it is true, without it: staged in one pass, to be dropped each by itself."""
    spark, schema = df.sparkSession, df.drop(flag).schema
    path = f"{shared_folder(spark)}/round-{uuid.uuid4().hex}"
    with shuffles_end(spark):
        df.write.partitionBy(flag).option("compression", "zstd").parquet(path)
    found = []
    for value in ("false", "true"):
        files, at = _hadoop(spark, folder := f"{path}/{flag}={value}")
        files.mkdirs(at)  # there is none where no row has the value
        found.append(spark.read.schema(schema).parquet(folder))
        _folders[found[-1]] = folder
    return tuple(found)


def dropped(*frames: DataFrame) -> None:
    """Delete what staged gave; nothing may read it any more, nor what was made of it and isn't staged itself. Frames that weren't staged have nothing to delete."""
    for frame in frames:
        if (path := _folders.pop(frame, None)) is not None:
            _delete(frame.sparkSession, path)


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _delete(spark: SparkSession, path: str) -> None:
    files, at = _hadoop(spark, path)
    files.delete(at, True)


def rewritten(df: DataFrame, last: str | None = None) -> tuple[DataFrame, str]:
    """df written as Parquet to the shared folder and read again, and where; the table of the round before, at last, is deleted.

    For rounds that join a table with itself: a checkpoint keeps the estimated size of what it was made of, a
    product that each round squares, until planning takes longer than the work; a file has its own size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/round-{uuid.uuid4().hex}"
    with shuffles_end(spark):
        df.write.option("compression", "zstd").parquet(path)
    if last is not None:
        _delete(spark, last)
    return spark.read.schema(df.schema).parquet(path), path


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has at most so many rows; it has to be written already, as it is counted here."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df

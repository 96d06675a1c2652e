"""Scratch folders and byte files that every executor and the driver can reach."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

T = TypeVar("T")

#: What this Python worker keeps from task to task, by name.
_kept: dict[str, object] = {}
#: Byte that Spark's text writer puts after each row of a byte file.
SEPARATOR = b"\0"


#: Of each open space, the paths made in it.
_spaces: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir. Where none is set, a temporary folder is, but only on a local master: executors elsewhere wouldn't see it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return _noted(f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}")


def _noted(path: str) -> str:
    for made in _spaces[-1:]:
        made.append(path)
    return path


@contextmanager
def space(spark: SparkSession) -> Iterator[list[str]]:
    """Paths that are made inside are deleted at its end, but for those taken out of the list. Nothing may read them any more by then."""
    _spaces.append(made := [])
    try:
        yield made
    finally:
        _spaces.remove(made)
        for path in made:
            discard(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder, its lineage cut."""
    scratch(df.sparkSession, "cut")
    out = df.checkpoint()
    if _spaces and (file := out._jdf.queryExecution().logical().rdd().getCheckpointFile()).isDefined():
        _noted(file.get())
    return out


def stored(df: DataFrame, name: str, compression: str = "snappy", path: str | None = None) -> DataFrame:
    """df written as Parquet in the shared folder, at path if one is given, and read again."""
    path = path or scratch(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more, as all made from it is written itself."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def kept(name: str, make: Callable[[], T]) -> T:
    """What make gives, made once a worker and kept until it works for something else."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]  # type: ignore[return-value]


def let_go(but: str = "") -> None:
    """Drop what this worker keeps, but for one. By a function of this module, as a nested one would be sent with a copy of the table."""
    for name in _kept.keys() - {but}:
        del _kept[name]


def in_workers(rows: DataFrame, of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, keeps: str = "") -> DataFrame:
    """rows.mapInArrow(of, schema) by workers that first let go what they kept from earlier tasks, but for keeps.

    Spark gives a worker to one operator after the other, and each worker's tables would stay beside the next one's data.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(keeps)
        yield from of(batches)

    return rows.mapInArrow(run, schema)


def write_bytes(rows: DataFrame, column: str, path: str, rows_per_file: int = 0) -> None:
    """Write binary rows one after the other, SEPARATOR behind each, one file a partition.

    Spark's own writer and commit protocol are used, so any file system that Spark knows will do,
    and what a lost or repeated task wrote is not seen.
    """
    writer = rows.select(F.col(column).cast("string")).write.option("lineSep", SEPARATOR.decode())
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.text(path)


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of each byte file; file is (part, piece), in the order of writing."""
    # anchored at the name's end, as the random part between the two numbers may hold -c and a digit
    number = lambda k: F.regexp_extract("path", r"/part-(\d+)-[^/]*-c(\d+)(?:\.[^/]*)?$", k).cast("long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.struct(number(1).alias("part"), number(2).alias("piece")).alias("file"), "content")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))

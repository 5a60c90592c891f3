"""Tables, and intermediate results that survive lost executors."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_dir(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="seqgraph-checkpoint-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where that is unset a temporary folder will do if all run in one process; anywhere else executors would
    write to disks that the driver can't read, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return _own_dir(spark.sparkContext.applicationId)
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


#: Folder name below shared_dir in which the innermost scratch() has intermediates written; each thread has its own.
_SCOPE: ContextVar[str | None] = ContextVar("scope", default=None)


def materialise(df: DataFrame, name: str, instead_of: DataFrame | None = None, outside: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts lineage, survives lost executors.

    instead_of: an earlier such table that nothing needs any more; it is deleted. outside: not into what scratch()
    deletes.
    """
    spark = df.sparkSession
    path = "/".join((shared_dir(spark), *filter(None, [None if outside else _SCOPE.get()]), f"{name}-{uuid.uuid4().hex}"))
    df.write.option("compression", "zstd").parquet(path)
    if instead_of is not None:
        discard(instead_of)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop, wherever it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete the folder of a table that materialise() returned."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediates written inside are deleted at the end; results that are still needed must be written
    elsewhere before."""
    scope = f"scratch-{uuid.uuid4().hex}"
    token = _SCOPE.set(scope)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        delete(spark, f"{shared_dir(spark)}/{scope}")

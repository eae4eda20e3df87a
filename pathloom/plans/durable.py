"""Tables kept between jobs, in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[tuple[SparkSession, str]]] = []
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where none is set, a local session gets a temporary folder of its own; on a
    cluster that folder would be another one on each machine, so it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="pathloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def durable(df: DataFrame, codec: str = "zstd", result: bool = False) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: its lineage ends there, and no lost
    executor takes any of it along. Within :func:`scratch` it is removed at the end, unless it is the ``result``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/pathloom-{uuid.uuid4().hex}"
    scopes = _scopes[:-1] if result else _scopes
    if scopes:
        scopes[-1].append((spark, path))
    df.write.option("compression", codec).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a table; if it is one that :func:`durable` wrote, that is not written again."""
    return df if df in _paths else durable(df)


def drop(*tables: DataFrame) -> None:
    """Removes tables that :func:`durable` wrote and that nothing reads any more, and what the jobs behind them left."""
    for df in tables:
        if df in _paths:
            remove(df.sparkSession, _paths.pop(df))
    if tables:
        tidy(tables[0].sparkSession)


def tidy(spark: SparkSession) -> None:
    """Spark removes the shuffle files of finished jobs when the driver's garbage is collected, which a driver with free memory puts
    off; until then its plans fill the heap and the files the disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def scratch() -> Iterator[None]:
    """Removes the tables that :func:`durable` writes inside, once the caller has written its results elsewhere. What reads
    such tables must not be used after it."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder on whatever file system it is."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

"""Results of lookups kept between runs, ``key, result``: dealt by key to buckets, a folder each, so that a batch reads those of its keys alone."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256
#: A bucket of more files than these is rewritten as one.
FILES = 8
_SCHEMA = "key string, result string, version bigint, bucket int"


def bucket(key: Column | str, buckets: int = BUCKETS) -> Column:
    """The bucket of a key; a cache keeps the number of buckets that it began with."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_SCHEMA).option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _SCHEMA)


def read(spark: SparkSession, path: str, keys: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``key, result`` of the greatest version of each key; of ``keys`` (``key``) alone if they are given, for which no other
    bucket is read. A cache not yet written is empty."""
    rows = _stored(spark, path)
    if keys is not None:
        # at most as many numbers as there are buckets
        near = [r.b for r in keys.select(bucket("key", buckets).alias("b")).distinct().collect() if r.b is not None]
        rows = rows.where(F.col("bucket").isin(near)).join(keys.select("key").distinct(), "key", "left_semi")
    return rows.groupBy("key").agg(F.max(F.struct("version", "result"))["result"].alias("result"))


def upsert(rows: DataFrame, path: str, version: int = 0, buckets: int = BUCKETS) -> None:
    """Adds ``key, result``, which from now on stand in for results of lesser versions. A bucket gets one file; null keys are left out.

    A run repeated with the same version changes nothing that :func:`read` gives, if its results are the same."""
    dealt = rows.where("key is not null").select("key", "result", F.lit(version).cast("long").alias("version"), bucket("key", buckets).alias("bucket"))
    dealt.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def compact(spark: SparkSession, path: str, files: int = FILES) -> list[int]:
    """Rewrites the buckets that have more than ``files`` files, each as one file without what later versions replaced; their numbers.

    A bucket is staged whole before it takes the place of its files. Should the job's driver be lost in between, results of the
    bucket may be gone and are looked up again."""
    rows = _stored(spark, path)
    n = Counter(int(m[1]) for f in rows.inputFiles() if (m := re.search(r"/bucket=(\d+)/", f)))
    many = sorted(b for b, k in n.items() if k > files)
    if many:
        last = rows.where(F.col("bucket").isin(many)).groupBy("bucket", "key").agg(F.max(F.struct("version", "result")).alias("x"))
        last.select("key", "x.result", "x.version", "bucket").repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return many

"""Payload documents as they arrive: the same shredding over a stream, and lookups of names not looked up before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pathloom.operators.linking import cache_key
from pathloom.plans.durable import durable, scratch
from pathloom.sources import cache, payload


def documents(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """A stream of payload documents from a folder of JSON files; those that are no object are left out."""
    raw = spark.readStream.schema(payload.SCHEMA + ", _bad string").option("columnNameOfCorruptRecord", "_bad").option("maxFilesPerTrigger", max_files).json(path)
    return raw.where("_bad is null").drop("_bad")


def participants(stream: DataFrame) -> DataFrame:
    return payload.participants(stream)


def lookup_new_names(stream: DataFrame, cache_path: str, checkpoint: str, compute: Callable[[DataFrame], DataFrame], source: str = "catalogue", buckets: int = cache.BUCKETS) -> StreamingQuery:
    """Looks up the registry names of each batch that the cache at ``cache_path`` doesn't have, and adds them to it.

    A batch reads the buckets of its names alone. Run again after a failure it finds its keys in the cache, so none is asked for twice."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        with scratch():
            names = durable(payload.entities(df).where("trim(coalesce(name, '')) <> ''").select(cache_key(source, F.col("name"), F.col("organism")).alias("key")).distinct())
            known = cache.read(spark, cache_path, names, buckets)
            cache.upsert(compute(names.join(known, "key", "left_anti")), cache_path, buckets=buckets)
        cache.compact(spark, cache_path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Joins in which one key may hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 32


def salted_join(large: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``large`` joined with ``small``, whose rows are given ``salts`` times over, so that a key's rows are dealt to as many
    tasks. For a ``small`` of few rows a key. A row's salt is of all its columns, so a rerun deals alike.

    Spark takes exploded rows to be as many as before and so would broadcast far more than it thinks. A join it sizes by the product:
    of ``range`` a row counts eight bytes, so an eighth of the salts comes by a join and each gives eight."""
    spread = large.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in large.columns if large.schema[c].dataType.typeName() not in ("map", "variant")]), F.lit(salts)).cast("int"))
    eighths = small.sparkSession.range(0, -(-salts // 8), 1, 1).withColumnRenamed("id", "_eighth")
    some = F.sequence((F.col("_eighth") * 8).cast("int"), F.least(F.col("_eighth") * 8 + 7, F.lit(salts - 1)).cast("int"))
    given = small.crossJoin(F.broadcast(eighths)).withColumn("_salt", F.explode(some)).drop("_eighth")
    return spread.join(given, [*keys, "_salt"], how).drop("_salt")


def spread_join(large: DataFrame, small: DataFrame, keys: list[str], salts: int = SALTS) -> DataFrame:
    """As :func:`salted_join`, where ``small`` has about as many keys as ``large`` has rows: a key's row is given for those
    salts alone that ``large`` has of it. ``large`` is read twice, so it should be a table."""
    spread = large.withColumn("_salt", F.pmod(F.xxhash64(*large.columns), F.lit(salts)).cast("int"))
    given = spread.select(*keys, "_salt").distinct().join(small, keys)
    return spread.join(given, [*keys, "_salt"]).drop("_salt")

"""Small relational forms used throughout: first of a key, in order, signatures. All aggregate partially, so a hot key is no hot task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The row of each key that comes first in the order; nulls last."""
    by = F.struct(*[x for o in order for c in [F.col(o) if isinstance(o, str) else o] for x in (c.isNull(), c)])
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), by).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def ordered(value: str | Column, *order: str) -> Column:
    """Aggregate: the values in order."""
    v = F.col(value) if isinstance(value, str) else value
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, v.alias("_v")))), lambda s: s["_v"])


def numbered(df: DataFrame, keys: list[str], *order: str | Column, name: str = "rn") -> DataFrame:
    from pyspark.sql import Window

    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))

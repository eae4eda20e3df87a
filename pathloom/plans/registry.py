"""Queries by name, each with its SQL twin where there is one.

A query is a function of :class:`Tables`, which reads the driver's tables and the model tables that stand on
them. In a twin, ``{name}`` is the stand-in's own SELECT.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from pathloom.sources.standins import STANDINS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in STANDINS:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        used = set(re.findall(r"\b(?:FROM|JOIN) ([a-z]+)\b", STANDINS[name]))
        text = re.sub(r"\b(FROM|JOIN) ([a-z]+)\b", r"\1 {\2}", STANDINS[name])
        return self.spark.sql(text, **{t: self.__getattr__(t) for t in used})

    def rows(self, ddl: str, *rows: tuple) -> DataFrame:
        """A fixed list: a dictionary, never data."""
        return self.spark.createDataFrame(list(rows), ddl)


def twin(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", lambda m: f"({twin(STANDINS[m[1]])})", sql)


def query(name: str, sql: str | None = None):
    def wrap(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = partial(_run, f)
        if sql:
            ORACLES[name] = twin(sql)
        return f

    return wrap


def _run(f: Callable[[Tables], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    return f(Tables(spark, sf_dir))

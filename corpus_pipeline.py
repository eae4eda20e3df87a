"""A training corpus from ``documents`` in five stages, each the whole of one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import decontaminate, line_dedup, packing, quality, simhash
from pathloom.llm.queries import tokenizer_path
from pathloom.plans.durable import durable, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the rules reject."""
    return quality.filter_documents(docs).select(*COLUMNS)


def line_winnowing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without runs of lines, or fewer lines of many words, that stand earlier in the corpus; documents with no line left go."""
    cut = line_dedup.dedup(docs, words=line_dedup.LONG_WORDS)
    return _documents(cut.where((F.col("n_removed_lines") == 0) | (F.col("n_removed_lines") < F.col("n_lines"))))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are linked by a similarity of 0.8 or more."""
    return simhash.keep_one_similar(docs).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without contaminated documents, and without the benchmark's passages in the others."""
    return _documents(decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def curve_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_winnowing), ("simhash_near_dedup", simhash_near_dedup), ("benchmark_decontamination", benchmark_decontamination), ("curve_packing", curve_packing)]

#: SQL can't express robust covariance, XXH64 or the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch():  # a stage's own tables go once its result is written
            docs = durable(stage(spark, docs, sf_dir), result=True)
    return STAGES[-1][1](spark, docs, sf_dir)

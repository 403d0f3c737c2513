"""The corpus pipeline: five stages, each written as Parquet and read back as the next one's documents.

A stage works on all that its predecessor kept and returns the columns of ``documents``; the last returns the digests of the
encoded texts. Documents go in the first stage (poor or toxic text), in the second (every line is held elsewhere), in the
third (all but one of a near-duplicate group) and in the fourth (a benchmark item inside).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitelens.llm.common import new_path
from sitelens.llm.op02_resampling import resample
from sitelens.llm.op03_bpe import digests, round_trip
from sitelens.llm.op06_templates import decontaminate
from sitelens.llm.op08_simhash import keep_one
from sitelens.llm.op10_lines import dedup_lines


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digests(round_trip(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The stages aren't expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None

"""Attributes: defaults and how often they are filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_defaults(attributes: Column, keys: list[str], value: str = "unspecified") -> Column:
    """Missing keys get the default; those there stay."""
    defaults = F.create_map(*(F.lit(x) for k in keys for x in (k, value)))
    have = F.coalesce(attributes, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(defaults, lambda k, _: ~F.map_contains_key(have, k)), have)


def unknown(key: str) -> Column:
    """Whether an attribute is missing or ``unspecified``."""
    return F.coalesce(F.col("attributes")[key], F.lit("unspecified")) == "unspecified"


def needs_reading(dets: DataFrame, least: float = 0.35) -> DataFrame:
    """Texts that OCR looks at: sure enough, and not known to be text or not."""
    return dets.where((F.col("class_name") == "text_or_logo") & (F.col("confidence") >= least) & unknown("is_text"))


def needs_label(dets: DataFrame, class_name: str, key: str) -> DataFrame:
    """Detections of a class that a classifier looks at: those whose attribute isn't known."""
    return dets.where((F.col("class_name") == class_name) & unknown(key))


def attribute_values(dets: DataFrame) -> DataFrame:
    """``class_name``, ``key``, ``value``, ``n``: every key a class ever has, over all its detections; a missing key is ``MISSING``."""
    have = dets.select("class_name", F.explode("attributes").alias("key", "value")).groupBy("class_name", "key", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = dets.groupBy("class_name").agg(F.count(F.lit(1)).alias("total"))
    missing = have.groupBy("class_name", "key").agg(F.sum("n").alias("n")).join(totals, "class_name").select("class_name", "key", F.lit("MISSING").alias("value"), (F.col("total") - F.col("n")).alias("n")).where("n > 0")
    return have.unionByName(missing)


def attribute_fill_rate(dets: DataFrame) -> DataFrame:
    """``class_name``, ``key``, ``total``, ``fill_rate``: the part that isn't ``unspecified`` (missing ones count as filled)."""
    v = attribute_values(dets)
    return v.groupBy("class_name", "key").agg(F.sum("n").alias("total"), ((F.sum("n") - F.sum(F.when(F.col("value") == "unspecified", F.col("n")).otherwise(0))) / F.sum("n")).alias("fill_rate"))


def top_values(dets: DataFrame, k: int = 4) -> DataFrame:
    """The ``k`` commonest values of each attribute, ties by value."""
    w = Window.partitionBy("class_name", "key").orderBy(F.desc("n"), "value")
    return attribute_values(dets).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def class_counts(dets: DataFrame, names: list[str]) -> DataFrame:
    """``class_name``, ``n`` with zeros for classes without detections."""
    spark = dets.sparkSession
    dim = F.broadcast(spark.createDataFrame([(n,) for n in names], "class_name string"))
    counts = dets.groupBy("class_name").agg(F.count(F.lit(1)).alias("n"))
    return dim.join(counts, "class_name", "left").select("class_name", F.coalesce("n", F.lit(0)).alias("n"))

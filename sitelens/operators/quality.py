"""Image quality gates and their counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.constants import QUALITY_PROFILES

METRICS = ["brightness", "contrast", "sharpness", "edge_density"]


def rejection_reasons(thresholds: tuple[float, float, float, float, float]) -> Column:
    """All reasons that apply, in fixed order; ``unreadable`` alone where there are no metrics."""
    dark, bright, contrast, sharp, edges = thresholds
    tests = [("too_dark", F.col("brightness") < dark), ("overexposed", F.col("brightness") > bright), ("low_contrast", F.col("contrast") < contrast), ("blurry", F.col("sharpness") < sharp), ("low_edge_density", F.col("edge_density") < edges)]
    found = F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests)))
    return F.when(F.col("brightness").isNull(), F.array(F.lit("unreadable"))).otherwise(found)


def quality_gate(images: DataFrame, profile: str = "strict", thresholds: tuple[float, float, float, float, float] | None = None) -> DataFrame:
    """``images`` with ``reasons`` and ``accepted``. Thresholds hold for the metrics as measured, not as rounded."""
    out = images.withColumn("reasons", rejection_reasons(thresholds or QUALITY_PROFILES[profile]))
    return out.withColumn("accepted", F.size("reasons") == 0)


def rounded_metrics(images: DataFrame) -> DataFrame:
    """Metrics as written to the index: one place after the point, four for the edge density."""
    return images.withColumns({m: F.bround(m, 4 if m == "edge_density" else 1) for m in METRICS})


def quality_gate_gray(images: DataFrame, least_brightness: float = 30.0, most_brightness: float = 250.0, least_sharpness: float = 50.0) -> DataFrame:
    """The gray gate: brightness and sharpness are tested; contrast is only told. Unreadable images count as zeros."""
    out = images.withColumns({m: F.coalesce(F.col(m), F.lit(0.0)) for m in METRICS[:3]})
    return out.withColumn("valid", F.col("brightness").between(least_brightness, most_brightness) & (F.col("sharpness") >= least_sharpness))


def rejection_counts(gated: DataFrame) -> DataFrame:
    """``what``, ``n``: one row a reason (an image counts for each of its own), and ``total`` and ``accepted``. One pass."""
    what = F.concat(F.array(F.lit("total")), F.when(F.col("accepted"), F.array(F.lit("accepted"))).otherwise(F.col("reasons")))
    return gated.select(F.explode(what).alias("what")).groupBy("what").agg(F.count(F.lit(1)).alias("n"))


def acceptance_rate(gated: DataFrame) -> DataFrame:
    return gated.agg(F.count(F.lit(1)).alias("total"), F.count_if("accepted").alias("accepted"), F.coalesce(F.count_if("accepted") / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("rate"))

"""Tables and reports that stages leave: indexes, counters, evaluation."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.constants import PRIVACY_TARGET, PRIVACY_WEIGHTS, QUALITY_PROFILES
from sitelens.functions.names import file_name
from sitelens.operators.evaluate import privacy_score
from sitelens.operators.quality import METRICS, rejection_counts, rounded_metrics
from sitelens.operators.selection import selection_stats
from sitelens.sources.files import copy_files, write_bytes


def accepted_index(gated: DataFrame) -> DataFrame:
    return rounded_metrics(gated.where("accepted")).select("path", *METRICS)


def rejected_index(gated: DataFrame) -> DataFrame:
    return rounded_metrics(gated.where("not accepted")).select("path", F.concat_ws(";", "reasons").alias("reason"), *METRICS)


def now() -> str:
    return datetime.now(UTC).replace(tzinfo=None).isoformat()


REASONS = ["too_dark", "overexposed", "low_contrast", "blurry", "low_edge_density", "unreadable"]
LIMITS = ["min_brightness", "max_brightness", "min_contrast", "min_sharpness", "min_edge_density"]


def prefilter_stats(counts: DataFrame, thresholds: tuple[float, ...], folder: str, timestamp: str) -> DataFrame:
    """One JSON object: counters (zero where none), time, thresholds, files. ``counts``: ``what``, ``n``, a few rows."""
    n = lambda what: F.coalesce(F.max(F.when(F.col("what") == what, F.col("n"))), F.lit(0))
    stats = F.struct(n("total").alias("total"), n("accepted").alias("accepted"), *(n(r).alias(f"rejected_{r}") for r in REASONS))
    config = F.struct(*(F.lit(float(v)).alias(k) for k, v in zip(LIMITS, thresholds, strict=True)))
    files = F.struct(F.lit(f"{folder}/accepted_images.csv").alias("accepted_index"), F.lit(f"{folder}/rejected_images.csv").alias("rejected_index"))
    return counts.agg(stats.alias("stats")).select(F.to_json(F.struct("stats", F.lit(timestamp).alias("timestamp"), config.alias("config"), files.alias("output_files"))).alias("value"))


def write_prefilter(gated: DataFrame, folder: str, thresholds: tuple[float, ...] = QUALITY_PROFILES["strict"], timestamp: str | None = None) -> None:
    """Both indexes as CSV and the counters as JSON. ``gated`` is read three times: cache it or hand in a written table."""
    accepted_index(gated).write.mode("overwrite").csv(f"{folder}/accepted_images.csv", header=True)
    rejected_index(gated).write.mode("overwrite").csv(f"{folder}/rejected_images.csv", header=True)
    write_bytes(f"{folder}/prefilter_stats.json", prefilter_stats(rejection_counts(gated), thresholds, folder, timestamp or now()).first()[0].encode())


def write_selection(scored: DataFrame, selected: DataFrame, baseline: DataFrame, folder: str, timestamp: str) -> None:
    """The selected images, copied flat by their file names (of equal names the last path stays), their means as JSON and the baseline's paths as text."""
    copy_files(selected.select(F.col("path").alias("source"), F.concat(F.lit(f"{folder}/"), file_name(F.col("path"))).alias("target")))
    s = selection_stats(selected).crossJoin(scored.agg(F.count(F.lit(1)).alias("total_scored"))).crossJoin(baseline.agg(F.count(F.lit(1)).alias("count")))
    stats = s.select(F.to_json(F.struct("total_scored", F.col("n").alias("total_selected"), F.col("mean_score").alias("avg_score"), F.col("mean_persons").alias("avg_persons"), F.col("mean_vehicles").alias("avg_vehicles"), F.lit(timestamp).alias("timestamp"), F.struct("count").alias("random_baseline"))).alias("value"))
    write_bytes(f"{folder}/selection_stats.json", stats.first()[0].encode())
    baseline.select("path").write.mode("overwrite").text(f"{folder}/random_baseline_paths")


def evaluation_json(per_class: DataFrame, config: dict[str, str], timestamp: str) -> DataFrame:
    """One JSON object: overall means, privacy score with its target, metrics by class."""
    four = ["precision", "recall", "f1", "mAP50", "mAP50-95"]
    named = per_class.select("class_name", "precision", "recall", "f1", F.col("ap50").alias("mAP50"), F.col("ap50_95").alias("mAP50-95"))
    overall = F.struct(*(F.avg(f"`{c}`").alias(c) for c in ("mAP50", "mAP50-95", "precision", "recall")))
    classes = F.map_from_entries(F.sort_array(F.collect_list(F.struct("class_name", F.struct(*(F.col(f"`{c}`") for c in four))))))
    rows = named.agg(overall.alias("overall"), classes.alias("per_class")).crossJoin(privacy_score(per_class))
    weights = F.struct(*(F.lit(v).alias(k) for k, v in PRIVACY_WEIGHTS.items()))
    said = [F.lit(v).alias(k) for k, v in config.items()]
    met = (F.col("privacy_score") >= PRIVACY_TARGET).alias("privacy_target_met")
    return rows.select(F.to_json(F.struct(*said, F.lit(timestamp).alias("timestamp"), "overall", "privacy_score", F.lit(PRIVACY_TARGET).alias("privacy_target"), met, weights.alias("privacy_weights"), "per_class")).alias("value"))


def console(rows: DataFrame, title: str) -> str:
    """A summary table of a few rows as lines of text: column names, then values, numbers with four digits."""
    shown = rows.limit(1000).collect()
    cells = [rows.columns, *([f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v) for v in r] for r in shown)]
    wide = [max(len(r[i]) for r in cells) for i in range(len(rows.columns))]
    return "\n".join([title, "-" * len(title), *("  ".join(c.ljust(w) for c, w in zip(r, wide, strict=True)).rstrip() for r in cells)])


def evaluation_csv(per_class: DataFrame) -> DataFrame:
    """Text rows: class, then precision, recall, F1, mAP50, mAP50-95 with four digits; a row of means, its F1 empty, comes last."""
    four = lambda c: F.format_string("%.4f", c)
    rows = per_class.select(F.lit(0).alias("o"), "class_id", F.col("class_name").alias("class"), four(F.col("precision")).alias("precision"), four(F.col("recall")).alias("recall"), four(F.col("f1")).alias("f1"), four(F.col("ap50")).alias("map50"), four(F.col("ap50_95")).alias("map50_95"))
    mean = per_class.agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "ap50", "ap50_95")))
    last = mean.select(F.lit(1).alias("o"), F.lit(None).cast("int").alias("class_id"), F.lit("Overall").alias("class"), four(F.col("precision")).alias("precision"), four(F.col("recall")).alias("recall"), F.lit("").alias("f1"), four(F.col("ap50")).alias("map50"), four(F.col("ap50_95")).alias("map50_95"))
    return rows.unionByName(last).orderBy("o", "class_id").drop("o", "class_id")

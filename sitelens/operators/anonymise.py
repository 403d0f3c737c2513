"""The blur plan: which rectangles are blurred, in which order and how."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions.geometry import Box, band, box, dynamic_kernel, odd_kernel, padded, padded_int
from sitelens.operators.spatial import holds_face, reclassify_heads

TIERS = ["reclassified_person_to_face", "tier1_face", "tier2_face_buffered", "tier3_body_blur", "text_or_logo"]


def blur_plan(dets: DataFrame, width: int, height: int, face_high: float = 0.5, base_kernel: int = 51, body_kernel: int = 31, padding: float = 10, top: float = 0.33, body: bool = True) -> DataFrame:
    """``image_id``, ``seq``, ``tier``, ``det_ord``, the rectangle and ``kernel``.

    Persons in another's head region count as faces. Faces of high confidence are padded, others twice as much; persons
    without a face get their upper part blurred; texts always. Order: reclassified, faces, bodies, texts.
    """
    w, h = F.lit(width), F.lit(height)
    marked = holds_face(reclassify_heads(dets, 0.5, 0.5, 0.40, True, "_was_person"), "_face")
    b = box()
    upper = band(b, 0, top)
    tier = F.when(F.col("_was_person"), TIERS[0]).when((F.col("class_name") == "face") & (F.col("confidence") >= face_high), TIERS[1]).when(F.col("class_name") == "face", TIERS[2]).when(F.col("class_name") == "person", TIERS[3]).when(F.col("class_name") == "text_or_logo", TIERS[4])
    held = marked.withColumn("tier", tier).where(F.col("tier").isNotNull() & ~((F.col("tier") == TIERS[3]) & (F.col("_face") | F.lit(not body))))
    is_body = F.col("tier") == TIERS[3]
    target = Box(b.x1, b.y1, b.x2, F.when(is_body, upper.y2).otherwise(b.y2))
    percent = F.when(F.col("tier") == TIERS[2], padding * 2).when(is_body, float(padding // 2)).otherwise(float(padding))
    kernel = F.when(is_body, dynamic_kernel(target.width, target.height, body_kernel)).otherwise(dynamic_kernel(target.width, target.height, base_kernel))
    rank = F.when(F.col("tier") == TIERS[0], 0).when(F.col("class_name") == "face", 1).when(is_body, 2).otherwise(3)
    rect = padded(target, w, h, percent)
    plan = held.select("image_id", "tier", "det_ord", rank.alias("_rank"), *rect.columns(), kernel.alias("kernel"))
    return plan.withColumn("seq", F.expr("row_number() over (partition by image_id order by _rank, det_ord)")).drop("_rank")


def blur_plan_module(dets: DataFrame, width: int, height: int, face_high: float = 0.5, strength: int = 51, body_strength: int = 31, padding: float = 10, top: float = 0.33, body: bool = True) -> DataFrame:
    """The class module's plan: new faces go to a tier by their confidence, kernels are fixed, rectangles in whole pixels."""
    w, h = F.lit(width), F.lit(height)
    marked = holds_face(reclassify_heads(dets, 0.5, 0.5, 0.40, True), "_face")
    b = box()
    tier = F.when((F.col("class_name") == "face") & (F.col("confidence") >= face_high), TIERS[1]).when(F.col("class_name") == "face", TIERS[2]).when((F.col("class_name") == "person") & ~F.col("_face") & F.lit(body), TIERS[3]).when(F.col("class_name") == "text_or_logo", TIERS[4])
    held = marked.withColumn("tier", tier).where("tier is not null")
    is_body = F.col("tier") == TIERS[3]
    target = Box(b.x1, b.y1, b.x2, F.when(is_body, band(b, 0, top).y2).otherwise(b.y2))
    percent = F.when(F.col("tier") == TIERS[2], padding * 2).when(is_body, float(padding // 2)).otherwise(float(padding))
    kernel = F.when(is_body, odd_kernel(F.lit(body_strength))).otherwise(odd_kernel(F.lit(strength)))
    return held.select("image_id", "tier", "det_ord", *padded_int(target, w, h, percent).columns(), kernel.alias("kernel"))


def drawn(dets: DataFrame, plan: DataFrame) -> DataFrame:
    """The detections that review overlays show: those that were blurred."""
    return dets.join(plan.select("image_id", "det_ord").distinct(), ["image_id", "det_ord"], "left_semi")


def tier_counts(plan: DataFrame) -> DataFrame:
    """``tier``, ``n``, with the sum as ``total``."""
    return plan.rollup("tier").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("tier", F.lit("total")).alias("tier"), "n")

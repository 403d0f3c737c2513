"""Greedy suppression. A suppressed box suppresses nothing, so this is a fold and no anti-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.constants import ALLOWED_CONTAINMENT
from sitelens.functions.geometry import box_of, iou
from sitelens.operators.folds import keep_greedily, sorted_rows
from sitelens.operators.spatial import reclassify_heads


def _within(dets: DataFrame, keys: list[str], threshold: float, inclusive: bool, confidence: str) -> DataFrame:
    rest = [c for c in dets.columns if c not in keys]
    groups = sorted_rows(dets, keys, [-F.col(confidence), F.col("det_ord")], rest)

    def conflict(kept, x):
        v = iou(box_of(kept), box_of(x))
        return v >= threshold if inclusive else v > threshold

    return groups.select(*keys, F.inline(keep_greedily(F.col("rows"), conflict))).select(*dets.columns)


def dedup_same_class(dets: DataFrame, threshold: float = 0.30, confidence: str = "confidence") -> DataFrame:
    """Of boxes of one image and class, those without a kept one of more confidence that overlaps by over ``threshold``. Ties by ``det_ord``."""
    return _within(dets, ["image_id", "class_id"], threshold, False, confidence)


def cross_model_nms(dets: DataFrame, threshold: float = 0.5) -> DataFrame:
    """As ``dedup_same_class``, and overlap of exactly ``threshold`` suppresses too."""
    return _within(dets, ["image_id", "class_id"], threshold, True, "confidence")


def inference_dedup(dets: DataFrame, threshold: float = 0.30) -> DataFrame:
    """The inference script's rule; the confidence column is ``conf`` if there is one."""
    return dedup_same_class(dets, threshold, "conf" if "conf" in dets.columns else "confidence")


def suppress_across_classes(dets: DataFrame, threshold: float = 0.5, order: str = "det_ord") -> DataFrame:
    """Drops boxes that overlap a kept one of another class, but for pairs that may contain one another."""
    rest = [c for c in dets.columns if c != "image_id"]
    groups = sorted_rows(dets, ["image_id"], [-F.col("confidence"), F.col(order)], rest)
    pairs = [F.lit(f"{a}|{b}") for x, y in ALLOWED_CONTAINMENT for a, b in ((x, y), (y, x))]

    def conflict(kept, x):
        allowed = F.concat_ws("|", kept["class_name"], x["class_name"]).isin(*pairs)
        return (kept["class_name"] != x["class_name"]) & ~allowed & (iou(box_of(kept), box_of(x)) > threshold)

    return groups.select("image_id", F.inline(keep_greedily(F.col("rows"), conflict))).select(*dets.columns)


def cross_class_cleanup(dets: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Small persons in the head region of larger ones become faces, then boxes are suppressed across classes.

    Equal confidences: persons first, then the other classes, then the new faces, each by ``det_ord``.
    """
    place = F.when(F.col("_new_face"), 2).when(F.col("class_name") == "person", 0).otherwise(1)
    ranked = reclassify_heads(dets, size=0.4, part=0.4, head=0.45, skip_empty=False, mark="_new_face").withColumn("_order", place * F.lit(1 << 32) + F.col("det_ord"))
    return suppress_across_classes(ranked, threshold, "_order").drop("_new_face", "_order")

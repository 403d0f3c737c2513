"""Filters of detections: predicates only, so they push down and fuse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.constants import MAX_ASPECT_RATIO
from sitelens.functions.geometry import aspect_ratio, box
from sitelens.functions.names import min_area, min_confidence


def filter_min_area(dets: DataFrame) -> DataFrame:
    return dets.where(box().area >= min_area(F.col("class_name")))


def filter_confidence(dets: DataFrame) -> DataFrame:
    return dets.where(F.col("confidence") >= min_confidence(F.col("class_name")))


def filter_person_area(dets: DataFrame, width: int, height: int, part: float = 0.15) -> DataFrame:
    """Persons that take more than ``part`` of the image go."""
    return dets.where((F.col("class_name") != "person") | (box().area <= F.lit(float(width * height)) * part))


def filter_aspect(dets: DataFrame, most: float = MAX_ASPECT_RATIO) -> DataFrame:
    return dets.where(aspect_ratio(box()) <= most)


def filter_size(dets: DataFrame, pixels: float = 5.0) -> DataFrame:
    return dets.where((box().width >= pixels) & (box().height >= pixels))


def filter_detector(dets: DataFrame, confidence: float, classes: list[str] | None = None) -> DataFrame:
    out = dets.where(F.col("confidence") >= confidence)
    return out.where(F.col("class_name").isin(classes)) if classes is not None else out


def minimum_crop(dets: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes whose crop is large enough to classify."""
    return dets.where((box().width >= width) & (box().height >= height))

"""Training and validation split of labelled images."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EXTENSION_RANK = [".jpg", ".jpeg", ".png", ".bmp"]


def match_labels(labels: DataFrame, images: DataFrame) -> DataFrame:
    """Labels with their image by ``stem``."""
    return labels.join(images, "stem")


def unmatched(labels: DataFrame, images: DataFrame) -> DataFrame:
    """``side``, ``n``: labels without an image and images without a label."""
    a = labels.join(images, "stem", "left_anti").select(F.lit("labels_without_images").alias("side"))
    b = images.join(labels, "stem", "left_anti").select(F.lit("images_without_labels").alias("side"))
    dim = labels.sparkSession.createDataFrame([("labels_without_images",), ("images_without_labels",)], "side string")
    return F.broadcast(dim).join(a.unionAll(b).groupBy("side").agg(F.count(F.lit(1)).alias("n")), "side", "left").select("side", F.coalesce("n", F.lit(0)).alias("n"))


def image_by_priority(labels: DataFrame, images: DataFrame) -> DataFrame:
    """One image a label: the first extension of the list that exists (``images``: ``stem``, ``ext``, ``image_path``)."""
    rank = F.array_position(F.array(*map(F.lit, EXTENSION_RANK)), F.col("ext"))
    best = images.withColumn("_rank", rank).where("_rank > 0").groupBy("stem").agg(F.min_by("image_path", "_rank").alias("image_path"))
    return labels.join(best, "stem")


def train_val_split(matched: DataFrame, val_ratio: float = 0.2, seed: int = 42, key: str = "stem") -> DataFrame:
    """``split``: of n rows the first ``int(n (1 - val_ratio))`` by the hash of key and seed train, the others validate.

    The order is md5 of the key and seed, so the split is the same in every run and engine. Ranks come from counts
    of the hash's first two digits (256 rows) and a rank within each, so no task sorts the whole table.
    """
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))
    hashed = matched.withColumns({"_h": h, "_part": F.substring(h, 1, 2)})
    parts = hashed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = parts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_total", F.sum("_n").over(Window.partitionBy()))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_h", key))
    ranked = hashed.withColumn("_rank", rank).join(F.broadcast(before), "_part")
    train = F.col("_before") + F.col("_rank") <= F.floor(F.col("_total") * F.lit(1 - val_ratio))
    return ranked.withColumn("split", F.when(train, "train").otherwise("val")).drop("_h", "_part", "_n", "_before", "_total", "_rank")


def split_class_counts(split: DataFrame, boxes: DataFrame, names: list[str]) -> DataFrame:
    """``split``, ``class_name``, ``n`` over label boxes (``stem``, ``class_id``); ids beyond the list are left out."""
    name = F.get(F.array(*map(F.lit, names)), F.col("class_id"))
    return boxes.where(F.col("class_id") < len(names)).join(split.select("stem", "split"), "stem").groupBy("split", name.alias("class_name")).agg(F.count(F.lit(1)).alias("n"))

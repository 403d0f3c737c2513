"""Tiling of large images: a generator, and the way back to image coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions.geometry import box, offset


def tile_grid(images: DataFrame, size: int = 640, overlap: float = 0.25) -> DataFrame:
    """One row a tile (``tile_ord``, ``tx1`` ... ``ty2``) of each image (``width``, ``height``), rows first.

    Tiles at the edge are moved inwards; those that then coincide stay twice, for they count in the fusion.
    """
    step = int(size * (1 - overlap))
    starts = lambda c: F.sequence(F.lit(0), F.col(c) - 1, F.lit(step))
    out = images.withColumn("y0", F.explode(starts("height"))).withColumn("x0", F.explode(starts("width")))
    tx2, ty2 = F.least(F.col("x0") + size, F.col("width")), F.least(F.col("y0") + size, F.col("height"))
    out = out.withColumns({"tx2": tx2, "ty2": ty2}).withColumns({"tx1": F.greatest(F.lit(0), F.col("tx2") - size), "ty1": F.greatest(F.lit(0), F.col("ty2") - size)})
    across = F.size(starts("width"))
    order = (F.col("y0") / step).cast("int") * across + (F.col("x0") / step).cast("int")
    return out.withColumn("tile_ord", order).drop("x0", "y0")


def needs_tiles(images: DataFrame, size: int = 640, enabled: bool = True) -> DataFrame:
    return images.where(F.lit(enabled) & ((F.col("width") > size) | (F.col("height") > size)))


def to_image(dets: DataFrame) -> DataFrame:
    """Detections of tiles (with ``tx1``, ``ty1``) in image coordinates."""
    return dets.withColumns(dict(zip(("x1", "y1", "x2", "y2"), offset(box(), F.col("tx1"), F.col("ty1")), strict=True))).drop("tx1", "ty1", "tx2", "ty2", "tile_ord")

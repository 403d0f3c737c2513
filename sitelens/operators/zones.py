"""Exclusion zones: shorthands and polygons, as crops, filters and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.constants import DEFAULT_EXCLUSION, EXCLUSION_CLASSES
from sitelens.functions.geometry import box
from sitelens.operators.folds import bounded
from sitelens.schemas import EXCLUSIONS, ZONES
from sitelens.sources.files import exists

SHORTHAND = r"^(full_width_top|full_width_bottom|left|right)_(?:.*_)?(\d+)$"
POINTS = "array<struct<x:int,y:int>>"


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """``setup``, ``description``, ``zone_name``, ``polygon`` (variant) of a zone file, one JSON object. No file: no zones."""
    if not exists(spark, path):
        return spark.createDataFrame([("", "", "", "")], "setup string, description string, zone_name string, polygon string").where("false").withColumn("polygon", F.parse_json("polygon"))
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", ZONES).alias("z"))
    setups = raw.select(F.explode("z").alias("setup", "cfg"))
    return setups.select("setup", "cfg.description", F.explode("cfg.zones").alias("zone")).select("setup", "description", F.col("zone.name").alias("zone_name"), F.col("zone.polygon").alias("polygon"))


def shorthand_of(polygon: Column) -> Column:
    """The shorthand of a variant, null for points."""
    return F.when(F.schema_of_variant(polygon) == "STRING", F.try_variant_get(polygon, "$", "string"))


def crop_fractions(zones: DataFrame) -> DataFrame:
    """Greatest fraction cut from each side, by setup, from shorthands (column ``shorthand``); points say nothing here."""
    side, pct = F.regexp_extract("shorthand", SHORTHAND, 1), F.regexp_extract("shorthand", SHORTHAND, 2).try_cast("int") / 100
    cut = lambda name: F.coalesce(F.max(F.when(side == name, pct)), F.lit(0.0))
    return zones.groupBy("setup").agg(cut("full_width_top").alias("top"), cut("full_width_bottom").alias("bottom"), cut("left").alias("left"), cut("right").alias("right"))


def crop_margins(width: Column, height: Column, top: Column, bottom: Column, left: Column, right: Column) -> dict[str, Column]:
    return {"cx1": (width * left).cast("int"), "cy1": (height * top).cast("int"), "cx2": width - (width * right).cast("int"), "cy2": height - (height * bottom).cast("int")}


def shorthand_polygon(shorthand: Column, width: Column, height: Column) -> Column:
    """Corners of a shorthand in whole pixels; another string is an error, null stays null."""
    side, pct = F.regexp_extract(shorthand, SHORTHAND, 1), F.regexp_extract(shorthand, SHORTHAND, 2).try_cast("int") / 100
    cut = lambda c: c.cast("int")
    zero = F.lit(0)

    def rect(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
        point = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
        return F.array(point(x1, y1), point(x2, y1), point(x2, y2), point(x1, y2))

    return (
        F.when(shorthand.isNull(), F.lit(None).cast(POINTS))
        .when(side == "full_width_top", rect(zero, zero, width, cut(height * pct)))
        .when(side == "full_width_bottom", rect(zero, cut(height * (1 - pct)), width, height))
        .when(side == "right", rect(cut(width * (1 - pct)), zero, width, height))
        .when(side == "left", rect(zero, zero, cut(width * pct), height))
        .otherwise(F.raise_error(F.concat(F.lit("Unknown zone shorthand: "), shorthand)).cast(POINTS))
    )


def explicit_polygon(polygon: Column) -> Column:
    """Points of a variant: a list of pairs or a flat list of coordinates; null for shorthands."""
    kind = F.schema_of_variant(polygon)
    pairs = F.transform(F.try_variant_get(polygon, "$", "array<array<double>>"), lambda p: F.struct(F.get(p, F.lit(0)).cast("int").alias("x"), F.get(p, F.lit(1)).cast("int").alias("y")))
    flat = F.try_variant_get(polygon, "$", "array<double>")
    joined = F.transform(F.sequence(F.lit(0), F.floor(F.size(flat) / 2).cast("int") - 1), lambda i: F.struct(F.get(flat, i * 2).cast("int").alias("x"), F.get(flat, i * 2 + 1).cast("int").alias("y")))
    return F.when(kind.startswith("ARRAY<ARRAY"), pairs).when(kind.startswith("ARRAY") & (F.size(flat) >= 2), joined)


def inside_polygon(points: Column, x: Column, y: Column) -> Column:
    """Whether a whole pixel is in a polygon, its edges included."""
    n = F.size(points)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(points, i).alias("a"), F.get(points, (i + 1) % n).alias("b")))

    def on_edge(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        return (cross == 0) & x.between(F.least(ax, bx), F.greatest(ax, bx)) & y.between(F.least(ay, by), F.greatest(ay, by))

    def crosses(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        at = ax + (y - ay) * (bx - ax) / F.when(by != ay, by - ay)
        return ((ay > y) != (by > y)) & F.coalesce(x < at, F.lit(False))

    return F.exists(edges, on_edge) | (F.size(F.filter(edges, crosses)) % 2 == 1)


def filter_polygon_zones(dets: DataFrame, zones: DataFrame, width: int, height: int) -> DataFrame:
    """Detections whose whole-pixel centre, moved into the image, lies in none of the zones of its setup.

    ``dets`` has ``setup``; ``zones``: ``setup``, ``points``. All classes are tested.
    """
    clamp = lambda c, most: F.greatest(F.lit(0), F.least(c.cast("int"), F.lit(most - 1)))
    placed = dets.withColumns({"_px": clamp(box().cx, width), "_py": clamp(box().cy, height)})
    z = bounded(zones.where("points is not null").select(F.col("setup").alias("_setup"), "points"))
    test = (F.col("setup") == F.col("_setup")) & inside_polygon(F.col("points"), F.col("_px"), F.col("_py"))
    return placed.join(z, test, "left_anti").drop("_px", "_py")


def read_exclusions(spark: SparkSession, path: str | None) -> DataFrame:
    """``setup``, ``top_pct``, ``right_pct``, ``bottom_pct`` of a file; the defaults where there is none, or it is empty."""
    if path is not None and exists(spark, path):
        raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", EXCLUSIONS)).alias("setup", "z")).where("z is not null")
        rows = raw.select("setup", *(F.coalesce(f"z.{c}", F.lit(0.0)).alias(c) for c in ("top_pct", "right_pct", "bottom_pct")))
        if not rows.isEmpty():
            return rows
    return spark.createDataFrame([(k, *v) for k, v in DEFAULT_EXCLUSION.items()], "setup string, top_pct double, right_pct double, bottom_pct double")


def filter_exclusion_zones(dets: DataFrame, exclusions: DataFrame, width: int, height: int) -> DataFrame:
    """Faces and texts whose centre lies in the top, bottom or right margin of their setup go. Setups are few: a broadcast join."""
    z = bounded(exclusions.select(F.col("setup").alias("_setup"), "top_pct", "right_pct", "bottom_pct"))
    b = box()
    out = (b.cy < height * F.col("top_pct")) | (b.cy > height * (1 - F.col("bottom_pct"))) | (b.cx > width * (1 - F.col("right_pct")))
    test = (F.col("setup") == F.col("_setup")) & F.col("class_name").isin(EXCLUSION_CLASSES) & out
    return dets.join(z, test, "left_anti")

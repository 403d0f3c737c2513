"""Tables of detections, images and the like, derived from the benchmark's parquet; the same in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.functions.names import class_name

WIDTH, HEIGHT = 1280, 720
NAMES_SQL = "['face','person','vehicle','text_or_logo','crane','container','scaffolding','material_stack']"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("image_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    t = t.withColumn("image_id", F.expr("l_orderkey div 10")).withColumn("det_ord", F.row_number().over(order))
    model = F.when(F.col("l_returnflag") == "A", "yolo_coco").when(F.col("l_returnflag") == "N", "grounding_dino").otherwise("yolo_world")
    small = F.col("l_partkey") % 5 == 0
    x1 = ((F.col("l_partkey") % 4) * 220 + (F.col("l_suppkey") % 10) * 6).cast("double")
    y1 = ((F.col("l_partkey") % 3) * 200 + (F.col("l_linenumber") % 5) * 8).cast("double")
    class_id = F.expr("cast((l_partkey * 5 + l_linenumber * 3) % 8 as int)")
    confidence = F.expr("0.05D + cast((l_partkey * 37 + l_suppkey * 11 + l_orderkey * 7) % 9001 as double) / 10000")
    return t.select(
        "image_id", "det_ord", class_id.alias("class_id"), class_name(class_id).alias("class_name"), x1.alias("x1"), y1.alias("y1"),
        (x1 + F.when(small, 28).otherwise(90) + F.col("l_quantity")).alias("x2"), (y1 + F.when(small, 24).otherwise(150) + F.col("l_quantity")).alias("y2"),
        confidence.alias("confidence"), model.alias("model"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
    )


DET_SQL = f"""det AS (
  SELECT *, x1 + (CASE WHEN part % 5 = 0 THEN 28 ELSE 90 END) + q AS x2, y1 + (CASE WHEN part % 5 = 0 THEN 24 ELSE 150 END) + q AS y2,
    ({NAMES_SQL})[class_id + 1] AS class_name
  FROM (SELECT l_orderkey // 10 AS image_id,
    CAST(row_number() OVER (PARTITION BY l_orderkey // 10 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS det_ord,
    CAST((l_partkey * 5 + l_linenumber * 3) % 8 AS INTEGER) AS class_id,
    CASE l_returnflag WHEN 'A' THEN 'yolo_coco' WHEN 'N' THEN 'grounding_dino' ELSE 'yolo_world' END AS model,
    0.05::DOUBLE + CAST((l_partkey * 37 + l_suppkey * 11 + l_orderkey * 7) % 9001 AS DOUBLE) / 10000 AS confidence,
    CAST((l_partkey % 4) * 220 + (l_suppkey % 10) * 6 AS DOUBLE) AS x1, CAST((l_partkey % 3) * 200 + (l_linenumber % 5) * 8 AS DOUBLE) AS y1,
    l_quantity AS q, l_partkey AS part, l_suppkey AS supp FROM lineitem))"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events")
    ext = F.when(F.col("event_id") % 50 == 0, ".bmp").otherwise(".jpg")
    n = (F.col("user_id") % 2 + 1).cast("string")
    gone = F.col("event_id") % 97 == 13
    metric = lambda sql: F.when(~gone, F.expr(sql))
    return t.select(
        F.col("event_id").alias("image_id"), F.concat(F.lit("raw/cam"), n, F.lit("/Kamera"), n, F.lit("_00_"), F.date_format("ts", "yyyyMMddHHmmss"), ext).alias("path"),
        metric("cast((event_id * 7919 + user_id * 31) % 2560 as double) / 10").alias("brightness"), metric("cast((event_id * 104729 + user_id * 17) % 800 as double) / 10").alias("contrast"),
        metric("cast((event_id * 1299709) % 30000 as double) / 10").alias("sharpness"), metric("cast((event_id * 15485863) % 2500 as double) / 10000").alias("edge_density"),
        gone.alias("unreadable"), F.expr("cast((event_id * 31 + user_id) % 4 as int)").alias("person_count"), F.expr("cast((event_id * 17) % 3 as int)").alias("vehicle_count"),
    )


IMG_SQL = """img AS (
  SELECT event_id AS image_id, 'raw/cam' || (user_id % 2 + 1) || '/Kamera' || (user_id % 2 + 1) || '_00_' || strftime(ts, '%Y%m%d%H%M%S') || (CASE WHEN event_id % 50 = 0 THEN '.bmp' ELSE '.jpg' END) AS path,
    CASE WHEN event_id % 97 <> 13 THEN CAST((event_id * 7919 + user_id * 31) % 2560 AS DOUBLE) / 10 END AS brightness,
    CASE WHEN event_id % 97 <> 13 THEN CAST((event_id * 104729 + user_id * 17) % 800 AS DOUBLE) / 10 END AS contrast,
    CASE WHEN event_id % 97 <> 13 THEN CAST((event_id * 1299709) % 30000 AS DOUBLE) / 10 END AS sharpness,
    CASE WHEN event_id % 97 <> 13 THEN CAST((event_id * 15485863) % 2500 AS DOUBLE) / 10000 END AS edge_density,
    event_id % 97 = 13 AS unreadable, CAST((event_id * 31 + user_id) % 4 AS INTEGER) AS person_count, CAST((event_id * 17) % 3 AS INTEGER) AS vehicle_count FROM events)"""


def overlap_sql(a: str, b: str) -> str:
    return f"(greatest(0.0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0.0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))"


def area_sql(a: str) -> str:
    return f"(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1))"


def iou_sql(a: str, b: str) -> str:
    i = overlap_sql(a, b)
    u = f"({area_sql(a)} + {area_sql(b)} - {i})"
    return f"(CASE WHEN {u} > 0 THEN {i} / {u} ELSE 0.0 END)"


def containment_sql(outer: str, inner: str) -> str:
    return f"(CASE WHEN {area_sql(inner)} > 0 THEN {overlap_sql(outer, inner)} / {area_sql(inner)} ELSE 0.0 END)"

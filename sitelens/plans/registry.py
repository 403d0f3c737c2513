"""The engine's queries over the benchmark's tables, each with the SQL that an independent engine answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens import constants as C
from sitelens.fixtures import DET_SQL, HEIGHT, IMG_SQL, WIDTH, area_sql, containment_sql, detections, images, iou_sql, overlap_sql, table
from sitelens.functions import geometry as g
from sitelens.functions import names
from sitelens.operators import anonymise, attributes, classify, evaluate, filters, fusion, quality, selection, spatial, split, suppress, tiles, zones
from sitelens.plans import stages
from sitelens.schemas import COCO
from sitelens.sources import formats, reports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
BOX = ["x1", "y1", "x2", "y2"]
BOX_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in BOX)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def boxes(df: DataFrame, *more: str) -> DataFrame:
    return df.select("image_id", "det_ord", "class_name", *(F.round(c, 6).alias(c) for c in (*BOX, "confidence")), *more)


BOXES_SQL = f"image_id, det_ord, class_name, {BOX_SQL}, round(confidence, 6) AS confidence"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- names ------------------------------------------------------------------------------------------------------------


@query(rf"WITH {IMG_SQL} SELECT DISTINCT path, regexp_extract(path, '[^/]+$') AS file_name, regexp_replace(regexp_extract(path, '[^/]+$'), '\.[^.]*$', '') AS stem, regexp_extract(path, '\.[^.]*$') AS ext FROM img WHERE path SIMILAR TO '.*\.(jpg|bmp)'")
def image_scan(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return images(spark, d).where(names.is_image(p, C.IMAGE_EXTENSIONS, True)).select("path", names.file_name(p).alias("file_name"), names.stem(p).alias("stem"), names.extension(p).alias("ext")).distinct()


@query(rf"WITH {IMG_SQL} SELECT image_id, 'setup_' || regexp_extract(lower(regexp_extract(path, '[^/]+$')), '(?:kamera|setup_?|cam)(\d+)', 1) AS setup FROM img")
def setup_from_filename(spark: SparkSession, d: str) -> DataFrame:
    return images(spark, d).select("image_id", names.setup_of(names.file_name(F.col("path"))).alias("setup"))


@query(f"WITH {IMG_SQL} SELECT image_id, CASE WHEN lower(regexp_extract(path, '[^/]+$')) LIKE '%kamera1%' THEN 'setup_1' WHEN lower(regexp_extract(path, '[^/]+$')) LIKE '%kamera2%' THEN 'setup_2' END AS setup FROM img")
def setup_by_substring(spark: SparkSession, d: str) -> DataFrame:
    return images(spark, d).select("image_id", names.setup_by_substring(names.file_name(F.col("path"))).alias("setup"))


@query(rf"WITH {IMG_SQL} SELECT image_id, strftime(try_strptime(regexp_extract(replace(path, '.jpg', ''), '[^_]+$'), '%Y%m%d%H%M%S'), '%Y-%m-%d %H:%M:%S') AS captured_at, strftime(try_strptime(regexp_extract(replace(path, '.jpg', ''), '[^_]+$'), '%Y%m%d%H%M%S'), '%Y%m%d_%H') AS hour FROM img")
def capture_timestamp(spark: SparkSession, d: str) -> DataFrame:
    at = names.captured_at(names.file_name(F.col("path")))
    return images(spark, d).select("image_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("captured_at"), names.hour_bucket(at).alias("hour"))


@query(rf"WITH {IMG_SQL}, s AS (SELECT image_id, regexp_extract(path, '_(\d+)\.[a-z]+$', 1) AS t FROM img) SELECT image_id, t[1:4] || '-' || t[5:6] || '-' || t[7:8] || '  ' || t[9:10] || ':' || t[11:12] || ':' || t[13:14] AS label FROM s")
def timestamp_label(spark: SparkSession, d: str) -> DataFrame:
    return images(spark, d).select("image_id", names.time_label(F.col("path")).alias("label"))


PHRASE_WORDS = ["Large Storage Container", "tower crane", " company logo on vehicle ", "a red car", "van near a truck", "warning sign", "brand", "nothing known", "worker head", "pile of bricks", "plate", "text on fence"]
PHRASE_SQL = "ph AS (SELECT l_orderkey, l_linenumber, ([{}])[l_partkey % {} + 1] || (CASE WHEN l_suppkey % 3 = 0 THEN ' sign' ELSE '' END) AS phrase FROM lineitem)".format(", ".join(map(_quoted, PHRASE_WORDS)), len(PHRASE_WORDS))


def _phrases(spark: SparkSession, d: str) -> DataFrame:
    word = F.get(F.array(*map(F.lit, PHRASE_WORDS)), (F.col("l_partkey") % len(PHRASE_WORDS)).cast("int"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(word, F.when(F.col("l_suppkey") % 3 == 0, " sign").otherwise("")).alias("phrase"))


def _case(tests: list[tuple[str, str]], default: str | None = None) -> str:
    return "CASE " + " ".join(f"WHEN {t} THEN '{v}'" for t, v in tests) + (f" ELSE '{default}'" if default else "") + " END"


def _like(text: str, key: str) -> str:
    return f"contains({text}, {_quoted(key)})"


LOW = "lower(trim(phrase))"


@query(f"WITH {PHRASE_SQL} SELECT l_orderkey, l_linenumber, {_case([(_like(LOW, k), v) for k, v in names.by_length(C.PHRASES)])} AS class_name FROM ph")
def phrase_to_class(spark: SparkSession, d: str) -> DataFrame:
    return _phrases(spark, d).select("l_orderkey", "l_linenumber", names.phrase_class(F.col("phrase")).alias("class_name"))


@query(f"WITH {PHRASE_SQL} SELECT l_orderkey, l_linenumber, {_case([(f'({_like(LOW, k)} OR contains({_quoted(k)}, {LOW}))', v) for k, v in C.MODULE_PHRASES], 'person')} AS class_name FROM ph")
def phrase_to_class_module(spark: SparkSession, d: str) -> DataFrame:
    return _phrases(spark, d).select("l_orderkey", "l_linenumber", names.phrase_class_module(F.col("phrase")).alias("class_name"))


@query(f"WITH {PHRASE_SQL} SELECT l_orderkey, l_linenumber, CASE WHEN {' OR '.join(_like(LOW, k) for k in C.LOGO_PHRASES)} THEN 'yes' ELSE 'no' END AS is_logo, {_case([(_like(LOW, k), v) for k, v in names.by_length(C.CONTENT_TYPES)], 'other')} AS content_type FROM ph")
def phrase_content_type(spark: SparkSession, d: str) -> DataFrame:
    return _phrases(spark, d).select("l_orderkey", "l_linenumber", names.is_logo(F.col("phrase")).alias("is_logo"), names.content_type(F.col("phrase")).alias("content_type"))


@query(f"WITH {PHRASE_SQL} SELECT l_orderkey, l_linenumber, {_case([('(' + ' OR '.join(_like(LOW, k) for k in ks) + ')', v) for v, ks in C.OPEN_VOCABULARY])} AS class_name FROM ph")
def open_vocab_class(spark: SparkSession, d: str) -> DataFrame:
    return _phrases(spark, d).select("l_orderkey", "l_linenumber", names.open_vocabulary_class(F.col("phrase")).alias("class_name"))


@query("SELECT l_orderkey, l_linenumber, CASE l_partkey % 9 WHEN 0 THEN 'person' WHEN 1 THEN 'vehicle' WHEN 2 THEN 'vehicle' WHEN 7 THEN 'vehicle' END AS coco_class, CASE l_partkey % 9 WHEN 0 THEN 'person' WHEN 2 THEN 'vehicle' WHEN 3 THEN 'vehicle' WHEN 5 THEN 'vehicle' WHEN 7 THEN 'vehicle' END AS module_class, CASE WHEN l_partkey % 9 <= 7 THEN (['face','person','vehicle','text_or_logo','crane','container','scaffolding','material_stack'])[l_partkey % 9 + 1] ELSE 'class_8' END AS class_name, CASE WHEN l_suppkey % 2 = 0 THEN 3 WHEN l_partkey % 9 <= 7 THEN CAST(l_partkey % 9 AS INTEGER) END AS global_class FROM lineitem")
def class_lookups(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("l_partkey") % 9).cast("int")
    raw = F.when(F.col("l_suppkey") % 2 == 0, "text_or_logo").otherwise("unknown")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", names.coco_class(n).alias("coco_class"), names.coco_class(n, True).alias("module_class"), names.class_name(n).alias("class_name"), names.global_class(raw, n).alias("global_class"))


# --- geometry ---------------------------------------------------------------------------------------------------------


@query(f"WITH {DET_SQL} SELECT a.image_id, a.det_ord AS a_det_ord, b.det_ord AS b_det_ord, round({iou_sql('a', 'b')}, 6) AS iou FROM det a JOIN det b ON a.image_id = b.image_id AND a.class_id = b.class_id AND a.det_ord < b.det_ord WHERE {iou_sql('a', 'b')} > 0.3")
def iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    det = detections(spark, d)
    test = (F.col("a_class_id") == F.col("b_class_id")) & (F.col("a_det_ord") < F.col("b_det_ord"))
    return spatial.pairs(det, det, test).withColumn("iou", g.iou(g.box("a_"), g.box("b_"))).where("iou > 0.3").select("image_id", "a_det_ord", "b_det_ord", F.round("iou", 6).alias("iou"))


@query(f"WITH {DET_SQL} SELECT p.image_id, p.det_ord AS a_det_ord, f.det_ord AS b_det_ord, round({containment_sql('p', 'f')}, 6) AS part FROM det p JOIN det f ON p.image_id = f.image_id WHERE p.class_name = 'person' AND f.class_name = 'face' AND {containment_sql('p', 'f')} >= 0.7")
def containment_pairs(spark: SparkSession, d: str) -> DataFrame:
    det = detections(spark, d)
    inside = g.containment(g.box("a_"), g.box("b_"))
    return spatial.pairs(spatial.of_class(det, "person"), spatial.of_class(det, "face"), inside >= 0.7).select("image_id", "a_det_ord", "b_det_ord", F.round(inside, 6).alias("part"))


@query(f"WITH {DET_SQL} SELECT image_id, det_ord, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h FROM det")
def bbox_to_coco(spark: SparkSession, d: str) -> DataFrame:
    return detections(spark, d).select("image_id", "det_ord", *g.to_coco(g.box()))


def _yolo_sql(w: float, h: float, clamp: bool = False) -> str:
    values = [f"(x1 + x2) / 2 / {w}", f"(y1 + y2) / 2 / {h}", f"(x2 - x1) / {w}", f"(y2 - y1) / {h}"]
    if clamp:
        values = [f"greatest(0.0, least(1.0, {v}))" for v in values]
    return "class_id || ' ' || " + " || ' ' || ".join(f"format('{{:.6f}}', round_even(CAST(CAST({v} AS DECIMAL(20, 12)) * 1000000 AS DOUBLE), 0) / 1000000)" for v in values)


@query(f"WITH {DET_SQL} SELECT image_id, det_ord, {_yolo_sql(WIDTH, HEIGHT)} AS line FROM det")
def bbox_to_yolo(spark: SparkSession, d: str) -> DataFrame:
    return formats.yolo_lines(detections(spark, d), F.lit(WIDTH), F.lit(HEIGHT)).select("image_id", "det_ord", "line")


@query(f"WITH {DET_SQL} SELECT image_id, det_ord, {_yolo_sql(500, 400, True)} AS line FROM det")
def bbox_to_yolo_clamped(spark: SparkSession, d: str) -> DataFrame:
    return formats.yolo_lines(detections(spark, d), F.lit(500), F.lit(400), clamp=True).select("image_id", "det_ord", "line")


@query(f"WITH {DET_SQL} SELECT 'img_' || image_id AS stem, string_agg({_yolo_sql(WIDTH, HEIGHT)}, chr(10) ORDER BY det_ord) AS content FROM det GROUP BY image_id")
def coco_to_yolo(spark: SparkSession, d: str) -> DataFrame:
    det = detections(spark, d)
    anns = formats.coco_annotations(det)
    ims = det.select(F.col("image_id").alias("id")).distinct().select("id", F.concat(F.lit("img_"), "id", F.lit(".jpg")).alias("file_name"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))
    return formats.coco_to_yolo(anns, ims)


@query(f"WITH {DET_SQL} SELECT 'img_' || image_id AS stem, string_agg({_yolo_sql(WIDTH, HEIGHT)} || chr(10), '' ORDER BY det_ord) AS content FROM det GROUP BY image_id")
def yolo_label_files(spark: SparkSession, d: str) -> DataFrame:
    lines = formats.yolo_lines(detections(spark, d), F.lit(WIDTH), F.lit(HEIGHT)).withColumn("stem", F.concat(F.lit("img_"), "image_id"))
    return formats.yolo_files(lines)


_PAD = "greatest(0.0, x1 - (x2 - x1) * {p} / 100) AS x1, greatest(0.0, y1 - (y2 - y1) * {p} / 100) AS y1, least({w}, x2 + (x2 - x1) * {p} / 100) AS x2, least({h}, y2 + (y2 - y1) * {p} / 100) AS y2"


@query(f"WITH {DET_SQL}, p AS (SELECT image_id, det_ord, {_PAD.format(p=10, w=700.0, h=600.0)} FROM det) SELECT image_id, det_ord, {BOX_SQL} FROM p")
def pad_box(spark: SparkSession, d: str) -> DataFrame:
    return rounded(detections(spark, d).select("image_id", "det_ord", *g.padded(g.box(), F.lit(700), F.lit(600), 10).columns()), *BOX)


@query(f"WITH {DET_SQL} SELECT image_id, det_ord, greatest(0, CAST(trunc(x1 - (x2 - x1) * 7 / 100) AS INTEGER)) AS x1, greatest(0, CAST(trunc(y1 - (y2 - y1) * 7 / 100) AS INTEGER)) AS y1, least(700, CAST(trunc(x2 + (x2 - x1) * 7 / 100) AS INTEGER)) AS x2, least(600, CAST(trunc(y2 + (y2 - y1) * 7 / 100) AS INTEGER)) AS y2 FROM det")
def pad_box_int(spark: SparkSession, d: str) -> DataFrame:
    return detections(spark, d).select("image_id", "det_ord", *g.padded_int(g.box(), F.lit(700), F.lit(600), 7).columns())


@query(f"WITH {DET_SQL}, k AS (SELECT image_id, det_ord, greatest(51, CAST(trunc(greatest(x2 - x1, y2 - y1) * 0.4::DOUBLE) AS INTEGER)) AS k FROM det) SELECT image_id, det_ord, CASE WHEN k % 2 = 0 THEN k + 1 ELSE k END AS kernel FROM k")
def dynamic_kernel(spark: SparkSession, d: str) -> DataFrame:
    return detections(spark, d).select("image_id", "det_ord", g.dynamic_kernel(g.box().width, g.box().height, 51).alias("kernel"))


_ASPECT = "(CASE WHEN x2 <= x1 OR y2 <= y1 THEN 999.0 ELSE greatest((x2 - x1) / (y2 - y1), (y2 - y1) / (x2 - x1)) END)"


@query(f"WITH {DET_SQL} SELECT image_id, det_ord, round({_ASPECT}, 6) AS aspect FROM det")
def aspect_ratio(spark: SparkSession, d: str) -> DataFrame:
    return detections(spark, d).select("image_id", "det_ord", F.round(g.aspect_ratio(g.box()), 6).alias("aspect"))


@query(f"WITH {DET_SQL} SELECT image_id, det_ord, round(x1, 6) AS head_x1, round(y1, 6) AS head_y1, round(x2, 6) AS head_x2, round(y1 + (y2 - y1) * 0.35::DOUBLE, 6) AS head_y2, greatest(0, CAST(trunc(x1 - 20) AS INTEGER)) AS crop_x1, greatest(0, CAST(trunc(y1 - 20) AS INTEGER)) AS crop_y1, least(700, CAST(trunc(x2 + 20) AS INTEGER)) AS crop_x2, least(600, CAST(trunc(y2 + 20) AS INTEGER)) AS crop_y2 FROM det")
def sub_boxes(spark: SparkSession, d: str) -> DataFrame:
    head, cut = g.band(g.box(), 0, 0.35), g.crop(g.box(), F.lit(700), F.lit(600), 20)
    return detections(spark, d).select("image_id", "det_ord", *(F.round(c, 6).alias(f"head_{n}") for c, n in zip(head, BOX, strict=True)), *(c.alias(f"crop_{n}") for c, n in zip(cut, BOX, strict=True)))


_DIMS_SQL = "dims AS (SELECT event_id AS image_id, CAST(500 + event_id % 7 * 300 AS INTEGER) AS width, CAST(400 + event_id % 5 * 350 AS INTEGER) AS height FROM events)"
_TILE_SQL = f"""{_DIMS_SQL}, t AS (SELECT image_id, width, height, xs.x AS x0, ys.y AS y0 FROM dims, LATERAL (SELECT unnest(range(0, width, 480)) AS x) xs, LATERAL (SELECT unnest(range(0, height, 480)) AS y) ys),
tiles AS (SELECT image_id, CAST(y0 // 480 * ((width + 479) // 480) + x0 // 480 AS INTEGER) AS tile_ord, CAST(greatest(0, least(x0 + 640, width) - 640) AS INTEGER) AS tx1, CAST(greatest(0, least(y0 + 640, height) - 640) AS INTEGER) AS ty1, CAST(least(x0 + 640, width) AS INTEGER) AS tx2, CAST(least(y0 + 640, height) AS INTEGER) AS ty2 FROM t)"""


def _dims(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("image_id"), (500 + F.col("event_id") % 7 * 300).cast("int").alias("width"), (400 + F.col("event_id") % 5 * 350).cast("int").alias("height"))


@query(f"WITH {_TILE_SQL} SELECT image_id, tile_ord, tx1, ty1, tx2, ty2 FROM tiles")
def tile_grid(spark: SparkSession, d: str) -> DataFrame:
    return tiles.tile_grid(_dims(spark, d)).select("image_id", "tile_ord", "tx1", "ty1", "tx2", "ty2")


@query(f"WITH {_TILE_SQL}, {DET_SQL} SELECT d.image_id, t.tile_ord, d.det_ord, d.x1 + tx1 AS x1, d.y1 + ty1 AS y1, d.x2 + tx1 AS x2, d.y2 + ty1 AS y2 FROM det d JOIN tiles t ON d.image_id = t.image_id")
def offset_tiles(spark: SparkSession, d: str) -> DataFrame:
    j = detections(spark, d).join(tiles.tile_grid(_dims(spark, d)).drop("width", "height"), "image_id").withColumn("tile", F.col("tile_ord"))
    return tiles.to_image(j).select("image_id", F.col("tile").alias("tile_ord"), "det_ord", *BOX)


# --- quality ----------------------------------------------------------------------------------------------------------

_REASON_SQL = "CASE WHEN brightness IS NULL THEN 'unreadable' ELSE concat_ws(';', CASE WHEN brightness < {0} THEN 'too_dark' END, CASE WHEN brightness > {1} THEN 'overexposed' END, CASE WHEN contrast < {2} THEN 'low_contrast' END, CASE WHEN sharpness < {3} THEN 'blurry' END, CASE WHEN edge_density < {4} THEN 'low_edge_density' END) END"


def _gated_sql(profile: str) -> str:
    return f"WITH {IMG_SQL}, gated AS (SELECT *, {_REASON_SQL.format(*C.QUALITY_PROFILES[profile])} AS reason FROM img)"


@query(_gated_sql("strict") + " SELECT image_id, reason, reason = '' AS accepted FROM gated")
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_gate(images(spark, d)).select("image_id", F.concat_ws(";", "reasons").alias("reason"), "accepted")


@query(_gated_sql("lenient") + " SELECT image_id, reason, reason = '' AS accepted FROM gated")
def quality_gate_lenient(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_gate(images(spark, d), "lenient").select("image_id", F.concat_ws(";", "reasons").alias("reason"), "accepted")


@query(f"WITH {IMG_SQL}, z AS (SELECT image_id, coalesce(brightness, 0.0) AS brightness, coalesce(sharpness, 0.0) AS sharpness FROM img) SELECT image_id, brightness >= 30 AND brightness <= 250 AND sharpness >= 50 AS valid FROM z")
def quality_gate_gray(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_gate_gray(images(spark, d)).select("image_id", "valid")


@query(_gated_sql("strict") + ", r AS (SELECT unnest(string_split(CASE WHEN reason = '' THEN 'accepted' ELSE reason END, ';')) AS what FROM gated) SELECT what, count(*) AS n FROM r GROUP BY what UNION ALL SELECT 'total', count(*) FROM gated")
def rejection_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.rejection_counts(quality.quality_gate(images(spark, d)))


@query(_gated_sql("strict") + " SELECT count(*) AS total, count(*) FILTER (reason = '') AS accepted, round(count(*) FILTER (reason = '') / count(*), 6) AS rate FROM gated")
def acceptance_rate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.acceptance_rate(quality.quality_gate(images(spark, d))), "rate")


@query(_gated_sql("strict") + " SELECT path, reason FROM gated WHERE reason <> ''")
def rejected_index(spark: SparkSession, d: str) -> DataFrame:
    return reports.rejected_index(quality.quality_gate(images(spark, d))).select("path", "reason")


# --- filters ----------------------------------------------------------------------------------------------------------

_MIN_AREA = "(CASE WHEN class_name IN ('face', 'text_or_logo') THEN 100.0 ELSE 400.0 END)"
_MIN_CONF = "(CASE class_name " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in C.MIN_CONFIDENCE.items()) + " ELSE 0.2::DOUBLE END)"


@query(f"WITH {DET_SQL} SELECT {BOXES_SQL} FROM det WHERE {area_sql('det')} >= {_MIN_AREA}")
def filter_min_area(spark: SparkSession, d: str) -> DataFrame:
    return boxes(filters.filter_min_area(detections(spark, d)))


@query(f"WITH {DET_SQL} SELECT {BOXES_SQL} FROM det WHERE confidence >= {_MIN_CONF}")
def filter_confidence(spark: SparkSession, d: str) -> DataFrame:
    return boxes(filters.filter_confidence(detections(spark, d)))


@query(f"WITH {DET_SQL} SELECT {BOXES_SQL} FROM det WHERE class_name <> 'person' OR {area_sql('det')} <= 400 * 300 * 0.15::DOUBLE")
def filter_person_area(spark: SparkSession, d: str) -> DataFrame:
    return boxes(filters.filter_person_area(detections(spark, d), 400, 300))


@query(f"WITH {DET_SQL} SELECT {BOXES_SQL} FROM det WHERE {_ASPECT} <= 1.5")
def filter_aspect(spark: SparkSession, d: str) -> DataFrame:
    return boxes(filters.filter_aspect(detections(spark, d), 1.5))


def _with_setup(det: DataFrame) -> DataFrame:
    return det.withColumn("setup", F.concat(F.lit("setup_"), (F.col("image_id") % 3 + 1).cast("string")))


@query(f"WITH {DET_SQL} SELECT {BOXES_SQL} FROM det WHERE NOT (image_id % 3 + 1 <= 2 AND class_name IN ('face', 'text_or_logo') AND ((y1 + y2) / 2 < 720 * 0.25::DOUBLE OR (y1 + y2) / 2 > 720 OR (x1 + x2) / 2 > 1280))")
def filter_exclusion_zone(spark: SparkSession, d: str) -> DataFrame:
    return boxes(zones.filter_exclusion_zones(_with_setup(detections(spark, d)), zones.read_exclusions(spark, None), WIDTH, HEIGHT))


ZONES = [("setup_1", "full_width_top_20"), ("setup_1", "right_30"), ("setup_2", "left_25"), ("setup_2", "full_width_bottom_10")]


def _zone_table(spark: SparkSession) -> DataFrame:
    z = spark.createDataFrame(ZONES, "setup string, shorthand string").withColumn("points", zones.shorthand_polygon(F.col("shorthand"), F.lit(WIDTH), F.lit(HEIGHT)))
    triangle = spark.createDataFrame([("setup_3", "[[0,0],[400,0],[0,300]]"), ("setup_2", "[500,200,700,200,700,400,500,400]")], "setup string, polygon string")
    return z.select("setup", "points").unionByName(triangle.select("setup", zones.explicit_polygon(F.parse_json("polygon")).alias("points")))


@query(f"""WITH {DET_SQL}, c AS (SELECT *, image_id % 3 + 1 AS s, greatest(0, least(CAST(trunc((x1 + x2) / 2) AS INTEGER), 1279)) AS px, greatest(0, least(CAST(trunc((y1 + y2) / 2) AS INTEGER), 719)) AS py FROM det)
SELECT {BOXES_SQL} FROM c WHERE NOT ((s = 1 AND (py <= 144 OR px >= 896)) OR (s = 2 AND (px <= 320 OR py >= 648 OR (px BETWEEN 500 AND 700 AND py BETWEEN 200 AND 400))) OR (s = 3 AND px * 3 + py * 4 <= 1200))""")
def filter_polygon_zone(spark: SparkSession, d: str) -> DataFrame:
    return boxes(zones.filter_polygon_zones(_with_setup(detections(spark, d)), _zone_table(spark), WIDTH, HEIGHT))


@query("SELECT * FROM (VALUES ('setup_1', 0.2::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.3::DOUBLE), ('setup_2', 0.0::DOUBLE, 0.1::DOUBLE, 0.25::DOUBLE, 0.0::DOUBLE)) t(setup, top, bottom, \"left\", \"right\")")
def zone_crops(spark: SparkSession, d: str) -> DataFrame:
    return zones.crop_fractions(spark.createDataFrame(ZONES, "setup string, shorthand string"))


# --- counts and attributes ------------------------------------------------------------------------------------------------


@query(f"WITH {DET_SQL}, n AS (SELECT unnest({[*C.CLASS_NAMES]}) AS class_name) SELECT n.class_name, count(det.image_id) AS n FROM n LEFT JOIN det ON n.class_name = det.class_name AND det.confidence > 0.2 GROUP BY 1")
def class_counts(spark: SparkSession, d: str) -> DataFrame:
    return attributes.class_counts(detections(spark, d).where("confidence > 0.2D"), C.CLASS_NAMES)


def _attributed(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda c, n, values: F.get(F.array(*map(F.lit, values)), (F.col(c) % n).cast("int"))
    helmet = F.create_map(F.lit("helmet"), pick("part", 3, ["yes", "no", "unspecified"]))
    color = F.when(F.col("supp") % 4 != 0, F.create_map(F.lit("color"), pick("supp", 5, ["red", "blue", "unspecified", "green", "white"]))).otherwise(F.create_map().cast("map<string,string>"))
    return detections(spark, d).withColumn("attributes", F.map_concat(helmet, color))


_ATTR_SQL = f"""{DET_SQL}, kv AS (SELECT class_name, 'helmet' AS key, (['yes','no','unspecified'])[part % 3 + 1] AS value FROM det UNION ALL
SELECT class_name, 'color', CASE WHEN supp % 4 <> 0 THEN (['red','blue','unspecified','green','white'])[supp % 5 + 1] ELSE 'MISSING' END FROM det)"""


@query(f"WITH {_ATTR_SQL} SELECT class_name, key, count(*) AS total, round(count(*) FILTER (value <> 'unspecified') / count(*), 6) AS fill_rate FROM kv GROUP BY ALL")
def attribute_fill_rate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(attributes.attribute_fill_rate(_attributed(spark, d)), "fill_rate")


@query(f"WITH {_ATTR_SQL}, c AS (SELECT class_name, key, value, count(*) AS n FROM kv GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY class_name, key ORDER BY n DESC, value) AS INTEGER) AS rank FROM c) SELECT class_name, key, value, n, rank FROM r WHERE rank <= 4")
def top_attribute_values(spark: SparkSession, d: str) -> DataFrame:
    return attributes.top_values(_attributed(spark, d)).select("class_name", "key", "value", "n", "rank")


# --- suppression ------------------------------------------------------------------------------------------------------

_ROW = "[{'o': det_ord, 'n': class_name, 'c': confidence, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}]"


def _fold_sql(source: str, keys: str, order: str, conflict: str) -> str:
    """Survivors of a fold over lists of one row: ``conflict`` in terms of ``a`` (kept) and ``b``."""
    return f"""g AS (SELECT {keys}, list({_ROW} ORDER BY {order}) AS xs FROM {source} GROUP BY {keys}),
f AS (SELECT {keys}, unnest(list_reduce(xs, lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: {conflict.replace("b.", "x[1].")})) > 0 THEN acc ELSE acc || x END)) AS r FROM g)"""


_KEPT = "image_id, r.o AS det_ord, r.n AS class_name, round(r.x1, 6) AS x1, round(r.y1, 6) AS y1, round(r.x2, 6) AS x2, round(r.y2, 6) AS y2, round(r.c, 6) AS confidence"


@query(f"WITH {DET_SQL}, {_fold_sql('det', 'image_id, class_id', 'confidence DESC, det_ord', iou_sql('a', 'b') + ' > 0.3')} SELECT {_KEPT} FROM f")
def dedup_same_class(spark: SparkSession, d: str) -> DataFrame:
    return boxes(suppress.dedup_same_class(detections(spark, d)))


@query(f"WITH {DET_SQL}, {_fold_sql('det', 'image_id, class_id', 'confidence DESC, det_ord', iou_sql('a', 'b') + ' >= 0.5')} SELECT {_KEPT} FROM f")
def cross_model_nms(spark: SparkSession, d: str) -> DataFrame:
    return boxes(suppress.cross_model_nms(detections(spark, d)))


@query(f"WITH {DET_SQL}, {_fold_sql('det', 'image_id, class_id', 'confidence DESC, det_ord', iou_sql('a', 'b') + ' > 0.3')} SELECT {_KEPT} FROM f")
def inference_dedup(spark: SparkSession, d: str) -> DataFrame:
    det = detections(spark, d).withColumnRenamed("confidence", "conf")
    return boxes(suppress.inference_dedup(det).withColumnRenamed("conf", "confidence"))


def _heads_sql(size: float, part: float, head: float, empty: str) -> str:
    return f"""heads AS (SELECT DISTINCT s.image_id, s.det_ord FROM det s JOIN det l ON s.image_id = l.image_id AND s.det_ord <> l.det_ord WHERE s.class_name = 'person' AND l.class_name = 'person'
  AND {area_sql("s")} < {area_sql("l")} * {size}::DOUBLE AND ({containment_sql("l", "s")} >= {part}::DOUBLE OR ({area_sql("s")} <= 0 AND {empty})) AND (s.y1 + s.y2) / 2 <= l.y1 + (l.y2 - l.y1) * {head}::DOUBLE)"""


_NEW_SQL = "{heads}, new AS (SELECT det.* EXCLUDE (class_id, class_name), h.det_ord IS NOT NULL AS was_person, CASE WHEN h.det_ord IS NOT NULL THEN 0 ELSE class_id END AS class_id, CASE WHEN h.det_ord IS NOT NULL THEN 'face' ELSE class_name END AS class_name FROM det LEFT JOIN heads h ON det.image_id = h.image_id AND det.det_ord = h.det_ord)"
_ALLOWED_SQL = "((a.n = 'person' AND b.n = 'face') OR (a.n = 'face' AND b.n = 'person') OR (a.n = 'person' AND b.n = 'text_or_logo') OR (a.n = 'text_or_logo' AND b.n = 'person') OR (a.n = 'vehicle' AND b.n = 'text_or_logo') OR (a.n = 'text_or_logo' AND b.n = 'vehicle'))"


@query(f"WITH {DET_SQL}, {_NEW_SQL.format(heads=_heads_sql(0.4, 0.4, 0.45, 'false'))}, {_fold_sql('new', 'image_id', 'confidence DESC, CASE WHEN was_person THEN 2 WHEN class_name = $$person$$ THEN 0 ELSE 1 END, det_ord'.replace('$$', chr(39)), f'a.n <> b.n AND NOT {_ALLOWED_SQL} AND ' + iou_sql('a', 'b') + ' > 0.5')} SELECT {_KEPT} FROM f")
def cross_class_cleanup(spark: SparkSession, d: str) -> DataFrame:
    return boxes(suppress.cross_class_cleanup(detections(spark, d)))


@query(f"WITH {DET_SQL}, {_NEW_SQL.format(heads=_heads_sql(0.5, 0.5, 0.40, 'true'))} SELECT {BOXES_SQL} FROM new")
def reclassify_head_person(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spatial.reclassify_heads(detections(spark, d)))


@query(f"WITH {DET_SQL}, {_NEW_SQL.format(heads=_heads_sql(0.4, 0.4, 0.45, 'false'))} SELECT {BOXES_SQL} FROM new")
def reclassify_head_person_annotation(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spatial.reclassify_heads(detections(spark, d), 0.4, 0.4, 0.45, False))


# --- spatial joins ------------------------------------------------------------------------------------------------------


@query(f"""WITH {DET_SQL}, h AS (SELECT f.image_id, f.det_ord AS f, p.det_ord AS p, {containment_sql("p", "f")} AS c FROM det f JOIN det p ON f.image_id = p.image_id WHERE f.class_name = 'face' AND p.class_name = 'person' AND {containment_sql("p", "f")} > 0),
b AS (SELECT image_id, p, c, row_number() OVER (PARTITION BY image_id, f ORDER BY c DESC, p) AS n FROM h), l AS (SELECT DISTINCT image_id, p FROM b WHERE n = 1 AND c >= 0.7)
SELECT det.image_id, det.det_ord, CASE WHEN l.p IS NOT NULL THEN 'yes' ELSE 'no' END AS face_visible FROM det LEFT JOIN l ON det.image_id = l.image_id AND det.det_ord = l.p WHERE class_name = 'person'""")
def link_faces_best(spark: SparkSession, d: str) -> DataFrame:
    return spatial.link_faces_best(detections(spark, d)).select("image_id", "det_ord", "face_visible")


@query(f"WITH {DET_SQL} SELECT image_id, det_ord FROM det p WHERE class_name = 'person' AND EXISTS (SELECT 1 FROM det f WHERE f.image_id = p.image_id AND f.class_name = 'face' AND {containment_sql('p', 'f')} >= 0.3)")
def face_visible_semi(spark: SparkSession, d: str) -> DataFrame:
    return spatial.persons_with_face(detections(spark, d)).select("image_id", "det_ord")


@query(f"""WITH {DET_SQL}, h AS (SELECT f.image_id, f.det_ord, min(p.det_ord) AS person_ord FROM det f LEFT JOIN det p ON f.image_id = p.image_id AND p.class_name = 'person' AND {containment_sql("p", "f")} >= 0.3 WHERE f.class_name = 'face' GROUP BY ALL)
SELECT h.image_id, h.det_ord, h.person_ord, CASE WHEN p.part % 3 = 0 THEN 'yes' ELSE 'no' END AS has_helmet FROM h LEFT JOIN det p ON h.image_id = p.image_id AND h.person_ord = p.det_ord""")
def face_first_person_helmet(spark: SparkSession, d: str) -> DataFrame:
    det = detections(spark, d).withColumn("helmet", F.when(F.col("part") % 3 == 0, "yes").otherwise("no"))
    return spatial.face_helmets(det).select("image_id", "det_ord", "person_ord", "has_helmet")


@query(f"WITH {DET_SQL} SELECT image_id, det_ord FROM det v WHERE class_name = 'vehicle' AND NOT EXISTS (SELECT 1 FROM det t WHERE t.image_id = v.image_id AND t.class_name = 'text_or_logo' AND t.part % 2 = 0 AND {containment_sql('v', 't')} >= 0.3)")
def vehicle_without_plate(spark: SparkSession, d: str) -> DataFrame:
    det = detections(spark, d)
    return spatial.vehicles_without_plate(det, spatial.of_class(det, "text_or_logo").where("part % 2 = 0")).select("image_id", "det_ord")


_CENTRE = "(f.x1 + f.x2) / 2 BETWEEN p.x1 AND p.x2 AND (f.y1 + f.y2) / 2 BETWEEN p.y1 AND p.y2"


@query(f"""WITH {DET_SQL}, h AS (SELECT f.image_id, f.det_ord, min(p.det_ord) AS po FROM det f JOIN det p ON f.image_id = p.image_id AND p.class_name = 'person' AND {_CENTRE} WHERE f.class_name = 'face' GROUP BY ALL),
j AS (SELECT d.*, p.x1 AS px1, p.y1 AS py1, p.x2 AS px2, p.y2 AS py2, coalesce(d.y2 - d.y1 > (p.y2 - p.y1) * 0.4::DOUBLE, false) AS clips FROM det d LEFT JOIN h ON d.image_id = h.image_id AND d.det_ord = h.det_ord LEFT JOIN det p ON h.image_id = p.image_id AND h.po = p.det_ord),
k AS (SELECT image_id, det_ord, class_name, confidence, CASE WHEN clips THEN greatest(x1, px1) ELSE x1 END AS x1, y1, CASE WHEN clips THEN least(x2, px2) ELSE x2 END AS x2, CASE WHEN clips THEN py1 + (py2 - py1) * 0.3::DOUBLE ELSE y2 END AS y2 FROM j)
SELECT {BOXES_SQL} FROM k WHERE y2 - y1 >= 5""")
def clip_face(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spatial.clip_faces(detections(spark, d)))


# --- fusion -----------------------------------------------------------------------------------------------------------

_MEAN = "{{'x1': c.b1 / c.s, 'y1': c.b2 / c.s, 'x2': c.b3 / c.s, 'y2': c.b4 / c.s}}".replace("{{", "{").replace("}}", "}")
_FRESH = "[{'b1': x1 * confidence, 'b2': y1 * confidence, 'b3': x2 * confidence, 'b4': y2 * confidence, 's': confidence, 'k': 1, 'ms': [model], 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'o': det_ord, 'n': class_name}]"


def _cluster_iou() -> str:
    """Overlap of a cluster's mean box ``c`` with the row ``x[1]``."""
    m = {k: f"(c.b{i} / c.s)" for i, k in enumerate(BOX, 1)}
    inter = f"(greatest(0.0, least({m['x2']}, x[1].x2) - greatest({m['x1']}, x[1].x1)) * greatest(0.0, least({m['y2']}, x[1].y2) - greatest({m['y1']}, x[1].y1)))"
    union = f"((({m['x2']} - {m['x1']}) * ({m['y2']} - {m['y1']})) + (x[1].x2 - x[1].x1) * (x[1].y2 - x[1].y1) - {inter})"
    return f"(CASE WHEN {union} > 0 THEN {inter} / {union} ELSE 0.0 END)"


def _wbf_sql(where: str, threshold: float, guard: bool, cap: bool) -> str:
    v = f"list_transform(acc, lambda c: {_cluster_iou()})"
    at = f"list_position({v}, list_max({v}))"
    rep = {k: f"((acc[{at}]).b{i} / (acc[{at}]).s)" for i, k in enumerate(BOX, 1)}
    wide = f"(x[1].n = 'person' AND greatest(x[1].x2, {rep['x2']}) - least(x[1].x1, {rep['x1']}) > greatest(x[1].x2 - x[1].x1, {rep['x2']} - {rep['x1']}) * 1.5)"
    grown = "{'b1': c.b1 + x[1].b1, 'b2': c.b2 + x[1].b2, 'b3': c.b3 + x[1].b3, 'b4': c.b4 + x[1].b4, 's': c.s + x[1].s, 'k': c.k + 1, 'ms': list_concat(c.ms, x[1].ms), 'x1': c.x1, 'y1': c.y1, 'x2': c.x2, 'y2': c.y2, 'o': c.o, 'n': c.n}"
    confidence = "least(r.s / r.k, 1.0)" if cap else "r.s / r.k"
    return f"""WITH {DET_SQL}, g AS (SELECT image_id, class_id, list({_FRESH} ORDER BY confidence DESC, det_ord) AS xs FROM det WHERE {where} GROUP BY ALL),
f AS (SELECT image_id, class_id, unnest(list_reduce(xs, lambda acc, x: CASE WHEN list_max({v}) > {threshold} {"AND NOT " + wide if guard else ""} THEN list_transform(acc, lambda c, i: CASE WHEN i = {at} THEN {grown} ELSE c END) ELSE acc || x END)) AS r FROM g)
SELECT image_id, r.o AS det_ord, r.n AS class_name, round(r.b1 / r.s, 6) AS x1, round(r.b2 / r.s, 6) AS y1, round(r.b3 / r.s, 6) AS x2, round(r.b4 / r.s, 6) AS y2, round({confidence}, 6) AS confidence, array_to_string(list_sort(list_distinct(r.ms)), '+') AS model, r.k AS num_fused FROM f"""


@query(_wbf_sql(f"{area_sql('det')} >= {_MIN_AREA}", 0.35, True, True))
def wbf_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return boxes(fusion.wbf_pipeline(detections(spark, d)), "model", "num_fused")


@query(_wbf_sql("confidence >= 0.1::DOUBLE", 0.5, False, False))
def wbf_module(spark: SparkSession, d: str) -> DataFrame:
    return boxes(fusion.wbf_module(detections(spark, d), 0.5, 0.1), "model", "num_fused")


_MEMBER = "[{'m': [{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'c': confidence, 'o': det_ord, 'n': class_name, 'k': model}]}]"
_ANCHOR_IOU = iou_sql("c.m[1]", "x[1].m[1]")


@query(f"""WITH {DET_SQL}, g AS (SELECT image_id, class_id, list({_MEMBER} ORDER BY det_ord) AS xs FROM det GROUP BY ALL),
f AS (SELECT image_id, class_id, unnest(list_reduce(xs, lambda acc, x: CASE WHEN len(list_filter(acc, lambda c: {_ANCHOR_IOU} > 0.3)) > 0 THEN list_transform(acc, lambda c, i: CASE WHEN i = list_position(list_transform(acc, lambda c: {_ANCHOR_IOU} > 0.3), true) THEN {{'m': list_concat(c.m, x[1].m)}} ELSE c END) ELSE acc || x END)) AS r FROM g),
m AS (SELECT image_id, r.m[1].o AS det_ord, r.m[1].n AS class_name, r.m AS m, list_sum(list_transform(r.m, lambda q: q.c)) AS t FROM f)
SELECT image_id, det_ord, class_name, {", ".join(f"round(list_sum(list_transform(m, lambda q: q.{k} * (q.c / t))), 6) AS {k}" for k in BOX)}, round(list_max(list_transform(m, lambda q: q.c)), 6) AS confidence, CASE WHEN len(m) = 1 THEN m[1].k ELSE 'wbf_fused' END AS model, CAST(len(m) AS INTEGER) AS num_fused FROM m""")
def wbf_single_class(spark: SparkSession, d: str) -> DataFrame:
    return boxes(fusion.wbf_single_class(detections(spark, d)), "model", "num_fused")


# --- zero-shot --------------------------------------------------------------------------------------------------------

_LABELS = C.ZERO_SHOT_TASKS["vehicle_type"][0]
_ZERO_SQL = f"""p AS (SELECT vec_id, vec_id % 4 AS o, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id < 32), c AS (SELECT vec_id AS crop_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id >= 32),
s AS (SELECT crop_id, o, greatest(0.0, max(list_inner_product(c.v, p.v) / sqrt(list_inner_product(c.v, c.v)) / sqrt(list_inner_product(p.v, p.v)))) AS score FROM c, p GROUP BY ALL),
b AS (SELECT crop_id, o, score, row_number() OVER (PARTITION BY crop_id ORDER BY score DESC, o) AS n FROM s), z AS (SELECT crop_id, CASE WHEN score >= 0.22 THEN ({_LABELS})[o + 1] ELSE 'unspecified' END AS label, CASE WHEN score >= 0.22 THEN round(score, 6) ELSE 0.0 END AS score FROM b WHERE n = 1)"""


def _zero_shot(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    order = (F.col("vec_id") % 4).cast("int")
    prompts = e.where("vec_id < 32").select(order.alias("label_ord"), F.get(F.array(*map(F.lit, _LABELS)), order).alias("label"), "embedding")
    return classify.zero_shot(e.where("vec_id >= 32").select(F.col("vec_id").alias("crop_id"), "embedding"), prompts, 0.22)


@query(f"WITH {_ZERO_SQL} SELECT crop_id, label, score FROM z")
def zero_shot_label(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_zero_shot(spark, d), "score")


@query(f"WITH {DET_SQL} SELECT {BOXES_SQL} FROM det WHERE NOT (class_name IN ('vehicle', 'material_stack', 'text_or_logo', 'container') AND part % 7 = 0)")
def verify_gate(spark: SparkSession, d: str) -> DataFrame:
    det = detections(spark, d)
    verdicts = det.select("image_id", "det_ord", F.when(F.col("part") % 7 == 0, "negative").when(F.col("part") % 7 == 1, "unspecified").otherwise("positive").alias("label"))
    return boxes(classify.verify_gate(det, verdicts))


# --- selection and split ------------------------------------------------------------------------------------------------


@query(f"WITH {IMG_SQL} SELECT image_id, person_count * 10.0::DOUBLE + vehicle_count * 5.0::DOUBLE AS score FROM img")
def relevance_score(spark: SparkSession, d: str) -> DataFrame:
    return selection.relevance_score(images(spark, d)).select("image_id", "score")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return images(spark, d).withColumn("captured_at", names.captured_at(names.file_name(F.col("path")))).select("image_id", "path", "captured_at", "person_count", "vehicle_count")


#: Images best first, each with those kept before it: no time within 180 s, no hour over five. Images without a time stay.
#: Pieces of the timeline between which both a gap and the hour's end lie don't touch one another, so each is a short list.
_SELECT_SQL = f"""{IMG_SQL}, sc AS (SELECT image_id, person_count * 10.0::DOUBLE + vehicle_count * 5.0::DOUBLE AS score, person_count, vehicle_count, try_strptime(regexp_extract(replace(path, '.jpg', ''), '[^_]+$'), '%Y%m%d%H%M%S') AS t FROM img),
ev AS (SELECT image_id, score, epoch(t) AS s, CAST(epoch(t) AS BIGINT) // 3600 AS h FROM sc WHERE t IS NOT NULL), la AS (SELECT *, lag(s) OVER w AS ls, lag(h) OVER w AS lh FROM ev WINDOW w AS (ORDER BY s, image_id)),
pc AS (SELECT *, sum(CASE WHEN s - ls >= 180 AND h <> lh THEN 1 ELSE 0 END) OVER (ORDER BY s, image_id ROWS UNBOUNDED PRECEDING) AS piece FROM la),
li AS (SELECT piece, list([{{'o': image_id, 's': s, 'h': h}}] ORDER BY score DESC, image_id) AS xs FROM pc GROUP BY piece),
fo AS (SELECT unnest(list_reduce(xs, lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: abs(a.s - x[1].s) < 180)) > 0 OR len(list_filter(acc, lambda a: a.h = x[1].h)) >= 5 THEN acc ELSE acc || x END)) AS r FROM li),
sel AS (SELECT sc.* FROM sc LEFT JOIN fo ON sc.image_id = fo.r.o WHERE t IS NULL OR fo.r.o IS NOT NULL ORDER BY score DESC, image_id LIMIT 2500)"""


@query(f"WITH {_SELECT_SQL} SELECT image_id, score, strftime(t, '%Y-%m-%d %H:%M:%S') AS captured_at FROM sel")
def temporal_diversity(spark: SparkSession, d: str) -> DataFrame:
    return stages.select_images(_scored(spark, d)).select("image_id", "score", F.date_format("captured_at", "yyyy-MM-dd HH:mm:ss").alias("captured_at"))


@query(f"WITH {_SELECT_SQL} SELECT count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(person_count), 6) AS mean_persons, round(avg(vehicle_count), 6) AS mean_vehicles FROM sel")
def selection_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(selection.selection_stats(stages.select_images(_scored(spark, d))), "mean_score", "mean_persons", "mean_vehicles")


@query(f"WITH {IMG_SQL}, p AS (SELECT DISTINCT path FROM img) SELECT path FROM p ORDER BY md5(path || '|42'), path LIMIT 2500")
def random_baseline(spark: SparkSession, d: str) -> DataFrame:
    return selection.random_baseline(_scored(spark, d).select("path").distinct(), 2500)


_SPLIT_SQL = "s AS (SELECT event_id, 'img_' || event_id AS stem FROM events WHERE event_id % 3 <> 0), r AS (SELECT *, row_number() OVER (ORDER BY md5(stem || '|42'), stem) AS n, count(*) OVER () AS t FROM s), sp AS (SELECT stem, CASE WHEN n <= floor(t * (1 - 0.2::DOUBLE)) THEN 'train' ELSE 'val' END AS split FROM r)"


def _stems(spark: SparkSession, d: str, where: str) -> DataFrame:
    return table(spark, d, "events").where(where).select(F.concat(F.lit("img_"), "event_id").alias("stem"))


@query(f"WITH {_SPLIT_SQL} SELECT stem, split FROM sp")
def train_val_split(spark: SparkSession, d: str) -> DataFrame:
    return split.train_val_split(_stems(spark, d, "event_id % 3 <> 0")).select("stem", "split")


@query(f"WITH {_SPLIT_SQL}, {DET_SQL} SELECT split, class_name, count(*) AS n FROM sp JOIN det ON sp.stem = 'img_' || det.image_id GROUP BY ALL")
def split_class_counts(spark: SparkSession, d: str) -> DataFrame:
    b = detections(spark, d).select(F.concat(F.lit("img_"), "image_id").alias("stem"), "class_id")
    return split.split_class_counts(split.train_val_split(_stems(spark, d, "event_id % 3 <> 0")), b, C.CLASS_NAMES)


@query("SELECT 'labels_without_images' AS side, count(*) AS n FROM events WHERE event_id % 3 <> 0 AND event_id % 5 = 0 UNION ALL SELECT 'images_without_labels', count(*) FROM events WHERE event_id % 3 = 0 AND event_id % 5 <> 0")
def unmatched_labels(spark: SparkSession, d: str) -> DataFrame:
    return split.unmatched(_stems(spark, d, "event_id % 3 <> 0"), _stems(spark, d, "event_id % 5 <> 0"))


@query("SELECT 'img_' || event_id AS stem, 'raw/img_' || event_id || (CASE WHEN event_id % 2 = 0 THEN '.jpg' ELSE '.png' END) AS image_path FROM events WHERE event_id % 3 <> 0")
def image_by_priority(spark: SparkSession, d: str) -> DataFrame:
    e = _stems(spark, d, "event_id % 3 <> 0")
    exts = F.when(F.substring("stem", -1, 1).isin("0", "2", "4", "6", "8"), F.array(F.lit(".png"), F.lit(".jpg"))).otherwise(F.array(F.lit(".bmp"), F.lit(".png"), F.lit(".gif")))
    files = e.select("stem", F.explode(exts).alias("ext")).withColumn("image_path", F.concat(F.lit("raw/"), "stem", "ext"))
    return split.image_by_priority(e, files).select("stem", "image_path")


# --- anonymisation ------------------------------------------------------------------------------------------------------


def _plan_sql() -> str:
    w, h = 700.0, 600.0
    return f"""{DET_SQL}, {_NEW_SQL.format(heads=_heads_sql(0.5, 0.5, 0.40, "true"))},
wf AS (SELECT DISTINCT image_id, po FROM (SELECT f.image_id, f.det_ord, min(p.det_ord) AS po FROM new f JOIN new p ON f.image_id = p.image_id AND p.class_name = 'person' AND {_CENTRE} WHERE f.class_name = 'face' GROUP BY ALL)),
t AS (SELECT n.*, CASE WHEN was_person THEN 'reclassified_person_to_face' WHEN class_name = 'face' AND confidence >= 0.5 THEN 'tier1_face' WHEN class_name = 'face' THEN 'tier2_face_buffered' WHEN class_name = 'person' AND wf.po IS NULL THEN 'tier3_body_blur' WHEN class_name = 'text_or_logo' THEN 'text_or_logo' END AS tier FROM new n LEFT JOIN wf ON n.image_id = wf.image_id AND n.det_ord = wf.po),
u AS (SELECT image_id, det_ord, tier, class_name, x1, y1, x2, CASE WHEN tier = 'tier3_body_blur' THEN y1 + (y2 - y1) * 0.33::DOUBLE ELSE y2 END AS y2, CASE tier WHEN 'tier2_face_buffered' THEN 20 WHEN 'tier3_body_blur' THEN 5 ELSE 10 END AS p, CASE WHEN tier = 'tier3_body_blur' THEN 31 ELSE 51 END AS base, CASE WHEN tier = 'reclassified_person_to_face' THEN 0 WHEN class_name = 'face' THEN 1 WHEN class_name = 'person' THEN 2 ELSE 3 END AS o FROM t WHERE tier IS NOT NULL),
k AS (SELECT *, greatest(base, CAST(trunc(greatest(x2 - x1, y2 - y1) * 0.4::DOUBLE) AS INTEGER)) AS k FROM u),
plan AS (SELECT image_id, tier, det_ord, CAST(row_number() OVER (PARTITION BY image_id ORDER BY o, det_ord) AS INTEGER) AS seq, greatest(0.0, x1 - (x2 - x1) * p / 100) AS x1, greatest(0.0, y1 - (y2 - y1) * p / 100) AS y1, least({w}, x2 + (x2 - x1) * p / 100) AS x2, least({h}, y2 + (y2 - y1) * p / 100) AS y2, CASE WHEN k % 2 = 0 THEN k + 1 ELSE k END AS kernel FROM k)"""


@query(f"WITH {_plan_sql()} SELECT image_id, seq, tier, det_ord, {BOX_SQL}, kernel FROM plan")
def blur_plan(spark: SparkSession, d: str) -> DataFrame:
    return rounded(anonymise.blur_plan(detections(spark, d), 700, 600), *BOX).select("image_id", "seq", "tier", "det_ord", *BOX, "kernel")


@query(f"WITH {_plan_sql()} SELECT tier, count(*) AS n FROM plan GROUP BY tier UNION ALL SELECT 'total', count(*) FROM plan")
def tier_counts(spark: SparkSession, d: str) -> DataFrame:
    return anonymise.tier_counts(anonymise.blur_plan(detections(spark, d), 700, 600))


def _module_plan_sql() -> str:
    pad = "greatest(0, CAST(trunc(x1 - (x2 - x1) * p / 100) AS INTEGER)) AS x1, greatest(0, CAST(trunc(y1 - (y2 - y1) * p / 100) AS INTEGER)) AS y1, least(1280, CAST(trunc(x2 + (x2 - x1) * p / 100) AS INTEGER)) AS x2, least(720, CAST(trunc(y2 + (y2 - y1) * p / 100) AS INTEGER)) AS y2"
    return f"""{DET_SQL}, {_NEW_SQL.format(heads=_heads_sql(0.5, 0.5, 0.40, "true"))},
wf AS (SELECT DISTINCT image_id, po FROM (SELECT f.image_id, f.det_ord, min(p.det_ord) AS po FROM new f JOIN new p ON f.image_id = p.image_id AND p.class_name = 'person' AND {_CENTRE} WHERE f.class_name = 'face' GROUP BY ALL)),
t AS (SELECT n.*, CASE WHEN class_name = 'face' AND confidence >= 0.5 THEN 'tier1_face' WHEN class_name = 'face' THEN 'tier2_face_buffered' WHEN class_name = 'person' AND wf.po IS NULL THEN 'tier3_body_blur' WHEN class_name = 'text_or_logo' THEN 'text_or_logo' END AS tier FROM new n LEFT JOIN wf ON n.image_id = wf.image_id AND n.det_ord = wf.po),
u AS (SELECT image_id, det_ord, tier, x1, y1, x2, CASE WHEN tier = 'tier3_body_blur' THEN y1 + (y2 - y1) * 0.33::DOUBLE ELSE y2 END AS y2, CASE tier WHEN 'tier2_face_buffered' THEN 20 WHEN 'tier3_body_blur' THEN 5 ELSE 10 END AS p FROM t WHERE tier IS NOT NULL),
plan AS (SELECT image_id, tier, det_ord, {pad}, CASE WHEN tier = 'tier3_body_blur' THEN 31 ELSE 51 END AS kernel FROM u)"""


@query(f"WITH {_module_plan_sql()} SELECT image_id, tier, det_ord, x1, y1, x2, y2, kernel FROM plan")
def blur_plan_module(spark: SparkSession, d: str) -> DataFrame:
    return stages.Anonymizer().plan(detections(spark, d), WIDTH, HEIGHT)


# --- evaluation -------------------------------------------------------------------------------------------------------

_T_IOU = iou_sql("t", "x[1]")
_MATCH_SQL = f"""{DET_SQL}, tr AS (SELECT image_id, class_id, list({{'o': det_ord, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY det_ord) AS ts FROM det WHERE model = 'yolo_coco' GROUP BY ALL),
pr AS (SELECT image_id, class_id, list([{{'o': det_ord, 'c': confidence, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 't': NULL::INTEGER}}] ORDER BY confidence DESC, det_ord) AS xs FROM det WHERE model <> 'yolo_coco' GROUP BY ALL),
pt AS (SELECT pr.image_id, pr.class_id, list_concat([[{{'o': -1, 'c': 0.0::DOUBLE, 'x1': 0.0::DOUBLE, 'y1': 0.0::DOUBLE, 'x2': 0.0::DOUBLE, 'y2': 0.0::DOUBLE, 't': NULL::INTEGER}}]], xs) AS xs, coalesce(ts, []) AS ts FROM pr LEFT JOIN tr ON pr.image_id = tr.image_id AND pr.class_id = tr.class_id),
mt AS (SELECT image_id, class_id, unnest(list_reduce(xs, lambda acc, x: acc || [{{'o': x[1].o, 'c': x[1].c, 'x1': x[1].x1, 'y1': x[1].y1, 'x2': x[1].x2, 'y2': x[1].y2,
  't': (list_sort(list_transform(list_filter(ts, lambda t: NOT list_contains(list_transform(acc, lambda a: a.t), t.o) AND {_T_IOU} >= 0.5), lambda t: {{'v': -{_T_IOU}, 'o': t.o}})))[1].o}}])) AS r FROM pt),
m AS (SELECT image_id, class_id, r.o AS det_ord, r.c AS confidence, r.t AS truth_ord, r.t IS NOT NULL AS tp FROM mt WHERE r.o > 0)"""


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    det = detections(spark, d)
    return det.where("model <> 'yolo_coco'"), det.where("model = 'yolo_coco'")


@query(f"WITH {_MATCH_SQL} SELECT image_id, class_id, det_ord, round(confidence, 6) AS confidence, truth_ord, tp FROM m")
def match_predictions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.match_predictions(*_sides(spark, d)), "confidence")


@query(f"""WITH {_MATCH_SQL}, c AS (SELECT class_id, count(*) FILTER (tp) AS tp, count(*) FILTER (NOT tp) AS fp FROM m GROUP BY class_id), n AS (SELECT class_id, count(*) AS n FROM det WHERE model = 'yolo_coco' GROUP BY class_id),
j AS (SELECT class_id, tp, fp, n - tp AS fn, tp / (tp + fp) AS p, tp / n AS r FROM c JOIN n USING (class_id)) SELECT class_id, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM j""")
def precision_recall(spark: SparkSession, d: str) -> DataFrame:
    p, t = _sides(spark, d)
    return rounded(evaluate.precision_recall(evaluate.match_predictions(p, t), t), "precision", "recall", "f1").select("class_id", "tp", "fp", "fn", "precision", "recall", "f1")


@query(f"""WITH {_MATCH_SQL}, n AS (SELECT class_id, count(*) AS n FROM det WHERE model = 'yolo_coco' GROUP BY class_id), s AS (SELECT class_id, confidence, count(*) FILTER (tp) AS tp, count(*) AS k FROM m GROUP BY ALL),
c AS (SELECT s.class_id, confidence, tp / n AS gain, sum(tp) OVER w / sum(k) OVER w AS p FROM s JOIN n USING (class_id) WINDOW w AS (PARTITION BY s.class_id ORDER BY confidence DESC)),
h AS (SELECT class_id, gain, max(p) OVER (PARTITION BY class_id ORDER BY confidence DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hull FROM c) SELECT class_id, round(sum(hull * gain), 6) AS ap FROM h GROUP BY class_id""")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    p, t = _sides(spark, d)
    return rounded(evaluate.average_precision(evaluate.match_predictions(p, t), t), "ap")


@query(f"""WITH {_MATCH_SQL}, c AS (SELECT class_id, count(*) FILTER (tp) AS tp FROM m GROUP BY class_id), n AS (SELECT class_id, class_name, count(*) AS n FROM det WHERE model = 'yolo_coco' GROUP BY ALL), r AS (SELECT class_name, tp / n AS r FROM c JOIN n USING (class_id))
SELECT round(sum(CASE class_name WHEN 'face' THEN 0.4 WHEN 'person' THEN 0.3 WHEN 'vehicle' THEN 0.1 WHEN 'text_or_logo' THEN 0.1 ELSE 0 END * r) + 0.1 * avg(r) FILTER (class_name NOT IN ('face', 'person', 'vehicle', 'text_or_logo')), 6) AS privacy_score FROM r""")
def privacy_score(spark: SparkSession, d: str) -> DataFrame:
    p, t = _sides(spark, d)
    pr = evaluate.precision_recall(evaluate.match_predictions(p, t), t)
    return rounded(evaluate.privacy_score(pr.select(names.class_name(F.col("class_id")).alias("class_name"), "recall")), "privacy_score")


def _report_sql() -> str:
    matched = lambda t: f"(WITH {_MATCH_SQL.replace('>= 0.5)', f'>= {t!r}::DOUBLE)')} SELECT {t!r}::DOUBLE AS t, class_id, confidence, tp FROM m)"
    four = lambda c: f"format('{{:.4f}}', {c})"
    return f"""WITH {DET_SQL}, mm AS ({" UNION ALL ".join(map(matched, evaluate.THRESHOLDS))}), n AS (SELECT class_id, class_name, count(*) AS n FROM det WHERE model = 'yolo_coco' GROUP BY ALL),
s AS (SELECT t, class_id, confidence, count(*) FILTER (tp) AS tp, count(*) AS k FROM mm GROUP BY ALL), c AS (SELECT t, s.class_id, confidence, tp / n AS gain, sum(tp) OVER w / sum(k) OVER w AS p FROM s JOIN n USING (class_id) WINDOW w AS (PARTITION BY t, s.class_id ORDER BY confidence DESC)),
h AS (SELECT t, class_id, gain, max(p) OVER (PARTITION BY t, class_id ORDER BY confidence DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hull FROM c), ap AS (SELECT t, class_id, sum(hull * gain) AS ap FROM h GROUP BY ALL),
a AS (SELECT class_id, max(ap) FILTER (t = 0.5) AS ap50, sum(ap) / 10 AS ap95 FROM ap GROUP BY class_id), q AS (SELECT class_id, sum(tp) AS tp, sum(k) AS k FROM s WHERE t = 0.5 GROUP BY class_id),
r AS (SELECT class_name, tp / k AS p, tp / n AS r, 2 * (tp / k) * (tp / n) / (tp / k + tp / n) AS f, ap50, ap95 FROM q JOIN n USING (class_id) JOIN a USING (class_id))
SELECT class_name AS class, {four("p")} AS precision, {four("r")} AS recall, {four("f")} AS f1, {four("ap50")} AS map50, {four("ap95")} AS map50_95 FROM r UNION ALL SELECT 'Overall', {four("avg(p)")}, {four("avg(r)")}, '', {four("avg(ap50)")}, {four("avg(ap95)")} FROM r"""


@query(_report_sql())
def evaluation_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.evaluation_csv(stages.evaluate_detections(*_sides(spark, d)))


# --- documents and pipelines ----------------------------------------------------------------------------------------------


@query(f"WITH {DET_SQL} SELECT row_number() OVER (ORDER BY image_id, det_ord) AS id, image_id, class_id + 1 AS category_id, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h, round({area_sql('det')}, 6) AS area, model AS source FROM det")
def coco_annotations(spark: SparkSession, d: str) -> DataFrame:
    a = formats.coco_annotations(detections(spark, d))
    return a.select("id", "image_id", "category_id", *(F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate("xywh")), F.round("area", 6).alias("area"), "source")


@query(f"""WITH {DET_SQL}, a AS (SELECT row_number() OVER (ORDER BY image_id, det_ord) AS id, image_id, class_id + 1 AS category_id, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h FROM det),
n AS (SELECT image_id // 1000 AS part, count(DISTINCT image_id) AS n_images FROM det GROUP BY ALL)
SELECT image_id // 1000 AS part, n_images, 8 AS n_categories, id, image_id, 'img_' || image_id || '.jpg' AS file_name, category_id, x, y, w, h FROM a JOIN n ON image_id // 1000 = part""")
def coco_document(spark: SparkSession, d: str) -> DataFrame:
    """The documents, read back."""
    det = detections(spark, d)
    ims = det.select("image_id").distinct().select("image_id", F.concat(F.lit("img_"), "image_id", F.lit(".jpg")).alias("file_name"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))
    docs = formats.coco_documents(formats.coco_annotations(det), ims, 1000).select("part", F.from_json("json", COCO).alias("d"))
    names_ = F.map_from_arrays(F.col("d.images.id"), F.col("d.images.file_name"))
    rows = docs.select("part", F.size("d.images").cast("long").alias("n_images"), F.size("d.categories").alias("n_categories"), names_.alias("names"), F.explode("d.annotations").alias("a"))
    return rows.select("part", "n_images", "n_categories", "a.id", "a.image_id", F.element_at("names", F.col("a.image_id")).alias("file_name"), "a.category_id", *(F.get("a.bbox", F.lit(i)).alias(n) for i, n in enumerate("xywh")))


def _annotation_sql() -> str:
    fused = _wbf_sql(f"{area_sql('det')} >= {_MIN_AREA}", 0.35, True, True)
    head = fused[: fused.index("\nSELECT image_id")].replace("unnest(list_reduce(", "list_reduce(").replace(")) AS r FROM g)", ") AS rs FROM g)")
    k = ", ".join(f"r.b{i} / r.s AS {c}" for i, c in enumerate(BOX, 1))
    new = _NEW_SQL.format(heads=_heads_sql(0.4, 0.4, 0.45, "false")).replace("heads AS", "heads2 AS").replace("heads h", "heads2 h").replace("det s", "fu s").replace("det l", "fu l").replace("det.", "fu.").replace("FROM det ", "FROM fu ")
    across = _fold_sql("new", "image_id", "confidence DESC, CASE WHEN was_person THEN 2 WHEN class_name = 'person' THEN 0 ELSE 1 END, det_ord", f"a.n <> b.n AND NOT {_ALLOWED_SQL} AND {iou_sql('a', 'b')} > 0.5").replace("g AS", "g2 AS").replace("FROM g)", "FROM g2)").replace("f AS", "f2 AS")
    same = _fold_sql("cl", "image_id, class_id", "confidence DESC, det_ord", iou_sql("a", "b") + " > 0.3").replace("g AS", "g3 AS").replace("FROM g)", "FROM g3)").replace("f AS", "f3 AS")
    zone = "NOT (image_id % 3 + 1 <= 2 AND class_name IN ('face', 'text_or_logo') AND ((y1 + y2) / 2 < 720 * 0.25::DOUBLE OR (y1 + y2) / 2 > 720 OR (x1 + x2) / 2 > 1280))"
    return f"""{head}, fx AS (SELECT image_id, class_id, unnest(rs) AS r, generate_subscripts(rs, 1) AS o FROM f),
fu AS (SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY class_id, o) AS INTEGER) AS det_ord, class_id, r.n AS class_name, {k}, least(r.s / r.k, 1.0) AS confidence, array_to_string(list_sort(list_distinct(r.ms)), '+') AS model, r.k AS num_fused FROM fx),
{new}, {across}, cl AS (SELECT new.* FROM f2 JOIN new ON f2.image_id = new.image_id AND f2.r.o = new.det_ord), {same}, du AS (SELECT cl.* FROM f3 JOIN cl ON f3.image_id = cl.image_id AND f3.r.o = cl.det_ord)
SELECT {BOXES_SQL}, model, num_fused FROM du WHERE confidence >= {_MIN_CONF} AND (class_name <> 'person' OR {area_sql("du")} <= 1280 * 720 * 0.15::DOUBLE) AND {_ASPECT} <= {C.MAX_ASPECT_RATIO} AND {zone}"""


@query(_annotation_sql())
def annotation_pipeline(spark: SparkSession, d: str) -> DataFrame:
    det = detections(spark, d)
    setup = F.concat(F.lit("setup_"), (F.col("image_id") % 3 + 1).cast("string"))
    return boxes(stages.annotate(det, WIDTH, HEIGHT, exclusions=zones.read_exclusions(spark, None), setup=setup), "model", "num_fused")


def _inference_sql() -> str:
    allowed = """SELECT * EXCLUDE (model), CASE WHEN class_name = 'face' THEN 'weights/face_only.pt' WHEN part % 3 = 0 THEN 'weights/v11_person_supplement.pt' ELSE 'weights/v12_general.pt' END AS model FROM det"""
    general = ", ".join(map(_quoted, formats.DEFAULT_CONFIG["models"][0]["classes"]))
    kept = f"(model = 'weights/v12_general.pt' AND confidence >= 0.15 AND class_name IN ({general})) OR (model = 'weights/face_only.pt' AND confidence >= 0.10 AND class_name = 'face') OR (model = 'weights/v11_person_supplement.pt' AND confidence >= 0.20 AND class_name = 'person')"
    mean = ", ".join(f"list_sum(list_transform(m, lambda q: q.{k} * (q.c / t))) AS {k}" for k in BOX)
    return f"""WITH {DET_SQL}, al AS ({allowed}), ok AS (SELECT * FROM al WHERE {kept}), g AS (SELECT image_id, class_id, list({_MEMBER} ORDER BY det_ord) AS xs FROM ok GROUP BY ALL),
f AS (SELECT image_id, class_id, unnest(list_reduce(xs, lambda acc, x: CASE WHEN len(list_filter(acc, lambda c: {_ANCHOR_IOU} > 0.3)) > 0 THEN list_transform(acc, lambda c, i: CASE WHEN i = list_position(list_transform(acc, lambda c: {_ANCHOR_IOU} > 0.3), true) THEN {{'m': list_concat(c.m, x[1].m)}} ELSE c END) ELSE acc || x END)) AS r FROM g),
mm AS (SELECT image_id, r.m[1].o AS det_ord, r.m[1].n AS class_name, r.m AS m, list_sum(list_transform(r.m, lambda q: q.c)) AS t FROM f),
w AS (SELECT image_id, det_ord, class_name, {mean}, list_max(list_transform(m, lambda q: q.c)) AS confidence, CASE WHEN len(m) = 1 THEN m[1].k ELSE 'wbf_fused' END AS model FROM mm),
h AS (SELECT f.image_id, f.det_ord, min(p.det_ord) AS po FROM w f JOIN w p ON f.image_id = p.image_id AND p.class_name = 'person' AND {_CENTRE} WHERE f.class_name = 'face' GROUP BY ALL),
j AS (SELECT d.*, p.x1 AS px1, p.y1 AS py1, p.x2 AS px2, p.y2 AS py2, coalesce(d.y2 - d.y1 > (p.y2 - p.y1) * 0.4::DOUBLE, false) AS clips FROM w d LEFT JOIN h ON d.image_id = h.image_id AND d.det_ord = h.det_ord AND d.class_name = 'face' LEFT JOIN w p ON h.image_id = p.image_id AND h.po = p.det_ord),
k AS (SELECT image_id, det_ord, class_name, confidence, model, CASE WHEN clips THEN greatest(x1, px1) ELSE x1 END AS x1, y1, CASE WHEN clips THEN least(x2, px2) ELSE x2 END AS x2, CASE WHEN clips THEN py1 + (py2 - py1) * 0.3::DOUBLE ELSE y2 END AS y2 FROM j)
SELECT {BOXES_SQL}, model FROM k WHERE y2 - y1 >= 5"""


@query(_inference_sql())
def inference_pipeline(spark: SparkSession, d: str) -> DataFrame:
    weights = F.when(F.col("class_name") == "face", "weights/face_only.pt").when(F.col("part") % 3 == 0, "weights/v11_person_supplement.pt").otherwise("weights/v12_general.pt")
    return boxes(stages.infer(detections(spark, d).withColumn("model", weights)), "model")


# --- enrichment and pixels ------------------------------------------------------------------------------------------------

_GEAR = ["hard hat", "Safety Vest", "white helmet", "gloves", "reflective jacket", "boots", "high visibility helmet"]
_GEAR_SQL = f"g AS (SELECT l_orderkey, lower(({_GEAR})[l_partkey % {len(_GEAR)} + 1]) AS name FROM lineitem), h AS (SELECT l_orderkey, contains(name, 'helmet') OR contains(name, 'hard hat') AS helmet, name FROM g)"


@query(f"WITH {_GEAR_SQL} SELECT l_orderkey, CASE WHEN bool_or(helmet) THEN 'yes' ELSE 'no' END AS helmet, CASE WHEN bool_or(NOT helmet AND (contains(name, 'vest') OR contains(name, 'visibility') OR contains(name, 'reflective') OR contains(name, 'safety jacket'))) THEN 'yes' ELSE 'no' END AS vest FROM h GROUP BY l_orderkey")
def ppe_flags(spark: SparkSession, d: str) -> DataFrame:
    name = F.get(F.array(*map(F.lit, _GEAR)), (F.col("l_partkey") % len(_GEAR)).cast("int"))
    return classify.ppe_flags(table(spark, d, "lineitem").select("l_orderkey", name.alias("name")), ["l_orderkey"])


@query("SELECT l_orderkey, CASE WHEN bool_or(l_partkey % 50 = 0) THEN NULL ELSE bool_or((l_suppkey % 10)::DOUBLE / 20 > 0.3) END AS is_text FROM lineitem GROUP BY l_orderkey")
def ocr_verdict(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "lineitem").select("l_orderkey", ((F.col("l_suppkey") % 10).cast("double") / 20).alias("score"), F.when(F.col("l_partkey") % 50 == 0, "failed").alias("error"))
    return classify.ocr_verdict(texts, ["l_orderkey"])


@query(f"WITH {DET_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, det_ord) AS n FROM det WHERE class_name = 'face') SELECT image_id, det_ord, CASE WHEN confidence >= 0.15 THEN 'clear' WHEN confidence >= 0.08 THEN 'partial' ELSE 'occluded' END AS visibility FROM f WHERE n = 1")
def best_rescue_face(spark: SparkSession, d: str) -> DataFrame:
    best = classify.best_face(spatial.of_class(detections(spark, d), "face"), ["image_id"])
    return best.select("image_id", "det_ord", names.visibility(F.col("confidence")).alias("visibility"))


@query(f"WITH {DET_SQL}, t AS (SELECT image_id, det_ord, (['company_name','license_plate','other'])[part % 3 + 1] AS ct, (['yes','no','unspecified'])[supp % 3 + 1] AS it, (['unspecified','yes'])[supp % 2 + 1] AS il FROM det WHERE class_name = 'text_or_logo') SELECT image_id, det_ord, CASE WHEN ct = 'company_name' THEN 'yes' WHEN it = 'yes' AND il = 'unspecified' THEN 'no' ELSE il END AS is_logo FROM t")
def text_attributes(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda c, values: F.get(F.array(*map(F.lit, values)), (F.col(c) % len(values)).cast("int"))
    texts = spatial.of_class(detections(spark, d), "text_or_logo").select("image_id", "det_ord", pick("part", ["company_name", "license_plate", "other"]).alias("content_type"), pick("supp", ["yes", "no", "unspecified"]).alias("is_text"), pick("supp", ["unspecified", "yes"]).alias("is_logo"))
    return classify.text_attributes(texts).select("image_id", "det_ord", "is_logo")


@query(f"""WITH {DET_SQL}, b AS (SELECT v.image_id, v.det_ord AS vehicle_ord, v.x1, v.y1 + (v.y2 - v.y1) * 0.5::DOUBLE AS y1, v.x2, v.y2, v.part FROM det v WHERE class_name = 'vehicle' AND NOT EXISTS (SELECT 1 FROM det t WHERE t.image_id = v.image_id AND t.class_name = 'text_or_logo' AND t.part % 2 = 0 AND {containment_sql('v', 't')} >= 0.3))
SELECT image_id, vehicle_ord, {BOX_SQL} FROM b WHERE part % 3 = 1 AND least(1280, trunc(x2)) - greatest(0, trunc(x1)) >= 20 AND least(720, trunc(y2)) - greatest(0, trunc(y1)) >= 10""")
def plate_rescue(spark: SparkSession, d: str) -> DataFrame:
    det = detections(spark, d)
    plates = spatial.of_class(det, "text_or_logo").where("part % 2 = 0")
    found = det.where("part % 3 = 1").select("image_id", "det_ord")
    return rounded(stages.rescue_plates(det, plates, found, WIDTH, HEIGHT).select("image_id", "vehicle_ord", *BOX), *BOX)


@query("WITH p AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(CAST(floor((x + 1) * 100) AS INTEGER) % 256 AS DOUBLE)) AS v FROM embeddings) SELECT 'img_' || vec_id AS path, round(list_avg(v), 6) AS brightness, round(list_stddev_pop(v), 6) AS contrast FROM p")
def pixel_metrics(spark: SparkSession, d: str) -> DataFrame:
    from sitelens.functions import kernels

    gray = F.expr("unhex(array_join(transform(embedding, x -> lpad(hex(cast(floor((cast(x as double) + 1) * 100) as int) % 256), 2, '0')), ''))")
    ims = table(spark, d, "embeddings").select(F.concat(F.lit("img_"), "vec_id").alias("path"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("n_channels"), gray.alias("data"))
    return rounded(kernels.measure(ims), "brightness", "contrast").select("path", "brightness", "contrast")


def _enrichment_sql() -> str:
    phrase = f"lower(trim(({PHRASE_WORDS})[part % {len(PHRASE_WORDS)} + 1]))"
    logo = f"CASE WHEN {' OR '.join(_like(phrase, k) for k in C.LOGO_PHRASES)} THEN 'yes' ELSE 'no' END"
    kind = _case([(_like(phrase, k), v) for k, v in names.by_length(C.CONTENT_TYPES)], "other")
    helmet = "CASE WHEN part % 3 = 0 THEN 'yes' ELSE 'no' END"
    return f"""WITH {DET_SQL}, seen AS (SELECT DISTINCT p.image_id, p.det_ord FROM det p JOIN det f ON f.image_id = p.image_id AND f.class_name = 'face' AND {containment_sql("p", "f")} >= 0.3 WHERE p.class_name = 'person'),
h AS (SELECT f.image_id, f.det_ord, min(p.det_ord) AS po FROM det f JOIN det p ON f.image_id = p.image_id AND p.class_name = 'person' AND {containment_sql("p", "f")} >= 0.3 WHERE f.class_name = 'face' GROUP BY ALL),
w AS (SELECT h.image_id, h.det_ord, {helmet} AS worn FROM h JOIN det p ON h.image_id = p.image_id AND h.po = p.det_ord)
SELECT d.image_id, d.det_ord, class_name, CASE class_name WHEN 'person' THEN '{{"face_visible":"' || (CASE WHEN seen.det_ord IS NULL THEN 'no' ELSE 'yes' END) || '","helmet":"' || ({helmet}) || '"}}'
WHEN 'face' THEN '{{"has_helmet":"' || coalesce(worn, 'no') || '"}}' WHEN 'text_or_logo' THEN '{{"content_type":"' || ({kind}) || '","is_logo":"' || ({logo}) || '","is_text":"yes"}}' ELSE '{{}}' END AS attributes
FROM det d LEFT JOIN seen ON d.image_id = seen.image_id AND d.det_ord = seen.det_ord LEFT JOIN w ON d.image_id = w.image_id AND d.det_ord = w.det_ord"""


@query(_enrichment_sql())
def enrichment(spark: SparkSession, d: str) -> DataFrame:
    det = detections(spark, d)
    phrase = F.when(F.col("class_name") == "text_or_logo", F.get(F.array(*map(F.lit, PHRASE_WORDS)), (F.col("part") % len(PHRASE_WORDS)).cast("int"))).otherwise("")
    helmet = F.when(F.col("class_name") == "person", F.create_map(F.lit("helmet"), F.when(F.col("part") % 3 == 0, "yes").otherwise("no"))).otherwise(F.create_map().cast("map<string,string>"))
    out = stages.enrich(det.withColumn("phrase", phrase).withColumn("attributes", helmet))
    return out.select("image_id", "det_ord", "class_name", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("attributes")))).alias("attributes"))


# those of files and complete stages join in
from sitelens.plans import more_queries  # noqa: E402, F401

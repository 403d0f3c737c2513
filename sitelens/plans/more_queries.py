"""Queries of single rules, of what goes through files, and of the complete annotation; they join those of ``registry``."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens import constants as C
from sitelens.fixtures import DET_SQL, HEIGHT, IMG_SQL, WIDTH, containment_sql, detections, images, table
from sitelens.functions import geometry as g
from sitelens.functions import kernels, names
from sitelens.operators import anonymise, attributes, detectors, evaluate, filters, quality, selection, tiles, zones
from sitelens.plans import registry, stages
from sitelens.plans.registry import BOX, BOX_SQL, BOXES_SQL, boxes, query, rounded
from sitelens.sources import files, formats, reports
from sitelens.sources import images as image_files

# --- single rules -------------------------------------------------------------------------------------------------------

_THIN = "thin AS (SELECT * EXCLUDE (x2, y2), x1 + (x2 - x1) / 16 AS x2, y1 + (y2 - y1) / 16 AS y2 FROM det)"


def _thin(spark: SparkSession, d: str) -> DataFrame:
    return detections(spark, d).withColumns({"x2": F.expr("x1 + (x2 - x1) / 16"), "y2": F.expr("y1 + (y2 - y1) / 16")})


@query(f"WITH {DET_SQL}, {_THIN} SELECT {BOXES_SQL} FROM thin WHERE x2 - x1 >= 5 AND y2 - y1 >= 5")
def filter_size(spark: SparkSession, d: str) -> DataFrame:
    return boxes(filters.filter_size(_thin(spark, d)))


@query(f"WITH {DET_SQL}, {_THIN} SELECT {BOXES_SQL} FROM thin WHERE x2 - x1 >= 7 AND y2 - y1 >= 11")
def minimum_crop(spark: SparkSession, d: str) -> DataFrame:
    return boxes(filters.minimum_crop(_thin(spark, d), 7, 11))


@query(f"WITH {DET_SQL} SELECT {BOXES_SQL} FROM det WHERE confidence >= 0.35::DOUBLE AND class_name IN ('person', 'vehicle')")
def filter_detector(spark: SparkSession, d: str) -> DataFrame:
    return boxes(filters.filter_detector(detections(spark, d), 0.35, ["person", "vehicle"]))


@query(f"WITH {registry._DIMS_SQL} SELECT image_id, width, height FROM dims WHERE width > 640 OR height > 640")
def needs_tiles(spark: SparkSession, d: str) -> DataFrame:
    return tiles.needs_tiles(registry._dims(spark, d))


@query(f"WITH {DET_SQL}, n AS (SELECT image_id, det_ord, (x1 + x2) / 2 / 1280 AS cx, (y1 + y2) / 2 / 720 AS cy, (x2 - x1) / 1280 AS w, (y2 - y1) / 720 AS h FROM det), b AS (SELECT image_id, det_ord, (cx - w / 2) * 1280 AS x1, (cy - h / 2) * 720 AS y1, (cx + w / 2) * 1280 AS x2, (cy + h / 2) * 720 AS y2 FROM n) SELECT image_id, det_ord, {BOX_SQL} FROM b")
def corners_of_centres(spark: SparkSession, d: str) -> DataFrame:
    w, h = F.lit(WIDTH), F.lit(HEIGHT)
    return rounded(detections(spark, d).select("image_id", "det_ord", *g.from_normalised(*g.normalised(g.box(), w, h), w, h).columns()), *BOX)


@query(f"WITH {DET_SQL} SELECT row_number() OVER (ORDER BY image_id, det_ord) AS id, image_id, class_id AS category_id, 0 AS points FROM det")
def coco_annotations_of_classes(spark: SparkSession, d: str) -> DataFrame:
    return formats.coco_annotations(detections(spark, d), one_based=False, segmentation=True).select("id", "image_id", "category_id", F.size("segmentation").alias("points"))


@query(f"SELECT CAST(unnest(range(1, 9)) AS INTEGER) AS id, unnest({[*C.CLASS_NAMES]}) AS name, 'none' AS supercategory")
def categories(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(c["id"], c["name"], c["supercategory"]) for c in formats.categories()], "id int, name string, supercategory string")


@query(f"WITH {registry._DIMS_SQL} SELECT image_id, CAST(trunc(width * 0.0625::DOUBLE) AS INTEGER) AS cx1, CAST(trunc(height * 0.25::DOUBLE) AS INTEGER) AS cy1, width - CAST(trunc(width * 0.375::DOUBLE) AS INTEGER) AS cx2, height - CAST(trunc(height * 0.125::DOUBLE) AS INTEGER) AS cy2 FROM dims")
def zone_margin_crop(spark: SparkSession, d: str) -> DataFrame:
    cut = zones.crop_margins(F.col("width"), F.col("height"), F.lit(0.25), F.lit(0.125), F.lit(0.0625), F.lit(0.375))
    return registry._dims(spark, d).select("image_id", *(c.alias(n) for n, c in cut.items()))


@query(registry._gated_sql("lenient") + " SELECT path, round_even(brightness, 1) AS brightness, round_even(contrast, 1) AS contrast, round_even(sharpness, 1) AS sharpness, round_even(edge_density, 4) AS edge_density FROM gated WHERE reason = ''")
def accepted_index(spark: SparkSession, d: str) -> DataFrame:
    return reports.accepted_index(quality.quality_gate(images(spark, d), "lenient"))


@query(f"WITH {DET_SQL} SELECT image_id, det_ord, '{{\"color\":\"' || (CASE WHEN part % 2 = 0 THEN 'red' ELSE 'unspecified' END) || '\",\"posture\":\"unspecified\"}}' AS attributes FROM det")
def attribute_defaults(spark: SparkSession, d: str) -> DataFrame:
    have = F.when(F.col("part") % 2 == 0, F.create_map(F.lit("color"), F.lit("red")))
    filled = attributes.with_defaults(have, ["posture", "color"])
    return detections(spark, d).select("image_id", "det_ord", F.to_json(F.map_from_entries(F.array_sort(F.map_entries(filled)))).alias("attributes"))


@query(f"WITH {DET_SQL}, m AS (SELECT *, CASE model WHEN 'yolo_coco' THEN 0 WHEN 'grounding_dino' THEN 1 ELSE 2 END AS o FROM det) SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY o, det_ord) AS INTEGER) AS det_ord, model, part FROM m")
def ensemble(spark: SparkSession, d: str) -> DataFrame:
    det = detections(spark, d)
    return detectors.ensemble(*(detectors.table_detector(det.select("image_id").distinct(), det.where(F.col("model") == m), 0.0) for m in ("yolo_coco", "grounding_dino", "yolo_world"))).select("image_id", "det_ord", "model", "part")


@query(f"WITH {DET_SQL}, c AS (SELECT image_id, CAST(count(*) FILTER (class_name = 'person') AS INTEGER) AS p, CAST(count(*) FILTER (class_name = 'vehicle') AS INTEGER) AS v FROM det GROUP BY ALL) SELECT event_id AS image_id, coalesce(p, 0) AS person_count, coalesce(v, 0) AS vehicle_count FROM events LEFT JOIN c ON event_id = image_id WHERE event_id % 97 <> 13")
def score_images(spark: SparkSession, d: str) -> DataFrame:
    ims = images(spark, d).select("image_id", F.when(~F.col("unreadable"), F.lit(b"x")).alias("data"))
    return selection.score_images(ims, detections(spark, d)).select("image_id", "person_count", "vehicle_count")


@query(f"WITH {registry._plan_sql()} SELECT DISTINCT image_id, det_ord FROM plan")
def drawn(spark: SparkSession, d: str) -> DataFrame:
    det = detections(spark, d)
    return anonymise.drawn(det, anonymise.blur_plan(det, 700, 600)).select("image_id", "det_ord")


@query(f"WITH {DET_SQL} SELECT image_id, det_ord FROM det WHERE class_name = 'text_or_logo' AND confidence >= 0.35::DOUBLE AND part % 3 <> 0")
def needs_reading(spark: SparkSession, d: str) -> DataFrame:
    known = F.when(F.col("part") % 3 == 0, F.create_map(F.lit("is_text"), F.lit("yes"))).when(F.col("part") % 3 == 1, F.create_map(F.lit("is_text"), F.lit("unspecified")))
    return attributes.needs_reading(detections(spark, d).withColumn("attributes", known)).select("image_id", "det_ord")


@query(f"""WITH {registry._MATCH_SQL}, c AS (SELECT class_id, count(*) FILTER (tp) AS tp FROM m GROUP BY class_id), n AS (SELECT class_id, class_name, count(*) AS n FROM det WHERE model = 'yolo_coco' GROUP BY ALL)
SELECT class_name, round(tp / n, 6) AS recall, CASE class_name WHEN 'face' THEN 0.5::DOUBLE ELSE 0.7::DOUBLE END AS floor FROM c JOIN n USING (class_id) WHERE (class_name = 'face' AND tp / n < 0.5) OR (class_name = 'person' AND tp / n < 0.7)""")
def recall_warnings(spark: SparkSession, d: str) -> DataFrame:
    p, t = registry._sides(spark, d)
    recalls = evaluate.evaluation(p, t).select(names.class_name(F.col("class_id")).alias("class_name"), "recall")
    return rounded(evaluate.recall_warnings(recalls), "recall")


# --- pixels -------------------------------------------------------------------------------------------------------------

_PIXEL = "CAST(floor((x + 1) * 100) AS INTEGER)"
_NEXT = {"up": "CASE WHEN i < 8 THEN i + 8 ELSE i - 8 END", "down": "CASE WHEN i >= 56 THEN i - 8 ELSE i + 8 END", "left": "CASE WHEN i % 8 = 0 THEN i + 1 ELSE i - 1 END", "right": "CASE WHEN i % 8 = 7 THEN i - 1 ELSE i + 1 END"}


def _color_images(spark: SparkSession, d: str) -> DataFrame:
    """8 x 8 pixels of three channels from each embedding: v, 3 v and 7 v, modulo 256."""
    v = "cast(floor((cast(x as double) + 1) * 100) as int)"
    data = F.expr(f"unhex(array_join(transform(embedding, x -> concat(lpad(hex({v} % 256), 2, '0'), lpad(hex({v} * 3 % 256), 2, '0'), lpad(hex({v} * 7 % 256), 2, '0'))), ''))")
    return table(spark, d, "embeddings").select(F.concat(F.lit("img_"), "vec_id").alias("path"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(3).alias("n_channels"), data.alias("data"))


@query(f"""WITH p AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: {_PIXEL}) AS v FROM embeddings),
q AS (SELECT vec_id, list_transform(v, lambda x: greatest(x % 256, x * 3 % 256, x * 7 % 256)) AS m, list_transform(v, lambda x: CAST((x % 256 * 1868 + x * 3 % 256 * 9617 + x * 7 % 256 * 4899 + 8192) // 16384 AS DOUBLE)) AS y FROM p),
l AS (SELECT vec_id, m, y, list_transform(range(64), lambda i: y[({_NEXT["up"]}) + 1] + y[({_NEXT["down"]}) + 1] + y[({_NEXT["left"]}) + 1] + y[({_NEXT["right"]}) + 1] - 4 * y[i + 1]) AS z FROM q)
SELECT 'img_' || vec_id AS path, round(list_avg(m), 6) AS brightness, round(list_stddev_pop(y), 6) AS contrast, floor((list_var_pop(z) + 1e-6) * 100) / 100 AS sharpness FROM l""")
def color_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = kernels.measure(_color_images(spark, d))
    return out.select("path", F.round("brightness", 6).alias("brightness"), F.round("contrast", 6).alias("contrast"), (F.floor((F.col("sharpness") + 1e-6) * 100) / 100).alias("sharpness"))


@query("SELECT 'img_' || vec_id AS path, 9 AS dark, 24 AS bytes FROM embeddings")
def rendered_images(spark: SparkSession, d: str) -> DataFrame:
    """A rectangle of nine pixels made black in each image, written as PNG and read back by Spark."""
    ims = _color_images(spark, d).withColumn("data", F.expr("unhex(repeat('C8', 192))"))
    plan = ims.select("path", F.lit(1).alias("seq"), F.lit(2.0).alias("x1"), F.lit(2.5).alias("y1"), F.lit(5.9).alias("x2"), F.lit(5.0).alias("y2"), F.lit(3).alias("kernel"))
    folder = files.scratch(spark, "rendered")
    formats.write_files(kernels.render(ims, plan, method="black").select(F.col("path").alias("stem"), "content"), folder, ".png")
    back = image_files.read_images(spark, folder).withColumn("h", F.hex("data"))
    dark = (F.length("h") - F.length(F.regexp_replace("h", "(?<=^(?:......){0,63})000000", ""))) / 6
    return back.select(names.stem(F.col("path")).alias("path"), dark.cast("int").alias("dark"), (F.col("width") * F.col("n_channels")).alias("bytes"))


# --- files --------------------------------------------------------------------------------------------------------------

_EXT = "(['.jpg','.PNG','.jpeg','.txt','.Bmp'])[vec_id % 5 + 1]"


def _image_files(spark: SparkSession, d: str) -> str:
    """Files named by the vectors' ids, with five extensions, in two folders."""
    folder = files.scratch(spark, "listing")
    ext = F.get(F.array(*map(F.lit, [".jpg", ".PNG", ".jpeg", ".txt", ".Bmp"])), (F.col("vec_id") % 5).cast("int"))
    rows = table(spark, d, "embeddings").select(F.concat(F.when(F.col("vec_id") % 2 == 0, "sub/").otherwise(""), F.lit("img_"), "vec_id", ext).alias("stem"), F.lit("x").alias("content"))
    formats.write_files(rows, folder, "")
    return folder


@query(f"SELECT 'img_' || vec_id || {_EXT} AS name FROM embeddings WHERE vec_id % 5 IN (0, 1, 2)")
def listed_images(spark: SparkSession, d: str) -> DataFrame:
    return image_files.list_images(spark, _image_files(spark, d)).select(names.file_name(F.col("path")).alias("name"))


@query(f"SELECT 'img_' || vec_id || {_EXT} AS name FROM embeddings WHERE vec_id % 5 <> 3 AND vec_id % 2 = 1")
def listed_annotated(spark: SparkSession, d: str) -> DataFrame:
    return image_files.list_annotated(spark, _image_files(spark, d)).select(names.file_name(F.col("path")).alias("name"))


@query(f"SELECT 'img_' || vec_id || {_EXT} AS name FROM embeddings WHERE vec_id % 5 = 0 AND vec_id % 2 = 1")
def listed_by_glob(spark: SparkSession, d: str) -> DataFrame:
    return image_files.list_by_glob(spark, _image_files(spark, d)).select(names.file_name(F.col("path")).alias("name"))


@query(f"SELECT name FROM (SELECT CASE WHEN vec_id % 2 = 0 THEN 'sub/' ELSE '' END AS dir, 'img_' || vec_id || {_EXT} AS name FROM embeddings WHERE vec_id % 5 IN (0, 1, 2)) ORDER BY dir || name LIMIT 50")
def first_listed(spark: SparkSession, d: str) -> DataFrame:
    return image_files.first_images(image_files.list_images(spark, _image_files(spark, d)), 50).select(names.file_name(F.col("path")).alias("name"))


@query("SELECT 'img_' || vec_id AS stem, 8 AS width, 8 AS height, CAST(floor((CAST(embedding[1] AS DOUBLE) + 1) * 100) AS INTEGER) % 256 AS blue FROM embeddings")
def decoded_images(spark: SparkSession, d: str) -> DataFrame:
    """Pixels written as PNG and decoded by Spark: size and the first byte."""
    ims = _color_images(spark, d)
    none = spark.createDataFrame([], "path string, seq int, x1 double, y1 double, x2 double, y2 double, kernel int")
    folder = files.scratch(spark, "pixels")
    formats.write_files(kernels.render(ims, none).select(F.col("path").alias("stem"), "content"), folder, ".png")
    back = image_files.read_images(spark, folder)
    sizes = image_files.image_dimensions(back).withColumnRenamed("path", "_path")
    return back.select("path", F.conv(F.hex(F.substring("data", 1, 1)), 16, 10).cast("int").alias("blue")).join(sizes, F.col("path") == F.col("_path")).select(names.stem(F.col("path")).alias("stem"), "width", "height", "blue")


@query(f"WITH {DET_SQL}, b AS (SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY det_ord) - 1 AS INTEGER) AS line_ord, class_id, (x1 + x2) / 2 / 1280 AS cx, (y1 + y2) / 2 / 720 AS cy, (x2 - x1) / 1280 AS w, (y2 - y1) / 720 AS h FROM det) SELECT 'img_' || image_id AS stem, line_ord, class_id, round(cx, 4) AS cx, round(cy, 4) AS cy, round(w, 4) AS w, round(h, 4) AS h FROM b")
def yolo_files_read(spark: SparkSession, d: str) -> DataFrame:
    """Label files written, one an image, and read back."""
    lines = formats.yolo_lines(detections(spark, d), F.lit(WIDTH), F.lit(HEIGHT)).withColumn("stem", F.concat(F.lit("img_"), "image_id"))
    folder = files.scratch(spark, "labels")
    formats.write_files(formats.yolo_files(lines), folder)
    return formats.read_yolo(spark, folder).select("stem", "line_ord", "class_id", *(F.round(c, 4).alias(c) for c in ("cx", "cy", "w", "h")))


def _label_files(spark: SparkSession, d: str) -> str:
    """Labels of all vectors in one folder, and of some again in a folder that comes later; some are empty."""
    folder = files.scratch(spark, "walk")
    rows = table(spark, d, "embeddings").select(F.concat(F.lit("img_"), "vec_id").alias("s"), F.when(F.col("vec_id") % 4 == 0, "").otherwise("1 0.5 0.5 0.1 0.1\n").alias("content"), "vec_id")
    again = rows.where("vec_id % 3 = 0").select(F.concat(F.lit("z/"), "s").alias("stem"), F.lit("2 0.5 0.5 0.1 0.1\n").alias("content"))
    formats.write_files(rows.select(F.concat(F.lit("a/"), "s").alias("stem"), "content").unionByName(again), folder)
    return folder


@query("SELECT 'img_' || vec_id AS stem, CASE WHEN vec_id % 3 = 0 THEN 'z' ELSE 'a' END AS folder, vec_id % 3 <> 0 AND vec_id % 4 = 0 AS empty FROM embeddings")
def label_files_found(spark: SparkSession, d: str) -> DataFrame:
    found = formats.find_label_files(spark, _label_files(spark, d))
    return found.select("stem", F.element_at(F.split("label_path", "/"), -2).alias("folder"), "empty")


@query("SELECT 'img_' || vec_id AS stem FROM embeddings")
def label_files_by_glob(spark: SparkSession, d: str) -> DataFrame:
    return formats.labels_by_glob(spark, f"{_label_files(spark, d)}/a").select("stem")


@query(registry._gated_sql("strict") + " SELECT path FROM gated WHERE reason = ''")
def index_read(spark: SparkSession, d: str) -> DataFrame:
    """The accepted images' index, written as CSV and read back."""
    folder = files.scratch(spark, "index")
    reports.write_prefilter(quality.quality_gate(images(spark, d)), folder)
    return image_files.read_index(spark, f"{folder}/accepted_images.csv")


@query(registry._gated_sql("strict") + ", r AS (SELECT unnest(string_split(reason, ';')) AS what FROM gated WHERE reason <> '') SELECT (SELECT count(*) FROM gated) AS total, (SELECT count(*) FROM gated WHERE reason = '') AS accepted, " + ", ".join(f"(SELECT count(*) FROM r WHERE what = '{w}') AS {w}" for w in reports.REASONS) + ", 50.0::DOUBLE AS min_brightness, true AS told")
def prefilter_stats(spark: SparkSession, d: str) -> DataFrame:
    counts = quality.rejection_counts(quality.quality_gate(images(spark, d)))
    said = reports.prefilter_stats(counts, C.QUALITY_PROFILES["strict"], "out", "2024-01-01T00:00:00")
    get = lambda path, kind: F.get_json_object("value", f"$.{path}").cast(kind)
    told = (get("timestamp", "string") == "2024-01-01T00:00:00") & (get("output_files.rejected_index", "string") == "out/rejected_images.csv")
    return said.select(*(get(f"stats.{k}", "long").alias(k) for k in ("total", "accepted")), *(get(f"stats.rejected_{k}", "long").alias(k) for k in reports.REASONS), get("config.min_brightness", "double").alias("min_brightness"), told.alias("told"))


@query(f"WITH {DET_SQL}, c AS (SELECT class_name, count(*) AS n FROM det GROUP BY ALL) SELECT class_name, n, (SELECT count(*) FROM det) AS total_detections, (SELECT count(DISTINCT image_id) FROM det) AS total_images, 'a+b' AS models FROM c")
def annotation_stats(spark: SparkSession, d: str) -> DataFrame:
    det = detections(spark, d)
    said = formats.annotation_stats(det, det.select("image_id").distinct(), ["a", "b"], "t")
    parsed = said.select(F.from_json("value", "total_images long, total_detections long, detections_per_class map<string,long>, models_used array<string>, timestamp string").alias("s"))
    return parsed.select(F.explode("s.detections_per_class").alias("class_name", "n"), "s.total_detections", "s.total_images", F.array_join("s.models_used", "+").alias("models"))


@query(f"""WITH {registry._MATCH_SQL}, c AS (SELECT class_id, count(*) FILTER (tp) AS tp FROM m GROUP BY class_id), n AS (SELECT class_id, class_name, count(*) AS n FROM det WHERE model = 'yolo_coco' GROUP BY ALL), r AS (SELECT class_name, tp / n AS r FROM c JOIN n USING (class_id)),
s AS (SELECT round(sum(CASE class_name WHEN 'face' THEN 0.4 WHEN 'person' THEN 0.3 WHEN 'vehicle' THEN 0.1 WHEN 'text_or_logo' THEN 0.1 ELSE 0 END * r) + 0.1 * avg(r) FILTER (class_name NOT IN ('face', 'person', 'vehicle', 'text_or_logo')), 6) AS privacy_score FROM r)
SELECT class_name, round(r, 6) AS recall, privacy_score, privacy_score >= 0.8 AS met, (SELECT round(avg(r), 6) FROM r) AS overall FROM r, s""")
def evaluation_json(spark: SparkSession, d: str) -> DataFrame:
    said = reports.evaluation_json(stages.evaluate_detections(*registry._sides(spark, d)), {"model": "m", "dataset": "d"}, "t")
    parsed = said.select(F.from_json("value", "privacy_score double, privacy_target_met boolean, overall struct<recall:double>, per_class map<string,struct<recall:double>>").alias("s"))
    rows = parsed.select(F.explode("s.per_class").alias("class_name", "m"), "s.privacy_score", F.col("s.privacy_target_met").alias("met"), F.col("s.overall.recall").alias("overall"))
    return rounded(rows.select("class_name", F.col("m.recall").alias("recall"), "privacy_score", "met", "overall"), "recall", "privacy_score", "overall")


_ZONES = {"setup_1": {"description": "d", "zones": [{"name": "sky", "polygon": "full_width_top_20"}, {"name": "p", "polygon": [[0, 0], [10, 0], [0, 10]]}]}, "setup_2": {"description": "", "zones": [{"name": "f", "polygon": [1, 2, 3, 4, 5, 6]}]}}


@query("SELECT * FROM (VALUES ('setup_1', 'sky', 'full_width_top_20', NULL), ('setup_1', 'p', NULL, '0,0 10,0 0,10'), ('setup_2', 'f', NULL, '1,2 3,4 5,6')) t(setup, zone_name, shorthand, points)")
def zone_file(spark: SparkSession, d: str) -> DataFrame:
    """A zone file read back; a missing one has no zones."""
    path = f"{files.scratch(spark, 'zones')}/zones.json"
    files.write_bytes(path, json.dumps(_ZONES).encode())
    z = zones.read_zones(spark, path).unionByName(zones.read_zones(spark, path + ".none"))
    points = F.array_join(F.transform(zones.explicit_polygon(F.col("polygon")), lambda p: F.concat(p["x"].cast("string"), F.lit(","), p["y"].cast("string"))), " ")
    return z.select("setup", "zone_name", zones.shorthand_of(F.col("polygon")).alias("shorthand"), points.alias("points"))


@query("SELECT * FROM (VALUES ('setup_9', 0.5::DOUBLE, 0.0::DOUBLE, 0.1::DOUBLE, 'file'), ('setup_1', 0.25::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 'none'), ('setup_2', 0.25::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 'none')) t(setup, top_pct, right_pct, bottom_pct, origin)")
def exclusion_file(spark: SparkSession, d: str) -> DataFrame:
    path = f"{files.scratch(spark, 'exclusions')}/zones.json"
    files.write_bytes(path, json.dumps({"setup_9": {"top_pct": 0.5, "bottom_pct": 0.1}}).encode())
    return zones.read_exclusions(spark, path).withColumn("origin", F.lit("file")).unionByName(zones.read_exclusions(spark, path + ".none").withColumn("origin", F.lit("none")))


_TAXONOMY = {"classes": [{"id": 0, "name": "face", "privacy_sensitive": True, "color": "#ff0000", "attributes": {"visibility": {"type": "select", "values": ["clear", "partial"], "default": "clear"}}}, {"id": 4, "name": "crane", "privacy_sensitive": False, "color": "#00ff00", "attributes": {}}]}


@query("SELECT * FROM (VALUES (0, 'face', true, 'visibility', 'clear|partial', 'clear'), (4, 'crane', false, NULL, NULL, NULL)) t(class_id, class_name, privacy_sensitive, attribute, allowed, default_value)")
def taxonomy(spark: SparkSession, d: str) -> DataFrame:
    path = f"{files.scratch(spark, 'taxonomy')}/taxonomy.json"
    files.write_bytes(path, json.dumps(_TAXONOMY).encode())
    rows = formats.read_taxonomy(spark, path)
    return rows.select("class_id", "class_name", "privacy_sensitive", "attribute", F.array_join("values", "|").alias("allowed"), F.col("default").alias("default_value"))


@query("SELECT * FROM (VALUES ('face', '#ff0000', 1, 'visibility', 'clear'), ('crane', '#00ff00', 0, NULL, NULL)) t(name, color, attributes, attribute, default_value)")
def label_editor(spark: SparkSession, d: str) -> DataFrame:
    path = f"{files.scratch(spark, 'editor')}/taxonomy.json"
    files.write_bytes(path, json.dumps(_TAXONOMY).encode())
    said = formats.label_editor(formats.read_taxonomy(spark, path))
    kind = "array<struct<name:string,color:string,attributes:array<struct<name:string,default_value:string,values:array<string>>>>>"
    rows = said.select(F.inline(F.from_json("json", kind)))
    return rows.select("name", "color", F.size("attributes").alias("attributes"), F.get("attributes.name", F.lit(0)).alias("attribute"), F.get("attributes.default_value", F.lit(0)).alias("default_value"))


@query("SELECT * FROM (VALUES ('wbf', false, 3), ('default', true, 3)) t(origin, wbf, models)")
def configuration(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of a file take the place of the default ones; the default file reads back as the defaults."""
    folder = files.scratch(spark, "config")
    files.write_bytes(f"{folder}/own.yaml", b"wbf:\n  enabled: false\n")
    formats.write_default_config(f"{folder}/default.yaml")
    rows = [("wbf", formats.load_config(f"{folder}/own.yaml")), ("default", formats.load_config(f"{folder}/default.yaml"))]
    return spark.createDataFrame([(k, c["wbf"]["enabled"], len(c["models"])) for k, c in rows], "origin string, wbf boolean, models int")


@query("""WITH s AS (SELECT vec_id, 'img_' || vec_id AS stem, label % 8 AS class_id FROM embeddings), r AS (SELECT *, row_number() OVER (ORDER BY md5(stem || '|42'), stem) AS n, count(*) OVER () AS t FROM s)
SELECT CASE WHEN n <= floor(t * (1 - 0.2::DOUBLE)) THEN 'train' ELSE 'val' END AS split, class_id, count(*) AS n FROM r GROUP BY ALL""")
def training_tree(spark: SparkSession, d: str) -> DataFrame:
    """Images and labels split, copied as a training set and read back by its dataset.yaml."""
    folder = files.scratch(spark, "training")
    e = table(spark, d, "embeddings").select(F.concat(F.lit("img_"), "vec_id").alias("stem"), (F.col("label") % 8).alias("c"))
    formats.write_files(e.select("stem", F.lit("x").alias("content")), f"{folder}/in/images", ".jpg")
    formats.write_files(e.select("stem", F.format_string("%d 0.5 0.5 0.1 0.1\n", "c").alias("content")), f"{folder}/in/labels", ".txt")
    stages.prepare_training(f"{folder}/in/labels", f"{folder}/in/images", f"{folder}/out", spark)
    parts = []
    for part in ("train", "val"):
        listed, boxes_, _ = formats.read_dataset(spark, f"{folder}/out/dataset.yaml", part)
        parts.append(boxes_.join(listed, "stem").select(F.lit(part).alias("split"), "class_id"))
    return parts[0].unionByName(parts[1]).groupBy("split", "class_id").agg(F.count(F.lit(1)).alias("n"))


# --- complete stages ----------------------------------------------------------------------------------------------------

_GEAR, _LABELS = ["hard hat", "vest", "gloves"], ["car", "truck", "construction", "standing"]


def _answers(det: DataFrame) -> dict[str, DataFrame]:
    """What the models would say, from the detections' numbers."""
    keys = ["image_id", "det_ord"]
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("part") % len(values)).cast("int"))
    asked = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("label")) for k, v in (("posture", pick(["standing", "walking"])), ("vehicle_type", pick(["car", "truck", "excavator"])), ("content_type", pick(["company_name", "license_plate"]))))))
    return {
        "labels": det.where("supp % 4 != 0").select(*keys, asked.alias("x")).select(*keys, "x.*"),
        "gear": det.where("class_name = 'person'").select(*keys, pick(_GEAR).alias("name")),
        "readings": det.where("class_name = 'text_or_logo'").select(*keys, (F.col("part") % 10 / 10.0).alias("score"), F.when(F.col("part") % 11 == 0, "failed").alias("error")),
        "verdicts": det.select(*keys, F.when(F.col("part") % 7 == 0, "negative").otherwise("positive").alias("label")),
        "found_faces": det.where("class_name = 'person' and supp % 3 = 0").select("image_id", F.col("det_ord").alias("person_ord"), F.lit(1).alias("det_ord"), F.lit(1.0).alias("x1"), F.lit(2.0).alias("y1"), F.lit(11.0).alias("x2"), F.lit(14.0).alias("y2"), F.col("confidence")),
        "seen_faces": det.where("class_name = 'person' and supp % 3 = 1").select(*keys, F.lit("face_visible").alias("label")),
        "found_plates": det.where("class_name = 'vehicle' and supp % 2 = 0").select(*keys),
    }


def _complete_sql() -> str:
    helmet = "CASE part % 3 WHEN 0 THEN 'yes' ELSE 'no' END"
    vest = "CASE part % 3 WHEN 1 THEN 'yes' ELSE 'no' END"
    label = lambda values: f"CASE WHEN supp % 4 <> 0 THEN ({values})[part % {len(values)} + 1] ELSE 'unspecified' END"
    kind = label(["company_name", "license_plate"])
    text = "CASE WHEN confidence >= 0.35::DOUBLE AND part % 11 <> 0 THEN (CASE WHEN part % 10 / 10.0::DOUBLE > 0.3 THEN 'yes' ELSE 'no' END) ELSE 'unspecified' END"
    return f"""WITH {DET_SQL}, k AS (SELECT * FROM det WHERE NOT (class_name IN ('vehicle', 'material_stack', 'text_or_logo', 'container') AND part % 7 = 0)),
seen AS (SELECT DISTINCT p.image_id, p.det_ord FROM k p JOIN k f ON f.image_id = p.image_id AND f.class_name = 'face' AND {containment_sql("p", "f")} >= 0.3 WHERE p.class_name = 'person'),
h AS (SELECT f.image_id, f.det_ord, min(p.det_ord) AS po FROM k f JOIN k p ON f.image_id = p.image_id AND p.class_name = 'person' AND {containment_sql("p", "f")} >= 0.3 WHERE f.class_name = 'face' GROUP BY ALL),
e AS (SELECT k.*, CASE WHEN seen.det_ord IS NULL THEN 'no' ELSE 'yes' END AS visible, {text} AS it, {kind} AS ct FROM k LEFT JOIN seen ON k.image_id = seen.image_id AND k.det_ord = seen.det_ord),
own AS (SELECT e.image_id, e.det_ord, class_name, x1, y1, x2, y2, confidence, CASE class_name
  WHEN 'person' THEN '{{"face_visible":"' || visible || '","helmet":"' || ({helmet}) || '","posture":"' || ({label(["standing", "walking"])}) || '","safety_vest":"' || ({vest}) || '"}}'
  WHEN 'vehicle' THEN '{{"ownership":"unspecified","vehicle_type":"' || ({label(["car", "truck", "excavator"])}) || '"}}'
  WHEN 'text_or_logo' THEN '{{"content_type":"' || ct || '","is_logo":"' || (CASE WHEN ct = 'company_name' THEN 'yes' WHEN it = 'yes' THEN 'no' ELSE 'unspecified' END) || '","is_text":"' || it || '"}}'
  WHEN 'face' THEN '{{"has_helmet":"no","visibility":"unspecified"}}' ELSE '{{}}' END AS attributes FROM e),
able AS (SELECT * FROM e WHERE class_name = 'person' AND visible = 'no' AND least(1280, trunc(x2)) - greatest(0, trunc(x1)) >= 10 AND least(720, trunc(y1 + (y2 - y1) * 0.35::DOUBLE)) - greatest(0, trunc(y1)) >= 10),
faces AS (SELECT image_id, 1 AS kind, det_ord AS o, x1 + 1 AS x1, y1 + 2 AS y1, x1 + 11 AS x2, y1 + 14 AS y2, confidence, '{{"has_helmet":"unspecified","visibility":"' || (CASE WHEN confidence >= 0.15 THEN 'clear' WHEN confidence >= 0.08 THEN 'partial' ELSE 'occluded' END) || '"}}' AS attributes FROM able WHERE supp % 3 = 0
  UNION ALL SELECT image_id, 1, det_ord, x1, y1, x2, y1 + (y2 - y1) * 0.25::DOUBLE, 0.20::DOUBLE, '{{"has_helmet":"unspecified","visibility":"partial"}}' FROM able WHERE supp % 3 = 1),
plates AS (SELECT v.image_id, 2 AS kind, v.det_ord AS o, v.x1, v.y1 + (v.y2 - v.y1) * 0.5::DOUBLE AS y1, v.x2, v.y2, 0.30::DOUBLE AS confidence, '{{"content_type":"license_plate","is_logo":"no","is_text":"yes"}}' AS attributes FROM k v WHERE class_name = 'vehicle' AND supp % 2 = 0
  AND NOT EXISTS (SELECT 1 FROM k t WHERE t.image_id = v.image_id AND t.class_name = 'text_or_logo' AND {containment_sql("v", "t")} >= 0.3) AND least(1280, trunc(x2)) - greatest(0, trunc(x1)) >= 20 AND least(720, trunc(y2)) - greatest(0, trunc(v.y1 + (v.y2 - v.y1) * 0.5::DOUBLE)) >= 10),
more AS (SELECT * FROM faces UNION ALL SELECT * FROM plates), last AS (SELECT image_id, max(det_ord) AS m FROM own GROUP BY ALL),
every AS (SELECT * FROM own UNION ALL SELECT more.image_id, CAST(m + row_number() OVER (PARTITION BY more.image_id ORDER BY kind, o) AS INTEGER), CASE kind WHEN 1 THEN 'face' ELSE 'text_or_logo' END, x1, y1, x2, y2, confidence, attributes FROM more JOIN last ON more.image_id = last.image_id)
SELECT {BOXES_SQL}, attributes FROM every"""


@query(_complete_sql())
def annotation_complete(spark: SparkSession, d: str) -> DataFrame:
    """Verification, gear, classified attributes, OCR, logos, rescued faces and plates, defaults."""
    det = detections(spark, d).withColumns({"phrase": F.lit(""), "attributes": F.create_map().cast("map<string,string>")})
    out = stages.enrich_all(det, WIDTH, HEIGHT, **_answers(det))
    return boxes(out, F.to_json(F.map_from_entries(F.array_sort(F.map_entries("attributes")))).alias("attributes"))

"""Annotation formats: COCO documents and YOLO label files, read and written; training configuration."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from sitelens.constants import CLASS_NAMES
from sitelens.functions.geometry import Box, box, from_coco, normalised, yolo_line
from sitelens.functions.names import stem
from sitelens.schemas import COCO, TAXONOMY
from sitelens.sources.files import copy_files, exists, list_files, read_text, there, write_bytes


# --- YOLO -----------------------------------------------------------------------------------------------------------


def yolo_lines(dets: DataFrame, width: Column, height: Column, clamp: bool = False) -> DataFrame:
    return dets.withColumn("line", yolo_line(F.col("class_id"), normalised(box(), width, height, clamp)))


def yolo_files(lines: DataFrame, images: DataFrame | None = None, newline: bool = True) -> DataFrame:
    """``stem``, ``content`` of each label file, lines by det_ord; images without boxes get an empty file.

    ``newline``: each line ends in one; else lines are joined by one.
    """
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("det_ord", "line"))), lambda x: x["line"])
    text = F.array_join(ordered, "\n")
    files = lines.groupBy("stem").agg(F.concat(text, F.lit("\n" if newline else "")).alias("content"))
    if images is None:
        return files
    return images.select("stem").distinct().join(files, "stem", "left").select("stem", F.coalesce("content", F.lit("")).alias("content"))


def labels_by_glob(spark: SparkSession, folder: str) -> DataFrame:
    """``stem``, ``label_path`` of the label files in one folder, by path."""
    inside = ~F.substring_index("path", folder.rstrip("/") + "/", -1).contains("/")
    return list_files(spark, folder, ".txt").where(inside).select(stem(F.col("path")).alias("stem"), F.col("path").alias("label_path")).orderBy("label_path")


def read_yolo(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """``stem``, ``line_ord``, ``class_id``, ``cx``, ``cy``, ``w``, ``h`` of label files; blank lines are left out."""
    files = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.txt").text(folder, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    lines = files.select(stem(F.col("path")).alias("stem"), F.posexplode(F.split("value", r"\r?\n")).alias("line_ord", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    p = F.split("line", r"\s+")
    return lines.select("stem", "line_ord", F.get(p, F.lit(0)).try_cast("int").alias("class_id"), *(F.get(p, F.lit(i + 1)).try_cast("double").alias(n) for i, n in enumerate(("cx", "cy", "w", "h"))))


def find_label_files(spark: SparkSession, folder: str) -> DataFrame:
    """``stem``, ``label_path``, ``empty``: of label files with one stem the last by path."""
    files = list_files(spark, folder, ".txt").groupBy(stem(F.col("path")).alias("stem")).agg(F.max(F.struct("path", "length")).alias("f"))
    return files.select("stem", F.col("f.path").alias("label_path"), (F.col("f.length") == 0).alias("empty"))


@dataclass
class _Written(WriterCommitMessage):
    files: int


class _FileWriter(DataSourceWriter):
    def __init__(self, folder: str, suffix: str):
        self.folder, self.suffix = folder.rstrip("/"), suffix

    def write(self, rows: Iterator) -> WriterCommitMessage:
        n = 0
        for row in rows:
            data = row["content"]
            write_bytes(f"{self.folder}/{row['stem']}{self.suffix}", data if isinstance(data, bytes | bytearray) else (data or "").encode())
            n += 1
        return _Written(n)


class FilePerRow(DataSource):
    """A sink for ``stem``, ``content`` rows: one file a row, rewritten as the same bytes when a task runs again.

    Options: ``path``, ``suffix`` (``.txt``). Register with ``spark.dataSource.register(FilePerRow)``.
    """

    @classmethod
    def name(cls) -> str:
        return "file_per_row"

    def schema(self) -> str:
        return "stem string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _FileWriter(self.options["path"], self.options.get("suffix", ".txt"))


def write_files(files: DataFrame, folder: str, suffix: str = ".txt") -> None:
    files.sparkSession.dataSource.register(FilePerRow)
    files.select("stem", "content").write.format("file_per_row").option("suffix", suffix).mode("append").save(folder)


# --- COCO -----------------------------------------------------------------------------------------------------------


def coco_annotations(dets: DataFrame, one_based: bool = True, segmentation: bool = False) -> DataFrame:
    """COCO annotation rows. Ids follow (image_id, det_ord): counts of earlier images from a table of images, then the place in the image."""
    b = box()
    fused = F.col("num_fused") if "num_fused" in dets.columns else F.lit(1)
    per_image = F.row_number().over(_by_image())
    rows = dets.withColumn("_n", per_image)
    counts = dets.groupBy("image_id").agg(F.count(F.lit(1)).alias("_c"))
    before = _running(counts)
    rows = rows.join(before, "image_id")
    out = rows.select(
        (F.col("_before") + F.col("_n")).alias("id"), "image_id", (F.col("class_id") + int(one_based)).alias("category_id"),
        F.array(b.x1, b.y1, b.width, b.height).alias("bbox"), b.area.alias("area"), F.lit(0).alias("iscrowd"), "confidence", F.col("model").alias("source"), fused.alias("num_fused"),
    )
    return out.withColumn("segmentation", F.expr("cast(array() as array<double>)")) if segmentation else out


def _by_image():
    from pyspark.sql import Window

    return Window.partitionBy("image_id").orderBy("det_ord")


def _running(counts: DataFrame, block: int = 4096) -> DataFrame:
    """``image_id``, ``_before``: sum of ``_c`` of smaller ids; a running sum within blocks of ids plus one over the blocks."""
    from pyspark.sql import Window

    b = counts.withColumn("_block", F.expr(f"image_id div {block}"))
    sums = b.groupBy("_block").agg(F.sum("_c").alias("_s"))
    earlier = sums.withColumn("_offset", F.coalesce(F.sum("_s").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_block", "_offset")
    own = F.coalesce(F.sum("_c").over(Window.partitionBy("_block").orderBy("image_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return b.withColumn("_own", own).join(earlier, "_block").select("image_id", (F.col("_own") + F.col("_offset")).alias("_before"))


def categories(one_based: bool = True) -> list[dict]:
    return [{"id": i + int(one_based), "name": n, "supercategory": "none"} for i, n in enumerate(CLASS_NAMES)]


def coco_documents(annotations: DataFrame, images: DataFrame, images_per_document: int = 50_000) -> DataFrame:
    """``part``, ``json``: COCO documents of at most so many consecutive image ids each, so that no document grows with the corpus."""
    part = F.expr(f"image_id div {images_per_document}")
    anns = annotations.withColumn("part", part).groupBy("part").agg(F.sort_array(F.collect_list(F.struct(*annotations.columns))).alias("annotations"))
    ims = images.select(F.col("image_id").alias("id"), "file_name", "width", "height").withColumn("part", F.expr(f"id div {images_per_document}")).groupBy("part").agg(F.sort_array(F.collect_list(F.struct("id", "file_name", "width", "height"))).alias("images"))
    cats = F.from_json(F.lit(json.dumps(categories())), "array<struct<id:int,name:string,supercategory:string>>")
    none = F.expr(f"cast(array() as array<{annotations.select(F.struct(*annotations.columns)).schema[0].dataType.simpleString()}>)")
    return ims.join(anns, "part", "left").select("part", F.to_json(F.struct("images", F.coalesce("annotations", none).alias("annotations"), cats.alias("categories"))).alias("json"))


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, annotations and categories of COCO documents."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", COCO).alias("d"))
    return tuple(doc.select(F.inline(f"d.{name}")) for name in ("images", "annotations", "categories"))


def coco_to_yolo(annotations: DataFrame, images: DataFrame, one_based: bool = True) -> DataFrame:
    """``stem``, ``content`` of a label file for each image of a COCO table."""
    im = images.select(F.col("id").alias("image_id"), "file_name", "width", "height")
    xywh = [F.get("bbox", F.lit(i)) for i in range(4)]
    rows = im.join(annotations.select("image_id", "id", "category_id", "bbox"), "image_id").withColumns(dict(zip(Box._fields, from_coco(*xywh), strict=True)))
    rows = rows.select(stem(F.col("file_name")).alias("stem"), F.col("id").alias("det_ord"), (F.col("category_id") - int(one_based)).alias("class_id"), *Box._fields, "width", "height")
    return yolo_files(yolo_lines(rows, F.col("width"), F.col("height")), im.select(stem(F.col("file_name")).alias("stem")), newline=False)


def import_zip(document: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("annotations/instances_default.json", (1980, 1, 1, 0, 0, 0)), document, zipfile.ZIP_DEFLATED)
    return out.getvalue()


# --- taxonomy and configuration ---------------------------------------------------------------------------------------


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """One row for each class and attribute: ``class_id``, ``class_name``, ``privacy_sensitive``, ``color``, ``attribute``, ``values``, ``default``."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", TAXONOMY).alias("t")).select(F.inline("t.classes"))
    return doc.select(F.col("id").alias("class_id"), F.col("name").alias("class_name"), "privacy_sensitive", "color", F.explode_outer("attributes").alias("attribute", "a")).select("class_id", "class_name", "privacy_sensitive", "color", "attribute", "a.values", "a.default")


def label_editor(taxonomy: DataFrame) -> DataFrame:
    """``json``: the label editor's list of classes with their attributes."""
    attribute = F.struct(F.col("attribute").alias("name"), F.lit(False).alias("mutable"), F.lit("select").alias("input_type"), F.coalesce("default", F.lit("unspecified")).alias("default_value"), "values")
    rows = taxonomy.groupBy("class_id", "class_name", "color").agg(F.sort_array(F.collect_list(F.when(F.col("attribute").isNotNull(), attribute))).alias("attributes"))
    return rows.agg(F.sort_array(F.collect_list(F.struct("class_id", F.col("class_name").alias("name"), "color", "attributes"))).alias("x")).select(F.to_json(F.transform("x", lambda c: F.struct(c["name"].alias("name"), c["color"].alias("color"), c["attributes"].alias("attributes")))).alias("json"))


def dataset_yaml(folder: str) -> str:
    return yaml.safe_dump({"path": folder, "train": "images/train", "val": "images/val", "names": dict(enumerate(CLASS_NAMES))}, default_flow_style=False)


#: Fixed values of the multi-model inference.
DEFAULT_CONFIG = {
    "class_names": CLASS_NAMES,
    "models": [
        {"path": "weights/v12_general.pt", "classes": ["person", "vehicle", "text_or_logo", "crane", "container", "scaffolding", "material_stack"], "confidence": 0.15},
        {"path": "weights/face_only.pt", "classes": ["face"], "confidence": 0.10},
        {"path": "weights/v11_person_supplement.pt", "classes": ["person"], "confidence": 0.20},
    ],
    "wbf": {"enabled": True, "iou_threshold": 0.30},
    "face_clipping": {"enabled": True, "max_height_ratio": 0.40, "clip_to_ratio": 0.30},
    "anonymisation": {"base_kernel": 51, "body_kernel": 31, "face_high_conf": 0.50, "padding_pct": 10, "person_fallback_ratio": 0.33, "anonymise_classes": ["face", "person", "text_or_logo"]},
}


def load_config(path: str | None) -> dict:
    """Defaults with a YAML file's top-level blocks in place of theirs; without the file the defaults."""
    return DEFAULT_CONFIG | (yaml.safe_load(read_text(path)) or {} if there(path) else {})


def write_default_config(path: str) -> None:
    write_bytes(path, yaml.safe_dump(DEFAULT_CONFIG, default_flow_style=False, sort_keys=False).encode())


# --- training sets ------------------------------------------------------------------------------------------------------


def write_training_tree(split: DataFrame, folder: str) -> DataFrame:
    """Images and labels copied under ``images/<split>`` and ``labels/<split>``, and ``dataset.yaml``; gives ``target``, ``bytes``.

    ``split``: ``stem``, ``image_path``, ``label_path``, ``split``. Copies take the place of symbolic links, which stores don't have.
    """
    at = lambda kind, ext: F.concat(F.lit(f"{folder}/{kind}/"), "split", F.lit("/"), "stem", ext)
    pairs = F.array(F.struct(F.col("image_path").alias("source"), at("images", F.regexp_extract("image_path", r"\.[^./]*$", 0)).alias("target")), F.struct(F.col("label_path").alias("source"), at("labels", F.lit(".txt")).alias("target")))
    done = copy_files(split.select(F.inline(pairs)))
    write_bytes(f"{folder}/dataset.yaml", dataset_yaml(folder).encode())
    return done


def read_dataset(spark: SparkSession, path: str, part: str = "val") -> tuple[DataFrame, DataFrame, dict[int, str]]:
    """Images (``stem``, ``image_path``), label boxes (``stem``, ``line_ord``, ``class_id``, ``cx`` ...) and class names of a part of a training set, by its ``dataset.yaml``."""
    cfg = yaml.safe_load(read_text(path))
    root = str(cfg.get("path") or path.rpartition("/")[0]).rstrip("/")
    images = f"{root}/{cfg[part]}"
    listed = list_files(spark, images).select(stem(F.col("path")).alias("stem"), F.col("path").alias("image_path"))
    names = cfg["names"]
    return listed, read_yolo(spark, images.replace("/images/", "/labels/")), dict(enumerate(names)) if isinstance(names, list) else {int(k): v for k, v in names.items()}


def best_weights(spark: SparkSession, candidates: list[str]) -> str | None:
    """The first of the candidate paths that exists."""
    return next((p for p in candidates if exists(spark, p)), None)


# --- what annotation leaves ---------------------------------------------------------------------------------------------


def annotation_stats(dets: DataFrame, images: DataFrame, models: list[str], timestamp: str) -> DataFrame:
    """One JSON object: images, detections, detections by class, models, time."""
    counts = dets.groupBy("class_name").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_detections"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("class_name", "n")))).alias("detections_per_class"))
    total = images.agg(F.count(F.lit(1)).alias("total_images"))
    return total.crossJoin(counts).select(F.to_json(F.struct("total_images", "total_detections", "detections_per_class", F.array(*map(F.lit, models)).alias("models_used"), F.lit(timestamp).alias("timestamp"))).alias("value"))


def write_annotations(dets: DataFrame, images: DataFrame, taxonomy: DataFrame, folder: str, models: list[str], timestamp: str, images_per_document: int = 50_000) -> None:
    """COCO documents, their import archives, YOLO labels with ``classes.txt``, the label editor's list and the counts.

    ``images``: ``image_id``, ``file_name``, ``width``, ``height``. A document holds so many consecutive image ids at most.
    """
    documents = coco_documents(coco_annotations(dets), images, images_per_document).select(F.format_string("annotations_%05d", "part").alias("stem"), F.col("json").alias("content"))
    write_files(documents, f"{folder}/annotations", ".json")
    zipped = F.udf(import_zip, "binary")  # one call a document
    write_files(documents.withColumn("content", zipped("content")), f"{folder}/annotations", ".zip")
    named = images.withColumn("stem", stem(F.col("file_name")))
    lines = yolo_lines(dets.join(named.select("image_id", "stem", "width", "height"), "image_id"), F.col("width"), F.col("height"))
    write_files(yolo_files(lines, named), f"{folder}/yolo_labels")
    write_bytes(f"{folder}/yolo_labels/classes.txt", "\n".join(CLASS_NAMES).encode())
    for name, table in (("labels", label_editor(taxonomy)), ("annotation_stats", annotation_stats(dets, images, models, timestamp))):
        write_bytes(f"{folder}/{name}.json", table.first()[0].encode())

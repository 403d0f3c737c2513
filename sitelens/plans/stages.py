"""The stages as DataFrame plans, and thin classes with the usual parameters around them."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens import constants as C
from sitelens.functions import kernels, names
from sitelens.functions.geometry import band, box, crop
from sitelens.operators import anonymise, attributes, classify, detectors, evaluate, filters, fusion, quality, selection, spatial, split, suppress, tiles, zones
from sitelens.operators.folds import bounded
from sitelens.sources import formats, images, reports
from sitelens.sources.files import checkpointed


def prefilter(spark: SparkSession, folder: str, profile: str = "strict", max_images: int | None = None, crops: DataFrame | None = None) -> DataFrame:
    """Listing, limit, crop of zone margins, metrics in one pass over the pixels, gate."""
    some = images.first_images(images.list_images(spark, folder), max_images)
    pixels = images.read_images(spark, folder).join(some, "path", "left_semi") if max_images is not None else images.read_images(spark, folder).where(names.is_image(F.col("path"), C.IMAGE_EXTENSIONS, True))
    if crops is not None:
        setup = names.setup_of(names.file_name(F.col("path")))
        pixels = pixels.withColumn("setup", setup).join(F.broadcast(crops), "setup", "left")
        part = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        pixels = pixels.withColumns(zones.crop_margins(F.col("width"), F.col("height"), part("top"), part("bottom"), part("left"), part("right")))
    return quality.quality_gate(kernels.measure(pixels), profile)


def select_images(scored: DataFrame, num_samples: int = 2500, min_gap_minutes: float = 3, max_per_hour: int = 5, person_weight: float = 10, vehicle_weight: float = 5) -> DataFrame:
    return selection.temporal_diversity(selection.relevance_score(scored, person_weight, vehicle_weight), num_samples, min_gap_minutes, max_per_hour)


def annotate(dets: DataFrame, width: int, height: int, wbf_iou: float = 0.35, exclusions: DataFrame | None = None, setup: Column | None = None) -> DataFrame:
    """Fusion, cross-class cleanup, dedup, then confidence, size and zone filters. The order matters: dedup comes before the confidences."""
    fused = fusion.wbf_pipeline(dets, wbf_iou)
    fused = fused.withColumn("det_ord", F.expr("row_number() over (partition by image_id order by class_id, cluster_ord)")).drop("cluster_ord")
    out = suppress.dedup_same_class(suppress.cross_class_cleanup(fused))
    out = filters.filter_aspect(filters.filter_person_area(filters.filter_confidence(out), width, height))
    if exclusions is not None:
        out = zones.filter_exclusion_zones(out.withColumn("setup", setup), exclusions, width, height).drop("setup")
    return out


def rescue_faces(persons: DataFrame, found: DataFrame, verdicts: DataFrame, width: int, height: int) -> DataFrame:
    """Faces for persons without one: the best that a detector ``found`` in the head crop (crop coordinates), else the top quarter where a ``verdict`` says face_visible.

    A found box is moved by the person's own corner, though the crop began inside of the image.
    """
    keys = ["image_id", "det_ord"]
    head = crop(band(box(), 0, 0.35), F.lit(width), F.lit(height), 0)
    able = persons.where((head.width >= 10) & (head.height >= 10)).select(*keys, "x1", "y1", "x2", "y2")
    w = F.expr("row_number() over (partition by image_id, person_ord order by confidence desc, det_ord)")
    best = found.withColumn("_n", w).where("_n = 1").select("image_id", F.col("person_ord").alias("det_ord"), *(F.col(c).alias(f"f{c}") for c in ("x1", "y1", "x2", "y2")), "confidence")
    by_model = able.join(best, keys).select(*keys, (F.col("x1") + F.col("fx1")).alias("x1"), (F.col("y1") + F.col("fy1")).alias("y1"), (F.col("x1") + F.col("fx2")).alias("x2"), (F.col("y1") + F.col("fy2")).alias("y2"), "confidence", F.lit("yolo_face_rescue").alias("model"), names.visibility(F.col("confidence")).alias("visibility"))
    seen = able.join(best, keys, "left_anti").join(verdicts.where("label = 'face_visible'").select(*keys), keys, "left_semi")
    quarter = band(box(), 0, 0.25)
    by_label = seen.select(*keys, *quarter.columns(), F.lit(0.20).alias("confidence"), F.lit("clip_face_rescue").alias("model"), F.lit("partial").alias("visibility"))
    return by_model.unionByName(by_label).withColumns({"class_id": F.lit(0), "class_name": F.lit("face")}).withColumnRenamed("det_ord", "person_ord")


def rescue_plates(vehicles: DataFrame, plates: DataFrame, found: DataFrame, width: int, height: int) -> DataFrame:
    """Plates for vehicles without one where OCR or classification found one (``found``: image_id, det_ord): the lower half."""
    bare = spatial.vehicles_without_plate(vehicles, plates)
    half = band(box(), 0.5, 1)
    area = crop(half, F.lit(width), F.lit(height), 0)
    able = bare.where((area.width >= 20) & (area.height >= 10)).join(found, ["image_id", "det_ord"], "left_semi")
    return able.select("image_id", F.col("det_ord").alias("vehicle_ord"), *half.columns(), F.lit(0.30).alias("confidence"), F.lit(3).alias("class_id"), F.lit("text_or_logo").alias("class_name"), F.lit("plate_rescue").alias("model"), F.lit("license_plate").alias("content_type"), F.lit("yes").alias("is_text"), F.lit("no").alias("is_logo"))


def enrich(dets: DataFrame) -> DataFrame:
    """What the geometry and the phrases say: text attributes, visible faces, helmets; ``attributes`` grows by them."""
    attrs = F.coalesce("attributes", F.create_map().cast("map<string,string>"))
    phrase = F.coalesce(F.col("phrase"), F.lit(""))
    said = F.create_map(F.lit("is_logo"), names.is_logo(phrase), F.lit("is_text"), F.lit("yes"), F.lit("content_type"), names.content_type(phrase))
    new = lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
    out = dets.withColumn("attributes", F.when((F.col("class_name") == "text_or_logo") & (phrase != ""), new(attrs, said)).otherwise(attrs))
    visible = spatial.persons_with_face(out).select("image_id", "det_ord", F.lit(True).alias("_seen"))
    helmets = spatial.face_helmets(out).select("image_id", "det_ord", "has_helmet")
    out = out.join(visible, ["image_id", "det_ord"], "left").join(helmets, ["image_id", "det_ord"], "left")
    seen = F.create_map(F.lit("face_visible"), F.when(F.col("_seen"), "yes").otherwise("no"))
    worn = F.create_map(F.lit("has_helmet"), F.col("has_helmet"))
    attrs = F.when(F.col("class_name") == "person", new(F.col("attributes"), seen)).when(F.col("class_name") == "face", new(F.col("attributes"), worn)).when(F.col("class_name") == "text_or_logo", attributes.with_defaults(F.col("attributes"), ["is_logo", "is_text", "content_type"])).otherwise(F.col("attributes"))
    return out.withColumn("attributes", attrs).select(*dets.columns)


KEYS = ["image_id", "det_ord"]
#: Attributes that a classifier gives, by class, and the least crop it looks at (width, height).
CLASSIFIED = {"person": ["posture"], "vehicle": ["vehicle_type", "ownership"], "text_or_logo": ["content_type"], "face": ["visibility"]}
DEFAULTS = {"person": ["face_visible", "helmet", "safety_vest", "posture"], "vehicle": ["vehicle_type", "ownership"], "text_or_logo": ["is_logo", "is_text", "content_type"], "face": ["visibility", "has_helmet"]}


def _with(attributes_: Column, **values: Column) -> Column:
    """Attributes with values set where they aren't null."""
    new = F.map_filter(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v))), lambda _, v: v.isNotNull())
    return F.map_concat(F.map_filter(attributes_, lambda k, _: ~F.map_contains_key(new, k)), new)


def enrich_all(dets: DataFrame, width: int, height: int, labels: DataFrame, gear: DataFrame, readings: DataFrame, verdicts: DataFrame, found_faces: DataFrame, seen_faces: DataFrame, found_plates: DataFrame) -> DataFrame:
    """Everything that follows fusion, in the annotation's order; each model's answers are a table by ``image_id`` and ``det_ord``.

    Verification (``verdicts``: ``label``), phrases, visible faces and helmets; protective gear (``gear``: ``name`` of what was
    found in a person's crop); classified attributes (``labels``: ``key``, ``label``) where they aren't known; OCR
    (``readings``: ``score``, ``error``) for sure texts not known to be text; what follows for logos; faces and plates for
    those without one; defaults for what is missing.
    """
    # written, for what follows reads it more than once
    out = checkpointed(enrich(classify.verify_gate(dets, verdicts)))
    flags = classify.ppe_flags(gear, KEYS)
    asked = labels.groupBy(*KEYS).agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct("key", "label")))).alias("_labels"))
    guarded = attributes.needs_reading(out).select(*KEYS)
    read = classify.ocr_verdict(readings.join(guarded, KEYS, "left_semi"), KEYS).withColumnRenamed("is_text", "_text")
    out = out.join(flags.select(*KEYS, F.col("helmet").alias("_helmet"), F.col("vest").alias("_vest")), KEYS, "left").join(asked, KEYS, "left").join(read, KEYS, "left")
    person, text = F.col("class_name") == "person", F.col("class_name") == "text_or_logo"
    said = {"helmet": F.when(person, F.col("_helmet")), "safety_vest": F.when(person, F.col("_vest")), "is_text": F.when(text & F.col("_text"), "yes").when(text & ~F.col("_text"), "no")}
    said |= {key: F.when((F.col("class_name") == name) & attributes.unknown(key), F.col("_labels")[key]) for name, keys in CLASSIFIED.items() for key in keys}
    out = out.withColumn("attributes", _with(F.col("attributes"), **said)).select(*dets.columns)
    kind, logo = F.col("attributes")["content_type"], F.coalesce(F.col("attributes")["is_logo"], F.lit("unspecified"))
    logo = F.when(text & (kind == "company_name"), "yes").when(text & (F.col("attributes")["is_text"] == "yes") & (logo == "unspecified"), "no")
    out = checkpointed(checkpointed(out).withColumn("attributes", _with(F.col("attributes"), is_logo=logo)))

    bare = spatial.of_class(out, "person").where(F.col("attributes")["face_visible"] == "no")
    faces = rescue_faces(bare, found_faces, seen_faces, width, height).select("image_id", F.lit(1).alias("_kind"), F.col("person_ord").alias("_of"), "class_id", "class_name", "x1", "y1", "x2", "y2", "confidence", "model", F.create_map(F.lit("visibility"), F.col("visibility")).alias("attributes"))
    plates = rescue_plates(out, spatial.of_class(out, "text_or_logo"), found_plates, width, height)
    plates = plates.select("image_id", F.lit(2).alias("_kind"), F.col("vehicle_ord").alias("_of"), "class_id", "class_name", "x1", "y1", "x2", "y2", "confidence", "model", F.create_map(*(x for c in ("content_type", "is_text", "is_logo") for x in (F.lit(c), F.col(c)))).alias("attributes"))
    # rescued ones come after an image's own, faces first
    last = out.groupBy("image_id").agg(F.max("det_ord").alias("_last"))
    place = F.expr("row_number() over (partition by image_id order by _kind, _of)")
    more = faces.unionByName(plates).withColumn("_n", place).join(last, "image_id").withColumn("det_ord", (F.col("_last") + F.col("_n")).cast("int")).drop("_kind", "_of", "_n", "_last")
    out = out.unionByName(more, allowMissingColumns=True)
    filled = F.col("attributes")
    for name, keys in DEFAULTS.items():
        filled = F.when(F.col("class_name") == name, attributes.with_defaults(F.col("attributes"), keys)).otherwise(filled)
    return out.withColumn("attributes", filled)


def annotate_images(dets: DataFrame, width: int, height: int, exclusions: DataFrame | None = None, setup: Column | None = None, tiles_of: DataFrame | None = None, **answers: DataFrame) -> DataFrame:
    """The whole annotation: detections of the image and of its tiles (``tiles_of``: detections with ``tx1`` ... ``ty2``, ``tile_ord``), ``annotate``, ``enrich_all``."""
    every = detectors.ensemble(dets, tiles.to_image(tiles_of)) if tiles_of is not None else dets
    return enrich_all(annotate(every, width, height, exclusions=exclusions, setup=setup), width, height, **answers)


def infer(dets: DataFrame, config: dict | None = None) -> DataFrame:
    """Multi-model inference after the models: allowed classes and confidences by model, fusion or dedup, clipped faces.

    ``dets``: detections with ``model`` the path of a configured model.
    """
    cfg = config or formats.DEFAULT_CONFIG
    allowed = None
    for m in cfg["models"]:
        test = (F.col("model") == m["path"]) & (F.col("confidence") >= m["confidence"]) & F.col("class_name").isin(m["classes"])
        allowed = test if allowed is None else allowed | test
    out = dets.where(allowed)
    wbf = cfg["wbf"]
    if wbf.get("enabled", False):
        out = fusion.wbf_single_class(out, wbf.get("iou_threshold", 0.30)).drop("cluster_ord", "num_fused")
    else:
        out = suppress.inference_dedup(out)
    clip = cfg["face_clipping"]
    return spatial.clip_faces(out, clip.get("max_height_ratio", 0.40), clip.get("clip_to_ratio", 0.30), enabled=clip.get("enabled", False))


def anonymise_plan(dets: DataFrame, width: int, height: int, zone_points: DataFrame | None = None, **options) -> DataFrame:
    """Detections inside of zones go (``dets`` has ``setup`` then), the rest is planned."""
    kept = zones.filter_polygon_zones(dets, zone_points, width, height) if zone_points is not None else dets
    return anonymise.blur_plan(kept, width, height, **options)


def evaluate_detections(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Per class: precision, recall, f1 at overlap .5, ap50, ap50_95."""
    return evaluate.evaluation(predictions, truth).withColumn("class_name", names.class_name(F.col("class_id")))


def anonymise_images(pixels: DataFrame, dets: DataFrame, width: int, height: int, zone_points: DataFrame | None = None, method: str = "gaussian", review: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """Images with zones and detections blurred and the time written on them (``path``, ``content``, ``review``), and the counts by tier.

    ``pixels``: ``path``, ``height``, ``width``, ``n_channels``, ``data``; ``dets``: with ``path``, the image's number
    ``image_id``; ``zone_points``: ``setup``, ``points``. Detections inside of zones aren't blurred once more.
    """
    setup = names.setup_of(names.file_name(F.col("path")))
    plan = anonymise_plan(dets.withColumn("setup", setup), width, height, zone_points, **options)
    named = plan.join(dets.select("image_id", "path").distinct(), "image_id")
    own = pixels.select("path").withColumn("setup", setup)
    masks = own.join(bounded(zone_points), "setup").select("path", "points") if zone_points is not None else None
    labels = own.select("path", names.time_label(F.col("path")).alias("label"))
    return kernels.render(pixels, named, masks, labels, method, review), anonymise.tier_counts(plan)


def run_stages(stages: list[tuple[str, Callable[[], object]]]) -> list[tuple[str, float, str | None]]:
    """Name, seconds and error of each stage, one after the other; the first that fails is the last that runs."""
    done = []
    for name, stage in stages:
        began, error = time.monotonic(), None
        try:
            stage()
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
        done.append((name, time.monotonic() - began, error))
        if error:
            break
    return done


@dataclass
class ImagePrefilter:
    input_dir: str
    output_dir: str
    min_brightness: float = 30.0
    max_brightness: float = 250.0
    min_contrast: float = 15.0
    min_sharpness: float = 50.0
    min_edge_density: float = 0.01

    def run(self, spark: SparkSession, max_images: int | None = None) -> DataFrame:
        metrics = prefilter(spark, self.input_dir, max_images=max_images).drop("reasons", "accepted")
        gated = quality.quality_gate(metrics, thresholds=(self.min_brightness, self.max_brightness, self.min_contrast, self.min_sharpness, self.min_edge_density))
        gated.write.mode("overwrite").parquet(f"{self.output_dir}/_metrics")
        gated = spark.read.parquet(f"{self.output_dir}/_metrics")
        reports.write_prefilter(gated, self.output_dir, (self.min_brightness, self.max_brightness, self.min_contrast, self.min_sharpness, self.min_edge_density))
        return quality.rejection_counts(gated)


@dataclass
class IntelligentImageSelector:
    num_samples: int = 2500
    min_gap_minutes: float = 3
    max_per_hour: int = 5
    person_weight: float = 10
    vehicle_weight: float = 5

    def run(self, scored: DataFrame) -> DataFrame:
        return select_images(scored, self.num_samples, self.min_gap_minutes, self.max_per_hour, self.person_weight, self.vehicle_weight)

    def select_from(self, images_: DataFrame, dets: DataFrame, target_dir: str) -> DataFrame:
        """Scores readable images (``image_id``, ``path``) by their detections, selects, copies and reports under ``target_dir``."""
        counted = selection.score_images(images_, dets).withColumn("captured_at", names.captured_at(names.file_name(F.col("path"))))
        scored = selection.relevance_score(counted.drop("data"), self.person_weight, self.vehicle_weight)
        selected = checkpointed(selection.temporal_diversity(scored, self.num_samples, self.min_gap_minutes, self.max_per_hour))
        reports.write_selection(scored, selected, selection.random_baseline(scored.select("path"), self.num_samples), target_dir, reports.now())
        return selected


@dataclass
class MultiModelAnnotator:
    cross_model_iou: float = 0.5

    def run(self, dets: DataFrame) -> DataFrame:
        """The class module's order: fusion, then links of faces to persons."""
        fused = fusion.wbf_module(dets, self.cross_model_iou)
        fused = fused.withColumn("det_ord", F.expr("row_number() over (partition by image_id order by class_id, cluster_ord)")).drop("cluster_ord")
        linked = spatial.link_faces_best(fused).select("image_id", "det_ord", "face_visible")
        return fused.join(linked, ["image_id", "det_ord"], "left")


@dataclass
class Anonymizer:
    blur_strength: int = 51
    body_blur_strength: int = 31
    padding_percent: float = 10
    face_high_thresh: float = 0.5
    body_blur_top_pct: float = 0.33
    body_anonymize: bool = True
    blur_method: str = "gaussian"
    options: dict = field(default_factory=dict)

    def plan(self, dets: DataFrame, width: int, height: int) -> DataFrame:
        return anonymise.blur_plan_module(dets, width, height, self.face_high_thresh, self.blur_strength, self.body_blur_strength, self.padding_percent, self.body_blur_top_pct, self.body_anonymize)

    def render(self, pixels: DataFrame, dets: DataFrame, width: int, height: int) -> DataFrame:
        """``path``, ``content`` of the images with their plan carried out by ``blur_method``; ``options`` go to the renderer (``zones``, ``labels``, ``review``)."""
        plan = self.plan(dets, width, height).withColumn("seq", F.col("det_ord")).join(dets.select("image_id", "path").distinct(), "image_id")
        return kernels.render(pixels, plan, method=self.blur_method, **self.options)


def prepare_training_split(labels: DataFrame, image_files: DataFrame, val_ratio: float = 0.2, seed: int = 42) -> DataFrame:
    return split.train_val_split(split.match_labels(labels, image_files), val_ratio, seed)


def prepare_training(labels_dir: str, images_dir: str, output_dir: str, spark: SparkSession, val_ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """Labels and images matched by stem, split, copied as a training set; gives class counts by split."""
    pictures = formats.list_files(spark, images_dir).select(names.stem(F.col("path")).alias("stem"), F.col("path").alias("image_path")).where(names.is_image(F.col("image_path"), C.ANNOTATED_EXTENSIONS, False))
    divided = checkpointed(prepare_training_split(formats.find_label_files(spark, labels_dir), pictures, val_ratio, seed))
    formats.write_training_tree(divided, output_dir)
    return split.split_class_counts(divided, formats.read_yolo(spark, labels_dir), C.CLASS_NAMES)


__all__ = ["Anonymizer", "ImagePrefilter", "IntelligentImageSelector", "MultiModelAnnotator", "annotate", "annotate_images", "anonymise_images", "anonymise_plan", "enrich", "enrich_all", "evaluate_detections", "infer", "prefilter", "prepare_training", "prepare_training_split", "rescue_faces", "rescue_plates", "run_stages", "select_images"]

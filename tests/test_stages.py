"""Model seams, complete stages, sinks, pixels; and what the plans look like."""

import datetime
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.fixtures import detections
from sitelens.functions import kernels
from sitelens.operators import anonymise, detectors, evaluate, selection, spatial, suppress, zones
from sitelens.plans import registry, stages
from sitelens.sources import files, formats, images, reports
from sitelens.streaming import live

SF = "/root/testdata/sf0.001"


# --- models -------------------------------------------------------------------------------------------------------------


def squares():
    """The class is made here, so that workers get it by value."""

    class Squares:
        """A stand-in that finds one box an image, fails on images of one row, and notes how many images a call has."""

        def detect(self, images, confidence, prompts):
            if (images["height"] == 1).any():
                raise ValueError("too flat")
            return [[{"class_id": 1, "class_name": (prompts or ["person"])[0], "x1": 0.0, "y1": 0.0, "x2": float(len(images)), "y2": 2.0, "confidence": c} for c in (0.9, confidence - 0.01)] for _ in range(len(images))]

        def embed(self, images):
            return [[float(h), float(len(images))] for h in images["height"]]

        def read(self, images):
            return [[("STOP", 0.9), ("x", 0.1)] if h > 2 else [] for h in images["height"]]

    return Squares


def pictures(spark, flat=()):
    return spark.range(200).coalesce(1).select(F.col("id").alias("image_id"), F.when(F.col("id").isin(*flat, -1), 1).otherwise(F.when(F.col("id") % 2 == 0, 2).otherwise(4)).alias("height"), F.lit(4).alias("width"), F.lit(1).alias("n_channels"), F.lit(b"x").alias("data"))


def test_detectors_get_batches(spark):
    rows = detectors.run_detector(pictures(spark), "squares", squares(), 0.3, ["crane"]).collect()
    assert len(rows) == 200 and {r.class_name for r in rows} == {"crane"} and {r.det_ord for r in rows} == {1}
    assert max(r.x2 for r in rows) == 64  # a call has 64 images
    rows = detectors.run_detector(pictures(spark, (5, 70)), "squares", squares(), 0.3).collect()
    assert {r.image_id for r in rows if r.error} == {5, 70} and all("too flat" in r.error for r in rows if r.error)
    assert sum(r.error is None for r in rows) == 198


def test_encoders_and_readers(spark):
    rows = detectors.run_encoder(pictures(spark), "squares", squares(), ["image_id"]).collect()
    assert len(rows) == 200 and all(r.embedding[0] == (2 if r.image_id % 2 == 0 else 4) and r.embedding[1] <= 64 for r in rows)
    rows = detectors.run_reader(pictures(spark), "squares", squares(), ["image_id"]).collect()
    assert len(rows) == 300 and {r.text for r in rows if r.image_id % 2 == 0} == {None} and {r.text for r in rows if r.image_id % 2} == {"STOP", "x"}


# --- selection ----------------------------------------------------------------------------------------------------------


def greedy(rows, gap, per_hour):
    taken = []
    for r in sorted(rows, key=lambda r: (-r[1], r[0])):
        hour = r[2].replace(minute=0, second=0)
        if sum(t[2].replace(minute=0, second=0) == hour for t in taken) < per_hour and all(abs((t[2] - r[2]).total_seconds()) >= gap for t in taken):
            taken.append(r)
    return {r[0] for r in taken}


@pytest.mark.parametrize("every, spread, block", [(60, 1, 24), (37, 40, 1), (600, 5, 24)])
def test_dense_times_against_brute_force(spark, every, spread, block):
    """Days without a pause: blocks are decided in rounds, as one list is."""
    rng = random.Random(every)
    begin = datetime.datetime(2024, 1, 1, 21)
    rows = [(i, float(rng.randint(0, 6)), begin + datetime.timedelta(seconds=every * i + rng.randint(0, spread))) for i in range(1500)]
    df = spark.createDataFrame(rows, "image_id long, score double, captured_at timestamp_ntz")
    got = {r.image_id for r in selection.temporal_diversity(df, 10_000, block_hours=block).collect()}
    assert got == greedy(rows, 180, 5)


def test_selection_is_copied_and_told(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"Kamera1_00_2024010{i + 1}030405.jpg").write_bytes(b"x" * i)
    ims = spark.createDataFrame([(i, str(tmp_path / f"Kamera1_00_2024010{i + 1}030405.jpg"), b"x" if i else None) for i in range(6)], "image_id long, path string, data binary")
    dets = spark.createDataFrame([(i, "person") for i in range(6) for _ in range(i)], "image_id long, class_name string")
    got = stages.IntelligentImageSelector(num_samples=3).select_from(ims, dets, str(tmp_path / "out")).collect()
    assert [r.image_id for r in got] == [5, 4, 3]
    stats = json.loads((tmp_path / "out" / "selection_stats.json").read_text())
    assert stats["total_scored"] == 5 and stats["total_selected"] == 3 and stats["avg_score"] == 40 and stats["random_baseline"]["count"] == 3
    assert len(list((tmp_path / "out").glob("*.jpg"))) == 3


# --- annotation and sinks -------------------------------------------------------------------------------------------------


def test_images_and_tiles_are_annotated(spark):
    from sitelens.plans.more_queries import _answers

    det = detections(spark, SF).where("image_id < 40").withColumns({"phrase": F.lit(""), "attributes": F.create_map().cast("map<string,string>")})
    tile = det.withColumns({"x1": F.col("x1") - 100, "x2": F.col("x2") - 100, "tx1": F.lit(100), "ty1": F.lit(0), "tx2": F.lit(740), "ty2": F.lit(640), "tile_ord": F.lit(0)})
    both = stages.annotate_images(det, 1280, 720, tiles_of=tile, **_answers(det)).where("num_fused is not null")
    once = stages.annotate_images(det, 1280, 720, **_answers(det)).where("num_fused is not null")
    assert both.count() == once.count() > 0 and both.agg(F.min("num_fused")).first()[0] >= 2  # a tile's boxes join those of the image


def test_annotations_on_disk(spark, tmp_path):
    from sitelens.plans.more_queries import _TAXONOMY

    (tmp_path / "taxonomy.json").write_text(json.dumps(_TAXONOMY))
    det = detections(spark, SF).where("image_id < 30").withColumn("num_fused", F.lit(1))
    ims = det.select("image_id").distinct().select("image_id", F.concat(F.lit("img_"), "image_id", F.lit(".jpg")).alias("file_name"), F.lit(1280).alias("width"), F.lit(720).alias("height"))
    formats.write_annotations(det, ims, formats.read_taxonomy(spark, str(tmp_path / "taxonomy.json")), str(tmp_path / "out"), ["a"], "t", 10)
    out = tmp_path / "out"
    assert len(list((out / "annotations").glob("*.json"))) == len(list((out / "annotations").glob("*.zip"))) == 3
    assert len(list((out / "yolo_labels").glob("img_*.txt"))) == ims.count()
    assert (out / "yolo_labels" / "classes.txt").read_text().split("\n")[0] == "face"
    assert json.loads((out / "annotation_stats.json").read_text())["total_detections"] == det.count()
    assert json.loads((out / "labels.json").read_text())[0]["name"] == "face"


def test_listing_below_folders(spark, tmp_path):
    for name in ("a.txt", "b/c.txt", "b/d/e.txt", "b/f.jpg"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("" if name == "a.txt" else "xy")
    rows = {r.path.removeprefix(f"file://{tmp_path}/"): r.length for r in files.list_files(spark, str(tmp_path), ".txt").collect()}
    assert rows == {"a.txt": 0, "b/c.txt": 2, "b/d/e.txt": 2}
    assert files.list_files(spark, str(tmp_path / "none")).count() == 0 and zones.read_zones(spark, str(tmp_path / "none.json")).count() == 0


def test_stages_stop_at_the_first_failure():
    done = []
    ran = stages.run_stages([("one", lambda: done.append(1)), ("two", lambda: 1 / 0), ("three", lambda: done.append(3))])
    assert [(n, e and e.split(":")[0]) for n, _, e in ran] == [("one", None), ("two", "ZeroDivisionError")] and done == [1]


def test_console(spark):
    text = reports.console(spark.createDataFrame([("face", 0.5), ("person", None)], "class string, recall double"), "Recall")
    assert text.split("\n") == ["Recall", "------", "class   recall", "face    0.5000", "person"]


# --- pixels -------------------------------------------------------------------------------------------------------------


def test_kernels_on_images():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (40, 60, 3)).astype(np.uint8)
    assert kernels.brightness_gray(kernels.gray(image)) == kernels.gray(image).mean() and kernels.brightness_gray(np.zeros((0, 3), np.uint8)) == 0
    same = np.full((30, 40, 3), 77, np.uint8)
    assert (kernels.resize(same, 7, 9) == 77).all() and kernels.resize(image, 40, 60).tolist() == image.tolist()
    assert kernels.resize(np.array([[[0], [100]]], np.uint8), 1, 4)[0, :, 0].tolist() == [0, 25, 75, 100]
    out = kernels.blur_rect(image.copy(), 10, 10, 50, 30, 9, "pixelate")
    assert (out[:10] == image[:10]).all() and len(np.unique(out[10:30, 10:50].reshape(-1, 3), axis=0)) <= 200
    over = kernels.overlay_time(np.full((60, 400, 3), 200, np.uint8), "2024-01-02  03:04:05")
    assert {tuple(p) for p in over.reshape(-1, 3)} == {(200, 200, 200), (80, 80, 80), (0, 255, 255)}
    drawn = kernels.draw_detection(np.zeros((50, 80, 3), np.uint8), 5, 20, 60, 45, "face 0.9", (1, 2, 3))
    assert drawn[20, 30].tolist() == [1, 2, 3] and drawn[11:18].any() and not drawn[30, 30].any()


def test_directory_of_images_is_anonymised(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in (1, 2):
        (tmp_path / "in" / f"Kamera{i}_00_20240102030405.png").write_bytes(kernels.encode_png(np.full((64, 96, 3), 200, np.uint8)))
    pixels = images.read_images(spark, str(tmp_path / "in"))
    setups = pixels.select("path", F.when(F.col("path").contains("Kamera1"), 1).otherwise(2).cast("long").alias("image_id"))
    boxes = spark.createDataFrame([(i, 1, 0, "face", 60.0, 30.0, 80.0, 50.0, 0.9) for i in (1, 2)] + [(2, 2, 3, "text_or_logo", 2.0, 50.0, 10.0, 60.0, 0.9)], "image_id long, det_ord int, class_id int, class_name string, x1 double, y1 double, x2 double, y2 double, confidence double").join(setups, "image_id")
    zone = spark.createDataFrame([("setup_2", "left_25")], "setup string, shorthand string").select("setup", zones.shorthand_polygon(F.col("shorthand"), F.lit(96), F.lit(64)).alias("points"))
    out, counts = stages.anonymise_images(pixels, boxes, 96, 64, zone, "black", review=True)
    assert {r.tier: r.n for r in counts.collect()} == {"tier1_face": 2, "total": 2}  # the text lies in a zone
    rows = out.collect()
    assert len(rows) == 2 and all(bytes(r.review[:4]) == bytes(r.content[:4]) == b"\x89PNG" for r in rows)
    formats.write_files(out.select(F.regexp_extract("path", r"Kamera\d", 0).alias("stem"), "content"), str(tmp_path / "out"), ".png")
    for r in images.read_images(spark, str(tmp_path / "out")).collect():
        picture = kernels.decode(r.data, r.height, r.width, r.n_channels)
        assert not picture[32:48, 62:78].any() and picture[60, 90].tolist() == [200, 200, 200]
    assert stages.Anonymizer(blur_method="black").render(pixels, boxes, 96, 64).count() == 2


# --- plans --------------------------------------------------------------------------------------------------------------


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") + plan.count("Exchange SinglePartition")


def test_exchanges(spark):
    """Detections are numbered by one exchange on the image; what an image decides needs no further one."""
    det = detections(spark, SF)
    own = exchanges(det)
    assert exchanges(spatial.reclassify_heads(det)) <= own and exchanges(anonymise.blur_plan(det, 700, 600)) <= own
    assert exchanges(suppress.cross_class_cleanup(det)) <= own and exchanges(suppress.dedup_same_class(det)) <= own + 1
    assert exchanges(evaluate.evaluation(*registry._sides(spark, SF))) <= 16
    plan = zones.filter_polygon_zones(registry._with_setup(det), registry._zone_table(spark), 1280, 720)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_stream_gives_whole_hours(spark, tmp_path):
    schema = "image_id long, path string, score double"
    rows = [(i, f"Kamera1_00_202401020{h}{m:02d}00.jpg", float(m)) for i, (h, m) in enumerate((h, m) for h in (3, 4, 8) for m in (0, 1, 30))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    counts = live.hourly_counts(live.stream_index(spark, str(tmp_path / "in"), schema))
    q = counts.writeStream.format("memory").queryName("whole_hours").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    # the watermark is an hour behind the last image, so the hours before are whole
    assert sorted((r.hour.hour, r.n, r.best) for r in spark.table("whole_hours").collect()) == [(3, 3, 30.0), (4, 3, 30.0)]

import json

import numpy as np
from pyspark.sql import functions as F

from sitelens.functions import kernels
from sitelens.operators import quality, zones
from sitelens.plans import stages
from sitelens.sources import formats, images, reports
from sitelens.streaming import live


def test_prefilter_from_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    noisy = rng.integers(0, 256, (60, 80, 3)).astype(np.uint8)
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "Kamera1_00_20240102030405.bmp").write_bytes(kernels.encode_bmp(noisy))
    (tmp_path / "in" / "sub" / "Kamera2_00_20240102030406.PNG").write_bytes(kernels.encode_png(np.full((50, 40, 3), 5, np.uint8)))
    (tmp_path / "in" / "broken.bmp").write_bytes(b"BM no image")
    (tmp_path / "in" / "note.txt").write_text("x")
    listing = images.list_images(spark, str(tmp_path / "in"))
    assert listing.count() == 3 and images.list_annotated(spark, str(tmp_path / "in")).count() == 2
    gated = stages.prefilter(spark, str(tmp_path / "in")).withColumn("name", F.element_at(F.split("path", "/"), -1))
    rows = {r["name"]: r for r in gated.collect()}
    assert rows["Kamera1_00_20240102030405.bmp"].accepted
    assert rows["broken.bmp"].reasons == ["unreadable"]
    assert rows["Kamera2_00_20240102030406.PNG"].reasons == ["too_dark", "low_contrast", "blurry", "low_edge_density"]
    assert rows["Kamera1_00_20240102030405.bmp"].brightness == kernels.brightness(noisy)
    reports.write_prefilter(gated, str(tmp_path / "out"))
    assert images.read_index(spark, str(tmp_path / "out" / "accepted_images.csv")).count() == 1
    counts = {r.what: r.n for r in quality.rejection_counts(gated).collect()}
    assert counts["total"] == 3 and counts["accepted"] == 1 and counts["unreadable"] == 1
    plan = spark.createDataFrame([(rows["Kamera1_00_20240102030405.bmp"].path, 1, 0.0, 0.0, 30.0, 30.0, 9)], "path string, seq int, x1 double, y1 double, x2 double, y2 double, kernel int")
    out = kernels.render(images.read_images(spark, str(tmp_path / "in")), plan)
    assert all(bytes(r.content[:4]) == b"\x89PNG" for r in out.collect())


def test_yolo_and_coco_round_trip(spark, tmp_path):
    files = spark.createDataFrame([("a", "1 0.5 0.5 0.25 0.25\n\n9 0.1 0.1 0.1 0.1\n"), ("b", "")], "stem string, content string")
    formats.write_files(files, str(tmp_path / "labels"))
    rows = formats.read_yolo(spark, str(tmp_path / "labels")).collect()
    assert sorted((r.stem, r.class_id, r.cx) for r in rows) == [("a", 1, 0.5), ("a", 9, 0.1)]
    assert {r.stem for r in formats.find_label_files(spark, str(tmp_path / "labels")).collect()} == {"a", "b"}
    det = spark.createDataFrame([(7, 1, 2, "vehicle", 0.0, 0.0, 64.0, 36.0, 0.5, "m"), (9, 1, 0, "face", 1.0, 1.0, 2.0, 2.0, 0.5, "m")], "image_id long, det_ord int, class_id int, class_name string, x1 double, y1 double, x2 double, y2 double, confidence double, model string")
    ims = spark.createDataFrame([(7, "x.jpg", 640, 360), (8, "y.jpg", 640, 360), (9, "z.jpg", 640, 360)], "image_id long, file_name string, width int, height int")
    doc = formats.coco_documents(formats.coco_annotations(det), ims).collect()
    assert len(doc) == 1
    data = json.loads(doc[0].json)
    assert [a["category_id"] for a in data["annotations"]] == [3, 1] and len(data["images"]) == 3 and data["categories"][0] == {"id": 1, "name": "face", "supercategory": "none"}
    (tmp_path / "coco.json").write_text(doc[0].json)
    im, ann, _ = formats.read_coco(spark, str(tmp_path / "coco.json"))
    got = {r.stem: r.content for r in formats.coco_to_yolo(ann, im).collect()}
    assert got["y"] == "" and got["x"] == "2 0.050000 0.050000 0.100000 0.100000"
    assert formats.import_zip("{}")[:2] == b"PK" and "images/train" in formats.dataset_yaml("/d")


def test_zone_file(spark, tmp_path):
    cfg = {"setup_1": {"description": "d", "zones": [{"name": "sky", "polygon": "full_width_top_20"}, {"name": "p", "polygon": [[0, 0], [10, 0], [0, 10]]}]}, "setup_2": {"description": "", "zones": [{"name": "f", "polygon": [1, 2, 3, 4, 5, 6]}]}}
    (tmp_path / "zones.json").write_text(json.dumps(cfg))
    z = zones.read_zones(spark, str(tmp_path / "zones.json"))
    rows = {r.zone_name: r for r in z.select("zone_name", zones.shorthand_of(F.col("polygon")).alias("s"), zones.explicit_polygon(F.col("polygon")).alias("p")).collect()}
    assert rows["sky"].s == "full_width_top_20" and rows["sky"].p is None
    assert [(p.x, p.y) for p in rows["p"].p] == [(0, 0), (10, 0), (0, 10)] and [(p.x, p.y) for p in rows["f"].p] == [(1, 2), (3, 4), (5, 6)]
    assert zones.read_exclusions(spark, None).count() == 2


def test_config_blocks_replace_defaults(tmp_path):
    (tmp_path / "c.yaml").write_text("wbf:\n  enabled: false\n")
    assert formats.load_config(str(tmp_path / "c.yaml"))["wbf"] == {"enabled": False}
    assert formats.load_config(None)["wbf"]["iou_threshold"] == 0.30


def test_stream_counts(spark, tmp_path):
    schema = "image_id long, path string, score double"
    rows = [(i, f"Kamera1_00_202401020{h}{m:02d}00.jpg", float(m)) for i, (h, m) in enumerate((h, m) for h in (3, 4) for m in (0, 1, 30))]
    spark.createDataFrame([*rows, rows[0]], schema).write.parquet(str(tmp_path / "in"))
    stream = live.stream_index(spark, str(tmp_path / "in"), schema)
    q = live.hourly_counts(stream).writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("hours").count() in (0, 1)
    batch = spark.read.parquet(str(tmp_path / "in"))
    assert batch.count() == 7

"""Order-dependent rules against plain statements of them, and golden edge cases."""

import datetime
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitelens.functions import kernels
from sitelens.operators import evaluate, fusion, selection, spatial, suppress, zones
from sitelens.schemas import DETECTION


def iou(a, b):
    i = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i
    return i / u if u > 0 else 0.0


def dets(spark, rows):
    """rows: (image, ord, class id, name, x1, y1, x2, y2, confidence)"""
    return spark.createDataFrame([(*r, "m") for r in rows], DETECTION)


def some(seed, n=60):
    rng = random.Random(seed)
    names = ["face", "person"]
    rows = []
    for i in range(n):
        c = rng.randrange(2)
        x, y = rng.randrange(60), rng.randrange(60)
        rows.append((i % 3, i, c, names[c], float(x), float(y), float(x + rng.randrange(0, 50)), float(y + rng.randrange(0, 50)), rng.choice([0.3, 0.5, 0.5, 0.9])))
    return rows


def test_suppressed_suppresses_nothing(spark):
    # the first suppresses the second, the second overlaps the third, the third must stay
    rows = [(1, 1, 1, "person", 0.0, 0.0, 10.0, 10.0, 0.9), (1, 2, 1, "person", 5.0, 0.0, 15.0, 10.0, 0.8), (1, 3, 1, "person", 10.0, 0.0, 20.0, 10.0, 0.7)]
    assert {r.det_ord for r in suppress.dedup_same_class(dets(spark, rows)).collect()} == {1, 3}


def test_threshold_is_strict_or_not(spark):
    # overlap of exactly one half
    rows = [(1, 1, 1, "person", 0.0, 0.0, 10.0, 10.0, 0.9), (1, 2, 1, "person", 0.0, 0.0, 10.0, 5.0, 0.9)]
    assert suppress.dedup_same_class(dets(spark, rows), 0.5).count() == 2
    assert [r.det_ord for r in suppress.cross_model_nms(dets(spark, rows), 0.5).collect()] == [1]


@pytest.mark.parametrize("seed", range(3))
def test_dedup_brute_force(spark, seed):
    rows, kept = some(seed), []
    for r in sorted(rows, key=lambda r: -r[8]):
        if not any(k[0] == r[0] and k[2] == r[2] and iou(k[4:8], r[4:8]) > 0.3 for k in kept):
            kept.append(r)
    got = suppress.dedup_same_class(dets(spark, rows)).collect()
    assert {(r.image_id, r.det_ord) for r in got} == {(r[0], r[1]) for r in kept}


@pytest.mark.parametrize("seed", range(3))
def test_fusion_brute_force(spark, seed):
    rows, want = some(seed), []
    for key in {(r[0], r[2]) for r in rows}:
        clusters = []
        for r in sorted((r for r in rows if (r[0], r[2]) == key and (r[6] - r[4]) * (r[7] - r[5]) >= (100 if r[3] == "face" else 400)), key=lambda r: -r[8]):
            b, c = np.array(r[4:8]), r[8]
            v = [iou(r[4:8], k["b"] / k["s"]) for k in clusters]
            at = int(np.argmax(v)) if v else -1
            if v and v[at] > 0.35:
                rep = clusters[at]["b"] / clusters[at]["s"]
                wide = max(b[2], rep[2]) - min(b[0], rep[0]) > 1.5 * max(b[2] - b[0], rep[2] - rep[0])
                if not (r[3] == "person" and wide):
                    clusters[at]["b"], clusters[at]["s"], clusters[at]["n"] = clusters[at]["b"] + b * c, clusters[at]["s"] + c, clusters[at]["n"] + 1
                    continue
            clusters.append({"b": b * c, "s": c, "n": 1})
        want += [(*key, *(round(float(x), 6) for x in k["b"] / k["s"]), round(k["s"] / k["n"], 6), k["n"]) for k in clusters]
    got = [(r.image_id, r.class_id, *(round(r[c], 6) for c in ("x1", "y1", "x2", "y2", "confidence")), r.num_fused) for r in fusion.wbf_pipeline(dets(spark, rows)).collect()]
    assert sorted(got) == sorted(want)


def test_single_class_keeps_lone_boxes(spark):
    rows = [(1, 1, 1, "person", 0.0, 0.0, 10.0, 10.0, 0.2), (1, 2, 1, "person", 1.0, 0.0, 11.0, 10.0, 0.6), (1, 3, 1, "person", 50.0, 0.0, 60.0, 10.0, 0.4)]
    got = {r.det_ord: r for r in fusion.wbf_single_class(dets(spark, rows)).collect()}
    assert got[1].model == "wbf_fused" and got[1].confidence == 0.6 and got[1].x1 == pytest.approx(0.75)
    assert got[3].model == "m" and got[3].x1 == 50.0


@pytest.mark.parametrize("seed", range(4))
def test_temporal_diversity_brute_force(spark, seed):
    rng = random.Random(seed)
    begin = datetime.datetime(2024, 3, 1, 22, 30)
    rows = [(i, None if i % 17 == 0 else begin + datetime.timedelta(seconds=rng.randrange(3600 * (3 if seed % 2 else 60))), float(rng.randrange(4))) for i in range(300)]
    rows += [(1000, datetime.datetime(2024, 5, 1, 10, 0, 0), 9.0), (1001, datetime.datetime(2024, 5, 1, 10, 3, 0), 8.0), (1002, datetime.datetime(2024, 5, 1, 10, 2, 59), 7.0)]
    taken, hours = [], {}
    for i, t, s in sorted(rows, key=lambda r: (-r[2], r[0])):
        if len(taken) == 120:
            break
        if t is not None:
            hour = t.replace(minute=0, second=0)
            if hours.get(hour, 0) >= 5 or any(u is not None and abs((t - u).total_seconds()) < 180 for _, u in taken):
                continue
            hours[hour] = hours.get(hour, 0) + 1
        taken.append((i, t))
    df = spark.createDataFrame(rows, "image_id long, captured_at timestamp_ntz, score double")
    assert {r.image_id for r in selection.temporal_diversity(df, 120).collect()} == {i for i, _ in taken}


@pytest.mark.parametrize("seed", range(2))
def test_matching_brute_force(spark, seed):
    p, t = some(seed), some(seed + 10)
    want = set()
    for key in {(r[0], r[2]) for r in p}:
        free = [r for r in t if (r[0], r[2]) == key]
        for r in sorted((r for r in p if (r[0], r[2]) == key), key=lambda r: -r[8]):
            best = max(free, key=lambda u: (iou(r[4:8], u[4:8]), -u[1]), default=None)
            hit = best is not None and iou(r[4:8], best[4:8]) >= 0.5
            if hit:
                free.remove(best)
            want.add((r[0], r[1], best[1] if hit else None))
    got = {(r.image_id, r.det_ord, r.truth_ord) for r in evaluate.match_predictions(dets(spark, p), dets(spark, t)).collect()}
    assert got == want


def test_heads_and_empty_boxes(spark):
    rows = [(1, 1, 1, "person", 0.0, 0.0, 100.0, 200.0, 0.9), (1, 2, 1, "person", 10.0, 10.0, 40.0, 50.0, 0.5), (1, 3, 1, "person", 10.0, 150.0, 40.0, 190.0, 0.5), (1, 4, 1, "person", 20.0, 20.0, 20.0, 20.0, 0.5)]
    got = {r.det_ord: r.class_name for r in spatial.reclassify_heads(dets(spark, rows)).collect()}
    assert got == {1: "person", 2: "face", 3: "person", 4: "face"}
    got = {r.det_ord: r.class_name for r in spatial.reclassify_heads(dets(spark, rows), 0.4, 0.4, 0.45, False).collect()}
    assert got[4] == "person"


def test_unknown_shorthand_is_an_error(spark):
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="Unknown zone shorthand"):
        spark.createDataFrame([("middle_10",)], "s string").select(zones.shorthand_polygon(F.col("s"), F.lit(10), F.lit(10))).collect()


def test_kernels():
    flat = np.full((20, 30, 3), 90, np.uint8)
    g = kernels.gray(flat)
    assert kernels.contrast(g) == 0 and kernels.sharpness(g) == 0 and kernels.edge_density(g) == 0 and kernels.brightness(flat) == 90
    step = flat.copy()
    step[:, 15:] = 250
    edges = kernels.canny(kernels.gray(step))
    assert edges.any() and set(np.nonzero(edges)[1]) <= {14, 15}
    blurred = kernels.blur_rect(step.copy(), 10, 5, 20, 15, 5)
    assert (blurred[:5] == step[:5]).all() and len(np.unique(blurred[8, 10:20])) > 2
    assert (kernels.blur_rect(flat.copy(), 5, 5, 15, 15, 31) == flat).all()
    assert (kernels.blur_rect(step.copy(), 40, 5, 20, 15, 5) == step).all()
    assert kernels.blur_rect(step.copy(), 0, 0, 5, 5, 5, "black")[2, 2].sum() == 0
    masked, n = kernels.mask_zones(step, [[(0, 0), (30, 0), (30, 10), (0, 10)]], 5)
    assert n == 1 and (masked[12:] == step[12:]).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.integers(0, 2**32 - 1))
def test_bmp_is_what_was_drawn(h, w, seed):
    image = np.random.default_rng(seed).integers(0, 256, (h, w, 3)).astype(np.uint8)
    data = kernels.encode_bmp(image)
    row = (w * 3 + 3) // 4 * 4
    back = np.frombuffer(data[54:], np.uint8).reshape(h, row)[:, : w * 3].reshape(h, w, 3)[::-1]
    assert (back == image).all()

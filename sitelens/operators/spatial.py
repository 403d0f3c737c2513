"""Spatial joins within an image. Every join has image_id as its equi-key; the geometry is a residual of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.geometry import Box, box, box_of, centre_inside, containment, contains, in_head_region
from sitelens.operators.folds import sorted_rows


def of_class(dets: DataFrame, name: str) -> DataFrame:
    return dets.where(F.col("class_name") == name)


def _named(dets: DataFrame, prefix: str, *more: str) -> DataFrame:
    return dets.select("image_id", *(F.col(c).alias(f"{prefix}{c}") for c in ("det_ord", *Box._fields, *more)))


def pairs(left: DataFrame, right: DataFrame, test: Column | None = None) -> DataFrame:
    """Pairs of one image as ``a_`` and ``b_`` columns."""
    out = _named(left, "a_", "class_id", "class_name", "confidence").join(_named(right, "b_", "class_id", "class_name", "confidence"), "image_id")
    return out if test is None else out.where(test)


def reclassify_heads(dets: DataFrame, size: float = 0.5, part: float = 0.5, head: float = 0.40, skip_empty: bool = True, mark: str | None = None) -> DataFrame:
    """Persons in the head region of a larger person become faces; no box changes, so all are decided at once.

    ``mark`` names a boolean column of those. Their attributes, if there are any, become visibility=occluded when they are
    tested by the annotation stage's rule (``skip_empty`` false).
    """
    rest = [c for c in dets.columns if c != "image_id"]
    groups = sorted_rows(dets, ["image_id"], [F.col("det_ord")], rest).withColumn("people", F.filter("rows", lambda r: r["class_name"] == "person"))
    larger = lambda s: F.exists("people", lambda l: (l["det_ord"] != s["det_ord"]) & in_head_region(box_of(l), box_of(s), size, part, head, skip_empty))
    marked = F.transform("rows", lambda s: F.struct(s.alias("row"), ((s["class_name"] == "person") & larger(s)).alias("_head")))
    out = groups.select("image_id", F.inline(marked)).select("image_id", "row.*", F.coalesce("_head", F.lit(False)).alias("_head"))
    if "attributes" in dets.columns and not skip_empty:
        out = out.withColumn("attributes", F.when(F.col("_head"), F.create_map(F.lit("visibility"), F.lit("occluded"))).otherwise(F.col("attributes")))
    out = out.withColumns({"class_id": F.when(F.col("_head"), 0).otherwise(F.col("class_id")), "class_name": F.when(F.col("_head"), "face").otherwise(F.col("class_name"))})
    out = out.withColumn(mark, F.col("_head")) if mark else out
    return out.select(*dets.columns, *([mark] if mark else []))


def holds_face(dets: DataFrame, name: str) -> DataFrame:
    """``dets`` with a boolean column: whether the row is the first person (by det_ord) around the centre of some face. One pass over each image's boxes."""
    rest = [c for c in dets.columns if c != "image_id"]
    of = lambda n: F.filter("rows", lambda r: r["class_name"] == n)
    groups = sorted_rows(dets, ["image_id"], [F.col("det_ord")], rest).withColumns({"people": of("person"), "faces": of("face")})
    first = lambda f: F.get(F.filter("people", lambda p: centre_inside(box_of(p), box_of(f))), F.lit(0))["det_ord"]
    groups = groups.withColumn("holders", F.array_compact(F.transform("faces", first)))
    marked = F.transform("rows", lambda r: F.struct(r.alias("row"), ((r["class_name"] == "person") & F.array_contains("holders", r["det_ord"])).alias(name)))
    return groups.select("image_id", F.inline(marked)).select("image_id", "row.*", name).select(*dets.columns, name)


def link_faces_best(dets: DataFrame, least: float = 0.7) -> DataFrame:
    """Each person with ``face_visible``: yes if some face lies in it more than in any other person, by ``least`` or more.

    Of persons that hold as much of a face the first counts; a person without a face keeps what it has, else gets no.
    """
    faces, people = of_class(dets, "face"), of_class(dets, "person")
    held = _named(faces, "f_").join(_named(people, "p_"), "image_id").withColumn("part", containment(box("p_"), box("f_"))).where("part > 0")
    best = held.groupBy("image_id", "f_det_ord").agg(F.max(F.struct("part", (-F.col("p_det_ord")).alias("minus"))).alias("best"))
    linked = best.where(F.col("best.part") >= least).select("image_id", (-F.col("best.minus")).alias("det_ord")).distinct().withColumn("_yes", F.lit("yes"))
    had = F.col("attributes")["face_visible"] if "attributes" in dets.columns else F.lit(None).cast("string")
    return people.join(linked, ["image_id", "det_ord"], "left").withColumn("face_visible", F.coalesce("_yes", had, F.lit("no"))).drop("_yes")


def persons_with_face(dets: DataFrame, least: float = 0.3) -> DataFrame:
    """Persons that contain a face (by ``least`` of its area)."""
    faces = _named(of_class(dets, "face"), "f_").withColumnRenamed("image_id", "f_image")
    return of_class(dets, "person").join(faces, (F.col("image_id") == F.col("f_image")) & contains(box(), box("f_"), least), "left_semi")


def vehicles_without_plate(dets: DataFrame, plates: DataFrame, least: float = 0.3) -> DataFrame:
    """Vehicles that contain none of ``plates``."""
    found = _named(plates, "t_").withColumnRenamed("image_id", "t_image")
    return of_class(dets, "vehicle").join(found, (F.col("image_id") == F.col("t_image")) & contains(box(), box("t_"), least), "left_anti")


def first_container(faces: DataFrame, people: DataFrame, test: Column) -> DataFrame:
    """``image_id``, ``f_det_ord``, ``p_det_ord``: for each face the first person (by det_ord) that passes ``test`` (``f_``, ``p_`` columns)."""
    return _named(faces, "f_").join(_named(people, "p_"), "image_id").where(test).groupBy("image_id", "f_det_ord").agg(F.min("p_det_ord").alias("p_det_ord"))


def face_first_person(dets: DataFrame, least: float = 0.3) -> DataFrame:
    """Each face with ``person_ord``, the first person that contains it; null without one."""
    faces, people = of_class(dets, "face"), of_class(dets, "person")
    first = first_container(faces, people, contains(box("p_"), box("f_"), least)).select("image_id", F.col("f_det_ord").alias("det_ord"), F.col("p_det_ord").alias("person_ord"))
    return faces.join(first, ["image_id", "det_ord"], "left")


def face_helmets(dets: DataFrame, least: float = 0.3) -> DataFrame:
    """Each face with ``has_helmet``, yes if the first person that contains it wears one (attribute or column ``helmet``)."""
    helmet = F.col("helmet") if "helmet" in dets.columns else F.col("attributes")["helmet"]
    wears = of_class(dets, "person").select("image_id", F.col("det_ord").alias("person_ord"), (helmet == "yes").alias("_wears"))
    return face_first_person(dets, least).join(wears, ["image_id", "person_ord"], "left").withColumn("has_helmet", F.when(F.col("_wears"), "yes").otherwise("no")).drop("_wears")


def clip_faces(dets: DataFrame, max_ratio: float = 0.40, clip_to: float = 0.30, least_height: float = 5.0, enabled: bool = True) -> DataFrame:
    """Faces too high for the first person around their centre are clipped to its head; then boxes of little height go, of any class."""
    if not enabled:
        return dets
    faces, people = of_class(dets, "face"), of_class(dets, "person")
    first = first_container(faces, people, centre_inside(box("p_"), box("f_")))
    bodies = first.join(_named(people, "p_"), ["image_id", "p_det_ord"]).select("image_id", F.col("f_det_ord").alias("det_ord"), *(f"p_{c}" for c in Box._fields)).withColumn("class_name", F.lit("face"))
    out = dets.join(bodies, ["image_id", "det_ord", "class_name"], "left")
    own, person = box(), box("p_")
    clips = F.coalesce(own.height > person.height * max_ratio, F.lit(False))
    new = {"x1": F.when(clips, F.greatest(own.x1, person.x1)).otherwise(own.x1), "x2": F.when(clips, F.least(own.x2, person.x2)).otherwise(own.x2), "y2": F.when(clips, person.y1 + person.height * clip_to).otherwise(own.y2)}
    return out.withColumns(new).where(F.col("y2") - F.col("y1") >= least_height).select(*dets.columns)

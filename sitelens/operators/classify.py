"""Zero-shot classification over embeddings, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.constants import VERIFIED_CLASSES, YES_ABOVE


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def zero_shot(crops: DataFrame, prompts: DataFrame, threshold: float, keys: list[str] | None = None) -> DataFrame:
    """Each crop's label: the label whose best prompt is nearest by cosine (0 at least); ``unspecified``, 0 under the threshold.

    ``crops``: keys and ``embedding``; ``prompts``: ``label``, ``label_ord`` (first wins ties), ``embedding``. Prompts are a
    few dozen by construction, so each crop is folded over them in place: no rows are multiplied and none are shuffled.
    """
    keys = keys or ["crop_id"]
    unit = prompts.select("label_ord", "label", F.struct(F.col("embedding").cast("array<double>").alias("v"), norm(F.col("embedding")).alias("n")).alias("p"))
    table = unit.groupBy("label_ord", "label").agg(F.collect_list("p").alias("ps")).agg(F.sort_array(F.collect_list(F.struct("label_ord", "label", "ps"))).alias("labels"))
    n = norm(F.col("embedding"))
    cosine = lambda p: dot(F.col("embedding"), p["v"]) / F.nullif(F.col("_n") * p["n"], F.lit(0.0))
    best = F.transform("labels", lambda x: F.struct(F.greatest(F.lit(0.0), F.coalesce(F.array_max(F.transform(x["ps"], cosine)), F.lit(0.0))).alias("score"), (-x["label_ord"]).alias("minus"), x["label"].alias("label")))
    out = crops.withColumn("_n", n).crossJoin(F.broadcast(table)).withColumn("best", F.array_max(best))
    sure = F.col("best.score") >= threshold
    return out.select(*keys, F.when(sure, F.col("best.label")).otherwise("unspecified").alias("label"), F.when(sure, F.col("best.score")).otherwise(0.0).alias("score"))


def accept_yes(labelled: DataFrame, task: str) -> DataFrame:
    """Helmet and vest: a yes needs a higher score than other labels."""
    return labelled.withColumn("label", F.when((F.col("label") == "yes") & (F.col("score") > YES_ABOVE[task]), "yes").otherwise("no"))


def verify_gate(dets: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Of the verified classes, detections labelled ``negative`` go; ``unspecified`` ones and those without a verdict stay."""
    bad = verdicts.where(F.col("label") == "negative").select("image_id", "det_ord")
    tested = dets.where(F.col("class_name").isin(list(VERIFIED_CLASSES))).join(bad, ["image_id", "det_ord"], "left_semi").select("image_id", "det_ord")
    return dets.join(tested, ["image_id", "det_ord"], "left_anti")


def ocr_verdict(texts: DataFrame, keys: list[str], least: float = 0.3) -> DataFrame:
    """``is_text``: any text of more than ``least``; null where OCR failed (``error``)."""
    return texts.groupBy(*keys).agg(F.when(F.bool_or(F.coalesce(F.col("error").isNotNull(), F.lit(False))), F.lit(None)).otherwise(F.coalesce(F.bool_or(F.col("score") > least), F.lit(False))).alias("is_text"))


def ppe_flags(found: DataFrame, keys: list[str]) -> DataFrame:
    """``helmet`` and ``vest`` from detected names."""
    name = F.lower("name")
    helmet = name.contains("helmet") | name.contains("hard hat")
    vest = ~helmet & (name.contains("vest") | name.contains("visibility") | name.contains("reflective") | name.contains("safety jacket"))
    yes = lambda c: F.when(F.bool_or(c), "yes").otherwise("no")
    return found.groupBy(*keys).agg(yes(helmet).alias("helmet"), yes(vest).alias("vest"))


def best_face(found: DataFrame, keys: list[str]) -> DataFrame:
    """The most confident face of each crop, the first of equals."""
    w = Window.partitionBy(*keys).orderBy(F.desc("confidence"), "det_ord")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def text_attributes(dets: DataFrame) -> DataFrame:
    """What follows for texts: a company's name is a logo; other text with nothing known is none."""
    logo = F.when(F.col("content_type") == "company_name", "yes").when((F.col("is_text") == "yes") & (F.coalesce("is_logo", F.lit("unspecified")) == "unspecified"), "no").otherwise(F.col("is_logo"))
    return dets.withColumn("is_logo", logo)

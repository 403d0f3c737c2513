"""Detection quality: matching, precision and recall, average precision, privacy score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.constants import PRIVACY_WEIGHTS, RECALL_FLOORS
from sitelens.functions.geometry import box_of, iou
from sitelens.operators.folds import sorted_rows


THRESHOLDS = tuple(0.5 + 0.05 * i for i in range(10))


def match_at(predictions: DataFrame, truth: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """``match_predictions`` at each of ``thresholds``, with the ``threshold``: the boxes are grouped once, and each group is folded once a threshold."""
    keys = ["image_id", "class_id"]
    cols = ["det_ord", "confidence", "x1", "y1", "x2", "y2"]
    p = sorted_rows(predictions, keys, [-F.col("confidence"), F.col("det_ord")], cols)
    t = sorted_rows(truth, keys, [F.col("det_ord")], [c for c in cols if c != "confidence"]).withColumnRenamed("rows", "truths")
    both = p.join(t, keys, "left").withColumn("truths", F.coalesce("truths", F.expr("cast(array() as array<struct<det_ord:int,x1:double,y1:double,x2:double,y2:double>>)")))
    empty = F.expr("cast(array() as array<struct<det_ord:int,confidence:double,truth_ord:int>>)")
    # each box with what it overlaps, once for all thresholds
    overlaps = lambda x: F.transform("truths", lambda t: F.struct(iou(box_of(x), box_of(t)).alias("v"), (-t["det_ord"]).alias("minus")))
    both = both.withColumn("seen", F.transform("rows", lambda x: F.struct(x["det_ord"].alias("det_ord"), x["confidence"].alias("confidence"), F.filter(overlaps(x), lambda s: s["v"] >= min(thresholds)).alias("at"))))

    def matched(threshold: float) -> Column:
        def step(acc: Column, x: Column) -> Column:
            free = F.filter(x["at"], lambda s: (s["v"] >= threshold) & ~F.exists(acc, lambda m: m["truth_ord"].eqNullSafe(-s["minus"])))
            return F.concat(acc, F.array(F.struct(x["det_ord"].alias("det_ord"), x["confidence"].alias("confidence"), (-F.array_max(free)["minus"]).alias("truth_ord"))))

        return F.struct(F.lit(threshold).alias("threshold"), F.aggregate("seen", empty, step).alias("m"))

    return both.select(*keys, F.inline(F.array(*map(matched, thresholds)))).select(*keys, "threshold", F.inline("m")).withColumn("tp", F.col("truth_ord").isNotNull())


def match_predictions(predictions: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``image_id``, ``class_id``, ``det_ord``, ``confidence``, ``truth_ord``, ``tp``: best confidence first, each takes the free truth it overlaps most, if by ``threshold``.

    Equal confidences by det_ord; equal overlaps go to the first truth.
    """
    return match_at(predictions, truth, (threshold,)).drop("threshold")


def precision_recall(matches: DataFrame, truth: DataFrame) -> DataFrame:
    """``class_id``, ``tp``, ``fp``, ``fn``, ``precision``, ``recall``, ``f1`` for every class of either side."""
    m = matches.groupBy("class_id").agg(F.count_if("tp").alias("tp"), F.count_if(~F.col("tp")).alias("fp"))
    t = truth.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_truth"))
    j = m.join(t, "class_id", "full").na.fill(0, ["tp", "fp", "n_truth"])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    j = j.withColumns({"fn": F.col("n_truth") - F.col("tp"), "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("n_truth"))})
    return j.withColumn("f1", f1(F.col("precision"), F.col("recall"))).drop("n_truth")


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / F.when(p + r > 0, p + r)).otherwise(0.0)


def _curves(matches: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` (class_id among them), ``tp``, ``fp``, ``ap`` of matches, and ``n_truth`` of their class."""
    steps = matches.groupBy(*keys, "confidence").agg(F.count_if("tp").alias("tp"), F.count(F.lit(1)).alias("n"))
    t = truth.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_truth"))
    down = Window.partitionBy(*keys).orderBy(F.desc("confidence")).rowsBetween(Window.unboundedPreceding, 0)
    curve = steps.withColumns({"ctp": F.sum("tp").over(down), "cn": F.sum("n").over(down)}).join(F.broadcast(t), "class_id", "left")
    curve = curve.withColumns({"precision": F.col("ctp") / F.col("cn"), "gain": F.col("tp") / F.col("n_truth")})
    # from the lowest confidence on: a frame that grows is summed up as it goes, one that shrinks would be made anew for each row
    right = Window.partitionBy(*keys).orderBy("confidence").rowsBetween(Window.unboundedPreceding, 0)
    curve = curve.withColumn("hull", F.max("precision").over(right))
    return curve.groupBy(*keys, "n_truth").agg(F.sum(F.col("hull") * F.col("gain")).alias("ap"), F.sum("tp").alias("tp"), F.sum(F.col("n") - F.col("tp")).alias("fp"))


def average_precision(matches: DataFrame, truth: DataFrame) -> DataFrame:
    """``class_id``, ``ap``: area under the precision-recall curve over all points, precision made monotone from the right.

    Running sums need a class's matches in order: a window by class over narrow rows. Classes are few and may be large,
    so counts are first summed by confidence: a class has as many rows as distinct confidences.
    """
    ap = _curves(matches, truth, ["class_id"]).select("class_id", "ap")
    return truth.select("class_id").distinct().join(ap, "class_id", "left").select("class_id", F.coalesce("ap", F.lit(0.0)).alias("ap"))


def evaluation(predictions: DataFrame, truth: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """``class_id``, ``tp``, ``fp``, ``fn``, ``precision``, ``recall``, ``f1`` at the first threshold, ``ap50`` there and ``ap50_95`` over all, from one matching."""
    by = _curves(match_at(predictions, truth, thresholds), truth, ["class_id", "threshold"])
    first = F.col("threshold") == thresholds[0]
    at = lambda c: F.coalesce(F.max(F.when(first, F.col(c))), F.lit(0)).alias(c)
    found = by.groupBy("class_id").agg(at("tp"), at("fp"), F.coalesce(F.max(F.when(first, F.col("ap"))), F.lit(0.0)).alias("ap50"), (F.coalesce(F.sum("ap"), F.lit(0.0)) / len(thresholds)).alias("ap50_95"))
    n = truth.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_truth"))
    j = found.join(n, "class_id", "full").na.fill(0, ["tp", "fp", "n_truth", "ap50", "ap50_95"])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    j = j.withColumns({"fn": F.col("n_truth") - F.col("tp"), "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("n_truth"))})
    return j.withColumn("f1", f1(F.col("precision"), F.col("recall"))).select("class_id", "tp", "fp", "fn", "precision", "recall", "f1", "ap50", "ap50_95")


def mean_average_precision(predictions: DataFrame, truth: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """``class_id``, ``ap50``, ``ap50_95``."""
    return evaluation(predictions, truth, thresholds).select("class_id", "ap50", "ap50_95")


def privacy_score(recalls: DataFrame) -> DataFrame:
    """``privacy_score`` of ``class_name``, ``recall``: weighted sum, what weight is left to the mean of other classes."""
    weight = F.try_element_at(F.create_map(*(F.lit(x) for kv in PRIVACY_WEIGHTS.items() for x in kv)), F.col("class_name"))
    left = 1.0 - sum(PRIVACY_WEIGHTS.values())
    w = recalls.withColumn("w", weight)
    return w.agg((F.coalesce(F.sum(F.col("w") * F.col("recall")), F.lit(0.0)) + F.coalesce(F.lit(left) * F.avg(F.when(F.col("w").isNull(), F.col("recall"))), F.lit(0.0))).alias("privacy_score"))


def recall_warnings(recalls: DataFrame) -> DataFrame:
    floor = F.try_element_at(F.create_map(*(F.lit(x) for kv in RECALL_FLOORS.items() for x in kv)), F.col("class_name"))
    return recalls.withColumn("floor", floor).where(F.col("recall") < F.col("floor"))

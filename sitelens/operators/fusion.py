"""Weighted box fusion: three rules, each a fold over an image's boxes of one class.

Sums follow the order of the members, so results are the same in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.geometry import Box, box_of, iou
from sitelens.functions.names import min_area
from sitelens.operators.folds import let, sorted_rows


def _mean(c: Column) -> Box:
    return Box(*(c[f"b{k}"] / c["csum"] for k in Box._fields))


def _fresh(x: Column) -> Column:
    return F.struct(*((x[k] * x["confidence"]).alias(f"b{k}") for k in Box._fields), x["confidence"].alias("csum"), F.lit(1).alias("n"), F.array(x["model"]).alias("models"), x.alias("top"))


def _grown(c: Column, x: Column) -> Column:
    return F.struct(*((c[f"b{k}"] + x[k] * x["confidence"]).alias(f"b{k}") for k in Box._fields), (c["csum"] + x["confidence"]).alias("csum"), (c["n"] + 1).alias("n"), F.concat(c["models"], F.array(x["model"])).alias("models"), c["top"].alias("top"))


def _fold(rows: Column, threshold: float, person_guard: bool) -> Column:
    def step(acc: Column, x: Column) -> Column:
        own = box_of(x)
        scored = F.transform(acc, lambda c, i: F.struct(iou(own, _mean(c)).alias("v"), (-i).alias("minus")))
        added = F.concat(acc, F.array(_fresh(x)))

        def merge(best: Column) -> Column:
            at = -best["minus"]
            joins = best["v"] > threshold
            if person_guard:
                rep = _mean(F.get(acc, at))
                wide = F.greatest(own.x2, rep.x2) - F.least(own.x1, rep.x1) > F.greatest(own.width, rep.width) * 1.5
                joins = joins & ~((x["class_name"] == "person") & wide)
            return F.when(joins, F.transform(acc, lambda c, i: F.when(i == at, _grown(c, x)).otherwise(c))).otherwise(added)

        return F.when(F.size(acc) == 0, added).otherwise(let(F.array_max(scored), merge))

    first = F.transform(F.slice(rows, 1, 0), _fresh)
    return F.aggregate(rows, first, step)


def _fused(dets: DataFrame, threshold: float, person_guard: bool) -> DataFrame:
    keys = ["image_id", "class_id"]
    rest = [c for c in dets.columns if c not in keys]
    groups = sorted_rows(dets, keys, [-F.col("confidence"), F.col("det_ord")], rest)
    clusters = groups.select(*keys, F.posexplode(_fold(F.col("rows"), threshold, person_guard)).alias("cluster_ord", "c"))
    own = {*Box._fields, "confidence", "model", "num_fused"}
    kept = [F.col(f"c.top.{c}").alias(c) for c in rest if c not in own]
    models = F.array_join(F.array_sort(F.array_distinct("c.models")), "+")
    return clusters.select(*keys, "cluster_ord", *kept, *_mean(F.col("c")).columns(), (F.col("c.csum") / F.col("c.n")).alias("confidence"), models.alias("model"), F.col("c.n").alias("num_fused"))


def wbf_pipeline(dets: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Boxes under their class's least area go; a box joins the cluster whose mean box it overlaps most, if by over ``threshold``.

    A person that would make its cluster half as wide again as the wider of both begins one of its own. Confidence is the
    members' mean, 1 at most; phrase, attributes and order come from the first member.
    """
    large = dets.where((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) >= min_area(F.col("class_name")))
    return _fused(large, threshold, True).withColumn("confidence", F.least(F.col("confidence"), F.lit(1.0)))


def wbf_module(dets: DataFrame, threshold: float = 0.5, skip: float = 0.0) -> DataFrame:
    """The module's rule: boxes of less confidence than ``skip`` go, no guard. Model names are sorted."""
    return _fused(dets.where(F.col("confidence") >= skip), threshold, False)


def wbf_single_class(dets: DataFrame, threshold: float = 0.30) -> DataFrame:
    """The inference script's rule: in list order, a box takes all later free ones that overlap it (not a mean) by over ``threshold``.

    Confidence is the greatest; ``wbf_fused`` names the model of fused boxes only.
    """
    keys = ["image_id", "class_id"]
    rest = [c for c in dets.columns if c not in keys]
    groups = sorted_rows(dets, keys, [F.col("det_ord")], rest)
    rows = F.col("rows")

    def step(acc: Column, x: Column) -> Column:
        # the first anchor that overlaps; members are kept whole, for weights need their sum first
        hits = F.transform(acc, lambda c, i: F.when(iou(box_of(F.get(c, F.lit(0))), box_of(x)) > threshold, i))
        return let(F.coalesce(F.array_min(F.filter(hits, lambda i: i.isNotNull())), F.lit(-1)), lambda at: F.when(at >= 0, F.transform(acc, lambda c, i: F.when(i == at, F.concat(c, F.array(x))).otherwise(c))).otherwise(F.concat(acc, F.array(F.array(x)))))

    clusters = groups.select(*keys, F.posexplode(F.aggregate(rows, F.transform(F.slice(rows, 1, 0), lambda x: F.array(x)), step)).alias("cluster_ord", "m"))
    m = F.col("m")
    n = F.size(m)
    total = F.aggregate(m, F.lit(0.0), lambda a, x: a + x["confidence"])
    one = F.get(m, F.lit(0))
    clusters = clusters.withColumn("total", total)
    mean = lambda k: F.when(n == 1, one[k]).otherwise(F.aggregate(m, F.lit(0.0), lambda a, x: a + x[k] * (x["confidence"] / F.col("total"))))
    own = {*Box._fields, "confidence", "model", "num_fused"}
    kept = [one[c].alias(c) for c in rest if c not in own]
    return clusters.select(*keys, "cluster_ord", *kept, *(mean(k).alias(k) for k in Box._fields), F.array_max(F.transform(m, lambda x: x["confidence"])).alias("confidence"), F.when(n == 1, one["model"]).otherwise("wbf_fused").alias("model"), n.alias("num_fused"))

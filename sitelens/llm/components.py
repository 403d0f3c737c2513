"""Distributed union-find: alternating large-star and small-star steps on written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import remove, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Component of every node that has an edge.

    ``edges`` has two long columns ``a`` and ``b``. Returns ``node`` and ``root``, the smallest node of its component.
    Each round keeps the graph's components and moves every node closer to its root; the loop ends when a round
    changes nothing. Links, roots and labels stay in tables; the driver sees a count and a checksum a round.
    Nulls take no part; self links give no row; an empty table gives an empty one.
    """
    spark = edges.sparkSession
    start = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    now, path = stored(start, "edges")
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        then, new = stored(small.where("a > b").distinct(), "edges")
        after = _state(then)
        remove(spark, path)
        now, path, same, state = then, new, after == state, after
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

"""Order-dependent operators as folds over a group's sorted rows, inside the JVM.

A group is the detections of one image (or of a class in it), so its array is as small as what detectors find in a picture.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded(table: DataFrame, most: int = 100_000) -> DataFrame:
    """A table of configuration, marked for a broadcast if it has ``most`` rows at most; else the planner chooses."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def sorted_rows(df: DataFrame, keys: list[str], order: Iterable[Column], columns: list[str]) -> DataFrame:
    """``keys`` and ``rows``: the group's ``columns`` as structs, sorted by ``order`` (ascending)."""
    sort = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    listed = F.collect_list(F.struct(*sort, F.struct(*columns).alias("row")))
    if not any("map<" in kind for name, kind in df.dtypes if name in columns):
        return df.groupBy(*keys).agg(F.transform(F.sort_array(listed), lambda x: x["row"]).alias("rows"))
    # maps have no order: the keys are sorted, with the rows' places
    places = F.sort_array(F.transform("listed", lambda x, i: F.struct(*(x[f"_o{k}"].alias(f"_o{k}") for k in range(len(sort))), i.alias("i"))))
    return df.groupBy(*keys).agg(listed.alias("listed")).select(*keys, F.transform(places, lambda k: F.get("listed", k["i"])["row"]).alias("rows"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def keep_greedily(rows: Column, conflict: Callable[[Column, Column], Column]) -> Column:
    """The rows that don't conflict with one kept before: ``conflict(kept, candidate)``."""
    return F.aggregate(rows, F.slice(rows, 1, 0), lambda kept, x: F.when(F.exists(kept, lambda k: conflict(k, x)), kept).otherwise(F.concat(kept, F.array(x))))

"""Order-dependent suppression of overlapping boxes, and first-wins deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import broadcast_if_small, cut

#: Boxes of a group that are folded one by one against all that were kept.
MOST_FOLDED = 512


def _iou(a: Column, b: Column) -> Column:
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    union = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def suppress_overlaps(boxes: DataFrame, keys: list[str], order: list[Column], least_iou: float, position: str) -> DataFrame:
    """The boxes that stay when, in order, each goes that overlaps one kept before it by least_iou or more.

    A box that goes suppresses no other, so this is a fold over each group's boxes, not an anti-join. keys: page, and panel where
    only boxes of one panel compete; position: a column that is unique within the keys and ends the order.
    """
    large = cut(boxes.groupBy(*keys).count().where(F.col("count") > MOST_FOLDED).select(*keys))
    if large.isEmpty():
        return _folded(boxes, keys, order, least_iou, position)
    some = broadcast_if_small(large)
    rest = _folded(boxes.join(some, keys, "left_anti"), keys, order, least_iou, position)
    return rest.unionByName(_by_overlaps(boxes.join(some, keys, "left_semi"), keys, order, least_iou, position))


def _by_overlaps(boxes: DataFrame, keys: list[str], order: list[Column], least_iou: float, position: str) -> DataFrame:
    """The same for groups of many boxes: the pairs that overlap enough are found in a grid, and only those are walked through in order."""
    import pandas as pd

    from .spatial import near_on_page

    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, position))
    ranked = cut(boxes.withColumn("_rank", rank))
    same = F.col("a._rank") < F.col("b._rank")
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    box = lambda side: {c: F.col(f"{side}.{c}") for c in ("x1", "y1", "x2", "y2")}
    pairs = near_on_page(ranked, ranked, [*[F.col(f"a.{k}") for k in keys], F.col("a._rank").alias("_first"), F.col("b._rank").alias("_then")], same & (_iou(box("a"), box("b")) >= least_iou))

    def walk(found: pd.DataFrame) -> pd.DataFrame:
        earlier: dict = {}
        for first, then in zip(found["_first"], found["_then"], strict=True):
            earlier.setdefault(then, []).append(first)
        gone: set = set()
        for then in sorted(earlier):
            if any(first not in gone for first in earlier[then]):
                gone.add(then)
        rows = found.iloc[[0] * len(gone)][keys]
        return rows.assign(_rank=sorted(gone))

    schema = ", ".join(f"{k} {boxes.schema[k].dataType.simpleString()}" for k in keys)
    gone = pairs.groupBy(*keys).applyInPandas(walk, f"{schema}, _rank int")
    return ranked.join(gone, [*keys, "_rank"], "left_anti").select(*boxes.columns)


def _folded(boxes: DataFrame, keys: list[str], order: list[Column], least_iou: float, position: str) -> DataFrame:
    entry = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(position).alias("at"), "x1", "y1", "x2", "y2")
    grouped = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("all"))
    none = F.array().cast(grouped.schema["all"].dataType)
    kept = F.aggregate("all", none, lambda kept, e: F.when(F.exists(kept, lambda k: _iou(k, e) >= least_iou), kept).otherwise(F.array_append(kept, e)))
    stay = grouped.select(*keys, F.explode(F.transform(kept, lambda e: e["at"])).alias(position))
    return boxes.join(stay, [*keys, position], "left_semi")


def first_by_key(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The first row of each key by position."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(position))).where("_n = 1").drop("_n")


def dedupe_candidates(candidates: DataFrame, keys: list[str], position: str, dealt: bool = False) -> tuple[DataFrame, DataFrame]:
    """(candidates without repeats that agree in everything but position, those of an id that still has several).

    keys: region and candidate id. The first of equal candidates stays. With dealt, candidates are dealt out by some of the keys already and stay where they are.
    """
    content = [c for c in candidates.columns if c != position]
    # Dealt out by id, once; repeats go where they are read. A null position is before all others.
    first = F.when(F.count_if(F.col(position).isNull()) == 0, F.min(position)).alias(position)
    once = (candidates if dealt else candidates.repartition(*keys)).groupBy(*content).agg(first).select(*candidates.columns)
    counted = once.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    return once, counted.where("_n > 1").drop("_n")


def distinct_boxes(boxes: Column) -> Column:
    """An array of boxes without exact repeats, in order."""
    return F.array_distinct(boxes)

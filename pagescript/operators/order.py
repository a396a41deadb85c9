"""Reading order: pair features, order edges, panels in rows, balloons by rank in their tournament, pages in sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .boxes import area, center_x, center_y, contains, height, intersection, iou, overlap_x, overlap_y, width

GROUP = ["sequence_id", "page_index"]


def pair_features(balloons: DataFrame, group: list[str] = GROUP, position: str = "pos") -> DataFrame:
    """One row per pair of balloons of a group, a before b by position: overlaps, containment (within 1 px), gaps, same row / column.

    Where balloons have a reference box (ref_x1 to ref_y2, see with_reference), also both centers as shares of it: a_rel_cx to b_rel_cy.
    All pairs of a group are what is asked for: groups are panels, or pages without panels.
    """
    relative = []
    if "ref_x1" in balloons.columns:
        side = lambda s, lo, hi: F.greatest(F.col(f"{s}.ref_{hi}") - F.col(f"{s}.ref_{lo}"), F.lit(1.0))
        for s in ("a", "b"):
            relative += [((center_x(s) - F.col(f"{s}.ref_x1")) / side(s, "x1", "x2")).alias(f"{s}_rel_cx"), ((center_y(s) - F.col(f"{s}.ref_y1")) / side(s, "y1", "y2")).alias(f"{s}_rel_cy")]
    a, b = balloons.alias("a"), balloons.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in group]
    on = F.col(f"a.{position}") < F.col(f"b.{position}")
    for s in same:
        on = on & s
    smaller_h = F.least(height("a"), height("b"))
    smaller_w = F.least(width("a"), width("b"))
    smaller = F.least(area("a"), area("b"))
    return a.join(b, on).select(
        *[F.col(f"a.{k}") for k in group],
        F.col(f"a.{position}").alias("a_pos"),
        F.col(f"b.{position}").alias("b_pos"),
        iou("a", "b").alias("iou"),
        F.when(smaller > 0, intersection("a", "b") / smaller).otherwise(0.0).alias("overlap"),
        contains("a", "b", 1.0).alias("a_contains_b"),
        contains("b", "a", 1.0).alias("b_contains_a"),
        F.greatest(F.greatest(F.col("a.x1"), F.col("b.x1")) - F.least(F.col("a.x2"), F.col("b.x2")), F.lit(0.0)).alias("gap_x"),
        F.greatest(F.greatest(F.col("a.y1"), F.col("b.y1")) - F.least(F.col("a.y2"), F.col("b.y2")), F.lit(0.0)).alias("gap_y"),
        (center_x("b") - center_x("a")).alias("dx"),
        (center_y("b") - center_y("a")).alias("dy"),
        F.when(smaller_h > 0, overlap_y("a", "b") >= 0.6 * smaller_h).otherwise(False).alias("same_row"),
        F.when(smaller_w > 0, overlap_x("a", "b") >= 0.6 * smaller_w).otherwise(False).alias("same_column"),
        *relative,
    )


def with_reference(balloons: DataFrame, panels: DataFrame, pages: DataFrame) -> DataFrame:
    """balloons + ref_x1 to ref_y2: the box of their panel (panel_pos), else the page from 0 to its size, at least 1."""
    boxes = panels.select(*GROUP, "panel_pos", *[F.col(c).alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")])
    joined = balloons.join(boxes, [*GROUP, "panel_pos"], "left").join(pages.select(*GROUP, F.col("width").alias("_w"), F.col("height").alias("_h")), GROUP, "left")
    inside = F.col("_x1").isNotNull()
    page = {"x1": F.lit(0.0), "y1": F.lit(0.0), "x2": F.greatest(F.coalesce("_w", F.lit(0)), F.lit(1)).cast("double"), "y2": F.greatest(F.coalesce("_h", F.lit(0)), F.lit(1)).cast("double")}
    return joined.withColumns({f"ref_{c}": F.when(inside, F.col(f"_{c}")).otherwise(whole) for c, whole in page.items()}).drop("_x1", "_y1", "_x2", "_y2", "_w", "_h")


def order_edges(pairs: DataFrame, group: list[str] = GROUP, rtl: bool | None = True) -> DataFrame:
    """(group, first, second, confidence, rule): which of each pair is read first.

    The one that is contained first; overlapping ones and rows by x; else by y if that differs by more than 10; else by x.
    rtl None: unknown, read as right to left with less confidence. Equal x: by position.
    """
    right_first = rtl is not False
    by_x_conf = F.lit(0.78 if rtl is not None else 0.52)
    a_first_by_x = F.when(F.col("dx") == 0, True).otherwise((F.col("dx") < 0) if right_first else (F.col("dx") > 0))
    by_x = (F.col("overlap") >= 0.6) | F.col("same_row")
    a_first = F.when(F.col("b_contains_a"), False).when(F.col("a_contains_b"), True).when(by_x, a_first_by_x).when(F.abs("dy") > 10, F.col("dy") > 0).otherwise(a_first_by_x)
    x_conf = F.when(F.col("dx") == 0, 0.40).otherwise(by_x_conf)
    confidence = F.when(F.col("b_contains_a") | F.col("a_contains_b"), 0.85).when(by_x, x_conf).when(F.abs("dy") > 10, 0.82).otherwise(x_conf)
    rule = F.when(F.col("b_contains_a") | F.col("a_contains_b"), "containment").when(by_x, "row").when(F.abs("dy") > 10, "vertical").otherwise("horizontal")
    return pairs.select(*group, F.when(a_first, F.col("a_pos")).otherwise(F.col("b_pos")).alias("first"), F.when(a_first, F.col("b_pos")).otherwise(F.col("a_pos")).alias("second"), confidence.alias("confidence"), rule.alias("rule"))


def panel_order(panels: DataFrame, group: list[str] = GROUP, position: str = "panel_pos") -> DataFrame:
    """+ panel_rank (from 0): rows of panels from top to bottom, in a row from right to left.

    Panels in order of (cy, -cx, position) begin a new row where cy rises by more than half the mean height of the two.
    """
    along = Window.partitionBy(*group).orderBy("_cy", F.desc("_cx"), position)
    marked = panels.withColumns({"_cx": center_x(), "_cy": center_y(), "_h": height()})
    jump = (F.col("_cy") - F.lag("_cy").over(along)) / ((F.col("_h") + F.lag("_h").over(along)) / 2) > 0.5
    rows = marked.withColumn("_new", F.coalesce(jump, F.lit(False)).cast("int")).withColumn("_row", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("_row", F.desc("_cx"), "_cy", position)) - 1
    return rows.withColumn("panel_rank", rank).drop("_cx", "_cy", "_h", "_new", "_row")


def balloon_order(balloons: DataFrame, edges: DataFrame, group: list[str] = GROUP, position: str = "pos") -> DataFrame:
    """(group, position, balloon_rank from 0) by topological order of a complete tournament.

    In a tournament the next balloon without open predecessors is the one whose number of predecessors equals its rank, and nobody
    shares that number. Where this ends (a cycle), the rest follows by position.
    """
    # Balloons and their predecessors meet in one exchange by group, which the windows then use too. A balloon that is there several times stays so.
    both = balloons.select(*group, position, F.lit(0).alias("_one"), F.lit(1).alias("_here")).unionByName(edges.select(*group, F.col("second").alias(position), F.lit(1).alias("_one"), F.lit(0).alias("_here")))
    counted = both.repartition(*group).groupBy(*group, position).agg(F.sum("_one").alias("_sum"), F.sum("_here").cast("int").alias("_here")).where("_here > 0")
    ranked = counted.select(*group, position, F.explode(F.array_repeat("_sum", F.col("_here"))).alias("_d"))
    by_d = Window.partitionBy(*group).orderBy("_d", position)
    shared = F.count("*").over(Window.partitionBy(*group, "_d"))
    fits = ranked.withColumn("_ok", (F.row_number().over(by_d) - 1 == F.col("_d")) & (shared == 1))
    broken = F.max((~F.col("_ok")).cast("int")).over(by_d.rowsBetween(Window.unboundedPreceding, 0))
    final = fits.withColumn("_rest", broken)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("_rest", F.when(F.col("_rest") == 0, F.col("_d")).otherwise(F.col(position)))) - 1
    return final.withColumn("balloon_rank", rank).select(*group, position, "balloon_rank")


def story_filter(balloons: DataFrame, adjudications: DataFrame, keys: list[str]) -> DataFrame:
    """balloons but those that an adjudication leaves out of the story; without one a balloon stays."""
    left_out = adjudications.where("NOT include_in_story").select(*keys).distinct()
    return balloons.join(left_out, keys, "left_anti")


def page_order(balloons: DataFrame, panels: DataFrame, rtl: bool | None = True) -> DataFrame:
    """(sequence, page, pos, panel_rank, balloon_rank): balloons with a panel_pos in their panel's place, the others last.

    Balloons are ordered among those of their panel; those without a panel form one group per page.
    """
    keyed = balloons.withColumn("panel_key", F.coalesce("panel_pos", F.lit(-1)))
    group = [*GROUP, "panel_key"]
    ranks = balloon_order(keyed, order_edges(pair_features(keyed, group), group, rtl), group)
    placed = panel_order(panels).select(*GROUP, F.col("panel_pos").alias("panel_key"), "panel_rank")
    return ranks.join(placed, group, "left").select(*GROUP, "pos", "panel_rank", "balloon_rank")


def order_diagnostics(pages: DataFrame, balloons: DataFrame, panels: DataFrame) -> DataFrame:
    """(sequence, page, component, code, pos) of what page_order() had to do without.

    no_layout_panels (no pos): a page without any panel of the layout model with a sound box; balloon_unassigned: a balloon of another page whose panel_pos is
    none of the page's panels, and which is read after all others. panels may have a source; balloons have their panel_pos, as
    best_panel_for_balloon() gives it.
    """
    real = panels.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    real = (real.where("source = 'layout_model'") if "source" in panels.columns else real).select(*GROUP, "panel_pos")
    with_any = real.select(*GROUP).distinct()
    none = pages.select(*GROUP).distinct().join(with_any, GROUP, "left_anti").select(*GROUP, F.lit("panel_order").alias("component"), F.lit("no_layout_panels").alias("code"), F.lit(None).cast(dict(balloons.dtypes)["pos"]).alias("pos"))
    lost = balloons.join(with_any, GROUP, "left_semi").join(real, [*GROUP, "panel_pos"], "left_anti").select(*GROUP, F.lit("panel_assignment").alias("component"), F.lit("balloon_unassigned").alias("code"), "pos")
    return none.unionByName(lost)


def sequence_order(pages: DataFrame) -> DataFrame:
    """+ sequence_position from 0 along pages, panels (those without last) and balloons."""
    along = Window.partitionBy("sequence_id").orderBy("page_index", F.col("panel_rank").isNull(), "panel_rank", "balloon_rank", "pos")
    return pages.withColumn("sequence_position", F.row_number().over(along) - 1)

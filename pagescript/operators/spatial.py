"""Spatial joins: every one is an equi-join on the page with a condition on boxes, then a window that picks the best.

Pages of very many boxes are laid out in a grid: boxes meet in the cells that they share, once, so only neighbours are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import broadcast_if_small, cut
from .boxes import KEYS, area, center_x, center_y, contains, height, intersection, iou, is_valid, overlap_x, overlap_y, width


def on_page(a: DataFrame, b: DataFrame, condition: Column | None = None, how: str = "inner") -> DataFrame:
    on = (F.col("a.sequence_id") == F.col("b.sequence_id")) & (F.col("a.page_index") == F.col("b.page_index"))
    return a.alias("a").join(b.alias("b"), on if condition is None else on & condition, how)


#: Boxes on a page, of either table, from which on it is laid out in a grid.
DENSE = 512


def dense_pages(a: DataFrame, b: DataFrame, reach: Column | float = 0.0) -> DataFrame:
    """(keys, cell_w, cell_h) of pages with more than DENSE boxes in both tables: cells of a mean box, but no more a side than the root of the number of boxes."""
    x1, y1, x2, y2 = _reaching(reach)
    one = lambda df: df.where(is_valid()).groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum(x2 - x1).alias("w"), F.sum(y2 - y1).alias("h"), F.min(x1).alias("l"), F.min(y1).alias("t"), F.max(x2).alias("r"), F.max(y2).alias("o")).where(F.col("n") > DENSE)
    both = one(a) if a is b else one(a).unionByName(one(b))
    of_page = both.groupBy(*KEYS).agg(F.count("*").alias("tables"), *[F.sum(c).alias(c) for c in "nwh"], *[F.min(c).alias(c) for c in "lt"], *[F.max(c).alias(c) for c in "ro"])
    side = lambda total, span: F.greatest(total / F.col("n"), span / F.sqrt("n"), F.lit(1e-9))
    return of_page.where(F.col("tables") == (1 if a is b else 2)).select(*KEYS, side(F.col("w"), F.col("r") - F.col("l")).alias("cell_w"), side(F.col("h"), F.col("o") - F.col("t")).alias("cell_h"))


def _reaching(reach: Column | float) -> list[Column]:
    far = reach if isinstance(reach, Column) else F.lit(float(reach))
    return [F.col("x1") - far, F.col("y1") - far, F.col("x2") + far, F.col("y2") + far]


def _in_cells(boxes: DataFrame, dense: DataFrame, reach: Column | float) -> DataFrame:
    """A row per cell that a box reaches, with the first cell of the box."""
    x1, y1, x2, y2 = _reaching(reach)
    low = {"_fx": F.floor(F.least(x1, x2) / F.col("cell_w")), "_fy": F.floor(F.least(y1, y2) / F.col("cell_h"))}
    laid = boxes.where("x1 + y1 + x2 + y2 IS NOT NULL").join(broadcast_if_small(dense), KEYS).withColumns(low)
    across = F.sequence("_fx", F.floor(F.greatest(x1, x2) / F.col("cell_w")))
    down = F.sequence("_fy", F.floor(F.greatest(y1, y2) / F.col("cell_h")))
    return laid.withColumn("_x", F.explode(across)).withColumn("_y", F.explode(down)).drop("cell_w", "cell_h")


def near_on_page(a: DataFrame, b: DataFrame, columns: list[Column], condition: Column | None = None, keep_a: bool = False, reach: Column | float = 0.0) -> DataFrame:
    """columns of the pairs of boxes of a page that meet the condition; with keep_a also of rows of a with an empty b.

    On pages of more than DENSE boxes pairs whose boxes, each widened by its reach, do not touch are not looked at, so the condition must fail
    for them or the row not matter. There, keep_a gives every row of a once more with an empty b; elsewhere only those without a pair. reach is an
    expression of a box's own columns.
    """
    how = "left" if keep_a else "inner"
    # Where no page of a has so many boxes, which one narrow count says, nothing is asked of b.
    crowded = a.where(is_valid()).groupBy(*KEYS).agg(F.count("*").alias("n")).where(F.col("n") > DENSE)
    dense = None if crowded.isEmpty() else cut(dense_pages(a, b, reach))
    if dense is None or dense.isEmpty():
        return on_page(a, b, condition, how).select(*columns)
    pages = broadcast_if_small(dense.select(*KEYS))
    plain = on_page(a.join(pages, KEYS, "left_anti"), b.join(pages, KEYS, "left_anti"), condition, how).select(*columns)
    cell = (F.col("a._x") == F.col("b._x")) & (F.col("a._y") == F.col("b._y"))
    first = (F.col("a._x") == F.greatest("a._fx", "b._fx")) & (F.col("a._y") == F.greatest("a._fy", "b._fy"))
    laid = on_page(_in_cells(a, dense, reach), _in_cells(b, dense, reach), cell & first if condition is None else cell & first & condition).select(*columns)
    if keep_a:
        laid = laid.unionByName(on_page(a.join(pages, KEYS, "left_semi"), b.limit(0), None, "left").select(*columns))
    return plain.unionByName(laid)


def _coverage(inner: str, outer: str) -> Column:
    """Share of the inner box's area."""
    return F.when(area(inner) > 0, intersection(inner, outer) / area(inner)).otherwise(0.0)


def _if_found(position: str, value: Column) -> Column:
    """0 where an outer join found nothing: greatest and least pass over nulls, so a missing box would look like the box itself."""
    return F.when(F.col(f"b.{position}").isNull(), 0.0).otherwise(F.coalesce(value, F.lit(0.0)))


def _carried(carry: list[str]) -> tuple[list[Column], list[Column]]:
    """Columns of a that come along through a group of its pairs: as joined, and as grouped. What is asked for later needs no join, which would deal all rows out again."""
    return [F.col(f"a.{c}").alias(f"_a_{c}") for c in carry], [F.first(f"_a_{c}").alias(c) for c in carry]


def assign_panels(regions: DataFrame, panels: DataFrame, position: str = "region_pos", carry: list[str] | None = None) -> DataFrame:
    """(keys, position, columns to carry, status, panel_pos, confidence, candidates, covers): the smallest panel that contains a region, else the one that covers it best.

    Containment gives .95 (.5 if the panel's source, where there is such a column, is not layout_model), a cover of .8 or more with a lead of
    .2 gives .65; any other overlap is ambiguous, with all panels that overlap as candidates and their covers, largest first. Without an
    overlap, or with a malformed box, a region is unassigned.
    """
    from_model = F.col("b.source") == "layout_model" if "source" in panels.columns else F.lit(True)
    marked = regions.withColumn("_good", F.coalesce(is_valid(), F.lit(False)))
    cover = F.when(F.col("a._good"), _if_found("panel_pos", _coverage("a", "b"))).otherwise(0.0)
    inside = F.col("a._good") & F.coalesce(contains("b", "a"), F.lit(False))
    joins, firsts = _carried(carry or [])
    columns = [*[F.col(f"a.{k}") for k in KEYS], F.col(f"a.{position}"), F.col("b.panel_pos"), inside.alias("inside"), area("b").alias("panel_area"), from_model.alias("from_model"), cover.alias("cover"), *joins]
    # Panels that a region does not meet say nothing of it, so they are not grouped.
    joined = near_on_page(marked, panels, columns, F.col("a._good") & (inside | (_coverage("a", "b") > 0)), keep_a=True)
    own = [*KEYS, position]
    summary = joined.groupBy(*own).agg(
        *firsts,
        F.min(F.when(F.col("inside"), F.struct("panel_area", "panel_pos", "from_model"))).alias("first"),
        F.sort_array(F.collect_list(F.when(F.col("cover") > 0, F.struct((-F.col("cover")).alias("c"), F.col("panel_pos").alias("p"))))).alias("over"),
    )
    contained, best, second = F.col("first").isNotNull(), -F.get("over", F.lit(0))["c"], F.coalesce(-F.get("over", F.lit(1))["c"], F.lit(0.0))
    sure = F.coalesce((best >= 0.8) & ((F.size("over") == 1) | (best - second >= 0.2)), F.lit(False))
    return summary.select(
        *own,
        *(carry or []),
        F.when(contained | sure, "assigned").when(F.size("over") > 0, "ambiguous").otherwise("unassigned").alias("status"),
        F.when(contained, F.col("first.panel_pos")).when(sure, F.get("over", F.lit(0))["p"]).alias("panel_pos"),
        F.when(contained, F.when(F.col("first.from_model"), 0.95).otherwise(0.5)).when(sure, 0.65).alias("confidence"),
        F.when(contained, F.array("first.panel_pos")).otherwise(F.transform(F.when(sure, F.slice("over", 1, 1)).otherwise(F.col("over")), lambda x: x["p"])).alias("candidates"),
        F.when(contained, F.array().cast("array<double>")).otherwise(F.transform("over", lambda x: -x["c"])).alias("covers"),
    )


def assign_regions_to_balloons(regions: DataFrame, proposals: DataFrame, position: str = "region_pos", carry: list[str] | None = None) -> DataFrame:
    """(keys, position, columns to carry, status, proposal_pos, best, runner_up, candidates, covers) of regions that a proposal covers by a quarter or more.

    Assigned if the best covers half and leads the next compatible one by .15, else ambiguous. candidates and covers: all compatible
    proposals, the best first. Malformed regions are left out.
    """
    cover = _coverage("a", "b")
    joins, firsts = _carried(carry or [])
    joined = near_on_page(regions.where(is_valid()), proposals, [*[F.col(f"a.{k}") for k in KEYS], F.col(f"a.{position}"), F.col("b.proposal_pos"), cover.alias("cover"), *joins], cover >= 0.25)
    grouped = joined.groupBy(*KEYS, position).agg(*firsts, F.sort_array(F.collect_list(F.struct((-F.col("cover")).alias("c"), F.col("proposal_pos").alias("p")))).alias("over"))
    best, second = -F.get("over", F.lit(0))["c"], F.coalesce(-F.get("over", F.lit(1))["c"], F.lit(0.0))
    sure = (best >= 0.5) & (best - second >= 0.15)
    return grouped.select(
        *KEYS, position, *(carry or []), F.when(sure, "assigned").otherwise("ambiguous").alias("status"), F.when(sure, F.get("over", F.lit(0))["p"]).alias("proposal_pos"), best.alias("best"), second.alias("runner_up"),
        F.transform("over", lambda x: x["p"]).alias("candidates"), F.transform("over", lambda x: -x["c"]).alias("covers"),
    )


def reject_cross_panel_groups(members: DataFrame, group: list[str]) -> DataFrame:
    """+ status: all members of a group whose members are in several panels are ambiguous, the others assigned."""
    panels = members.groupBy(*group).agg(F.countDistinct("panel_pos").alias("_panels"))
    return members.join(panels, group).withColumn("status", F.when(F.col("_panels") > 1, "ambiguous").otherwise("assigned")).drop("_panels")


def best_panel_for_balloon(balloons: DataFrame, panels: DataFrame, position: str = "pos", carry: list[str] | None = None) -> DataFrame:
    """(keys, position, columns to carry, panel_pos): the panel that covers most of the balloon, null below a tenth; the first of equals."""
    ratio = _coverage("a", "b")
    joins, firsts = _carried(carry or [])
    joined = near_on_page(balloons, panels, [*[F.col(f"a.{k}") for k in KEYS], F.col(f"a.{position}"), F.col("b.panel_pos"), _if_found("panel_pos", ratio).alias("ratio"), *joins], ratio >= 0.1, keep_a=True)
    best = joined.groupBy(*KEYS, position).agg(*firsts, F.max(F.struct("ratio", (-F.col("panel_pos")).alias("p"))).alias("best"))
    return best.select(*KEYS, position, *(carry or []), F.when(F.col("best.ratio") >= 0.1, -F.col("best.p")).alias("panel_pos"))


def attach_faces(bodies: DataFrame, faces: DataFrame) -> DataFrame:
    """(keys, face_pos, body_pos, cover, candidates): the body that covers .55 of a face with a lead of .15.

    Both have panel_pos; the panels must be equal or one of them unknown. Of orphans body_pos is null, and candidates holds the bodies
    that cover a quarter or more, the best first.
    """
    cover = _coverage("b", "a")
    panel = (F.col("a.panel_pos") == F.col("b.panel_pos")) | F.col("a.panel_pos").isNull() | F.col("b.panel_pos").isNull()
    joined = near_on_page(bodies, faces, [*[F.col(f"b.{k}") for k in KEYS], F.col("b.face_pos"), F.struct((-cover).alias("c"), F.col("a.body_pos").alias("p")).alias("x")], panel)
    over = joined.groupBy(*KEYS, "face_pos").agg(F.array_sort(F.collect_list("x")).alias("over"))
    best, second = -F.get("over", F.lit(0))["c"], F.coalesce(-F.get("over", F.lit(1))["c"], F.lit(0.0))
    sure = F.coalesce((best >= 0.55) & (best - second >= 0.15), F.lit(False))
    possible = F.transform(F.filter(F.coalesce("over", F.array().cast(over.schema["over"].dataType)), lambda x: x["c"] <= -0.25), lambda x: x["p"])
    found = faces.select(*KEYS, "face_pos").join(over, [*KEYS, "face_pos"], "left")
    return found.select(*KEYS, "face_pos", F.when(sure, F.get("over", F.lit(0))["p"]).alias("body_pos"), best.alias("cover"), F.when(~sure, possible).otherwise(F.array().cast(possible_type(bodies))).alias("candidates"))


def possible_type(bodies: DataFrame) -> str:
    return f"array<{dict(bodies.dtypes)['body_pos']}>"


def character_proposals(bodies: DataFrame, faces: DataFrame) -> DataFrame:
    """(keys, kind, body_pos, faces, candidates, diagnostic): a row for each body with its faces in order, one for each orphan face.

    A body's faces go by falling confidence, y1, x1. Orphans (kind face_only) keep the bodies that they may belong to, and say whether there
    are any: ambiguous_face_association or face_without_body. faces needs a confidence.
    """
    attached = attach_faces(bodies, faces).join(faces.select(*KEYS, "face_pos", "confidence", "x1", "y1"), [*KEYS, "face_pos"])
    rank = F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("c"), "y1", "x1", "face_pos")
    own = attached.where("body_pos IS NOT NULL").groupBy(*KEYS, "body_pos").agg(F.transform(F.array_sort(F.collect_list(rank)), lambda f: f["face_pos"]).alias("faces"))
    no_faces, no_bodies = F.array().cast(f"array<{dict(faces.dtypes)['face_pos']}>"), F.array().cast(possible_type(bodies))
    of_bodies = bodies.select(*KEYS, "body_pos").join(own, [*KEYS, "body_pos"], "left").select(*KEYS, F.lit("body").alias("kind"), "body_pos", F.coalesce("faces", no_faces).alias("faces"), no_bodies.alias("candidates"), F.lit(None).cast("string").alias("diagnostic"))
    orphans = attached.where("body_pos IS NULL").select(
        *KEYS, F.lit("face_only").alias("kind"), "body_pos", F.array("face_pos").alias("faces"), "candidates", F.when(F.size("candidates") > 0, "ambiguous_face_association").otherwise("face_without_body").alias("diagnostic")
    )
    return of_bodies.unionByName(orphans)


def spatial_relations(regions: DataFrame, position: str = "region_pos") -> DataFrame:
    """(keys, a_pos, b_pos, strength, method, confidence) of pairs of regions of one panel that belong together.

    Strong: an overlap of .8 of the smaller (.88), of .35 (.76), or neighbours that are aligned by .45 with a small gap (.72). Weak (.40):
    aligned by .2 and near by the smaller sides.
    """
    def gap(lo: str, hi: str) -> Column:
        """How far two boxes are apart along an axis; below 0 by how much they overlap."""
        return F.greatest(f"a.{lo}", f"b.{lo}") - F.least(f"a.{hi}", f"b.{hi}")

    both = contains("a", "b") | contains("b", "a")
    sides = {"_wa": width("a"), "_wb": width("b"), "_ha": height("a"), "_hb": height("b"), "_gx": gap("x1", "x2"), "_gy": gap("y1", "y2"), "_smaller": F.least(area("a"), area("b")), "_within": both}
    columns = [*[F.col(f"a.{k}") for k in KEYS], F.col(f"a.{position}").alias("a_pos"), F.col(f"b.{position}").alias("b_pos"), *[c.alias(n) for n, c in sides.items()]]
    # Gaps are bounded by shares of the larger side of one of the two.
    reach = F.greatest(F.lit(1.6), 1.6 * (F.col("x2") - F.col("x1")), 1.6 * (F.col("y2") - F.col("y1")))
    # Panels are compared after the join, which then goes by page as all others do.
    same = F.coalesce(F.col("a.panel_pos") == F.col("b.panel_pos"), F.col("a.panel_pos").isNull() & F.col("b.panel_pos").isNull())
    pairs = near_on_page(regions, regions, columns, (F.col(f"a.{position}") < F.col(f"b.{position}")) & same, reach=reach)
    wa, wb, ha, hb = F.col("_wa"), F.col("_wb"), F.col("_ha"), F.col("_hb")
    gap_x, gap_y, over_x, over_y = (F.greatest(c, F.lit(0.0)) for c in (F.col("_gx"), F.col("_gy"), -F.col("_gx"), -F.col("_gy")))
    measured = pairs.select(
        *KEYS, "a_pos", "b_pos", "_within", F.when(F.col("_smaller") > 0, over_x * over_y / F.col("_smaller")).otherwise(0.0).alias("_over"), gap_x.alias("_gap_x"), gap_y.alias("_gap_y"), (over_x / F.least(wa, wb)).alias("_along_x"), (over_y / F.least(ha, hb)).alias("_along_y"),
        F.greatest(ha, hb).alias("_tall"), F.greatest(wa, wb).alias("_wide"), F.greatest(F.lit(1.0), F.least(ha, hb), F.least(wa, wb)).alias("_small"),
    )
    over, along_x, along_y = F.col("_over"), F.col("_along_x"), F.col("_along_y")
    near = F.sqrt(F.col("_gap_x") * F.col("_gap_x") + F.col("_gap_y") * F.col("_gap_y")) / F.col("_small") <= 1.6
    neighbours = ((along_x >= 0.45) & (F.col("_gap_y") <= 0.55 * F.col("_tall"))) | ((along_y >= 0.45) & (F.col("_gap_x") <= 0.4 * F.col("_wide")))
    confidence = F.when(over >= 0.8, 0.88).when(over >= 0.35, 0.76).when(neighbours, 0.72).when(near & ((along_x >= 0.2) | (along_y >= 0.2)), 0.40)
    judged = measured.select(*KEYS, "a_pos", "b_pos", F.when((over >= 0.8) & F.col("_within"), "containment").otherwise("geometry").alias("method"), confidence.alias("confidence"), F.monotonically_increasing_id().alias("_row"))
    # The row number keeps this filter, and all that it is made of, out of the join's condition: written out there, it is too long to be compiled.
    found = judged.where((F.col("_row") >= 0) & F.col("confidence").isNotNull()).drop("_row")
    return found.withColumn("strength", F.when(F.col("confidence") == 0.40, "weak").otherwise("strong"))


def speaker_candidates(balloons: DataFrame, characters: DataFrame, pages: DataFrame, tails: DataFrame | None = None, panels: DataFrame | None = None) -> DataFrame:
    """(keys, pos, character_pos + features): the characters of the balloon's panel if it has any, otherwise all of the page.

    Features: same_panel, center_distance_px, center_distance, overlap (of the smaller), box_distance, face_distance, tail_distance_px, tail_distance,
    tail_inside, tail_alignment (cosine), face_available, body_available, dx, dy; distances without px are shares of the page's diagonal.
    characters may have a face (face_x1 to face_y2) and has_body; tails: (keys, pos, tail_x, tail_y). With panels (panel_pos, source) only
    panels of the layout model count, and same_panel is null for a balloon outside of them. Malformed boxes are left out; what a balloon or character
    lacks is null.
    """
    faces = "face_x1" in characters.columns
    box = [F.col(f"face_{c}") if faces else F.lit(None).cast("double").alias(f"face_{c}") for c in ("x1", "y1", "x2", "y2")]
    body = F.col("has_body") if "has_body" in characters.columns else F.lit(True)
    people = characters.where(is_valid()).select(*KEYS, "character_pos", "panel_pos", "x1", "y1", "x2", "y2", *box, body.alias("has_body"))
    speech = balloons.where(is_valid()).select(*KEYS, "pos", "panel_pos", "x1", "y1", "x2", "y2")
    tails = speech.select(*KEYS, "pos").limit(0).withColumns({"tail_x": F.lit(0.0), "tail_y": F.lit(0.0)}) if tails is None else tails.select(*KEYS, "pos", "tail_x", "tail_y")
    speech = speech.join(tails, [*KEYS, "pos"], "left")
    if panels is not None:
        real = panels.where("source = 'layout_model'").select(*KEYS, "panel_pos").distinct().withColumn("_real", F.lit(True))
        speech = speech.join(real, [*KEYS, "panel_pos"], "left").withColumn("in_panel", F.coalesce("_real", F.lit(False)))
        same = F.when(F.col("a.in_panel"), F.coalesce(F.col("a.panel_pos") == F.col("b.panel_pos"), F.lit(False)))
    else:
        same = F.coalesce(F.col("a.panel_pos") == F.col("b.panel_pos"), F.lit(False))
    joined = on_page(speech, people).join(pages.alias("p"), (F.col("a.sequence_id") == F.col("p.sequence_id")) & (F.col("a.page_index") == F.col("p.page_index")))
    w, h = F.col("p.width"), F.col("p.height")
    diagonal = F.when((w > 0) & (h > 0), F.sqrt(w * w + h * h))
    between = lambda lo, hi: F.greatest(F.greatest(F.col(f"a.{lo}"), F.col(f"b.{lo}")) - F.least(F.col(f"a.{hi}"), F.col(f"b.{hi}")), F.lit(0.0))
    hypot = lambda x, y: F.sqrt(x * x + y * y)

    def beyond(x: Column, y: Column, side: str) -> Column:
        """How far a point is from a box of b; greatest() passes over nulls, so a missing point or box is asked for."""
        x1, y1, x2, y2 = (F.col(f"b.{side}{c}") for c in ("x1", "y1", "x2", "y2"))
        away = hypot(F.greatest(x1 - x, x - x2, F.lit(0.0)), F.greatest(y1 - y, y - y2, F.lit(0.0)))
        return F.when(x.isNotNull() & y.isNotNull() & (x2 > x1) & (y2 > y1), away)

    dx, dy = center_x("b") - center_x("a"), center_y("b") - center_y("a")
    smaller = F.least(area("a"), area("b"))
    tx, ty = F.col("a.tail_x"), F.col("a.tail_y")
    along, across_ = tx - center_x("a"), ty - center_y("a")
    lengths = hypot(along, across_) * hypot(dx, dy)
    rows = joined.select(
        *[F.col(f"a.{k}") for k in KEYS],
        F.col("a.pos"),
        F.col("b.character_pos"),
        same.alias("same_panel"),
        hypot(dx, dy).alias("center_distance_px"),
        (hypot(dx, dy) / diagonal).alias("center_distance"),
        (hypot(between("x1", "x2"), between("y1", "y2")) / diagonal).alias("box_distance"),
        F.when(smaller > 0, intersection("a", "b") / smaller).otherwise(0.0).alias("overlap"),
        (beyond(center_x("a"), center_y("a"), "face_") / diagonal).alias("face_distance"),
        beyond(tx, ty, "").alias("tail_distance_px"),
        (beyond(tx, ty, "") / diagonal).alias("tail_distance"),
        (tx.between(F.col("b.x1"), F.col("b.x2")) & ty.between(F.col("b.y1"), F.col("b.y2"))).alias("tail_inside"),
        F.when(lengths > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (along * dx + across_ * dy) / lengths))).alias("tail_alignment"),
        F.col("b.face_x1").isNotNull().alias("face_available"),
        F.col("b.has_body").alias("body_available"),
        (dx / w).alias("dx"),
        (dy / h).alias("dy"),
    )
    any_same = F.coalesce(F.max("same_panel").over(Window.partitionBy(*KEYS, "pos")), F.lit(False))
    return rows.withColumn("_any", any_same).where("same_panel OR NOT _any").drop("_any")


def reconstruct_blocks(predictions: DataFrame, truths: DataFrame) -> DataFrame:
    """(keys, gt_pos, text, confidence, members): predictions with the center within 2 px of a true box, or half their area in it.

    Texts are joined from top to bottom; a prediction may serve several boxes.
    """
    near = center_x("a").between(F.col("b.x1") - 2, F.col("b.x2") + 2) & center_y("a").between(F.col("b.y1") - 2, F.col("b.y2") + 2)
    belongs = near | (_coverage("a", "b") >= 0.5)
    columns = [*[F.col(f"b.{k}") for k in KEYS], F.col("b.gt_pos"), F.struct(F.col("a.y1"), F.col("a.x1"), F.col("a.region_pos"), F.col("a.text")).alias("t"), F.col("a.confidence")]
    rows = near_on_page(predictions, truths, columns, belongs, reach=2.0)
    return rows.groupBy(*KEYS, "gt_pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["text"]), " ").alias("text"), F.avg("confidence").alias("confidence"), F.count("*").alias("members"))


def story_membership(predictions: DataFrame, truths: DataFrame) -> DataFrame:
    """(keys, inside, outside): predictions with their center in any true box of the page, and the others."""
    hit = center_x("a").between(F.col("b.x1"), F.col("b.x2")) & center_y("a").between(F.col("b.y1"), F.col("b.y2"))
    numbered = cut(predictions.withColumn("_row", F.monotonically_increasing_id()))
    inside = near_on_page(numbered, truths, [*[F.col(f"a.{k}") for k in KEYS], F.col("a._row")], hit).distinct().groupBy(*KEYS).agg(F.count("*").alias("inside"))
    everything = predictions.groupBy(*KEYS).agg(F.count("*").alias("n"))
    return everything.join(inside, KEYS, "left").select(*KEYS, F.coalesce("inside", F.lit(0)).alias("inside"), (F.col("n") - F.coalesce("inside", F.lit(0))).alias("outside"))


def match_truth_to_balloons(truths: DataFrame, balloons: DataFrame, least: float = 0.05) -> DataFrame:
    """(keys, gt_pos, pos, iou, coverage_failure): the balloon of largest IoU, the first of equals, if it is above least."""
    joined = near_on_page(truths, balloons, [*[F.col(f"a.{k}") for k in KEYS], F.col("a.gt_pos"), F.col("b.pos"), _if_found("pos", iou("a", "b")).alias("iou")], keep_a=True)
    best = joined.groupBy(*KEYS, "gt_pos").agg(F.max(F.struct("iou", (-F.col("pos")).alias("p"))).alias("m"))
    hit = F.col("m.iou") > least
    return best.select(*KEYS, "gt_pos", F.when(hit, -F.col("m.p")).alias("pos"), F.col("m.iou").alias("iou"), (~hit).alias("coverage_failure"))


def character_panels(characters: DataFrame, panels: DataFrame) -> DataFrame:
    """(keys, character_pos, panel_pos) by the rule of assign_panels among panels of the layout model; null where it is not sure."""
    if "source" in panels.columns:
        panels = panels.where("source = 'layout_model'")
    return assign_panels(characters, panels, "character_pos").select(*KEYS, "character_pos", "panel_pos")


def join_oracle(blocks: DataFrame, oracle: DataFrame, least_iou: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """(blocks with their oracle row and a drift flag, oracle keys that occur twice).

    blocks count pages from 1, oracle rows from 0. Blocks without an oracle row stay.
    """
    a = blocks.withColumn("page_index", F.col("page_index") - 1)
    repeated = oracle.groupBy(*KEYS, "block_pos").count().where("count > 1").drop("count")
    on = (F.col("a.sequence_id") == F.col("b.sequence_id")) & (F.col("a.page_index") == F.col("b.page_index")) & (F.col("a.block_pos") == F.col("b.block_pos"))
    same = F.when(F.col("b.block_pos").isNotNull(), iou("a", "b"))
    joined = a.alias("a").join(oracle.alias("b"), on, "left").select(*[F.col(f"a.{k}") for k in KEYS], F.col("a.block_pos"), F.col("b.block_pos").isNotNull().alias("matched"), same.alias("iou"), (same < least_iou).alias("drift"))
    return joined, repeated

"""Queries of boxes, spatial joins, layout and order over the views of the driver tables, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import hold, load, with_views
from ..functions.tables import rounded
from ..operators import boxes, layout, order, spatial, speakers, suppress

K = ["sequence_id", "page_index"]
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql, *views)
        return f

    return add


# SQL of boxes a and b, as the column builders have it.
OX, OY = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0.0e0)", "greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0.0e0)"
INTER = f"({OX} * {OY})"
AREA = lambda t: f"(greatest({t}.x2 - {t}.x1, 0.0e0) * greatest({t}.y2 - {t}.y1, 0.0e0))"
PAGE = "a.sequence_id = b.sequence_id AND a.page_index = b.page_index"
INSIDE = "(b.x1 <= a.x1 AND b.y1 <= a.y1 AND b.x2 >= a.x2 AND b.y2 >= a.y2)"


@query(
    """SELECT r.sequence_id, r.page_index, r.region_pos, greatest(x2 - x1, 0.0e0) * greatest(y2 - y1, 0.0e0) AS area, (x1 + x2) / 2 AS center_x, (y1 + y2) / 2 AS center_y,
    x2 - x1 AS box_width, y2 - y1 AS box_height, round((x2 - x1) / (y2 - y1), 6) AS aspect, round(greatest(x2 - x1, 0.0e0) * greatest(y2 - y1, 0.0e0) / (p.width * p.height), 6) AS area_ratio,
    CASE WHEN y2 - y1 > 1.35e0 * (x2 - x1) THEN 'vertical' ELSE 'horizontal' END AS orientation FROM fx_regions r JOIN fx_pages p USING (sequence_id, page_index)""",
    "fx_regions", "fx_pages",
)
def b1_box_features(spark, sf_dir):
    regions, pages = load(spark, sf_dir, "fx_regions", "fx_pages")
    return boxes.box_features(regions, pages).select(*K, "region_pos", "area", "center_x", "center_y", "box_width", "box_height", rounded("aspect", 6).alias("aspect"), rounded("area_ratio", 6).alias("area_ratio"), "orientation")


@query(
    """SELECT sequence_id, page_index, count(*) FILTER (x2 > x1 AND y2 > y1) AS good, count(*) FILTER (NOT (x2 > x1 AND y2 > y1)) AS rejected
    FROM (SELECT sequence_id, page_index, x1, y1, CASE WHEN k = 2 THEN x1 - 1 ELSE x2 END AS x2, CASE WHEN k = 3 THEN y1 ELSE y2 END AS y2 FROM fx_regions) GROUP BY ALL""",
    "fx_regions",
)
def b2_valid_boxes(spark, sf_dir):
    (regions,) = load(spark, sf_dir, "fx_regions")
    broken = regions.withColumns({"x2": F.when(F.col("k") == 2, F.col("x1") - 1).otherwise(F.col("x2")), "y2": F.when(F.col("k") == 3, F.col("y1")).otherwise(F.col("y2"))})
    good, bad = boxes.valid_boxes(broken)
    both = good.select(*K, F.lit(1).alias("g")).unionByName(bad.select(*K, F.lit(0).alias("g")))
    return both.groupBy(*K).agg(F.sum("g").alias("good"), F.sum(1 - F.col("g")).alias("rejected"))


@query(
    """SELECT * FROM (SELECT b.sequence_id, b.page_index, proposal_pos, least(greatest(x1 - 40, 0.0e0), width) AS x1, least(greatest(y1 - 40, 0.0e0), height) AS y1,
    least(greatest(x2 + 300, 0.0e0), width) AS x2, least(greatest(y2 + 300, 0.0e0), height) AS y2 FROM fx_balloons b JOIN fx_pages p USING (sequence_id, page_index)) WHERE x2 > x1 AND y2 > y1""",
    "fx_balloons", "fx_pages",
)
def b3_clip_boxes(spark, sf_dir):
    balloons, pages = load(spark, sf_dir, "fx_balloons", "fx_pages")
    wide = balloons.select(*K, "proposal_pos", (F.col("x1") - 40).alias("x1"), (F.col("y1") - 40).alias("y1"), (F.col("x2") + 300).alias("x2"), (F.col("y2") + 300).alias("y2"))
    return boxes.clip_boxes(wide, pages)


@query(
    """SELECT sequence_id, page_index, region_pos, reason, CASE WHEN reason IS NULL THEN l END AS "left", CASE WHEN reason IS NULL THEN t END AS top, CASE WHEN reason IS NULL THEN r END AS "right", CASE WHEN reason IS NULL THEN b END AS bottom
    FROM (SELECT *, CASE WHEN x2 <= x1 OR y2 <= y1 THEN 'degenerate' WHEN l >= r OR t >= b THEN 'outside_page' END AS reason FROM (
      SELECT sequence_id, page_index, region_pos, x1, y1, x2, y2, greatest(CAST(floor(x1) AS BIGINT), 0) AS l, greatest(CAST(floor(y1) AS BIGINT), 0) AS t, least(CAST(ceil(x2) AS BIGINT), width) AS r, least(CAST(ceil(y2) AS BIGINT), height) AS b
      FROM (SELECT sequence_id, page_index, region_pos, x1 + 500.25e0 AS x1, y1 - 0.5e0 AS y1, CASE WHEN k = 7 THEN x1 ELSE x2 + 500.25e0 END AS x2, y2 FROM fx_regions) JOIN fx_pages USING (sequence_id, page_index)))""",
    "fx_regions", "fx_pages",
)
def b4_crop_windows(spark, sf_dir):
    regions, pages = load(spark, sf_dir, "fx_regions", "fx_pages")
    moved = regions.select(*K, "region_pos", (F.col("x1") + 500.25).alias("x1"), (F.col("y1") - 0.5).alias("y1"), F.when(F.col("k") == 7, F.col("x1")).otherwise(F.col("x2") + 500.25).alias("x2"), "y2")
    return boxes.crop_windows(moved, pages).drop("x1", "y1", "x2", "y2")


@query(
    """SELECT sequence_id, page_index, region_pos, least(a, c) AS x1, least(b, d) AS y1, greatest(a, c) AS x2, greatest(b, d) AS y2 FROM (
    SELECT sequence_id, page_index, region_pos, rx1 + CASE WHEN rel THEN x1 * (rx2 - rx1) ELSE x1 END AS a, ry1 + CASE WHEN rel THEN y1 * (ry2 - ry1) ELSE y1 END AS b,
      rx1 + CASE WHEN rel THEN x2 * (rx2 - rx1) ELSE x2 END AS c, ry1 + CASE WHEN rel THEN y2 * (ry2 - ry1) ELSE y2 END AS d FROM (
      SELECT *, greatest(abs(x1), abs(y1), abs(x2), abs(y2)) <= 1.5e0 AS rel FROM (SELECT sequence_id, page_index, region_pos, x1 AS rx1, y1 AS ry1, x2 AS rx2, y2 AS ry2,
        CASE WHEN k % 2 = 0 THEN 0.75e0 ELSE 12.0e0 END AS x1, 0.25e0 AS y1, CASE WHEN k % 2 = 0 THEN 0.5e0 ELSE 2.0e0 END AS x2, 1.0e0 AS y2 FROM fx_regions)))""",
    "fx_regions",
)
def b5_rescale_boxes(spark, sf_dir):
    (regions,) = load(spark, sf_dir, "fx_regions")
    even = F.col("k") % 2 == 0
    inner = regions.select(*K, "region_pos", F.col("x1").alias("rx1"), F.col("y1").alias("ry1"), F.col("x2").alias("rx2"), F.col("y2").alias("ry2"), F.when(even, 0.75).otherwise(12.0).alias("x1"), F.lit(0.25).alias("y1"), F.when(even, 0.5).otherwise(2.0).alias("x2"), F.lit(1.0).alias("y2"))
    return boxes.rescale_boxes(inner).select(*K, "region_pos", "x1", "y1", "x2", "y2")


@query(
    """SELECT sequence_id, page_index, CASE k % 4 WHEN 0 THEN 'body' ELSE 'face' END AS category,
    'p' || page_index || '-' || CASE k % 4 WHEN 0 THEN 'body' ELSE 'face' END || '-' || CAST(x1 AS BIGINT) || '-' || CAST(y1 AS BIGINT) || '-' || CAST(x2 AS BIGINT) || '-' || CAST(y2 AS BIGINT) AS detection_id, confidence
    FROM fx_regions WHERE confidence BETWEEN 0.3e0 AND 1 AND k % 4 < 2""",
    "fx_regions",
)
def b6_filter_detections(spark, sf_dir):
    (regions,) = load(spark, sf_dir, "fx_regions")
    detections = regions.withColumn("class_id", (F.col("k") % 4).cast("int"))
    return boxes.filter_detections(detections, 0.3, {0: "body", 1: "face"}).select(*K, "category", "detection_id", "confidence")


@query(
    """SELECT sequence_id, page_index, region_pos, x1, y1, x1 + w AS x2, y1 + h AS y2, CASE WHEN score BETWEEN 0 AND 1 THEN score END AS confidence
    FROM (SELECT *, x2 - x1 - 40 AS w, y2 - y1 - 20 AS h, confidence * 1.5e0 AS score FROM fx_regions) WHERE w > 0 AND h > 0""",
    "fx_regions",
)
def b7_detection_boxes(spark, sf_dir):
    (regions,) = load(spark, sf_dir, "fx_regions")
    blocks = regions.select(*K, "region_pos", F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1") - 40).alias("w"), (F.col("y2") - F.col("y1") - 20).alias("h"), (F.col("confidence") * 1.5).alias("score"))
    return boxes.detection_boxes(blocks)


_J1 = f"""WITH j AS (SELECT a.sequence_id, a.page_index, a.region_pos, b.panel_pos, {INSIDE} AS inside, {AREA("b")} AS panel_area, {INTER} / {AREA("a")} AS cover FROM fx_regions a JOIN fx_panels b ON {PAGE} AND {INTER} > 0),
  g AS (SELECT sequence_id, page_index, region_pos, (list(panel_pos ORDER BY panel_area, panel_pos) FILTER (inside))[1] AS fp, list(panel_pos ORDER BY cover DESC, panel_pos) AS ps, list(cover ORDER BY cover DESC, panel_pos) AS cs FROM j GROUP BY ALL),
  s AS (SELECT *, fp IS NULL AND cs[1] >= 0.8e0 AND (len(cs) = 1 OR cs[1] - cs[2] >= 0.2e0) AS sure FROM g)
  SELECT sequence_id, page_index, region_pos, CASE WHEN fp IS NOT NULL OR sure THEN 'assigned' WHEN ps IS NOT NULL THEN 'ambiguous' ELSE 'unassigned' END AS status, coalesce(fp, CASE WHEN sure THEN ps[1] END) AS panel_pos,
  CASE WHEN fp IS NOT NULL THEN 0.95e0 WHEN sure THEN 0.65e0 END AS confidence, CASE WHEN fp IS NOT NULL THEN [fp] WHEN sure THEN [ps[1]] ELSE coalesce(ps, []) END AS candidates,
  CASE WHEN fp IS NOT NULL OR cs IS NULL THEN [] ELSE list_transform(cs, lambda c: round(c, 6)) END AS covers FROM fx_regions LEFT JOIN s USING (sequence_id, page_index, region_pos)"""


@query(_J1, "fx_regions", "fx_panels")
def j1_assign_panels(spark, sf_dir):
    return spatial.assign_panels(*load(spark, sf_dir, "fx_regions", "fx_panels")).withColumn("covers", F.transform("covers", lambda c: rounded(c, 6)))


_J2 = f"""WITH j AS (SELECT a.sequence_id, a.page_index, a.region_pos, b.proposal_pos, {INTER} / {AREA("a")} AS cover FROM fx_regions a JOIN fx_balloons b ON {PAGE} AND {INTER} / {AREA("a")} >= 0.25e0),
  g AS (SELECT sequence_id, page_index, region_pos, list(proposal_pos ORDER BY cover DESC, proposal_pos) AS ps, list(cover ORDER BY cover DESC, proposal_pos) AS cs FROM j GROUP BY ALL),
  s AS (SELECT *, cs[1] >= 0.5e0 AND cs[1] - coalesce(cs[2], 0) >= 0.15e0 AS sure FROM g)
  SELECT sequence_id, page_index, region_pos, CASE WHEN sure THEN 'assigned' ELSE 'ambiguous' END AS status, CASE WHEN sure THEN ps[1] END AS proposal_pos, round(cs[1], 6) AS best, round(coalesce(cs[2], 0), 6) AS runner_up,
  ps AS candidates, list_transform(cs, lambda c: round(c, 6)) AS covers FROM s"""


@query(_J2, "fx_regions", "fx_balloons")
def j2_regions_to_balloons(spark, sf_dir):
    found = spatial.assign_regions_to_balloons(*load(spark, sf_dir, "fx_regions", "fx_balloons"))
    return found.withColumns({"best": rounded("best", 6), "runner_up": rounded("runner_up", 6), "covers": F.transform("covers", lambda c: rounded(c, 6))})


@query(
    """SELECT sequence_id, page_index, k, region_pos, CASE WHEN max(p) OVER w > min(p) OVER w THEN 'ambiguous' ELSE 'assigned' END AS status
    FROM (SELECT *, CAST(floor(x1 / 600) + 2 * floor(y1 / 750) AS INT) AS p FROM fx_regions) WINDOW w AS (PARTITION BY sequence_id, page_index, k)""",
    "fx_regions",
)
def j3_cross_panel_groups(spark, sf_dir):
    (regions,) = load(spark, sf_dir, "fx_regions")
    members = regions.select(*K, "k", "region_pos", (F.floor(F.col("x1") / 600) + 2 * F.floor(F.col("y1") / 750)).cast("int").alias("panel_pos"))
    return spatial.reject_cross_panel_groups(members, [*K, "k"]).drop("panel_pos")


_J4 = f"""WITH j AS (SELECT a.sequence_id, a.page_index, a.region_pos AS pos, b.panel_pos, CASE WHEN b.panel_pos IS NULL THEN 0 ELSE {INTER} / {AREA("a")} END AS ratio FROM fx_regions a LEFT JOIN fx_panels b ON {PAGE})
  SELECT sequence_id, page_index, pos, CASE WHEN ratio >= 0.1e0 THEN panel_pos END AS panel_pos FROM (SELECT *, row_number() OVER (PARTITION BY sequence_id, page_index, pos ORDER BY ratio DESC, panel_pos) AS n FROM j) WHERE n = 1"""


@query(_J4, "fx_regions", "fx_panels")
def j4_best_panel(spark, sf_dir):
    regions, panels = load(spark, sf_dir, "fx_regions", "fx_panels")
    return spatial.best_panel_for_balloon(regions.withColumnRenamed("region_pos", "pos"), panels)


_J6 = f"""WITH bodies AS (SELECT sequence_id, page_index, character_pos, x1, y1, x2, y2, CASE WHEN character_pos % 3 = 0 THEN NULL ELSE character_pos % 2 END AS pp FROM fx_characters),
  faces AS (SELECT sequence_id, page_index, character_pos, x1 + 40 AS x1, y1 + 10 AS y1, x2 - 40 AS x2, y1 + 100 AS y2, character_pos % 2 AS pp FROM fx_characters WHERE has_face),
  j AS (SELECT b.sequence_id, b.page_index, b.character_pos AS face_pos, a.character_pos AS body_pos, {INTER} / {AREA("b")} AS cover FROM bodies a JOIN faces b ON {PAGE} AND (a.pp = b.pp OR a.pp IS NULL OR b.pp IS NULL)),
  g AS (SELECT sequence_id, page_index, face_pos, list(body_pos ORDER BY cover DESC, body_pos) AS ps, list(cover ORDER BY cover DESC, body_pos) AS cs FROM j GROUP BY ALL),
  s AS (SELECT *, cs[1] >= 0.55e0 AND cs[1] - coalesce(cs[2], 0) >= 0.15e0 AS sure FROM g),
  a AS (SELECT f.*, f.character_pos AS face_pos, CASE WHEN sure THEN ps[1] END AS body_pos, round(cs[1], 6) AS cover, CASE WHEN sure OR ps IS NULL THEN [] ELSE ps[1:len(list_filter(cs, lambda c: c >= 0.25e0))] END AS candidates
    FROM faces f LEFT JOIN s ON f.sequence_id = s.sequence_id AND f.page_index = s.page_index AND f.character_pos = s.face_pos)"""
#: A face's confidence, for the order of a body's faces.
_FACE = "((character_pos * 7) % 10) / 10.0e0"


def _bodies_and_faces(spark, sf_dir):
    (characters,) = load(spark, sf_dir, "fx_characters")
    at = F.col("character_pos")
    bodies = characters.select(*K, at.alias("body_pos"), "x1", "y1", "x2", "y2", F.when(at % 3 != 0, at % 2).alias("panel_pos"))
    faces = characters.where("has_face").select(
        *K, at.alias("face_pos"), (F.col("x1") + 40).alias("x1"), (F.col("y1") + 10).alias("y1"), (F.col("x2") - 40).alias("x2"), (F.col("y1") + 100).alias("y2"), (at % 2).alias("panel_pos"), ((at * 7) % 10 / 10.0).alias("confidence")
    )
    return bodies, faces


@query(f"{_J6} SELECT sequence_id, page_index, face_pos, body_pos, cover, candidates FROM a", "fx_characters")
def j6_attach_faces(spark, sf_dir):
    return spatial.attach_faces(*_bodies_and_faces(spark, sf_dir)).withColumn("cover", rounded("cover", 6))


@query(
    f"""{_J6} SELECT b.sequence_id, b.page_index, 'body' AS kind, b.character_pos AS body_pos, coalesce(n, []) AS faces, [] AS candidates, NULL AS diagnostic
    FROM bodies b LEFT JOIN (SELECT sequence_id, page_index, body_pos, list(face_pos ORDER BY {_FACE} DESC, y1, x1, face_pos) AS n FROM a WHERE body_pos IS NOT NULL GROUP BY ALL) o
    ON b.sequence_id = o.sequence_id AND b.page_index = o.page_index AND b.character_pos = o.body_pos
    UNION ALL SELECT sequence_id, page_index, 'face_only', NULL, [face_pos], candidates, CASE WHEN len(candidates) > 0 THEN 'ambiguous_face_association' ELSE 'face_without_body' END FROM a WHERE body_pos IS NULL""",
    "fx_characters",
)
def j6_character_proposals(spark, sf_dir):
    return spatial.character_proposals(*_bodies_and_faces(spark, sf_dir))


_GX, _GY = "greatest(greatest(a.x1, b.x1) - least(a.x2, b.x2), 0.0e0)", "greatest(greatest(a.y1, b.y1) - least(a.y2, b.y2), 0.0e0)"
_J7 = f"""WITH r AS (SELECT *, CAST(floor(x1 / 600) AS INT) AS p FROM fx_regions),
  j AS (SELECT a.sequence_id, a.page_index, a.region_pos AS a_pos, b.region_pos AS b_pos, {INTER} / least({AREA("a")}, {AREA("b")}) AS over, {OX} / least(a.x2 - a.x1, b.x2 - b.x1) AS ax, {OY} / least(a.y2 - a.y1, b.y2 - b.y1) AS ay,
    {_GX} AS gx, {_GY} AS gy, least(a.y2 - a.y1, b.y2 - b.y1) AS h, least(a.x2 - a.x1, b.x2 - b.x1) AS w, greatest(a.y2 - a.y1, b.y2 - b.y1) AS hh, greatest(a.x2 - a.x1, b.x2 - b.x1) AS ww,
    (a.x1 <= b.x1 AND a.y1 <= b.y1 AND a.x2 >= b.x2 AND a.y2 >= b.y2) OR {INSIDE} AS inside FROM r a JOIN r b ON {PAGE} AND a.p = b.p AND a.region_pos < b.region_pos),
  c AS (SELECT *, CASE WHEN over >= 0.8e0 THEN 0.88e0 WHEN over >= 0.35e0 THEN 0.76e0 WHEN (ax >= 0.45e0 AND gy <= 0.55e0 * hh) OR (ay >= 0.45e0 AND gx <= 0.4e0 * ww) THEN 0.72e0
    WHEN sqrt(gx * gx + gy * gy) / greatest(1.0e0, h, w) <= 1.6e0 AND (ax >= 0.2e0 OR ay >= 0.2e0) THEN 0.4e0 END AS confidence FROM j)
  SELECT sequence_id, page_index, a_pos, b_pos, CASE WHEN over >= 0.8e0 AND inside THEN 'containment' ELSE 'geometry' END AS method, confidence, CASE WHEN confidence = 0.4e0 THEN 'weak' ELSE 'strong' END AS strength FROM c WHERE confidence IS NOT NULL"""


def _with_half(regions):
    return regions.withColumn("panel_pos", F.floor(F.col("x1") / 600).cast("int"))


@query(_J7, "fx_regions")
def j7_spatial_relations(spark, sf_dir):
    (regions,) = load(spark, sf_dir, "fx_regions")
    return spatial.spatial_relations(_with_half(regions))


_DIAG = "sqrt(CAST(p.width AS DOUBLE) * p.width + CAST(p.height AS DOUBLE) * p.height)"
_J8 = f"""WITH u AS (SELECT sequence_id, page_index, region_pos AS pos, x1, y1, x2, y2, CAST(floor(x1 / 600) AS INT) AS pp FROM fx_regions), c AS (SELECT *, CAST(floor(x1 / 600) AS INT) AS pp FROM fx_characters),
  j AS (SELECT a.sequence_id, a.page_index, a.pos, b.character_pos, a.pp = b.pp AS same_panel, {INTER} / least({AREA("a")}, {AREA("b")}) AS overlap, sqrt({_GX} * {_GX} + {_GY} * {_GY}) / {_DIAG} AS box_distance
    FROM u a JOIN c b ON {PAGE} JOIN fx_pages p ON a.sequence_id = p.sequence_id AND a.page_index = p.page_index),
  k AS (SELECT *, bool_or(same_panel) OVER (PARTITION BY sequence_id, page_index, pos) AS any_same FROM j)
  SELECT sequence_id, page_index, pos, character_pos, same_panel, overlap, box_distance FROM k WHERE same_panel OR NOT any_same"""


_J8_ALL = ["center_distance_px", "center_distance", "box_distance", "overlap", "face_distance", "tail_distance_px", "tail_distance", "tail_alignment", "dx", "dy"]
_FAR = lambda x, y, x1, y1, x2, y2: f"sqrt(pow(greatest({x1} - {x}, {x} - {x2}, 0.0e0), 2) + pow(greatest({y1} - {y}, {y} - {y2}, 0.0e0), 2))"
_CXA, _CYA, _CXB, _CYB = "((a.x1 + a.x2) / 2)", "((a.y1 + a.y2) / 2)", "((b.x1 + b.x2) / 2)", "((b.y1 + b.y2) / 2)"
_J8_FULL = f"""WITH u AS (SELECT sequence_id, page_index, region_pos AS pos, x1, y1, x2, y2, CAST(floor(x1 / 600) AS INT) AS pp, CAST(floor(x1 / 600) AS INT) = 1 AS real, CASE WHEN region_pos % 4 = 0 THEN x1 - 10 END AS tx, CASE WHEN region_pos % 4 = 0 THEN y2 + 20 END AS ty FROM fx_regions),
  c AS (SELECT *, CAST(floor(x1 / 600) AS INT) AS pp FROM fx_characters),
  j AS (SELECT a.sequence_id, a.page_index, a.pos, b.character_pos, CASE WHEN real THEN a.pp = b.pp END AS same_panel, sqrt(pow({_CXB} - {_CXA}, 2) + pow({_CYB} - {_CYA}, 2)) AS center_distance_px, {INTER} / least({AREA("a")}, {AREA("b")}) AS overlap,
    sqrt({_GX} * {_GX} + {_GY} * {_GY}) / {_DIAG} AS box_distance, {_DIAG} AS diag, CASE WHEN has_face THEN {_FAR(_CXA, _CYA, "(b.x1 + 40)", "(b.y1 + 10)", "(b.x2 - 40)", "(b.y1 + 100)")} / {_DIAG} END AS face_distance,
    CASE WHEN tx IS NOT NULL THEN {_FAR("a.tx", "a.ty", "b.x1", "b.y1", "b.x2", "b.y2")} END AS tail_distance_px, tx BETWEEN b.x1 AND b.x2 AND ty BETWEEN b.y1 AND b.y2 AS tail_inside, has_face AS face_available,
    tx - {_CXA} AS vx, ty - {_CYA} AS vy, {_CXB} - {_CXA} AS wx, {_CYB} - {_CYA} AS wy, p.width, p.height
    FROM u a JOIN c b ON {PAGE} JOIN fx_pages p ON a.sequence_id = p.sequence_id AND a.page_index = p.page_index),
  k AS (SELECT *, coalesce(bool_or(same_panel) OVER (PARTITION BY sequence_id, page_index, pos), false) AS any_same FROM j)
  SELECT sequence_id, page_index, pos, character_pos, same_panel, tail_inside, face_available, true AS body_available, center_distance_px, center_distance_px / diag AS center_distance, box_distance, overlap, face_distance, tail_distance_px, tail_distance_px / diag AS tail_distance,
  CASE WHEN sqrt(vx * vx + vy * vy) * sqrt(wx * wx + wy * wy) > 0 THEN greatest(-1.0e0, least(1.0e0, (vx * wx + vy * wy) / (sqrt(vx * vx + vy * vy) * sqrt(wx * wx + wy * wy)))) END AS tail_alignment, wx / width AS dx, wy / height AS dy FROM k WHERE same_panel OR NOT any_same"""


@query(f"SELECT sequence_id, page_index, pos, character_pos, same_panel, tail_inside, face_available, body_available, {', '.join(f'round({c}, 6) AS {c}' for c in _J8_ALL)} FROM ({_J8_FULL})", "fx_regions", "fx_characters", "fx_pages")
def j8_speaker_candidates(spark, sf_dir):
    regions, characters, pages = load(spark, sf_dir, "fx_regions", "fx_characters", "fx_pages")
    face = {"face_x1": F.col("x1") + 40, "face_y1": F.col("y1") + 10, "face_x2": F.col("x2") - 40, "face_y2": F.col("y1") + 100}
    people = _with_half(characters).withColumns({k: F.when(F.col("has_face"), v) for k, v in face.items()})
    balloons = _with_half(regions).withColumnRenamed("region_pos", "pos")
    tails = balloons.where("pos % 4 = 0").select(*K, "pos", (F.col("x1") - 10).alias("tail_x"), (F.col("y2") + 20).alias("tail_y"))
    panels = pages.select(*K, F.explode(F.array(F.struct(F.lit(0).alias("panel_pos"), F.lit("page_fallback").alias("source")), F.struct(F.lit(1).alias("panel_pos"), F.lit("layout_model").alias("source")))).alias("p")).select(*K, "p.*")
    found = spatial.speaker_candidates(balloons, people, pages, tails, panels)
    return found.select(*K, "pos", "character_pos", "same_panel", "tail_inside", "face_available", "body_available", *[rounded(c, 6).alias(c) for c in _J8_ALL])


@query(
    f"""WITH g AS (SELECT sequence_id, page_index, panel_pos AS gt_pos, x1, y1, x2, y2 FROM fx_panels),
    j AS (SELECT b.sequence_id, b.page_index, b.gt_pos, a.y1, a.x1, a.region_pos, 't' || a.k AS text, a.confidence FROM fx_regions a JOIN g b ON {PAGE} AND
      (((a.x1 + a.x2) / 2 BETWEEN b.x1 - 2 AND b.x2 + 2 AND (a.y1 + a.y2) / 2 BETWEEN b.y1 - 2 AND b.y2 + 2) OR {INTER} / {AREA("a")} >= 0.5e0))
    SELECT sequence_id, page_index, gt_pos, string_agg(text, ' ' ORDER BY y1, x1, region_pos) AS text, round(avg(confidence), 6) AS confidence, count(*) AS members FROM j GROUP BY ALL""",
    "fx_regions", "fx_panels",
)
def j9_reconstruct_blocks(spark, sf_dir):
    regions, panels = load(spark, sf_dir, "fx_regions", "fx_panels")
    texts = regions.withColumn("text", F.concat(F.lit("t"), F.col("k").cast("string")))
    return spatial.reconstruct_blocks(texts, panels.withColumnRenamed("panel_pos", "gt_pos")).withColumn("confidence", rounded("confidence", 6))


@query(
    """SELECT a.sequence_id, a.page_index, count(*) FILTER (hit) AS inside, count(*) FILTER (NOT hit) AS outside FROM (
    SELECT *, EXISTS (SELECT 1 FROM fx_panels b WHERE b.panel_pos <> 4 AND a.sequence_id = b.sequence_id AND a.page_index = b.page_index AND (a.x1 + a.x2) / 2 BETWEEN b.x1 AND b.x2 AND (a.y1 + a.y2) / 2 BETWEEN b.y1 AND b.y2) AS hit FROM fx_regions a) a GROUP BY ALL""",
    "fx_regions", "fx_panels",
)
def j10_story_membership(spark, sf_dir):
    regions, panels = load(spark, sf_dir, "fx_regions", "fx_panels")
    return spatial.story_membership(regions, panels.where("panel_pos <> 4"))


_IOU = f"({INTER} / ({AREA('a')} + {AREA('b')} - {INTER}))"


@query(
    f"""WITH g AS (SELECT * FROM fx_regions WHERE k <= 3), j AS (SELECT a.sequence_id, a.page_index, a.region_pos AS gt_pos, b.proposal_pos AS pos, CASE WHEN b.proposal_pos IS NULL THEN 0 ELSE {_IOU} END AS iou FROM g a LEFT JOIN fx_balloons b ON {PAGE})
    SELECT sequence_id, page_index, gt_pos, CASE WHEN iou > 0.05e0 THEN pos END AS pos, round(iou, 6) AS iou, NOT iou > 0.05e0 AS coverage_failure FROM (SELECT *, row_number() OVER (PARTITION BY sequence_id, page_index, gt_pos ORDER BY iou DESC, pos) AS n FROM j) WHERE n = 1""",
    "fx_regions", "fx_balloons",
)
def j11_match_truth(spark, sf_dir):
    regions, balloons = load(spark, sf_dir, "fx_regions", "fx_balloons")
    found = spatial.match_truth_to_balloons(regions.where("k <= 3").withColumnRenamed("region_pos", "gt_pos"), balloons.withColumnRenamed("proposal_pos", "pos"))
    return found.withColumn("iou", rounded("iou", 6))


@query()
def d1_suppress_overlaps(spark, sf_dir):
    (balloons,) = load(spark, sf_dir, "fx_balloons")
    kept = suppress.suppress_overlaps(balloons, K, [F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2"), -F.col("confidence")], 0.85, "proposal_pos")
    return kept.select(*K, "proposal_pos", "x1", "y1", "x2", "y2")


@query("SELECT sequence_id, page_index, k, region_pos FROM (SELECT *, row_number() OVER (PARTITION BY sequence_id, page_index, k ORDER BY region_pos) AS n FROM fx_regions) WHERE n = 1", "fx_regions")
def d3_first_by_key(spark, sf_dir):
    (regions,) = load(spark, sf_dir, "fx_regions")
    return suppress.first_by_key(regions, [*K, "k"], "region_pos").select(*K, "k", "region_pos")


@query(
    """SELECT sequence_id, page_index, CAST(panel_pos AS INT) AS ordinal, x1, y1, x2, y2, 'layout_model' AS source FROM (SELECT sequence_id, page_index, x1, y1, x2, y2, row_number() OVER (PARTITION BY sequence_id, page_index ORDER BY y1, x1, y2, x2, panel_pos) AS panel_pos FROM fx_panels)
    UNION ALL SELECT sequence_id, page_index, 1, 0, 0, width, height, 'page_fallback' FROM fx_pages WHERE sequence_id % 5 = 0""",
    "fx_panels", "fx_pages",
)
def l1_panels_or_fallback(spark, sf_dir):
    panels, pages = load(spark, sf_dir, "fx_panels", "fx_pages")
    twice = panels.unionByName(panels.withColumns({"panel_pos": F.col("panel_pos") + 10, "x1": F.col("x1") + 1}))
    return layout.panels_or_fallback(twice, pages)


@query(
    """SELECT p.sequence_id, p.page_index, CASE WHEN layout_ran THEN p.width ELSE rx END AS width, CASE WHEN layout_ran THEN p.height ELSE ry END AS height FROM fx_pages p
    JOIN (SELECT sequence_id, page_index, CAST(max(ceil(x2)) AS BIGINT) AS rx, CAST(max(ceil(y2)) AS BIGINT) AS ry FROM fx_regions GROUP BY ALL) r USING (sequence_id, page_index)""",
    "fx_regions", "fx_pages",
)
def l2_page_extent(spark, sf_dir):
    regions, pages = load(spark, sf_dir, "fx_regions", "fx_pages")
    sized = pages.withColumn("width", F.when(F.col("layout_ran"), F.col("width")).otherwise(0))
    return layout.page_extent(sized, regions)


def _relations(spark, sf_dir):
    (regions,) = load(spark, sf_dir, "fx_regions", by=K)
    halves = _with_half(regions)
    return halves, *hold(spatial.spatial_relations(halves), too=True)


_L3 = f"""WITH RECURSIVE rel AS ({_J7.replace("WITH r AS", "WITH r AS")}), e AS (SELECT sequence_id, page_index, a_pos AS u, b_pos AS v FROM rel WHERE strength = 'strong' UNION ALL SELECT sequence_id, page_index, b_pos, a_pos FROM rel WHERE strength = 'strong'),
  t AS (SELECT sequence_id, page_index, region_pos AS u, region_pos AS v FROM fx_regions UNION SELECT t.sequence_id, t.page_index, t.u, e.v FROM t JOIN e ON t.sequence_id = e.sequence_id AND t.page_index = e.page_index AND t.v = e.u)
  SELECT sequence_id, page_index, u AS region_pos, min(v) AS component FROM t GROUP BY ALL"""


@query(f"SELECT * FROM ({_L3})", "fx_regions")
def l3_components(spark, sf_dir):
    regions, relations = _relations(spark, sf_dir)
    return layout.group_components(regions, relations.where("strength = 'strong'"))


_L4 = f"""WITH RECURSIVE rel AS ({_J7}), e AS (SELECT sequence_id, page_index, a_pos AS u, b_pos AS v FROM rel WHERE strength = 'strong' UNION ALL SELECT sequence_id, page_index, b_pos, a_pos FROM rel WHERE strength = 'strong'),
  t AS (SELECT sequence_id, page_index, region_pos AS u, region_pos AS v FROM fx_regions UNION SELECT t.sequence_id, t.page_index, t.u, e.v FROM t JOIN e ON t.sequence_id = e.sequence_id AND t.page_index = e.page_index AND t.v = e.u),
  c AS (SELECT sequence_id, page_index, u AS region_pos, min(v) AS component FROM t GROUP BY ALL),
  m AS (SELECT c.*, r.* EXCLUDE (sequence_id, page_index, region_pos) FROM c JOIN fx_regions r USING (sequence_id, page_index, region_pos)),
  p AS (SELECT a.sequence_id, a.page_index, a.component, min(coalesce(s.confidence, 0.5e0)) AS confidence, count(DISTINCT coalesce(s.method, 'geometry')) AS kinds, min(coalesce(s.method, 'geometry')) AS kind
    FROM m a JOIN m b ON a.sequence_id = b.sequence_id AND a.page_index = b.page_index AND a.component = b.component AND a.region_pos < b.region_pos
    LEFT JOIN (SELECT * FROM rel WHERE strength = 'strong') s ON s.sequence_id = a.sequence_id AND s.page_index = a.page_index AND s.a_pos = a.region_pos AND s.b_pos = b.region_pos GROUP BY ALL),
  g AS (SELECT sequence_id, page_index, component, list(region_pos ORDER BY region_pos) AS members, CAST(floor(arg_min(x1, region_pos) / 600) AS INT) AS panel_pos, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM m GROUP BY ALL HAVING count(*) > 1)
  SELECT g.*, p.confidence, CASE WHEN kinds = 1 THEN kind ELSE 'hybrid' END AS method, printf('balloon-geometry-%d-%04d', g.page_index, row_number() OVER (PARTITION BY g.sequence_id, g.page_index ORDER BY y1, x1, y2, x2, members)) AS balloon_id FROM g JOIN p USING (sequence_id, page_index, component)"""


@query(f"SELECT * FROM ({_L4})", "fx_regions")
def l4_geometry_groups(spark, sf_dir):
    regions, relations = _relations(spark, sf_dir)
    strong = relations.where("strength = 'strong'")
    return layout.materialize_balloons(layout.geometry_groups(regions, layout.group_components(regions, strong), strong))


@query(
    """SELECT sequence_id, page_index, region_pos, 0.5e0 AS confidence FROM fx_regions WHERE x1 < 600 AND k <> 2 AND k <> 3""",
    "fx_regions",
)
def l5_singletons(spark, sf_dir):
    (regions,) = load(spark, sf_dir, "fx_regions")
    assigned = regions.withColumn("panel_pos", F.when(F.col("x1") < 600, 1))
    return layout.singleton_groups(assigned, regions.where("k = 2"), regions.where("k = 3"))


@query(
    f"""SELECT r.sequence_id, r.page_index, r.region_pos, CASE WHEN reason IS NULL THEN 'assigned' WHEN reason = 'no_proposal_overlap' THEN 'unassigned' ELSE 'ambiguous' END AS status, reason FROM (
    SELECT r.*, CASE WHEN p.layout_ran AND l.status IS NULL THEN 'no_proposal_overlap' WHEN p.layout_ran AND l.status = 'ambiguous' THEN 'layout_ambiguous' WHEN NOT p.layout_ran AND r.k = 2 THEN 'weak_relation' WHEN a.status <> 'assigned' THEN 'panel_uncertain' END AS reason
    FROM fx_regions r JOIN fx_pages p USING (sequence_id, page_index) LEFT JOIN ({_J1}) a USING (sequence_id, page_index, region_pos) LEFT JOIN ({_J2}) l USING (sequence_id, page_index, region_pos)) r""",
    "fx_regions", "fx_pages", "fx_panels", "fx_balloons",
)
def l8_grouping_decisions(spark, sf_dir):
    regions, panels, balloons, pages = load(spark, sf_dir, "fx_regions", "fx_panels", "fx_balloons", "fx_pages", by=K)
    return layout.grouping_decisions(regions, spatial.assign_panels(regions, panels), spatial.assign_regions_to_balloons(regions, balloons), pages, regions.where("k = 2"))


_CONTAIN = lambda o, i: f"({o}.x1 <= {i}.x1 + 1 AND {o}.y1 <= {i}.y1 + 1 AND {o}.x2 >= {i}.x2 - 1 AND {o}.y2 >= {i}.y2 - 1)"
_PAIRS = f"""SELECT a.sequence_id, a.page_index, a.pos AS a_pos, b.pos AS b_pos, {INTER} / least({AREA("a")}, {AREA("b")}) AS overlap, {_CONTAIN("a", "b")} AS ab, {_CONTAIN("b", "a")} AS ba,
    (b.x1 + b.x2) / 2 - (a.x1 + a.x2) / 2 AS dx, (b.y1 + b.y2) / 2 - (a.y1 + a.y2) / 2 AS dy, {OY} >= 0.6e0 * least(a.y2 - a.y1, b.y2 - b.y1) AS same_row, {OX} >= 0.6e0 * least(a.x2 - a.x1, b.x2 - b.x1) AS same_column
    FROM u a JOIN u b ON {PAGE} AND a.pos < b.pos"""
_U = "u AS (SELECT *, region_pos AS pos FROM fx_regions)"
_FIRST = "CASE WHEN ba THEN false WHEN ab THEN true WHEN overlap >= 0.6e0 OR same_row THEN dx <= 0 WHEN abs(dy) > 10 THEN dy > 0 ELSE dx <= 0 END"


def _balloons(spark, sf_dir):
    (regions,) = load(spark, sf_dir, "fx_regions")
    return hold(regions.withColumnRenamed("region_pos", "pos"))[0]


@query(f"WITH {_U} SELECT sequence_id, page_index, a_pos, b_pos, round(overlap, 6) AS overlap, ab AS a_contains_b, ba AS b_contains_a, dx, dy, same_row, same_column FROM ({_PAIRS})", "fx_regions")
def o1_pair_features(spark, sf_dir):
    return order.pair_features(_balloons(spark, sf_dir)).select(*K, "a_pos", "b_pos", rounded("overlap", 6).alias("overlap"), "a_contains_b", "b_contains_a", "dx", "dy", "same_row", "same_column")


@query(
    f"""WITH u AS (SELECT r.*, r.region_pos AS pos, coalesce(q.x1, 0) AS rx1, coalesce(q.y1, 0) AS ry1, coalesce(q.x2, p.width) AS rx2, coalesce(q.y2, p.height) AS ry2 FROM fx_regions r JOIN fx_pages p USING (sequence_id, page_index) LEFT JOIN fx_panels q ON q.sequence_id = r.sequence_id AND q.page_index = r.page_index AND q.panel_pos = r.k)
    SELECT a.sequence_id, a.page_index, a.pos AS a_pos, b.pos AS b_pos, round(((a.x1 + a.x2) / 2 - a.rx1) / (a.rx2 - a.rx1), 6) AS a_rel_cx, round(((a.y1 + a.y2) / 2 - a.ry1) / (a.ry2 - a.ry1), 6) AS a_rel_cy, round(((b.x1 + b.x2) / 2 - b.rx1) / (b.rx2 - b.rx1), 6) AS b_rel_cx,
      round(((b.y1 + b.y2) / 2 - b.ry1) / (b.ry2 - b.ry1), 6) AS b_rel_cy FROM u a JOIN u b ON {PAGE} AND a.pos < b.pos""",
    "fx_regions", "fx_pages", "fx_panels",
)
def o1_relative_centers(spark, sf_dir):
    regions, pages, panels = load(spark, sf_dir, "fx_regions", "fx_pages", "fx_panels")
    placed = order.with_reference(regions.withColumnsRenamed({"region_pos": "pos"}).withColumn("panel_pos", F.col("k")), panels, pages)
    return order.pair_features(placed).select(*K, "a_pos", "b_pos", *[rounded(c, 6).alias(c) for c in ("a_rel_cx", "a_rel_cy", "b_rel_cx", "b_rel_cy")])


_EDGES = f"""SELECT sequence_id, page_index, CASE WHEN f THEN a_pos ELSE b_pos END AS first, CASE WHEN f THEN b_pos ELSE a_pos END AS second,
    CASE WHEN ab OR ba THEN 0.85e0 WHEN (overlap >= 0.6e0 OR same_row) AND dx = 0 THEN 0.4e0 WHEN overlap >= 0.6e0 OR same_row THEN 0.78e0 WHEN abs(dy) > 10 THEN 0.82e0 WHEN dx = 0 THEN 0.4e0 ELSE 0.78e0 END AS confidence FROM (SELECT *, {_FIRST} AS f FROM ({_PAIRS}))"""


@query(f"WITH {_U} {_EDGES}", "fx_regions")
def o2_order_edges(spark, sf_dir):
    return order.order_edges(order.pair_features(_balloons(spark, sf_dir))).select(*K, "first", "second", "confidence")


@query(
    """WITH m AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, y2 - y1 AS h FROM fx_regions),
    r AS (SELECT *, coalesce((cy - lag(cy) OVER v) / ((h + lag(h) OVER v) / 2) > 0.5e0, false) AS fresh FROM m WINDOW v AS (PARTITION BY sequence_id, page_index ORDER BY cy, -cx, region_pos)),
    s AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY sequence_id, page_index ORDER BY cy, -cx, region_pos ROWS UNBOUNDED PRECEDING) AS line FROM r)
    SELECT sequence_id, page_index, region_pos AS panel_pos, row_number() OVER (PARTITION BY sequence_id, page_index ORDER BY line, -cx, cy, region_pos) - 1 AS panel_rank FROM s""",
    "fx_regions",
)
def o3_panel_order(spark, sf_dir):
    (regions,) = load(spark, sf_dir, "fx_regions")
    return order.panel_order(regions.withColumnRenamed("region_pos", "panel_pos")).select(*K, "panel_pos", "panel_rank")


_RANK = f"""d AS (SELECT u.sequence_id, u.page_index, u.pos, count(e.second) AS d FROM u LEFT JOIN ({_EDGES}) e ON u.sequence_id = e.sequence_id AND u.page_index = e.page_index AND u.pos = e.second GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, page_index ORDER BY d, pos) - 1 AS rk, count(*) OVER (PARTITION BY sequence_id, page_index, d) AS same FROM d),
  f AS (SELECT *, max(CAST(NOT (rk = d AND same = 1) AS INT)) OVER (PARTITION BY sequence_id, page_index ORDER BY d, pos ROWS UNBOUNDED PRECEDING) AS rest FROM k),
  o AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, page_index ORDER BY rest, CASE WHEN rest = 0 THEN d ELSE pos END) - 1 AS balloon_rank FROM f)"""


@query(f"WITH {_U}, {_RANK} SELECT sequence_id, page_index, pos, balloon_rank FROM o", "fx_regions")
def o4_balloon_order(spark, sf_dir):
    balloons = _balloons(spark, sf_dir)
    return order.balloon_order(balloons, order.order_edges(order.pair_features(balloons)))


@query("SELECT r.sequence_id, r.page_index, r.region_pos FROM fx_regions r WHERE NOT EXISTS (SELECT 1 FROM fx_adjudications a WHERE NOT a.include_in_story AND a.sequence_id = r.sequence_id AND a.page_index = r.page_index AND a.balloon_pos = r.region_pos)", "fx_regions", "fx_adjudications")
def o5_story_filter(spark, sf_dir):
    regions, adjudications = load(spark, sf_dir, "fx_regions", "fx_adjudications")
    named = regions.withColumnRenamed("region_pos", "balloon_pos")
    return order.story_filter(named, adjudications, [*K, "balloon_pos"]).select(*K, F.col("balloon_pos").alias("region_pos"))


_O6 = f"""WITH w AS (SELECT r.*, r.region_pos AS pos, b.panel_pos AS own, coalesce(b.panel_pos, -1) AS page_panel FROM fx_regions r JOIN ({_J4}) b ON b.sequence_id = r.sequence_id AND b.page_index = r.page_index AND b.pos = r.region_pos),
  u AS (SELECT * FROM w), e AS (SELECT p.*, {_FIRST} AS f FROM (SELECT q.*, ua.page_panel FROM ({_PAIRS}) q JOIN u ua ON ua.sequence_id = q.sequence_id AND ua.page_index = q.page_index AND ua.pos = q.a_pos JOIN u ub ON ub.sequence_id = q.sequence_id AND ub.page_index = q.page_index AND ub.pos = q.b_pos AND ub.page_panel = ua.page_panel) p),
  t AS (SELECT sequence_id, page_index, CASE WHEN f THEN b_pos ELSE a_pos END AS pos, count(*) AS d FROM e GROUP BY ALL),
  d AS (SELECT u.sequence_id, u.page_index, u.pos, u.page_panel, coalesce(t.d, 0) AS d FROM u LEFT JOIN t USING (sequence_id, page_index, pos)),
  k AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, page_index, page_panel ORDER BY d, pos) - 1 AS rk, count(*) OVER (PARTITION BY sequence_id, page_index, page_panel, d) AS same FROM d),
  g AS (SELECT *, max(CAST(NOT (rk = d AND same = 1) AS INT)) OVER (PARTITION BY sequence_id, page_index, page_panel ORDER BY d, pos ROWS UNBOUNDED PRECEDING) AS rest FROM k),
  o AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, page_index, page_panel ORDER BY rest, CASE WHEN rest = 0 THEN d ELSE pos END) - 1 AS balloon_rank FROM g)
  SELECT sequence_id, page_index, pos, CASE page_panel WHEN 2 THEN 0 WHEN 1 THEN 1 WHEN 4 THEN 2 WHEN 3 THEN 3 END AS panel_rank, balloon_rank FROM o"""


@query(f"SELECT * FROM ({_O6})", "fx_regions", "fx_panels")
def o6_page_order(spark, sf_dir):
    regions, panels = load(spark, sf_dir, "fx_regions", "fx_panels", by=K)
    balloons = regions.withColumnRenamed("region_pos", "pos")
    placed = spatial.best_panel_for_balloon(balloons, panels, carry=["x1", "y1", "x2", "y2"])
    return order.page_order(hold(placed, too=True)[0], panels)


@query(
    f"""SELECT sequence_id, page_index, 'panel_order' AS component, 'no_layout_panels' AS code, CAST(NULL AS INT) AS pos FROM fx_pages p LEFT JOIN (SELECT DISTINCT sequence_id, page_index, 1 AS found FROM fx_panels) USING (sequence_id, page_index) WHERE found IS NULL
    UNION ALL SELECT sequence_id, page_index, 'panel_assignment', 'balloon_unassigned', pos FROM ({_J4}) JOIN (SELECT DISTINCT sequence_id, page_index FROM fx_panels) USING (sequence_id, page_index) WHERE panel_pos IS NULL OR pos = 6""",
    "fx_regions", "fx_panels", "fx_pages",
)
def o6_order_diagnostics(spark, sf_dir):
    """Every sixth balloon is told to be in a panel that its page does not have."""
    regions, panels, pages = load(spark, sf_dir, "fx_regions", "fx_panels", "fx_pages")
    placed = spatial.best_panel_for_balloon(regions.withColumnRenamed("region_pos", "pos"), panels)
    return order.order_diagnostics(pages, placed.withColumn("panel_pos", F.when(F.col("pos") == 6, 99).otherwise(F.col("panel_pos"))), panels)


@query(f"WITH {_U}, {_RANK} SELECT sequence_id, page_index, pos, balloon_rank, row_number() OVER (PARTITION BY sequence_id ORDER BY page_index, balloon_rank, pos) - 1 AS sequence_position FROM o", "fx_regions")
def o7_sequence_order(spark, sf_dir):
    balloons = _balloons(spark, sf_dir)
    ranks = order.balloon_order(balloons, order.order_edges(order.pair_features(balloons)))
    return order.sequence_order(ranks.withColumn("panel_rank", F.lit(None).cast("int"))).select(*K, "pos", "balloon_rank", "sequence_position")


def _scored(spark, sf_dir):
    regions, characters, pages = load(spark, sf_dir, "fx_regions", "fx_characters", "fx_pages")
    balloons = _with_half(regions).withColumnRenamed("region_pos", "pos")
    found = spatial.speaker_candidates(balloons, _with_half(characters), pages).withColumn("face_distance", F.lit(None).cast("double"))
    return balloons, speakers.speaker_scores(found)


_P2 = f"SELECT *, 0.55e0 * least(1.0e0, overlap / 0.75e0) + 0.2e0 * greatest(0.0e0, 1 - box_distance / 0.15e0) + 0.1e0 * CAST(same_panel AS DOUBLE) AS score FROM ({_J8})"


@query(f"SELECT sequence_id, page_index, pos, character_pos, round(score, 6) AS score FROM ({_P2})", "fx_regions", "fx_characters", "fx_pages")
def p2_speaker_scores(spark, sf_dir):
    return _scored(spark, sf_dir)[1].select(*K, "pos", "character_pos", rounded("score", 6).alias("score"))


_P3 = f"""WITH s AS (SELECT *, pos % 4 = 0 AS has_tail, CASE WHEN pos % 4 = 0 THEN box_distance END AS td FROM ({_P2})),
  r AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, page_index, pos ORDER BY score DESC, character_pos) AS sn, row_number() OVER (PARTITION BY sequence_id, page_index, pos ORDER BY td NULLS LAST, character_pos) AS tn FROM s),
  f AS (SELECT sequence_id, page_index, pos, bool_or(has_tail) AS has_tail, count(*) AS n, count(*) FILTER (td = 0) AS hits, min(character_pos) FILTER (td = 0) AS hit, min(character_pos) FILTER (tn = 1) AS near, min(td) FILTER (tn = 1) AS nd, min(td) FILTER (tn = 2) AS far,
    min(character_pos) FILTER (sn = 1) AS best, min(score) FILTER (sn = 1) AS bs, coalesce(min(score) FILTER (sn = 2), 0) AS nxt, coalesce(bool_or(same_panel) FILTER (sn = 1), false) AS sp, min(overlap) FILTER (sn = 1) AS ov FROM r GROUP BY ALL),
  d AS (SELECT *, CASE WHEN has_tail AND hits = 1 THEN 'tail_inside' WHEN has_tail AND nd <= 0.025e0 AND (far IS NULL OR far - nd >= 0.03e0) THEN 'tail_near' WHEN NOT has_tail AND n = 1 AND sp THEN 'only_candidate'
    WHEN NOT has_tail AND bs >= 0.6e0 AND bs - nxt >= 0.15e0 AND (least(1.0e0, ov / 0.75e0) >= 0.65e0 OR sp) THEN 'score' ELSE 'unknown' END AS rule FROM f),
  e AS (SELECT *, NOT has_tail AND rule <> 'only_candidate' AS weighed, CASE rule WHEN 'tail_inside' THEN hit WHEN 'tail_near' THEN near WHEN 'only_candidate' THEN best WHEN 'score' THEN best END AS who FROM d)
  SELECT sequence_id, page_index, region_pos AS pos, who AS character_pos, CASE WHEN rule IN ('tail_inside', 'tail_near') THEN 'tail' WHEN rule IN ('only_candidate', 'score') THEN 'spatial' ELSE 'unknown' END AS method,
    CASE rule WHEN 'only_candidate' THEN 0.58e0 WHEN 'score' THEN round(least(0.99e0, 0.5e0 + 0.5e0 * least(1.0e0, bs + bs - nxt)), 6) END AS confidence, coalesce(rule, 'no_candidate') AS rule, CASE WHEN weighed THEN round(bs, 6) END AS selected_score,
    CASE WHEN weighed THEN round(nxt, 6) END AS runner_up_score, CASE WHEN weighed THEN round(bs - nxt, 6) END AS score_margin, CASE WHEN rule IN ('tail_inside', 'tail_near', 'only_candidate') THEN who END AS old_character_pos,
    CASE WHEN rule IS NULL THEN 'no_candidates' WHEN rule = 'tail_inside' THEN 'unique_tail_endpoint_inside_character' WHEN rule = 'tail_near' THEN 'unique_near_tail_endpoint' WHEN rule = 'only_candidate' THEN 'only_visible_character_instance_in_panel'
      WHEN rule = 'score' THEN 'multi_feature_no_tail' WHEN weighed THEN 'insufficient_or_ambiguous_no_tail_evidence' ELSE 'insufficient_or_ambiguous_evidence' END AS reason
  FROM (SELECT sequence_id, page_index, region_pos FROM fx_regions) LEFT JOIN (SELECT *, pos AS region_pos FROM e) USING (sequence_id, page_index, region_pos)"""


@query(f"SELECT * FROM ({_P3})", "fx_regions", "fx_characters", "fx_pages")
def p3_resolve_speakers(spark, sf_dir):
    balloons, scored = _scored(spark, sf_dir)
    tailed = scored.withColumns({"has_tail": F.col("pos") % 4 == 0, "tail_distance": F.when(F.col("pos") % 4 == 0, F.col("box_distance"))}).withColumn("tail_inside", F.when(F.col("has_tail"), F.col("box_distance") == 0))
    found = speakers.compare_grounding(speakers.resolve_speakers(balloons, tailed))
    return found.withColumns({c: rounded(c, 6) for c in ("confidence", "selected_score", "runner_up_score", "score_margin")})


@query(f"SELECT sequence_id, page_index, pos, list(character_pos ORDER BY character_pos) AS character_ids FROM ({_J8}) GROUP BY ALL", "fx_regions", "fx_characters", "fx_pages")
def p4_candidate_ids(spark, sf_dir):
    return speakers.candidate_ids(_scored(spark, sf_dir)[1])


@query(f"SELECT sequence_id, page_index, region_pos AS character_pos, panel_pos FROM ({_J1.replace('fx_regions', '(SELECT *, character_pos AS region_pos FROM fx_characters)')})", "fx_characters", "fx_panels")
def j5_character_panels(spark, sf_dir):
    return spatial.character_panels(*load(spark, sf_dir, "fx_characters", "fx_panels"))


@query(
    f"""SELECT a.sequence_id, a.page_index, a.region_pos AS block_pos, b.region_pos IS NOT NULL AS matched, CASE WHEN b.region_pos IS NOT NULL THEN round({_IOU}, 6) END AS iou, CASE WHEN b.region_pos IS NOT NULL THEN {_IOU} < 0.85e0 END AS drift
    FROM fx_regions a LEFT JOIN (SELECT sequence_id, page_index, region_pos, x1 + k AS x1, y1, x2 + k AS x2, y2 FROM fx_regions WHERE k <> 3) b ON {PAGE} AND a.region_pos = b.region_pos""",
    "fx_regions",
)
def j12_join_oracle(spark, sf_dir):
    (regions,) = load(spark, sf_dir, "fx_regions")
    oracle = regions.where("k <> 3").select(*K, F.col("region_pos").alias("block_pos"), (F.col("x1") + F.col("k")).alias("x1"), "y1", (F.col("x2") + F.col("k")).alias("x2"), "y2")
    blocks = regions.select("sequence_id", (F.col("page_index") + 1).alias("page_index"), F.col("region_pos").alias("block_pos"), "x1", "y1", "x2", "y2")
    return spatial.join_oracle(blocks, oracle)[0].withColumn("iou", rounded("iou", 6))


@query("SELECT DISTINCT region_id, source AS candidate_id FROM fx_candidates WHERE region_id % 5 = 0", "fx_candidates")
def d2_conflicting_candidates(spark, sf_dir):
    (rows,) = load(spark, sf_dir, "fx_candidates", by_document=True)
    version = lambda text, position: F.struct(text.alias("text"), F.lit(position).alias("position"))
    twice, other = [version(F.col("text"), 0), version(F.col("text"), 1)], version(F.concat(F.coalesce("text", F.lit("")), F.lit("!")), 2)
    versions = F.when(F.col("region_id") % 5 == 0, F.array(*twice, other)).otherwise(F.array(*twice))
    keys = ["doc_id", "region_id", "candidate_id"]
    conflicts = suppress.dedupe_candidates(rows.select("doc_id", "region_id", F.col("source").alias("candidate_id"), F.inline(versions)), keys, "position", dealt=True)[1]
    return conflicts.select(*keys).distinct().drop("doc_id")


def _visual(spark, sf_dir):
    """Every ambiguous region is proposed with the next one, for the first balloon of the page or for none; balloons are the groups."""
    regions, panels, balloons = load(spark, sf_dir, "fx_regions", "fx_panels", "fx_balloons", by=K)
    box = ["x1", "y1", "x2", "y2"]
    found = spatial.assign_regions_to_balloons(regions, balloons, carry=[*box, "k"])
    (assigned,) = hold(found.select(*K, "region_pos", *box, "k", "status", "proposal_pos", F.col("candidates").alias("owners")), too=True)
    # Only ambiguous regions are proposed, and no other may be in a proposal, so only these are asked for their panel.
    placed = spatial.assign_panels(assigned.where("status = 'ambiguous'"), panels, carry=[*box, "k", "owners"])
    targets = F.transform("owners", lambda c: F.concat(F.lit("b"), c.cast("string"))).alias("targets")
    (rows,) = hold(placed.select(*K, "region_pos", *box, "k", F.lit("ambiguous").alias("status"), "panel_pos", targets), too=True)
    # Balloons and the regions that they own meet in one group, not in a join, which would deal both out again.
    homes = spatial.best_panel_for_balloon(balloons, panels, "proposal_pos", carry=box).withColumn("here", F.lit(1))
    owned = assigned.where("status = 'assigned'").select(*K, "proposal_pos", "region_pos")
    firsts = [F.max(c).alias(c) for c in [*box, "panel_pos", "here"]]
    met = homes.unionByName(owned, allowMissingColumns=True).groupBy(*K, "proposal_pos").agg(*firsts, F.sort_array(F.collect_list("region_pos")).alias("members")).where("here = 1")
    groups = met.select(*K, F.col("proposal_pos").alias("group_pos"), F.concat(F.lit("b"), F.col("proposal_pos").cast("string")).alias("balloon_id"), "panel_pos", *box, F.lit(0.9).alias("confidence"), F.lit("layout_model").alias("method"), "members")
    asked = rows.select(*K, F.col("region_pos").alias("proposal_pos"), F.lit(0.7).alias("confidence"), F.when(F.col("k") % 3 > 0, F.get("targets", F.lit(0))).alias("target"), F.when(F.col("k") % 3 == 1, F.array("region_pos")).otherwise(F.array("region_pos", (F.col("region_pos") + 1).cast("int"))).alias("members"))
    return layout.apply_visual_groupings(asked, rows, *hold(groups, too=True))


@query()
def l6_visual_groupings(spark, sf_dir):
    return _visual(spark, sf_dir)[0]


@query()
def l7_materialize_balloons(spark, sf_dir):
    return layout.materialize_balloons(_visual(spark, sf_dir)[1]).drop("group_pos")


@query()
def p1_balloon_tails(spark, sf_dir):
    (regions,) = load(spark, sf_dir, "fx_regions")
    x, y, w = F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1")
    corner = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    tip = corner(x + w / 2, F.col("y2") + F.col("k") * 40)
    outline = F.array(corner(x, y), corner(F.col("x2"), y), corner(F.col("x2"), F.col("y2")), corner(x + w / 2 + 8, F.col("y2")), tip, corner(x + w / 2 - 8, F.col("y2")), corner(x, F.col("y2")))
    found = speakers.balloon_tails(regions.select(*K, F.col("region_pos").alias("pos"), outline.alias("polygon")))
    return found.withColumns({c: rounded(c, 4) for c in ("tail_x", "tail_y", "strength")})

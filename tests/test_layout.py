"""Visual groupings, ids, and pages of very many boxes against plain models."""

import random

import pytest
from pyspark.sql import functions as F

from pagescript.operators import layout, spatial, suppress

K = "sequence_id long, page_index int"
REGION = f"{K}, region_pos int, x1 double, y1 double, x2 double, y2 double, status string, panel_pos int, targets array<string>"
GROUP = f"{K}, group_pos int, balloon_id string, panel_pos int, x1 double, y1 double, x2 double, y2 double, confidence double, method string, members array<int>"
PROPOSAL = f"{K}, proposal_pos int, confidence double, target string, members array<int>"
BOX = f"{K}, pos int, x1 double, y1 double, x2 double, y2 double"


def region(pos, status="ambiguous", panel=0, targets=(), page=0):
    return (1, page, pos, 10.0 * pos, 5.0, 10.0 * pos + 8, 9.0, status, panel, list(targets))


def grouped(spark, regions, groups, proposals):
    decisions, found = layout.apply_visual_groupings(spark.createDataFrame(proposals, PROPOSAL), spark.createDataFrame(regions, REGION), spark.createDataFrame(groups, GROUP))
    return {(r.page_index, r.proposal_pos): r.accepted for r in decisions.collect()}, {(r.page_index, r.group_pos): r for r in found.collect()}


B7 = (1, 0, 3, "b7", None, 100.0, 0.0, 120.0, 20.0, 0.9, "layout_model", [9])
B8 = (1, 0, 4, "b8", 1, 0.0, 0.0, 9.0, 9.0, 0.9, "layout_model", [])


def test_a_target_takes_boxes_members_panel_and_confidence(spark):
    decided, found = grouped(spark, [region(0, targets=["b7"]), region(1, targets=["b7", "b8"])], [B7, B8], [(1, 0, 0, 0.65, "b7", [1, 0, 1])])
    g = found[0, 3]
    assert decided == {(0, 0): True}
    assert (g.members, g.panel_pos, g.x1, g.y1, g.x2, g.y2, g.confidence, g.method, g.balloon_id) == ([9, 1, 0], 0, 0.0, 0.0, 120.0, 20.0, 0.65, "layout_model", "b7")
    assert found[0, 4].members == [] and len(found) == 2


def test_what_is_turned_down(spark):
    regions = [region(0, targets=["b7"]), region(1, targets=["b7", "b8"]), region(2, "assigned", targets=["b7"]), region(3, panel=1, targets=["b8"]), region(4, panel=None), region(5, panel=None), region(6, panel=1)]
    asked = [
        (0, 0.64, "b7", [0]), (1, None, "b7", [0]), (2, 0.9, "b7", [2]), (3, 0.9, "b7", [99]), (4, 0.9, "b9", [0]), (5, 0.9, "b8", [0]), (6, 0.9, "b8", [1]), (7, 0.9, None, [0]), (8, 0.9, None, [4, 5]),
        (9, 0.9, None, [1, 3]), (10, 0.9, None, []), (11, 0.9, "b7", None), (12, 0.9, None, [0, 4]), (13, 0.9, "b7", [0]), (14, 0.9, "b8", [3]), (15, 0.9, None, [3, 6]), (16, 0.9, None, [6, 6]),
    ]
    decided, found = grouped(spark, regions, [B7, B8], [(1, 0, *a) for a in asked])
    # 12: the region of no panel goes where the other is; 13: used by then; 15: one of them is.
    assert {p for (_, p), yes in decided.items() if yes} == {12, 14}
    new = found[0, 5]
    assert (new.members, new.panel_pos, new.method, new.balloon_id, new.confidence, new.x1, new.x2) == ([0, 4], 0, "visual_fallback", None, 0.9, 0.0, 48.0)
    assert found[0, 4].members == [3]


def test_pages_stay_apart_and_pages_without_proposals_stay_as_they_are(spark):
    other = (1, 1, 0, "b7", 0, 0.0, 0.0, 1.0, 1.0, 0.9, "layout_model", [5])
    regions = [region(0, targets=["b7"]), region(0, targets=["b7"], page=1)]
    decided, found = grouped(spark, regions, [B7, other, (2, 0, *other[2:])], [(1, 0, 0, 0.9, "b7", [0])])
    assert decided == {(0, 0): True} and found[0, 3].members == [9, 0] and found[1, 0].members == [5]
    nothing = layout.apply_visual_groupings(spark.createDataFrame([], PROPOSAL), spark.createDataFrame(regions, REGION), spark.createDataFrame([B7], GROUP))
    assert nothing[0].count() == 0 and nothing[1].first().members == [9]


def test_panels_that_a_target_got_before_count(spark):
    regions = [region(0, targets=["b7"]), region(1, panel=1, targets=["b7"]), region(2, panel=None, targets=["b7"])]
    decided, found = grouped(spark, regions, [B7], [(1, 0, 2, 0.9, "b7", [2]), (1, 0, 1, 0.9, "b7", [1]), (1, 0, 0, 0.9, "b7", [0])])
    assert decided == {(0, 0): True, (0, 1): False, (0, 2): True} and found[0, 3].members == [9, 0, 2]


def test_only_proposals_that_others_may_turn_down_are_walked_through(spark, monkeypatch):
    regions = [region(0, targets=["b7"]), region(1, "assigned", targets=["b7"]), region(2, targets=["b8"]), region(3, targets=["b8"]), region(4)]
    asked = [(1, 0, 0, 0.9, "b7", [0]), (1, 0, 1, 0.9, "b7", [1]), (1, 0, 2, 0.9, "b8", [2]), (1, 0, 3, float("nan"), "b7", [0]), (1, 0, 4, 0.9, "b7", [None]), (1, 0, 5, 0.9, None, [4, 0]), (1, 0, 6, 0.9, None, [4, 99])]
    walked, plain = [], layout._walked
    monkeypatch.setattr(layout, "_walked", lambda fit: walked.extend(r.proposal_pos for r in fit.collect()) or plain(fit))
    decided, found = grouped(spark, regions, [B7, B8], asked)
    assert sorted(walked) == [0, 5] and {p for (_, p), yes in decided.items() if yes} == {0} and found[0, 3].members == [9, 0]


def test_random_pages_equal_a_plain_walk(spark):
    rng, regions, groups, asked, expected, left = random.Random(9), [], [], [], {}, {}
    for page in range(60):
        spots = {m: (rng.choice(["ambiguous"] * 4 + ["assigned"]), rng.choice([None, 0, 0, 1]), rng.sample(["b0", "b1", "b2"], 2)) for m in range(6)}
        held = {g: [f"b{g % 3}", rng.choice([None, None, 0]), [90 + g], 0.9] for g in range(rng.choice([3, 4]))}  # the fourth has the first one's name
        regions += [region(m, status, panel, targets, page) for m, (status, panel, targets) in spots.items()]
        groups += [(1, page, g, name, panel, 1000.0, 0.0, 1001.0, 1.0, c, "layout_model", members) for g, (name, panel, members, c) in held.items()]
        taken: set = set()
        for p in range(8):
            target, members = rng.choice([None, "b0", "b1", "b2", "b9"]), [rng.randrange(7) for _ in range(rng.choice([1, 2, 2, 3]))]
            confidence = rng.choice([0.7, 0.8, 0.6])
            asked.append((1, page, p, confidence, target, members))
            once = list(dict.fromkeys(members))
            fits = confidence >= 0.65 and all(m in spots and spots[m][0] == "ambiguous" for m in once) and not taken & set(once)
            panels = {spots[m][1] for m in once} - {None} if fits else set()
            if fits and target:
                group = next((g for g in held.values() if g[0] == target), None)
                fits = group is not None and all(target in spots[m][2] for m in once) and (group[1] is None or not panels or panels == {group[1]})
                if fits:
                    group[1] = next(iter(panels)) if group[1] is None and len(panels) == 1 else group[1]
                    group[2], group[3] = list(dict.fromkeys(group[2] + once)), confidence
            elif fits:
                fits = len(once) > 1 and len(panels) == 1
                if fits:
                    held[max(held) + 1] = [None, next(iter(panels)), once, confidence]
            taken |= set(once) if fits else set()
            expected[page, p] = fits
        left |= {(page, g): tuple(v) for g, v in held.items()}
    decided, found = grouped(spark, regions, groups, asked)
    assert decided == expected and sum(expected.values()) > 40
    assert {k: (r.balloon_id, r.panel_pos, r.members, r.confidence) for k, r in found.items()} == left


def test_carried_columns_are_those_of_the_boxes(spark, crowded):
    panels = crowded.where("y2 > y1 AND x2 > x1").withColumnRenamed("pos", "panel_pos").where("panel_pos % 2 = 0")
    boxes = crowded.where("page_index = 1").withColumn("region_pos", F.col("pos"))
    for found in (spatial.assign_panels(boxes, panels, carry=["x1", "y2"]), spatial.best_panel_for_balloon(boxes, panels, carry=["x1", "y2"])):
        position = "pos" if "pos" in found.columns else "region_pos"
        assert sorted(map(str, found.select(position, "x1", "y2").collect())) == sorted(map(str, boxes.select(position, "x1", "y2").collect()))


def test_ordinals_count_named_groups_too(spark):
    at = lambda pos, y, name, members: (1, 2, pos, name, 0, 0.0, y, 9.0, y + 5, 0.5, "geometry", members)
    rows = [at(0, 30.0, None, [4]), at(1, 10.0, "mine", [1]), at(2, 20.0, None, []), at(3, 30.0, None, [3]), at(4, 5.0, None, [7])]
    found = {r.group_pos: r.balloon_id for r in layout.materialize_balloons(spark.createDataFrame(rows, GROUP)).collect()}
    assert found == {4: "balloon-geometry-2-0001", 1: "mine", 3: "balloon-geometry-2-0003", 0: "balloon-geometry-2-0004"}


@pytest.fixture(scope="module")
def crowded(spark):
    """Two pages of hundreds of boxes, one small and one with malformed and null boxes, and boxes of the size of the page."""
    rng, rows = random.Random(5), []
    for page, n in ((0, 700), (1, 40), (2, 600)):
        for i in range(n):
            x, y, big = rng.uniform(-50, 1500), rng.uniform(-50, 1500), rng.random() < 0.01
            w, h = (1500, 1500) if big else (rng.uniform(1, 60), rng.uniform(1, 60))
            rows.append((1, page, i, x, y, x - 5 if i % 97 == 0 else x + w, None if i % 89 == 0 else y + h))
    return spark.createDataFrame(rows, BOX).repartition(6)


@pytest.fixture
def all_pairs(monkeypatch):
    """Runs a function with and without the grid."""

    def both(function):
        results = []
        for most in (100, 10**9):
            for module, name in ((spatial, "DENSE"), (suppress, "MOST_FOLDED")):
                monkeypatch.setattr(module, name, most)
            results.append(sorted(map(str, function().collect())))
        return results

    return both


def test_grids_find_what_all_pairs_find(crowded, all_pairs):
    sound = crowded.where("y2 > y1 AND x2 > x1")
    regions, panels = crowded.withColumnRenamed("pos", "region_pos"), sound.withColumnsRenamed({"pos": "panel_pos"}).where("panel_pos % 2 = 0")
    named = lambda name, part: sound.withColumnRenamed("pos", name).where(f"{name} % 3 <> {part}")
    faces, bodies = (named(n, p).withColumn("panel_pos", F.lit(None).cast("int")) for n, p in (("face_pos", 0), ("body_pos", 1)))
    texts = regions.withColumns({"text": F.col("region_pos").cast("string"), "confidence": F.lit(0.5)})
    for function in (
        lambda: spatial.assign_panels(regions, panels), lambda: spatial.assign_regions_to_balloons(regions, named("proposal_pos", 1)), lambda: spatial.best_panel_for_balloon(crowded, panels),
        lambda: spatial.spatial_relations(sound.withColumnRenamed("pos", "region_pos").withColumn("panel_pos", (F.col("region_pos") % 2).cast("int"))), lambda: spatial.attach_faces(bodies, faces).drop("cover"),
        lambda: spatial.reconstruct_blocks(texts, named("gt_pos", 2)), lambda: spatial.story_membership(regions, named("gt_pos", 2)), lambda: spatial.match_truth_to_balloons(named("gt_pos", 2), sound),
        lambda: suppress.suppress_overlaps(sound, ["sequence_id", "page_index"], [F.col("x1") % 7], 0.2, "pos"),
    ):
        grid, plain = all_pairs(function)
        assert len(plain) > 0 and grid == plain


def test_a_page_of_twenty_thousand_boxes_forms_few_pairs(spark):
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("sequence_id"), F.lit(0).alias("page_index"), F.col("id").cast("int").alias("region_pos"), (F.col("id") % 141 * 10.0).alias("x1"), (F.floor(F.col("id") / 141) * 10.0).alias("y1"))
    boxes = rows.withColumns({"x2": F.col("x1") + 6, "y2": F.col("y1") + 6, "panel_pos": F.lit(0)})
    relations = spatial.spatial_relations(boxes)
    assert "_x" in relations._jdf.queryExecution().optimizedPlan().toString()
    strong = relations.where("strength = 'strong'")
    found = layout.group_components(boxes, strong)
    assert found.count() == 20_000 and 0 < found.select("component").distinct().count() <= 20_000


def test_components_of_a_large_page_equal_a_plain_model(spark):
    rng = random.Random(6)
    pairs = [(1, 0, *sorted(rng.sample(range(20_000), 2))) for _ in range(12_000)] + [(1, 1, i, i + 1) for i in range(30)]
    parent = {(p, i): i for p in (0, 1) for i in range(20_000 if p == 0 else 40)}

    def root(p, i):
        while parent[p, i] != i:
            parent[p, i] = parent[p, parent[p, i]]
            i = parent[p, i]
        return i

    for _, p, a, b in pairs:
        x, y = sorted((root(p, a), root(p, b)))
        parent[p, y] = x
    nodes = spark.createDataFrame([(1, p, i) for p, i in parent], f"{K}, region_pos int")
    found = layout.group_components(nodes, spark.createDataFrame(pairs, f"{K}, a_pos int, b_pos int"))
    assert {(r.page_index, r.region_pos): r.component for r in found.collect()} == {(p, i): root(p, i) for p, i in parent}

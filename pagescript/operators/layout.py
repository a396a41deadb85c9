"""Layout grouping: panels or a fallback, page extents, groups of regions by strong relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import broadcast_if_small, components, cut
from .boxes import KEYS, clip_boxes, valid_boxes
from .suppress import suppress_overlaps

#: Edges of a page that are folded one by one.
MOST_EDGES = 256

_BY_PLACE = ["y1", "x1", "y2", "x2"]


def panels_or_fallback(proposals: DataFrame, pages: DataFrame, position: str = "panel_pos", least_iou: float = 0.85) -> DataFrame:
    """(keys, ordinal from 1, x1..y2, source): valid proposals, clipped, without near repeats, from top to bottom; pages without any get one
    panel of the whole page."""
    clipped = clip_boxes(valid_boxes(proposals)[0], pages)
    kept = suppress_overlaps(clipped, KEYS, [], least_iou, position)
    by = Window.partitionBy(*KEYS).orderBy(*_BY_PLACE, position)
    found = kept.select(*KEYS, F.row_number().over(by).alias("ordinal"), "x1", "y1", "x2", "y2", F.lit("layout_model").alias("source"))
    whole = pages.join(found.select(*KEYS).distinct(), KEYS, "left_anti")
    return found.unionByName(whole.select(*KEYS, F.lit(1).alias("ordinal"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.col("width").cast("double").alias("x2"), F.col("height").cast("double").alias("y2"), F.lit("page_fallback").alias("source")))


def page_extent(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """(keys, width, height): the given size if it is positive, else as far as valid boxes reach, at least 1."""
    reach = valid_boxes(regions)[0].groupBy(*KEYS).agg(F.max(F.ceil("x2")).alias("rx"), F.max(F.ceil("y2")).alias("ry"))
    given = (F.col("width") > 0) & (F.col("height") > 0)
    pick = lambda own, other: F.when(given, F.col(own).cast("long")).otherwise(F.greatest(F.coalesce(other, F.lit(1)), F.lit(1)))
    return pages.join(reach, KEYS, "left").select(*KEYS, pick("width", F.col("rx")).alias("width"), pick("height", F.col("ry")).alias("height"))


def group_components(nodes: DataFrame, edges: DataFrame, position: str = "region_pos") -> DataFrame:
    """(keys, position, component): the least position that strong edges reach inside a page.

    Pages have a few dozen regions, as a rule: the edges of a page are folded into a map from position to label, where each edge gives all that has the
    larger of its two labels the smaller one. Pages of more than MOST_EDGES edges go through alternating stars, all of them at once. Regions
    without an edge are their own component.
    """
    edges = cut(edges.select(*KEYS, "a_pos", "b_pos"))
    large = cut(edges.groupBy(*KEYS).count().where(F.col("count") > MOST_EDGES).select(*KEYS))
    if large.isEmpty():
        found = _folded_components(edges, position)
    else:
        some = broadcast_if_small(large)
        ends = [F.struct(*KEYS, F.col(c).alias(position)).alias(n) for c, n in (("a_pos", "a"), ("b_pos", "b"))]
        reached = components(edges.join(some, KEYS, "left_semi").select(*ends))
        found = _folded_components(edges.join(some, KEYS, "left_anti"), position).unionByName(reached.select("id.*", F.col(f"component.{position}").alias("component")))
    return nodes.select(*KEYS, position).join(found, [*KEYS, position], "left").withColumn("component", F.coalesce("component", position))


def _folded_components(edges: DataFrame, position: str) -> DataFrame:
    ends = F.array_distinct(F.flatten(F.transform("edges", lambda e: F.array(e["a_pos"], e["b_pos"]))))
    folded = edges.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("a_pos", "b_pos"))).alias("edges")).withColumn("ends", ends)

    def join(labels, edge):
        u, v = labels[edge["a_pos"]], labels[edge["b_pos"]]
        pair = F.struct(F.greatest(u, v).alias("high"), F.least(u, v).alias("low"))
        return F.get(F.transform(F.array(pair), lambda p: F.transform_values(labels, lambda _, label: F.when(label == p["high"], p["low"]).otherwise(label))), F.lit(0))

    labels = F.aggregate("edges", F.map_from_arrays("ends", "ends"), join)
    return folded.select(*KEYS, F.explode(labels).alias(position, "component"))


def geometry_groups(regions: DataFrame, components: DataFrame, edges: DataFrame, position: str = "region_pos") -> DataFrame:
    """(keys, component, members, panel_pos, x1..y2, confidence, method) of groups of two or more; members are positions in order.

    The confidence is the least over all pairs of members, .5 for a pair without an edge; the method is the pairs' own if they have just one, else
    hybrid, where a pair without an edge counts as geometry. Pairs without an edge are known by their number, so none are formed.
    panel_pos is the first member's, null where regions have no panel.
    """
    panel = F.col("panel_pos") if "panel_pos" in regions.columns else F.lit(None).cast("int").alias("panel_pos")
    own = regions.select(*KEYS, position, "x1", "y1", "x2", "y2", panel).join(components, [*KEYS, position])
    inside = edges.select(*KEYS, F.col("a_pos").alias(position), "confidence", "method").join(components, [*KEYS, position])
    of_pairs = inside.groupBy(*KEYS, "component").agg(F.count("*").alias("known"), F.min(F.coalesce("confidence", F.lit(0.5))).alias("least"), F.collect_set(F.coalesce("method", F.lit("geometry"))).alias("kinds"))
    boxes = own.groupBy(*KEYS, "component").agg(
        F.array_sort(F.collect_list(position)).alias("members"), F.min_by("panel_pos", position).alias("panel_pos"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")
    )
    n = F.size("members").cast("long")
    missing = n * (n - 1) / 2 > F.col("known")
    kinds = F.when(missing, F.array_union("kinds", F.array(F.lit("geometry")))).otherwise(F.col("kinds"))
    return boxes.where(F.size("members") > 1).join(of_pairs, [*KEYS, "component"]).select(
        *KEYS, "component", "members", "panel_pos", "x1", "y1", "x2", "y2", F.when(missing, F.least("least", F.lit(0.5))).otherwise(F.col("least")).alias("confidence"), F.when(F.size(kinds) == 1, kinds[0]).otherwise("hybrid").alias("method")
    )


def singleton_groups(assigned: DataFrame, grouped: DataFrame, weak: DataFrame, position: str = "region_pos") -> DataFrame:
    """(keys, position, confidence): regions of a panel that no group and no weak relation has become balloons of their own."""
    own = [*KEYS, position]
    return assigned.where("panel_pos IS NOT NULL").join(grouped.select(*own), own, "left_anti").join(weak.select(*own), own, "left_anti").select(*own, F.lit(0.5).alias("confidence"))


def materialize_balloons(groups: DataFrame) -> DataFrame:
    """+ balloon_id of groups (keys, x1..y2, members and, where a proposal has named them, balloon_id): the proposal's own, else
    balloon-geometry-<page>-<ordinal>. The ordinal counts all groups of the page that have members, named or not, from 1, by y1, x1, y2, x2, members."""
    by = Window.partitionBy(*KEYS).orderBy("y1", "x1", "y2", "x2", "members")
    made = F.format_string("balloon-geometry-%d-%04d", "page_index", F.row_number().over(by))
    named = F.col("balloon_id").cast("string") if "balloon_id" in groups.columns else F.lit(None).cast("string")
    return groups.where(F.size("members") > 0).withColumn("balloon_id", F.coalesce(named, made))


def grouping_decisions(regions: DataFrame, panels: DataFrame, proposals: DataFrame, pages: DataFrame, weak: DataFrame, position: str = "region_pos") -> DataFrame:
    """(keys, position, status, reason): one decision per region.

    panels and proposals: results of the two assignments. Precedence: malformed, no overlap with a proposal (only where the layout
    provider ran), ambiguous between proposals, weak relations, uncertain panel.
    """
    own = [*KEYS, position]
    bad = ~F.coalesce((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")), F.lit(False))
    # All that is known of a region meets in one group of flags, not in joins, which would deal out every table by region again.
    flags = ["here", "bad", "covered", "torn", "is_weak", "uncertain"]
    one = lambda rows, **known: rows.select(*own, *[known.get(f, F.lit(None).cast("long")).cast("long").alias(f) for f in flags])
    found = lambda rows: rows.dropna(subset=own)
    parts = [
        one(found(panels), uncertain=F.col("status") != "assigned"), one(found(proposals), covered=F.col("status").isNotNull(), torn=F.col("status") == "ambiguous"),
        one(found(weak), is_weak=F.lit(1)),
    ]
    together = one(regions, here=F.lit(1), bad=bad)
    for part in parts:
        together = together.unionByName(part)
    sums = [F.sum("here").alias("here"), F.sum("bad").alias("bad"), *[F.coalesce(F.max(f), F.lit(0)).alias(f) for f in flags[2:]]]
    known = together.groupBy(*own).agg(*sums).where("here > 0").join(pages.select(*KEYS, "layout_ran"), KEYS, "left")
    # A region that is there several times has a decision each time.
    joined = known.withColumn("malformed", F.explode(F.concat(F.array_repeat(F.lit(True), F.col("bad").cast("int")), F.array_repeat(F.lit(False), (F.col("here") - F.col("bad")).cast("int")))))
    reason = (
        F.when(F.col("malformed"), "malformed")
        .when(F.col("layout_ran") & (F.col("covered") == 0), "no_proposal_overlap")
        .when(F.col("layout_ran") & (F.col("torn") == 1), "layout_ambiguous")
        .when(~F.col("layout_ran") & (F.col("is_weak") == 1), "weak_relation")
        .when(F.col("uncertain") == 1, "panel_uncertain")
    )
    decided = joined.withColumn("reason", reason)
    status = F.when(F.col("reason").isNull(), "assigned").when(F.col("reason").isin("malformed", "no_proposal_overlap"), "unassigned").otherwise("ambiguous")
    return decided.select(*own, status.alias("status"), "reason")


def apply_visual_groupings(proposals: DataFrame, regions: DataFrame, groups: DataFrame, least: float = 0.65) -> tuple[DataFrame, DataFrame]:
    """(decisions, groups) after outside proposals to group regions were taken in or turned down, one after the other.

    proposals: keys, proposal_pos, confidence, target (a balloon_id or null), members (positions). regions: keys, region_pos, x1..y2, status, panel_pos, targets
    (balloon ids that may own it). groups: keys, group_pos, balloon_id (or null), panel_pos, x1..y2, confidence, method, members.
    A proposal needs the least confidence, and members that are all ambiguous and not yet taken. A target must be a group of the page that is open to
    each member and lies in no other panel than theirs; it gets the members that it lacks, their boxes, the proposal's confidence, and
    their panel if it has none. Without a target, two members or more in exactly one panel become a group, method visual_fallback, after the others.
    decisions: keys, proposal_pos, accepted, target, members (each once).
    All that does not hang on what was taken before is asked first, by joins. Only what is left is walked through in order, and only on pages where several are.
    """
    box = ["x1", "y1", "x2", "y2"]
    judged = cut(_judged(proposals, regions, least))
    named = groups.select(*KEYS, F.col("group_pos").cast("int").alias("group_pos"), F.col("balloon_id").cast("string").alias("balloon_id"), F.col("panel_pos").cast("int").alias("panel_pos"), *[F.col(c).cast("double").alias(c) for c in box], F.col("confidence").cast("double").alias("confidence"), "method", F.col("members").cast("array<int>").alias("members"))
    fit = cut(_with_home(judged.where("fits"), named))
    taken = cut(fit.join(_walked(fit), [*KEYS, "_id"], "left_semi"))
    columns = [*KEYS, "proposal_pos", "accepted", "target", "members"]
    answered = judged.where("fits").join(taken.select(*KEYS, "_id", F.lit(True).alias("_yes")), [*KEYS, "_id"], "left").withColumn("accepted", F.coalesce("_yes", F.lit(False)))
    decisions = judged.where("NOT fits").withColumn("accepted", F.lit(False)).select(*columns).unionByName(answered.select(*columns))
    return decisions, _enlarged(named, taken).unionByName(_added(named, taken))


_SIDES = {"x1": F.min, "y1": F.min, "x2": F.max, "y2": F.max}


def _judged(proposals: DataFrame, regions: DataFrame, least: float) -> DataFrame:
    """(keys, _id, proposal_pos, confidence, target, members, panels, panel, x1..y2, fits): proposals with what their ambiguous members say; fits where nothing but the target's panel, or what
    others took, can turn them down. panels: 0, 1 or 2 for more; panel: the one, if it is one."""
    members = F.array_distinct(F.coalesce(F.col("members").cast("array<int>"), F.array().cast("array<int>")))
    asked = proposals.select(*KEYS, F.col("proposal_pos").cast("int").alias("proposal_pos"), F.col("confidence").cast("double").alias("confidence"), F.col("target").cast("string").alias("target"), members.alias("members"), F.monotonically_increasing_id().alias("_id"))
    sent = asked.select("*", F.explode_outer("members").alias("_pos"))
    spots = regions.where("status = 'ambiguous'").select(*KEYS, F.col("region_pos").cast("int").alias("_pos"), F.lit(True).alias("_here"), F.col("panel_pos").cast("int").alias("_panel"), *[F.col(c).cast("double").alias(c) for c in _SIDES], F.col("targets").cast("array<string>").alias("_targets"))
    met = sent.join(spots, [*KEYS, "_pos"], "left").withColumn("_open", F.coalesce(F.array_contains("_targets", F.col("target")), F.lit(False)))
    # Only numbers are gathered, and a proposal's own fields are keys, so groups are hashed and need no order.
    gathered = [F.count_if(F.col("_here").isNull()).alias("_missing"), F.min("_panel").alias("_low"), F.max("_panel").alias("_high"), F.count_if(~F.col("_open")).alias("_closed"), *[f(c).alias(c) for c, f in _SIDES.items()]]
    whole = met.groupBy(*KEYS, "_id", "proposal_pos", "confidence", "target", "members").agg(*gathered).withColumn("panels", F.when(F.col("_low").isNull(), 0).when(F.col("_low") == F.col("_high"), 1).otherwise(2))
    sure = (F.col("confidence") >= least) & ~F.isnan("confidence") & (F.size("members") > 0) & (F.col("_missing") == 0)
    alone = (F.size("members") >= 2) & (F.col("panels") == 1)
    fits = F.coalesce(sure & F.when(F.col("target").isNull(), alone).otherwise(F.col("_closed") == 0), F.lit(False))
    return whole.select(*KEYS, "_id", "proposal_pos", "confidence", "target", "members", "panels", F.when(F.col("panels") == 1, F.col("_low")).alias("panel"), *_SIDES, fits.alias("fits"))


def _with_home(fit: DataFrame, named: DataFrame) -> DataFrame:
    """fit + home (group_pos and panel_pos of the target, the first group of that name; null without a target), but those whose target is not there or in another panel."""
    asks = fit.where("target IS NOT NULL")
    homes = named.select(*KEYS, F.col("balloon_id").alias("target"), F.struct("group_pos", "panel_pos").alias("_home"))
    found = asks.join(homes, [*KEYS, "target"]).groupBy(*asks.columns).agg(F.min("_home").alias("home"))
    agrees = F.col("home.panel_pos").isNull() | (F.col("panels") == 0) | F.coalesce(F.col("panel") == F.col("home.panel_pos"), F.lit(False))
    return found.where(agrees).unionByName(fit.where("target IS NULL"), allowMissingColumns=True)


def _walked(fit: DataFrame) -> DataFrame:
    """(keys, _id) of the proposals that are taken in: on each page, in order, those whose members are free and whose target got no other panel before."""
    import pyarrow as pa

    names = [*KEYS, "_id"]
    types = [pa.int64(), pa.int32(), pa.int64()]

    def walk(batches):
        for batch in batches:
            out: list[tuple] = []
            for page in batch.to_pylist():
                used: set = set()
                panel_of: dict = {}
                for ask in page["asks"]:
                    free, panels, bare = used.isdisjoint(ask["members"]), ask["panels"], ask["bare"]
                    if free and bare is not None and panels and bare in panel_of:
                        free = ask["panel"] is not None and ask["panel"] == panel_of[bare]
                    if free:
                        used.update(ask["members"])
                        if bare is not None and panels == 1:
                            panel_of[bare] = ask["panel"]
                        out.append((page["sequence_id"], page["page_index"], ask["_id"]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    # A target without a panel gets one from the first that has just one.
    bare = F.when(F.col("home.panel_pos").isNull(), F.col("home.group_pos"))
    asks = F.sort_array(F.collect_list(F.struct("proposal_pos", "_id", "members", "panels", "panel", bare.alias("bare"))))
    pages = cut(fit.groupBy(*KEYS).agg(asks.alias("asks")))
    alone = pages.where(F.size("asks") == 1).select(*KEYS, F.get("asks", F.lit(0))["_id"].alias("_id"))
    several = pages.where(F.size("asks") > 1).mapInArrow(walk, ", ".join(f"{n} {fit.schema[n].dataType.simpleString()}" for n in names))
    return alone.unionByName(several)


def _enlarged(named: DataFrame, taken: DataFrame) -> DataFrame:
    """named with the boxes, members, panel and confidence of what was taken in for them."""
    given = taken.where("target IS NOT NULL").select(*KEYS, F.col("home.group_pos").alias("group_pos"), "target", F.struct("proposal_pos", "_id", "confidence", "members", "panel").alias("g"), *_SIDES)
    of_group = given.groupBy(*KEYS, "group_pos").agg(F.first("target").alias("target"), F.sort_array(F.collect_list("g")).alias("given"), *[f(c).alias(c) for c, f in _SIDES.items()])
    sent = of_group.select(*KEYS, "group_pos", F.struct("target", "given", *_SIDES).alias("_sent"))
    # Groups meet what is theirs in a window along the page, where a join would deal all of them out again.
    met = named.unionByName(sent, allowMissingColumns=True).withColumn("_got", F.first("_sent", ignorenulls=True).over(Window.partitionBy(*KEYS, "group_pos"))).where("_sent IS NULL")
    hit = F.coalesce(F.col("balloon_id") == F.col("_got.target"), F.lit(False))
    panel = F.get(F.array_compact("_got.given.panel"), F.lit(0))
    members = F.array_distinct(F.concat(F.coalesce("members", F.array().cast("array<int>")), F.flatten("_got.given.members")))
    new = {
        "panel_pos": F.coalesce("panel_pos", panel), "x1": F.least("x1", "_got.x1"), "y1": F.least("y1", "_got.y1"), "x2": F.greatest("x2", "_got.x2"), "y2": F.greatest("y2", "_got.y2"),
        "confidence": F.get("_got.given.confidence", F.size("_got.given") - 1), "members": members,
    }
    return met.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in named.columns])


def _added(named: DataFrame, taken: DataFrame) -> DataFrame:
    """Groups of what was taken in without a target, in order after those of their page."""
    new = taken.where("target IS NULL").withColumn("_n", F.row_number().over(Window.partitionBy(*KEYS).orderBy("proposal_pos", "_id")))
    last = named.groupBy(*KEYS).agg(F.max("group_pos").alias("_last"))
    made = {"group_pos": F.coalesce("_last", F.lit(-1)) + F.col("_n"), "balloon_id": F.lit(None).cast("string"), "panel_pos": F.col("panel"), "method": F.lit("visual_fallback")}
    return new.join(last, KEYS, "left").select(*[made[c].alias(c) if c in made else F.col(c) for c in named.columns])

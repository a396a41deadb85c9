"""Speaker grounding: scores of candidate characters and the cascade of rules that picks one per balloon."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .boxes import KEYS


def speaker_scores(candidates: DataFrame) -> DataFrame:
    """+ score without a tail; features that are missing add nothing."""
    def part(weight: float, value):
        return F.lit(weight) * F.coalesce(value, F.lit(0.0))

    return candidates.withColumn(
        "score",
        part(0.55, F.least(F.lit(1.0), F.col("overlap") / 0.75))
        + part(0.20, F.greatest(F.lit(0.0), 1 - F.col("box_distance") / 0.15))
        + part(0.15, F.greatest(F.lit(0.0), 1 - F.col("face_distance") / 0.25))
        + part(0.10, F.col("same_panel").cast("double")),
    )


def resolve_speakers(balloons: DataFrame, candidates: DataFrame, visual: DataFrame | None = None) -> DataFrame:
    """(keys, pos, character_pos, method, confidence, rule, selected_score, runner_up_score, score_margin) of every balloon.

    candidates: scored, + has_tail, tail_inside, tail_distance (null without a tail). visual: (keys, pos, character_pos, vote).
    A balloon with a tail is settled by the tail or by the vote, never by the score without a tail; scores are given only where they were
    weighed: without a tail, unless the one candidate in the panel settled it.
    """
    own = [*KEYS, "pos"]
    by_score = Window.partitionBy(*own).orderBy(F.desc("score"), "character_pos")
    by_tail = Window.partitionBy(*own).orderBy(F.col("tail_distance").asc_nulls_last(), "character_pos")
    near = F.struct("character_pos", "tail_distance")
    ranked = candidates.withColumns({"_s": F.row_number().over(by_score), "_t": F.row_number().over(by_tail)})
    facts = ranked.groupBy(*own).agg(
        F.max("has_tail").alias("has_tail"),
        F.count("*").alias("n"),
        F.sum(F.coalesce("tail_inside", F.lit(False)).cast("int")).alias("hits"),
        F.min(F.when(F.col("tail_inside"), F.col("character_pos"))).alias("hit"),
        F.min(F.when(F.col("_t") == 1, near)).alias("near"),
        F.min(F.when(F.col("_t") == 2, F.col("tail_distance"))).alias("far"),
        F.min(F.when(F.col("_s") == 1, F.struct("character_pos", "score", "same_panel", "overlap"))).alias("best"),
        F.coalesce(F.min(F.when(F.col("_s") == 2, F.col("score"))), F.lit(0.0)).alias("next"),
        F.max("same_panel").alias("any_same"),
    )
    if visual is not None:
        allowed = visual.join(candidates.select(*own, "character_pos"), [*own, "character_pos"], "left_semi").where("vote >= 0.65")
        facts = facts.join(allowed.groupBy(*own).agg(F.max(F.struct("vote", (-F.col("character_pos")).alias("c"))).alias("v")), own, "left")
    else:
        facts = facts.withColumn("v", F.lit(None).cast("struct<vote:double,c:int>"))
    margin = F.col("best.score") - F.col("next")
    near_tail = (F.col("near.tail_distance") <= 0.025) & (F.col("far").isNull() | (F.col("far") - F.col("near.tail_distance") >= 0.03))
    strong = (F.col("best.score") >= 0.60) & (margin >= 0.15) & ((F.least(F.lit(1.0), F.col("best.overlap") / 0.75) >= 0.65) | F.coalesce(F.col("best.same_panel"), F.lit(False)))
    rule = (
        F.when(F.col("has_tail") & (F.col("hits") == 1), "tail_inside")
        .when(F.col("has_tail") & near_tail, "tail_near")
        .when(~F.col("has_tail") & (F.col("n") == 1) & F.coalesce(F.col("best.same_panel"), F.lit(False)), "only_candidate")
        .when(~F.col("has_tail") & strong, "score")
        .when(F.col("v").isNotNull(), "visual")
        .otherwise("unknown")
    )
    decided = facts.withColumn("rule", rule)
    is_ = lambda *names: F.col("rule").isin(*names)
    who = F.when(is_("tail_inside"), F.col("hit")).when(is_("tail_near"), F.col("near.character_pos")).when(is_("only_candidate", "score"), F.col("best.character_pos")).when(is_("visual"), -F.col("v.c"))
    method = F.when(is_("tail_inside", "tail_near"), "tail").when(is_("only_candidate", "score"), "spatial").when(is_("visual"), F.when(F.col("has_tail") | F.coalesce("any_same", F.lit(False)), "hybrid").otherwise("visual")).otherwise("unknown")
    confidence = F.when(is_("only_candidate"), 0.58).when(is_("score"), F.least(F.lit(0.99), 0.5 + 0.5 * F.least(F.lit(1.0), F.col("best.score") + margin))).when(is_("visual"), F.col("v.vote"))
    weighed = ~F.col("has_tail") & ~is_("only_candidate")
    scores = [F.when(weighed, value).alias(name) for value, name in ((F.col("best.score"), "selected_score"), (F.col("next"), "runner_up_score"), (margin, "score_margin"))]
    found = decided.select(*own, who.alias("character_pos"), method.alias("method"), confidence.alias("confidence"), "rule", *scores)
    return balloons.select(*own).join(found, own, "left").fillna({"method": "unknown", "rule": "no_candidate"})


def candidate_ids(candidates: DataFrame) -> DataFrame:
    """(keys, pos, character_ids) with the ids in order."""
    return candidates.groupBy(*KEYS, "pos").agg(F.sort_array(F.collect_list("character_pos")).alias("character_ids"))


#: Rules of systems without scores, and what is said of a decision by its rule. Fixed values.
OLD_RULES = ["tail_inside", "tail_near", "only_candidate"]
REASONS = {"tail_inside": "unique_tail_endpoint_inside_character", "tail_near": "unique_near_tail_endpoint", "only_candidate": "only_visible_character_instance_in_panel", "score": "multi_feature_no_tail", "no_candidate": "no_candidates"}


def compare_grounding(decisions: DataFrame, old_rules: list[str] = OLD_RULES, labels: DataFrame | None = None) -> DataFrame:
    """decisions + old_character_pos, reason and, with labels (keys, pos, speaker), old_result and new_result.

    old_character_pos is what a system that has only the old rules would have said. reason is the rule's name; of decisions that fell through, that
    scores were weighed in vain, or that there was no evidence. Results are the labels, UNKNOWN without one; the old result is the label
    where an old rule settled it.
    """
    old = F.col("rule").isin(old_rules)
    reason = F.coalesce(F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])[F.col("rule")], F.when(F.col("rule") == "visual", "visual").when(F.col("selected_score").isNotNull(), "insufficient_or_ambiguous_no_tail_evidence").otherwise("insufficient_or_ambiguous_evidence"))
    compared = decisions.withColumns({"old_character_pos": F.when(old, F.col("character_pos")), "reason": reason})
    if labels is None:
        return compared
    named = compared.join(labels.select(*KEYS, "pos", "speaker"), [*KEYS, "pos"], "left")
    return named.withColumns({"old_result": F.when(old, F.coalesce("speaker", F.lit("UNKNOWN"))).otherwise("UNKNOWN"), "new_result": F.coalesce("speaker", F.lit("UNKNOWN"))}).drop("speaker")


def balloon_tails(balloons: DataFrame) -> DataFrame:
    """(keys, pos, tail_x, tail_y, strength) of balloons whose outline (polygon: array of x, y) has one clear tip.

    A tip has an angle of at most 60 degrees and lies at least .68 of the largest radius from the center; its strength is
    ((60 - angle) / 60) * extension. It must lead the next tip by .12.
    """
    numbered = balloons.where(F.size("polygon") >= 4).select(*KEYS, "pos", "polygon", F.posexplode("polygon").alias("i", "p"))
    n = F.size("polygon")
    at = lambda i: F.get("polygon", i)
    before, after = at((F.col("i") - 1 + n) % n), at((F.col("i") + 1) % n)
    mean = lambda k: F.aggregate("polygon", F.lit(0.0), lambda a, p: a + p[k]) / n
    centred = numbered.select(*KEYS, "pos", "i", F.col("p.x").alias("x"), F.col("p.y").alias("y"), (before["x"] - F.col("p.x")).alias("ax"), (before["y"] - F.col("p.y")).alias("ay"), (after["x"] - F.col("p.x")).alias("bx"), (after["y"] - F.col("p.y")).alias("by"), mean("x").alias("cx"), mean("y").alias("cy"))
    norm = F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2) * F.sqrt(F.col("bx") ** 2 + F.col("by") ** 2)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("ax") * F.col("bx") + F.col("ay") * F.col("by")) / norm))
    radius = F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2)
    measured = centred.withColumns({"angle": F.when(norm > 0, F.degrees(F.acos(cosine))), "radius": radius})
    own = Window.partitionBy(*KEYS, "pos")
    extended = measured.withColumn("extension", F.col("radius") / F.max("radius").over(own)).where("angle <= 60 AND extension >= 0.68")
    tips = extended.withColumn("strength", (60 - F.col("angle")) / 60 * F.col("extension"))
    by = own.orderBy(F.desc("strength"), F.desc("i"))
    ranked = tips.withColumns({"n": F.row_number().over(by), "next": F.coalesce(F.lead("strength").over(by), F.lit(0.0))})
    return ranked.where("n = 1 AND strength - next >= 0.12").select(*KEYS, "pos", F.col("x").alias("tail_x"), F.col("y").alias("tail_y"), "strength")

"""Preprocessing policies: best actions, gain thresholds, features, simple models, verifier thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def action_errors(actions: DataFrame) -> DataFrame:
    return actions.withColumn("cer", T.char_error_rate(F.col("target_text"), F.col("text")))


def oracle_actions(errors: DataFrame, least_gain: float = 0.03) -> DataFrame:
    """(item, best_action, best_cer, base_cer, gain, oracle_action): the action of least error, the first of equals; NONE if it gains little. Actions without a text have no error."""
    best = errors.groupBy("sequence_id", "item_id").agg(F.min(F.when(F.col("cer").isNotNull(), F.struct("cer", "action_pos", "action"))).alias("b"), F.max(F.when(F.col("action") == "NONE", F.col("cer"))).alias("base_cer"))
    gain = F.col("base_cer") - F.col("b.cer")
    return best.select("sequence_id", "item_id", F.col("b.action").alias("best_action"), F.col("b.cer").alias("best_cer"), "base_cer", gain.alias("gain"), F.when(gain >= least_gain, F.col("b.action")).otherwise("NONE").alias("oracle_action"))


def match_blocks(scores: DataFrame, least: float = 50.0) -> DataFrame:
    """(page_id, block_pos, gt_pos, action, score): each block proposes its one best pair, each truth takes its best proposal.

    scores: page_id, block_pos, gt_pos, action, action_pos, score. A block that loses its truth has no second choice.
    """
    own = Window.partitionBy("page_id", "block_pos").orderBy(F.desc("score"), "gt_pos", "action_pos")
    proposals = scores.withColumn("_n", F.row_number().over(own)).where((F.col("_n") == 1) & (F.col("score") >= least))
    taken = Window.partitionBy("page_id", "gt_pos").orderBy(F.desc("score"), F.desc("block_pos"))
    return proposals.withColumn("_n", F.row_number().over(taken)).where("_n = 1").select("page_id", "block_pos", "gt_pos", "action", "score")


def unmatched_blocks(scores: DataFrame, matched: DataFrame) -> DataFrame:
    best = scores.groupBy("page_id", "block_pos").agg(F.max("score").alias("best_score"))
    return best.join(matched, ["page_id", "block_pos"], "left_anti")


def action_distribution(oracle: DataFrame, actions: list[str]) -> DataFrame:
    """(action, n) of all actions, those that are never best with 0."""
    listed = oracle.sparkSession.createDataFrame([(a,) for a in actions], "action string")
    counts = oracle.groupBy(F.col("oracle_action").alias("action")).agg(F.count("*").alias("n"))
    return listed.join(counts, "action", "left").fillna(0)


def gain_sweep(oracle: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, used, mean_before, mean_after, mean_gain); the thresholds are the caller's short list."""
    rows = _at_thresholds(oracle, thresholds)
    use = F.col("gain") >= F.col("threshold")
    after = F.when(use, F.col("best_cer")).otherwise(F.col("base_cer"))
    return rows.groupBy("threshold").agg(F.sum(use.cast("int")).alias("used"), F.avg("base_cer").alias("mean_before"), F.avg(after).alias("mean_after"), F.avg(F.col("base_cer") - after).alias("mean_gain"))


def _at_thresholds(oracle: DataFrame, thresholds: list[float]) -> DataFrame:
    return oracle.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))


def sweep_actions(oracle: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, action, n): how often each action is taken where a gain of the threshold is asked for; NONE where it is not reached."""
    taken = F.when(F.col("gain") >= F.col("threshold"), F.col("best_action")).otherwise("NONE")
    return _at_thresholds(oracle, thresholds).groupBy("threshold", taken.alias("action")).agg(F.count("*").alias("n"))


def top_improvements(oracle: DataFrame, n: int = 15) -> DataFrame:
    return oracle.orderBy(F.desc("gain"), "sequence_id", "item_id").limit(n)


#: Inference-time features of a crop and its text.
FEATURES = ["recognition_score", "width", "height", "aspect_ratio", "area_ratio", "line_count", "mean_line_height", "characters", "words", "punctuation_ratio", "digit_ratio", "is_vertical"]


def policy_features(rows: DataFrame) -> DataFrame:
    """+ FEATURES, and upper_ratio, mean_word, non_ascii of the text at hand; a null text is empty.

    rows: text, and recognition_score, width, height, page_area, line_count, orientation as far as they are known; what is not there is
    null. Nothing that depends on the truth is a feature.
    """
    text = F.coalesce("text", F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    ratio = lambda pattern: F.regexp_count(text, F.lit(pattern)) / n
    known = {c: F.col(c) if c in rows.columns else F.lit(None).cast(kind) for c, kind in (("recognition_score", "double"), ("width", "double"), ("height", "double"), ("page_area", "double"), ("line_count", "double"), ("orientation", "string"))}
    positive = lambda a, b: F.when(b > 0, a / b)
    made = {
        "recognition_score": known["recognition_score"].cast("double"), "width": known["width"].cast("double"), "height": known["height"].cast("double"), "line_count": known["line_count"].cast("double"),
        "aspect_ratio": positive(known["width"], known["height"]), "area_ratio": positive(known["width"] * known["height"], known["page_area"]), "mean_line_height": positive(known["height"], known["line_count"]),
        "is_vertical": (known["orientation"] == "vertical").cast("double"), "characters": F.length(text), "words": words, "mean_word": F.length(text) / F.greatest(words, F.lit(1)),
        "digit_ratio": ratio(r"\p{Nd}"), "upper_ratio": ratio("[A-Z]"), "punctuation_ratio": ratio("[.,!?;:'\"()\\-]"), "non_ascii": F.regexp_count(text, F.lit("[^ -~]")),
    }
    return rows.withColumns(made)


def feature_summary(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, label, mean, median)."""
    long = rows.select(F.col(label).alias("label"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("x")).select("label", "x.*")
    return long.groupBy("feature", "label").agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"))


def confusion(y: Column, said: Column) -> list[Column]:
    return [F.count_if((y == 1) & (said == 1)).alias("tp"), F.count_if((y == 0) & (said == 1)).alias("fp"), F.count_if((y == 0) & (said == 0)).alias("tn"), F.count_if((y == 1) & (said == 0)).alias("fn")]


def with_rates(counts: DataFrame) -> DataFrame:
    """+ accuracy, balanced_accuracy (of the classes that occur), precision, recall, f1; null where nothing can be divided by."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    div = lambda a, b: F.when(b > 0, a / b)
    sides = F.array_compact(F.array(div(tp, tp + fn), div(tn, tn + fp)))
    return counts.withColumns({"accuracy": div(tp + tn, tp + fp + tn + fn), "balanced_accuracy": F.aggregate(sides, F.lit(0.0), lambda a, x: a + x) / F.size(sides), "precision": div(tp, tp + fp), "recall": div(tp, tp + fn), "f1": div(2 * tp, 2 * tp + fp + fn)})


def verifier_sweep(scores: DataFrame, thresholds: list[float], models: list[str]) -> DataFrame:
    """(model, threshold, counts, rates, wrong_recall, call_rate, wrong_accept_rate) of accepting what scores the threshold or more."""
    long = scores.select("expected", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in models])).alias("m"), F.array(*[F.lit(t) for t in thresholds]).alias("ts"))
    rows = long.select("expected", "m.model", "m.score", F.explode("ts").alias("threshold")).withColumn("said", (F.col("score") >= F.col("threshold")).cast("int"))
    rated = with_rates(rows.groupBy("model", "threshold").agg(*confusion(F.col("expected"), F.col("said"))))
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return rated.withColumns({"wrong_recall": F.when(F.col("tn") + F.col("fp") > 0, F.col("tn") / (F.col("tn") + F.col("fp"))), "call_rate": (F.col("tn") + F.col("fn")) / n, "wrong_accept_rate": F.col("fp") / n})


def always_accept(scores: DataFrame) -> DataFrame:
    """Counts and rates of accepting everything: what any verifier has to beat."""
    return with_rates(scores.agg(*confusion(F.col("expected"), F.lit(1))))


def failure_breakdown(scores: DataFrame, model: str, threshold: float, example: str | None = None, examples: int = 10) -> DataFrame:
    """(source, kind, n): misjudged rows by source and by kind, each with null for the other; + examples, the least few of that column, in order.

    Each task keeps the least few of a group before the shuffle, so groups may have any size.
    """
    wrong = scores.withColumn("kind", F.when((F.col(model) >= threshold) & (F.col("expected") == 0), "false_accept").when((F.col(model) < threshold) & (F.col("expected") == 1), "false_reject")).where("kind IS NOT NULL")
    sets = F.array(F.struct(F.col("source").alias("source"), F.lit(None).cast("string").alias("kind"), F.lit(0).alias("of")), F.struct(F.lit(None).cast("string").alias("source"), F.col("kind").alias("kind"), F.lit(1).alias("of")))
    key = ["of", "source", "kind"]
    rows = wrong.select(F.explode(sets).alias("s"), *([F.col(example).alias("example")] if example else [])).select("s.of", "s.source", "s.kind", *(["example"] if example else []))
    counts = rows.groupBy(*key).agg(F.count("*").alias("n"))
    if not example:
        return counts.drop("of")
    least = rows.where("example IS NOT NULL").withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("example"))).where(F.col("_r") <= examples)
    listed = least.groupBy(*key).agg(F.array_sort(F.collect_list("example")).alias("examples"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    return counts.alias("a").join(listed.alias("b"), same, "left").select("a.source", "a.kind", "a.n", "b.examples")


def group_split(sequences: DataFrame, ratio: float, seed: int) -> DataFrame:
    """+ held_out: max(1, round(n * ratio)) whole sequences, those of least hash. The hash replaces a shuffle by a random generator."""
    hashed = sequences.select("sequence_id").distinct().withColumn("h", F.xxhash64("sequence_id", F.lit(seed))).withColumn("bucket", F.shiftright("h", 52))
    counts = sorted(hashed.groupBy("bucket").count().collect())
    left = int(max(1, round(ratio * sum(n for _, n in counts))))
    last = None
    for bucket, n in counts:
        last = bucket
        if left <= n:
            break
        left -= n
    # Only the bucket in which the last of them lies is ranked.
    edge = hashed.where(F.col("bucket") == F.lit(last)).orderBy("h", "sequence_id").limit(left).agg(F.max(F.struct("h", "sequence_id")).alias("e")).first().e
    if edge is None:
        return sequences.withColumn("held_out", F.lit(False))
    h = F.xxhash64("sequence_id", F.lit(seed))
    below = (h < edge.h) | ((h == edge.h) & (F.col("sequence_id") <= F.lit(edge.sequence_id)))
    return sequences.withColumn("held_out", F.coalesce(below & F.col("sequence_id").isNotNull(), F.lit(False)))

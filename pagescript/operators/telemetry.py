"""Run telemetry: latencies, page counts, diagnostics, run states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latency_profile(timings: DataFrame) -> DataFrame:
    """(stage, calls, total_ms, avg_ms, p50_ms, p95_ms) with percentiles between neighbouring values."""
    ms = F.col("seconds") * 1000
    p = F.percentile(ms, F.array(F.lit(0.5), F.lit(0.95)))
    return timings.groupBy("stage").agg(F.count("*").alias("calls"), F.sum(ms).alias("total_ms"), F.avg(ms).alias("avg_ms"), p[0].alias("p50_ms"), p[1].alias("p95_ms"))


def page_stats(regions: DataFrame, adjudications: DataFrame) -> DataFrame:
    """(sequence_id, page_index, regions, story, spoken): per page, per sequence (page null) and over all (both null)."""
    joined = regions.join(adjudications, ["sequence_id", "page_index", "balloon_pos"], "left")
    return joined.rollup("sequence_id", "page_index").agg(F.count("*").alias("regions"), F.count_if(F.coalesce("include_in_story", F.lit(False))).alias("story"), F.count_if(F.col("text_type") == "dialogue").alias("spoken"))


def run_report(counted: dict[str, DataFrame]) -> DataFrame:
    """(sequence_id, metric, n): how many rows each named table has of each sequence, and of all where sequence_id is null.

    One union and one rollup, summed up where the rows are; see report_tables() for what a run counts.
    """
    out = None
    for metric, rows in counted.items():
        one = rows.select("sequence_id", F.lit(metric).alias("metric"))
        out = one if out is None else out.unionByName(one)
    sets = [[F.col("sequence_id"), F.col("metric")], [F.col("metric")]]
    return out.where("sequence_id IS NOT NULL").groupingSets(sets, "sequence_id", "metric").agg(F.count("*").alias("n"))


def report_tables(regions: DataFrame, balloons: DataFrame, adjudications: DataFrame, candidates: DataFrame, characters: DataFrame, resolved: DataFrame, clusters: DataFrame, pairs: DataFrame, diagnostics: DataFrame) -> dict[str, DataFrame]:
    """What a run counts: regions, balloons, those of the story, candidates, characters; speakers of the story by what is known of them, identity
    clusters (sequence_id, state) by state, pairs of characters, items by what became of them, diagnostics by severity."""
    story = resolved.where("resolution = 'ordered'")
    told = F.col("speaker") == "NARRATION"
    return {
        "regions": regions, "balloons": balloons, "story_decisions": adjudications.where("include_in_story"), "candidates": candidates, "characters": characters,
        "speakers_resolved": story.where(~told & F.col("identity_state").isNotNull()), "speakers_narration": story.where(told), "speakers_unresolved": story.where("speaker IS NULL"), "speakers_ambiguous": story.where("identity_state = 'ambiguous'"),
        "clusters": clusters, **{f"clusters_{state}": clusters.where(F.col("state") == state) for state in ("matched", "ambiguous", "unmatched")}, "pairs": pairs,
        "ordered": story, "excluded": resolved.where("resolution = 'excluded'"), "unresolved": resolved.where("resolution = 'unresolved'"), "diagnostics": diagnostics, "errors": diagnostics.where("severity = 'error'"),
    }


def diagnostic_summary(diagnostics: DataFrame) -> DataFrame:
    """(component, code, severity, n, sequences)."""
    return diagnostics.groupBy("component", "code", "severity").agg(F.count("*").alias("n"), F.countDistinct("sequence_id").alias("sequences"))


def run_states(events: DataFrame, statuses: list[str]) -> DataFrame:
    """(sequence_id, status, at): the newest event of each sequence that is a status."""
    known = events.where(F.col("status").isin(statuses))
    return known.groupBy("sequence_id").agg(F.max(F.struct("at", "event_id", "status")).alias("s")).select("sequence_id", "s.status", "s.at")

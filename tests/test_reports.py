"""Reports: what grounding is compared with, what an order had to do without, what a run counts."""

import pytest

from pagescript.operators import order, speakers, telemetry

K = "sequence_id long, page_index int"


def test_comparison_of_grounding(spark):
    decisions = spark.createDataFrame([(1, 0, 0, 5, "tail_inside", None), (1, 0, 1, 6, "score", 0.7), (1, 0, 2, None, "unknown", 0.3), (1, 0, 3, None, "unknown", None), (1, 0, 4, None, "no_candidate", None), (1, 0, 5, 7, "visual", None)], f"{K}, pos int, character_pos int, rule string, selected_score double")
    labels = spark.createDataFrame([(1, 0, 0, "A"), (1, 0, 1, "B"), (1, 0, 5, None)], f"{K}, pos int, speaker string")
    found = {r.pos: (r.old_character_pos, r.reason, r.old_result, r.new_result) for r in speakers.compare_grounding(decisions, labels=labels).collect()}
    assert found == {
        0: (5, "unique_tail_endpoint_inside_character", "A", "A"), 1: (None, "multi_feature_no_tail", "UNKNOWN", "B"), 2: (None, "insufficient_or_ambiguous_no_tail_evidence", "UNKNOWN", "UNKNOWN"),
        3: (None, "insufficient_or_ambiguous_evidence", "UNKNOWN", "UNKNOWN"), 4: (None, "no_candidates", "UNKNOWN", "UNKNOWN"), 5: (None, "visual", "UNKNOWN", "UNKNOWN"),
    }


def test_order_diagnostics_and_reference_boxes(spark):
    pages = spark.createDataFrame([(1, 0, 200, 100), (1, 1, 0, 0), (1, 2, 50, 50)], f"{K}, width int, height int")
    panels = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 100.0, 50.0, "layout_model"), (1, 1, 1, 0.0, 0.0, 9.0, 9.0, "page_fallback"), (1, 2, 1, 5.0, 5.0, 5.0, 9.0, "layout_model")], f"{K}, panel_pos int, x1 double, y1 double, x2 double, y2 double, source string")
    balloons = spark.createDataFrame([(1, 0, 0, 1, 10.0, 10.0, 30.0, 20.0), (1, 0, 1, 9, 0.0, 0.0, 20.0, 50.0), (1, 0, 2, None, 0.0, 0.0, 20.0, 50.0), (1, 1, 0, None, 0.0, 0.0, 1.0, 1.0)], f"{K}, pos int, panel_pos int, x1 double, y1 double, x2 double, y2 double")
    found = sorted((r.page_index, r.code, r.pos) for r in order.order_diagnostics(pages, balloons, panels).collect())
    assert found == [(0, "balloon_unassigned", 1), (0, "balloon_unassigned", 2), (1, "no_layout_panels", None), (2, "no_layout_panels", None)]
    pair = order.pair_features(order.with_reference(balloons.where("page_index = 0 AND pos < 2"), panels, pages)).first()
    assert (pair.a_rel_cx, pair.a_rel_cy, pair.b_rel_cx, pair.b_rel_cy) == pytest.approx((0.2, 0.3, 0.05, 0.25))


def test_run_report_counts_by_sequence_and_over_all(spark):
    one = spark.createDataFrame([(1,), (1,), (2,), (None,)], "sequence_id long")
    found = {(r.sequence_id, r.metric): r.n for r in telemetry.run_report({"x": one, "y": one.where("sequence_id = 2"), "z": one.limit(0)}).collect()}
    assert found == {(1, "x"): 2, (2, "x"): 1, (None, "x"): 3, (2, "y"): 1, (None, "y"): 1}

"""Resolution of a sequence: all codes, what is told, what is left out, and the rules over the result."""

import pytest

from pagescript.operators import resolve

ORDER = "sequence_id string, balloon_id string, sequence_position int, page_index int"
BALLOONS = "sequence_id string, balloon_id string, page_index int, panel_pos int"
SAID = "sequence_id string, balloon_id string, adj_pos int, text_type string, include_in_story boolean, final_text string"
BY = "sequence_id string, balloon_id string, decision_pos int, character_id string"
PEOPLE = "sequence_id string, page_index int, character_id string"
NAMED = "sequence_id string, character_id string, identity_id string, label string, state string"


@pytest.fixture
def resolved(spark):
    def run(order, balloons=None, said=(), by=(), people=(("p1", 0), ("p2", 1)), named=(("p1", "i1", "A", "matched"),)):
        balloons = [(b, page, None) for b, _, page in order] if balloons is None else balloons
        tables = [
            ([("s", *r) for r in order], ORDER), ([("s", *r) for r in balloons], BALLOONS), ([("s", *r) for r in said], SAID), ([("s", *r) for r in by], BY),
            ([("s", page, c) for c, page in people], PEOPLE), ([("s", *r) for r in named], NAMED),
        ]
        frames = [spark.createDataFrame(rows, schema) for rows, schema in tables]
        return resolve.resolve_sequence(*frames), frames

    return run


def rows(df):
    return {(r.balloon_id, r.sequence_position): r for r in df.collect()}


def test_each_code(resolved):
    order = [(f"b{i}", i, 0) for i in range(10)]
    balloons = [(f"b{i}", 2 if i == 2 else 0, 7) for i in range(10) if i != 0]
    said = [(f"b{i}", 1, "dialogue", True, "x") for i in range(10) if i not in (0, 1)]
    by = [("b2", 0, "p1"), ("b4", 0, "p9"), ("b5", 0, "p2"), ("b6", 0, "p3"), ("b7", 0, "p4"), ("b8", 0, "p1"), ("b3", 0, None)]
    named = [("p1", "i1", "A", "matched"), ("p3", "i3", None, "matched"), ("p4", "i4", "Hero", "ambiguous")]
    df, _ = resolved(order, balloons, said, by, people=[(f"p{i}", 0) for i in range(1, 5)], named=named)
    found = {r.balloon_id: r for r in df.collect()}
    codes = {b: r.codes for b, r in found.items()}
    assert codes == {
        "b0": ["missing_adjudication_result", "balloon_not_in_any_page"], "b1": ["missing_adjudication_result"], "b2": ["page_index_mismatch"], "b3": ["no_speaker_resolved"], "b4": ["invalid_speaker_character_reference"],
        "b5": ["speaker_identity_unresolved"], "b6": ["speaker_identity_label_missing"], "b7": ["speaker_identity_ambiguous"], "b8": [], "b9": ["no_speaker_resolved"],
    }
    assert (found["b0"].reason, found["b1"].reason, found["b2"].reason) == ("balloon_not_in_any_page", "missing_adjudication_result", None)
    assert found["b2"].page_index == 2 and found["b2"].panel_pos == 7
    assert {b: (r.speaker, r.identity_id, r.identity_state) for b, r in found.items() if b in ("b3", "b4", "b5", "b6", "b7", "b8")} == {
        "b3": (None, None, None), "b4": (None, None, None), "b5": (None, None, "unmatched"), "b6": (None, "i3", "ambiguous"), "b7": ("Hero", "i4", "ambiguous"), "b8": ("Character A", "i1", "matched"),
    }
    parts = resolve.split_resolution(df)
    assert {r.balloon_id for r in parts.unresolved.collect()} == {"b0", "b1"} and parts.ordered.count() == 8 and parts.excluded.count() == 0
    severity = {r.code: r.severity for r in parts.diagnostics.collect()}
    assert len(severity) == 8 and severity["page_index_mismatch"] == "warning" and severity["speaker_identity_label_missing"] == "error"


def test_no_identity_result(resolved):
    df, _ = resolved([("b", 0, 0)], said=[("b", 1, "unknown", True, "x")], by=[("b", 0, "p1")], named=[])
    row = df.first()
    assert (row.codes, row.speaker, row.identity_state, row.resolution) == (["no_identity_result"], None, "unmatched", "ordered")


def test_first_decisions_count_and_rows_do_not_multiply(resolved):
    order = [("a", 0, 0), ("b", 1, 0)]
    said = [("a", 2, "sign", False, "no"), ("a", 1, "dialogue", True, "yes"), ("b", 1, "dialogue", True, "x")]
    by = [("a", 1, "p2"), ("a", 0, "p1"), ("a", 0, "p1"), ("b", 0, None), ("b", 1, "p1")]
    named = [("p1", "i1", "A", "matched"), ("p1", "i2", "B", "matched")]
    df, _ = resolved(order, [("a", 1, None), ("a", 0, 3), ("b", 0, None)], said, by, named=named)
    found = {r.balloon_id: r for r in df.collect()}
    assert df.count() == 2
    assert (found["a"].final_text, found["a"].character_id, found["a"].identity_id, found["a"].speaker, found["a"].page_index, found["a"].panel_pos) == ("yes", "p1", "i1", "Character A", 0, 3)
    # The first decision is that nobody speaks.
    assert found["b"].codes == ["no_speaker_resolved"]


@pytest.mark.parametrize("kind", resolve.NARRATION)
def test_what_is_told_needs_no_speaker(resolved, kind):
    df, _ = resolved([("b", 0, 0)], said=[("b", 1, kind, True, "x")], by=[("b", 0, "p9")])
    row = df.first()
    assert (row.speaker, row.identity_state, row.codes, row.character_id) == ("NARRATION", None, [], "p9")


def checked(frames, df):
    parts = resolve.split_resolution(df)
    characters, named = frames[4], frames[5]
    consistency = sorted((r.code, r.page_index, r.balloon_id, r.identity_id, r.character_id) for r in resolve.consistency_checks(parts.ordered, named, characters).collect())
    expected = frames[0].select("sequence_id").distinct()
    violations = sorted((r.rule, r.page_index, r.balloon_id, r.identity_id, r.label) for r in resolve.validate_resolution(parts.ordered, parts.excluded, characters, named, expected).collect())
    return consistency, violations


def test_what_is_left_out_is_no_violation(resolved):
    order = [("a", 0, 2), ("b", 1, 0), ("b", 2, 0), ("c", 3, 2)]
    said = [("a", 1, "sign", False, ""), ("b", 1, "sign", False, " "), ("c", 1, "narration", True, "x")]
    df, frames = resolved(order, None, said)
    assert checked(frames, df) == ([], [])
    assert {r.balloon_id for r in resolve.split_resolution(df).excluded.collect()} == {"a", "b"}
    assert [r.text for r in resolve.submission_rows(resolve.split_resolution(df).ordered).collect()] == ["x"]


def test_contradictions(resolved):
    order = [("a", 0, 1), ("b", 1, 0), ("a", 2, 1), ("c", 3, 3), ("d", 4, 3), (" ", 5, 3)]
    said = [(b, 1, "dialogue", b != "d", "　\n" if b == "c" else "x") for b in ("a", "b", "c", "d", " ")]
    by = [("a", 0, "p1"), ("b", 0, "p2"), ("c", 0, "p9"), (" ", 0, "p3")]
    named = [("p1", "i1", "A", "matched"), ("p2", "i1", "B", "matched"), ("p3", "i3", "A", "matched"), ("p7", "i7", "NARRATION", "matched"), ("p8", "i8", "NARRATION", "matched")]
    df, frames = resolved(order, None, said, by, people=[("p1", 0), ("p2", 0), ("p3", 1)], named=named)
    consistency, violations = checked(frames, df)
    assert consistency == [
        ("duplicate_balloon_in_sequence", None, "a", None, None), ("identity_label_conflict", None, None, "i1", None), ("identity_references_unknown_character", None, None, None, "p7"),
        ("identity_references_unknown_character", None, None, None, "p8"), ("page_order_violation", 0, "b", None, None), ("same_page_identity_collapse", 0, None, "i1", None),
    ]
    assert violations == [
        ("all_page_indices_valid", 3, " ", None, None), ("all_page_indices_valid", 3, "c", None, None), ("all_page_indices_valid", 3, "d", None, None), ("every_balloon_has_source_id", 3, " ", None, None), ("exactly_three_pages", None, None, None, None),
        ("no_duplicate_balloon", 1, "a", None, None), ("no_identity_label_conflicts", None, None, "i1", None), ("page_order_monotonic", 0, "b", None, None), ("sequence_labels_deterministic", None, None, None, "A"),
        ("speaker_references_valid_character", 3, "c", None, None), ("text_exists_for_story_balloons", 3, "c", None, None),
    ]


def test_labels_and_sequences_that_nobody_knows(spark, resolved):
    df, frames = resolved([("a", 0, 0)], said=[("a", 1, "dialogue", True, "x")], by=[("a", 0, "p1")])
    parts = resolve.split_resolution(df)
    others = spark.createDataFrame([("s", "i1", "Z"), ("t", "i1", "A")], "sequence_id string, identity_id string, label string")
    found = resolve.validate_resolution(parts.ordered, parts.excluded, frames[4], others, frames[0].select("sequence_id").where("sequence_id = 't'"))
    assert sorted((r.rule, r.label) for r in found.collect()) == [("no_output_references_different_sequence", None), ("speaker_label_maps_to_valid_identity", "Character A")]


def test_items_of_a_wrong_page_count_are_not_judged(spark):
    page = [{"speaker": "A", "text": "x"}, {"speaker": " ", "text": "y"}, {"speaker": "B", "text": "[balloon 3]"}, {"speaker": "C", "text": "　"}]
    rows_ = [(0, "s", [page, [], []]), (1, "t", [page, []]), (2, "u", None)]
    schema = "position int, sequence_id string, pages array<array<struct<speaker:string,text:string>>>"
    table = spark.createDataFrame(rows_, schema)
    template = spark.createDataFrame([(0, "s"), (1, "t"), (2, "u")], "position int, sequence_id string")
    found = sorted((r.sequence_id, r.page_index, r.error) for r in resolve.submission_errors(table, template).collect())
    assert found == [("s", 0, "invalid_item"), ("s", 0, "invalid_item"), ("s", 0, "placeholder"), ("t", None, "page_count"), ("u", None, "page_count")]
    assert [(r.speaker, r.n) for r in resolve.speaker_histogram(table).collect()] == [("A", 1)]


def test_empty_tables(resolved):
    df, frames = resolved([], [], people=[], named=[])
    assert df.count() == 0 and checked(frames, df) == ([], [])

"""Named cases of what is easy to get wrong, and order-dependent operators against plain models."""

import random

import pytest
from pyspark.sql import functions as F

from pagescript.functions import text as T
from pagescript.operators import boxes, evidence, identity, layout, order, policy, resolve, score, spatial, speakers, suppress
from pagescript.sources import transcripts

BOX = "sequence_id long, page_index int, pos int, x1 double, y1 double, x2 double, y2 double"


def box_rows(rng, n, pages=3):
    out = []
    for i in range(n):
        x, y = rng.randrange(0, 200), rng.randrange(0, 200)
        out.append((1, i % pages, i, float(x), float(y), float(x + rng.randrange(5, 90)), float(y + rng.randrange(5, 90))))
    return out


def iou(a, b):
    w = max(0, min(a[5], b[5]) - max(a[3], b[3]))
    h = max(0, min(a[6], b[6]) - max(a[4], b[4]))
    inter = w * h
    return inter / ((a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - inter)


def test_a_suppressed_box_suppresses_no_other(spark):
    rows = box_rows(random.Random(1), 60)
    expected = set()
    for page in range(3):
        kept = []
        for r in sorted((r for r in rows if r[1] == page), key=lambda r: (r[4], r[3], r[2])):
            if not any(iou(k, r) >= 0.2 for k in kept):
                kept.append(r)
        expected |= {r[2] for r in kept}
    table = spark.createDataFrame(rows, BOX).repartition(5)
    found = suppress.suppress_overlaps(table, boxes.KEYS, [F.col("y1"), F.col("x1")], 0.2, "pos")
    assert {r.pos for r in found.collect()} == expected


def test_tournament_order_follows_in_degrees_and_then_positions(spark):
    rng = random.Random(7)
    edges, nodes, expected = [], [], {}
    for g in range(40):
        n = rng.randrange(1, 7)
        before = {i: set() for i in range(n)}
        for a in range(n):
            for b in range(a + 1, n):
                first, second = (a, b) if rng.random() < 0.75 else (b, a)
                before[second].add(first)
                edges.append((g, 0, first, second))
        nodes += [(g, 0, i) for i in range(n)]
        done, rest = [], set(range(n))
        while rest:
            free = [i for i in rest if not before[i] & rest]
            if len(free) != 1:
                break
            done.append(free[0])
            rest.remove(free[0])
        expected |= {(g, p): r for r, p in enumerate(done + sorted(rest))}
    found = order.balloon_order(spark.createDataFrame(nodes, "sequence_id long, page_index int, pos int"), spark.createDataFrame(edges, "sequence_id long, page_index int, first int, second int"))
    assert {(r.sequence_id, r.pos): r.balloon_rank for r in found.collect()} == expected


def test_containment_within_a_pixel_orders_but_does_not_assign(spark):
    rows = [(1, 0, 0, 0.0, 0.0, 100.0, 100.0), (1, 0, 1, 10.0, 10.0, 100.5, 50.0)]
    pair = order.pair_features(spark.createDataFrame(rows, BOX)).first()
    assert pair.a_contains_b and not pair.b_contains_a
    panels = spark.createDataFrame([(1, 0, 7, 0.0, 0.0, 100.0, 100.0)], BOX.replace(" pos ", " panel_pos "))
    regions = spark.createDataFrame(rows[1:], BOX).withColumnRenamed("pos", "region_pos")
    assert spatial.assign_panels(regions, panels).first().confidence == 0.65


def test_page_without_panels_leaves_regions_unassigned(spark):
    regions = spark.createDataFrame(box_rows(random.Random(2), 3), BOX).withColumnRenamed("pos", "region_pos")
    none = spark.createDataFrame([], BOX.replace(" pos ", " panel_pos "))
    assert {r.status for r in spatial.assign_panels(regions, none).collect()} == {"unassigned"}


def test_missing_pair_edge_counts_half(spark):
    rows = [(1, 0, i, 10.0 * i, 0.0, 10.0 * i + 9, 9.0) for i in range(3)]
    regions = spark.createDataFrame(rows, BOX).withColumnRenamed("pos", "region_pos")
    edges = spark.createDataFrame([(1, 0, 0, 1, 0.88, "geometry"), (1, 0, 1, 2, 0.76, "containment")], "sequence_id long, page_index int, a_pos int, b_pos int, confidence double, method string")
    group = layout.geometry_groups(regions, layout.group_components(regions, edges), edges).first()
    assert (group.members, group.confidence, group.method) == ([0, 1, 2], 0.5, "hybrid")


def test_components_equal_a_plain_model(spark):
    rng = random.Random(3)
    nodes = [(1, p, i) for p in range(6) for i in range(14)]
    pairs = [(1, p, *sorted(rng.sample(range(14), 2))) for p in range(6) for _ in range(9)]
    label = {(p, i): i for _, p, i in nodes}
    for _ in range(20):
        for _, p, a, b in pairs:
            low = min(label[p, a], label[p, b])
            for key in [(p, a), (p, b)]:
                old = label[key]
                label.update({k: low for k in label if k[0] == p and label[k] == old})
    found = layout.group_components(spark.createDataFrame(nodes, "sequence_id long, page_index int, region_pos int"), spark.createDataFrame(pairs, "sequence_id long, page_index int, a_pos int, b_pos int"))
    assert {(r.page_index, r.region_pos): r.component for r in found.collect()} == label


def test_one_character_per_page_blocks_a_merge(spark):
    characters = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 0, 3), (1, 2, 4)], "sequence_id long, page_index int, character_id long")
    edges = spark.createDataFrame([(1, 1, 2, 0, 1, 0.9), (1, 2, 3, 1, 0, 0.8), (1, 3, 4, 0, 2, 0.7), (1, 1, 4, 0, 2, 0.6)], "sequence_id long, a_id long, b_id long, a_page int, b_page int, score double")
    found = {r.character_id: r.cluster for r in identity.constrained_clusters(characters, edges).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 3}


def test_letters_of_labels(spark):
    rows = spark.createDataFrame([(0,), (25,), (26,), (51,), (52,), (701,), (702,)], "n long").select("n", identity.letters(F.col("n")).alias("l"))
    assert {r.n: r.l for r in rows.collect()} == {0: "A", 25: "Z", 26: "AA", 51: "AZ", 52: "BA", 701: "ZZ", 702: "AAA"}


def test_an_inconclusive_tail_forbids_the_score(spark):
    schema = "sequence_id long, page_index int, pos int, character_pos int, score double, same_panel boolean, overlap double, has_tail boolean, tail_inside boolean, tail_distance double"
    rows = [(1, 0, 0, 5, 0.95, True, 1.0, True, False, 0.2), (1, 0, 0, 6, 0.1, True, 0.0, True, False, 0.21), (1, 0, 1, 5, 0.95, True, 1.0, False, None, None), (1, 0, 1, 6, 0.1, True, 0.0, False, None, None)]
    balloons = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 0, 2)], "sequence_id long, page_index int, pos int")
    found = {r.pos: (r.rule, r.character_pos) for r in speakers.resolve_speakers(balloons, spark.createDataFrame(rows, schema)).collect()}
    assert found == {0: ("unknown", None), 1: ("score", 5), 2: ("no_candidate", None)}


def test_one_clear_tip_is_a_tail(spark):
    circle = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (6.0, 10.0), (5.0, 40.0), (4.0, 10.0), (0.0, 10.0)]
    rows = [(1, 0, 0, [{"x": x, "y": y} for x, y in circle]), (1, 0, 1, [{"x": x, "y": y} for x, y in circle[:4]]), (1, 0, 2, [])]
    found = speakers.balloon_tails(spark.createDataFrame(rows, "sequence_id long, page_index int, pos int, polygon array<struct<x:double,y:double>>")).collect()
    assert [(r.pos, r.tail_x, r.tail_y) for r in found] == [(0, 5.0, 40.0)]


def test_any_overlap_without_a_sure_panel_is_ambiguous(spark):
    box = "x1 double, y1 double, x2 double, y2 double"
    regions = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 100.0, 100.0), (1, 0, 1, 60.0, 10.0, 90.0, 20.0), (1, 0, 2, 500.0, 500.0, 510.0, 510.0), (1, 0, 3, 5.0, 5.0, 5.0, 9.0), (1, 0, 4, 900.0, 900.0, 920.0, 920.0)], f"sequence_id long, page_index int, region_pos int, {box}")
    panels = spark.createDataFrame([(1, 0, 1, 50.0, 0.0, 200.0, 100.0, "layout_model"), (1, 0, 2, 0.0, 0.0, 40.0, 100.0, "layout_model"), (1, 0, 3, 850.0, 850.0, 950.0, 950.0, "page_fallback")], f"sequence_id long, page_index int, panel_pos int, {box}, source string")
    found = {r.region_pos: r for r in spatial.assign_panels(regions, panels).collect()}
    assert {i: (r.status, r.panel_pos, r.confidence, r.candidates, r.covers) for i, r in found.items()} == {
        0: ("ambiguous", None, None, [1, 2], [0.5, 0.4]), 1: ("assigned", 1, 0.95, [1], []), 2: ("unassigned", None, None, [], []), 3: ("unassigned", None, None, [], []), 4: ("assigned", 3, 0.5, [3], []),
    }
    characters = regions.withColumnRenamed("region_pos", "character_pos")
    assert {r.character_pos: r.panel_pos for r in spatial.character_panels(characters, panels).collect()} == {0: None, 1: 1, 2: None, 3: None, 4: None}


def test_payloads_of_every_kind(spark):
    payloads = ['{"text": " a "}', '{"res": {"text": "b"}}', '{"text": "broken', "plain words", '"a string"', "[1]", "5", '{"text": ""}', None]
    raw = spark.createDataFrame([(i, source, p) for i, p in enumerate(payloads) for source in ("x", "y")], "region_id int, source string, payload string")
    found = sorted((r.region_id, r.source, r.text) for r in evidence.normalize_candidates(raw, {"x": ["text", "transcription"], "y": ["text"]}).collect())
    assert found == [(0, "x", "a"), (0, "y", "a"), (1, "x", "b"), (1, "y", "b"), (2, "x", '{"text": "broken'), (3, "x", "plain words")]


def test_refused_merges_and_unused_labels(spark):
    edge = "sequence_id long, a_id long, b_id long, a_page int, b_page int, score double"
    edges = spark.createDataFrame([(1, 1, 2, 0, 1, 0.9), (1, 2, 3, 1, 0, 0.8), (1, 1, 4, 0, 2, 0.5)], edge)
    people = spark.createDataFrame([(1, i, p) for i, p in ((1, 0), (2, 1), (3, 0), (4, 2))], "sequence_id long, character_id long, page_index int")
    clusters = identity.constrained_clusters(people, edges)
    assert {(r.a_id, r.b_id, r.code) for r in identity.merge_diagnostics(clusters, edges).collect()} == {(1, 4, "ambiguous_edge"), (2, 3, "same_page_constraint_violated")}
    placed = people.withColumns({"y1": -F.col("character_id"), "x1": F.lit(0)})
    labels = {r.cluster: r.label for r in identity.label_clusters(clusters, placed, edges.limit(0)).collect()}
    assert labels == {3: "Character A", 1: "Character B", 4: "Character C"}
    known = spark.createDataFrame([(1, 2, "identity-007", "A"), (1, 1, "special", "C")], "sequence_id long, character_id long, identity string, label string")
    filled = {r.character_id: (r.identity, r.label) for r in identity.fill_singletons(known, placed).collect()}
    assert filled == {2: ("identity-007", "A"), 1: ("special", "C"), 3: ("identity-008", "B"), 4: ("identity-009", "D")}


def brute_alignment(gold, predicted):
    best = {(0, 0): 0.0}
    for i in range(len(gold) + 1):
        for j in range(len(predicted) + 1):
            options = [best.get((i - 1, j), -1), best.get((i, j - 1), -1)]
            if i and j:
                options.append(best[i - 1, j - 1] + score.token_weight(gold[i - 1], predicted[j - 1]))
            best[i, j] = max(0.0, *options)
    return best[len(gold), len(predicted)]


def test_alignment_has_the_greatest_weight_and_is_monotone():
    rng = random.Random(5)
    for _ in range(60):
        gold, predicted = ([rng.choice(["alpha", "alphb", "beta", "bet", "x", "y"]) for _ in range(rng.randrange(0, 12))] for _ in range(2))
        pairs = score.align(gold, predicted)
        assert sum(w for *_, w in pairs) == pytest.approx(brute_alignment(gold, predicted))
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:]))


def test_assignment_equals_brute_force():
    from itertools import permutations

    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(40):
        n, m = rng.integers(1, 5, 2)
        table = rng.integers(0, 9, (n, m)).astype(float)
        size = max(n, m)
        full = np.zeros((size, size))
        full[:n, :m] = table
        best = max(sum(full[i, p[i]] for i in range(size)) for p in permutations(range(size)))
        found = score.assignment({(f"p{i}", f"g{j}"): table[i, j] for i in range(n) for j in range(m)})
        assert sum(table[int(p[1:]), int(g[1:])] for p, g in found.items()) == best and len(set(found.values())) == len(found)


SF = "/root/testdata/sf0.001"
LINE = "sequence_id long, page_index int, line_index int, speaker string, text string"


def test_scores_of_hand_worked_sequences(spark):
    gold = [(1, 0, 0, "A", "Hello “World”"), (2, 0, 0, None, "one two three"), (3, 1, 0, "A", "alpha beta"), (4, 0, 0, "A", "alpha beta"), (4, 0, 1, "B", "gamma"), (5, 2, 0, "NARRATION", "wait..... here")]
    predicted = [(1, 0, 0, "X", 'hello "world"'), (2, 0, 0, "X", "one two three"), (4, 0, 0, "X", "alpha beta"), (4, 0, 1, "Y", "gamma"), (4, 0, 2, "Z", "delta"), (5, 2, 0, "X", "wait... here")]
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 9)], "sequence_id long")
    have = ids.where("sequence_id <> 3")
    scores = score.score_sequences(spark.createDataFrame(gold, LINE), spark.createDataFrame(predicted, LINE), ids, have)
    found = {r.sequence_id: r for r in scores.collect()}
    values = {i: tuple(None if r[m] is None else round(r[m], 6) for m in score.METRICS) for i, r in found.items()}
    # text order, balanced, accuracy, joint, coverage
    assert values == {
        1: (1, 1, 1, 1, 1), 2: (1, None, None, None, 1), 3: (0, 0, 0, 0, 0), 4: (round(1 - 6 / 22, 6), round(2 / 3, 6), 1, round(6 / 7, 6), 1), 5: (1, 0, 0, 0, 1), 9: (1, None, None, None, 1),
    }
    assert [tuple(found[2][c] for c in [*score.COUNTS, *score.WEIGHTS])] == [(3, 3, 0, 0, 0, 0)]
    assert [tuple(found[4][c] for c in [*score.COUNTS, *score.WEIGHTS])] == [(3, 4, 3, 4, 3, 3)]
    assert {i: (r.missing_sequence, r.active_text_pages) for i, r in found.items()} == {1: (False, 1), 2: (False, 1), 3: (True, 1), 4: (False, 1), 5: (False, 1), 9: (False, 0)}
    mean = score.macro_scores(scores, have).first()
    assert (mean.sequences, mean.missing_sequences) == (6, 1)
    assert mean.text_order_score == pytest.approx((3 + 16 / 22) / 5) and mean.matched_token_coverage == pytest.approx(4 / 5)
    assert mean.balanced_joint_f1 == pytest.approx((1 + 2 / 3) / 4) and mean.joint_f1 == pytest.approx((1 + 6 / 7) / 4) and mean.speaker_accuracy_on_matched == pytest.approx(2 / 4)
    only = score.macro_scores(scores.where("sequence_id = 9")).first()
    assert only.text_order_score == 1 and only.joint_f1 is None
    with pytest.raises(ValueError):
        score.macro_scores(scores, spark.createDataFrame([(77,)], "sequence_id long"))


def test_tokens_leave_low_lines_out(spark):
    text = spark.createDataFrame([("snake_case it's well-known ... né\u00a0x",)], "t string")
    assert text.select(T.tokens(F.col("t")).alias("w")).first().w == ["snake", "case", "it's", "well-known", ".", ".", ".", "né", "x"]


def test_error_rates_count_code_points_and_words(spark):
    rows = spark.createDataFrame([("été", "ete", "a b c", "a x c d"), ("", "x", "", "x"), ("", "", "", "")], "t string, f string, u string, g string")
    found = rows.select(T.char_error_rate(F.col("t"), F.col("f")).alias("c"), T.word_error_rate(F.col("u"), F.col("g")).alias("w")).collect()
    assert [(round(r.c, 6), round(r.w, 6)) for r in found] == [(0.666667, 0.666667), (1.0, 1.0), (0.0, 0.0)]


def test_scorer_form_folds_and_tidies(spark):
    rows = spark.createDataFrame([("Ｈｅｌｌｏ  “WORLD” ....",), ("A , b ( c )",), ("Straße​",), (None,)], "t string")
    assert [r.s for r in rows.select(T.scorer(F.col("t")).alias("s")).collect()] == ['hello "world"...', "a, b (c)", "strasse", None]


def test_confidences_that_are_none(spark):
    rows = spark.createDataFrame([("0.5",), ("true",), ("NaN",), ("2.0",), ("-0.1",), ("x",), (None,), ("1",)], "c string")
    assert [r.v for r in rows.select(evidence.clean_confidence(F.col("c")).alias("v")).collect()] == [0.5, None, None, None, None, None, None, 1.0]


def test_equal_candidates_collapse_and_conflicts_are_reported(spark):
    rows = [(1, "a", "x", 0), (1, "a", "x", 1), (1, "b", "x", 2), (1, "b", "y", 3)]
    once, conflicts = suppress.dedupe_candidates(spark.createDataFrame(rows, "region_id long, candidate_id string, text string, position int"), ["region_id", "candidate_id"], "position")
    assert once.count() == 3 and {r.candidate_id for r in conflicts.collect()} == {"b"}


def line(*items, sequence="s9", pages=3):
    import json

    return json.dumps({"sequence_id": sequence, "pages": [[{"speaker": a, "text": t} for a, t in items], *[[] for _ in range(pages - 1)]]}, ensure_ascii=False)


def test_strict_transcripts(spark):
    good = ['{"sequence_id": "s1", "pages": [[{"speaker": "UNKNOWN", "text": "a\\tb\\n"}], [], [{"speaker": "B", "text": "b"}]]}', "", "   ", '{"sequence_id": "s2", "pages": [[{"speaker": null, "text": "c"}], [], []]}']
    bad = [
        '{"sequence_id": "s2", "sequence_id": "s2", "pages": [[], [], []]}', '{"sequence_id": " s3", "pages": [[], [], []]}', '{"sequence_id": "s4", "pages": [[], []]}', '{"sequence_id": "s5", "pages": ["", "", ""]}', "nothing", "[1]", "5",
        line(("B", " ")), line(("B", "\u200b")), line((5, "x")), line((" B", "x")), line(("", "x")), line(("B", 7)), line(("B", "x\u0085y\u0080")), line(("B", "x\u007f")), '{"sequence_id": "s6", "pages": [[{"speaker": "B"}], [], []]}',
        '{"sequence_id": "s7", "pages": [5, [], []]}', '{"sequence_id": "s8", "pages": {"a": 1, "b": 2, "c": 3}}', '{"sequence_id": 8, "pages": [[], [], []]}', '{"sequence_id": "t", "pages": [[], [], []]}', '{"sequence_id": "t", "pages": [[], [], []]}',
    ]
    lines = spark.createDataFrame([(x,) for x in [*good, *bad]], "value string")
    rows, rejected = transcripts.read_transcripts(lines, reference=True)
    assert sorted((r.sequence_id, r.page_index, r.speaker, r.text) for r in rows.collect()) == [("s1", 0, None, "a\tb\n"), ("s1", 2, "B", "b"), ("s2", 0, None, "c")]
    assert rejected.count() == len(bad) - 1
    with pytest.raises(ValueError):
        transcripts.read_transcripts(lines, reference=True, strict=True)
    # Null speakers are for references alone.
    assert transcripts.read_transcripts(spark.createDataFrame([(good[3],)], "value string"))[1].count() == 1


def test_missing_files_and_strict_manifests(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    for name in ("a b/1.png", "2.png"):
        (tmp_path / name).write_bytes(b"x")
    pages = spark.createDataFrame([("s", 0, "a b/1.png"), ("s", 1, "2.png"), ("s", 2, "3.png")], "sequence_id string, page_index int, image_path string")
    assert [r.image_path for r in transcripts.missing_files(spark, pages, str(tmp_path)).collect()] == ["3.png"]
    (tmp_path / "m.json").write_text('[{"sequence_id": "b", "split": "other", "images": ["1", "2", "3"]}]')
    with pytest.raises(ValueError):
        transcripts.read_sequences(spark, str(tmp_path / "m.json"), strict=True)


def test_manifest_and_transcripts_round_trip(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"sequence_id": "a", "split": "test", "images": ["1", "2", "3"]}, {"sequence_id": "b", "split": "other", "images": ["1", "2", "3"]}, {"split": "test", "images": []}]')
    good, rejected = transcripts.read_sequences(spark, str(tmp_path / "m.json"))
    assert [r.sequence_id for r in good.collect()] == ["a"] and {r.reason for r in rejected.collect()} == {"bad_split", "missing_id"}
    lines = spark.createDataFrame([("a", 1, 0, "X", "hé")], "sequence_id string, page_index int, line_index int, speaker string, text string")
    transcripts.write_transcripts(lines, good, str(tmp_path / "out"))
    again, errors = transcripts.read_transcripts(spark.read.text(str(tmp_path / "out")))
    assert again.collect() == lines.collect() and errors.count() == 0
    transcripts.table_sink(good, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    (tmp_path / "o.jsonl").write_text('{"sequence_id": "a", "n": 1}\n{"sequence_id": "b", "n": 2}\n')
    row = transcripts.read_oracle_rows(spark, [str(tmp_path / "o.jsonl")], "sequence_id string, n int", "b").collect()
    assert [(r.n, r.file_name) for r in row] == [(2, "o.jsonl")]


def test_results_do_not_depend_on_row_order(spark):
    rows = box_rows(random.Random(11), 40)
    results = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        table = spark.createDataFrame(rows, BOX).repartition(seed + 2)
        ranked = order.balloon_order(table, order.order_edges(order.pair_features(table)))
        results.append(sorted(map(tuple, ranked.collect())))
    assert results[0] == results[1]


def test_group_split_is_whole(spark):
    split = policy.group_split(spark.range(20).select(F.col("id").alias("sequence_id")), 0.25, 3)
    assert split.where("held_out").count() == 5


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_text_queries_take_rows_in_any_alphabet(spark):
    import re

    from pagescript.fixtures import load
    from pagescript.plans.records import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    plain = {r.doc_id: r.plain for r in QUERIES["t1_normalize_text"](spark, SF).collect()}
    sizes = {r.doc_id: r.tokens for r in QUERIES["t2_tokenize"](spark, SF).collect()}
    assert any(not t.isascii() for t in texts.values())
    assert plain == {d: re.sub(r"[ \t\n\x0b\f\r]+", " ", t.upper()).strip(" ") for d, t in texts.items()}
    assert sizes == {d: len(re.findall(r"[^\W_]+(?:['\-][^\W_]+)*|[^\s\w]", t.lower())) for d, t in texts.items()}
    actions = {(r.item_id, r.action): (r.target_text, r.text) for r in load(spark, SF, "fx_actions")[0].collect()}
    errors = {(r.item_id, r.action): r.cer for r in QUERIES["t3_char_error_rate"](spark, SF).collect()}
    assert set(errors) == set(actions)
    some = [k for k in sorted(k for k, (t, f) in actions.items() if not t.isascii() and t != f)][::10]
    assert some and all(errors[k] == pytest.approx(levenshtein(*actions[k]) / len(actions[k][0]), abs=1e-6) for k in some)
    for name in ("t4_word_error_rate", "t8_fuzzy_ratio", "x7_policy_features"):
        assert {(r.item_id, r.action) for r in QUERIES[name](spark, SF).collect()} == set(actions)
    gold, pred = load(spark, SF, "fx_gold", "fx_pred")
    pages = {(r.sequence_id, r.page_index) for r in gold.unionByName(pred).where("text <> ''").collect()}
    assert {(r.sequence_id, r.page_index) for r in QUERIES["t9_page_text_score"](spark, SF).collect()} == pages


def test_an_action_without_text_is_never_best(spark):
    rows = [(1, 1, "NONE", 1, 0.5), (1, 1, "UPSCALE", 2, None), (1, 1, "CONTRAST", 3, 0.2)]
    table = spark.createDataFrame(rows, "sequence_id long, item_id long, action string, action_pos int, cer double")
    assert policy.oracle_actions(table).first().best_action == "CONTRAST"


def test_fixtures_hold_whole_texts(spark):
    from pagescript.fixtures import load

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    regions = sorted((r.region_id, r.text) for r in load(spark, SF, "fx_candidates")[0].where("source = 'nemotron'").collect())
    found = {d: "" for d in texts}
    for region, text in regions:
        found[region // 1000000] += text
    assert found == texts and len({r for r, _ in regions}) == len(regions)
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    assert {(r.item_id, r.target_text) for r in load(spark, SF, "fx_actions")[0].collect()} == set(items.items())


def test_every_region_is_compared(spark):
    from pagescript.fixtures import load
    from pagescript.plans.records import QUERIES

    regions = load(spark, SF, "fx_candidates")[0].select("region_id").distinct()
    assert QUERIES["c5_candidate_similarity"](spark, SF).count() == 6 * regions.count()


def test_group_split_ranks_one_bucket_only(spark):
    table = spark.range(5000).withColumnRenamed("id", "sequence_id")
    found = policy.group_split(table, 0.2, 7)
    least = table.orderBy(F.xxhash64("sequence_id", F.lit(7)), "sequence_id").limit(1000)
    assert {r.sequence_id for r in found.where("held_out").collect()} == {r.sequence_id for r in least.collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "TakeOrdered" not in plan and "Exchange" not in plan
    assert policy.group_split(table.limit(0), 0.2, 7).count() == 0


def test_covers_are_rounded_as_in_sql(spark):
    """The cover is 0.2615625 but for its last bit; times 10^6 it lies below the half, while the decimal that is printed does not."""
    import duckdb

    from pagescript.functions.tables import rounded

    values = [i / 128 / 5**j for i in range(-300, 300) for j in range(5)] + [0.2615625, 0.5 - 2**-54, 0.0]
    found = [r.v for r in spark.createDataFrame([(v,) for v in values], "v double").select(rounded("v").alias("v")).collect()]
    assert found == [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]
    table = spark.createDataFrame([(v,) for v in (None, float("nan"))], "v double")
    assert [r.v is None or r.v != r.v for r in table.select(rounded("v").alias("v")).collect()] == [True, True]

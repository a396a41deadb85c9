"""Banks, fields of sources, fallback texts, rules on records, word rates and alignments."""

import json
import random
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from pagescript.functions import text as T
from pagescript.operators import evidence, rules, score

CANDIDATE = "region_id string, candidate_id string, text string, confidence double, position int"


def test_banks_keep_each_candidate_once_in_order(spark):
    regions = spark.createDataFrame([("r2", 0), ("r1", 1), ("none", 2)], "region_id string, region_pos int")
    rows = [("r1", "a", "x", 0.5, 2), ("r1", "a", "x", 0.5, 0), ("r1", "b", "x", None, 1), ("r2", "a", "y", None, 5)]
    bank, errors = evidence.checked_bank(regions, spark.createDataFrame(rows, CANDIDATE), ["region_id"])
    found = {r.region_id: (r.region_pos, [(c.position, c.candidate_id) for c in r.candidates]) for r in bank.collect()}
    assert found == {"r1": (1, [(0, "a"), (1, "b")]), "r2": (0, [(5, "a")])} and errors.count() == 0
    assert evidence.checked_bank(regions, spark.createDataFrame(rows, CANDIDATE), ["region_id"], strict=True)[0].count() == 2


def test_bank_errors(spark):
    regions = spark.createDataFrame([("r1", 0), ("r2", 1), ("r2", 2), ("r3", 3)], "region_id string, region_pos int")
    rows = [("r1", "a", "x", 0.5, 0), ("r1", "a", "x", 0.6, 1), ("r1", "b", "z", 0.6, 2), ("r2", "a", "x", None, 3), ("lost", "a", "x", None, 4), ("lost", "a", "x", None, 5), (None, "a", "x", None, 6)]
    table = spark.createDataFrame(rows, CANDIDATE)
    bank, errors = evidence.checked_bank(regions, table, ["region_id"])
    assert sorted((str(r.region_id), str(r.candidate_id), r.error) for r in errors.collect()) == [("None", "a", "unknown_region"), ("lost", "a", "unknown_region"), ("r1", "a", "conflicting_candidate"), ("r2", "None", "repeated_region")]
    assert {r.region_id: [c.candidate_id for c in r.candidates] for r in bank.collect()} == {"r1": ["b"]}
    with pytest.raises(ValueError):
        evidence.checked_bank(regions, table, ["region_id"], strict=True)


FIELDS = [
    ("ocr_base", {"rec_text": " a ", "rec_score": 0.5}, {"text": "a", "ocr_confidence": 0.5, "visual_confidence": None}), ("ocr_rotate_cw", {"rec_text": None, "text": "b", "score": "0.25"}, {"text": "b", "ocr_confidence": 0.25}),
    ("ocr_base", {"text": "c", "rec_score": None, "score": 0.9}, {"ocr_confidence": None}), ("ocr_base", {"text": "c", "rec_score": True}, {"ocr_confidence": None}), ("ocr_base", {"text": "c", "rec_score": 1.5}, {"ocr_confidence": None}),
    ("nemotron", {"rec_text": "no", "transcription": "no", "text": "d", "confidence": 1, "visual_confidence": 0.5}, {"text": "d", "ocr_confidence": 1.0, "visual_confidence": None}),
    ("qwen3_vl", {"text": "no", "transcription": "e", "ocr_confidence": "x", "rec_score": 0.5, "visual_confidence": 0.75, "candidate_supported": True, "text_type": "Sound Effect", "notes": 5}, {"text": "e", "ocr_confidence": None, "visual_confidence": 0.75, "candidate_supported": True, "semantic_type": "sound_effect", "notes": "5"}),
    ("fused", {"rec_text": "f", "candidate_supported": "true", "text_type": 5, "semantic_type": "sign"}, {"text": "f", "candidate_supported": None, "semantic_type": "unknown"}), ("fused", {"res": {"text": "g", "semantic_type": "vocalization"}}, {"text": "g", "semantic_type": "vocalisation"}),
    ("nemotron", {"text": "h", "bbox": [0.5, 0, 0.25, 1]}, {"bx1": 102.5, "bx2": 105.0, "by1": 0.0, "by2": 20.0}), ("nemotron", {"text": "h", "left": 2, "upper": 3, "right": 1, "lower": 0}, {"bx1": 101.0, "bx2": 102.0, "by1": 0.0, "by2": 3.0}),
    ("nemotron", {"text": "h", "bbox": [1, 2, 3], "left": 2}, {"bx1": None}), ("ocr_base", {"text": "h", "bbox": [0, 0, 1, 1]}, {"bx1": None}), ("nemotron", {"text": "h", "bbox": ["a", 0, 1, 1]}, {"bx1": None}),
    ("fused", "plain words", {"text": "plain words", "semantic_type": "unknown"}), ("fused", {"text": 12}, {"text": "12"}),
]


def test_fields_of_sources(spark):
    raw = [(i, s, p if isinstance(p, str) else json.dumps(p), 100.0, 0.0, 110.0, 20.0) for i, (s, p, _) in enumerate(FIELDS)]
    blank = [(90, "fused", "[1]", 0.0, 0.0, 1.0, 1.0), (91, "fused", '{"text": " \\u3000"}', 0.0, 0.0, 1.0, 1.0), (92, "fused", None, 0.0, 0.0, 1.0, 1.0), (93, "ocr_base", "{}", 0.0, 0.0, 1.0, 1.0)]
    found = {r.region_id: r for r in evidence.evidence_fields(spark.createDataFrame(raw + blank, "region_id int, source string, payload string, x1 double, y1 double, x2 double, y2 double")).collect()}
    assert sorted(found) == list(range(len(FIELDS)))
    for i, (source, payload, values) in enumerate(FIELDS):
        assert {k: found[i][k] for k in values} == values, (source, payload)


def test_fallback_texts_by_kind_and_order(spark):
    balloons = spark.createDataFrame([("b1", "speech"), ("b2", "thought"), ("b3", "odd"), ("b4", "narration"), ("b5" * 20, None)], "balloon_id string, kind string")
    members = spark.createDataFrame([("b1", "r1", 1), ("b1", "r2", 0), ("b2", "r3", 0), ("b3", "r1", 0), ("b3", "gone", 1), ("b5" * 20, "gone", 0)], "balloon_id string, region_id string, member_pos int")
    texts = spark.createDataFrame([("r1", 0, 0, " one ", None), ("r1", 0, 1, "uno", 0.0), ("r2", 1, 0, "two", 0.5), ("r2", 1, 1, "dos", 0.9), ("r3", 2, 0, "　", 0.9), ("r3", 2, 1, "x", 0.1)], "region_id string, region_pos int, position int, text string, ocr_confidence double")
    by = {order: {r.balloon_id[:4]: (r.final_text, r.text_type, r.include_in_story) for r in evidence.fallback_adjudications(balloons, members, texts, order).collect()} for order in ("bank", "member")}
    assert by["bank"]["b1"] == ("one dos", "dialogue", True) and by["member"]["b1"] == ("dos one", "dialogue", True)
    assert by["bank"]["b2"] == ("[balloon b2 -- adjudication unavailable]", "thought", True) and by["bank"]["b3"] == ("one", "dialogue", True)
    assert by["bank"]["b4"] == ("", "unknown", False) and by["bank"]["b5b5"] == (f"[balloon {'b5' * 12} -- adjudication unavailable]", "dialogue", True)


def test_fallback_texts_are_those_of_the_sql(spark, tmp_path):
    """Documents that are empty or null, with no length and with no id."""
    import duckdb

    from pagescript.plans.records import ORACLES, QUERIES

    docs = [(0, "e" * 250 + "ß", 251), (1, "", 0), (2, None, None), (3, "two words " * 9, None), (4, " ", 1), (None, "no id", 5)]
    spark.createDataFrame(docs, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = QUERIES["c6_fallback_adjudication"](spark, str(tmp_path))
    expected = con.execute(ORACLES["c6_fallback_adjudication"]).fetchall()
    assert sorted(map(tuple, found.select("balloon_id", "final_text").collect()), key=str) == sorted(expected, key=str)
    assert {(250000, ""), (500000, None), (None, "no id")} <= set(expected)


def test_rules_of_records(spark):
    page = "sequence_id string, page_index int"
    tables = {
        "sequences": spark.createDataFrame([("a", "test", ["1", "2", "3"]), ("a", "other", ["1"]), (" ", "test", None)], "sequence_id string, split string, images array<string>"),
        "regions": spark.createDataFrame([("a", 0, "r1", 0.0, 0.0, 1.0, 1.0, 0.5, "sign"), ("a", 0, "r1", 0.0, 0.0, 1.0, 1.0, None, "sign"), ("a", 1, "r1", 1.0, 0.0, 1.0, None, 1.5, "x"), ("a", 1, "", 0.0, 0.0, 1.0, 1.0, float("nan"), None)], f"{page}, region_id string, x1 double, y1 double, x2 double, y2 double, confidence double, category string"),
        "members": spark.createDataFrame([("a", 0, "b1", "r1"), ("a", 0, "b1", "r1"), ("a", 0, "b2", "r9")], f"{page}, balloon_id string, region_id string"),
        "balloons": spark.createDataFrame([("a", 0, "b1", None, "geometry", "speech")], f"{page}, balloon_id string, confidence double, grouping_method string, kind string"),
        "candidates": spark.createDataFrame([("a", 0, "r1", "c", "t", 0.5, None, "fused", "unknown"), ("a", 0, "r1", "c", " ", -1.0, 2.0, "odd", "other"), ("a", 5, "r1", "d", "t", None, None, "ocr_base", "sign")], f"{page}, region_id string, candidate_id string, text string, ocr_confidence double, visual_confidence double, source string, semantic_type string"),
        "adjudications": spark.createDataFrame([("a", 0, "b1", "sign", True, "　"), ("a", 0, "b1", "sign", None, ""), ("a", 0, "b2", None, True, "x")], f"{page}, balloon_id string, text_type string, include_in_story boolean, final_text string"),
        "adjudication_inputs": spark.createDataFrame([("a", 0, "b1", "c", "r1"), ("a", 0, "b1", "c", "r2")], f"{page}, balloon_id string, candidate_id string, region_id string"),
        "unheard_of": spark.range(3),
    }
    found = {}
    for r in rules.check_schema_rules(tables).collect():
        found.setdefault(r.record, []).append((r.rule, json.loads(r.key).get("region_id", json.loads(r.key).get("balloon_id", json.loads(r.key).get("sequence_id"))), r.n))
    assert {k: sorted(v) for k, v in found.items()} == {
        "sequences": [("filled_sequence_id", " ", 1), ("kind_split", "a", 1), ("three_images", " ", 1), ("three_images", "a", 1), ("unique_sequence", "a", 2)],
        "regions": [("filled_region_id", "", 1), ("kind_category", "", 1), ("kind_category", "r1", 1), ("range_confidence", "", 1), ("range_confidence", "r1", 1), ("sound_box", "r1", 1), ("unique_region", "r1", 2)],
        "members": [("balloon_of_member", "r9", 1), ("region_of_member", "r9", 1), ("unique_member", "r1", 2)],
        "candidates": [("filled_text", "r1", 1), ("kind_semantic_type", "r1", 1), ("kind_source", "r1", 1), ("range_ocr_confidence", "r1", 1), ("range_visual_confidence", "r1", 1), ("region_of_candidate", "r1", 1), ("unique_candidate", "r1", 2)],
        "adjudications": [("kind_text_type", "b2", 1), ("text_of_story", "b1", 1)],
        "adjudication_inputs": [("region_of_balloon", "b1", 1), ("unique_input", "b1", 2)],
    }
    with pytest.raises(ValueError):
        rules.check_schema_rules({"unheard_of": spark.range(1)})
    assert rules.violations("regions", rules.records()["regions"], tables["regions"].limit(0)).count() == 0


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_word_rates(spark):
    rng = random.Random(7)
    pairs = [(" ".join(rng.choice("abcd") for _ in range(rng.randrange(9))), " ".join(rng.choice("abcd") for _ in range(rng.randrange(9)))) for _ in range(200)] + [("", ""), ("", "a"), ("a", ""), ("a  b", "a b"), (None, "a"), ("a", None)]
    table = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    for r in table.select("a", "b", T.word_error_rate(F.col("a"), F.col("b")).alias("w")).collect():
        expected = None if r.a is None or r.b is None else (0.0 if r.b == "" else 1.0) if r.a == "" else plain_edits(r.a.split(" "), r.b.split(" ")) / len(r.a.split(" "))
        assert r.w == (None if expected is None else pytest.approx(expected)), (r.a, r.b)


def test_word_rates_of_sixty_thousand_different_words(spark):
    words = [f"w{i}" for i in range(60_000)]
    other = words[:30_000] + ["new"] + words[30_000:59_990] + ["x", "y"]
    table = spark.createDataFrame([(" ".join(words), " ".join(other))], "a string, b string")
    assert table.select(T.word_error_rate(F.col("a"), F.col("b"))).first()[0] == pytest.approx((1 + 10) / 60_000)


def plain_alignment(gold, predicted):
    w = {(a, b): score.token_weight(a, b) for a in set(gold) for b in set(predicted)}
    sums = [[0.0] * (len(predicted) + 1) for _ in range(len(gold) + 1)]
    for i in range(1, len(gold) + 1):
        for j in range(1, len(predicted) + 1):
            sums[i][j] = max(sums[i - 1][j], sums[i][j - 1], sums[i - 1][j - 1] + w[gold[i - 1], predicted[j - 1]])
    i, j, out = len(gold), len(predicted), []
    while i and j:
        if sums[i][j] == sums[i - 1][j]:
            i -= 1
        elif sums[i][j] == sums[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j, w[gold[i], predicted[j]]))
    return out[::-1]


def test_alignments_equal_the_whole_table():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 8))) for _ in range(60)] + ["long" * 20, "long" * 20 + "x"]
    for _ in range(80):
        gold, predicted = ([rng.choice(words) for _ in range(rng.randrange(40))] for _ in range(2))
        expected = plain_alignment(gold, predicted)
        for block in (1, 3, None):
            assert score.align(gold, predicted, block) == expected


def test_long_pages_are_aligned_in_little_room():
    """12,000 tokens a side: a table of two bits a cell alone would take 36 MB, one of sums 1.1 GB."""
    rng = random.Random(2)
    gold = [f"w{rng.randrange(900)}" for _ in range(12_000)]
    predicted = [w if rng.random() < 0.9 else "x" for w in gold]
    tracemalloc.start()
    found = score.align(gold, predicted)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6 and len(found) >= sum(a == b for a, b in zip(gold, predicted, strict=True))


def test_similarity_moves_each_text_once(spark):
    """Two exchanges at most, both of single texts; the pairs themselves are not shuffled."""
    from difflib import SequenceMatcher

    rng = random.Random(5)
    rows = [(g, f"{g}-{i}", "".join(rng.choice("ab Cc\n") for _ in range(rng.choice((0, 5, 40, 250))))) for g in range(12) for i in range(4)]
    rows += [(1, "1-again", rows[4][2]), (1, "1-null", None)]
    found = evidence.candidate_similarity(spark.createDataFrame(rows, "g long, candidate_id string, text string"), "g")
    form = lambda t: " ".join((t or "").lower().split())
    expected = {(g, i, j): SequenceMatcher(None, form(a), form(b)).ratio() for g, i, a in rows for h, j, b in rows if g == h and i != j}
    assert {(r.g, r.a_id, r.b_id): r.ratio for r in found.collect()} == expected
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 0
    assert found._jdf.queryExecution().sparkPlan().toString().count("Join") == 1


def test_candidates_that_are_dealt_out_are_compared_in_place(spark):
    from pagescript.plans.records import QUERIES

    rows = [(1, 7, "x", "one"), (1, 7, "y", None), (1, 7, "y", "one two"), (1, 7, None, "one"), (1, 8, "x", "one"), (2, None, "x", "a"), (2, None, "y", "b"), (3, 9, "x", "ab"), (3, 9, "z", "ba")]
    table = spark.createDataFrame(rows, "doc_id long, g long, candidate_id string, text string")
    found = evidence.candidate_similarity(table.repartition(4, "doc_id"), "g", "doc_id")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, evidence.candidate_similarity(table, "g").collect()))
    assert found.where("g = 7").count() == 4 and found.columns == ["g", "a_id", "b_id", "ratio"]
    plan = QUERIES["c5_candidate_similarity"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(dealt) == 1 and "doc_id" in dealt[0] and plan.count("ArrowEvalPython") == 1


def test_short_texts_are_compared_in_bulk():
    """One at a time, 12,000 pairs in both orders take some 10 s."""
    from difflib import SequenceMatcher

    import pyarrow as pa

    def ratios(pairs):
        return [(r["ratio"], r["turned"]) for r in list(T._match_ratios(iter([tuple(pa.array(side, pa.string()) for side in zip(*pairs, strict=True))])))[0].to_pylist()]

    rng = random.Random(4)
    pairs = [(None, "a"), ("", None), ("a\u3000 b", "A b"), ("ß" * 64, "SS" * 32), ("İ" * 40, "i" * 64), ("😀" * 64, "😀" * 63 + "x"), ("\0" * 64, "\0a" * 32), ("ab" * 33, "ba" * 32)]
    for _ in range(1500):
        letters = rng.choice(("ab", "abc dE\n", "abcdefgh éü😀 "))
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(rng.choice((8, 65, 70, 230)))))
        b = "".join(rng.choice(letters) if rng.random() < 0.2 else ch for ch in a) if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(rng.randrange(70)))
        pairs += [(a, b), (b, a), (a, a)]
    form = lambda t: " ".join((t or "").lower().split())
    ratio = lambda a, b: SequenceMatcher(None, form(a), form(b)).ratio()
    assert ratios(pairs) == [(ratio(a, b), ratio(b, a)) for a, b in pairs]
    lines = ["".join(rng.choice("aeiou ln") for _ in range(60)) for _ in range(12_000)]
    began = time.process_time()
    ratios([(t, t.replace("e", "c")) for t in lines])
    assert time.process_time() - began < 4


def test_edits_of_texts_of_any_length():
    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(3)
    for letters, longest in (("ab", 9), ("abé語", 70), ("abcdefgh 😀", 300)):
        for _ in range(120 if longest < 100 else 12):
            a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(longest))) for _ in range(2))
            assert T.edits(a, b) == table(a, b)
    long = "".join(rng.choice("abcdefgh the ") for _ in range(60_000))
    began = time.process_time()
    assert T.edits(long, long.replace("the", "te")) == long.count("the")
    assert time.process_time() - began < 30


def test_bank_deals_candidates_out_once(spark):
    """One exchange of candidates, one of regions."""
    rows = [("r1", "a", "x", 0.5, 1), ("r1", "a", "x", 0.5, 0), ("r1", None, "y", 0.5, 2), ("r1", None, "z", 0.5, 3), ("r2", "a", "x", 0.5, 0), ("r2", "a", "w", 0.5, 1), ("r3", "a", "x", 0.5, 0), ("r3", "a", "v", 0.5, 0), ("r4", "b", "u", 0.1, 0)]
    regions = spark.createDataFrame([("r1", 0), ("r2", 1), ("r4", 2), ("r4", 2)], "region_id string, region_pos int")
    bank, errors = evidence.checked_bank(regions, spark.createDataFrame(rows, CANDIDATE), ["region_id"])
    assert [(r.region_id, [(c.candidate_id, c.text, c.position) for c in r.candidates]) for r in bank.collect()] == [("r1", [("a", "x", 0), (None, "y", 2), (None, "z", 3)])]
    assert sorted((r.region_id, r.candidate_id, r.error) for r in errors.where("candidate_id IS NOT NULL").collect()) == [("r2", "a", "conflicting_candidate"), ("r3", "a", "conflicting_candidate"), ("r3", "a", "unknown_region")]
    assert sorted((r.region_id, r.error) for r in errors.where("candidate_id IS NULL").collect()) == [("r1", "conflicting_candidate"), ("r4", "repeated_region")]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = evidence.checked_bank(regions, spark.createDataFrame(rows, CANDIDATE), ["region_id"])[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2

"""Queries of evidence, identity, reconciliation, scoring, policies, telemetry and sources, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import hold, load, with_views
from ..functions import text as T
from ..functions.tables import rounded
from ..operators import evidence, identity, models, policy, resolve, rules, score, stumps, telemetry
from ..sources import transcripts

K = ["sequence_id", "page_index"]
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


def r6(*names: str) -> list:
    return [rounded(n).alias(n) for n in names]


_SOURCE = "CASE source WHEN 'ocr_base' THEN 1 WHEN 'nemotron' THEN 2 ELSE 3 END"


def _candidates(spark, sf_dir, **how):
    (rows,) = load(spark, sf_dir, "fx_candidates", **how)
    return rows.withColumn("position", F.when(F.col("source") == "ocr_base", 1).when(F.col("source") == "nemotron", 2).otherwise(3))


# ---- evidence


@query(
    """SELECT region_id, source, trim(CASE WHEN region_id % 3 = 0 THEN text ELSE text END) AS text FROM fx_candidates WHERE trim(text) <> ''""",
    "fx_candidates",
)
def c1_normalize_candidates(spark, sf_dir):
    rows = _candidates(spark, sf_dir)
    key = F.when(F.col("source") == "ocr_base", F.to_json(F.struct(F.col("text").alias("rec_text")))).when(F.col("source") == "nemotron", F.to_json(F.struct(F.struct("text").alias("res"))))
    raw = rows.select("region_id", "source", F.coalesce(key, F.to_json(F.struct(F.col("text").alias("content")))).alias("payload"))
    return evidence.normalize_candidates(raw, {"ocr_base": ["rec_text", "text", "transcription"], "nemotron": ["text", "transcription"], "qwen3_vl": ["text", "content"]}).select("region_id", "source", "text")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 1, 2) THEN NULL WHEN doc_id % 5 = 3 THEN base_score WHEN base_score * 2 <= 1 THEN base_score * 2 END AS confidence FROM fx_verifier""",
    "fx_verifier",
)
def c2_clean_confidence(spark, sf_dir):
    (rows,) = load(spark, sf_dir, "fx_verifier")
    case = F.col("doc_id") % 5
    raw = F.when(case == 0, "true").when(case == 1, "not-a-number").when(case == 2, "NaN").when(case == 3, F.col("base_score").cast("string")).otherwise((F.col("base_score") * 2).cast("string"))
    return rows.select("doc_id", evidence.clean_confidence(raw).alias("confidence"))


@query(
    """SELECT sequence_id, page_index, balloon_pos, CASE k WHEN 0 THEN 'vocalisation' WHEN 1 THEN 'unknown' WHEN 2 THEN text_type ELSE text_type END AS kind FROM (SELECT *, balloon_pos % 4 AS k FROM fx_adjudications)""",
    "fx_adjudications",
)
def c3_semantic_type(spark, sf_dir):
    (rows,) = load(spark, sf_dir, "fx_adjudications")
    case = F.col("balloon_pos") % 4
    raw = F.when(case == 0, " Vocalization ").when(case == 1, "other").when(case == 2, F.replace(F.upper("text_type"), F.lit("_"), F.lit(" "))).otherwise(F.col("text_type"))
    return rows.select(*K, "balloon_pos", evidence.semantic_type(raw).alias("kind"))


@query(f"SELECT region_id, list(source || ':' || text ORDER BY {_SOURCE}) AS candidates FROM fx_candidates GROUP BY region_id", "fx_candidates")
def c4_candidate_bank(spark, sf_dir):
    bank = evidence.candidate_bank(_candidates(spark, sf_dir), ["region_id"])
    return bank.select("region_id", F.transform("candidates", lambda c: F.concat_ws(":", c["source"], c["text"])).alias("candidates"))


_BANK = """t AS (SELECT region_id, region_id AS region_pos FROM fx_lines WHERE region_id % 7 <> 3 UNION ALL SELECT region_id, region_id FROM fx_lines WHERE region_id % 11 = 5),
    d AS (SELECT region_id, source AS candidate_id, text FROM fx_candidates UNION SELECT region_id, source, text || '!' FROM fx_candidates WHERE region_id % 13 = 2 AND source = 'nemotron'),
    o AS (SELECT region_id, count(*) AS times FROM t GROUP BY region_id), f AS (SELECT DISTINCT region_id, candidate_id FROM d WHERE region_id % 13 = 2 AND candidate_id = 'nemotron')"""


def _bank(spark, sf_dir):
    """Every candidate twice; some regions are unknown, some come twice, some candidates contradict themselves."""
    lines, rows = load(spark, sf_dir, "fx_lines", "fx_candidates")
    i = F.col("region_id")
    regions = lines.where(i % 7 != 3).unionByName(lines.where(i % 11 == 5)).select("region_id", i.alias("region_pos"))
    first = rows.select("region_id", F.col("source").alias("candidate_id"), "text", F.lit(0).alias("position"))
    other = first.where((i % 13 == 2) & (F.col("candidate_id") == "nemotron")).select("region_id", "candidate_id", F.concat("text", F.lit("!")).alias("text"), F.lit(2).alias("position"))
    return evidence.checked_bank(regions, first.unionByName(first.withColumn("position", F.lit(1))).unionByName(other), ["region_id"])


@query(
    f"""WITH {_BANK} SELECT region_id, CAST(NULL AS VARCHAR) AS candidate_id, 'repeated_region' AS error FROM o WHERE times > 1 UNION ALL SELECT DISTINCT region_id, candidate_id, 'unknown_region' FROM d WHERE region_id NOT IN (SELECT region_id FROM o)
    UNION ALL SELECT region_id, candidate_id, 'conflicting_candidate' FROM f""",
    "fx_lines", "fx_candidates",
)
def c4_bank_errors(spark, sf_dir):
    return _bank(spark, sf_dir)[1]


@query(f"WITH {_BANK} SELECT region_id, list(candidate_id ORDER BY candidate_id) AS candidates FROM d JOIN o USING (region_id) WHERE times = 1 AND (region_id, candidate_id) NOT IN (SELECT (region_id, candidate_id) FROM f) GROUP BY region_id", "fx_lines", "fx_candidates")
def c4_checked_bank(spark, sf_dir):
    return _bank(spark, sf_dir)[0].select("region_id", F.array_sort(F.transform("candidates", lambda c: c["candidate_id"])).alias("candidates"))


@query(
    """SELECT doc_id AS region_id, trim(text) AS text, CASE WHEN k = 0 THEN s WHEN k = 1 THEN NULL WHEN k = 2 THEN s / 2 WHEN k = 3 THEN s END AS ocr_confidence, CASE WHEN k = 3 THEN 1 - s END AS visual_confidence, CASE WHEN k = 3 THEN doc_id % 2 = 0 END AS candidate_supported,
    CASE k WHEN 0 THEN 'vocalisation' WHEN 3 THEN 'sound_effect' ELSE 'unknown' END AS semantic_type, CASE WHEN k = 2 THEN 100 + 0.25e0 * 50 END AS bx1, CASE WHEN k = 2 THEN 100 + 0.75e0 * 50 END AS bx2
    FROM (SELECT *, doc_id % 5 AS k, (doc_id % 100) / 100.0e0 AS s FROM documents WHERE regexp_matches(text, '[^\\s\\p{Z}]'))""",
)
def c2_evidence_fields(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    k, share, even = F.col("doc_id") % 5, F.col("doc_id") % 100 / 100.0, F.col("doc_id") % 2 == 0
    payload = (
        F.when(k == 0, F.to_json(F.struct(F.struct(F.lit("unread").alias("transcription"), F.col("text").alias("rec_text"), share.alias("rec_score"), F.lit("Vocalization").alias("text_type")).alias("res"))))
        .when(k == 1, F.to_json(F.struct(F.col("text").alias("text"), F.lit(True).alias("rec_score"), share.alias("score"))))
        .when(k == 2, F.to_json(F.struct(F.col("text").alias("text"), (share / 2).cast("string").alias("confidence"), F.array(F.lit(0.75), F.lit(0.0), F.lit(0.25), F.lit(1.0)).alias("bbox"))))
        .when(k == 3, F.to_json(F.struct(F.col("text").alias("transcription"), F.lit("other").alias("text"), share.alias("ocr_confidence"), (1 - share).alias("visual_confidence"), even.alias("candidate_supported"), F.lit("sound effect").alias("semantic_type"))))
        .otherwise(F.to_json(F.struct(F.col("text").alias("text"), F.lit(2.5).alias("ocr_confidence"), F.lit("yes").alias("candidate_supported"))))
    )
    source = F.when(k == 0, "ocr_base").when(k == 1, "ocr_upscale").when(k == 2, "nemotron").when(k == 3, "qwen3_vl").otherwise("fused")
    raw = docs.select(F.col("doc_id").alias("region_id"), source.alias("source"), payload.alias("payload"), *[F.lit(v).alias(c) for c, v in (("x1", 100.0), ("y1", 0.0), ("x2", 150.0), ("y2", 20.0))])
    return evidence.evidence_fields(raw).select("region_id", F.trim("text").alias("text"), "ocr_confidence", "visual_confidence", "candidate_supported", "semantic_type", "bx1", "bx2")


@query()
def c5_candidate_similarity(spark, sf_dir):
    rows = _candidates(spark, sf_dir, by_document=True).withColumn("candidate_id", F.concat_ws("-", "region_id", "source"))
    return evidence.candidate_similarity(rows, "region_id", "doc_id").withColumn("ratio", F.round("ratio", 6))


@query(
    f"""SELECT balloon_id, string_agg(text, ' ' ORDER BY region_id) AS final_text FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY coalesce(ocr_confidence, 0) DESC, {_SOURCE}) AS n FROM fx_candidates) WHERE n = 1 GROUP BY balloon_id""",
    "fx_candidates",
)
def c6_fallback_adjudication(spark, sf_dir):
    return evidence.fallback_adjudication(_candidates(spark, sf_dir))


_C6 = f"""SELECT b.balloon_id, CASE WHEN b.balloon_id % 10 = 9 THEN '' ELSE coalesce(said, '[balloon ' || substr(CAST(b.balloon_id AS VARCHAR), 1, 24) || ' -- adjudication unavailable]') END AS final_text,
    CASE WHEN b.balloon_id % 10 = 9 THEN 'unknown' ELSE CASE b.balloon_id % 5 WHEN 1 THEN 'thought' WHEN 2 THEN 'narration' ELSE 'dialogue' END END AS text_type, b.balloon_id % 10 <> 9 AS include_in_story FROM (SELECT DISTINCT balloon_id FROM fx_candidates) b
    LEFT JOIN (SELECT balloon_id, string_agg(t, ' ' ORDER BY region_id DESC) AS said FROM (SELECT balloon_id, region_id, trim(regexp_replace(CASE WHEN region_id % 6 = 1 OR balloon_id % 7 = 3 THEN ' ' ELSE text END, '^\\s+|\\s+$', '', 'g')) AS t, row_number() OVER (PARTITION BY region_id ORDER BY coalesce(ocr_confidence, 0) DESC, {_SOURCE}) AS n FROM fx_candidates)
      WHERE n = 1 AND t <> '' GROUP BY balloon_id) f USING (balloon_id)"""


@query(_C6, "fx_candidates")
def c6_member_order(spark, sf_dir):
    """Members from the last region to the first; some texts are blank, some balloons have no members."""
    rows = _candidates(spark, sf_dir)
    i = F.col("balloon_id")
    balloons = rows.select("balloon_id").distinct().withColumn("kind", F.when(i % 5 == 0, "speech").when(i % 5 == 1, "thought").when(i % 5 == 2, "narration").when(i % 5 == 3, "unknown"))
    members = rows.where(i % 10 != 9).select("balloon_id", "region_id").distinct().withColumn("member_pos", -F.col("region_id"))
    texts = rows.select("region_id", F.col("region_id").alias("region_pos"), "position", F.when((F.col("region_id") % 6 == 1) | (i % 7 == 3), " ").otherwise(F.col("text")).alias("text"), "ocr_confidence")
    return evidence.fallback_adjudications(balloons, members, texts, "member")


_LISTED = "('dialogue', 'narration', 'thought', 'sound_effect', 'sign', 'title', 'metadata', 'document_text', 'vocalisation', 'unknown')"
_C7 = f"""p AS (SELECT balloon_id, failure, CASE WHEN payload LIKE '```%' THEN regexp_replace(regexp_replace(payload, '^```(json)?\\s*', ''), '\\s*```$', '') ELSE payload END AS payload FROM fx_answers),
    v AS (SELECT balloon_id, failure, json_valid(payload) AS valid, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS j FROM p),
    t AS (SELECT *, json_type(j) AS whole, json_type(j, '$.final_text') AS tt, json_type(j, '$.include_in_story') AS st, json_type(j, '$.text_type') AS yt, json_type(j, '$.corrections') AS ct, json_type(j, '$.notes') AS nt,
      json_extract_string(j, '$.final_text') AS final_text, json_extract_string(j, '$.text_type') AS y, coalesce(json_extract_string(j, '$.include_in_story') = 'true' AND json_type(j, '$.include_in_story') = 'BOOLEAN', false) AS inc,
      CASE WHEN json_type(j, '$.confidence') IS NOT NULL THEN j->'$.confidence' ELSE j->'$.decision_confidence' END AS c FROM v),
    u AS (SELECT *, coalesce(json_type(c), 'NULL') AS ck, CASE WHEN json_type(c) IN ('DOUBLE', 'BIGINT', 'UBIGINT') AND CAST(c AS DOUBLE) BETWEEN 0 AND 1 THEN CAST(c AS DOUBLE) END AS confidence,
      CASE WHEN failure IS NOT NULL THEN 'backend_failure' WHEN NOT coalesce(valid, false) THEN 'malformed_json' WHEN whole <> 'OBJECT' THEN 'invalid_response_type' WHEN json_type(j, '$._json_parse_error') IS NOT NULL THEN 'malformed_json'
        WHEN tt <> 'VARCHAR' THEN 'invalid_final_text' WHEN inc AND trim(regexp_replace(coalesce(final_text, ''), '\\s', '', 'g')) = '' THEN 'invalid_adjudication_result' END AS useless FROM t),
    i AS (SELECT balloon_id, CAST(unnest(range(CAST(json_array_length(j, '$.corrections') AS BIGINT))) AS INTEGER) AS position, j FROM u WHERE useless IS NULL AND ct = 'ARRAY'),
    k AS (SELECT balloon_id, position, j->('$.corrections[' || position || ']') AS item FROM i),
    x AS (SELECT k.balloon_id, position, a.candidate_id, item, CASE WHEN coalesce(json_type(item, '$.candidate_id'), '') <> 'VARCHAR' OR coalesce(json_type(item, '$.from_text'), '') <> 'VARCHAR' OR coalesce(json_type(item, '$.to_text'), '') <> 'VARCHAR' THEN 'invalid_correction'
      WHEN a.candidate_id IS NULL THEN 'unknown_correction_candidate' END AS code FROM k LEFT JOIN fx_answer_candidates a ON a.balloon_id = k.balloon_id AND a.candidate_id = json_extract_string(item, '$.candidate_id'))"""


@query(
    f"""WITH {_C7}, n AS (SELECT balloon_id, string_agg(candidate_id, ',' ORDER BY position) AS corrections FROM x WHERE code IS NULL GROUP BY balloon_id)
    SELECT balloon_id, CASE WHEN useless IS NULL THEN coalesce(final_text, '') ELSE '' END AS final_text, CASE WHEN useless IS NULL AND yt = 'VARCHAR' AND y IN {_LISTED} THEN y ELSE 'unknown' END AS text_type, useless IS NULL AND inc AS include_in_story,
      CASE WHEN useless IS NULL THEN confidence END AS confidence, coalesce(corrections, '') AS corrections, CASE WHEN useless IS NULL AND nt <> 'NULL' THEN json_extract_string(j, '$.notes') END AS notes FROM u LEFT JOIN n USING (balloon_id)""",
    "fx_answers", "fx_answer_candidates",
)
def c7_validate_adjudications(spark, sf_dir):
    decisions, _ = evidence.validate_adjudications(*load(spark, sf_dir, "fx_answers", "fx_answer_candidates"))
    return decisions.withColumn("corrections", F.array_join(F.transform("corrections", lambda c: c["candidate_id"]), ","))


@query(
    f"""WITH {_C7} SELECT balloon_id, CAST(NULL AS INTEGER) AS position, unnest(list_filter([useless, CASE WHEN ck <> 'NULL' AND confidence IS NULL AND useless IS NULL THEN 'invalid_confidence' END, CASE WHEN st <> 'BOOLEAN' AND useless IS NULL THEN 'invalid_story_decision' END,
      CASE WHEN st IS NULL AND useless IS NULL THEN 'missing_story_decision' END, CASE WHEN useless IS NULL AND yt IS NOT NULL AND NOT coalesce(yt = 'VARCHAR' AND y IN {_LISTED}, false) THEN 'invalid_text_type' END,
      CASE WHEN ct <> 'ARRAY' AND useless IS NULL THEN 'invalid_corrections' END, CASE WHEN nt NOT IN ('VARCHAR', 'NULL') AND useless IS NULL THEN 'coerced_notes' END], lambda d: d IS NOT NULL)) AS code FROM u
    UNION ALL SELECT balloon_id, position, code FROM x WHERE code IS NOT NULL""",
    "fx_answers", "fx_answer_candidates",
)
def c7_adjudication_defects(spark, sf_dir):
    return evidence.validate_adjudications(*load(spark, sf_dir, "fx_answers", "fx_answer_candidates"))[1]


@query(
    """SELECT sequence_id, page_index, coalesce(string_agg(text, ' ' ORDER BY cy, cx, region_pos) FILTER (text <> ''), '') AS text, round(coalesce(avg(confidence) FILTER (text <> ''), 0), 6) AS score
    FROM (SELECT *, (y1 + y2) / 2 AS cy, (x1 + x2) / 2 AS cx, CASE WHEN k = 2 THEN '' ELSE 'L' || k END AS text FROM fx_regions) GROUP BY ALL""",
    "fx_regions",
)
def c8_reassemble_lines(spark, sf_dir):
    (rows,) = load(spark, sf_dir, "fx_regions")
    lines = rows.select(*K, ((F.col("y1") + F.col("y2")) / 2).alias("cy"), ((F.col("x1") + F.col("x2")) / 2).alias("cx"), F.col("region_pos").alias("line_pos"), F.when(F.col("k") == 2, " ").otherwise(F.concat(F.lit("L"), F.col("k").cast("string"))).alias("text"), F.col("confidence").alias("score"))
    return evidence.reassemble_lines(lines, K).select(*K, "text", *r6("score"))


@query(
    "SELECT a.source AS source_a, b.source AS source_b, count(*) AS pairs, round(avg(CASE WHEN lower(a.text) = lower(b.text) THEN 1.0e0 ELSE 0 END), 6) AS agreement FROM fx_candidates a JOIN fx_candidates b ON a.region_id = b.region_id AND a.source < b.source GROUP BY ALL",
    "fx_candidates",
)
def c9_source_agreement(spark, sf_dir):
    return evidence.source_agreement(_candidates(spark, sf_dir)).select("source_a", "source_b", "pairs", *r6("agreement"))


@query("SELECT balloon_id, min(region_id) AS region_id FROM fx_candidates GROUP BY balloon_id", "fx_candidates")
def c10_first_region(spark, sf_dir):
    members = _candidates(spark, sf_dir).select("balloon_id", "region_id", F.col("region_id").alias("member_pos"))
    return evidence.first_region(members)


@query(
    f"SELECT balloon_id, region_id, source, row_number() OVER (PARTITION BY balloon_id ORDER BY region_id, {_SOURCE}) AS input_pos FROM fx_candidates WHERE region_id % 7 <> 3",
    "fx_candidates",
)
def j13_adjudication_input(spark, sf_dir):
    rows = _candidates(spark, sf_dir)
    members = rows.select("balloon_id", "region_id", F.col("region_id").alias("member_pos")).distinct()
    return evidence.adjudication_input(members, rows.where("region_id % 7 <> 3"))[0].select("balloon_id", "region_id", "source", "input_pos")


@query("SELECT DISTINCT balloon_id, region_id FROM fx_candidates WHERE region_id % 7 = 3", "fx_candidates")
def j13_dangling_regions(spark, sf_dir):
    rows = _candidates(spark, sf_dir)
    members = rows.select("balloon_id", "region_id", F.col("region_id").alias("member_pos")).distinct()
    return evidence.adjudication_input(members, rows.where("region_id % 7 <> 3"))[1].select("balloon_id", "region_id")


@query(
    """WITH o AS (SELECT sequence_id, page_index, region_pos AS balloon_pos, k FROM fx_regions)
    SELECT sequence_id, page_index, balloon_pos, 'adjudication' AS missing FROM o WHERE NOT EXISTS (SELECT 1 FROM fx_adjudications a WHERE a.sequence_id = o.sequence_id AND a.page_index = o.page_index AND a.balloon_pos = o.balloon_pos)
    UNION ALL SELECT sequence_id, page_index, balloon_pos, 'character' FROM o WHERE k > 5 UNION ALL SELECT DISTINCT sequence_id, CAST(NULL AS INT), CAST(NULL AS INT), 'sequence' FROM o WHERE sequence_id % 50 = 3""",
    "fx_regions", "fx_adjudications",
)
def j14_missing_rows(spark, sf_dir):
    regions, adjudications = load(spark, sf_dir, "fx_regions", "fx_adjudications")
    order = regions.withColumnsRenamed({"region_pos": "balloon_pos", "k": "character_id"})
    return resolve.missing_rows(order, adjudications, order, order.where("character_id <= 5"), order.select("sequence_id").distinct().where("sequence_id % 50 <> 3"))


# ---- identity

_COS = "CASE WHEN na * nb > 0 THEN greatest(-1.0e0, least(1.0e0, dot / (na * nb))) ELSE 0 END"
_I1 = f"""SELECT sequence_id, a_id, b_id, a_page, b_page, ({_COS} + 1) / 2 AS "full" FROM (SELECT a.sequence_id, a.character_id AS a_id, b.character_id AS b_id, a.page_index AS a_page, b.page_index AS b_page,
    list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) AS dot, sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS na, sqrt(list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS nb
    FROM fx_vectors a JOIN fx_vectors b ON a.sequence_id = b.sequence_id AND a.character_id < b.character_id AND a.page_index <> b.page_index)"""


def _pairs(spark, sf_dir):
    (vectors,) = load(spark, sf_dir, "fx_vectors")
    return vectors, identity.identity_pairs(vectors)


def _edges(spark, sf_dir):
    vectors, pairs = _pairs(spark, sf_dir)
    known = pairs.withColumns({"face": F.lit(None).cast("double"), "body": F.when(F.col("a_id") % 2 == 0, F.col("full"))})
    return vectors, identity.combine_similarity(known)


@query(f'SELECT sequence_id, a_id, b_id, round("full", 5) AS "full" FROM ({_I1})', "fx_vectors")
def i1_identity_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)[1].select("sequence_id", "a_id", "b_id", F.round("full", 5).alias("full"))


@query(
    f"""SELECT sequence_id, a_id, b_id, round("full", 5) AS score, CASE WHEN a_id % 2 = 0 THEN 0.75e0 ELSE 0.55e0 END AS confidence, CASE WHEN a_id % 2 = 0 THEN 'combined' ELSE 'full' END AS method FROM ({_I1})""",
    "fx_vectors",
)
def i2_combine_similarity(spark, sf_dir):
    return _edges(spark, sf_dir)[1].select("sequence_id", "a_id", "b_id", F.round("score", 5).alias("score"), "confidence", "method")


@query(f'SELECT sequence_id, a_id, b_id, round("full", 5) AS score FROM ({_I1})', "fx_vectors")
def i3_strongest_edge(spark, sf_dir):
    _, edges = _edges(spark, sf_dir)
    back = edges.select("sequence_id", F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"), (F.col("score") - 0.1).alias("score"), F.lit(1).alias("position"))
    both = edges.select("sequence_id", "a_id", "b_id", "score", F.lit(0).alias("position")).unionByName(back)
    return identity.strongest_edge(both).select("sequence_id", "a_id", "b_id", F.round("score", 5).alias("score"))


@query()
def i4_constrained_clusters(spark, sf_dir):
    vectors, edges = _edges(spark, sf_dir)
    return identity.constrained_clusters(vectors, edges, 0.55)


@query()
def i5_label_clusters(spark, sf_dir):
    vectors, edges = _edges(spark, sf_dir)
    return identity.label_clusters(identity.constrained_clusters(vectors, edges, 0.55), vectors, identity.ambiguous_edges(edges, 0.45, 0.55))


@query(
    """WITH c AS (SELECT sequence_id, character_id, 'identity-' || lpad(CAST(2 * n AS VARCHAR), 3, '0') AS identity, chr(CAST(63 + 2 * n AS INT)) AS label, 2 * n AS k FROM (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY character_id) AS n FROM fx_vectors WHERE character_id % 3 <> 0)),
    m AS (SELECT sequence_id, character_id, row_number() OVER (PARTITION BY sequence_id ORDER BY page_index, -character_id, character_id) AS n FROM fx_vectors WHERE character_id % 3 = 0),
    free AS (SELECT s.sequence_id, chr(CAST(65 + i AS INT)) AS label, row_number() OVER (PARTITION BY s.sequence_id ORDER BY i) AS n FROM (SELECT DISTINCT sequence_id FROM fx_vectors) s, (SELECT unnest(range(0, 26)) AS i) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.sequence_id = s.sequence_id AND c.label = chr(CAST(65 + i AS INT)))),
    l AS (SELECT sequence_id, max(k) AS k FROM c GROUP BY ALL)
    SELECT sequence_id, character_id, identity, label FROM c UNION ALL SELECT m.sequence_id, character_id, 'identity-' || lpad(CAST(coalesce(k, 0) + m.n AS VARCHAR), 3, '0'), f.label FROM m JOIN free f ON m.sequence_id = f.sequence_id AND m.n = f.n LEFT JOIN l ON m.sequence_id = l.sequence_id""",
    "fx_vectors",
)
def i6_fill_singletons(spark, sf_dir):
    """Two thirds of the characters have identities of even numbers and every other letter."""
    from pyspark.sql import Window

    (vectors,) = load(spark, sf_dir, "fx_vectors")
    n = F.row_number().over(Window.partitionBy("sequence_id").orderBy("character_id"))
    known = vectors.where("character_id % 3 <> 0").withColumn("n", n).select("sequence_id", "character_id", F.format_string("identity-%03d", 2 * F.col("n")).alias("identity"), F.char(63 + 2 * F.col("n")).alias("label"))
    return identity.fill_singletons(known, vectors.select("sequence_id", "character_id", "page_index", (-F.col("character_id")).alias("y1")))


@query()
def i4_merge_diagnostics(spark, sf_dir):
    vectors, edges = _edges(spark, sf_dir)
    return identity.merge_diagnostics(identity.constrained_clusters(vectors, edges, 0.55), edges, 0.45, 0.55).withColumn("score", F.round("score", 6))


@query()
def j15_character_graph(spark, sf_dir):
    vectors, edges = _edges(spark, sf_dir)
    return resolve.character_graph(identity.constrained_clusters(vectors, edges, 0.55), edges).withColumn("score", F.round("score", 6))


@query()
def r4_identity_summary(spark, sf_dir):
    vectors, edges = _edges(spark, sf_dir)
    return resolve.identity_summary(identity.constrained_clusters(vectors, edges, 0.55).join(vectors, ["sequence_id", "character_id"]))


# ---- reconciliation

_TOLD = "text_type IN ('narration', 'thought', 'sound_effect', 'sign', 'title', 'metadata', 'document_text', 'vocalisation')"
#: Regions as balloons. Some items name another page than their balloon's, some are in no page, some come twice; of two decisions and adjudications the first counts.
_CAST = """n AS (SELECT sequence_id, page_index, region_pos, k, x1, CAST(page_index * 1000 + region_pos AS BIGINT) AS balloon_id, row_number() OVER (PARTITION BY sequence_id ORDER BY page_index, region_pos) - 1 AS sequence_position FROM fx_regions),
  o AS (SELECT sequence_id, balloon_id, sequence_position, CASE WHEN k = 5 AND sequence_id % 4 = 0 THEN (page_index + 1) % 3 ELSE page_index END AS order_page FROM n UNION ALL SELECT sequence_id, balloon_id, sequence_position + 1000, page_index FROM n WHERE region_pos = 2 AND sequence_id % 5 = 0),
  b AS (SELECT sequence_id, balloon_id, page_index + CASE WHEN sequence_id % 40 = 9 THEN 1 ELSE 0 END AS page_index, CAST(floor(x1 / 600) AS INT) AS panel_pos FROM n WHERE NOT (k = 7 AND sequence_id % 6 = 1)),
  a AS (SELECT sequence_id, CAST(page_index * 1000 + balloon_pos AS BIGINT) AS balloon_id, text_type, include_in_story, CASE WHEN balloon_pos = 4 AND sequence_id % 3 = 0 THEN ' ' ELSE final_text END AS final_text FROM fx_adjudications),
  s AS (SELECT sequence_id, balloon_id, CASE WHEN region_pos % 3 <> 0 THEN k END AS character_id FROM n),
  c AS (SELECT DISTINCT sequence_id, page_index, k AS character_id FROM n WHERE k <= 6),
  i AS (SELECT DISTINCT sequence_id, k AS character_id, CASE WHEN k = 2 AND sequence_id % 9 = 2 THEN 1 ELSE k END AS identity_id, CASE k WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 4 THEN 'B' WHEN 7 THEN 'Hero' END AS label, CASE WHEN k = 4 THEN 'ambiguous' ELSE 'matched' END AS state FROM n WHERE (k <= 4 OR k = 7) AND sequence_id % 8 <> 5)"""
_R1 = f"""WITH {_CAST},
  j AS (SELECT o.sequence_id, o.balloon_id, o.sequence_position, o.order_page, b.page_index, b.panel_pos, b.balloon_id IS NOT NULL AS placed, a.balloon_id IS NOT NULL AS adj, a.text_type, a.include_in_story, a.final_text, coalesce({_TOLD}, false) AS told, s.character_id,
      EXISTS (SELECT 1 FROM c WHERE c.sequence_id = o.sequence_id AND c.character_id = s.character_id) AS person, o.sequence_id IN (SELECT sequence_id FROM i) AS identified, i.identity_id, i.label, i.state
    FROM o LEFT JOIN b USING (sequence_id, balloon_id) LEFT JOIN a USING (sequence_id, balloon_id) LEFT JOIN s USING (sequence_id, balloon_id) LEFT JOIN i ON i.sequence_id = o.sequence_id AND i.character_id = s.character_id),
  r AS (SELECT *, placed AND adj AS usable, placed AND adj AND NOT told AS asked, placed AND adj AND NOT told AND person AND identified AS named FROM j)
  SELECT sequence_id, sequence_position, page_index, panel_pos, balloon_id, text_type, include_in_story, final_text, CASE WHEN usable THEN character_id END AS character_id, CASE WHEN named THEN identity_id END AS identity_id,
    CASE WHEN usable AND told THEN 'NARRATION' WHEN named AND label IN ('A', 'B') THEN 'Character ' || label WHEN named THEN label END AS speaker,
    CASE WHEN asked AND person AND NOT identified THEN 'unmatched' WHEN NOT named THEN NULL WHEN identity_id IS NULL THEN 'unmatched' WHEN label IS NULL THEN 'ambiguous' ELSE state END AS identity_state,
    CASE WHEN NOT usable THEN 'unresolved' WHEN include_in_story THEN 'ordered' ELSE 'excluded' END AS resolution, CASE WHEN NOT placed THEN 'balloon_not_in_any_page' WHEN NOT adj THEN 'missing_adjudication_result' END AS reason,
    list_filter([CASE WHEN NOT adj THEN 'missing_adjudication_result' END, CASE WHEN NOT placed THEN 'balloon_not_in_any_page' END, CASE WHEN usable AND order_page <> page_index THEN 'page_index_mismatch' END,
      CASE WHEN NOT asked THEN NULL WHEN character_id IS NULL THEN 'no_speaker_resolved' WHEN NOT person THEN 'invalid_speaker_character_reference' WHEN NOT identified THEN 'no_identity_result' WHEN identity_id IS NULL THEN 'speaker_identity_unresolved'
        WHEN label IS NULL THEN 'speaker_identity_label_missing' WHEN state = 'ambiguous' THEN 'speaker_identity_ambiguous' END], lambda x: x IS NOT NULL) AS codes FROM r"""


def _cast(spark, sf_dir):
    """(order, balloons, adjudications, speakers, characters, identity)."""
    from pyspark.sql import Window

    # Everything is asked for by sequence, a page included.
    regions, adjudications = load(spark, sf_dir, "fx_regions", "fx_adjudications", by=["sequence_id"], held=False)
    i, k, ball = F.col("sequence_id"), F.col("k"), F.col("page_index") * 1000
    numbered = regions.select(*K, "region_pos", "k", "x1", (ball + F.col("region_pos")).cast("long").alias("balloon_id"), (F.row_number().over(Window.partitionBy("sequence_id").orderBy("page_index", "region_pos")) - 1).alias("sequence_position"))
    hold(numbered)
    twice = numbered.where((F.col("region_pos") == 2) & (i % 5 == 0)).select("sequence_id", "balloon_id", (F.col("sequence_position") + 1000).alias("sequence_position"), "page_index")
    order = numbered.select("sequence_id", "balloon_id", "sequence_position", F.when((k == 5) & (i % 4 == 0), (F.col("page_index") + 1) % 3).otherwise(F.col("page_index")).alias("page_index")).unionByName(twice)
    balloons = numbered.where(~((k == 7) & (i % 6 == 1))).select("sequence_id", "balloon_id", (F.col("page_index") + F.when(i % 40 == 9, 1).otherwise(0)).alias("page_index"), F.floor(F.col("x1") / 600).cast("int").alias("panel_pos"))
    first = adjudications.select("sequence_id", (ball + F.col("balloon_pos")).cast("long").alias("balloon_id"), "adj_pos", "text_type", "include_in_story", F.when((F.col("balloon_pos") == 4) & (i % 3 == 0), " ").otherwise(F.col("final_text")).alias("final_text"))
    again = first.withColumns({"adj_pos": F.lit(2), "text_type": F.lit("sign")})
    decided = numbered.select("sequence_id", "balloon_id", F.lit(0).alias("decision_pos"), F.when(F.col("region_pos") % 3 != 0, k).alias("character_id"))
    characters = numbered.where("k <= 6").select(*K, k.alias("character_id")).distinct()
    people = numbered.where(((k <= 4) | (k == 7)) & (i % 8 != 5)).select("sequence_id", k.alias("character_id")).distinct()
    j = F.col("character_id")
    label = F.when(j == 1, "A").when(j.isin(2, 4), "B").when(j == 7, "Hero")
    identity_ = people.select("sequence_id", "character_id", F.when((j == 2) & (i % 9 == 2), 1).otherwise(j).alias("identity_id"), label.alias("label"), F.when(j == 4, "ambiguous").otherwise("matched").alias("state"))
    return order, balloons, first.unionByName(again), decided.unionByName(decided.withColumns({"decision_pos": F.lit(1), "character_id": F.lit(1)})), characters, identity_


def _resolved(spark, sf_dir):
    return resolve.resolve_sequence(*_cast(spark, sf_dir))


@query(f"SELECT sequence_id, sequence_position, page_index, panel_pos, balloon_id, character_id, identity_id, speaker, identity_state, resolution, reason, codes FROM ({_R1})", "fx_regions", "fx_adjudications")
def r1_resolve_sequence(spark, sf_dir):
    return _resolved(spark, sf_dir).drop("text_type", "include_in_story", "final_text")


@query(f"SELECT sequence_id, sequence_position, balloon_id, page_index, reason FROM ({_R1}) WHERE resolution = 'unresolved'", "fx_regions", "fx_adjudications")
def r1_unresolved_items(spark, sf_dir):
    return resolve.split_resolution(_resolved(spark, sf_dir)).unresolved


_SEVERITY = " ".join(f"WHEN '{c}' THEN '{v}'" for c, v in resolve.SEVERITY.items())


@query(f"SELECT 'sequence_resolver' AS component, code, CASE code {_SEVERITY} END AS severity, count(*) AS n, count(DISTINCT sequence_id) AS sequences FROM (SELECT sequence_id, unnest(codes) AS code FROM ({_R1})) GROUP BY ALL", "fx_regions", "fx_adjudications")
def m3_diagnostic_summary(spark, sf_dir):
    return telemetry.diagnostic_summary(resolve.split_resolution(_resolved(spark, sf_dir)).diagnostics)


@query("SELECT sequence_id, page_index, line_index, CASE WHEN speaker = 'assistant' OR speaker = 'NARRATION' THEN speaker WHEN speaker = 'user' THEN 'Character USER' END AS speaker FROM fx_gold", "fx_gold")
def r2_normalize_labels(spark, sf_dir):
    (gold,) = load(spark, sf_dir, "fx_gold")
    label = F.when(F.col("speaker") == "user", "USER").otherwise(F.col("speaker"))
    keep = F.when(label == "NARRATION", label).otherwise(resolve.normalize_labels(label))
    return gold.select(*K, "line_index", keep.alias("speaker"))


_NONE = {"page_index": "CAST(NULL AS INT)", "balloon_id": "CAST(NULL AS BIGINT)", "identity_id": "CAST(NULL AS BIGINT)", "character_id": "CAST(NULL AS BIGINT)", "label": "CAST(NULL AS VARCHAR)"}


def _says(kind: str, name: str, names: list[str], source: str, **columns: str) -> str:
    """A part of a union of violations."""
    return f"SELECT sequence_id, '{name}' AS {kind}, " + ", ".join(f"{columns.get(c, _NONE[c])} AS {c}" for c in names) + f" FROM {source}"


_STORY = f"""r AS ({_R1}), story AS (SELECT * FROM r WHERE resolution = 'ordered'), w AS (SELECT *, lag(page_index) OVER (PARTITION BY sequence_id ORDER BY sequence_position, balloon_id) AS prev, row_number() OVER (PARTITION BY sequence_id, balloon_id ORDER BY sequence_position) AS times FROM story),
  labels AS (SELECT sequence_id, identity_id FROM story WHERE identity_id IS NOT NULL AND speaker IS NOT NULL GROUP BY ALL HAVING count(DISTINCT speaker) > 1)"""
_IN_R3 = ["page_index", "balloon_id", "identity_id", "character_id"]
_R3 = " UNION ALL ".join([
    _says("code", "identity_label_conflict", _IN_R3, "labels", identity_id="identity_id"),
    _says("code", "same_page_identity_collapse", _IN_R3, "(SELECT sequence_id, page_index, identity_id FROM c JOIN i USING (sequence_id, character_id) GROUP BY ALL HAVING count(DISTINCT character_id) > 1)", page_index="page_index", identity_id="identity_id"),
    _says("code", "page_order_violation", _IN_R3, "w WHERE page_index < prev", page_index="page_index", balloon_id="balloon_id"),
    _says("code", "duplicate_balloon_in_sequence", _IN_R3, "w WHERE times > 1", balloon_id="balloon_id"),
    _says("code", "identity_references_unknown_character", _IN_R3, "i WHERE character_id = 7", character_id="character_id"),
])


@query(f"WITH {_CAST}, {_STORY} SELECT *, 'error' AS severity FROM ({_R3})", "fx_regions", "fx_adjudications")
def r3_consistency_checks(spark, sf_dir):
    *_, characters, identity_ = cast = _cast(spark, sf_dir)
    (resolved,) = hold(resolve.resolve_sequence(*cast).drop("text_type", "final_text", "panel_pos"), too=True)
    return resolve.consistency_checks(resolve.split_resolution(resolved).ordered, identity_, characters)


_IN_V1 = ["page_index", "balloon_id", "identity_id", "label"]
_AT = {"page_index": "page_index", "balloon_id": "balloon_id"}
_V1 = " UNION ALL ".join([
    _says("rule", "all_page_indices_valid", _IN_V1, "r WHERE resolution <> 'unresolved' AND page_index NOT IN (0, 1, 2)", **_AT),
    _says("rule", "exactly_three_pages", _IN_V1, "(SELECT DISTINCT sequence_id FROM story WHERE page_index NOT IN (0, 1, 2))"),
    _says("rule", "no_duplicate_balloon", _IN_V1, "w WHERE times > 1", **_AT),
    _says("rule", "page_order_monotonic", _IN_V1, "w WHERE page_index < prev", **_AT),
    _says("rule", "text_exists_for_story_balloons", _IN_V1, "story WHERE trim(final_text) = ''", **_AT),
    _says("rule", "speaker_references_valid_character", _IN_V1, "story WHERE character_id = 7", **_AT),
    _says("rule", "speaker_label_maps_to_valid_identity", _IN_V1, "story WHERE speaker <> 'NARRATION' AND NOT EXISTS (SELECT 1 FROM l WHERE l.sequence_id = story.sequence_id AND 'Character ' || l.label = story.speaker)", label="speaker", **_AT),
    _says("rule", "no_identity_label_conflicts", _IN_V1, "labels", identity_id="identity_id"),
    _says("rule", "sequence_labels_deterministic", _IN_V1, "(SELECT sequence_id, label FROM l GROUP BY ALL HAVING count(DISTINCT identity_id) > 1)", label="label"),
    _says("rule", "no_output_references_different_sequence", _IN_V1, "(SELECT DISTINCT sequence_id FROM r WHERE resolution <> 'unresolved' AND sequence_id % 50 = 3)"),
])


@query(f"WITH {_CAST}, {_STORY}, l AS (SELECT DISTINCT sequence_id, identity_id, label FROM i WHERE label IS NOT NULL AND NOT (character_id IN (1, 2) AND sequence_id % 7 = 3)) {_V1}", "fx_regions", "fx_adjudications")
def v1_validate_resolution(spark, sf_dir):
    *_, characters, identity_ = cast = _cast(spark, sf_dir)
    found = resolve.split_resolution(*hold(resolve.resolve_sequence(*cast).drop("text_type", "panel_pos"), too=True))
    identities = identity_.where("label IS NOT NULL AND NOT (character_id IN (1, 2) AND sequence_id % 7 = 3)").select("sequence_id", "identity_id", "label").distinct()
    return resolve.validate_resolution(found.ordered, found.excluded, characters, identities, characters.select("sequence_id").distinct().where("sequence_id % 50 <> 3").unionByName(cast[0].select("sequence_id").distinct().where("sequence_id % 50 <> 3")))


_V3 = f"""SELECT sequence_id, page_index, row_number() OVER (PARTITION BY sequence_id, page_index ORDER BY sequence_position) - 1 AS line_index,
    CASE WHEN speaker IS NULL THEN 'UNKNOWN' WHEN speaker = 'NARRATION' THEN speaker WHEN identity_state = 'ambiguous' THEN 'UNKNOWN' ELSE speaker END AS speaker, final_text AS text FROM ({_R1}) WHERE resolution = 'ordered' AND page_index <= 2 AND trim(final_text) <> ''"""


@query(_V3, "fx_regions", "fx_adjudications")
def v3_submission_rows(spark, sf_dir):
    return resolve.submission_rows(resolve.split_resolution(_resolved(spark, sf_dir)).ordered)


@query(f"SELECT speaker, count(*) AS n FROM ({_V3}) GROUP BY speaker", "fx_regions", "fx_adjudications")
def v2_submission_speakers(spark, sf_dir):
    return resolve.submission_rows(resolve.split_resolution(_resolved(spark, sf_dir)).ordered).groupBy("speaker").agg(F.count("*").alias("n"))


@query(
    """WITH g AS (SELECT DISTINCT sequence_id FROM fx_gold WHERE sequence_id % 9 <> 2), p AS (SELECT sequence_id, count(*) AS items, count(DISTINCT page_index) AS pages FROM fx_pred GROUP BY ALL)
    SELECT coalesce(g.sequence_id, p.sequence_id) AS sequence_id, coalesce(items, 0) AS items, 3 - coalesce(pages, 0) AS empty_pages, g.sequence_id IS NOT NULL AS in_template, p.sequence_id IS NOT NULL AS in_rows FROM g FULL JOIN p USING (sequence_id)""",
    "fx_gold", "fx_pred",
)
def v4_validate_submission(spark, sf_dir):
    gold, pred = load(spark, sf_dir, "fx_gold", "fx_pred")
    return resolve.validate_submission(pred, gold.select("sequence_id").distinct().where("sequence_id % 9 <> 2"))


def _submission(spark, sf_dir):
    """Predictions as lines of a submission; some texts are blank or placeholders, one sequence comes twice, some are swapped or short."""
    gold, pred = load(spark, sf_dir, "fx_gold", "fx_pred")
    text = F.when(F.col("line_index") == 1, "  ").when((F.col("line_index") == 0) & (F.col("sequence_id") % 3 == 0), F.concat(F.lit("[balloon "), F.col("sequence_id").cast("string"))).otherwise(F.col("text"))
    entry = F.struct("page_index", "line_index", "speaker", text.alias("text"))
    grouped = pred.groupBy("sequence_id").agg(F.array_sort(F.collect_list(entry)).alias("items"))
    page = lambda p: F.transform(F.filter("items", lambda x: x["page_index"] == p), lambda x: F.struct(x["speaker"].alias("speaker"), x["text"].alias("text")))
    pages = F.transform(F.sequence(F.lit(0), F.when(F.col("sequence_id") % 7 == 1, 1).otherwise(2)), page)
    rows = grouped.select(F.col("sequence_id").alias("position"), F.when(F.col("sequence_id") % 5 == 4, F.col("sequence_id") - 1).otherwise(F.col("sequence_id")).alias("sequence_id"), pages.alias("pages"))
    return rows, gold.select(F.col("sequence_id").alias("position"), "sequence_id").distinct()


_SUBMITTED = "SELECT sequence_id AS position, CASE WHEN sequence_id % 5 = 4 THEN sequence_id - 1 ELSE sequence_id END AS sequence_id, page_index, speaker, CASE WHEN line_index = 1 THEN '  ' WHEN line_index = 0 AND sequence_id % 3 = 0 THEN '[balloon ' || sequence_id ELSE text END AS text FROM fx_pred WHERE NOT (sequence_id % 7 = 1 AND page_index = 2)"


@query(
    f"""WITH s AS ({_SUBMITTED}), p AS (SELECT DISTINCT sequence_id AS position, CASE WHEN sequence_id % 5 = 4 THEN sequence_id - 1 ELSE sequence_id END AS sequence_id FROM fx_pred), t AS (SELECT DISTINCT sequence_id FROM fx_gold)
    SELECT sequence_id, CAST(NULL AS INT) AS page_index, 'not_unique' AS error FROM p GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT coalesce(p.sequence_id, t.sequence_id), NULL, 'not_as_in_template' FROM p FULL JOIN t ON p.position = t.sequence_id WHERE p.sequence_id IS DISTINCT FROM t.sequence_id
    UNION ALL SELECT sequence_id, NULL, 'page_count' FROM p WHERE position % 7 = 1
    UNION ALL SELECT sequence_id, page_index, CASE WHEN trim(coalesce(speaker, '')) = '' OR trim(coalesce(text, '')) = '' THEN 'invalid_item' ELSE 'placeholder' END FROM s WHERE position % 7 <> 1 AND (trim(coalesce(speaker, '')) = '' OR trim(coalesce(text, '')) = '' OR text LIKE '[balloon %')""",
    "fx_gold", "fx_pred",
)
def v4_submission_errors(spark, sf_dir):
    return resolve.submission_errors(*_submission(spark, sf_dir))


@query(f"SELECT speaker, count(*) AS n FROM ({_SUBMITTED}) WHERE position % 7 <> 1 AND trim(speaker) <> '' AND trim(text) <> '' AND text NOT LIKE '[balloon %' GROUP BY speaker", "fx_pred")
def v4_speaker_histogram(spark, sf_dir):
    return resolve.speaker_histogram(_submission(spark, sf_dir)[0])


@query("SELECT DISTINCT sequence_id FROM fx_gold WHERE sequence_id % 2 = 0 AND sequence_id % 3 = 0", "fx_gold")
def v5_check_split(spark, sf_dir):
    (gold,) = load(spark, sf_dir, "fx_gold")
    return resolve.check_split(gold.where("sequence_id % 2 = 0"), gold.where("sequence_id % 3 = 0"))


_V6 = """g AS (SELECT sequence_id, page_index, CASE WHEN k = 6 THEN 'r1' ELSE 'r' || region_pos END AS region_id, 'b' || region_pos AS balloon_id, x1, y1, CASE WHEN k = 7 AND sequence_id % 9 = 0 THEN x1 ELSE x2 END AS x2, y2, confidence * 1.2e0 AS confidence,
      CASE k WHEN 1 THEN 'dialogue' WHEN 2 THEN 'shout' WHEN 3 THEN NULL ELSE 'sign' END AS category, k, region_pos FROM fx_regions),
    a AS (SELECT sequence_id, page_index, 'b' || balloon_pos AS balloon_id, text_type, include_in_story, CASE WHEN balloon_pos = 2 THEN ' ' ELSE final_text END AS final_text FROM fx_adjudications),
    m AS (SELECT sequence_id, page_index, balloon_id, 'r' || region_pos AS region_id FROM g)"""
_KEY = lambda *c: "CAST(json_object(" + ", ".join(f"'{x}', {x}" for x in c) + ") AS VARCHAR)"
_RID, _BID = _KEY("sequence_id", "page_index", "region_id"), _KEY("sequence_id", "page_index", "balloon_id")
_MID = _KEY("sequence_id", "page_index", "balloon_id", "region_id")


def _records(spark, sf_dir):
    regions, adjudications = load(spark, sf_dir, "fx_regions", "fx_adjudications")
    k, pos = F.col("k"), F.col("region_pos").cast("string")
    named = regions.withColumns({
        "region_id": F.when(k == 6, "r1").otherwise(F.concat(F.lit("r"), pos)), "balloon_id": F.concat(F.lit("b"), pos), "x2": F.when((k == 7) & (F.col("sequence_id") % 9 == 0), F.col("x1")).otherwise(F.col("x2")),
        "confidence": F.col("confidence") * 1.2, "category": F.when(k == 1, "dialogue").when(k == 2, "shout").when(k == 3, F.lit(None)).otherwise("sign"),
    })
    said = adjudications.withColumns({"balloon_id": F.concat(F.lit("b"), F.col("balloon_pos").cast("string")), "final_text": F.when(F.col("balloon_pos") == 2, " ").otherwise(F.col("final_text"))})
    return {
        "regions": named.select(*K, "region_id", "x1", "y1", "x2", "y2", "confidence", "category"), "adjudications": said.select(*K, "balloon_id", "text_type", "include_in_story", "final_text"),
        "members": named.select(*K, "balloon_id", F.concat(F.lit("r"), pos).alias("region_id")), "balloons": named.where("k <> 5").select(*K, "balloon_id"),
    }


@query(
    f"""WITH {_V6} SELECT 'regions' AS record, 'range_confidence' AS rule, {_RID} AS key, 1 AS n FROM g WHERE confidence > 1 UNION ALL SELECT 'regions', 'kind_category', {_RID}, 1 FROM g WHERE category IS NULL OR category = 'shout'
    UNION ALL SELECT 'regions', 'sound_box', {_RID}, 1 FROM g WHERE NOT (x2 > x1 AND y2 > y1) UNION ALL SELECT 'regions', 'unique_region', {_RID}, count(*) FROM g GROUP BY sequence_id, page_index, region_id HAVING count(*) > 1
    UNION ALL SELECT 'adjudications', 'text_of_story', {_BID}, 1 FROM a WHERE include_in_story AND trim(final_text) = '' UNION ALL SELECT 'members', 'balloon_of_member', {_MID}, 1 FROM m WHERE NOT EXISTS (SELECT 1 FROM g WHERE k <> 5 AND g.sequence_id = m.sequence_id AND g.page_index = m.page_index AND g.balloon_id = m.balloon_id)
    UNION ALL SELECT 'members', 'region_of_member', {_MID}, 1 FROM m WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.sequence_id = m.sequence_id AND g.page_index = m.page_index AND g.region_id = m.region_id)""",
    "fx_regions", "fx_adjudications",
)
def v6_schema_rules(spark, sf_dir):
    return rules.check_schema_rules(_records(spark, sf_dir))


# ---- sources

_SEQ = "SELECT DISTINCT sequence_id, CASE WHEN sequence_id % 4 = 0 THEN 'test' ELSE 'development' END AS split FROM fx_pages"


def _manifest(spark, sf_dir):
    (pages,) = load(spark, sf_dir, "fx_pages")
    name = F.col("sequence_id").cast("string")
    images = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat(name, F.lit("/"), i.cast("string"), F.lit(".png")))
    return pages.select("sequence_id").distinct().select("sequence_id", F.when(F.col("sequence_id") % 4 == 0, "test").otherwise("development").alias("split"), images.alias("images"))


@query(f"SELECT CAST(sequence_id AS VARCHAR) AS sequence_id, CASE WHEN sequence_id % 5 = 0 THEN 'bad_images' END AS reason FROM ({_SEQ})", "fx_pages")
def s1_check_manifest(spark, sf_dir):
    rows = _manifest(spark, sf_dir).withColumn("sequence_id", F.col("sequence_id").cast("string"))
    broken = rows.withColumn("images", F.when(F.col("sequence_id").cast("long") % 5 == 0, F.slice("images", 1, 2)).otherwise(F.col("images")))
    good, bad = transcripts.check_manifest(broken)
    return good.select("sequence_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("sequence_id", "reason"))


@query(f"SELECT * FROM ({_SEQ}) WHERE split = 'test'", "fx_pages")
def s2_sequences_by_split(spark, sf_dir):
    return transcripts.sequences_by_split(_manifest(spark, sf_dir), "test").drop("images")


@query(f"SELECT sequence_id, split, p AS page_index, sequence_id || '/' || p || '.png' AS image_path FROM ({_SEQ}), (VALUES (0), (1), (2)) t(p)", "fx_pages")
def s3_explode_pages(spark, sf_dir):
    return transcripts.explode_pages(_manifest(spark, sf_dir))


_S4 = r"""SELECT 's' || sequence_id AS sequence_id, page_index, line_index, speaker, text FROM fx_gold WHERE sequence_id % 11 NOT IN (1, 2, 3, 4)
  AND sequence_id NOT IN (SELECT sequence_id FROM fx_gold WHERE text IS NULL OR trim(regexp_replace(text, '[\s\p{Cf}]', '', 'g')) = '' OR regexp_matches(text, '[\x00-\x08\x0E-\x1B\x7F-\x84\x86-\x9F]') OR speaker <> trim(speaker) OR speaker = '')"""


@query(_S4, "fx_gold")
def s4_read_transcripts(spark, sf_dir):
    """Four of eleven sequences are broken: a key twice, a speaker that is a number, a blank line, a page too few."""
    (gold,) = load(spark, sf_dir, "fx_gold")
    named = gold.select(F.concat(F.lit("s"), F.col("sequence_id").cast("string")).alias("sequence_id"), "page_index", "line_index", F.coalesce("speaker", F.lit("UNKNOWN")).alias("speaker"), "text")
    lines = transcripts.transcript_lines(named, named).withColumn("k", F.substring("sequence_id", 2, 30).cast("long") % 11)
    value = F.col("value")
    broken = (
        F.when(F.col("k") == 1, F.concat(F.lit('{"pages":[],'), F.substr(value, F.lit(2)))).when(F.col("k") == 2, F.regexp_replace(value, '"speaker":"[^"]*"', '"speaker":5'))
        .when(F.col("k") == 3, F.lit("  ")).when(F.col("k") == 4, F.regexp_replace(value, r"\}$", ',"more":0}')).otherwise(value)
    )
    return transcripts.read_transcripts(lines.select(broken.alias("value")), reference=True)[0]


@query(
    """SELECT sequence_id, count(*) AS items, count(DISTINCT page_index) AS pages, sum(length(text)) AS characters FROM fx_gold GROUP BY sequence_id""",
    "fx_gold",
)
def s5_transcript_lines(spark, sf_dir):
    (gold,) = load(spark, sf_dir, "fx_gold")
    schema = "sequence_id long, pages array<array<struct<speaker:string,text:string>>>"
    parsed = transcripts.transcript_lines(gold, gold).select(F.from_json("value", schema).alias("v")).select("v.*")
    lines = parsed.select("sequence_id", F.posexplode("pages").alias("page_index", "page")).select("sequence_id", "page_index", F.explode("page").alias("item"))
    return lines.groupBy("sequence_id").agg(F.count("*").alias("items"), F.countDistinct("page_index").alias("pages"), F.sum(F.length("item.text")).alias("characters"))


@query(f"SELECT sequence_id, split FROM ({_SEQ}) WHERE sequence_id % 3 <> 0", "fx_pages")
def s8_resume_pending(spark, sf_dir):
    manifest = _manifest(spark, sf_dir).drop("images")
    done = manifest.where("sequence_id % 3 = 0").select("sequence_id", F.lit("x").alias("engine"), F.lit(True).alias("passed"))
    other = manifest.select("sequence_id", F.lit("y").alias("engine"), F.lit(True).alias("passed"))
    return transcripts.resume_pending(manifest, done.unionByName(other), "x")


# ---- text and scores

# DuckDB's levenshtein counts bytes, so in SQL the letters outside ASCII that the tables hold stand for one byte each.
_LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_BYTES = "".join(map(chr, [*range(1, 9), *range(14, 27)]))


def _edits(a: str, b: str) -> str:
    return "levenshtein({}, {})".format(*[f"translate({c}, '{_LETTERS}', '{_BYTES}')" for c in (a, b)])


_CER = f"CASE WHEN length(target_text) = 0 THEN CASE WHEN length(text) = 0 THEN 0.0e0 ELSE 1.0e0 END ELSE {_edits('target_text', 'text')} / CAST(length(target_text) AS DOUBLE) END"
#: Upper case as Spark has it.
_UPPER = f"translate(upper(replace(text, 'ß', 'SS')), '{T.ORACLE_FANCY}', '{T.ORACLE_PLAIN.replace(chr(39), chr(39) * 2)}')"


def _normal(text: str) -> str:
    """The form that is scored, for what the tables hold."""
    fancy, plain = T.FANCY, T.PLAIN.replace("'", "''")
    folded = f"replace(translate(lower(replace({text}, 'ß', 'ss')), '{fancy}', '{plain}'), '…', '...')"
    steps = [(r"\p{Cf}", ""), (r"\.{3,}", "..."), (r"[\s\p{Z}\x0B\x1C-\x1F\x85]+", " "), (r" +([.,!?;:%)\]}])", r"\1"), (r"([(\[{]) +", r"\1")]
    for i, (pattern, by) in enumerate(steps):
        folded = f"regexp_replace({folded}, '{pattern}', '{by}', 'g')"
        folded = f"trim({folded})" if i == 2 else folded
    return folded


@query(r"SELECT doc_id, trim(regexp_replace(upper(replace(text, 'ß', 'SS')), '\s+', ' ', 'g')) AS plain, trim(regexp_replace(regexp_replace(replace(" + _UPPER + r", '…', '...'), '[^A-Z0-9''!?.,:;()\-\x22]+', ' ', 'g'), ' +', ' ', 'g')) AS oracle FROM documents")
def t1_normalize_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", T.plain(F.col("text")).alias("plain"), T.oracle(F.col("text")).alias("oracle"))


@query()
def t1_scorer_form(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.sha2(T.scorer(F.col("text")), 256).alias("form"))


@query(r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:[''\-][\p{L}\p{N}]+)*|[^\s\p{Z}_\p{L}\p{N}]')) AS tokens FROM documents")
def t2_tokenize(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.size(T.tokens(F.lower("text"))).alias("tokens"))


def _actions(spark, sf_dir):
    (rows,) = load(spark, sf_dir, "fx_actions")
    return rows


_ERRORS = f"SELECT *, {_CER} AS cer FROM fx_actions"


@query(f"SELECT item_id, action, round(cer, 6) AS cer FROM ({_ERRORS})", "fx_actions")
def t3_char_error_rate(spark, sf_dir):
    return policy.action_errors(_actions(spark, sf_dir)).select("item_id", "action", *r6("cer"))


@query()
def t4_word_error_rate(spark, sf_dir):
    return _actions(spark, sf_dir).select("item_id", "action", F.round(T.word_error_rate(F.col("target_text"), F.col("text")), 6).alias("wer"))


_SHAPE = "item_id % 7 AS lines, item_id % 3 AS fragments, CASE WHEN item_id % 5 = 0 THEN 'vertical' ELSE 'horizontal' END AS orientation"
_SAME = lambda c: rf"trim(regexp_replace(upper(replace({c}, 'ß', 'SS')), '\s+', ' ', 'g'))"
_MARKS = lambda c: rf"regexp_replace({c}, '[\p{{L}}\p{{N}}\s\p{{Z}}]', '', 'g')"


@query(
    f"""SELECT item_id, action, {_SAME("target_text")} = {_SAME("text")} AS exact_match, {_SAME("text")} = '' AS empty_output, {_MARKS("target_text")} <> {_MARKS("text")} AS punctuation_error, lines > 1 AS multi_line, fragments > 1 AS multi_fragment, orientation = 'vertical' OR lines >= 6 AS stylized
    FROM (SELECT *, {_SHAPE} FROM ({_ERRORS}))""",
    "fx_actions",
)
def t5_text_flags(spark, sf_dir):
    i = F.col("item_id")
    flags = T.text_flags(F.col("target_text"), F.col("text"), i % 7, i % 3, F.when(i % 5 == 0, "vertical").otherwise("horizontal"))
    return _actions(spark, sf_dir).select("item_id", "action", *[v.alias(k) for k, v in flags.items()])


@query(
    f"""SELECT action AS source, sequence_id, count(*) AS n, count(f) AS covered, round(count(f) / CAST(count(*) AS DOUBLE), 6) AS coverage, round(avg(CASE WHEN f IS NOT NULL THEN cer END), 6) AS mean_cer, count(*) FILTER (target_text = f) AS exact, count(*) FILTER (f = '') AS empty
    FROM (SELECT *, CASE WHEN item_id % 9 <> 4 THEN text END AS f FROM ({_ERRORS})) GROUP BY GROUPING SETS ((action, sequence_id), (action))""",
    "fx_actions",
)
def t6_recognizer_summary(spark, sf_dir):
    found = F.when(F.col("item_id") % 9 != 4, F.col("text"))
    pairs = _actions(spark, sf_dir).select(F.col("action").alias("source"), "sequence_id", F.col("target_text").alias("truth"), found.alias("found"))
    return score.recognizer_summary(pairs).select("source", "sequence_id", "n", "covered", *r6("coverage", "mean_cer"), "exact", "empty")


@query(f"SELECT count(*) FILTER (a.cer < b.cer) AS a, count(*) FILTER (b.cer < a.cer) AS b, count(*) FILTER (a.cer = b.cer) AS ties FROM ({_ERRORS}) a JOIN ({_ERRORS}) b ON a.item_id = b.item_id AND a.action = 'NONE' AND b.action = 'UPSCALE'", "fx_actions")
def t7_paired_wins(spark, sf_dir):
    errors = policy.action_errors(_actions(spark, sf_dir))
    a = errors.where("action = 'NONE'").select("item_id", F.col("cer").alias("cer_a"))
    b = errors.where("action = 'UPSCALE'").select("item_id", F.col("cer").alias("cer_b"))
    return score.paired_wins(a.join(b, "item_id"))


@query()
def t8_fuzzy_ratio(spark, sf_dir):
    return _actions(spark, sf_dir).select("item_id", "action", F.round(T.fuzzy_ratio("target_text", "text"), 6).alias("ratio"))


_LINES = "string_agg(text, ' ' ORDER BY line_index)"
_T9 = f"""WITH g AS (SELECT sequence_id, page_index, {_normal(_LINES)} AS g FROM fx_gold GROUP BY ALL), p AS (SELECT sequence_id, page_index, {_normal(_LINES)} AS p FROM fx_pred GROUP BY ALL)
  SELECT sequence_id, page_index, CASE WHEN g = p THEN 1.0e0 ELSE greatest(0.0e0, 1 - {_edits("coalesce(g, '')", "coalesce(p, '')")} / CAST(greatest(length(coalesce(g, '')), length(coalesce(p, ''))) AS DOUBLE)) END AS score
  FROM g FULL JOIN p USING (sequence_id, page_index) WHERE greatest(length(coalesce(g, '')), length(coalesce(p, ''))) > 0"""


@query(f"SELECT sequence_id, page_index, round(score, 6) AS score FROM ({_T9})", "fx_gold", "fx_pred")
def t9_page_text_score(spark, sf_dir):
    return score.page_text_score(*load(spark, sf_dir, "fx_gold", "fx_pred")).select(*K, *r6("score"))


@query()
def t10_align_tokens(spark, sf_dir):
    return score.align_tokens(*load(spark, sf_dir, "fx_gold", "fx_pred")).withColumn("weight", F.round("weight", 6))


@query()
def t11_speaker_mapping(spark, sf_dir):
    return score.speaker_mapping(score.align_tokens(*load(spark, sf_dir, "fx_gold", "fx_pred")))


@query()
def t12_score_sequences(spark, sf_dir):
    found = score.score_sequences(*load(spark, sf_dir, "fx_gold", "fx_pred"))
    return found.select("sequence_id", "missing_sequence", "active_text_pages", *r6(*score.METRICS), *score.COUNTS, *r6(*score.WEIGHTS))


_T13 = """SELECT sequence_id, sequence_id % 10 = 7 AS m, sequence_id % 6 AS a, CASE WHEN sequence_id % 10 = 7 THEN 0 ELSE sequence_id % 8 / 8.0e0 END AS t, CASE WHEN sequence_id % 10 = 7 THEN 0 ELSE sequence_id % 5 / 5.0e0 END AS c,
  CASE WHEN sequence_id % 3 <> 0 THEN sequence_id % 4 / 4.0e0 END AS j FROM (SELECT DISTINCT sequence_id FROM fx_gold)"""


@query(
    f"""SELECT count(*) AS sequences, count(*) FILTER (m) AS missing_sequences, round(avg(t) FILTER (m OR a > 0), 6) AS text_order_score, round(avg(j), 6) AS balanced_joint_f1, round(avg(j / 2), 6) AS speaker_accuracy_on_matched,
    round(avg(j / 4), 6) AS joint_f1, round(avg(c) FILTER (m OR a > 0), 6) AS matched_token_coverage FROM ({_T13})""",
    "fx_gold",
)
def t13_macro_scores(spark, sf_dir):
    (gold,) = load(spark, sf_dir, "fx_gold")
    i = F.col("sequence_id")
    missing, joint = i % 10 == 7, F.when(i % 3 != 0, i % 4 / 4.0)
    made = {
        "missing_sequence": missing, "active_text_pages": i % 6, "text_order_score": F.when(missing, 0.0).otherwise(i % 8 / 8.0), "matched_token_coverage": F.when(missing, 0.0).otherwise(i % 5 / 5.0),
        "balanced_joint_f1": joint, "speaker_accuracy_on_matched": joint / 2, "joint_f1": joint / 4,
    }
    scores = gold.select("sequence_id").distinct().withColumns(made)
    return score.macro_scores(scores, gold.where("sequence_id % 10 <> 7")).select("sequences", "missing_sequences", *r6(*score.METRICS))


@query()
def t13_macro_of_sequences(spark, sf_dir):
    """The means of the scores that t12 gives."""
    gold, predicted = load(spark, sf_dir, "fx_gold", "fx_pred")
    (scores,) = hold(score.score_sequences(gold, predicted))
    return score.macro_scores(scores, predicted).select("sequences", "missing_sequences", *r6(*score.METRICS))


# ---- policies

_X2 = f"""SELECT sequence_id, item_id, best_action, best_cer, base_cer, base_cer - best_cer AS gain, CASE WHEN base_cer - best_cer >= 0.03e0 THEN best_action ELSE 'NONE' END AS oracle_action FROM (
    SELECT sequence_id, item_id, arg_min(action, (cer, action_pos)) AS best_action, min(cer) AS best_cer, max(cer) FILTER (action = 'NONE') AS base_cer FROM ({_ERRORS}) GROUP BY ALL)"""


def _oracle(spark, sf_dir):
    return policy.oracle_actions(policy.action_errors(_actions(spark, sf_dir)))


def _blocks(spark, sf_dir):
    rows = _actions(spark, sf_dir)
    score_ = ((F.col("item_id") * 17 + F.col("action_pos") * 31) % 101).cast("double")
    return rows.select(F.col("sequence_id").alias("page_id"), (F.col("item_id") % 5).alias("block_pos"), (F.col("item_id") % 3).alias("gt_pos"), "action", "action_pos", score_.alias("score"))


_BLOCKS = "SELECT sequence_id AS page_id, item_id % 5 AS block_pos, item_id % 3 AS gt_pos, action, action_pos, CAST((item_id * 17 + action_pos * 31) % 101 AS DOUBLE) AS score FROM fx_actions"
_X1 = f"""SELECT page_id, block_pos, gt_pos, action, score FROM (SELECT *, row_number() OVER (PARTITION BY page_id, gt_pos ORDER BY score DESC, block_pos DESC) AS m FROM (
    SELECT *, row_number() OVER (PARTITION BY page_id, block_pos ORDER BY score DESC, gt_pos, action_pos) AS n FROM ({_BLOCKS})) WHERE n = 1 AND score >= 50) WHERE m = 1"""


@query(_X1, "fx_actions")
def x1_match_blocks(spark, sf_dir):
    return policy.match_blocks(_blocks(spark, sf_dir))


@query(f"SELECT sequence_id, item_id, best_action, round(best_cer, 6) AS best_cer, round(base_cer, 6) AS base_cer, round(gain, 6) AS gain, oracle_action FROM ({_X2})", "fx_actions")
def x2_oracle_actions(spark, sf_dir):
    return _oracle(spark, sf_dir).select("sequence_id", "item_id", "best_action", *r6("best_cer", "base_cer", "gain"), "oracle_action")


@query(f"SELECT b.page_id, b.block_pos, max(b.score) AS best_score FROM ({_BLOCKS}) b LEFT JOIN ({_X1}) m ON m.page_id = b.page_id AND m.block_pos = b.block_pos WHERE m.page_id IS NULL GROUP BY ALL", "fx_actions")
def x3_unmatched_blocks(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    return policy.unmatched_blocks(blocks, policy.match_blocks(blocks))


_LIST = ["NONE", "UPSCALE", "CONTRAST", "THRESHOLD", "ROTATE_CW", "ROTATE_CCW"]


@query(f"SELECT a.action, count(o.item_id) AS n FROM (SELECT unnest({_LIST}) AS action) a LEFT JOIN ({_X2}) o ON o.oracle_action = a.action GROUP BY ALL", "fx_actions")
def x4_action_distribution(spark, sf_dir):
    return policy.action_distribution(_oracle(spark, sf_dir), _LIST)


@query(
    f"""SELECT t AS threshold, count(*) FILTER (gain >= t) AS used, round(avg(base_cer), 6) AS mean_before, round(avg(CASE WHEN gain >= t THEN best_cer ELSE base_cer END), 6) AS mean_after, round(avg(CASE WHEN gain >= t THEN base_cer - best_cer ELSE 0 END), 6) AS mean_gain
    FROM ({_X2}), (SELECT unnest([0.0e0, 0.01e0, 0.02e0, 0.05e0]) AS t) GROUP BY t""",
    "fx_actions",
)
def x5_gain_sweep(spark, sf_dir):
    return policy.gain_sweep(_oracle(spark, sf_dir), [0.0, 0.01, 0.02, 0.05]).select("threshold", "used", *r6("mean_before", "mean_after", "mean_gain"))


@query(f"SELECT t AS threshold, CASE WHEN gain >= t THEN best_action ELSE 'NONE' END AS action, count(*) AS n FROM ({_X2}), (SELECT unnest([0.0e0, 0.01e0, 0.02e0, 0.05e0]) AS t) GROUP BY ALL", "fx_actions")
def x5_sweep_actions(spark, sf_dir):
    return policy.sweep_actions(_oracle(spark, sf_dir), [0.0, 0.01, 0.02, 0.05])


@query(f"SELECT sequence_id, item_id, round(gain, 6) AS gain FROM ({_X2}) ORDER BY gain DESC, sequence_id, item_id LIMIT 15", "fx_actions")
def x6_top_improvements(spark, sf_dir):
    return policy.top_improvements(_oracle(spark, sf_dir)).select("sequence_id", "item_id", *r6("gain"))


_WORDS = r"len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))"
_X7 = f"""SELECT item_id, action, length(text) AS characters, {_WORDS} AS words, len(regexp_extract_all(text, '[0-9]')) / CAST(length(text) AS DOUBLE) AS digit_ratio, len(regexp_extract_all(text, '[A-Z]')) / CAST(length(text) AS DOUBLE) AS upper_ratio FROM ({_ERRORS})"""


_X7_ALL = r"""SELECT item_id, action, recognition_score, 20.0e0 + item_id % 90 AS width, 10.0e0 + item_id % 40 AS height, 1.0e0 + item_id % 4 AS line_count, CASE WHEN item_id % 5 = 0 THEN 1.0e0 ELSE 0.0e0 END AS is_vertical, length(text) AS characters,
  len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, len(regexp_extract_all(text, '\p{Nd}')) / CAST(greatest(length(text), 1) AS DOUBLE) AS digit_ratio, len(regexp_extract_all(text, '[.,!?;:''\x22()\-]')) / CAST(greatest(length(text), 1) AS DOUBLE) AS punctuation_ratio FROM fx_actions"""


@query(
    f"""SELECT item_id, action, round(recognition_score, 6) AS recognition_score, width, height, round(width / height, 6) AS aspect_ratio, round(width * height / 1800000.0e0, 6) AS area_ratio, line_count, round(height / line_count, 6) AS mean_line_height,
    characters, words, round(punctuation_ratio, 6) AS punctuation_ratio, round(digit_ratio, 6) AS digit_ratio, is_vertical FROM ({_X7_ALL})""",
    "fx_actions",
)
def x7_policy_features(spark, sf_dir):
    i = F.col("item_id")
    shaped = _actions(spark, sf_dir).withColumns({"width": i % 90 + 20.0, "height": i % 40 + 10.0, "page_area": F.lit(1800000.0), "line_count": i % 4 + 1.0, "orientation": F.when(i % 5 == 0, "vertical").otherwise("horizontal")})
    whole = ["width", "height", "line_count", "is_vertical", "characters", "words"]
    return policy.policy_features(shaped).select("item_id", "action", *whole, *r6(*[f for f in policy.FEATURES if f not in whole]))


@query(
    f"""SELECT feature, label, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median FROM (SELECT action AS label, 'characters' AS feature, CAST(characters AS DOUBLE) AS value FROM ({_X7}) UNION ALL SELECT action, 'digit_ratio', digit_ratio FROM ({_X7})) GROUP BY ALL""",
    "fx_actions",
)
def x8_feature_summary(spark, sf_dir):
    rows = policy.policy_features(_actions(spark, sf_dir))
    return policy.feature_summary(rows, ["characters", "digit_ratio"], "action").select("feature", "label", *r6("mean", "median"))


_SWEEP = """SELECT model, threshold, count(*) FILTER (expected = 1 AND score >= threshold) AS tp, count(*) FILTER (expected = 0 AND score >= threshold) AS fp, count(*) FILTER (expected = 0 AND score < threshold) AS tn, count(*) FILTER (expected = 1 AND score < threshold) AS fn
    FROM (SELECT expected, 'base_score' AS model, base_score AS score FROM fx_verifier UNION ALL SELECT expected, 'tuned_score', tuned_score FROM fx_verifier), (SELECT unnest([0.25e0, 0.5e0, 0.75e0]) AS threshold) GROUP BY ALL"""
_RATES = "round((tp + tn) / CAST(tp + fp + tn + fn AS DOUBLE), 6) AS accuracy, round(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 6) AS precision, round(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 6) AS recall, round(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 6) AS f1"


@query(f"SELECT tp, fp, tn, fn, {_RATES}, round((tp / CAST(tp + fn AS DOUBLE) + tn / CAST(tn + fp AS DOUBLE)) / 2, 6) AS balanced_accuracy FROM ({_SWEEP}) WHERE model = 'base_score' AND threshold = 0.5e0", "fx_verifier")
def x9_binary_metrics(spark, sf_dir):
    (rows,) = load(spark, sf_dir, "fx_verifier")
    said = (F.col("base_score") >= 0.5).cast("int")
    return policy.with_rates(rows.agg(*policy.confusion(F.col("expected"), said))).select("tp", "fp", "tn", "fn", *r6("accuracy", "precision", "recall", "f1", "balanced_accuracy"))


#: Groups of 1, 2 or 6 rows; one feature is the same everywhere, one differs in each row.
_STUMP_FEATURES = ["base_score", "tuned_score", "place", "same"]
_LEFT_OUT = f"""f AS (SELECT *, CAST(CASE WHEN doc_id % 10 < 6 THEN floor(doc_id / 10) * 10 ELSE doc_id END AS BIGINT) AS grp, CAST(doc_id AS DOUBLE) / 16 AS place, 1.0e0 AS same FROM fx_verifier),
    l AS (SELECT grp, expected, unnest({_STUMP_FEATURES}) AS feature, unnest([base_score, tuned_score, place, same]) AS value FROM f WHERE expected IS NOT NULL),
    t AS (SELECT grp, feature, value, sum(expected) AS pos, sum(1 - expected) AS neg FROM l WHERE value IS NOT NULL GROUP BY ALL),
    o AS (SELECT feature, value, sum(pos) AS pos, sum(neg) AS neg FROM t GROUP BY ALL),
    k AS (SELECT g.grp, o.feature, o.value, o.pos - coalesce(t.pos, 0) AS pos, o.neg - coalesce(t.neg, 0) AS neg FROM (SELECT DISTINCT grp FROM t) g CROSS JOIN o LEFT JOIN t ON t.grp = g.grp AND t.feature = o.feature AND t.value = o.value),
    c AS (SELECT *, lead(value) OVER w AS nxt, sum(pos) OVER w AS a, sum(neg) OVER w AS b, sum(pos) OVER v AS p, sum(neg) OVER v AS n FROM k WHERE pos + neg > 0 WINDOW w AS (PARTITION BY grp, feature ORDER BY value), v AS (PARTITION BY grp, feature)),
    s AS (SELECT grp, feature, (value + nxt) / 2 AS threshold, a, b, p, n, CASE WHEN p * n > 0 THEN n ELSE 1 END AS wp, CASE WHEN p * n > 0 THEN p ELSE 1 END AS wn FROM c WHERE nxt IS NOT NULL),
    d AS (SELECT grp, feature, threshold, 'ge' AS direction, wn * b + wp * (p - a) AS num, wn * n + wp * p AS den FROM s UNION ALL SELECT grp, feature, threshold, 'le', wn * (n - b) + wp * a, wn * n + wp * p FROM s),
    stumps AS (SELECT grp, feature, threshold, direction, CAST(NULL AS INTEGER) AS said, num / CAST(den AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY grp, feature ORDER BY num DESC, threshold DESC, direction DESC) AS r FROM d) WHERE r = 1
      UNION ALL SELECT grp, feature, min(value), 'constant', CASE WHEN min(p) >= min(n) THEN 1 ELSE 0 END, NULL FROM c GROUP BY grp, feature HAVING count(*) = 1)"""


def _left_out(spark, sf_dir):
    (rows,) = load(spark, sf_dir, "fx_verifier")
    i = F.col("doc_id")
    table = rows.withColumns({"grp": F.when(i % 10 < 6, F.floor(i / 10) * 10).otherwise(i), "place": i / 16.0, "same": F.lit(1.0)})
    return table, stumps.leave_one_out_stumps(table, _STUMP_FEATURES, "expected", "grp")


@query(f"WITH {_LEFT_OUT} SELECT grp, feature, threshold, direction, said, round(score, 6) AS score FROM stumps", "fx_verifier")
def x10_stump_leave_one_out(spark, sf_dir):
    return _left_out(spark, sf_dir)[1].select("grp", "feature", "threshold", "direction", "said", *r6("score"))


@query(
    f"""WITH {_LEFT_OUT}, h AS (SELECT feature, expected, CASE direction WHEN 'le' THEN value <= threshold WHEN 'ge' THEN value >= threshold ELSE said = 1 END AS y FROM l JOIN stumps USING (grp, feature) WHERE value IS NOT NULL),
    q AS (SELECT feature, count(*) FILTER (expected = 1 AND y) AS tp, count(*) FILTER (expected = 0 AND y) AS fp, count(*) FILTER (expected = 0 AND NOT y) AS tn, count(*) FILTER (expected = 1 AND NOT y) AS fn FROM h GROUP BY feature)
    SELECT feature, tp, fp, tn, fn, {_RATES}, round((tp / CAST(tp + fn AS DOUBLE) + tn / CAST(tn + fp AS DOUBLE)) / 2, 6) AS balanced_accuracy FROM q""",
    "fx_verifier",
)
def x10_left_out_metrics(spark, sf_dir):
    table, found = _left_out(spark, sf_dir)
    return stumps.left_out_metrics(table, found, _STUMP_FEATURES, "expected", "grp").select("feature", "tp", "fp", "tn", "fn", *r6("accuracy", "precision", "recall", "f1", "balanced_accuracy"))


@query(
    f"WITH {_LEFT_OUT} SELECT grp, feature, threshold, direction, said, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(coalesce(score, -1), 12) DESC, feature) AS r FROM stumps) WHERE r = 1", "fx_verifier"
)
def x10_best_features(spark, sf_dir):
    return stumps.best_features(_left_out(spark, sf_dir)[1], "grp").select("grp", "feature", "threshold", "direction", "said", *r6("score"))


def _folds(spark, sf_dir):
    (rows,) = load(spark, sf_dir, "fx_verifier")
    chosen = F.when(F.col("source") == "hard_negative", 1.0).otherwise(0.0)
    return rows.where("expected IS NOT NULL").select(F.col("doc_id").alias("row_id"), "expected", "base_score", "tuned_score", chosen.alias("hard"), (F.col("doc_id") % 4).cast("int").alias("fold"))


_X11 = ["base_score", "tuned_score", "hard"]


@query()
def x11_grouped_cv(spark, sf_dir):
    found = models.logistic_says(_folds(spark, sf_dir), _X11, "expected", "fold", 4)
    return found.select("row_id", F.col("expected").alias("label"), "fold", F.round("probability", 4).alias("probability"))


def _tree_level(level: str, grown: str) -> str:
    """Cuts of the nodes of a level, from the table `grown` of (fold, node, y, base_score, tuned_score, hard)."""
    return f"""{level}_l AS (SELECT fold, node, y, unnest([0, 1, 2]) AS f, unnest([base_score, tuned_score, hard]) AS value FROM {grown}),
    {level}_v AS (SELECT fold, node, f, value, sum(CASE WHEN y = 1 THEN w1 ELSE 0 END) AS dp, sum(CASE WHEN y = 0 THEN w0 ELSE 0 END) AS dq FROM {level}_l JOIN weights USING (fold) GROUP BY ALL),
    {level}_c AS (SELECT *, lead(value) OVER w AS nxt, CAST(sum(dp) OVER w AS DOUBLE) AS a, CAST(sum(dq) OVER w AS DOUBLE) AS b, CAST(sum(dp) OVER v AS DOUBLE) AS p, CAST(sum(dq) OVER v AS DOUBLE) AS q FROM {level}_v WINDOW w AS (PARTITION BY fold, node, f ORDER BY value), v AS (PARTITION BY fold, node, f)),
    {level}_n AS (SELECT fold, node, any_value(p) AS p, any_value(q) AS q FROM {level}_c GROUP BY fold, node),
    {level}_s AS (SELECT fold, node, f, (value + nxt) / 2 AS threshold, row_number() OVER (PARTITION BY fold, node ORDER BY round((a * b / (a + b) + (p - a) * (q - b) / (p - a + q - b)) / (p + q), 12), f, value) AS r FROM {level}_c WHERE nxt IS NOT NULL AND p > 0 AND q > 0),
    {level} AS (SELECT n.fold, n.node, s.f, s.threshold, CASE WHEN n.p > n.q THEN 1 ELSE 0 END AS said FROM {level}_n n LEFT JOIN {level}_s s ON s.fold = n.fold AND s.node = n.node AND s.r = 1)"""


_VALUE = "CASE f WHEN 0 THEN base_score WHEN 1 THEN tuned_score ELSE hard END"
_TREES = f"""rows AS (SELECT doc_id AS row_id, expected AS y, base_score, tuned_score, CASE WHEN source = 'hard_negative' THEN 1.0e0 ELSE 0.0e0 END AS hard, CAST(doc_id % 4 AS INTEGER) AS own FROM fx_verifier WHERE expected IS NOT NULL),
    g1 AS (SELECT k.fold, 1 AS node, rows.* FROM rows JOIN (SELECT unnest([0, 1, 2, 3]) AS fold) k ON k.fold <> own),
    weights AS (SELECT fold, greatest(sum(1 - y), 1) AS w1, greatest(sum(y), 1) AS w0 FROM g1 GROUP BY fold), {_tree_level("r1", "g1")},
    g2 AS (SELECT fold, node * 2 + CASE WHEN {_VALUE} <= threshold THEN 0 ELSE 1 END AS node, y, base_score, tuned_score, hard FROM g1 JOIN r1 USING (fold, node) WHERE f IS NOT NULL), {_tree_level("r2", "g2")},
    g3 AS (SELECT fold, node * 2 + CASE WHEN {_VALUE} <= threshold THEN 0 ELSE 1 END AS node, y, base_score, tuned_score, hard FROM g2 JOIN r2 USING (fold, node) WHERE f IS NOT NULL), {_tree_level("r3", "g3")},
    trees AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT fold, node, NULL, NULL, said FROM r3)"""


@query(f"WITH {_TREES} SELECT fold, CAST(node AS BIGINT) AS node, ['base_score', 'tuned_score', 'hard'][f + 1] AS feature, round(threshold, 6) AS threshold, said FROM trees", "fx_verifier")
def x11_tree_folds(spark, sf_dir):
    return models.tree_folds(_folds(spark, sf_dir), _X11, "expected", "fold", 4).select("fold", "node", "feature", *r6("threshold"), "said")


@query()
def x11_compared_models(spark, sf_dir):
    """Out-of-fold answers of either model beside never saying yes."""
    rows = _folds(spark, sf_dir)
    trees = models.tree_says(rows, models.tree_folds(rows, _X11, "expected", "fold", 4), _X11, "fold").withColumnRenamed("said", "tree")
    both = models.logistic_says(trees, _X11, "expected", "fold", 4).withColumns({"logistic": (F.col("probability") >= 0.5).cast("int"), "never": F.lit(0)})
    return models.compared_models(both, "expected", ["never", "tree", "logistic"]).select("model", "tp", "fp", "tn", "fn", *r6("accuracy", "balanced_accuracy", "precision", "recall", "f1"))


@query()
def x11_ranked_coefficients(spark, sf_dir):
    return models.ranked_coefficients(_folds(spark, sf_dir), _X11, "expected").withColumn("coefficient", F.round("coefficient", 4))


@query(f"SELECT model, threshold, tp, fp, tn, fn, {_RATES}, round(tn / CAST(tn + fp AS DOUBLE), 6) AS wrong_recall, round((tn + fn) / CAST(tp + fp + tn + fn AS DOUBLE), 6) AS call_rate, round(fp / CAST(tp + fp + tn + fn AS DOUBLE), 6) AS wrong_accept_rate FROM ({_SWEEP})", "fx_verifier")
def x12_verifier_sweep(spark, sf_dir):
    (rows,) = load(spark, sf_dir, "fx_verifier")
    return policy.verifier_sweep(rows, [0.25, 0.5, 0.75], ["base_score", "tuned_score"]).select("model", "threshold", "tp", "fp", "tn", "fn", *r6("accuracy", "precision", "recall", "f1", "wrong_recall", "call_rate", "wrong_accept_rate"))


@query("SELECT count(*) FILTER (expected = 1) AS tp, count(*) FILTER (expected = 0) AS fp, 0 AS tn, 0 AS fn, round(avg(CAST(expected AS DOUBLE)), 6) AS accuracy, round(avg(CAST(expected AS DOUBLE)), 6) AS precision, 1.0e0 AS recall FROM fx_verifier", "fx_verifier")
def x12_always_accept(spark, sf_dir):
    return policy.always_accept(*load(spark, sf_dir, "fx_verifier")).select("tp", "fp", "tn", "fn", *r6("accuracy", "precision", "recall"))


@query(
    """SELECT source, kind, count(*) AS n, list_slice(list(doc_id ORDER BY doc_id), 1, 10) AS examples FROM (SELECT doc_id, source, CASE WHEN tuned_score >= 0.5e0 AND expected = 0 THEN 'false_accept' WHEN tuned_score < 0.5e0 AND expected = 1 THEN 'false_reject' END AS kind FROM fx_verifier) WHERE kind IS NOT NULL GROUP BY GROUPING SETS ((source), (kind))""",
    "fx_verifier",
)
def x13_failure_breakdown(spark, sf_dir):
    (rows,) = load(spark, sf_dir, "fx_verifier")
    return policy.failure_breakdown(rows, "tuned_score", 0.5, "doc_id")


@query()
def x14_group_split(spark, sf_dir):
    (pages,) = load(spark, sf_dir, "fx_pages")
    return policy.group_split(pages.select("sequence_id").distinct(), 0.2, 7)


# ---- telemetry


@query(
    "SELECT stage, count(*) AS calls, round(sum(seconds * 1000), 3) AS total_ms, round(avg(seconds * 1000), 3) AS avg_ms, round(quantile_cont(seconds * 1000, 0.5), 3) AS p50_ms, round(quantile_cont(seconds * 1000, 0.95), 3) AS p95_ms FROM fx_timings GROUP BY stage",
    "fx_timings",
)
def m1_latency_profile(spark, sf_dir):
    (rows,) = load(spark, sf_dir, "fx_timings")
    return telemetry.latency_profile(rows).select("stage", "calls", *[F.round(c, 3).alias(c) for c in ("total_ms", "avg_ms", "p50_ms", "p95_ms")])


@query(
    """SELECT sequence_id, page_index, count(*) AS regions, count(*) FILTER (coalesce(include_in_story, false)) AS story, count(*) FILTER (text_type = 'dialogue') AS spoken
    FROM (SELECT sequence_id, page_index, region_pos AS balloon_pos FROM fx_regions) LEFT JOIN fx_adjudications USING (sequence_id, page_index, balloon_pos) GROUP BY ROLLUP (sequence_id, page_index)""",
    "fx_regions", "fx_adjudications",
)
def m2_page_stats(spark, sf_dir):
    regions, adjudications = load(spark, sf_dir, "fx_regions", "fx_adjudications")
    return telemetry.page_stats(regions.withColumnRenamed("region_pos", "balloon_pos").select(*K, "balloon_pos"), adjudications)


_COUNTED = {
    "regions": "fx_regions", "balloons": "b", "story_decisions": "a WHERE include_in_story", "characters": "c", "speakers_resolved": "r WHERE resolution = 'ordered' AND speaker <> 'NARRATION' AND identity_state IS NOT NULL", "speakers_narration": "r WHERE resolution = 'ordered' AND speaker = 'NARRATION'",
    "speakers_unresolved": "r WHERE resolution = 'ordered' AND speaker IS NULL", "speakers_ambiguous": "r WHERE resolution = 'ordered' AND identity_state = 'ambiguous'", "clusters": "i", "clusters_matched": "i WHERE state = 'matched'", "clusters_ambiguous": "i WHERE state = 'ambiguous'", "pairs": "c x JOIN c y USING (sequence_id) WHERE x.page_index < y.page_index",
    "ordered": "r WHERE resolution = 'ordered'", "excluded": "r WHERE resolution = 'excluded'", "unresolved": "r WHERE resolution = 'unresolved'", "diagnostics": "d", "errors": f"d WHERE CASE code {_SEVERITY} END = 'error'", "candidates": "b WHERE balloon_id % 3 = 0",
}


@query(
    f"WITH {_CAST}, r AS ({_R1}), d AS (SELECT sequence_id, unnest(codes) AS code FROM r), m AS (" + " UNION ALL ".join(f"SELECT sequence_id, '{k}' AS metric FROM {v}" for k, v in _COUNTED.items()) + ") SELECT sequence_id, metric, count(*) AS n FROM m GROUP BY GROUPING SETS ((sequence_id, metric), (metric))",
    "fx_regions", "fx_adjudications",
)
def m2_run_report(spark, sf_dir):
    order, balloons, adjudications, speakers, characters, identity_ = _cast(spark, sf_dir)
    (resolved,) = hold(resolve.resolve_sequence(order, balloons, adjudications, speakers, characters, identity_).drop("text_type", "final_text", "panel_pos"), too=True)
    x, y = (characters.select("sequence_id", F.col("page_index").alias(c)) for c in ("p", "q"))
    pairs = x.join(y, "sequence_id").where("p < q")
    regions, _ = load(spark, sf_dir, "fx_regions", "fx_adjudications", by=["sequence_id"], held=False)
    return telemetry.run_report(telemetry.report_tables(regions, balloons, adjudications.where("adj_pos = 1"), balloons.where("balloon_id % 3 = 0"), characters, resolved, identity_, pairs, resolve.diagnostics(resolved)))


@query("SELECT sequence_id, stage AS status, event_id FROM (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY ts DESC, event_id DESC) AS n FROM fx_timings WHERE stage IN ('click', 'purchase')) WHERE n = 1", "fx_timings")
def m4_run_states(spark, sf_dir):
    (rows,) = load(spark, sf_dir, "fx_timings")
    events = rows.select("sequence_id", F.col("stage").alias("status"), F.col("ts").alias("at"), "event_id")
    latest = telemetry.run_states(events, ["click", "purchase"])
    return latest.join(events, ["sequence_id", "status", "at"]).groupBy("sequence_id", "status").agg(F.max("event_id").alias("event_id"))

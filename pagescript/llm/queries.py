"""Queries of the training-data operators over the driver's tables, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, jaccard, licenses, merkle, mixing, quality, secret_scan, simhash, spelling, suffix_dedup, token_counts, toxicity
from .common import read, scratch_path

#: Place of the vocabulary files; a file of the same name must be on every executor.
TOKENIZERS = "/opt/tokenizers"


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN



def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where(toxicity.learnable(F.col("doc_id"))).select("doc_id", "toxic")
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    held_out = F.coalesce(~toxicity.learnable(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= toxicity.CUTOFF, 1).otherwise(0).alias("predicted"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents")).drop("places")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    candidates = secret_scan.candidates(docs, "source")
    found = secret_scan.judge(candidates, secret_scan.fit(secret_scan.weak_labels(candidates))).where("is_secret")
    return found.select("doc_id", "ordinal", F.col("length").cast("long").alias("length"), F.sha2("candidate", 256).alias("secret_sha256"), F.round("probability", 4).alias("probability"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches: all documents; those of every 97th id deleted; those of every 89th id that are left counted as half, rounded down.

    The second batch is committed twice, which must not count.
    """
    from .common import cut

    docs = read(spark, sf_dir, "documents")
    counts = cut(token_counts.counted(docs, f"{TOKENIZERS}/byte_bpe_50k.tiktoken", _pattern(), "byte_bpe_50k/1"))
    ledger = token_counts.Ledger(spark, scratch_path(spark, "token-ledger"))
    gone = counts.where("doc_id % 97 = 0")
    ledger.commit("0001", token_counts.inserts(counts))
    ledger.commit("0002", token_counts.deletes(gone))
    ledger.commit("0002", token_counts.deletes(gone))
    ledger.commit("0003", token_counts.revisions(counts.where("doc_id % 89 = 0 AND doc_id % 97 <> 0"), F.floor(F.col("n_tokens") / 2)))
    return ledger.totals()


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(read(spark, sf_dir, "documents"), decontam.question_and_answer(read(spark, sf_dir, "benchmark")))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    tricky = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(tricky)
    vocabulary, pattern = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", _pattern()
    return chat.read_back(chat.format_turns(rows, vocabulary, pattern), vocabulary, pattern)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.removal(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance2", 3).alias("distance2"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id has an even CRC-32 are tampered with: their line ends are deleted."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle.manifest(read(spark, sf_dir, "documents"), {"text": tampered})
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def queries() -> dict:
    found = (
        op1_toxicity, op2_license_scan, op3_secret_scan, op4_mix_sources, op5_token_counts,
        op6_decontamination, op7_chat_format, op8_suffix_dedup, op9_quality_rules, op10_ngram_jaccard,
        op11_merkle_manifest, op12_spelling_variants, op13_simhash,
    )
    return {f.__name__: f for f in found}


_UNIT = "CAST(('0x' || substr(md5({}), 1, 8)) AS BIGINT) / 4294967296.0e0"
MIX_SQL = rf"""
WITH d AS (SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, coalesce('s' || source, 'n') AS name FROM documents),
s AS (SELECT name, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY name),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0e0 AS cap, row_number() OVER (ORDER BY source IS NULL, source) AS rk FROM s),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM w
  WINDOW b AS (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT (SELECT level FROM l WHERE cap / weight > level ORDER BY cap / weight, rk LIMIT 1) AS final),
t AS (SELECT name, source_size, CASE WHEN final IS NULL THEN cap ELSE least(cap, weight * final) END AS target FROM l, f),
k AS (SELECT *, length(bin(size + 1)) - 1 AS o, floor({_UNIT.format("coalesce(CAST(doc_id AS VARCHAR), '') || '/' || md5(coalesce(text, '')) || '/mix'")} * 128) AS bucket FROM d),
n AS (SELECT doc_id, size, name, row_number() OVER (PARTITION BY name ORDER BY 4 * o + floor((size + 1) * 4 / pow(2.0e0, o)), bucket, size, doc_id) AS upto FROM k),
c AS (SELECT n.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, {_UNIT.format("n.name || '/mix'")} AS start FROM n JOIN t USING (name))
SELECT doc_id, size, source_size, target, size * CAST(least(floor(upto * rate + start) - floor((upto - 1) * rate + start), 3) AS BIGINT) AS taken FROM c
"""


#: CRC-32 of the bytes of a string, with the table t worked out in a CTE "crc".
_CRC = "xor(list_reduce([4294967295] || list_transform(range(CAST(strlen({0}) AS BIGINT)), lambda i: CAST('0x' || substr(hex({0}), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"
_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"
_PART = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_PART.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
MERKLE_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT doc_id, coalesce('s' || source, '') AS tree, {_LEAF.format("text")} AS leaf,
  {_LEAF.format(f"(CASE WHEN {_CRC.format('CAST(doc_id AS VARCHAR)')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)")} AS changed FROM documents, crc),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
up AS (SELECT 0 AS lvl, tree, pos, n, leaf AS digest FROM l
  UNION ALL SELECT lvl + 1, tree, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY lvl, tree, pos // 3, n),
s AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
upper AS (SELECT 0 AS lvl, pos, n, subroot AS digest FROM s
  UNION ALL SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY lvl, pos // 3, n),
f AS (SELECT doc_id, tree, pos AS id, 0 AS lvl, pos, n, changed AS digest, '' AS proof FROM l
  UNION ALL SELECT doc_id, f.tree, id, f.lvl + 1, f.pos // 3, (f.n + 2) // 3, sha256(string_agg(CASE WHEN u.pos = f.pos THEN f.digest ELSE u.digest END, '' ORDER BY u.pos)),
    any_value(f.proof) || coalesce(string_agg(u.digest, '' ORDER BY u.pos) FILTER (WHERE u.pos <> f.pos), '')
  FROM f JOIN up u ON u.tree = f.tree AND u.lvl = f.lvl AND u.pos // 3 = f.pos // 3 WHERE f.n > 1 GROUP BY doc_id, f.tree, id, f.lvl, f.pos // 3, f.n),
g AS (SELECT f.doc_id, f.tree, id, 0 AS lvl, s.pos, s.n, f.digest, f.proof FROM f JOIN s USING (tree) WHERE f.n = 1
  UNION ALL SELECT doc_id, g.tree, id, g.lvl + 1, g.pos // 3, (g.n + 2) // 3, sha256(string_agg(CASE WHEN u.pos = g.pos THEN g.digest ELSE u.digest END, '' ORDER BY u.pos)),
    any_value(g.proof) || coalesce(string_agg(u.digest, '' ORDER BY u.pos) FILTER (WHERE u.pos <> g.pos), '')
  FROM g JOIN upper u ON u.lvl = g.lvl AND u.pos // 3 = g.pos // 3 WHERE g.n > 1 GROUP BY doc_id, g.tree, id, g.lvl, g.pos // 3, g.n)
SELECT l.doc_id, leaf, subroot, upper.digest AS root, sha256(g.proof) AS proof_sha256, g.digest AS folded_root, g.digest = upper.digest AS verified
FROM l JOIN s USING (tree) JOIN g ON g.tree = l.tree AND g.id = l.pos AND g.n = 1 JOIN upper ON upper.n = 1
"""
#: Near words by deletion: of equal length if they agree without one place, else if the longer one without one place is the shorter.
SPELLING_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
k AS (SELECT doc_id, run, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR) || ':' || run, '') AS name FROM r GROUP BY doc_id, run),
h AS (SELECT run, n, doc_id IS NOT NULL AS slips, {_CRC.format("name")} AS h FROM k, crc),
c AS (SELECT CASE WHEN slips AND h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1),
v AS MATERIALIZED (SELECT word, n FROM c WHERE length(word) >= 5 AND n >= 3),
e AS MATERIALIZED (SELECT word, p, substr(word, 1, p - 1) || substr(word, p + 1) AS part FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM v)),
near AS (SELECT a.word AS a, b.word AS b FROM e a JOIN e b USING (p, part) WHERE a.word <> b.word
  UNION SELECT e.word, v.word FROM e JOIN v ON e.part = v.word UNION SELECT v.word, e.word FROM e JOIN v ON e.part = v.word),
b AS (SELECT a, CAST(count(*) AS BIGINT) AS n_near, min(struct_pack(k := -v.n, w := v.word)) AS best FROM near JOIN v ON v.word = near.b GROUP BY a),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.k >= 2 * v.n THEN best.w END AS form, CASE WHEN -best.k >= 2 * v.n THEN -best.k END AS form_n FROM v LEFT JOIN b ON b.a = v.word),
w AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT w.word, f.word, f.form FROM w JOIN f ON f.word = w.next)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM f JOIN w ON w.word = f.word AND w.next IS NULL
"""


def oracle_sql() -> dict:
    """What SQL can express; the others train, tokenize, hash or search, and are tested in tests/llm."""
    return {"op4_mix_sources": MIX_SQL, "op11_merkle_manifest": MERKLE_SQL, "op12_spelling_variants": SPELLING_SQL}

"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Each stage takes all that its predecessor kept and decides on whole texts:

1. toxicity: documents that the compression-distance classifier rejects go.
2. near_duplicates: of each group that five-word shingles with a Jaccard similarity of 0.8 or more link, the one of the smallest id stays.
3. decontamination: documents that hold a benchmark item go.
4. secrets: secrets are replaced by a mark, n_chars follows; no document goes.
5. mixing: one row per copy of the mix, with size, source_size, target, copies, taken and copy.

Rows without a doc_id are documents of their own in all stages; near copies without any id leave one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagescript.llm import decontam, jaccard, mixing, secret_scan, toxicity
from pagescript.llm.common import broadcast_if_small, cut, read, scratch_path

#: Ids that a join may broadcast; more are joined by a shuffle.
MOST_IDS = 500_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").where(toxicity.learnable(F.col("doc_id"))).select("doc_id", "toxic")
    verdict = toxicity.scorer(toxicity.fit(docs.select("doc_id", "text"), labels))
    return docs.where(verdict(F.col("text")) < toxicity.CUTOFF)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.first_of_each(docs, width=5, num=80, den=100)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = decontam.question_and_answer(read(spark, sf_dir, "benchmark"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("no id"), "text"))
    leaked = cut(decontam.leaks(docs.select(key.alias("doc_id"), "text"), items).select(F.col("doc_id").alias("_leaked")).distinct())
    return docs.join(broadcast_if_small(leaked, MOST_IDS), key == F.col("_leaked"), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    candidates = secret_scan.candidates(docs, "source")
    return secret_scan.redact(docs, secret_scan.judge(candidates, secret_scan.fit(secret_scan.weak_labels(candidates))))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat(mixing.mix(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: No SQL can train the classifiers; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""Helpers on whole tables: cut lineage, rounding as in SQL, checked broadcasts, running sums over groups of any size, components of graphs of any size."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a join may broadcast, after a count.
MOST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where the session names none and runs in one process."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder: what stands above it is never worked out again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def rounded(value: Column | str, digits: int = 6) -> Column:
    """value at so many digits as SQL engines round doubles: the scaled value to the nearest whole number, halves away from zero.

    F.round() rounds the decimal that is printed, which differs where the scaled value lies next to a half.
    """
    c = F.col(value) if isinstance(value, str) else value
    scaled = F.abs(c) * 10.0**digits
    whole = F.rint(scaled)
    return F.signum(c) * F.when(scaled - whole == 0.5, whole + 1).otherwise(whole) / 10.0**digits


def broadcast_if_small(df: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, counted; else as it is. df must be cheap to compute twice."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def running(rows: DataFrame, keys: list[str], order: list[str], **sums: Column) -> DataFrame:
    """rows with each of sums as its running total along order within keys, the row itself included.

    keys must not be null. Rows are dealt out by ranges of (keys, order), so a group of any size is spread over tasks; of each range only
    one row per group is summed up across ranges. Rows that agree in order come in any order.
    """
    by = [*keys, *order]
    ranged = cut(rows.withColumns({f"_{name}": value for name, value in sums.items()}).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_at", 33))
    total = ranged.groupBy(*keys, "_range").agg(*[F.sum(f"_{name}").alias(f"_all_{name}") for name in sums])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(total.select(*keys, "_range", *[F.coalesce(F.sum(f"_all_{name}").over(before), F.lit(0)).alias(f"_start_{name}") for name in sums]))
    along = Window.partitionBy("_range", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.join(broadcast_if_small(starts), [*keys, "_range"]).withColumns({name: F.col(f"_start_{name}") + F.sum(f"_{name}").over(along) for name in sums})
    return placed.drop("_at", "_range", *[f"{p}_{name}" for name in sums for p in ("", "_start")])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) from edges (a, b): the least id that each id reaches. Ids may be structs; loops and repeats do no harm.

    Alternating stars: each round hangs every id's larger neighbours, then its smaller ones, on the least one. Rounds grow with the logarithm
    of the longest path, and each is written to the shared folder.
    """
    now = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        found = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if found == state:
            break
        state = found
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    own = now.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(own).distinct()

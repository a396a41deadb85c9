"""One-feature rules of best balanced accuracy, for each left-out group and feature at once.

Leaving a group out changes the counts of positive and negative rows at the group's own values only; between two of them its counts are those of
all rows less a constant. So there is one grid of values per feature with running counts, and a group asks for the best cut of each of its
segments. The score of a cut is linear in its two running counts, so the best of a segment is a vertex of the convex hull of its points: hulls
of CHUNK values, of RADIX chunks and so on are made once, and a segment is a few hulls and parts of at most two chunks. Rows
grow with the values of the groups and the logarithm of the grid, not with groups times values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import broadcast_if_small, cut, running
from .policy import confusion, with_rates

#: Values of a chunk, nodes of a level that a node of the next one covers, and questions to one node that one task answers.
CHUNK, RADIX, QUESTIONS = 512, 16, 20_000
_POINT = "feature string, level int, block long, idx long, a long, b long"


def hull(a: list[int], b: list[int]) -> list[int]:
    """Places of the vertices of the convex hull of points along which neither a nor b falls, in order."""
    kept = set()
    for sign in (1, -1):
        line: list[int] = []
        for i in range(len(a)):
            while len(line) > 1 and sign * ((a[line[-1]] - a[line[-2]]) * (b[i] - b[line[-2]]) - (b[line[-1]] - b[line[-2]]) * (a[i] - a[line[-2]])) <= 0:
                line.pop()
            line.append(i)
        kept |= set(line)
    return sorted(kept)


def cover(first: int, last: int, chunk: int, radix: int) -> Iterator[tuple[int, int]]:
    """(level, block) of nodes that cover the places first .. last: level -1 are the chunks at the ends, the others whole nodes."""
    low, high = first // chunk, last // chunk
    yield -1, low
    if high > low:
        yield -1, high
    low, high, level = low + 1, high - 1, 0
    while low <= high:
        while low <= high and (low % radix or low == high):
            yield level, low
            low += 1
        while low <= high and (high + 1) % radix:
            yield level, high
            high -= 1
        low, high, level = low // radix, (high + 1) // radix - 1, level + 1


def _hulls(table: pa.Table) -> pa.Table:
    table = table.take(pc.sort_indices(table, [("idx", "ascending")]))
    return table.take(pa.array(hull(table["a"].to_pylist(), table["b"].to_pylist()), pa.int64()))


def _best(points: pa.Table, asked: pa.Table) -> pa.Table:
    """Per question the best cut among the points; of equals the last, then saying yes below."""
    idx, a, b = (points[c].to_numpy() for c in ("idx", "a", "b"))
    order = np.argsort(idx)
    idx, a, b = idx[order], a[order], b[order]
    q = {c: asked[c].to_numpy() for c in ("first", "last", "own_a", "own_b", "pos", "neg")}
    score, at, below = (np.full(asked.num_rows, -1, np.int64) for _ in range(3))
    for k in range(0, asked.num_rows if len(idx) else 0, 256):
        part = slice(k, k + 256)
        pos, neg = q["pos"][part, None], q["neg"][part, None]
        # Recall of either class counts the same; where one class is missing only the other counts.
        wp, wn = np.where(pos * neg > 0, neg, 1), np.where(pos * neg > 0, pos, 1)
        x, y = a[None, :] - q["own_a"][part, None], b[None, :] - q["own_b"][part, None]
        above = wn * y + wp * (pos - x)
        under = wn * (neg - y) + wp * x
        inside = (idx[None, :] >= q["first"][part, None]) & (idx[None, :] <= q["last"][part, None])
        value = np.where(inside, np.maximum(above, under), -1)
        best = len(idx) - 1 - np.argmax(value[:, ::-1], axis=1)
        rows = np.arange(len(best))
        score[part], at[part], below[part] = value[rows, best], idx[best], (under >= above)[rows, best]
    out = asked.select(["group", "feature", "pos", "neg"])
    for name, values in (("num", score), ("at", at), ("below", below)):
        out = out.append_column(name, pa.array(values))
    return out.filter(pa.array(score >= 0))


def unpivoted(rows: DataFrame, features: list[str], label: str, group: str) -> DataFrame:
    """(group, feature, value, y): one row per known value; rows without a group, or a label of 0 or 1, are left out."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]))
    long = rows.select(F.col(group).alias("group"), F.col(label).cast("int").alias("y"), cells.alias("c"))
    return long.where("group IS NOT NULL AND y IN (0, 1) AND c.value IS NOT NULL AND NOT isnan(c.value)").select("group", "c.feature", "c.value", "y")


def grid_of(own: DataFrame) -> DataFrame:
    """(feature, value, idx, a, b, only, before, after): places from 0, running positives and negatives. only is the group that alone has the
    value, before and after the next values on either side that another group has, too, where only is known."""
    one = F.when(F.count("*") == 1, F.min("group"))
    values = own.groupBy("feature", "value").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), one.alias("only"))
    grid = cut(running(values, ["feature"], ["value"], place=F.lit(1), a=F.col("p"), b=F.col("n")).select("feature", "value", (F.col("place") - 1).alias("idx"), "a", "b", "only"))
    last = grid.select("feature", (F.col("idx") + 1).alias("idx"), F.col("only").alias("_last"))
    alone = grid.where("only IS NOT NULL").join(last, ["feature", "idx"], "left")
    # Runs of values that one group alone has.
    runs = running(alone.withColumn("fresh", F.when(F.col("only").eqNullSafe(F.col("_last")), 0).otherwise(1)), ["feature"], ["idx"], run=F.col("fresh"))
    ends = runs.groupBy("feature", "run").agg((F.min("idx") - 1).alias("_before"), (F.max("idx") + 1).alias("_after"))
    at = lambda name: grid.select("feature", F.col("idx").alias(f"_{name}"), F.col("value").alias(name))
    ends = ends.join(at("before"), ["feature", "_before"], "left").join(at("after"), ["feature", "_after"], "left")
    known = runs.select("feature", "idx", "run").join(ends.select("feature", "run", "before", "after"), ["feature", "run"]).select("feature", "idx", "before", "after")
    return cut(grid.join(known, ["feature", "idx"], "left"))


def leave_one_out_stumps(rows: DataFrame, features: list[str], label: str, group: str, chunk: int = CHUNK, radix: int = RADIX) -> DataFrame:
    """(group, feature, threshold, direction, said, score): per group and feature the best rule on all other groups.

    direction: 'le' says yes up to the threshold, 'ge' from it on, 'constant' says `said`, the majority (yes if even), where the
    others have one value only. Thresholds lie midway between neighbouring values of the others. Of equal balanced accuracies (exact, as
    fractions) the larger threshold wins, then 'le'. A class that the others do not have does not count. Groups without others have no row.
    """
    kind = rows.schema[group].dataType.simpleString()
    own = cut(unpivoted(rows, features, label, group).groupBy("group", "feature", "value").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")))
    grid = grid_of(own)
    totals = F.broadcast(grid.groupBy("feature").agg(F.max("a").alias("all_pos"), F.max("b").alias("all_neg"), F.max("idx").alias("end")))
    folds = own.groupBy("group", "feature").agg(F.sum("pos").alias("own_pos"), F.sum("neg").alias("own_neg")).join(totals, "feature")
    # A cut has values of others on either side, so runs of the group's own values at the ends are left out.
    low_end = grid.where("only IS NOT NULL AND before IS NULL").groupBy("feature", F.col("only").alias("group")).agg((F.max("idx") + 1).alias("least"))
    high_end = grid.where("only IS NOT NULL AND after IS NULL").groupBy("feature", F.col("only").alias("group")).agg((F.min("idx") - 2).alias("most"))
    folds = folds.join(F.broadcast(low_end), ["feature", "group"], "left").join(F.broadcast(high_end), ["feature", "group"], "left")
    counts = [(F.col("all_pos") - F.col("own_pos")).alias("pos"), (F.col("all_neg") - F.col("own_neg")).alias("neg")]
    folds = cut(folds.select("group", "feature", F.coalesce("least", F.lit(0)).alias("least"), F.coalesce("most", F.col("end") - 1).alias("most"), *counts).where("pos + neg > 0"))

    placed = own.join(grid.select("feature", "value", "idx"), ["feature", "value"])
    summed = running(placed, ["group", "feature"], ["idx"], n=F.lit(1), own_a=F.col("pos"), own_b=F.col("neg")).select("group", "feature", "idx", "n", "own_a", "own_b")
    following = summed.select("group", "feature", (F.col("n") - 1).alias("n"), F.col("idx").alias("_next"))
    segments = summed.join(following, ["group", "feature", "n"], "left").select("group", "feature", F.col("idx").alias("first"), "_next", "own_a", "own_b")
    heads = following.where("n = 0").select("group", "feature", F.lit(0).cast("long").alias("first"), "_next", F.lit(0).cast("long").alias("own_a"), F.lit(0).cast("long").alias("own_b"))
    cuts = segments.unionByName(heads).join(folds, ["group", "feature"])
    ends = [F.greatest("first", "least").alias("first"), F.least(F.coalesce(F.col("_next") - 1, F.col("most")), F.col("most")).alias("last")]
    kept = cuts.select("group", "feature", *ends, "own_a", "own_b", "pos", "neg").where("first <= last")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, level, block = [], [], []
            for i, (first, last) in enumerate(zip(batch["first"].to_pylist(), batch["last"].to_pylist(), strict=True)):
                for lv, bl in cover(first, last, chunk, radix):
                    row.append(i)
                    level.append(lv)
                    block.append(bl)
            out = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(level, pa.int32()), pa.array(block, pa.int64())], names=[*batch.schema.names, "level", "block"])

    asked = kept.mapInArrow(ask, f"group {kind}, feature string, first long, last long, own_a long, own_b long, pos long, neg long, level int, block long")
    own_hull = lambda df, up: df.withColumn("block", F.floor(F.col("block") / up)).groupBy("feature", "block")
    points = grid.select("feature", F.lit(-1).alias("level"), F.floor(F.col("idx") / chunk).alias("block"), "idx", "a", "b")
    last, n = cut(own_hull(points.withColumn("level", F.lit(0)), 1).applyInArrow(_hulls, _POINT)), grid.agg(F.max("idx")).first()[0] or 0
    points, size = points.unionByName(last), chunk
    while size * radix <= n:
        last = cut(own_hull(last.withColumn("level", F.col("level") + 1), radix).applyInArrow(_hulls, _POINT))
        points, size = points.unionByName(last), size * radix
    node = ["feature", "level", "block"]
    asked = cut(asked)
    salts = cut(asked.groupBy(*node).agg(F.ceil(F.count("*") / F.lit(QUESTIONS)).cast("int").alias("salts")))
    salted = asked.join(broadcast_if_small(salts), node).withColumn("salt", F.pmod(F.xxhash64("group"), F.col("salts")).cast("int"))
    copied = points.join(broadcast_if_small(salts), node).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    found = copied.groupBy(*node, "salt").cogroup(salted.groupBy(*node, "salt")).applyInArrow(_best, f"group {kind}, feature string, pos long, neg long, num long, at long, below long")
    return _named(found, grid, folds, group)


def _named(found: DataFrame, grid: DataFrame, folds: DataFrame, group: str) -> DataFrame:
    best = found.groupBy("group", "feature", "pos", "neg").agg(F.max(F.struct("num", "at", "below")).alias("b")).select("group", "feature", "pos", "neg", "b.*")
    side = lambda name, by, away: grid.select("feature", (F.col("idx") - by).alias("at"), F.col("value").alias(name), F.col("only").alias(f"{name}_only"), F.col(away).alias(f"{name}_away"))
    both = best.join(side("low", 0, "before"), ["feature", "at"]).join(side("high", 1, "after"), ["feature", "at"])
    value = lambda name: F.when(F.col(f"{name}_only").eqNullSafe(F.col("group")), F.col(f"{name}_away")).otherwise(F.col(name))
    score = F.col("num") / F.when((F.col("pos") > 0) & (F.col("neg") > 0), 2.0 * F.col("pos") * F.col("neg")).otherwise(F.col("pos") + F.col("neg"))
    ruled = both.select("group", "feature", ((value("low") + value("high")) / 2).alias("threshold"), F.when(F.col("below") == 1, "le").otherwise("ge").alias("direction"), F.lit(None).cast("int").alias("said"), score.alias("score")).where("threshold IS NOT NULL")
    # What has no cut has one value among the others: any that is not the group's alone.
    rest = folds.join(ruled.select("group", "feature"), ["group", "feature"], "left_anti")
    shared = grid.groupBy("feature").agg(F.min(F.when(F.col("only").isNull(), F.col("value"))).alias("shared"), F.min(F.struct("only", "value")).alias("x"), F.max(F.struct("only", "value")).alias("y"))
    other = F.coalesce("shared", F.when(F.col("x.only").eqNullSafe(F.col("group")), F.col("y.value")).otherwise(F.col("x.value")))
    constant = rest.join(F.broadcast(shared), "feature").select("group", "feature", other.alias("threshold"), F.lit("constant").alias("direction"), (F.col("pos") >= F.col("neg")).cast("int").alias("said"), F.lit(None).cast("double").alias("score"))
    return ruled.unionByName(constant).withColumnRenamed("group", group)


def left_out_metrics(rows: DataFrame, stumps: DataFrame, features: list[str], label: str, group: str) -> DataFrame:
    """(feature, counts and rates) of what the rules of leave_one_out_stumps say of the rows that they were not made from."""
    cells = unpivoted(rows, features, label, group).join(stumps.withColumnRenamed(group, "group"), ["group", "feature"])
    says = F.when(F.col("direction") == "le", F.col("value") <= F.col("threshold")).when(F.col("direction") == "ge", F.col("value") >= F.col("threshold")).otherwise(F.col("said") == 1)
    return with_rates(cells.groupBy("feature").agg(*confusion(F.col("y"), says.cast("int"))))


def best_features(stumps: DataFrame, group: str) -> DataFrame:
    """Per group the rule of the feature of best score, of equals the first by name; rules that are constant come last."""
    order = F.struct(-F.coalesce("score", F.lit(-1.0)), F.col("feature"))
    return stumps.groupBy(group).agg(F.min_by(F.struct("feature", "threshold", "direction", "said", "score"), order).alias("b")).select(group, "b.*")

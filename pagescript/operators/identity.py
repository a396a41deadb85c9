"""Characters across pages: similar pairs, constrained clusters, labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors as (c + 1) / 2; null if one is missing or empty or the lengths differ; a zero vector has cosine 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    length = norm(a) * norm(b)
    c = F.when(length > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / length))).otherwise(0.0)
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), (c + 1) / 2)


def unit(v: Column) -> Column:
    """The vector over its length, in doubles; a zero vector stays."""
    wide = v.cast("array<double>")
    length = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform(wide, lambda x: x / length)).otherwise(wide)


def unit_cosine(a: Column, b: Column) -> Column:
    """cosine() of vectors that are of length 1, or 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)) + 1) / 2)


def identity_pairs(vectors: DataFrame) -> DataFrame:
    """(sequence_id, a_id, b_id, a_page, b_page, full) of pairs of characters of one sequence on different pages. Lengths are taken once per vector."""
    units = vectors.withColumn("embedding", unit(F.col("embedding")))
    a, b = units.alias("a"), units.alias("b")
    on = (F.col("a.sequence_id") == F.col("b.sequence_id")) & (F.col("a.character_id") < F.col("b.character_id")) & (F.col("a.page_index") != F.col("b.page_index"))
    return a.join(b, on).select(F.col("a.sequence_id"), F.col("a.character_id").alias("a_id"), F.col("b.character_id").alias("b_id"), F.col("a.page_index").alias("a_page"), F.col("b.page_index").alias("b_page"), unit_cosine(F.col("a.embedding"), F.col("b.embedding")).alias("full"))


def combine_similarity(pairs: DataFrame) -> DataFrame:
    """+ score, confidence, method from full, body and face: weights 1, 1.5 and 2 over those that are there."""
    weights = {"face": 2.0, "body": 1.5, "full": 1.0}
    weight = sum((F.when(F.col(k).isNotNull(), w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    value = sum((F.coalesce(F.col(k) * w, F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))
    count = sum((F.col(k).isNotNull().cast("int") for k in weights), F.lit(0))
    method = F.when(count == 0, "none").when(count > 1, "combined").when(F.col("face").isNotNull(), "face").when(F.col("body").isNotNull(), "body").otherwise("full")
    confidence = F.when(count == 0, 0.0).when(count == 1, 0.55).when(count == 2, 0.75).otherwise(0.90)
    return pairs.withColumns({"score": F.when(weight > 0, value / weight).otherwise(0.0), "confidence": confidence, "method": method})


def strongest_edge(edges: DataFrame) -> DataFrame:
    """One edge per unordered pair: the best, the first of equals by position."""
    pair = edges.withColumns({"lo": F.least("a_id", "b_id"), "hi": F.greatest("a_id", "b_id")})
    w = Window.partitionBy("sequence_id", "lo", "hi").orderBy(F.desc("score"), "position")
    return pair.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "lo", "hi")


def ambiguous_edges(edges: DataFrame, low: float = 0.45, high: float = 0.65) -> DataFrame:
    return edges.where((F.col("score") >= low) & (F.col("score") < high))


def constrained_clusters(characters: DataFrame, edges: DataFrame, high: float = 0.65) -> DataFrame:
    """(sequence_id, character_id, cluster): edges of at least high merge clusters, the best first, unless a page would be in twice.

    The order decides, so this is no connected component: the edges of a sequence, and only those that can merge, are folded in one
    place. cluster is its least character_id. A sequence has a few dozen characters.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "a_id", "b_id"], ascending=[False, True, True])
        of: dict = {}
        members: dict = {}
        for r in rows.itertuples(index=False):
            for who, page in ((r.a_id, r.a_page), (r.b_id, r.b_page)):
                if who not in of:
                    of[who], members[who] = who, {who: page}
            x, y = of[r.a_id], of[r.b_id]
            if x != y and not set(members[x].values()) & set(members[y].values()):
                keep, gone = min(x, y), max(x, y)
                for who in members[gone]:
                    of[who] = keep
                members[keep] |= members.pop(gone)
        return pd.DataFrame({"sequence_id": rows["sequence_id"].iloc[0], "character_id": list(of), "cluster": list(of.values())})

    strong = edges.where(F.col("score") >= high).select("sequence_id", "a_id", "b_id", "a_page", "b_page", "score")
    merged = strong.groupBy("sequence_id").applyInPandas(fold, "sequence_id long, character_id long, cluster long")
    return characters.select("sequence_id", "character_id").join(merged, ["sequence_id", "character_id"], "left").withColumn("cluster", F.coalesce("cluster", "character_id"))


def letters(n: Column) -> Column:
    """0 -> A, 25 -> Z, 26 -> AA, 702 -> AAA."""
    one = lambda x: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (x % 26 + 1).cast("int"), F.lit(1))
    two = F.floor(n / 26) - 1
    three = F.floor(two / 26) - 1
    return F.concat(F.when(n >= 702, one(three)).otherwise(""), F.when(n >= 26, one(two)).otherwise(""), one(n))


#: Where a character stands, as far as a table tells: page, rank of its panel, top, left, id.
PLACE = ["page_index", "panel_rank", "y1", "x1", "character_id"]


def place(characters: DataFrame) -> Column:
    return F.struct(*[c for c in PLACE if c in characters.columns])


def label_clusters(clusters: DataFrame, characters: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """(sequence_id, cluster, identity, label, state, confidence, members) in order of each cluster's first member by place.

    characters: sequence_id, character_id, page_index, and panel_rank, y1, x1 if known. Matched: on several pages; else ambiguous if an ambiguous
    edge touches it; else unmatched.
    """
    joined = clusters.join(characters.select("sequence_id", "character_id", "page_index", place(characters).alias("_place")), ["sequence_id", "character_id"])
    touched = ambiguous.select("sequence_id", F.explode(F.array("a_id", "b_id")).alias("character_id")).distinct().withColumn("_t", F.lit(1))
    groups = joined.join(touched, ["sequence_id", "character_id"], "left").groupBy("sequence_id", "cluster").agg(
        F.min("_place").alias("first"), F.countDistinct("page_index").alias("pages"), F.count("*").alias("members"), F.max("_t").alias("touched")
    )
    n = F.row_number().over(Window.partitionBy("sequence_id").orderBy("first")) - 1
    state = F.when(F.col("pages") > 1, "matched").when(F.col("touched") == 1, "ambiguous").otherwise("unmatched")
    named = groups.withColumns({"n": n, "state": state})
    return named.select("sequence_id", "cluster", F.format_string("identity-%03d", F.col("n") + 1).alias("identity"), F.concat(F.lit("Character "), letters(F.col("n"))).alias("label"), "state", F.when(F.col("state") == "matched", 0.80).when(F.col("state") == "ambiguous", 0.50).otherwise(1.0).alias("confidence"), "members")


def merge_diagnostics(clusters: DataFrame, edges: DataFrame, low: float = 0.45, high: float = 0.65) -> DataFrame:
    """(sequence_id, a_id, b_id, score, code): edges that are ambiguous, and edges of at least high whose clusters would have held a page twice.

    Clusters only grow, so a merge that was refused is one whose ends are apart in the end.
    """
    of = clusters.select("sequence_id", "character_id", "cluster")
    a, b = of.withColumnsRenamed({"character_id": "a_id", "cluster": "_a"}), of.withColumnsRenamed({"character_id": "b_id", "cluster": "_b"})
    refused = edges.where(F.col("score") >= high).join(a, ["sequence_id", "a_id"]).join(b, ["sequence_id", "b_id"]).where("_a <> _b")
    wanted = ["sequence_id", "a_id", "b_id", "score"]
    return ambiguous_edges(edges, low, high).select(*wanted, F.lit("ambiguous_edge").alias("code")).unionByName(refused.select(*wanted, F.lit("same_page_constraint_violated").alias("code")))


def fill_singletons(clusters: DataFrame, grounded: DataFrame) -> DataFrame:
    """(sequence_id, character_id, identity, label): clusters as they are, and the grounded characters that miss there as identities of one.

    clusters: sequence_id, character_id, identity, label. New ones go by place; their numbers follow the largest one, their labels are
    the first letters that the sequence has not used.
    """
    own = Window.partitionBy("sequence_id")
    missing = grounded.join(clusters.where("identity IS NOT NULL").select("sequence_id", "character_id"), ["sequence_id", "character_id"], "left_anti")
    missing = missing.groupBy("sequence_id", "character_id").agg(F.min(place(grounded)).alias("_place")).withColumn("n", F.row_number().over(own.orderBy("_place")))
    used = clusters.where("identity IS NOT NULL").select("sequence_id", "label").distinct()
    number = F.regexp_extract("identity", r"^identity-(\d+)$", 1).try_cast("int")
    last = clusters.groupBy("sequence_id").agg(F.max(number).alias("last"), F.countDistinct("label").alias("labels"))
    # Among the first used + missing letters, so many as miss are free.
    wanted = missing.groupBy("sequence_id").agg(F.count("*").alias("m")).join(last, "sequence_id", "left")
    free = wanted.select("sequence_id", F.explode(F.sequence(F.lit(0), F.col("m") + F.coalesce("labels", F.lit(0)) - 1)).alias("k")).withColumn("label", letters(F.col("k")))
    free = free.join(used, ["sequence_id", "label"], "left_anti").withColumn("n", F.row_number().over(own.orderBy("k"))).drop("k")
    new = missing.join(free, ["sequence_id", "n"]).join(last, "sequence_id", "left").select("sequence_id", "character_id", F.format_string("identity-%03d", F.coalesce("last", F.lit(0)) + F.col("n")).alias("identity"), "label")
    return clusters.where("identity IS NOT NULL").select("sequence_id", "character_id", "identity", "label").unionByName(new)

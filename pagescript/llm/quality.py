"""Quality rules: text statistics, fixed base rules, and robust multivariate outliers. Built-in expressions only.

Each document gets a vector of three transformed statistics. For each language and source a minimum-covariance-determinant
estimate is made: from two starts, medians with quartile ranges and the plain mean and covariance, concentration steps keep the share ``SUBSET`` of the
group that is nearest by Mahalanobis distance and estimate mean and covariance anew from it, until the determinant falls no more; the
start that ends lower counts. The covariance is then scaled so that the median distance is what a normal distribution has, and drawn towards
the scatter that groups have within themselves, the more the smaller the group is. The mean stays the group's own: a
language or source that is unlike all others is no outlier for that. Documents beyond ``CUTOFF`` go.

Estimates are sums and mergeable quantile sketches, so a group of any size is pre-aggregated where its rows are; only one row per
group is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, broadcast_if_small, cut, let

SYMBOLS = "#*$%&|<>"
#: Share of a group that a concentration step keeps.
SUBSET = 0.75
#: A group whose determinant falls by no more than this share in a step has settled.
SETTLED = 1e-6
#: Steps at most; a step never makes an estimate worse, so where some group still moves its last estimate counts.
MOST_STEPS = 25
#: A group's covariance counts by its documents, the scatter within all groups as much as this many.
PRIOR = 50.0
#: Median of chi-squared with three degrees of freedom.
MEDIAN = 2.366
#: Squared distance beyond which a document goes: chi-squared with three degrees of freedom exceeds it once in a thousand.
CUTOFF = 16.266
#: Standard deviations added to each statistic, for groups where it is tied. Most texts have no symbol and no repeated line, so these
#: alone set how much passes there: a symbol in every five words, one line in five that is a repeat.
FLOORS = (0.05, 0.05, 0.3)
DIMS = ("z1", "z2", "z3")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words that stand in a window of width words found twice or more in the array, first occurrences included."""

    def covered(starts: Column) -> Column:
        gaps = F.zip_with(F.slice(starts, F.lit(1), F.size(starts) - 1), F.slice(starts, F.lit(2), F.size(starts) - 1), lambda a, b: F.least(F.lit(width), b - a).cast("long"))
        return total(gaps) + width

    def twice(hashes: Column) -> Column:
        by_hash = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        pairs = let(by_hash, lambda s: F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))))
        return let(F.array_sort(F.array_distinct(F.flatten(pairs))), covered)

    hashes = let(words, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(twice(h)))
    return F.when(F.size(words) <= width, F.lit(0).cast("long")).otherwise(found)


def statistics(docs: DataFrame) -> DataFrame:
    """docs + n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of each whole text (null: no words).

    Lines are split at line feeds and count if they have a word. A column of docs with one of these names is replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.when(F.btrim(text, F.lit(WS)) == "", F.array().cast("array<string>")).otherwise(F.split(F.btrim(text, F.lit(WS)), r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(WS)) != "")
    found = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    rest = docs.drop(*[c for c in docs.columns if c.lower() in names])
    made = rest.withColumns(
        {
            "_w": found,
            "_l": of_lines,
            "word_chars": F.length(F.translate(text, WS, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        }
    )
    return made.select(*rest.columns, "_w.n_words", "word_chars", "n_symbols", "_l.n_lines", "_l.n_dup_lines", "_w.n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def vector(stats: DataFrame) -> DataFrame:
    """+ z1, z2, z3: logarithms of the mean word length, of symbols per word and of the share of repeated lines."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return stats.withColumns(
        {
            "z1": F.log((F.col("word_chars") + 1.0) / words),
            "z2": F.log1p(F.col("n_symbols") / words),
            "z3": F.log1p(10.0 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        }
    )


def determinant(floors: tuple[float, ...]) -> Column:
    a, b, c = (F.col(f"c{i}{i}") + floors[i - 1] ** 2 for i in (1, 2, 3))
    x, y, z = F.col("c12"), F.col("c13"), F.col("c23")
    return a * (b * c - z * z) - x * (x * c - z * y) + y * (x * z - b * y)


def distance(floors: tuple[float, ...] = (1e-6, 1e-6, 1e-6)) -> Column:
    """Squared Mahalanobis distance of (z1, z2, z3) from m1.. under the covariance c11.., each variance raised by its floor squared."""
    d = {i: F.col(f"z{i}") - F.col(f"m{i}") for i in (1, 2, 3)}
    a, b, c = (F.col(f"c{i}{i}") + floors[i - 1] ** 2 for i in (1, 2, 3))
    x, y, z = F.col("c12"), F.col("c13"), F.col("c23")
    form = (
        d[1] * d[1] * (b * c - z * z) + d[2] * d[2] * (a * c - y * y) + d[3] * d[3] * (a * b - x * x)
        + 2 * (d[1] * d[2] * (y * z - x * c) + d[1] * d[3] * (x * z - b * y) + d[2] * d[3] * (x * y - a * z))
    )
    return form / determinant(floors)


def moments(rows: DataFrame, groups: list[str]) -> DataFrame:
    pairs = [(i, j) for i in (1, 2, 3) for j in (1, 2, 3) if i <= j]
    return rows.groupBy(*groups).agg(*[F.avg(f"z{i}").alias(f"m{i}") for i in (1, 2, 3)], *[F.covar_pop(f"z{i}", f"z{j}").alias(f"c{i}{j}") for i, j in pairs])


_MOMENTS = ["m1", "m2", "m3", "c11", "c12", "c13", "c22", "c23", "c33"]


def starts(vectors: DataFrame, group: str) -> DataFrame:
    """(group, start, m1.., c11..): 0, medians and quartile ranges, and 1, mean and covariance, of each group."""
    quartiles = vectors.groupBy(group).agg(*[F.percentile_approx(z, [0.25, 0.5, 0.75], 2000).alias(z) for z in DIMS])
    means = {f"m{i}": F.col(z)[1] for i, z in enumerate(DIMS, 1)}
    spreads = {f"c{i}{i}": F.pow((F.col(z)[2] - F.col(z)[0]) / 1.349, F.lit(2.0)) for i, z in enumerate(DIMS, 1)}
    robust = quartiles.withColumns(means | spreads | {c: F.lit(0.0) for c in ("c12", "c13", "c23")}).select(group, F.lit(0).alias("start"), *_MOMENTS)
    return robust.unionByName(moments(vectors, [group]).select(group, F.lit(1).alias("start"), *_MOMENTS))


def mcd(vectors: DataFrame, group: str, subset: float = SUBSET, most_steps: int = MOST_STEPS) -> DataFrame:
    """Estimates per group: group + m1..m3, c11..c33, scaled to the normal distribution. group must not be null.

    A group keeps an estimate and takes part in no more steps from its start once a step doesn't lower its determinant (that of distance(), with
    the floors). Of the two ends the one of lower determinant counts, of equals the first. Groups whose subset is constant have a covariance
    of zero; the floors of distance() keep it usable.
    """
    own = [group, "start"]
    now = cut(starts(vectors, group).withColumns({"_det": F.lit(None).cast("double"), "_moved": F.lit(True)}))
    for _ in range(most_steps):
        moving = now.where("_moved")
        if moving.isEmpty():
            break
        far = vectors.join(broadcast_if_small(moving), group).select(*own, *DIMS, distance(FLOORS).alias("d2"))
        within = cut(far.groupBy(*own).agg(F.percentile_approx("d2", subset, 2000).alias("most")))
        step = moments(far.join(broadcast_if_small(within), own).where("d2 <= most"), own).withColumn("_new", determinant(FLOORS))
        step = cut(step.join(moving.select(*own, "_det"), own).where(F.col("_det").isNull() | (F.col("_new") < F.col("_det") * (1 - SETTLED))))
        taken = step.drop("_det").withColumnRenamed("_new", "_det").withColumn("_moved", F.lit(True))
        stays = now.join(step.select(*own), own, "left_anti").withColumn("_moved", F.lit(False))
        now = cut(stays.unionByName(taken))
    least = F.min(F.struct(F.coalesce("_det", F.lit(float("inf"))).alias("d"), "start", *_MOMENTS)).alias("b")
    now = cut(now.groupBy(group).agg(least).select(group, *[f"b.{c}" for c in _MOMENTS]))
    far = vectors.join(broadcast_if_small(now), group).select(group, distance().alias("d2"))
    scale = far.groupBy(group).agg((F.percentile_approx("d2", 0.5, 2000) / F.lit(MEDIAN)).alias("scale"))
    # A scale below 1 or from a degenerate group is no evidence that documents are closer together than their subset.
    factor = F.when(F.isnan("scale") | F.col("scale").isNull(), F.lit(1.0)).otherwise(F.least(F.greatest(F.col("scale"), F.lit(1.0)), F.lit(4.0)))
    return cut(now.join(scale, group).withColumn("_f", factor).select(group, "m1", "m2", "m3", *[(F.col(c) * F.col("_f")).alias(c) for c in ("c11", "c12", "c13", "c22", "c23", "c33")]))


def drawn(estimates: DataFrame, sizes: DataFrame, prior: float) -> DataFrame:
    """(own, m1.., c11..): estimates of groups with covariances drawn towards their mean by documents by n / (n + prior). sizes: (own, count), one row a group."""
    weight = F.col("count") / (F.col("count") + F.lit(prior))
    joined = cut(sizes.join(estimates.withColumnRenamed("group", "own"), "own"))
    scatter = [c for c in _MOMENTS if c.startswith("c")]
    within = joined.agg(*[(F.sum(F.col("count") * F.col(c)) / F.sum("count")).alias(c) for c in scatter]).first()
    return joined.select("own", "m1", "m2", "m3", *[(weight * F.col(c) + (1 - weight) * F.lit(within[c])).alias(c) for c in scatter])


def judge(docs: DataFrame, cutoff: float = CUTOFF, prior: float = PRIOR) -> DataFrame:
    """Per document: doc_id, lang, source, the statistics, base_failed, distance2 (null if base_failed), kept.

    Documents that fail the base rules take no part in the estimates. Null languages and sources are groups of their own, as any other
    value; a group of any size has an estimate, its covariance drawn towards the scatter within all groups as if prior documents of that were in it.
    A document that is alone in its group is at its middle. Repeated rows are separate documents. An empty table gives an empty result.
    """
    group = F.concat_ws("/", F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("null")), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")))
    stats = vector(statistics(docs.select("doc_id", "lang", "source", "text")).drop("text")).withColumn("base_failed", base_failed())
    named = cut(stats.withColumn("own", group))
    sizes = cut(named.where("NOT base_failed").groupBy("own").count())
    if sizes.isEmpty():  # no document passes the base rules
        return named.select(*stats.columns, F.lit(None).cast("double").alias("distance2"), F.lit(False).alias("kept"))
    estimates = mcd(named.where("NOT base_failed").select(F.col("own").alias("group"), *DIMS), "group")
    judged = named.join(broadcast_if_small(cut(drawn(estimates, sizes, prior))), "own", "left")
    judged = judged.withColumn("distance2", F.when(F.col("base_failed"), None).otherwise(distance(FLOORS)))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= cutoff)
    return judged.withColumn("kept", kept).select(*stats.columns, "distance2", "kept")

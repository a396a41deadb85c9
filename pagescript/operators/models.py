"""Small classifiers under grouped cross-validation: a weighted tree of depth two and a logistic regression, with class weights that balance.

Trees of all folds grow together: one table of (fold, node, feature, value) counts, running sums along the values, one best cut per node. Rows are
repeated once per fold that trains on them, which is what training on them means; nothing else grows with the folds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import cut, running
from .policy import confusion, with_rates


def tree_folds(rows: DataFrame, features: list[str], label: str, fold: str, folds: int, depth: int = 2) -> DataFrame:
    """(fold, node, feature, threshold, said): per left-out fold the tree of the rows of the others. The root is node 1, the children of k
    are 2k (values up to the threshold) and 2k + 1; a leaf has no feature. Every node says the class of more weight, no if even.

    A cut is the one of least weighted Gini impurity, midway between neighbouring values; of equals the first feature in the list, then the
    least threshold. Nodes of one class or without a cut are leaves. Rows need a label of 0 or 1, a fold from 0 to folds - 1 and all features.
    """
    cells = F.array(*[F.col(f).cast("double") for f in features])
    whole = rows.select(F.col(fold).cast("int").alias("own"), F.col(label).cast("int").alias("y"), cells.alias("x")).where("own IS NOT NULL AND y IN (0, 1) AND NOT exists(x, v -> v IS NULL OR isnan(v))")
    others = F.filter(F.lit(list(range(folds))), lambda k: k != F.col("own"))
    at = cut(whole.select(F.explode(others).alias("fold"), F.lit(1).cast("long").alias("node"), "y", "x"))
    shares = at.groupBy("fold").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
    # n / 2 n1 and n / 2 n0, times 2 n1 n0 / n: whole numbers, so impurities of either side compare exactly enough and ties are ties.
    weights = F.broadcast(cut(shares.select("fold", F.when(F.col("n0") > 0, F.col("n0")).otherwise(1).alias("w1"), F.when(F.col("n1") > 0, F.col("n1")).otherwise(1).alias("w0"))))
    nodes = None
    for level in range(depth + 1):
        sums = at.join(weights, "fold").groupBy("fold", "node").agg(F.sum(F.when(F.col("y") == 1, F.col("w1"))).alias("p"), F.sum(F.when(F.col("y") == 0, F.col("w0"))).alias("q"))
        here = cut(sums.select("fold", "node", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("q", F.lit(0)).alias("q")))
        if level == depth:
            found = here.select("fold", "node", F.lit(None).cast("int").alias("f"), F.lit(None).cast("double").alias("threshold"), (F.col("p") > F.col("q")).cast("int").alias("said"))
        else:
            found = here.join(_cuts(at, weights, here), ["fold", "node"], "left").select("fold", "node", "f", "threshold", (F.col("p") > F.col("q")).cast("int").alias("said"))
        found = cut(found)
        nodes = found if nodes is None else nodes.unionByName(found)
        # A level has 2 ** level nodes per fold.
        onward = at.join(F.broadcast(found.where("f IS NOT NULL").select("fold", "node", "f", "threshold")), ["fold", "node"])
        at = cut(onward.select("fold", (F.col("node") * 2 + F.when(F.get("x", F.col("f")) <= F.col("threshold"), 0).otherwise(1)).alias("node"), "y", "x"))
    name = F.get(F.lit(features), F.col("f"))
    return nodes.select("fold", "node", name.alias("feature"), "threshold", "said")


def _cuts(at: DataFrame, weights: DataFrame, here: DataFrame) -> DataFrame:
    """(fold, node, f, threshold): the best cut of each node that has both classes."""
    open_ = F.broadcast(here.where("p > 0 AND q > 0"))
    cells = at.select("fold", "node", "y", F.posexplode("x").alias("f", "value")).join(weights, "fold")
    values = cells.groupBy("fold", "node", "f", "value").agg(F.coalesce(F.sum(F.when(F.col("y") == 1, F.col("w1"))), F.lit(0)).alias("dp"), F.coalesce(F.sum(F.when(F.col("y") == 0, F.col("w0"))), F.lit(0)).alias("dq"))
    along = running(values, ["fold", "node", "f"], ["value"], k=F.lit(1), a=F.col("dp"), b=F.col("dq")).select("fold", "node", "f", "value", "k", "a", "b")
    following = along.select("fold", "node", "f", (F.col("k") - 1).alias("k"), F.col("value").alias("next"))
    both = along.join(following, ["fold", "node", "f", "k"]).join(open_, ["fold", "node"])
    side = lambda x, y: x * y / (x + y)  # noqa: E731  half of the weighted impurity of a side
    impurity = side(F.col("a").cast("double"), F.col("b").cast("double")) + side((F.col("p") - F.col("a")).cast("double"), (F.col("q") - F.col("b")).cast("double"))
    scale = F.col("p").cast("double") + F.col("q").cast("double")
    scored = both.select("fold", "node", "f", ((F.col("value") + F.col("next")) / 2).alias("threshold"), F.round(impurity / scale, 12).alias("impurity"))
    return scored.groupBy("fold", "node").agg(F.min(F.struct("impurity", "f", "threshold")).alias("b")).select("fold", "node", "b.f", "b.threshold")


def tree_says(rows: DataFrame, trees: DataFrame, features: list[str], fold: str, depth: int = 2) -> DataFrame:
    """rows + said: what the tree of the row's own fold, which did not see it, says; null for rows without a fold or a feature."""
    listed = F.map_from_entries(F.collect_list(F.struct("node", F.struct("feature", "threshold", "said"))))
    maps = F.broadcast(trees.groupBy(F.col("fold").alias("_fold")).agg(listed.alias("_tree")))
    values = F.map_from_arrays(F.lit(features), F.array(*[F.col(f).cast("double") for f in features]))
    node: Column = F.lit(1).cast("long")
    for _ in range(depth):
        step = F.get(F.array(F.try_element_at("_tree", node)), F.lit(0))
        node = F.when(step["feature"].isNull(), node).otherwise(node * 2 + F.when(F.try_element_at("_x", step["feature"]) <= step["threshold"], 0).otherwise(1))
    known = F.lit(True)
    for f in features:
        known = known & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    joined = rows.join(maps, F.col(fold).cast("int") == F.col("_fold"), "left").withColumn("_x", values)
    return joined.withColumn("said", F.when(known, F.try_element_at("_tree", node)["said"])).drop("_fold", "_tree", "_x")


def standard_scale(rows: DataFrame, features: list[str]) -> list[Column]:
    """The features less their mean, over their population deviation (1 where that is 0)."""
    moments = rows.agg(*[F.struct(F.avg(F.col(f).cast("double")).alias("m"), F.stddev_pop(F.col(f).cast("double")).alias("s")).alias(f) for f in features]).first()
    return [(F.col(f).cast("double") - (moments[f].m or 0.0)) / (moments[f].s or 1.0) for f in features]


def logistic(train: DataFrame, features: list[str], label: str, strength: float = 1.0):
    """(scaled feature columns, model) of a logistic regression on the standardized scale with balanced classes, None without both classes.

    strength is the inverse penalty on the sum of losses: half the squared coefficients, none on the intercept.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    n = train.agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("n1")).first()
    if not n.n or not 0 < n.n1 < n.n:
        return None
    scaled = standard_scale(train, features)
    weight = F.when(F.col(label) == 1, n.n / (2.0 * n.n1)).otherwise(n.n / (2.0 * (n.n - n.n1)))
    table = train.select(array_to_vector(F.array(*scaled)).alias("features"), F.col(label).cast("double").alias("label"), weight.alias("w"))
    return scaled, LogisticRegression(weightCol="w", regParam=1.0 / (strength * n.n), standardization=False, maxIter=500, tol=1e-10).fit(table)


def logistic_says(rows: DataFrame, features: list[str], label: str, fold: str, folds: int, strength: float = 1.0) -> DataFrame:
    """rows with a fold + probability, of the model that did not see the row; rows need label and features. A fold whose others are of one class has null."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = cut(rows.where(F.col(fold).isNotNull()))
    out = None
    for k in range(folds):
        test = rows.where(F.col(fold) == k)
        fitted = logistic(rows.where(F.col(fold) != k), features, label, strength)
        if fitted is None:
            said = test.withColumn("probability", F.lit(None).cast("double"))
        else:
            scaled, model = fitted
            made = model.transform(test.withColumn("features", array_to_vector(F.array(*scaled))))
            said = made.select(*rows.columns, vector_to_array("probability")[1].alias("probability"))
        out = said if out is None else out.unionByName(said)
    return out


def ranked_coefficients(rows: DataFrame, features: list[str], label: str, strength: float = 1.0) -> DataFrame:
    """(rank, feature, coefficient) of the logistic regression of all rows, by size from 1."""
    fitted = logistic(rows, features, label, strength)
    found = [] if fitted is None else sorted(zip(features, map(float, fitted[1].coefficients), strict=True), key=lambda x: (-abs(x[1]), x[0]))
    return rows.sparkSession.createDataFrame([(i + 1, f, c) for i, (f, c) in enumerate(found)], "rank int, feature string, coefficient double")


def compared_models(said: DataFrame, label: str, models: list[str]) -> DataFrame:
    """(model, counts and rates) of columns of 0 and 1 beside a label; null counts as no row."""
    long = said.select(F.col(label).cast("int").alias("y"), F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("int").alias("said")) for m in models])).alias("m"))
    return with_rates(long.where("m.said IS NOT NULL").groupBy(F.col("m.model").alias("model")).agg(*confusion(F.col("y"), F.col("m.said"))))

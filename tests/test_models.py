"""Rules, trees and regressions under left-out groups, against plain searches over every cut."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagescript.functions.tables import components, running
from pagescript.operators import models, policy, stumps


def plain_stump(rows):
    """rows: (value, y). (threshold, direction, said, score as a fraction)."""
    values = sorted({v for v, _ in rows})
    pos, neg = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    if len(values) == 1:
        return values[0], "constant", int(2 * pos >= len(rows)), None
    found = []
    for low, high in zip(values, values[1:], strict=False):
        for direction in ("le", "ge"):
            t = (low + high) / 2
            says = [(v <= t) if direction == "le" else (v >= t) for v, _ in rows]
            sides = [Fraction(sum(s and y for s, (_, y) in zip(says, rows, strict=True)), pos)] if pos else []
            sides += [Fraction(sum(not s and not y for s, (_, y) in zip(says, rows, strict=True)), neg)] if neg else []
            found.append((sum(sides) / len(sides), t, direction))
    score, t, direction = max(found)
    return t, direction, None, score


@pytest.mark.parametrize("seed", range(4))
def test_stumps_equal_a_search_of_every_cut(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(90):
        group = rng.choice(("hot", "hot", "a", "b", "c", f"g{i}"))
        y = int(rng.random() < 0.4)
        # Both ends and runs in between belong to one group alone; values are exact in binary.
        wide = {"hot": rng.randrange(0, 8), "a": 200 + rng.randrange(8), "b": 60 + rng.randrange(4)}.get(group, rng.randrange(100)) / 4
        rows.append((group, rng.randrange(4) / 2 + y * rng.random() // 0.8, wide, 1.0, None if rng.random() < 0.3 else float(i), y))
    rows += [(None, 1.0, 1.0, 1.0, 1.0, 1), ("a", 1.0, 1.0, 1.0, 1.0, None), ("z", 99.0, 99.0, 3.0, float("nan"), 1)]
    features = ["few", "wide", "same", "gaps"]
    table = spark.createDataFrame(rows, "group string, few double, wide double, same double, gaps double, label int").repartition(5)
    found = {(r.group, r.feature): (r.threshold, r.direction, r.said, r.score) for r in stumps.leave_one_out_stumps(table, features, "label", "group", chunk=3, radix=2).collect()}
    known = [r for r in rows if r[0] is not None and r[5] is not None]
    expected = {}
    for k, feature in enumerate(features, 1):
        cells = [(r[0], r[k], r[5]) for r in known if r[k] is not None and r[k] == r[k]]
        for group in {g for g, *_ in cells}:
            t, d, said, score = plain_stump([(v, y) for g, v, y in cells if g != group])
            expected[group, feature] = t, d, said, None if score is None else pytest.approx(float(score))
    assert found == expected


def test_stumps_of_one_class_and_of_one_group(spark):
    table = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 1), ("b", 3.0, 1), ("b", 4.0, 1)], "g string, x double, y int")
    found = {r.g: (r.threshold, r.direction, r.score) for r in stumps.leave_one_out_stumps(table, ["x"], "y", "g").collect()}
    assert found == {"a": (3.5, "le", 0.5), "b": (1.5, "le", 0.5)}
    assert stumps.leave_one_out_stumps(table.where("g = 'a'"), ["x"], "y", "g").count() == 0
    assert stumps.leave_one_out_stumps(table.where("g = 'c'"), ["x"], "y", "g").count() == 0


def test_covers_are_exact():
    for chunk, radix, n in ((1, 2, 40), (3, 2, 70), (2, 4, 90)):
        for first in range(n):
            for last in range(first, n, 5):
                seen = []
                for level, block in stumps.cover(first, last, chunk, radix):
                    size = chunk * radix ** max(level, 0)
                    seen += [i for i in range(block * size, block * size + size) if level >= 0 or first <= i <= last]
                assert sorted(seen) == list(range(first, last + 1))


def test_hulls_keep_every_best_point():
    rng = random.Random(1)
    a, b = [0], [0]
    for _ in range(60):
        a.append(a[-1] + rng.randrange(3))
        b.append(b[-1] + rng.randrange(3))
    kept = stumps.hull(a, b)
    for _ in range(300):
        x, y = rng.randrange(-9, 10), rng.randrange(-9, 10)
        assert max(x * a[i] + y * b[i] for i in kept) == max(x * p + y * q for p, q in zip(a, b, strict=True))


def plain_tree(rows, features, depth=2):
    """rows: (values, y). {node: (feature, threshold, said)}, by the weighted Gini impurity of every cut."""
    n1 = sum(y for _, y in rows)
    n0 = len(rows) - n1
    w = {1: Fraction(len(rows), 2 * n1) if n1 else 1, 0: Fraction(len(rows), 2 * n0) if n0 else 1}
    out = {}

    def grow(node, inside, left):
        p, q = sum(w[y] for _, y in inside if y), sum(w[y] for _, y in inside if not y)
        out[node] = (None, None, int(p > q))
        cuts = []
        for f in range(len(features)) if left and p and q else ():
            values = sorted({x[f] for x, _ in inside})
            for low, high in zip(values, values[1:], strict=False):
                impurity = 0
                for side in ([r for r in inside if r[0][f] <= low], [r for r in inside if r[0][f] > low]):
                    sp, sq = sum(w[y] for _, y in side if y), sum(w[y] for _, y in side if not y)
                    impurity += sp * sq / (sp + sq)
                cuts.append((impurity, f, (low + high) / 2))
        if cuts:
            _, f, t = min(cuts)
            out[node] = (features[f], t, out[node][2])
            grow(2 * node, [r for r in inside if r[0][f] <= t], left - 1)
            grow(2 * node + 1, [r for r in inside if r[0][f] > t], left - 1)

    grow(1, rows, depth)
    return out


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(12)
    rows = []
    for i in range(160):
        x = (rng.randrange(12) / 2, rng.randrange(30) / 4, float(rng.randrange(2)))
        rows.append((i, i % 3, int(x[0] + 2 * x[2] - x[1] / 2 + rng.gauss(0, 1) > 1), *x))
    return rows


@pytest.fixture(scope="module")
def labelled_table(spark, labelled):
    return spark.createDataFrame(labelled + [(900, None, 1, 1.0, 1.0, 1.0), (901, 1, 1, None, 1.0, 1.0)], "row_id long, fold int, label int, a double, b double, c double").repartition(4)


def test_trees_equal_a_plain_search(labelled, labelled_table):
    names = ["a", "b", "c"]
    found = models.tree_folds(labelled_table, names, "label", "fold", 3)
    trees = {k: {r.node: (r.feature, r.threshold, r.said) for r in found.where(F.col("fold") == k).collect()} for k in range(3)}
    expected = {k: plain_tree([(r[3:], r[2]) for r in labelled if r[1] != k], names) for k in range(3)}
    assert trees == expected
    said = {r.row_id: r.said for r in models.tree_says(labelled_table, found, names, "fold").collect()}
    for row_id, fold, _, *x in labelled:
        node, tree = 1, expected[fold]
        while tree[node][0] is not None:
            node = 2 * node + (x[names.index(tree[node][0])] > tree[node][1])
        assert said[row_id] == tree[node][2]
    assert said[900] is None and said[901] is None


def test_a_tree_of_one_class_is_a_leaf(spark):
    table = spark.createDataFrame([(0, 1, 1.0), (1, 1, 2.0), (1, 1, 3.0)], "fold int, label int, a double")
    assert {(r.fold, r.node, r.feature, r.said) for r in models.tree_folds(table, ["a"], "label", "fold", 2).collect()} == {(0, 1, None, 1), (1, 1, None, 1)}


def newton(x, y, strength):
    """Coefficients that minimise the weighted losses and half the squared coefficients over strength, by Newton's steps."""
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    design, beta = np.column_stack((np.ones(len(y)), x)), np.zeros(x.shape[1] + 1)
    ridge = np.diag([0.0] + [1 / strength] * x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-design @ beta))
        beta -= np.linalg.solve(design.T @ (design * (w * p * (1 - p))[:, None]) + ridge, design.T @ (w * (p - y)) + ridge @ beta)
    return beta


def test_logistic_regression_equals_newton(labelled, labelled_table):
    names, rows = ["a", "b", "c"], [r for r in labelled]
    whole = labelled_table.where("row_id < 900")
    said = {r.row_id: r.probability for r in models.logistic_says(whole, names, "label", "fold", 3).collect()}
    x, y, fold = np.array([r[3:] for r in rows]), np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    for k in range(3):
        train = fold != k
        mean, dev = x[train].mean(axis=0), x[train].std(axis=0)
        beta = newton((x[train] - mean) / dev, y[train], 1.0)
        expected = 1 / (1 + np.exp(-(beta[0] + (x[~train] - mean) / dev @ beta[1:])))
        assert np.allclose([said[r[0]] for r in rows if r[1] == k], expected, atol=1e-4)
    ranked = models.ranked_coefficients(whole, names, "label").collect()
    beta = newton((x - x.mean(axis=0)) / x.std(axis=0), y, 1.0)[1:]
    assert [r.feature for r in ranked] == [names[i] for i in np.argsort(-np.abs(beta))] and [r["rank"] for r in ranked] == [1, 2, 3]
    assert np.allclose([r.coefficient for r in ranked], sorted(beta, key=lambda v: -abs(v)), atol=1e-4)


def test_one_class_has_no_regression(spark):
    table = spark.createDataFrame([(i, i % 2, 1, float(i)) for i in range(6)], "row_id long, fold int, label int, a double")
    assert {r.probability for r in models.logistic_says(table, ["a"], "label", "fold", 2).collect()} == {None}
    assert models.ranked_coefficients(table, ["a"], "label").count() == 0


def test_compared_models_count_what_each_says(spark):
    table = spark.createDataFrame([(1, 1, 0), (0, 1, 0), (1, None, 0), (0, 0, 0)], "label int, m int, never int")
    found = {r.model: (r.tp, r.fp, r.tn, r.fn) for r in models.compared_models(table, "label", ["m", "never"]).collect()}
    assert found == {"m": (1, 1, 1, 0), "never": (0, 0, 2, 2)}


def test_failures_have_the_least_examples_of_each_group(spark):
    rows = [(i, "s" if i % 3 else None, int(i % 2), 0.9 if i % 4 else 0.1) for i in range(200)] + [(None, "s", 0, 0.9)]
    table = spark.createDataFrame(rows, "id long, source string, expected int, score double").repartition(7)
    found = {(r.source, r.kind): (r.n, r.examples) for r in policy.failure_breakdown(table, "score", 0.5, "id", 3).collect()}
    wrong = [(i, s, "false_accept") for i, s, e, p in rows if p >= 0.5 and not e] + [(i, s, "false_reject") for i, s, e, p in rows if p < 0.5 and e]
    expected = {}
    for key in {(s, None) for _, s, _ in wrong} | {(None, k) for *_, k in wrong}:
        for is_source in (True, False):
            if (is_source and key[1] is None) or (not is_source and key[0] is None and key[1] is not None):
                ids = [i for i, s, k in wrong if (s == key[0] if is_source else k == key[1])]
                expected[key] = len(ids), sorted(i for i in ids if i is not None)[:3]
    assert found == expected
    plan = policy.failure_breakdown(table, "score", 0.5, "id", 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_running_sums_of_groups_of_any_size(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(20)}", i, rng.randrange(9)) for i in range(3000)]
    found = running(spark.createDataFrame(rows, "k string, i long, v long").repartition(9), ["k"], ["i"], n=F.lit(1), s=F.col("v")).collect()
    sums, expected = {}, {}
    for k, i, v in sorted(rows):
        n, s = sums.get(k, (0, 0))
        sums[k] = expected[k, i] = (n + 1, s + v)
    assert {(r.k, r.i): (r.n, r.s) for r in found} == expected


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)] + [(7000, 7000)]
    random.Random(2).shuffle(edges)
    found = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}, **{2000 + i: 2000 for i in range(50)}}

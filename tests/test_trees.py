"""Boosted trees, extremely randomised trees and their Shapley values against brute force in numpy."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import forests, shap, trees
from quern.operators.forests import Forest
from quern.operators.trees import UNIT, Boosting


def planted(n=600, width=5, seed=0):
    """Three classes by two features, with some noise."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)).round(3)
    y = np.where(x[:, 1] > 0.4, 2, np.where(x[:, 3] + x[:, 0] > 0, 1, 0))
    y = np.where(rng.random(n) < 0.05, rng.integers(0, 3, n), y)
    return x, y


def frame(spark, x, y, parts=3):
    return spark.createDataFrame([(i, int(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, y long, x array<double>").repartition(parts)


def shape(t):
    return (t.feature, t.cut, t.left, t.right, np.round(t.value, 9).tolist())


def brute_boost(x, y, p, cuts, rounds):
    """One leaf at a time, every histogram from scratch."""
    k = y.max() + 1
    w = np.array([len(y) / (k * (y == c).sum()) for c in range(k)])[y]
    bins = np.stack([np.searchsorted(cuts[f], x[:, f], "right") for f in range(x.shape[1])], 1)
    scores, out = np.zeros((len(y), k)), []
    for _ in range(rounds):
        prob, made = trees.softmax(scores), []
        for c in range(k):
            g, h = (np.rint(v * w * UNIT) / UNIT for v in (prob[:, c] - (y == c), prob[:, c] * (1 - prob[:, c])))
            rows, leaves = {0: np.arange(len(y))}, trees.Tree()

            def best(mine, g=g, h=h):
                found = []
                for f in range(x.shape[1]):
                    for b in range(p.bins - 1):
                        left = bins[mine, f] <= b
                        if left.any() and not left.all():
                            hl, hr = h[mine][left].sum(), h[mine][~left].sum()
                            if hl >= p.least_hessian and hr >= p.least_hessian:
                                gl, gr = g[mine][left].sum(), g[mine][~left].sum()
                                found.append((0.5 * (gl**2 / (hl + p.l2) + gr**2 / (hr + p.l2) - (gl + gr) ** 2 / (hl + hr + p.l2)) - p.gamma, -f, -b))
                return max(found, default=(0, 0, 0))

            while len(rows) < p.leaves:
                gain, node, f, b = max((best(m)[0], -n, -best(m)[1], -best(m)[2]) for n, m in rows.items() if leaves.depth[n] < p.depth)
                if gain <= 0:
                    break
                mine = rows.pop(-node)
                left = bins[mine, f] <= b
                for child, part in zip(leaves.split(-node, f, cuts[f][b], b), (mine[left], mine[~left]), strict=True):
                    rows[child] = part
                    leaves.value[child] = -p.rate * g[part].sum() / (h[part].sum() + p.l2)
            made.append(leaves)
        for c, t in enumerate(made):
            scores[:, c] += np.array(t.value)[t.leaf_of(x)]
        out.append(made)
    return out


def test_boosted_trees_equal_brute_force(spark):
    x, y = planted()
    p = Boosting(rounds=3, leaves=5, bins=8, at_once=1, keep_every=2)
    df = frame(spark, x, y)
    cuts = trees.width_cuts(df, p.bins)
    model = trees.fit_boosted(df, p, cuts=cuts)
    want = brute_boost(x, y, p, cuts, 3)
    assert [[shape(t) for t in ts] for ts in model.trees] == [[shape(t) for t in ts] for ts in want]
    # the same trees from other partitions; predictions as brute force scores
    again = trees.fit_boosted(frame(spark, x, y, 7), p, cuts=cuts)
    assert [[shape(t) for t in ts] for ts in again.trees] == [[shape(t) for t in ts] for ts in model.trees]
    got = {r["id"]: r for r in trees.predict(model, df, ["id", "y"], scores="s").collect()}
    assert np.allclose([got[i]["s"] for i in range(len(y))], model.scores(x)) and np.mean([got[i]["y_pred"] == y[i] for i in range(len(y))]) > 0.8
    table = trees.node_table(spark, model).collect()
    assert sum(r["cover"] for r in table if r["round"] == 0 and r["class"] == 0 and r["feature"] is None) == len(y)


def test_boosting_stops_early_and_learns(spark):
    x, y = planted(900, seed=1)
    df = frame(spark, x, y)
    model = trees.fit_boosted(df, Boosting(rounds=30, leaves=6, bins=16, patience=2, rate=0.8, rows=0.8, features=0.8), F.when(F.col("id") % 3 == 0, "val").otherwise("train"))
    assert 1 <= len(model.trees) < 30 and len(model.trees) == np.argmin(model.losses) and len(model.losses) <= len(model.trees) + 3
    held = [r["y"] == r["y_pred"] for r in trees.predict(model, df.where("id % 3 = 0"), ["id", "y"]).collect()]
    assert np.mean(held) > 0.8


def test_trees_on_odd_rows(spark):
    rows = [(1, 1, [1.0, None]), (2, 2, [float("nan"), 2.0]), (3, None, [1.0, 1.0]), (4, 1, None), (5, 2, [0.0]), (6, 1, [1.5, 2.5]), (None, 2, [-1.0, 0.5]), (6, 1, [1.5, 2.5])]
    df = spark.createDataFrame(rows, "id long, y long, x array<double>")
    p = Boosting(rounds=2, least_hessian=0.0, bins=4)
    for model in (trees.fit_boosted(df, p), forests.fit_forest(df, Forest(trees=3))):
        out = trees.predict(model, df, ["id"]).collect()
        assert len(out) == 8 and sum(r["y_pred"] is None for r in out) == 2
    for few, label in ((df.where("y IS NULL"), None), (df.where("id = 1"), 1)):
        for model in (trees.fit_boosted(few, p), forests.fit_forest(few, Forest(trees=2))):
            out = trees.predict(model, df, ["id"]).collect()
            assert len(out) == 8 and {r["y_pred"] for r in out} <= {None, label}


def brute_forest(x, y, p):
    k = y.max() + 1
    w = np.array([len(y) / (k * (y == c).sum()) for c in range(k)])
    out = []
    for tree in range(p.trees):
        t, level = trees.Tree(), {0: np.arange(len(y))}
        for _ in range(p.depth):
            below = {}
            for node, mine in level.items():
                if len(mine) < p.least or len(set(y[mine])) < 2:
                    continue
                best = None
                for f in forests.candidates(p, x.shape[1], tree, node):
                    v = x[mine, f]
                    if v.min() == v.max():
                        continue
                    cut = max(v.min() + (v.max() - v.min()) * trees.uniform(p.seed, "cut", tree, node, f), np.nextafter(v.min(), np.inf))
                    sides = [np.bincount(y[mine][s], minlength=k) * w for s in (v < cut, v >= cut)]
                    pure = round(sum((s**2).sum() / s.sum() for s in sides), 9)
                    if best is None or pure > best[0]:
                        best = (pure, f, cut, v < cut)
                if best:
                    for child, part in zip(t.split(node, best[1], best[2]), (mine[best[3]], mine[~best[3]]), strict=True):
                        below[child] = part
            level = below
        out.append((t.feature, t.cut, t.left))
    return out


def test_forest_equals_brute_force(spark):
    x, y = planted(400)
    p = Forest(trees=4, depth=4)
    a, b = (forests.fit_forest(frame(spark, x, y, n), p) for n in (2, 5))
    grown = [(t.feature, t.cut, t.left) for (t,) in a.trees]
    assert grown == [(t.feature, t.cut, t.left) for (t,) in b.trees] == brute_forest(x, y, p)
    # each leaf's counts are those of the rows that come to it
    for k, (t,) in enumerate(a.trees):
        leaf = t.leaf_of(x)
        assert all(a.counts[k, n] == np.bincount(y[leaf == n], minlength=3).tolist() for n, f in enumerate(t.feature) if f < 0)
    held_x, held_y = planted(300, seed=9)
    assert np.mean(forests.fit_forest(frame(spark, x, y), Forest(trees=30, depth=8)).scores(held_x).argmax(1) == held_y) > 0.75
    assert forests.forest_table(spark, a).count() == sum(len(t.feature) for (t,) in a.trees)


def expectation(t, row, known, node=0):
    """A tree's mean over training rows where only some features of a row are known."""
    f = t.feature[node]
    if f < 0:
        return np.asarray(t.value[node], float)
    if f in known:
        return expectation(t, row, known, t.left[node] if row[f] < t.cut[node] else t.right[node])
    return sum(t.cover[c] * expectation(t, row, known, c) for c in (t.left[node], t.right[node])) / t.cover[node]


def brute_shapley(t, row, width):
    out = []
    for f in range(width):
        rest = [g for g in range(width) if g != f]
        out.append(sum(factorial(s) * factorial(width - s - 1) / factorial(width) * (expectation(t, row, {*u, f}) - expectation(t, row, set(u))) for s in range(width) for u in combinations(rest, s)))
    return out


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_shapley_values_equal_brute_force(spark, kind):
    x, y = planted(300, width=6)
    df = frame(spark, x, y)
    model = trees.fit_boosted(df, Boosting(rounds=2, leaves=8, bins=16)) if kind == "boosted" else forests.fit_forest(df, Forest(trees=3, depth=5))
    phi = shap.values(model, x[:12])
    for i in range(12):
        want = np.zeros((3, 6))
        for ts in model.trees:
            for k, t in enumerate(ts):
                own = np.array(brute_shapley(t, x[i], 6))
                want += np.array([own[:, c] / len(model.trees) for c in range(3)]) if kind == "forest" else np.eye(3)[:, [k]] * own.reshape(1, 6)
        assert np.allclose(phi[i], want)
    rows = shap.explain(model, df, "id").collect()
    got = np.zeros((300, 3, 6))
    for r in rows:
        got[r["id"], r["class"]] = r["phi"]
    assert np.allclose(got.sum(2) + shap.base(model), model.scores(x))
    top = shap.importance(shap.explain(model, df, "id")).groupBy("feature").agg(F.sum("mean_abs").alias("s")).orderBy(F.desc("s")).first()
    assert top["feature"] == 1

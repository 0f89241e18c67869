"""Adaptive search: proposals, halving, and its model against a plain loop."""

import numpy as np
from pyspark.sql import functions as F

from quern.operators import search as S


def bowl(t):
    return -((t["a"] - 0.73) ** 2) - (np.log10(t["b"]) - 1.2) ** 2 - (0 if t["c"] == "x" else 0.5)


SPACE = {"a": S.Real(0.0, 1.0), "b": S.Real(0.01, 1000.0, log=True), "c": S.Choice(("x", "y", "z"))}


def test_a_planted_optimum_is_found_in_fewer_trials_than_by_a_grid():
    seen = []

    def score(trials, rung):
        seen.extend([rung] * len(trials))
        return [bowl(t) for t in trials]

    runs = [S.search(SPACE, score, rounds=12, batch=8, seed=s) for s in range(5)]
    assert len(runs[0]) == 96 and sum(r for _, r, _ in runs[0]) == 48
    best = [max(s for _, _, s in r) for r in runs]
    a, b = np.meshgrid(np.linspace(0, 1, 7), np.linspace(-2, 3, 7))
    grid = max(bowl({"a": x, "b": 10**y, "c": c}) for x, y in zip(a.ravel(), b.ravel(), strict=True) for c in "xyz")  # 147 trials
    assert np.median(best) > grid
    random = [max(bowl(S.proposed(SPACE, [], rng)) for _ in range(96)) for rng in map(np.random.default_rng, range(5))]
    assert np.median(best) > np.median(random)
    assert S.search(SPACE, score, 4, 6, seed=7) == S.search(SPACE, score, 4, 6, seed=7)


def test_trials_are_scored_together_as_one_by_one(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 400)
    x = rng.normal(size=(400, 4)) * [1, 5, 1, 1] + np.eye(3, 4)[y] * 1.5
    rows = [(i, int(a), [float(v) for v in b]) for i, (a, b) in enumerate(zip(y, x, strict=True))]
    df = spark.createDataFrame([*rows, (900, None, [1.0] * 4), (901, 1, None), (902, 9, [0.0] * 4)], "id long, y long, x array<double>").repartition(3)
    role = F.when(F.col("id") % 4 == 0, "val").when(F.col("id") % 4 == 1, "test").otherwise("train")
    model = S.fit_centroids(df.where(role == "train"))
    mine = np.arange(400) % 4 >= 2
    assert np.allclose(model.means[:3], [x[mine & (y == k)].mean(0) for k in range(3)])
    trials = [{"shrink": a, "scale": b, "prior": c} for a, b, c in ((0.0, 0.0, 0.01), (0.5, 1.0, 1.0), (0.9, 1.5, 9.0))]
    got = S.accuracies(model, df.where(role == "val"), trials)
    val = np.arange(400) % 4 == 0
    for t, own in zip(trials, got, strict=True):
        label = []
        for row in x[val]:
            c = model.means * (1 - t["shrink"]) + model.centre * t["shrink"]
            d = [sum((row[f] - m[f]) ** 2 / model.spread[f] ** (2 * t["scale"]) for f in range(4)) - 2 * t["prior"] * np.log(p) for m, p in zip(c, model.shares, strict=True)]
            label.append(int(np.argmin(d)))
        assert np.isclose(own, np.mean([np.mean(np.array(label)[y[val] == k] == k) for k in range(3)]))
    out = S.searched_centroids(df, role, rounds=3, batch=4).collect()
    assert len(out) == 12 and sum(r["test"] is not None for r in out) == 1
    chosen = next(r for r in out if r["test"] is not None)
    assert chosen["rung"] == 1 and chosen["val"] == max(r["val"] for r in out if r["rung"] == 1)
    assert [tuple(r) for r in S.searched_centroids(df.repartition(5), role, rounds=3, batch=4).collect()] == [tuple(r) for r in out]

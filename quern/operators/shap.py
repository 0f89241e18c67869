"""Path-dependent Shapley values of tree models, from their node tables.

For each leaf, the features on its way either agree with a row or don't; a feature that is left out passes the
share of training rows that went that way. The sum over all subsets of features is a product of polynomials,
one factor a feature: it is extended by each feature of the way and unwound by one at a time, for all rows
of a batch at once. A leaf with d features costs d^2 steps a row, a tree as many leaves.

Values of a row add up to its score less the model's mean score over the training rows (``base``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.trees import Tree, matrix


def ways(t: Tree) -> Iterator[tuple[int, dict[int, tuple[float, float, float]]]]:
    """Each leaf and its way: feature → (least value, first value too large, share of rows that pass)."""
    stack = [(0, {})]
    while stack:
        node, way = stack.pop()
        f = t.feature[node]
        if f < 0:
            yield node, way
            continue
        lo, hi, share = way.get(f, (-np.inf, np.inf, 1.0))
        for child, low, high in ((t.left[node], lo, min(hi, t.cut[node])), (t.right[node], max(lo, t.cut[node]), hi)):
            stack.append((child, {**way, f: (low, high, share * (t.cover[child] / t.cover[node] if t.cover[node] else 0.0))}))


def extended(c: np.ndarray, one: np.ndarray, zero: float) -> np.ndarray:
    """Coefficients by number of features that are in, with one more feature: times (zero + one * t)."""
    out = np.zeros((c.shape[0], c.shape[1] + 1))
    out[:, :-1] = c * zero
    out[:, 1:] += c * one[:, None]
    return out


def unwound(c: np.ndarray, one: np.ndarray, zero: float) -> np.ndarray:
    """The coefficients without a feature: divided by (zero + one * t), from the top where it is in, from the bottom else."""
    d = c.shape[1] - 1
    top, bottom = np.zeros((len(c), d)), np.zeros((len(c), d))
    carry = np.zeros(len(c))
    for i in range(d - 1, -1, -1):
        carry = c[:, i + 1] - zero * carry
        top[:, i] = carry
    if zero:
        bottom[:] = c[:, :d] / zero
    return np.where(one[:, None] > 0, top, bottom)


def weights(d: int) -> np.ndarray:
    """s! (d - s - 1)! / d! of each number of features s in, of d."""
    out = np.empty(d)
    out[0] = 1.0 / d
    for s in range(1, d):
        out[s] = out[s - 1] * s / (d - s)
    return out


def tree_values(t: Tree, x: np.ndarray, width: int, n_out: int) -> np.ndarray:
    """(row, output, feature) values of one tree."""
    phi = np.zeros((len(x), n_out, width))
    for leaf, way in ways(t):
        value = np.atleast_1d(np.asarray(t.value[leaf], float))
        d = len(way)
        if not d:
            continue
        ones = {f: ((x[:, f] >= lo) & (x[:, f] < hi)).astype(float) for f, (lo, hi, _) in way.items()}
        c = np.ones((len(x), 1))
        for f, (_, _, zero) in way.items():
            c = extended(c, ones[f], zero)
        w = weights(d)
        for f, (_, _, zero) in way.items():
            part = (unwound(c, ones[f], zero) @ w) * (ones[f] - zero)
            phi[:, :, f] += part[:, None] * value
    return phi


def base(model) -> list[float]:
    """The model's mean score over its training rows, by class."""
    out = np.zeros(len(model.classes))
    for trees in model.trees:
        for k, t in enumerate(trees):
            mean = sum(np.prod([share for *_, share in way.values()]) * np.asarray(t.value[leaf], float) for leaf, way in ways(t))
            if len(trees) == 1:
                out += mean / len(model.trees)
            else:
                out[k] += mean
    return out.tolist()


def values(model, x: np.ndarray) -> np.ndarray:
    """(row, class, feature) Shapley values: sums over a boosted model's trees, means over a forest's."""
    phi = np.zeros((len(x), len(model.classes), model.width))
    for trees in model.trees:
        for k, t in enumerate(trees):
            if len(trees) == 1:
                phi += tree_values(t, x, model.width, len(model.classes)) / len(model.trees)
            else:
                phi[:, k : k + 1] += tree_values(t, x, model.width, 1)
    return phi


#: Rows that a task explains at once.
AT_ONCE = 512


def explain(model, df: DataFrame, key: str) -> DataFrame:
    """key, class (its number), phi (a value a feature), for each row whose vector has the model's length."""
    rows = df.where(F.size("x") == model.width).select(key, F.col("x").cast("array<double>").alias("x"))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), AT_ONCE):
                b = whole.slice(at, AT_ONCE)
                phi = values(model, matrix(b.column("x"), model.width))
                n, k, f = phi.shape
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, n * k * f + 1, f, dtype=np.int32)), pa.array(phi.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.arange(k, dtype=np.int32), n)), flat], names=[key, "class", "phi"])

    return rows.mapInArrow(run, f"`{key}` {kind}, class int, phi array<double>")


def importance(explained: DataFrame) -> DataFrame:
    """feature, class, mean_abs, mean over rows of the values' size."""
    each = explained.select("class", F.posexplode("phi").alias("feature", "v"))
    return each.groupBy("feature", "class").agg(F.avg(F.abs("v")).alias("mean_abs"), F.avg("v").alias("mean"))

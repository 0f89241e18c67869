"""Extremely randomised trees: a random cut for each (tree, node, feature), all trees of a level in two passes.

The first pass finds the least and the largest value of each open node's candidate features, which fix the cuts
(a place between them by a hash of seed, tree, node and feature); the second counts the classes on either side of
each. Counts are whole numbers, so the same seed gives the same forest however the rows are partitioned. The
driver holds the nodes: ``trees * 2^depth`` at most; a task's tables have a row for each open node and candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.trees import Tree, matrix, uniform, usable, width_of
from quern.sources.scratch import Temporary, save


@dataclass
class Forest:
    """Parameters. ``candidates``: features tried at a node, the root of their number by default."""

    trees: int = 20
    depth: int = 6
    least: int = 2
    candidates: int | None = None
    balanced: bool = True
    seed: int = 42


@dataclass
class Grown:
    """A forest: each leaf's value is its (weighted) share of each class; ``counts`` its training rows by class."""

    classes: list
    width: int
    trees: list[list[Tree]]
    counts: dict[tuple[int, int], list[int]]

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.classes)))
        for (t,) in self.trees:
            values = np.array([v if f < 0 else [0.0] * len(self.classes) for v, f in zip(t.value, t.feature, strict=True)])
            out += values[t.leaf_of(x)]
        return out / max(1, len(self.trees))


def candidates(p: Forest, width: int, tree: int, node: int) -> list[int]:
    m = p.candidates or max(1, round(width**0.5))
    return sorted(range(width), key=lambda f: (uniform(p.seed, "feature", tree, node, f), f))[:m]


def _placed(trees: list[Tree], open_: dict[int, dict[int, int]], tree: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a tree's open nodes, and the nodes' slots."""
    slots = np.full(len(trees[tree].feature), -1)
    nodes = open_[tree]
    slots[list(nodes)] = list(nodes.values())
    slot = slots[trees[tree].leaf_of(x)]
    (rows,) = np.nonzero(slot >= 0)
    return rows, slot[rows]


def _ranges(trees: list[Tree], open_: dict[int, dict[int, int]], tried: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = np.full(tried.shape, np.inf), np.full(tried.shape, -np.inf)
        for b in batches:
            x = matrix(b.column("x"), width)
            for k in open_ if len(x) else ():
                rows, slot = _placed(trees, open_, k, x)
                values = x[rows[:, None], tried[slot]]
                np.maximum.at(hi, slot, values)
                np.minimum.at(lo, slot, np.where(np.isfinite(values), values, np.inf))
        slot, j = np.nonzero(np.isfinite(lo))
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(j.astype(np.int32)), pa.array(lo[slot, j]), pa.array(hi[slot, j])], names=["slot", "j", "lo", "hi"])

    return run


def _sides(trees: list[Tree], open_: dict[int, dict[int, int]], tried: np.ndarray, cuts: np.ndarray, width: int, n_classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = tried.shape[1]
        counts = np.zeros(len(tried) * m * 2 * n_classes, np.int64)
        for b in batches:
            x, y = matrix(b.column("x"), width), b.column("y").to_numpy()
            for k in open_ if len(x) else ():
                rows, slot = _placed(trees, open_, k, x)
                right = ~(x[rows[:, None], tried[slot]] < cuts[slot])
                place = ((slot[:, None] * m + np.arange(m)) * 2 + right) * n_classes + y[rows, None]
                counts += np.bincount(place.ravel(), minlength=len(counts))
        counts = counts.reshape(len(tried), m, 2, n_classes)
        slot, j, k = np.nonzero(counts.sum(2))
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(j.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(counts[slot, j, 0, k]), pa.array(counts[slot, j, 1, k])], names=["slot", "j", "k", "l", "r"])

    return run


def _best_cuts(parts: DataFrame, weights: list[float]) -> DataFrame:
    """slot, j, and class counts on either side of the cut with the purest sides by Gini's measure (ties to the first candidate)."""
    sums = parts.groupBy("slot", "j", "k").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), F.col("k") + 1)
    part = lambda c: F.try_divide(F.sum(w * F.col(c) * w * F.col(c)), F.sum(w * F.col(c)))
    each = F.collect_list(F.struct("k", "l", "r")).alias("counts")
    d = sums.groupBy("slot", "j").agg(F.sum("l").alias("n_l"), F.sum("r").alias("n_r"), F.round(part("l") + part("r"), 9).alias("pure"), each)
    return d.where("n_l > 0 AND n_r > 0").groupBy("slot").agg(F.max(F.struct("pure", (-F.col("j")).alias("j"), "counts")).alias("b")).select("slot", (-F.col("b.j")).alias("j"), "b.counts")


def fit_forest(data: DataFrame, p: Forest) -> Grown:
    """A node is split while it has ``least`` rows, more than one class and a candidate that isn't constant, down to ``depth``. Null and NaN components are below every cut."""
    width = width_of(data)
    train = usable(data, width)
    counts = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    classes = sorted(counts)
    n = sum(counts.values())
    weights = [n / (len(classes) * counts[c]) if p.balanced else 1.0 for c in classes]
    trees = [Tree() for _ in range(p.trees)]
    known = {(k, 0): [counts[c] for c in classes] for k in range(p.trees)}
    with Temporary():
        number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("y")).cast("int") - 1 if classes else F.lit(0)
        rows = save(train.select(number.alias("y"), F.col("x").cast("array<double>").alias("x")), "forest")
        for level in range(p.depth):
            flat = [(k, i) for k, t in enumerate(trees) for i, f in enumerate(t.feature) if f < 0 and t.depth[i] == level and _goes_on(known[k, i], p)]
            if not flat:
                break
            open_: dict[int, dict[int, int]] = {}
            for slot, (k, i) in enumerate(flat):
                open_.setdefault(k, {})[i] = slot
            tried = np.array([candidates(p, width, k, i) for k, i in flat])
            cuts = np.full(tried.shape, -np.inf)  # a candidate without a range sends all rows right
            ends = rows.mapInArrow(_ranges(trees, open_, tried, width), "slot bigint, j int, lo double, hi double").groupBy("slot", "j").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            for r in ends.where("lo < hi").collect():
                k, i = flat[r["slot"]]
                at = uniform(p.seed, "cut", k, i, int(tried[r["slot"], r["j"]]))
                # above the least value, so that neither side is empty
                cuts[r["slot"], r["j"]] = max(r["lo"] + (r["hi"] - r["lo"]) * at, np.nextafter(r["lo"], np.inf))
            parts = rows.mapInArrow(_sides(trees, open_, tried, cuts, width, len(classes)), "slot bigint, j int, k int, l bigint, r bigint")
            for r in sorted(_best_cuts(parts, weights).collect()):
                k, i = flat[r["slot"]]
                pair = trees[k].split(i, int(tried[r["slot"], r["j"]]), float(cuts[r["slot"], r["j"]]))
                for child, side in zip(pair, ("l", "r"), strict=True):
                    own = {c["k"]: c[side] for c in r["counts"]}
                    known[k, child] = [own.get(c, 0) for c in range(len(classes))]
    for k, t in enumerate(trees):
        for i in range(len(t.feature)):
            mass = [c * w for c, w in zip(known[k, i], weights, strict=True)]
            t.value[i], t.cover[i] = [m / max(sum(mass), 1e-300) for m in mass], float(sum(known[k, i]))
    return Grown(classes, width, [[t] for t in trees], known)


def _goes_on(counts: list[int], p: Forest) -> bool:
    return sum(counts) >= p.least and sum(c > 0 for c in counts) > 1


def forest_table(spark, grown: Grown) -> DataFrame:
    """tree, node, feature (null: a leaf), cut, left, right, counts of every node."""
    rows = []
    for k, (t,) in enumerate(grown.trees):
        for i, f in enumerate(t.feature):
            inner = f >= 0
            rows.append((k, i, f if inner else None, t.cut[i] if inner else None, t.left[i] if inner else None, t.right[i] if inner else None, grown.counts[k, i]))
    return spark.createDataFrame(rows, "tree int, node int, feature int, cut double, left int, right int, counts array<bigint>")

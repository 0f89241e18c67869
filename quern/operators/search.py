"""Adaptive search: tree-structured Parzen proposals, trials scored together as rows, successive halving.

A round proposes a batch of trials. Those scored so far are cut into good ones and the rest; a parameter's values
are drawn from the density of the good ones, and the draw with the highest ratio of good to other density is
tried. Each batch is scored in one pass over a share of the validation rows, its better half in another over all of
them; only scores on all rows teach the proposals. Test rows have no say: they are scored for the chosen trial alone.

The model is the nearest centroid in scaled components (see ``Centroids``): its fit is one aggregate of sums, and a
pass judges every row by all trials of a batch. What goes out to the tasks is ``trials * classes * width`` numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.trees import matrix, usable, width_of


@dataclass(frozen=True)
class Real:
    """A number in [lo, hi], on a logarithmic scale where ``log``."""

    lo: float
    hi: float
    log: bool = False

    def inward(self, v: float) -> float:
        return (math.log(v / self.lo) / math.log(self.hi / self.lo)) if self.log else (v - self.lo) / (self.hi - self.lo)

    def outward(self, u: float) -> float:
        return self.lo * (self.hi / self.lo) ** u if self.log else self.lo + (self.hi - self.lo) * u

    def density(self, seen: list, u: np.ndarray) -> np.ndarray:
        """A uniform part and a bell around each value seen, wide where few are."""
        at, width = np.array([self.inward(v) for v in seen]), max(0.05, 1.0 / (1 + len(seen)))
        bells = np.exp(-0.5 * ((u[:, None] - at) / width) ** 2) / (width * math.sqrt(2 * math.pi))
        return (1.0 + bells.sum(1)) / (1 + len(seen))

    def draw(self, seen: list, rng: np.random.Generator, n: int) -> np.ndarray:
        centre = rng.integers(0, len(seen) + 1, n)
        at = np.array([*[self.inward(v) for v in seen], 0.0])[centre]
        u = np.where(centre == len(seen), rng.random(n), at + rng.normal(0, max(0.05, 1.0 / (1 + len(seen))), n))
        return np.clip(u, 0, 1)


@dataclass(frozen=True)
class Choice:
    """One of some values; a whole number of steps is a choice, too."""

    values: tuple

    def outward(self, u: float):
        return self.values[int(u)]

    def density(self, seen: list, u: np.ndarray) -> np.ndarray:
        counts = np.array([1.0 + sum(v == s for s in seen) for v in self.values])
        return (counts / counts.sum())[u.astype(int)]

    def draw(self, seen: list, rng: np.random.Generator, n: int) -> np.ndarray:
        counts = np.array([1.0 + sum(v == s for s in seen) for v in self.values])
        return rng.choice(len(self.values), n, p=counts / counts.sum()).astype(float)


Space = dict[str, Real | Choice]


def proposed(space: Space, known: list[tuple[dict, float]], rng: np.random.Generator, start: int = 8, draws: int = 24) -> dict:
    """A trial: at random while fewer than ``start`` are known, from the better quarter's densities then."""
    order = sorted(known, key=lambda x: -x[1])
    good = [t for t, _ in order[: max(1, math.ceil(len(order) / 4))]] if len(known) >= start else []
    rest = [t for t, _ in order[len(good) :]] if good else []
    out = {}
    for name, p in space.items():
        a, b = [t[name] for t in good], [t[name] for t in rest]
        u = p.draw(a, rng, draws if good else 1)
        out[name] = p.outward(u[np.argmax(p.density(a, u) / p.density(b, u))] if good else u[0])
    return out


def search(space: Space, score: Callable[[list[dict], int], list[float]], rounds: int, batch: int, seed: int, start: int = 8) -> list[tuple[dict, int, float]]:
    """(trial, rung, score) of all trials; rung 1 was scored on all rows, rung 0 on a share only. ``score``: (trials, rung) → scores."""
    rng, known, out = np.random.default_rng(seed), [], []
    for _ in range(rounds):
        trials = [proposed(space, known, rng, start) for _ in range(batch)]
        first = score(trials, 0)
        order = sorted(range(batch), key=lambda i: (-first[i], i))
        ahead = order[: -(-batch // 2)]
        second = score([trials[i] for i in ahead], 1)
        known += [(trials[i], s) for i, s in zip(ahead, second, strict=True)]
        out += [(trials[i], 1, s) for i, s in zip(ahead, second, strict=True)] + [(trials[i], 0, first[i]) for i in order[len(ahead) :]]
    return out


@dataclass
class Centroids:
    """Class means, spreads and shares of the training rows. A trial shrinks the means towards the mean of all (``shrink``),
    weighs components by their spread (``scale``: 0 not at all, 1 to unit variance) and adds a bonus for frequent classes (``prior``)."""

    classes: list
    means: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    shares: np.ndarray

    def labels(self, trial: dict, x: np.ndarray) -> np.ndarray:
        """The number of each row's class, ties to the first."""
        c = self.means * (1 - trial["shrink"]) + self.centre * trial["shrink"]
        w = 1.0 / self.spread ** (2 * trial["scale"])
        near = np.stack([((x - m) ** 2 * w).sum(1) for m in c], 1)
        return (near - 2 * trial["prior"] * np.log(self.shares)).argmin(1)


def fit_centroids(train: DataFrame) -> Centroids:
    """One pass: sums of each class and component. Null components count as 0."""
    width = width_of(train)
    v = F.coalesce(F.nanvl(F.col("v").cast("double"), F.lit(0.0)), F.lit(0.0))
    parts = usable(train, width).select("y", F.posexplode("x").alias("f", "v")).select("y", "f", v.alias("v"))
    rows = parts.groupBy("y", "f").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.count("*").alias("n")).collect()
    classes = sorted({r["y"] for r in rows})
    s, q, n = (np.zeros((len(classes), width)) for _ in range(3))
    for r in rows:
        for to, c in ((s, "s"), (q, "q"), (n, "n")):
            to[classes.index(r["y"]), r["f"]] = r[c]
    centre = s.sum(0) / n.sum(0)
    spread = np.sqrt(np.maximum(q.sum(0) / n.sum(0) - centre**2, 1e-12))
    return Centroids(classes, s / n, centre, spread, n[:, 0] / n[:, 0].sum())


def accuracies(model: Centroids, rows: DataFrame, trials: list[dict]) -> list[float]:
    """Balanced accuracy of each trial over ``rows``: one pass for all. A class without rows doesn't count; no rows give 0."""
    width, k = model.means.shape[1], len(model.classes)
    number = F.array_position(F.array(*[F.lit(c) for c in model.classes]), F.col("y")).cast("int") - 1
    d = usable(rows, width).where(F.col("y").isin(model.classes)).select(number.alias("y"), F.col("x").cast("array<double>").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, n = np.zeros((len(trials), k), np.int64), np.zeros(k, np.int64)
        for b in batches:
            x, y = matrix(b.column("x"), width), b.column("y").to_numpy()
            x = np.where(np.isfinite(x), x, 0.0)
            n += np.bincount(y, minlength=k)
            for i, t in enumerate(trials):
                hits[i] += np.bincount(y[model.labels(t, x) == y], minlength=k)
        trial, c = (a.ravel() for a in np.indices(hits.shape))
        yield pa.RecordBatch.from_arrays([pa.array(trial), pa.array(c), pa.array(hits.ravel()), pa.array(np.tile(n, len(trials)))], names=["trial", "c", "hits", "n"])

    found = d.mapInArrow(run, "trial bigint, c bigint, hits bigint, n bigint").groupBy("trial", "c").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    got = found.where("n > 0").groupBy("trial").agg(F.avg(F.col("hits") / F.col("n")).alias("a")).collect()
    by = {r["trial"]: r["a"] for r in got}
    return [by.get(i, 0.0) for i in range(len(trials))]


SPACE: Space = {"shrink": Real(0.0, 1.0), "scale": Real(0.0, 1.5), "prior": Real(0.01, 10.0, log=True)}


def searched_centroids(data: DataFrame, role: Column, rounds: int = 6, batch: int = 8, seed: int = 42, share: int = 4) -> DataFrame:
    """trial, rung, its parameters, val, test (of the chosen trial only): ``role`` is train, val or test; rung 0 sees one in ``share`` val rows."""
    train, val, test = (data.where(role == r) for r in ("train", "val", "test"))
    model = fit_centroids(train)
    few = val.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0)
    done = search(SPACE, lambda trials, rung: accuracies(model, val if rung else few, trials), rounds, batch, seed)
    best = max((i for i, x in enumerate(done) if x[1]), key=lambda i: (done[i][2], -i))
    (final,) = accuracies(model, test, [done[best][0]])
    rows = [(i, rung, *[float(t[n]) for n in SPACE], float(s), float(final) if i == best else None) for i, (t, rung, s) in enumerate(done)]
    return data.sparkSession.createDataFrame(rows, f"trial int, rung int, {', '.join(f'{n} double' for n in SPACE)}, val double, test double")

"""Decision trees as node tables: feature bins, histograms of (tree node, feature, bin), boosted trees of several classes.

Rows are (id, y, x array<double>). A row's features are binned once and kept as one byte each. What a pass over
the rows gathers is sums of whole numbers (gradients are rounded to 2^-24), so a model depends neither on the
number of partitions nor on the order of rows, and a retried task changes nothing. A task sums its rows into one
table of (tree, node, feature, bin), whose size follows from the parameters; one ``groupBy`` adds them up,
and a window over the bins finds each node's best split. Only a row for each open leaf comes to the driver,
which holds the trees: ``rounds * classes * leaves`` nodes.

Null labels and null or short vectors take no part in a fit; a null or NaN component is below every cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.sources.scratch import Temporary, save

#: Gradients are whole multiples of 1 / UNIT.
UNIT = 1 << 24
#: Values of a node's number, in the key of (class, node).
NODES = 1 << 20


def uniform(*key) -> float:
    """A number in [0, 1) of a key: 60 bits of a digest, so that other engines can follow."""
    return int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:15], 16) / 2**60


@dataclass
class Tree:
    """Nodes by number, the root first; a row goes left where its feature is below the cut. Leaves have feature -1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[float] = field(default_factory=lambda: [0.0])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list = field(default_factory=lambda: [0.0])
    cover: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, cut: float, at_bin: int = 0) -> tuple[int, int]:
        left = len(self.feature)
        for _ in range(2):
            for name, x in (("feature", -1), ("cut", 0.0), ("bin", 0), ("left", 0), ("right", 0), ("value", 0.0), ("cover", 0.0), ("depth", self.depth[node] + 1)):
                getattr(self, name).append(x)
        self.feature[node], self.cut[node], self.bin[node], self.left[node], self.right[node] = feature, cut, at_bin, left, left + 1
        return left, left + 1

    def leaf_of(self, x: np.ndarray, binned: bool = False) -> np.ndarray:
        """The leaf of each row; ``binned``: rows hold bins in place of values."""
        feature, left, right = np.array(self.feature), np.array(self.left), np.array(self.right)
        below = np.array(self.bin) + 1 if binned else np.array(self.cut)
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(max(self.depth)):
            f = feature[node]
            node = np.where(f < 0, node, np.where(x[rows, f] < below[node], left[node], right[node]))
        return node


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of arrays of ``width`` numbers; null and NaN are below everything."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return np.where(np.isnan(x), -np.inf, x)


def packed(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """Rows of a binary column as numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def usable(data: DataFrame, width: int) -> DataFrame:
    return data.where(F.col("y").isNotNull() & (F.size("x") == width))


def width_of(data: DataFrame) -> int:
    return data.agg(F.max(F.size("x"))).first()[0] or 0


def quantile_cuts(data: DataFrame, bins: int) -> dict[int, list[float]]:
    """Of each feature up to ``bins`` - 1 values that cut its rows into equal parts, from a quantile sketch of all rows."""
    at = [i / bins for i in range(1, bins)]
    rows = data.select(F.posexplode("x").alias("f", "v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    return {r["f"]: sorted(set(r["c"])) for r in rows.groupBy("f").agg(F.percentile_approx("v", at, 10_000).alias("c")).collect()}


def width_cuts(data: DataFrame, bins: int) -> dict[int, list[float]]:
    """Of each feature ``bins`` - 1 cuts at equal steps between its least and its largest value."""
    rows = data.select(F.posexplode("x").alias("f", "v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    ends = rows.groupBy("f").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    return {r["f"]: [r["lo"] + (r["hi"] - r["lo"]) * i / bins for i in range(1, bins)] for r in ends}


def binned(data: DataFrame, cuts: dict[int, list[float]], width: int, classes: list, role: Column | None = None) -> DataFrame:
    """key (a hash of id), y (the class's number), val, bins (a byte a feature), scores (none yet)."""
    edges = [np.array(cuts.get(f, [])) for f in range(width)]
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("y")).cast("int") - 1
    rows = usable(data, width).select(F.xxhash64("id").alias("key"), number.alias("y"), (F.lit(False) if role is None else role == "val").alias("val"), F.col("x").cast("array<double>").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("x"), width)
            out = np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)], 1).astype(np.uint8) if len(x) else x
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([r.tobytes() for r in out], pa.binary()), pa.array([b""] * len(x), pa.binary())], names=["key", "y", "val", "bins", "scores"])

    return rows.mapInArrow(run, "key bigint, y int, val boolean, bins binary, scores binary")


@dataclass
class Boosting:
    """Parameters of a fit. ``at_once``: leaves of a tree that are split after one pass, best first; 1 is leaf by leaf."""

    rounds: int = 20
    leaves: int = 8
    depth: int = 6
    rate: float = 0.3
    at_once: int = 4
    bins: int = 32
    l2: float = 1.0
    gamma: float = 0.0
    least_hessian: float = 1.0
    rows: float = 1.0
    features: float = 1.0
    patience: int = 5
    balanced: bool = True
    seed: int = 42
    keep_every: int = 8


@dataclass
class Boosted:
    """Trees of each round and class; ``losses``: of the validation rows before each round, where there are any."""

    classes: list
    width: int
    trees: list[list[Tree]]
    losses: list[float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.classes)))
        for trees in self.trees:
            for k, t in enumerate(trees):
                out[:, k] += np.array(t.value)[t.leaf_of(x)]
        return out


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _added(scores: np.ndarray, pending: list[list[Tree]], bins: np.ndarray) -> np.ndarray:
    for trees in pending:
        for k, t in enumerate(trees):
            scores[:, k] += np.array(t.value)[t.leaf_of(bins, binned=True)]
    return scores


def _start(b: pa.RecordBatch, width: int, n_classes: int, pending: list[list[Tree]]) -> tuple[np.ndarray, np.ndarray]:
    bins = packed(b.column("bins"), np.uint8, width)
    raw = b"".join(b.column("scores").to_pylist())
    scores = np.frombuffer(raw, np.float64).reshape(-1, n_classes).copy() if raw else np.zeros((len(b), n_classes))
    return bins, _added(scores, pending, bins)


def _scored(rows: DataFrame, width: int, n_classes: int, pending: list[list[Tree]]) -> DataFrame:
    """The rows with the scores of the trees so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, s = _start(b, width, n_classes, pending)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([r.tobytes() for r in s], pa.binary())], names=b.schema.names)

    return save(rows.mapInArrow(run, "key bigint, y int, val boolean, bins binary, scores binary"), "scored")


def _chosen_rows(key: np.ndarray, seed: int, share: float) -> np.ndarray:
    """The rows of a round, by a hash of their key."""
    x = key.astype(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return (x ^ (x >> np.uint64(31))) < np.uint64(min(2**64 - 1, int(share * 2**64)))


def _gathered(p: Boosting, width: int, weights: list[float], pending: list[list[Tree]], trees: list[Tree], wanted: dict[int, dict[int, int]], columns: list[np.ndarray], turn: int):
    """A task's sums: of each class's wanted nodes (node → the sibling to subtract them from, or none) for each of the class's columns and bins.

    Before the first split it also gives the validation rows' loss, under key -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_classes, bins = len(weights), p.bins
        sums = {k: np.zeros((3, len(nodes), len(columns[k]) * bins), np.int64) for k, nodes in wanted.items()}
        loss, held = 0, 0
        for b in batches:
            if not len(b):
                continue
            x, s = _start(b, width, n_classes, pending)
            y, val = b.column("y").to_numpy(), b.column("val").to_numpy(zero_copy_only=False)
            w, prob = np.array(weights)[y], softmax(s)
            if val.any() and len(trees[0].feature) == 1:
                own = -np.log(np.maximum(prob[np.arange(len(y)), y], 1e-15))
                loss, held = loss + int(np.rint(own[val] * w[val] * UNIT).astype(np.int64).sum()), held + int(np.rint(w[val] * UNIT).astype(np.int64).sum())
            fit = ~val
            if p.rows < 1:
                fit &= _chosen_rows(b.column("key").to_numpy(), p.seed * 1000 + turn, p.rows)
            x, y, w, prob = x[fit], y[fit], w[fit], prob[fit]
            for k, nodes in wanted.items():
                at = np.full(len(trees[k].feature), -1)
                at[list(nodes)] = np.arange(len(nodes))
                slot = at[trees[k].leaf_of(x, binned=True)]
                mine = slot >= 0
                if not mine.any():
                    continue
                g = np.rint((prob[mine, k] - (y[mine] == k)) * w[mine] * UNIT)
                h = np.rint(prob[mine, k] * (1 - prob[mine, k]) * w[mine] * UNIT)
                cols = columns[k]
                place = (slot[mine, None] * len(cols) + np.arange(len(cols))) * bins + x[mine][:, cols]
                size = sums[k][0].size
                for i, v in enumerate((g, h, np.ones_like(g))):
                    # whole numbers below 2^53: exact
                    sums[k][i] += np.bincount(place.ravel(), np.repeat(v, len(cols)), size).astype(np.int64).reshape(sums[k][i].shape)
        key, feature, at_bin, parts = [], [], [], []
        for k, nodes in wanted.items():
            for slot, (node, sibling) in enumerate(nodes.items()):
                got = sums[k][:, slot]
                (where,) = np.nonzero(got[2])
                for to, sign in ((node, 1), (sibling, -1)):
                    if to is not None:
                        key.append(np.full(len(where), k * NODES + to))
                        feature.append(columns[k][where // bins])
                        at_bin.append(where % bins)
                        parts.append(sign * got[:, where])
        if held:
            key.append(np.array([-1]))
            feature.append(np.array([0]))
            at_bin.append(np.array([0]))
            parts.append(np.array([[loss], [held], [0]]))
        if key:
            g, h, n = np.concatenate(parts, 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in (key, feature, at_bin)] + [pa.array(c) for c in (g, h, n)], names=["key", "feature", "bin", "g", "h", "n"])

    return run


def best_splits(hist: DataFrame, p: Boosting) -> DataFrame:
    """key, g, h, n of each node and the best split's gain, feature, bin (the last on the left) and left sums; ties to the smallest feature and bin."""
    node = W.partitionBy("key", "feature")
    upto = node.orderBy("bin")
    d = hist.where("key >= 0")
    for c in "ghn":
        d = d.withColumn(f"{c}_all", F.sum(c).over(node)).withColumn(f"{c}_l", F.sum(c).over(upto))
    real = {c: F.col(c) / F.lit(float(UNIT)) for c in ("g_l", "h_l", "g_all", "h_all")}
    half = lambda g, h: F.coalesce(F.try_divide(g * g, h + p.l2), F.lit(0.0))
    g_r, h_r = real["g_all"] - real["g_l"], real["h_all"] - real["h_l"]
    gain = (half(real["g_l"], real["h_l"]) + half(g_r, h_r) - half(real["g_all"], real["h_all"])) * 0.5 - p.gamma
    valid = (F.col("n_l") > 0) & (F.col("n_l") < F.col("n_all")) & (real["h_l"] >= p.least_hessian) & (h_r >= p.least_hessian)
    d = d.withColumn("s", F.when(valid, F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "g_l", "h_l", "n_l")))
    best = d.groupBy("key").agg(F.max("g_all").alias("g"), F.max("h_all").alias("h"), F.max("n_all").alias("n"), F.max("s").alias("s"))
    return best.select("key", "g", "h", "n", F.col("s.gain").alias("gain"), (-F.col("s.f")).alias("feature"), (-F.col("s.b")).alias("bin"), F.col("s.g_l").alias("g_l"), F.col("s.h_l").alias("h_l"), F.col("s.n_l").alias("n_l"))


def fit_boosted(data: DataFrame, p: Boosting, role: Column | None = None, cuts: dict[int, list[float]] | None = None) -> Boosted:
    """Boosted trees under softmax, one tree a class and round; ``role``: ``val`` rows only tell when to stop.

    Rows of a class weigh by the reciprocal of its share where ``balanced``. With validation rows the fit stops
    after ``patience`` rounds without a lower loss and keeps the rounds up to the lowest.
    """
    width = width_of(data)
    if p.bins > 256:
        raise ValueError("a bin is one byte")
    train = usable(data, width) if role is None else usable(data, width).where(role != "val")
    counts = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    classes = sorted(counts)
    model = Boosted(classes, width, [], [])
    if len(classes) < 2:
        model.trees = [[Tree() for _ in classes]]
        return model
    weights = [sum(counts.values()) / (len(classes) * counts[c]) if p.balanced else 1.0 for c in classes]
    cuts = cuts or quantile_cuts(train, p.bins)
    known = data.where(F.col("y").isin(classes))
    with Temporary():
        rows, pending = save(binned(known, cuts, width, classes, role), "binned"), []
        for turn in range(p.rounds + 1):
            if len(pending) >= p.keep_every:
                rows, pending = _scored(rows, width, len(classes), pending), []
            trees, loss = _round(rows, p, width, weights, pending, cuts, turn, len(model.trees) == p.rounds)
            if loss is not None:
                model.losses.append(loss)
                if len(model.losses) - 1 - int(np.argmin(model.losses)) >= p.patience:
                    break
            if turn < p.rounds:
                model.trees.append(trees)
                pending = [*pending, trees]
            if role is None and turn == p.rounds - 1:
                break
    if model.losses:
        model.trees = model.trees[: max(1, int(np.argmin(model.losses)))]
    return model


def _round(rows: DataFrame, p: Boosting, width: int, weights: list[float], pending: list[list[Tree]], cuts: dict, turn: int, only_loss: bool) -> tuple[list[Tree], float | None]:
    """The trees of a round, and the validation loss before it."""
    n_columns = max(1, round(width * p.features))
    columns = [np.array(sorted(sorted(range(width), key=lambda f: uniform(p.seed, "columns", turn, k, f))[:n_columns])) for k in range(len(weights))]  # noqa: B023
    trees = [Tree() for _ in weights]
    stats: dict[int, dict] = {}  # of each open leaf
    tables: dict[int, DataFrame] = {}  # where a node's histogram is
    wanted: dict[int, dict[int, int | None]] = {k: {0: None} for k in ([] if only_loss else range(len(weights)))}
    loss, first = None, True
    while first or wanted:
        run = _gathered(p, width, weights, pending, trees, wanted, columns, turn)
        parts = rows.mapInArrow(run, "key bigint, feature bigint, bin bigint, g bigint, h bigint, n bigint")
        for table, keys in _parents(trees, wanted, tables):
            to = F.create_map(*[F.lit(x) for pair in keys.items() for x in pair])
            parts = parts.unionByName(table.where(F.col("key").isin(list(keys))).withColumn("key", F.element_at(to, F.col("key")).cast("long")))
        hist = parts.repartition("key", "feature").groupBy("key", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"]).where("n > 0 OR key < 0")
        hist = save(hist, "histogram")
        if first:
            r = hist.where("key = -1").first()
            loss = None if r is None else r["g"] / r["h"]
        for r in best_splits(hist, p).collect():
            stats[r["key"]], tables[r["key"]] = r.asDict(), hist
        first, wanted, full = False, {}, True
        for k, t in enumerate(trees) if not only_loss else ():
            left = p.leaves - sum(f < 0 for f in t.feature)
            open_ = [s for s in stats.values() if s["key"] // NODES == k and s["gain"] is not None and s["gain"] > 0 and t.depth[s["key"] % NODES] < p.depth]
            for s in sorted(open_, key=lambda s: (-s["gain"], s["key"]))[: min(p.at_once, left)]:
                node = s["key"] % NODES
                pair = t.split(node, s["feature"], float(cuts[s["feature"]][s["bin"]]), s["bin"])
                del stats[s["key"]]
                for child, (g, h, n) in zip(pair, ((s["g_l"], s["h_l"], s["n_l"]), (s["g"] - s["g_l"], s["h"] - s["h_l"], s["n"] - s["n_l"])), strict=True):
                    t.value[child], t.cover[child] = _step(p, g, h), n
                    stats[k * NODES + child] = {"key": k * NODES + child, "gain": None, "g": g, "h": h, "n": n}
                t.cover[node] = s["n"]
                small, large = pair if s["n_l"] * 2 <= s["n"] else pair[::-1]
                wanted.setdefault(k, {})[small] = large
            full &= sum(f < 0 for f in t.feature) >= p.leaves
        if full:
            break
    for k, t in enumerate(trees):
        if len(t.feature) == 1 and k * NODES in stats:
            s = stats[k * NODES]
            t.value[0], t.cover[0] = _step(p, s["g"], s["h"]), s["n"]
    return trees, loss


def _step(p: Boosting, g: int, h: int) -> float:
    return -p.rate * (g / UNIT) / (h / UNIT + p.l2) if h or p.l2 else 0.0


def _parents(trees: list[Tree], wanted: dict[int, dict[int, int | None]], tables: dict[int, DataFrame]) -> Iterator[tuple[DataFrame, dict[int, int]]]:
    """Each table that has histograms of split nodes, and node → the child that they less the other's are."""
    by: dict[int, tuple[DataFrame, dict[int, int]]] = {}
    for k, nodes in wanted.items():
        parent = {child: i for i, f in enumerate(trees[k].feature) if f >= 0 for child in (trees[k].left[i], trees[k].right[i])}
        for sibling in nodes.values():
            if sibling is not None:
                key = k * NODES + parent[sibling]
                by.setdefault(id(tables[key]), (tables[key], {}))[1][key] = k * NODES + sibling
    yield from by.values()


def predict(model, df: DataFrame, keep: list[str], name: str = "y_pred", scores: str | None = None) -> DataFrame:
    """``keep`` columns, the class of the highest score (ties to the first class), null for vectors of another length and from a fit without rows; and all ``scores`` where named."""
    first = next(iter(model.classes), 0)
    kind = "string" if isinstance(first, str) else "double" if isinstance(first, float) else "bigint"
    width, types = model.width, [df.schema[c].dataType.simpleString() for c in keep]
    schema = ", ".join([*[f"`{c}` {t}" for c, t in zip(keep, types, strict=True)], f"`{name}` {kind}", *([f"`{scores}` array<double>"] if scores else [])])
    rows = df.select(*keep, F.when(F.size("x") == width, F.col("x").cast("array<double>")).alias("__x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("__x")
            has = x.is_valid().to_numpy(zero_copy_only=False)
            s = model.scores(matrix(x.drop_null(), width))
            best = iter(s.argmax(1) if s.size else ())
            label = pa.array([model.classes[next(best)] if ok and s.size else None for ok in has], {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64()}[kind])
            columns, names = [*b.columns[:-1], label], [*keep, name]
            if scores:
                each = iter(s.tolist())
                columns, names = [*columns, pa.array([next(each) if ok else None for ok in has], pa.list_(pa.float64()))], [*names, scores]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, schema)


def node_table(spark: SparkSession, model) -> DataFrame:
    """round, class, node, feature (null: a leaf), cut, left, right, value, cover of every node."""
    rows = []
    for i, trees in enumerate(model.trees):
        for k, t in enumerate(trees):
            for n, f in enumerate(t.feature):
                inner = f >= 0
                rows.append((i, k, n, f if inner else None, t.cut[n] if inner else None, t.left[n] if inner else None, t.right[n] if inner else None, t.value[n], float(t.cover[n])))
    return spark.createDataFrame(rows, "round int, class int, node int, feature int, cut double, left int, right int, value double, cover double")

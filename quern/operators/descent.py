"""Data-parallel fits over blocks of rows: exact sums of gradients, descent with resumable state, principal components, encoders.

Rows are packed once into blocks, a row of arrays for each some hundred, and written to the shared folder. A
pass is one scan: each task adds up what a kernel makes of its blocks, in whole numbers, and the tasks' sums
are added by position. A block is the same whatever the partitions and the sums are exact, so a fit doesn't
depend on the number of tasks, their order or retries. Only the parameters travel: out in a broadcast whose size the
model fixes, back as one row each. A pass is an ordinary job, not a barrier stage: a barrier needs slots for all its
tasks at once and starts all of them anew when one executor is lost; here one task is retried.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.scratch import save

Weights = dict[str, np.ndarray]
#: Of a block's arrays by name and the weights: the block's sum of each result.
Kernel = Callable[[Weights, dict[str, np.ndarray]], Weights]

#: Rows of a block, in expectation, and the quantum of a sum's mean.
PER_BLOCK, QUANTUM = 256, 2.0**-50
#: Blocks of vectors that are written, and so read, together.
GROUP = 16


def vector_blocks(df: DataFrame, key: str, vector: str, per_block: int = PER_BLOCK) -> DataFrame:
    """block, rows, key array, x: vectors of one length, end to end, in order of the key. Null vectors are left out.

    Rows are sorted by block and packed as they come, so that a task holds one block. A reader decodes a row group at once,
    whose size on disk says little of vectors of few values; a group therefore has ``GROUP`` blocks at most.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("x"))
    block = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-rows.count() // per_block)))).alias("block")
    by = ("block", "key", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            names = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if names[lo] != at:
                    yield from _block(held)
                    at, held = names[lo], []
                held.append(b.slice(lo, hi - lo))
        yield from _block(held)

    packed = rows.select(block, "key", "x").repartition("block").sortWithinPartitions(*by).mapInArrow(run, "block bigint, rows bigint, key array<bigint>, x array<double>")
    return save(packed, "blocks", **{"parquet.block.row.count.limit": GROUP})


def _block(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The block of rows (block, key, x), none of no rows."""
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        key, x = t["key"].combine_chunks(), t["x"].combine_chunks().flatten()
        yield pa.RecordBatch.from_arrays([t["block"].combine_chunks().slice(0, 1), pa.array([len(t)]), one(key), one(x)], names=["block", "rows", "key", "x"])


def arrays(batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
    """Each block of a batch as numpy arrays by column."""
    names = batch.schema.names
    for i in range(len(batch)):
        cells = [batch.column(c)[i] for c in range(len(names))]
        yield {n: x.values.to_numpy(zero_copy_only=False) if isinstance(x, pa.ListScalar) else x.as_py() for n, x in zip(names, cells, strict=True)}


def summed(blocks: DataFrame, kernel: Kernel, weights: Weights, shapes: dict[str, tuple], rows: int) -> Weights:
    """The mean over ``rows`` rows of what ``kernel`` gives (``shapes`` by name), to 2^-50 a block and exactly added."""
    shared = blocks.sparkSession.sparkContext.broadcast(weights)
    size = sum(int(np.prod(s)) for s in shapes.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_block = np.zeros(size, np.int64), False
        for b in batches:
            for block in arrays(b):
                got = kernel(shared.value, block)
                flat = np.concatenate([np.ravel(got[n]) for n in shapes]) / (rows * QUANTUM)
                if not (np.abs(flat) < 2.0**62).all():
                    raise OverflowError("a block's sum is not finite or too large: scale the input or lower the rate")
                total += np.rint(flat).astype(np.int64)
                any_block = True
        if any_block:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["s"])

    parts = blocks.mapInArrow(run, "s array<bigint>").select(F.posexplode("s").alias("at", "v"))
    flat = np.zeros(size)
    # a decimal, so that sums beyond a long don't wrap
    for r in parts.groupBy("at").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("v")).collect():
        flat[r["at"]] = float(r["v"]) * QUANTUM
    shared.unpersist()
    out, at = {}, 0
    for n, s in shapes.items():
        k = int(np.prod(s))
        out[n], at = flat[at : at + k].reshape(s), at + k
    return out


def row_count(blocks: DataFrame) -> int:
    return blocks.agg(F.sum("rows")).first()[0] or 0


def descend(blocks: DataFrame, kernel: Kernel, weights: Weights, steps: int, rate: float, state: str | None = None, every: int = 10) -> tuple[Weights, list[float]]:
    """``steps`` full passes of Adam from ``weights``: the weights of the least mean loss met, and the loss before each step and at the end.

    ``kernel`` gives ``loss`` and a gradient for each weight. ``state``: a path in the shared folder where the
    state is written each ``every`` steps; a fit that finds one there goes on from it and ends with the same weights
    as one that was never stopped. Without rows the weights come back as they are.
    """
    spark, rows = blocks.sparkSession, row_count(blocks)
    if not rows:
        return weights, []
    shapes: dict[str, tuple] = {"loss": ()} | {n: w.shape for n, w in weights.items()}
    w = {n: np.asarray(x, np.float64) for n, x in weights.items()}
    now = {"w": w, "best": w, "m": {n: np.zeros_like(x) for n, x in w.items()}, "v": {n: np.zeros_like(x) for n, x in w.items()}}
    losses: list[float] = []
    if state and (found := _last(spark, state)):
        losses = found["losses"]
        now = {k: {n: np.array(x).reshape(w[n].shape) for n, x in found[k].items()} for k in now}
    while len(losses) <= steps:
        got = summed(blocks, kernel, now["w"], shapes, rows)
        losses.append(float(got["loss"]))
        if losses[-1] <= min(losses):
            now["best"] = now["w"]
        t = len(losses)
        now["m"] = {n: 0.9 * x + 0.1 * got[n] for n, x in now["m"].items()}
        now["v"] = {n: 0.999 * x + 0.001 * got[n] ** 2 for n, x in now["v"].items()}
        now["w"] = {n: x - rate * (now["m"][n] / (1 - 0.9**t)) / (np.sqrt(now["v"][n] / (1 - 0.999**t)) + 1e-8) for n, x in now["w"].items()}
        if state and (t % every == 0 or t > steps):
            text = json.dumps({"losses": losses} | {k: {n: x.ravel().tolist() for n, x in d.items()} for k, d in now.items()})
            spark.createDataFrame([(t, text)], "step int, state string").coalesce(1).write.mode("append").parquet(state)
    return now["best"], losses


def _last(spark: SparkSession, state: str) -> dict | None:
    """The latest state written at a path, None where there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    r = spark.read.schema("step int, state string").parquet(state).agg(F.max_by("state", "step").alias("s")).first()
    return json.loads(r["s"]) if r["s"] else None


# ---- principal components by a randomised range finder


def _moments(_: Weights, b: dict[str, np.ndarray]) -> Weights:
    return {"mean": b["x"].reshape(b["rows"], -1).sum(0)}


def _sketch(w: Weights, b: dict[str, np.ndarray]) -> Weights:
    a = b["x"].reshape(b["rows"], -1) - w["mean"]
    return {"y": a.T @ (a @ w["q"])}


def principal(blocks: DataFrame, width: int, k: int, passes: int = 6, extra: int = 8, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """mean (width), components (width, k) and variances (k) of ``vector_blocks``, by a randomised range finder.

    Each pass multiplies the covariance with a thin orthonormal basis of ``k + extra`` columns, as sums over blocks, and
    orthonormalises it anew: the covariance itself is never formed. Signs: a component's largest entry is positive.
    """
    rows, k = row_count(blocks), min(k, width)
    thin = min(width, k + extra)
    if not rows:
        return np.zeros(width), np.eye(width)[:, :k], np.zeros(k)
    mean = summed(blocks, _moments, {}, {"mean": (width,)}, rows)["mean"]
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, thin)))[0]
    for _ in range(passes):
        q = np.linalg.qr(summed(blocks, _sketch, {"mean": mean, "q": q}, {"y": (width, thin)}, rows)["y"])[0]
    small = q.T @ summed(blocks, _sketch, {"mean": mean, "q": q}, {"y": (width, thin)}, rows)["y"]
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    v = (q @ vectors)[:, ::-1][:, :k]
    return mean, v * np.where(v[np.abs(v).argmax(0), np.arange(k)] < 0, -1, 1), values[::-1][:k]


# ---- an encoder that starts as the principal components


def encoder(mean: np.ndarray, components: np.ndarray, hidden: int, seed: int = 42) -> Weights:
    """Weights of a code z = (x - mean) V + relu((x - mean) A) B and its reading z V' + relu(z C) D: linear where B and D are 0, as here."""
    r, (d, k) = np.random.default_rng(seed), components.shape
    draw = lambda i, o: r.standard_normal((i, o)) / np.sqrt(i)
    return {"mean": mean, "V": components, "U": components.T, "A": draw(d, hidden), "B": np.zeros((hidden, k)), "C": draw(k, hidden), "D": np.zeros((hidden, d))}


def codes(w: Weights, x: np.ndarray) -> np.ndarray:
    c = x - w["mean"]
    return c @ w["V"] + np.maximum(c @ w["A"], 0) @ w["B"]


def encoder_kernel(w: Weights, b: dict[str, np.ndarray]) -> Weights:
    """Squared error of the reconstruction, and its gradients."""
    c = b["x"].reshape(b["rows"], -1) - w["mean"]
    h1 = np.maximum(c @ w["A"], 0)
    z = c @ w["V"] + h1 @ w["B"]
    h2 = np.maximum(z @ w["C"], 0)
    e = z @ w["U"] + h2 @ w["D"] - c
    g = 2 * e
    g2 = (g @ w["D"].T) * (h2 > 0)
    gz = g @ w["U"].T + g2 @ w["C"].T
    g1 = (gz @ w["B"].T) * (h1 > 0)
    return {"loss": (e * e).sum(), "mean": np.zeros(c.shape[1]), "V": c.T @ gz, "U": z.T @ g, "A": c.T @ g1, "B": h1.T @ gz, "C": z.T @ g2, "D": h2.T @ g}


def encode(df: DataFrame, key: str, vector: str, w: Weights) -> DataFrame:
    """key, code of every row; a null vector has a null code."""
    shared = df.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            there = b.column(1).is_valid().to_numpy(zero_copy_only=False)
            x = b.column(1).drop_null().flatten().to_numpy().reshape(int(there.sum()), -1)
            found = iter(codes(shared.value, x).tolist() if len(x) else [])
            out = [next(found) if t else None for t in there]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], names=[key, "code"])

    return df.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, f"`{key}` bigint, code array<double>")

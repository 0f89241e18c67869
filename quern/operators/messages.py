"""Trained message passing over many small graphs, and untrained messages along directed edges of one large graph.

A graph is a row of its block (see ``descent``): it must be small, as a molecule is; there may be any number. States
live on nodes, or on directed edges, where an edge a to b hears every edge into a but its own reverse. The
line graph is never built: what an edge hears is the sum into its first node less its reverse.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.descent import PER_BLOCK, Weights, arrays, descend
from quern.sources.scratch import save


def directed_messages(edges: DataFrame, rounds: int) -> DataFrame:
    """src, dst, value of directed edges (src, dst, value): each round adds to an edge's value those of the edges into its src, but for its reverse.

    Repeated edges are one, with the sum of their values. Values are written out each round. Work grows with the edges, not with
    the square of a node's degree; a node's sum is pre-aggregated and joined to its edges.
    """
    now = edges.groupBy("src", "dst").agg(F.sum("value").alias("value"))
    first = now = save(now, "edges")
    for _ in range(rounds):
        into = now.groupBy(F.col("dst").alias("src")).agg(F.sum("value").alias("into"))
        back = now.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("value").alias("back"))
        heard = first.join(into, "src", "left").join(back, ["src", "dst"], "left")
        zero = F.lit(0).cast(first.schema["value"].dataType)
        now = save(heard.select("src", "dst", (F.col("value") + F.coalesce("into", zero) - F.coalesce("back", zero)).alias("value")), "edges")
    return now


# ---- blocks of graphs


def graph_blocks(nodes: DataFrame, edges: DataFrame, labels: DataFrame, per_block: int = PER_BLOCK) -> DataFrame:
    """Blocks of labelled graphs: nodes (graph_id, node, x array), undirected edges (graph_id, src, dst), labels (graph_id, label from 0).

    Loops, repeated edges and edges to nodes that aren't there are left out; so are graphs without a label or a node.
    """
    n = nodes.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct(F.col("node").cast("long").alias("node"), F.col("x").cast("array<double>").alias("x")))).alias("n"))
    pair = F.struct(F.least("src", "dst").cast("long").alias("a"), F.greatest("src", "dst").cast("long").alias("b"))
    e = edges.where("src <> dst").groupBy("graph_id").agg(F.array_sort(F.collect_set(pair)).alias("e"))
    rows = labels.select("graph_id", F.col("label").cast("long").alias("label")).where("label IS NOT NULL").join(n, "graph_id").join(e, "graph_id", "left")
    at = lambda x: (F.array_position(F.col("n.node"), x) - 1).cast("long")
    placed = F.transform(F.coalesce("e", F.array().cast("array<struct<a:bigint,b:bigint>>")), lambda p: F.struct(at(p["a"]).alias("a"), at(p["b"]).alias("b")))
    rows = rows.select("graph_id", "label", F.col("n.x").alias("x"), F.filter(placed, lambda p: (p["a"] >= 0) & (p["b"] >= 0)).alias("e"))
    rows = save(rows.select(F.col("graph_id").cast("long").alias("key"), "label", F.size("x").cast("long").alias("size"), F.flatten("x").alias("x"), F.size("e").cast("long").alias("m"), F.col("e.a").alias("a"), F.col("e.b").alias("b")), "graphs")
    block = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-rows.count() // per_block)))).alias("block")
    packed = rows.groupBy(block).agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias("r"))
    flat = [F.flatten(f"r.{c}").alias(c) for c in ("x", "a", "b")]
    return save(packed.select("block", F.size("r").cast("long").alias("rows"), *[F.col(f"r.{c}").alias(c) for c in ("key", "label", "size", "m")], *flat), "blocks")


# ---- the model


def _spread(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``values`` added up at their places among n."""
    out = np.zeros((n, values.shape[1]))
    if len(at):
        order = np.argsort(at, kind="stable")
        place = at[order]
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        out[place[first]] = np.add.reduceat(values[order], first)
    return out


class Wiring:
    """A block's graphs laid end to end: node features, directed edges with their reverses, each node's graph."""

    def __init__(self, b: dict[str, np.ndarray], on_edges: bool):
        self.graphs, size = b["rows"], b["size"]
        self.n = int(size.sum())
        self.x = b["x"].reshape(self.n, -1)
        self.graph, self.share = np.repeat(np.arange(self.graphs), size), 1 / size[:, None]
        start = np.repeat(np.cumsum(size) - size, b["m"])
        a, z = b["a"] + start, b["b"] + start
        self.src, self.dst = np.r_[a, z], np.r_[z, a]
        self.back = np.roll(np.arange(2 * len(a)), len(a))
        self.on_edges = on_edges

    def heard(self, h: np.ndarray) -> np.ndarray:
        """What each state hears: an edge the edges into its src less its reverse, a node itself and its neighbours."""
        return _spread(h, self.dst, self.n)[self.src] - h[self.back] if self.on_edges else h + _spread(h[self.src], self.dst, self.n)

    def heard_back(self, g: np.ndarray) -> np.ndarray:
        """The transpose of ``heard``."""
        return _spread(g, self.src, self.n)[self.dst] - g[self.back] if self.on_edges else g + _spread(g[self.dst], self.src, self.n)


def new_model(features: int, classes: int, width: int = 24, seed: int = 42) -> Weights:
    r = np.random.default_rng(seed)
    draw = lambda i, o: r.standard_normal((i, o)) * np.sqrt(2 / i)
    return {"enter": draw(features, width), "message": draw(width, width) / 2, "own": draw(features, width), "sum": draw(width, width) / 2, "bias": np.zeros(width), "out": draw(width, classes) / 2, "level": np.zeros(classes)}


def _forward(w: Weights, g: Wiring, rounds: int) -> tuple:
    z0 = (g.x[g.src] if g.on_edges else g.x) @ w["enter"]
    states, heard = [np.maximum(z0, 0)], []
    for _ in range(rounds):
        heard.append(g.heard(states[-1]))
        states.append(np.maximum(z0 + heard[-1] @ w["message"], 0))
    total = _spread(states[-1], g.dst, g.n) if g.on_edges else states[-1]
    node = np.maximum(g.x @ w["own"] + total @ w["sum"] + w["bias"], 0)
    pooled = _spread(node, g.graph, g.graphs) * g.share
    return states, heard, total, node, pooled, pooled @ w["out"] + w["level"]


def kernel(rounds: int, on_edges: bool):
    """Cross entropy of a block's graphs and its gradients."""

    def run(w: Weights, b: dict[str, np.ndarray]) -> Weights:
        g = Wiring(b, on_edges)
        states, heard, total, node, pooled, score = _forward(w, g, rounds)
        score = score - score.max(1, keepdims=True)
        p = np.exp(score)
        p /= p.sum(1, keepdims=True)
        each = np.arange(g.graphs)
        out = {"loss": -np.log(np.maximum(p[each, b["label"]], 1e-300)).sum()}
        d = p.copy()
        d[each, b["label"]] -= 1
        out |= {"out": pooled.T @ d, "level": d.sum(0)}
        dn = ((d @ w["out"].T) * g.share)[g.graph] * (node > 0)
        out |= {"own": g.x.T @ dn, "sum": total.T @ dn, "bias": dn.sum(0)}
        dh = dn @ w["sum"].T
        dh = dh[g.dst] if g.on_edges else dh
        dz0, message = np.zeros_like(states[0]), np.zeros_like(w["message"])
        for t in range(rounds, 0, -1):
            dz = dh * (states[t] > 0)
            dz0 += dz
            message += heard[t - 1].T @ dz
            dh = g.heard_back(dz @ w["message"].T)
        dz0 += dh * (states[0] > 0)
        return out | {"enter": (g.x[g.src] if g.on_edges else g.x).T @ dz0, "message": message}

    return run


def train(blocks: DataFrame, features: int, classes: int, rounds: int = 3, on_edges: bool = True, steps: int = 40, rate: float = 0.015, width: int = 24, state: str | None = None) -> tuple[Weights, list[float]]:
    """A graph classifier fitted to ``graph_blocks``: its weights and the losses on the way."""
    return descend(blocks, kernel(rounds, on_edges), new_model(features, classes, width), steps, rate, state)


def predict(blocks: DataFrame, w: Weights, rounds: int = 3, on_edges: bool = True) -> DataFrame:
    """graph_id, block, y_true, y_pred of blocked graphs; ties to the smallest class."""
    shared = blocks.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in arrays(batch):
                best = _forward(shared.value, Wiring(b, on_edges), rounds)[-1].argmax(1)
                yield pa.RecordBatch.from_arrays([pa.array(b["key"]), pa.array(np.full(len(best), b["block"], np.int64)), pa.array(b["label"]), pa.array(best)], names=["graph_id", "block", "y_true", "y_pred"])

    return blocks.mapInArrow(run, "graph_id bigint, block bigint, y_true bigint, y_pred bigint")

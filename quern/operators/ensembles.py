"""Weighted ensembles, neighbours, clusters and message passing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.vectors import distance
from quern.sources.scratch import save

#: Queries of a neighbour search that are broadcast together.
CHUNK = 20_000
#: Rows of a block in a search for close pairs.
BLOCK = 4096
#: Fixed value: kT in kcal/mol at 298 K.
KT = 0.5922


def boltzmann(df: DataFrame, group: str, energy: str, kt: float = KT) -> DataFrame:
    """Adds ``weight``: exp(-(e - lowest) / kt), normed to 1 in each group. Two windows over one partitioning: one shuffle."""
    w = W.partitionBy(group)
    e = df.withColumn("__w", F.exp(-(F.col(energy) - F.min(energy).over(w)) / kt))
    return e.withColumn("weight", F.col("__w") / F.sum("__w").over(w)).drop("__w")


def lowest(df: DataFrame, group: list[str], energy: str, key: str) -> DataFrame:
    """The member of each group with the least energy, ties to the smallest key."""
    rest = [c for c in df.columns if c not in (*group, energy, key)]
    m = df.where(F.col(energy).isNotNull()).groupBy(*group).agg(F.min(F.struct(energy, key, *rest)).alias("m"))
    return m.select(*group, "m.*").select(*df.columns)


def weighted_stats(df: DataFrame, group: str, value: str, weight: str) -> DataFrame:
    """Weighted mean and std of each group, from sums shifted by the group's first value for stability."""
    shift = df.groupBy(group).agg(F.min(value).alias("__s"))
    d = F.col(value) - F.col("__s")
    a = df.join(shift, group).groupBy(group).agg(F.sum(weight).alias("w"), F.sum(F.col(weight) * d).alias("wx"), F.sum(F.col(weight) * d * d).alias("wxx"), F.first("__s").alias("s"))
    mean = F.col("wx") / F.col("w")
    return a.where("w > 0").select(group, (mean + F.col("s")).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("wxx") / F.col("w") - mean * mean)).alias("std"))


def neighbours(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, chunk: int = CHUNK) -> DataFrame:
    """Exact k nearest rows of each query (never a row with its key): query, key, distance, rank; ties to the smallest key.

    Queries go out in chunks of ``chunk`` by hash, which bounds each broadcast. A task compares its rows with
    them block by block, by matrix products, keeps k of each query, and computes those distances exactly.
    Vectors are not null and of one length.
    """
    asked = queries.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias("v"))
    every = rows.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias("v"))
    chunks = max(1, -(-asked.count() // chunk))
    out = None
    for c in range(chunks):
        t = asked.where(F.pmod(F.xxhash64(key), F.lit(chunks)) == c).toPandas()
        part = _nearest(every, key, t[key].to_numpy(np.int64), np.array(t["v"].tolist(), np.float64), k)
        out = part if out is None else out.unionByName(save(part, "nearest") if chunks > 1 else part)
    order = W.partitionBy("query").orderBy("distance", key)
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _nearest(rows: DataFrame, key: str, ids: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((ids, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        best_id, best = np.full((len(ids), 0), -1, np.int64), np.full((len(ids), 0), np.inf)
        for b in batches:
            for at in range(0, len(b) if len(ids) else 0, 4096):
                part = b.slice(at, 4096)
                name = part.column(0).to_numpy()
                x = part.column(1).flatten().to_numpy().reshape(len(name), -1)
                near = (x * x).sum(1) + (q * q).sum(1)[:, None] - 2 * q @ x.T
                near[ids[:, None] == name] = np.inf
                # a few more than k by the rounded distance, then exactly
                top = np.argpartition(near, min(k + 8, len(name)) - 1, axis=1)[:, : k + 8]
                d = np.sqrt(((x[top] - q[:, None, :]) ** 2).sum(2))
                d[np.isinf(np.take_along_axis(near, top, 1))] = np.inf
                best_id, best = np.concatenate([best_id, name[top]], 1), np.concatenate([best, d], 1)
                order = np.lexsort((best_id, best), axis=1)[:, :k]
                best_id, best = np.take_along_axis(best_id, order, 1), np.take_along_axis(best, order, 1)
        found = np.isfinite(best)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, found.sum(1))), pa.array(best_id[found]), pa.array(best[found])], names=["query", key, "distance"])

    return rows.mapInArrow(run, f"query bigint, `{key}` bigint, distance double")


def vote(found: DataFrame, labelled: DataFrame, key: str, label: str) -> DataFrame:
    """query, y_pred: the commonest label among each query's neighbours, ties to the smallest."""
    c = found.join(labelled.select(key, label), key).groupBy("query", label).agg(F.count("*").alias("c"))
    return c.groupBy("query").agg(F.min(F.struct((-F.col("c")).alias("k"), F.col(label).alias("l"))).alias("m")).select("query", F.col("m.l").alias("y_pred"))


def centroids(df: DataFrame, category: str, vector: str) -> DataFrame:
    """category, pos, mean, spread of every component."""
    return df.select(category, F.posexplode(vector).alias("pos", "x")).groupBy(category, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("spread"))


def centroid_distances(df: DataFrame, category: str, vector: str) -> DataFrame:
    """Distance of each pair of categories' centroids."""
    c = centroids(df, category, vector)
    a, b = c.select(F.col(category).alias("a"), "pos", F.col("mean").alias("x")), c.select(F.col(category).alias("b"), "pos", F.col("mean").alias("y"))
    return a.join(b, "pos").where("a < b").groupBy("a", "b").agg(F.sqrt(F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))).alias("distance"))


def pairs_within(df: DataFrame, group: str, key: str, vector: str, radius: float, axes: int = 2, block: int = BLOCK) -> DataFrame:
    """Pairs of a group at ``radius`` or less: group, i, j (the keys, i < j), distance. Rows of equal keys make no pair with each other.

    The first ``axes`` components cut space into cells a little wider than the radius, so that pairs lie in one cell or in
    adjoining ones; a cell of more than ``block`` rows is dealt into blocks by hash. A task holds two blocks at a time and
    compares them by matrix products; the distances of what these leave are made component by component and decide. Vectors
    that are null or hold null or non-finite components, and those of unequal length, are in no pair.
    """
    kind = df.schema[vector].dataType.elementType.simpleString()
    kind = kind if kind == "float" else "double"
    at = lambda i: F.coalesce(F.get("x", F.lit(i)).cast("double"), F.lit(0.0))
    # wider than the radius by more than a quotient is rounded; what lies very far out shares the outermost cells
    width = radius * (1 + 1e-6) if radius > 0 else 1.0
    place = lambda i: F.floor(F.greatest(F.lit(-1e9), F.least(F.lit(1e9), at(i) / width)))
    rows = df.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(vector).cast(f"array<{kind}>").alias("x")).where("g IS NOT NULL AND k IS NOT NULL AND x IS NOT NULL")
    rows = rows.where(F.forall("x", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf"))))
    # vectors of other lengths are in cells of their own
    rows = rows.withColumn("cell", F.array(F.size("x").cast("long"), *[place(i) for i in range(axes)]))

    parts = save(rows.groupBy("g", "cell").agg(F.count("*").alias("n"), F.ceil(F.count("*") / block).cast("int").alias("parts")), "cells")
    near = F.array(*[F.array(F.get("cell", F.lit(0)), *[F.get("cell", F.lit(i + 1)) + d for i, d in enumerate(ds)]) for ds in product((-1, 0, 1), repeat=axes)])
    meets = parts.select("g", F.col("cell").alias("own"), "n", "parts", F.explode(near).alias("cell")).join(parts.select("g", "cell", F.col("parts").alias("others")), ["g", "cell"])
    cells = save(meets.groupBy("g", "own").agg(F.first("n").alias("n"), F.first("parts").alias("parts"), F.collect_list(F.struct("cell", "others")).alias("near")), "cells")
    sent = cells.agg(F.sum(F.col("n") * F.aggregate("near", F.lit(0), lambda s, c: s + c["others"]))).first()[0] or 0

    own = F.struct("cell", F.pmod(F.xxhash64("k", "x"), F.col("parts")).cast("int").alias("part"))
    dealt = rows.join(cells.select("g", F.col("own").alias("cell"), "parts", "near"), ["g", "cell"]).withColumn("own", own).withColumn("c", F.explode("near"))
    dealt = dealt.withColumn("other", F.explode(F.transform(F.sequence(F.lit(0), F.col("c.others") - 1), lambda n: F.struct(F.col("c.cell").alias("cell"), n.alias("part")))))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 0).when(lo == F.col("own"), 1).otherwise(2)
    dealt = dealt.select("g", lo.alias("lo"), hi.alias("hi"), side.alias("side"), "k", "x")
    by = ("g", "lo", "hi")
    dealt = dealt.repartition(sent // BLOCK + 1, *by).sortWithinPartitions(*by)
    # a number for each run of a tile's rows, so that the tasks need not compare cells
    dealt = dealt.select("g", F.xxhash64(*by).alias("tile"), "side", "k", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []
        for b in batches:
            names = b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if names[lo] != tile:
                    yield from _close(held, radius)
                    tile, held = names[lo], []
                held.append(b.slice(lo, hi - lo))
        yield from _close(held, radius)

    kinds = {c: dealt.schema[c].dataType.simpleString() for c in ("g", "k")}
    found = dealt.mapInArrow(run, f"g {kinds['g']}, a {kinds['k']}, b {kinds['k']}, distance double").where("a <> b")
    return found.select(F.col("g").alias(group), F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "distance")


def _close(held: list[pa.RecordBatch], radius: float) -> Iterator[pa.RecordBatch]:
    """g, a, b, distance of a tile's close pairs; columns g, tile, side (0: all with each other; else 1 with 2), k, x."""
    t = pa.Table.from_batches(held).combine_chunks() if held else []
    if len(t) < 2:
        return
    side, names, n = t["side"].to_numpy(), t["k"].combine_chunks(), len(t)
    x = t["x"].combine_chunks().flatten().to_numpy().reshape(n, -1).astype(np.float64)
    left, right = (np.arange(n), np.arange(n)) if side[0] == 0 else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
    if not (len(left) and len(right)):
        return
    with np.errstate(all="ignore"):
        size = (x * x).sum(1)
        # squares so large that products could overflow are left to the exact distance, as is all within the rounding of a product
        large = ~(size < 1e200)
        size[large] = 0
        base, y, columns = size * (1 - 1e-9), np.where(large[:, None], 0, x), np.ascontiguousarray(x.T)
        for at in range(0, len(left), 256):
            rows = left[at : at + 256]
            near = base[rows][:, None] + base[right] - 2 * (y[rows] @ y[right].T) <= radius * radius * (1 + 1e-9)
            near |= large[rows][:, None] | large[right]
            if side[0] == 0:
                near &= rows[:, None] < right
            one, two = np.nonzero(near)
            one, two = rows[one], right[two]
            for cut in range(0, len(one), 65536):
                a, b = one[cut : cut + 65536], two[cut : cut + 65536]
                total = np.zeros(len(a))
                for c in columns:
                    d = c[a] - c[b]
                    total += d * d
                distance = np.sqrt(total)
                kept = np.flatnonzero(distance <= radius)
                if len(kept):
                    yield pa.RecordBatch.from_arrays([pa.repeat(t["g"][0], len(kept)), names.take(pa.array(a[kept])), names.take(pa.array(b[kept])), pa.array(distance[kept])], names=["g", "a", "b", "distance"])


def message_pass(nodes: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """(node, value), edges (src, dst): each round a node's value becomes half its own plus half its in-neighbours' mean.

    Edges are written once and values each round, so that a round's plan reads two tables however many came before.
    """
    edges = save(edges.select("src", "dst"), "edges")
    for _ in range(rounds):
        nodes = save(nodes, "nodes")
        m = edges.join(nodes.select(F.col("node").alias("src"), "value"), "src").groupBy("dst").agg(F.avg("value").alias("m"))
        nodes = nodes.join(m, nodes["node"] == m["dst"], "left").select("node", (F.col("value") * 0.5 + F.coalesce("m", "value") * 0.5).alias("value"))
    return nodes


def greedy_leaders(df: DataFrame, group: str, key: str, energy: str, vector: str, apart: float, most: int) -> DataFrame:
    """Of each group, in order of energy: a member leads if it is ``apart`` or more from all leaders so far, up to ``most``.

    Sequential by nature; a fold over the group's sorted members, so groups must be small (an ensemble of one molecule).
    """
    members = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(energy).alias("e"), F.col(key).alias("k"), F.col(vector).alias("v")))).alias("m"))
    empty = F.slice("m", 1, 0)
    lead = F.aggregate("m", empty, lambda a, x: F.when((F.size(a) < most) & F.forall(a, lambda y: distance(y["v"], x["v"]) >= apart), F.concat(a, F.array(x))).otherwise(a))
    return members.select(group, F.posexplode(lead).alias("place", "x")).select(group, "place", F.col("x.k").alias(key), F.col("x.e").alias(energy))

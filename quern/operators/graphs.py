"""Graphs: bounded traversals of one large graph, and per-graph kernels over many small ones."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.vectors import sign_product
from quern.sources.scratch import save


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, ...) and their reverses."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def bfs(edges: DataFrame, start: DataFrame, depth: int, blocked: DataFrame | None = None) -> DataFrame:
    """node, dist of everything within ``depth`` steps of ``start`` (column node), blocked nodes left out.

    The loop is bounded by ``depth``; each step joins the frontier with the edges and leaves out what is known.
    Edges and each frontier are written out, so that a step's plan doesn't hold the steps before.
    """
    edges = save(edges.select("src", "dst"), "edges")
    if blocked is not None:
        start = start.join(blocked, "node", "left_anti")
    known = frontier = save(start.select("node").distinct().withColumn("dist", F.lit(0)), "frontier")
    for d in range(1, depth + 1):
        nxt = frontier.select(F.col("node").alias("src")).join(edges, "src").select(F.col("dst").alias("node")).distinct().join(known, "node", "left_anti")
        if blocked is not None:
            nxt = nxt.join(blocked, "node", "left_anti")
        frontier = save(nxt.withColumn("dist", F.lit(d)), "frontier")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def edge_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Undirected edges (src, dst, w) of two sides → a, b, w_before, w_after, change: formed, broken, changed or same."""
    norm = lambda df, w: df.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "w").groupBy("a", "b").agg(F.max("w").alias(w))
    j = norm(before, "w_before").join(norm(after, "w_after"), ["a", "b"], "full_outer").fillna(0, ["w_before", "w_after"])
    kind = F.when(F.col("w_before") == 0, "formed").when(F.col("w_after") == 0, "broken").when(F.col("w_before") != F.col("w_after"), "changed").otherwise("same")
    return j.withColumn("change", kind)


def reaction_centre(changes: DataFrame) -> DataFrame:
    """The nodes that a formed, broken or changed edge touches."""
    hit = changes.where("change <> 'same'")
    return hit.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def two_views(before: DataFrame, after: DataFrame) -> DataFrame:
    """Both sides' edges in one table, with the side's name."""
    return before.withColumn("side", F.lit("reactant")).unionByName(after.withColumn("side", F.lit("product")))


def graph_summary(nodes: DataFrame, edges: DataFrame, features: list[str] = []) -> DataFrame:  # noqa: B006
    """Of each graph: nodes, edges, density E / (N (N - 1)), and the mean of each node feature over all and over ring nodes.

    ``nodes``: graph_id, and for features also ``ring`` (0/1); a graph without ring nodes has ring means of 0.
    """
    means = [F.avg(c).alias(f"{c}_mean") for c in features]
    rings = [F.coalesce(F.avg(F.when(F.col("ring") == 1, F.col(c))), F.lit(0.0)).alias(f"{c}_ring") for c in features]
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("n_nodes"), *means, *rings)
    e = edges.groupBy("graph_id").agg(F.count("*").alias("n_edges"))
    pairs = F.col("n_nodes") * (F.col("n_nodes") - 1)
    out = n.join(e, "graph_id", "left").fillna(0, ["n_edges"])
    return out.withColumn("density", F.when(pairs > 0, F.col("n_edges") / pairs).otherwise(F.lit(0.0)))


def from_template(graphs: DataFrame, ring: list[tuple[int, int]], variants: list[str], own: DataFrame) -> DataFrame:
    """graph_id, variant, src, dst, kind: a fixed ring for each graph and variant, both ways, and the graph's own edges in each."""
    edge = F.explode(F.array(*[F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst")) for x in ring for a, b in (x, x[::-1])]))
    variant = F.explode(F.array(*map(F.lit, variants))).alias("variant")
    fixed = graphs.select("graph_id", variant).select("*", edge.alias("e")).select("graph_id", "variant", "e.*", F.lit("ring").alias("kind"))
    rest = both_ways(own.select("graph_id", "src", "dst")).join(graphs.select("graph_id"), "graph_id", "left_semi")
    return fixed.unionByName(rest.select("graph_id", variant, "src", "dst", F.lit("substituent").alias("kind")))


def complete(found: DataFrame, wanted: DataFrame, variants: list[str], defaults: dict) -> DataFrame:
    """A row for each wanted graph and variant: the one found, or a dummy with the defaults and ``dummy`` 1."""
    grid = wanted.select("graph_id", F.explode(F.array(*map(F.lit, variants))).alias("variant"))
    out = grid.join(found.withColumn("dummy", F.lit(0)), ["graph_id", "variant"], "left")
    return out.fillna(defaults | {"dummy": 1})


# ---- many small graphs


def distances(edges: DataFrame, starts: DataFrame, most: int = 1 << 30) -> DataFrame:
    """graph_id, start, node, dist within ``most`` steps: ``edges`` (graph_id, src, dst), undirected; ``starts`` (graph_id, start, blocked array).

    Each graph is one group, so it must be small (a molecule); there may be any number of them.
    """

    def run(e: pa.Table, s: pa.Table) -> pa.Table:
        near: dict[int, list[int]] = {}
        for a, b in zip(e["src"].to_pylist(), e["dst"].to_pylist(), strict=True):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        rows = []
        for graph, start, blocked in zip(*(s[c].to_pylist() for c in ("graph_id", "start", "blocked")), strict=True):
            shut = set(blocked or ()) - {None}
            dist, level = ({start: 0}, [start]) if start not in shut else ({}, [])
            for d in range(1, most + 1):
                level = [n for n in dict.fromkeys(y for x in level for y in near.get(x, ())) if n not in dist and n not in shut]
                if not level:
                    break
                dist |= dict.fromkeys(level, d)
            rows += [(graph, start, n, d) for n, d in dist.items()]
        cols = zip(*rows, strict=True) if rows else ([], [], [], [])
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["graph_id", "start", "node", "dist"])

    e = edges.select(F.col("graph_id").cast("long").alias("graph_id"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    s = starts.select(F.col("graph_id").cast("long").alias("graph_id"), F.col("start").cast("long").alias("start"), F.col("blocked").cast("array<bigint>").alias("blocked"))
    return e.groupBy("graph_id").cogroup(s.groupBy("graph_id")).applyInArrow(run, "graph_id bigint, start bigint, node bigint, dist int")


def layers(dist: DataFrame, centres: DataFrame, within: tuple[int, ...] = (3, 4, 5), far: int = 99) -> DataFrame:
    """Of each graph, from ``dist`` (graph_id, node, dist; start left out) and signed ``centres`` (graph_id, node, sign):

    centres within each number of steps, the sum of sign / dist, the nearest centre's distance and sign (ties
    to the smallest node; ``far`` and 0 without any), and the product of the signs within the first number.
    """
    near = dist.where("dist > 0").join(centres, ["graph_id", "node"])
    first = F.min(F.struct("dist", "node", "sign"))
    signs = F.collect_list(F.when(F.col("dist") <= within[0], F.col("sign").cast("double")))
    out = near.groupBy("graph_id").agg(
        *[F.count_if(F.col("dist") <= k).alias(f"n{k}") for k in within],
        F.sum(F.col("sign") / F.col("dist")).alias("gradient"),
        first.alias("m"),
        F.when(F.size(signs) > 0, sign_product(signs)).otherwise(F.lit(0.0)).alias("product"),
    )
    out = dist.select("graph_id").distinct().join(out, "graph_id", "left")
    value = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    return out.select("graph_id", *[value(f"n{k}", 0).alias(f"n{k}") for k in within], value("gradient", 0.0).alias("gradient"), value("m.dist", far).alias("nearest"), value("m.sign", 0).alias("nearest_sign"), value("product", 0.0).alias("product"))


def eccentricity(dist: DataFrame) -> DataFrame:
    """The greatest distance from each graph's start: the longest chain."""
    return dist.groupBy("graph_id", "start").agg(F.max("dist").alias("eccentricity"))


def branch_sequence(dist: DataFrame, nodes: DataFrame, depth: int = 4) -> DataFrame:
    """graph_id, start, seq: the atomic numbers within ``depth`` steps, largest first."""
    z = dist.where(F.col("dist") <= depth).join(nodes.select("graph_id", "node", "z"), ["graph_id", "node"])
    return z.groupBy("graph_id", "start").agg(F.sort_array(F.collect_list("z"), False).alias("seq"))


def outranks(a: Column, b: Column) -> Column:
    """1, 0 or -1: of two sequences the one with the larger value at the first difference is higher, else the longer one."""
    return F.when(a == b, 0).when(a > b, 1).otherwise(-1)


def explode_graphs(graphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (graph_id, z array, bonds array of structs (a, b, kind)) → node and edge tables, edges both ways."""
    nodes = graphs.select("graph_id", F.posexplode("z").alias("node", "z"))
    edges = graphs.select("graph_id", F.inline("bonds"))
    return nodes, both_ways(edges.withColumnsRenamed({"a": "src", "b": "dst"}))

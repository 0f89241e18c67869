"""Substructures of many small labelled graphs, in DataFrame functions: neighbourhood fingerprints, scaffolds, template matches.

Fingerprints and scaffolds work on packed graphs: a row holds a graph's node codes and neighbour lists, so that after one
shuffle every round stays in its row. Graphs must be small (a molecule); there may be any number. Templates are
matched by joins over the table of all edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.descent import principal, vector_blocks
from quern.sources.scratch import save

#: Key of a graph that peels away whole.
ACYCLIC = "acyclic"


def pack(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, node array (ascending), code array, near array of arrays of places: nodes (graph_id, node, code string), undirected edges (graph_id, src, dst).

    Loops and edges to nodes that aren't there are left out, repeated edges count once; a null code is the empty string.
    """
    n = nodes.groupBy("graph_id").agg(F.array_sort(F.collect_set(F.struct(F.col("node").cast("long").alias("node"), F.coalesce(F.col("code").cast("string"), F.lit("")).alias("code")))).alias("n"))
    ends = F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"))))
    e = edges.where("src <> dst").select("graph_id", ends.alias("e")).groupBy("graph_id").agg(F.collect_set(F.struct(F.col("e.a").cast("long").alias("a"), F.col("e.b").cast("long").alias("b"))).alias("e"))
    place = lambda x: (F.array_position(F.col("n.node"), x) - 1).cast("int")
    own = lambda v: F.transform(F.filter(F.col("e"), lambda p: p["a"] == v), lambda p: place(p["b"]))
    near = F.transform(F.col("n.node"), lambda v: F.array_sort(F.filter(own(v), lambda i: i >= 0)))
    rows = n.join(e, "graph_id", "left").withColumn("e", F.coalesce("e", F.array().cast("array<struct<a:bigint,b:bigint>>")))
    return rows.select("graph_id", F.col("n.node").alias("node"), F.col("n.code").alias("code"), near.alias("near"))


def refined(code: Column, near: Column) -> Column:
    """Each node's code after a round: the digest of its own and its neighbours' codes, sorted."""
    return F.transform(code, lambda c, i: F.md5(F.concat_ws(",", F.concat(F.array(c), F.array_sort(F.transform(F.get(near, i), lambda j: F.get(code, j)))))))


def fingerprint(packed: DataFrame, radius: int = 3, bits: int = 512) -> DataFrame:
    """Adds ``fp``: the sorted bits of the nodes' neighbourhoods of 0 to ``radius`` steps, folded to ``bits``.

    The same for any numbering of the nodes; a graph's neighbourhoods that look alike share a bit.
    """
    # a fold, so that a round reads the codes of the one before as a value
    grow = lambda codes, _: F.concat(codes, F.array(refined(F.element_at(codes, -1), F.col("near"))))
    every = F.flatten(F.aggregate(F.sequence(F.lit(0), F.lit(radius)), F.array(F.transform("code", lambda c: F.md5(c))), lambda codes, r: F.when(r == 0, codes).otherwise(grow(codes, r))))
    fold = lambda c: (F.conv(F.substring(c, 1, 8), 16, 10).cast("long") % bits).cast("int")
    return packed.withColumn("fp", F.array_sort(F.array_distinct(F.transform(every, fold))))


def difference(a: Column, b: Column, bits: int = 512) -> Column:
    """array<int> of 1 where only ``a`` has the bit, -1 where only ``b`` has it, else 0; a null side has no bits."""
    has = lambda x, i: F.coalesce(F.array_contains(x, i), F.lit(False)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: has(a, i) - has(b, i))


def compressed(df: DataFrame, key: str, vector: str, width: int, k: int = 16) -> DataFrame:
    """key, components: the rows' ``k`` principal components, zeros where there are fewer of variance; fitted on the rows that aren't zero throughout."""
    rows = save(df.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias("v")), "vectors")
    blocks = vector_blocks(rows.where(F.exists("v", lambda x: x != 0)), key, "v")
    mean, parts, variances = principal(blocks, width, k)
    # few numbers: k columns of the width, broadcast
    full = np.zeros((width, k))
    full[:, : parts.shape[1]] = parts * (variances > 1e-12)
    shared = df.sparkSession.sparkContext.broadcast((mean, full))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, full = shared.value
        for b in batches:
            for at in range(0, len(b), 1024):
                name, v = b.column(0).slice(at, 1024), b.column(1).slice(at, 1024)
                out = np.zeros((len(v), k))
                there = pc.equal(pc.list_value_length(v), width).fill_null(False)
                x = v.filter(there).flatten()
                y = (x.to_numpy(zero_copy_only=False).reshape(-1, width) - mean) @ full
                y[x.is_null().to_numpy(zero_copy_only=False).reshape(-1, width).any(1)] = 0
                out[there.to_numpy(zero_copy_only=False)] = y
                yield pa.RecordBatch.from_arrays([name, pa.array(list(out), pa.list_(pa.float64()))], names=[key, "components"])

    return rows.mapInArrow(run, f"`{key}` bigint, components array<double>")


def scaffold(packed: DataFrame) -> DataFrame:
    """graph_id, scaffold (the nodes left), key: nodes of fewer than two neighbours go until none is left to go.

    What stays are rings and the links between them. The key is the digest of their codes after as many rounds of colour
    refinement as nodes stay, so equal scaffolds share it whatever their numbering; regular graphs that refinement
    can't tell apart share it too. A graph without a ring has the key ``acyclic``.
    """
    rounds = F.sequence(F.lit(1), F.size("node"))
    left = lambda alive, i: F.filter(F.get("near", i), lambda j: F.get(alive, j))
    peel = lambda alive, _: F.transform(alive, lambda a, i: a & (F.size(left(alive, i)) > 1))
    df = packed.withColumn("__alive", F.aggregate(rounds, F.transform("node", lambda _: F.lit(True)), peel))
    df = df.withColumn("__near", F.transform("near", lambda x: F.filter(x, lambda j: F.get("__alive", j))))
    rounds = F.filter(rounds, lambda r: r <= F.size(F.filter("__alive", lambda a: a)))
    df = df.withColumn("__code", F.aggregate(rounds, F.transform("code", lambda c: F.md5(c)), lambda code, _: refined(code, F.col("__near"))))
    mine = lambda x: F.filter(F.col(x), lambda _, i: F.get("__alive", i))
    key = F.when(F.exists("__alive", lambda a: a), F.md5(F.array_join(F.array_sort(mine("__code")), ","))).otherwise(F.lit(ACYCLIC))
    return df.select("graph_id", mine("node").alias("scaffold"), key.alias("key"))


# ---- templates

#: A template: the label that each of its nodes must have (None: any), and its edges.
Template = tuple[list, list[tuple[int, int]]]


def _order(template: Template, counts: dict[tuple, int]) -> list[tuple[int, int]]:
    """The template's edges, the rarest first, then always the rarest of those that touch what is bound; closing edges as soon as they can be."""
    labels, edges = template
    fits = lambda want, have: want is None or want == have
    rare = lambda e: sum(n for (a, b), n in counts.items() if fits(labels[e[0]], a) and fits(labels[e[1]], b))
    left, bound, out = list(edges), set(), []
    while left:
        touching = [e for e in left if bound & set(e)] or left
        if bound and touching is left:
            raise ValueError("a template must be connected")
        e = min(touching, key=lambda e: (not set(e) <= bound, rare(e), e))
        left.remove(e)
        out.append(e)
        bound |= set(e)
    return out


def first_match(nodes: DataFrame, edges: DataFrame, templates: list[Template]) -> DataFrame:
    """graph_id, template (number from 0), match (array of nodes, in the template's order): the first template that fits, at its least place.

    nodes (graph_id, node, label), undirected edges (graph_id, src, dst). A match maps template nodes to different nodes of the graph,
    with their labels and all the template's edges; of several the one whose nodes are least in order. Graphs that no template fits have no row.

    An edge of the template is a join over the labelled edges of all graphs, on the graph and what is bound so far. A template's
    joins start from its rarest edge, by one count of the pairs of labels, and each edge table is filtered by both labels first.
    """
    n = nodes.select("graph_id", "node", "label")
    both = edges.where("src <> dst").select("graph_id", F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("graph_id", "e.*").distinct()
    end = lambda c: n.select("graph_id", F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    e = save(both.join(end("src"), ["graph_id", "src"]).join(end("dst"), ["graph_id", "dst"]), "edges")
    counts = {(r["src_label"], r["dst_label"]): r["count"] for r in e.groupBy("src_label", "dst_label").count().collect()}
    found = None
    for number, template in enumerate(templates):
        labels, _ = template
        rows, bound = None, []
        for a, b in _order(template, counts):
            wanted = [F.col(f"{c}_label") == labels[i] for c, i in (("src", a), ("dst", b)) if labels[i] is not None]
            step = e
            for w in wanted:
                step = step.where(w)
            step = step.select("graph_id", F.col("src").alias(f"p{a}"), F.col("dst").alias(f"p{b}"))
            new = [i for i in (a, b) if i not in bound]
            rows = step if rows is None else rows.join(step, ["graph_id", *[f"p{i}" for i in (a, b) if i in bound]])
            for i in new:
                for j in bound:
                    rows = rows.where(F.col(f"p{i}") != F.col(f"p{j}"))
            bound += new
        if rows is None:  # a single node
            rows = n.where(F.lit(True) if labels[0] is None else F.col("label") == labels[0]).select("graph_id", F.col("node").alias("p0"))
        one = rows.select("graph_id", F.lit(number).alias("template"), F.array(*[F.col(f"p{i}") for i in range(len(labels))]).alias("match"))
        found = one if found is None else found.unionByName(one)
    return found.groupBy("graph_id").agg(F.min(F.struct("template", "match")).alias("m")).select("graph_id", "m.*")

"""Fits by data-parallel descent over molecule graphs and vectors, and messages along directed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import descent as D
from quern.operators import messages as P
from quern.plans.common import Registry, table
from quern.plans.molecules import ATOMS, bonds, nodes

REGISTRY = Registry()
query = REGISTRY.add

#: A bond is uneven where just one of its atoms is at this distance from the origin or farther.
FAR = 2.0
CLASSES, CODE, HIDDEN = 3, 16, 32


def labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Molecule graphs with a class that only bonds tell: how many of them are uneven (up to 9, up to 11, more)."""
    n, e = nodes(spark, sf_dir).where("x IS NOT NULL"), bonds(spark, sf_dir)
    far = n.groupBy("graph_id").agg(F.collect_set(F.when(F.col("x") >= FAR, F.col("node"))).alias("far"))
    uneven = F.array_contains("far", F.col("src").cast("int")) != F.array_contains("far", F.col("dst").cast("int"))
    label = F.count_if(uneven)
    classes = e.join(far, "graph_id").groupBy("graph_id").agg(F.when(label <= 9, 0).when(label <= 11, 1).otherwise(2).alias("label"))
    x = F.array(F.lit(1.0), F.col("x") / 4, (F.col("x") >= FAR).cast("double"), F.col("ring").cast("double"), F.col("z") / 16.0)
    return n.select("graph_id", "node", x.alias("x")), e, classes


def _classes(spark: SparkSession, sf_dir: str, on_edges: bool) -> DataFrame:
    n, e, classes = labelled(spark, sf_dir)
    blocks = P.graph_blocks(n, e, classes, per_block=64)
    held_out = F.pmod(F.col("block"), F.lit(5)) == 0
    w, _ = P.train(blocks.where(~held_out), 5, CLASSES, rounds=2, on_edges=on_edges)
    return P.predict(blocks, w, rounds=2, on_edges=on_edges).select("graph_id", held_out.alias("held_out"), "y_true", "y_pred")


@query()
def edge_message_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all molecule graphs by a model whose messages run along directed edges, trained on the blocks that aren't held out (every fifth is)."""
    return _classes(spark, sf_dir, True)


@query()
def node_message_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a model whose states live on nodes."""
    return _classes(spark, sf_dir, False)


@query(f"""WITH e AS (SELECT vec_id AS g, i AS s, i + 1 AS d FROM embeddings, unnest(range(0, {ATOMS - 1})) AS u(i) WHERE (vec_id + i) % 9 <> 0 UNION ALL SELECT vec_id, i, i + 5 FROM embeddings, unnest([0, 5, 10, 15]) AS u(i) WHERE (vec_id + i) % 4 <> 0),
b AS (SELECT g, s, d, s + 2 * d + 1 AS v FROM e UNION ALL SELECT g, d, s, d + 2 * s + 1 FROM e),
m1 AS (SELECT x.g, x.s, x.d, any_value(x.v) + coalesce(sum(y.v), 0) AS v FROM b x LEFT JOIN b y ON y.g = x.g AND y.d = x.s AND y.s <> x.d GROUP BY x.g, x.s, x.d),
m2 AS (SELECT x.g, x.s, x.d, any_value(x.v) + coalesce(sum(y.v), 0) AS v FROM b x LEFT JOIN m1 y ON y.g = x.g AND y.d = x.s AND y.s <> x.d GROUP BY x.g, x.s, x.d)
SELECT g * 100 + s AS src, g * 100 + d AS dst, CAST(v AS BIGINT) AS value FROM m2""")
def directed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of messages along the directed bonds of all molecules, as one large graph."""
    b = bonds(spark, sf_dir)
    e = b.unionByName(b.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    node = lambda c: (F.col("graph_id") * 100 + F.col(c)).cast("long").alias(c)
    return P.directed_messages(e.select(node("src"), node("dst"), (F.col("src") + 2 * F.col("dst") + 1).cast("long").alias("value")), 2)


@query()
def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of 16 numbers for all vectors, by an encoder that starts as the principal components and descends from there."""
    e = table(spark, sf_dir, "embeddings")
    width = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    blocks = D.vector_blocks(e, "vec_id", "embedding")
    mean, v, _ = D.principal(blocks, width, CODE)
    w, _ = D.descend(blocks, D.encoder_kernel, D.encoder(mean, v, HIDDEN), 20, 0.002)
    return D.encode(e, "vec_id", "embedding", w)

"""Vector, geometry and graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.operators import ensembles as E
from quern.operators import graphs as G
from quern.plans.common import Registry, table

REGISTRY = Registry()
query = REGISTRY.add

DIST = "sqrt(list_sum([(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2 FOR i IN range(1, 65)]))"


@query(f"""WITH d AS (SELECT a.vec_id AS q, b.vec_id AS v, {DIST} AS d FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, v) AS rn FROM d) SELECT q AS "query", round(avg(d), 6) AS mean_distance FROM r WHERE rn <= 5 GROUP BY q""")
def knn5_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean distance of the five nearest of a stated query set: ids divisible by 20."""
    e = table(spark, sf_dir, "embeddings")
    n = E.neighbours(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 5)
    return n.groupBy("query").agg(F.round(F.avg("distance"), 6).alias("mean_distance"))


@query("""WITH c AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, unnest(range(1, 65)) AS u(i) GROUP BY ALL)
SELECT x.label AS a, y.label AS b, round(sqrt(sum((x.m - y.m) ** 2)), 6) AS distance FROM c x JOIN c y ON x.i = y.i AND x.label < y.label GROUP BY ALL""")
def centroid_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.centroid_distances(table(spark, sf_dir, "embeddings"), "label", "embedding").select("a", "b", F.round("distance", 6).alias("distance"))


@query(f"SELECT a.label, a.vec_id AS i, b.vec_id AS j, round({DIST}, 6) AS distance FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {DIST} <= 1.2")
def pairwise_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pairs_within(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 1.2).withColumn("distance", F.round("distance", 6))


@query("""WITH c AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, unnest(range(1, 65)) AS u(i) GROUP BY ALL),
d AS (SELECT e.vec_id, sqrt(sum((e.embedding[c.i]::DOUBLE - c.m) ** 2)) AS n FROM embeddings e JOIN c ON e.label = c.label GROUP BY e.vec_id)
SELECT vec_id, k - 1 AS k, round(exp(-0.5 / 0.25 ** 2 * (n - (k - 1) * 0.25) ** 2), 6) AS value FROM d, unnest(range(1, 10)) AS u(k)""")
def rbf_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's distance from its label's centroid, spread over nine radial functions."""
    e = table(spark, sf_dir, "embeddings")
    centre = E.centroids(e, "label", "embedding").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("c"))
    d = e.join(centre, "label").select("vec_id", V.radial_basis(V.distance(F.col("embedding"), F.col("c")), 0.0, 2.0, 9).alias("r"))
    return d.select("vec_id", F.posexplode("r").alias("k", "value")).select("vec_id", F.col("k").cast("long").alias("k"), F.round("value", 6).alias("value"))


BFS_SQL = """WITH RECURSIVE e AS (SELECT DISTINCT 'c' || o_custkey AS s, 'p' || l_partkey AS d FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
b AS (SELECT s, d FROM e UNION ALL SELECT d, s FROM e),
w(node, dist) AS (SELECT 'c1', 0 UNION SELECT d, dist + 1 FROM w JOIN b ON w.node = b.s WHERE dist < 3)
SELECT node, CAST(min(dist) AS INT) AS dist FROM w GROUP BY node"""


@query(BFS_SQL)
def bfs_depth3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and the parts they ordered, three steps from customer 1."""
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    e = j.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()
    return G.bfs(G.both_ways(e), spark.range(1).select(F.lit("c1").alias("node")), 3)


@query(BFS_SQL.replace("WITH RECURSIVE e AS", "WITH RECURSIVE z AS (SELECT DISTINCT 'p' || l_partkey AS n FROM lineitem WHERE l_partkey % 3 = 0), e AS").replace("WHERE dist < 3)", "WHERE dist < 3 AND b.d NOT IN (SELECT n FROM z))"))
def bfs_around_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, never entering a part whose key is divisible by 3."""
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    e = j.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()
    blocked = table(spark, sf_dir, "lineitem").where("l_partkey % 3 = 0").select(F.concat(F.lit("p"), "l_partkey").alias("node")).distinct()
    return G.bfs(G.both_ways(e), spark.range(1).select(F.lit("c1").alias("node")), 3, blocked)


@query("""WITH f AS (SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, max(l_linenumber) AS w FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL),
o AS (SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, max(l_linenumber) AS w FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL)
SELECT coalesce(f.a, o.a) AS a, coalesce(f.b, o.b) AS b, coalesce(f.w, 0) AS w_before, coalesce(o.w, 0) AS w_after,
CASE WHEN f.w IS NULL THEN 'formed' WHEN o.w IS NULL THEN 'broken' WHEN f.w <> o.w THEN 'changed' ELSE 'same' END AS change FROM f FULL JOIN o ON f.a = o.a AND f.b = o.b""")
def edge_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_linenumber").alias("w"), "l_linestatus")
    return G.edge_changes(l.where("l_linestatus = 'F'").drop("l_linestatus"), l.where("l_linestatus = 'O'").drop("l_linestatus"))


@query("""WITH n AS (SELECT n_nationkey AS node, n_regionkey AS r, CAST(n_nationkey AS DOUBLE) AS v FROM nation),
a AS (SELECT x.node, any_value(x.r) AS r, any_value(x.v) * 0.5 + 0.5 * avg(y.v) AS v FROM n x JOIN n y ON x.r = y.r AND x.node <> y.node GROUP BY x.node),
b AS (SELECT x.node, any_value(x.v) * 0.5 + 0.5 * avg(y.v) AS v FROM a x JOIN a y ON x.r = y.r AND x.node <> y.node GROUP BY x.node)
SELECT node, round(v, 6) AS value FROM b""")
def message_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_nationkey").alias("src"), "n_regionkey"), n.select(F.col("n_nationkey").alias("dst"), "n_regionkey")
    edges = a.join(b, "n_regionkey").where("src <> dst").select("src", "dst")
    return E.message_pass(n.select(F.col("n_nationkey").alias("node"), F.col("n_nationkey").cast("double").alias("value")), edges, 2).select("node", F.round("value", 6).alias("value"))


@query("""WITH n AS (SELECT n_regionkey AS g, count(*) AS k FROM nation GROUP BY ALL), e AS (SELECT n_regionkey AS g, count(*) AS m FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT CAST(n.g AS BIGINT) AS graph_id, k AS n_nodes, coalesce(m, 0) AS n_edges, round(CASE WHEN k > 1 THEN coalesce(m, 0) / (k * (k - 1)) ELSE 0 END, 6)::DOUBLE AS density FROM n LEFT JOIN e ON n.g = e.g""")
def graph_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("graph_id"), "n_nationkey")
    e = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("graph_id")
    return G.graph_summary(n, e).withColumn("density", F.round("density", 6))


@query()
def greedy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaders by energy in ensembles of at most ten members (ids of one label and hundred)."""
    e = table(spark, sf_dir, "embeddings").select(F.concat_ws("/", "label", F.floor(F.col("vec_id") / 100)).alias("ensemble"), "vec_id", F.abs(F.get("embedding", F.lit(0))).cast("double").alias("energy"), "embedding")
    return E.greedy_leaders(e, "ensemble", "vec_id", "energy", "embedding", 1.2, 8)

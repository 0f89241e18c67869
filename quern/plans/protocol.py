"""Model protocol queries over the embeddings, with the nearest class centroid as the model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import ensembles as E
from quern.operators import protocol as P
from quern.plans.common import Registry, table

REGISTRY = Registry()
query = REGISTRY.add

WIDTH = 64
GROUPS = {f"g{i}": list(range(16 * i, 16 * i + 16)) for i in range(4)}
MODELS = {"full": None, "head": list(range(32)), "majority": None}
E_SQL = "WITH e AS (SELECT vec_id AS id, label AS y, i - 1 AS pos, embedding[i]::DOUBLE AS v FROM embeddings, unnest(range(1, 65)) AS u(i)), r AS (SELECT vec_id AS id, label AS y FROM embeddings) "


def data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("y"), F.col("embedding").cast("array<double>").alias("x"))


def gold():
    return F.col("id") % 3 == 0


def scores_sql(predictions: str, by: str) -> str:
    """Balanced accuracy, correlation and rows of the table ``predictions`` (by, y, yp), as further CTEs ending in ``scores``."""
    join = " AND ".join(f"k.{c.strip()} = z.{c.strip()}" for c in by.split(","))
    return f""", rc AS (SELECT {by}, y, avg(CAST(y = yp AS DOUBLE)) AS r FROM {predictions} GROUP BY ALL), ba AS (SELECT {by}, avg(r) AS bal_acc FROM rc GROUP BY ALL),
kk AS (SELECT {by}, unnest(range(0, 1000)) AS c FROM (SELECT DISTINCT {by} FROM {predictions})),
mg AS (SELECT {", ".join("k." + c.strip() for c in by.split(","))}, k.c, CAST(count(*) FILTER (z.y = k.c) AS DOUBLE) AS t, CAST(count(*) FILTER (z.yp = k.c) AS DOUBLE) AS q, CAST(count(*) FILTER (z.y = k.c AND z.yp = k.c) AS DOUBLE) AS h
  FROM (SELECT * FROM kk WHERE c IN (SELECT y FROM r)) k JOIN {predictions} z ON {join} GROUP BY ALL),
sm AS (SELECT {by}, sum(t) AS s, sum(h) AS h, sum(t * q) AS tq, sum(t * t) AS tt, sum(q * q) AS qq FROM mg GROUP BY ALL),
mc AS (SELECT {by}, CASE WHEN (s * s - qq) * (s * s - tt) = 0 THEN 0 ELSE (h * s - tq) / sqrt((s * s - qq) * (s * s - tt)) END AS mcc, CAST(s AS BIGINT) AS n_test FROM sm),
scores AS (SELECT * FROM ba JOIN mc USING ({by})) """


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


@query(E_SQL + """, f AS (SELECT unnest(range(0, 5)) AS k), c AS (SELECT k, y, pos, avg(v) AS m FROM e, f WHERE id % 5 <> k GROUP BY ALL),
d AS (SELECT k, e.id, e.y, c.y AS cy, sum((v - m) ** 2) AS a, sum((v - m) ** 2) FILTER (e.pos < 32) AS b FROM e JOIN c ON e.pos = c.pos AND e.id % 5 = k GROUP BY ALL),
j AS (SELECT k, y, count(*) AS n FROM r, f WHERE id % 5 <> k GROUP BY ALL), q AS (SELECT k, arg_min(y, {'n': -n, 'y': y}) AS yp, sum(n) AS n_train FROM j GROUP BY k),
p AS (SELECT 'full' AS model, k, id, y, arg_min(cy, {'d': a, 'y': cy}) AS yp FROM d GROUP BY ALL UNION ALL SELECT 'head', k, id, y, arg_min(cy, {'d': b, 'y': cy}) FROM d GROUP BY ALL UNION ALL SELECT 'majority', k, id, y, yp FROM r JOIN q ON id % 5 = k) """
    + scores_sql("p", "model, k") + "SELECT model, 'fold' || k AS split_name, CAST(n_train AS BIGINT) AS n_train, round(bal_acc, 6) AS bal_acc, round(mcc, 6)::DOUBLE AS mcc, n_test FROM scores JOIN q USING (k)")
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of models over five folds."""
    d = data(spark, sf_dir)
    splits = d.select(F.col("id").alias("row_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    splits = splits.select(F.concat(F.lit("fold"), "k").alias("split_name"), "row_id", F.when(F.col("row_id") % 5 == F.col("k"), "test").otherwise("train").alias("role"))
    return rounded(P.compared(d, splits, MODELS), "bal_acc", "mcc")


FOLD_SQL = E_SQL + """, c AS (SELECT y, pos, avg(v) AS m FROM e WHERE id % 5 <> 0 GROUP BY ALL), d AS (SELECT e.id, e.y, c.y AS cy, sum((v - m) ** 2) AS a FROM e JOIN c ON e.pos = c.pos WHERE id % 5 = 0 GROUP BY ALL),
p0 AS (SELECT id, y, arg_min(cy, {'d': a, 'y': cy}) AS yp FROM d GROUP BY ALL) """


def _fold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Train and test rows: fold 0 is the test."""
    d = data(spark, sf_dir)
    return d.where("id % 5 <> 0"), d.where("id % 5 = 0")


@query(FOLD_SQL + ", p AS (SELECT 'full' AS subset, y, yp FROM p0 UNION ALL SELECT CASE WHEN id % 3 = 0 THEN 'gold' ELSE 'nongold' END, y, yp FROM p0) "
    + scores_sql("p", "subset") + "SELECT subset, round(bal_acc, 6) AS bal_acc, round(mcc, 6)::DOUBLE AS mcc, n_test FROM scores")
def honest_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model on all test rows, on gold ones and on the rest."""
    train, test = _fold(spark, sf_dir)
    return rounded(P.honest(P.predict(test, P.centroids(train)), gold()), "bal_acc", "mcc")


@query(E_SQL + """, c AS (SELECT id % 4 AS s, y, pos, avg(v) AS m FROM e WHERE id % 5 <> 0 GROUP BY ALL), d AS (SELECT e.id, id % 4 AS s, e.y, c.y AS cy, sum((v - m) ** 2) AS a FROM e JOIN c ON e.pos = c.pos AND id % 4 = c.s WHERE id % 5 = 0 GROUP BY ALL),
p AS (SELECT s AS subset, id, y, arg_min(cy, {'d': a, 'y': cy}) AS yp FROM d GROUP BY ALL) """ + scores_sql("p", "subset") + "SELECT subset, round(bal_acc, 6) AS bal_acc, round(mcc, 6)::DOUBLE AS mcc, n_test FROM scores")
def subset_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.subset_models(data(spark, sf_dir).withColumn("subset", F.col("id") % 4), "subset", F.col("id") % 5 == 0), "bal_acc", "mcc")


@query(E_SQL + """, f AS (SELECT unnest(range(0, 5)) AS k), c AS (SELECT k, y, pos, avg(v) AS m FROM e, f WHERE id % 5 <> k GROUP BY ALL), d AS (SELECT k, e.id, e.y, c.y AS cy, sqrt(sum((v - m) ** 2)) AS a FROM e JOIN c ON e.pos = c.pos AND e.id % 5 = k GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY a, cy) AS rn FROM d)
SELECT id, any_value(y) AS y, any_value(k)::BIGINT AS fold, max(cy) FILTER (rn = 1) AS y_pred, round(max(a) FILTER (rn = 2) - max(a) FILTER (rn = 1), 6) AS margin FROM o GROUP BY id""")
def out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row judged by a model of the other folds: what a second model may learn from."""
    return rounded(P.out_of_fold(data(spark, sf_dir).withColumn("fold", F.col("id") % 5), "fold"), "margin")


NULLS = list(range(5))
SPREAD = "(sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(q) - sum(s) * sum(s) / sum(n))"


@query(E_SQL + f""", n AS (SELECT y, count(*) AS n FROM r GROUP BY y), b AS (SELECT y, sum(n) OVER (ORDER BY y) AS upto, sum(n) OVER (ORDER BY y) - n AS since FROM n),
o AS (SELECT s, id, row_number() OVER (PARTITION BY s ORDER BY substr(md5(CAST(s AS VARCHAR) || '|' || CAST(id AS VARCHAR)), 1, 15)) - 1 AS place FROM r, (SELECT unnest({NULLS}) AS s)), z AS (SELECT s AS seed, id, b.y AS l FROM o JOIN b ON place >= since AND place < upto),
x AS (SELECT seed, pos, l, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM z JOIN e USING (id) GROUP BY ALL), w AS (SELECT seed, pos, {SPREAD} AS i FROM x GROUP BY ALL),
t AS (SELECT pos, y, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM e GROUP BY ALL), g AS (SELECT pos, {SPREAD} AS i FROM t GROUP BY pos)
SELECT g.pos::INT AS pos, round(any_value(g.i), 6) AS importance, round(avg(CAST(w.i >= g.i AS DOUBLE)), 6) AS p_value, round(quantile_cont(w.i, 0.75), 6) AS null_p75, avg(CAST(w.i >= g.i AS DOUBLE)) > 0.25 AS noise FROM g JOIN w ON g.pos = w.pos GROUP BY g.pos""")
def null_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each component's importance against runs with shuffled labels."""
    return rounded(P.null_importance(data(spark, sf_dir), NULLS), "importance", "p_value", "null_p75")


PERMUTATIONS = [1, 2]


@query(FOLD_SQL + f""", t AS (SELECT id, row_number() OVER (ORDER BY id) AS place FROM r WHERE id % 5 = 0), h AS (SELECT s, id AS other, row_number() OVER (PARTITION BY s ORDER BY substr(md5(CAST(s AS VARCHAR) || '|' || CAST(id AS VARCHAR)), 1, 15), id) AS place FROM r, (SELECT unnest({PERMUTATIONS}) AS s) WHERE id % 5 = 0),
m AS (SELECT s, t.id, h.other FROM t JOIN h USING (place)), w AS (SELECT m.s, m.id, x.pos, x.v AS own, o.v AS other FROM m JOIN e x ON x.id = m.id JOIN e o ON o.id = m.other AND o.pos = x.pos), gr AS (SELECT unnest(range(0, 4)) AS g),
dd AS (SELECT g, s, w.id, c.y AS cy, sum(((CASE WHEN w.pos // 16 = g THEN other ELSE own END) - m) ** 2) AS a FROM w JOIN c ON w.pos = c.pos, gr GROUP BY ALL), pp AS (SELECT 'g' || g AS grp, s, dd.id, arg_min(cy, {{'d': a, 'y': cy}}) AS yp FROM dd GROUP BY ALL),
al AS (SELECT grp, s, pp.id, r.y, yp FROM pp JOIN r USING (id) UNION ALL SELECT '', -1, id, y, yp FROM p0), re AS (SELECT grp, s, y, avg(CAST(y = yp AS DOUBLE)) AS f, avg(CAST(y = yp AS DOUBLE)) FILTER (id % 3 = 0) AS o FROM al GROUP BY ALL),
ru AS (SELECT grp, s, avg(f) AS f, avg(o) AS o FROM re GROUP BY ALL), me AS (SELECT grp, avg(f) AS f, avg(o) AS o FROM ru GROUP BY grp)
SELECT x.grp AS "group", round(b.f - x.f, 6) AS full_drop, round(b.o - x.o, 6) AS gold_drop FROM me x, me b WHERE b.grp = '' AND x.grp <> ''""")
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _fold(spark, sf_dir)
    return rounded(P.permutation_importance(test, P.centroids(train), GROUPS, PERMUTATIONS, gold()), "full_drop", "gold_drop")


@query(E_SQL + """, c AS (SELECT y, pos, avg(v) AS m FROM e WHERE id % 5 <> 0 GROUP BY ALL), g AS (SELECT unnest(range(-1, 4)) AS g), d AS (SELECT g, e.id, e.y, c.y AS cy, sum((v - m) ** 2) AS a FROM e JOIN c ON e.pos = c.pos, g WHERE id % 5 = 0 AND id % 3 = 0 AND e.pos // 16 <> g GROUP BY ALL),
p AS (SELECT g, id, y, arg_min(cy, {'d': a, 'y': cy}) AS yp FROM d GROUP BY ALL), h AS (SELECT g, y, avg(CAST(y = yp AS DOUBLE)) AS r FROM p GROUP BY ALL), b AS (SELECT g, avg(r) AS acc FROM h GROUP BY g)
SELECT 'g' || x.g AS "group", round(o.acc, 6) AS base_gold, round(x.acc, 6) AS ablated_gold, round(x.acc - o.acc, 6) AS gold_delta, x.acc - o.acc >= -0.005 AS passes FROM b x, b o WHERE o.g = -1 AND x.g >= 0""")
def group_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group of components left out, and the gate on what that costs."""
    return rounded(P.ablation(*_fold(spark, sf_dir), GROUPS, WIDTH, gold()), "base_gold", "ablated_gold", "gold_delta")


SHRINKAGES = [0.0, 0.25, 0.5]


@query(E_SQL + """, o AS (SELECT pos, avg(v) AS o FROM e WHERE id % 5 >= 2 GROUP BY pos), c AS (SELECT y, pos, avg(v) AS m FROM e WHERE id % 5 >= 2 GROUP BY ALL), k AS (SELECT unnest([0.0, 0.25, 0.5])::DOUBLE AS k), z AS (SELECT k, y, pos, m * (1 - k) + o * k AS m FROM c JOIN o USING (pos), k),
d AS (SELECT k, e.id, e.y, z.y AS cy, sum((v - m) ** 2) AS a FROM e JOIN z ON e.pos = z.pos WHERE id % 5 < 2 GROUP BY ALL), p AS (SELECT k, id % 5 AS fold, id, y, arg_min(cy, {'d': a, 'y': cy}) AS yp FROM d GROUP BY ALL), h AS (SELECT k, fold, y, avg(CAST(y = yp AS DOUBLE)) AS r FROM p GROUP BY ALL),
b AS (SELECT k, avg(r) FILTER (fold = 1) AS val, avg(r) FILTER (fold = 0) AS test FROM h GROUP BY k) SELECT k AS shrinkage, round(val, 6) AS val, round(test, 6) AS test, k = (SELECT arg_min(k, {'v': -val, 'k': k}) FROM b) AS chosen FROM b""")
def shrinkage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parameter chosen on the validation fold, scored on the test fold."""
    d = data(spark, sf_dir)
    fold = lambda c: d.where(f"id % 5 {c}")
    return rounded(P.searched(fold(">= 2"), fold("= 1"), fold("= 0"), SHRINKAGES), "val", "test")


DIST = "sqrt(list_sum([(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2 FOR i IN range(1, 65)]))"


@query(f"""WITH d AS (SELECT a.vec_id AS q, b.vec_id AS v, b.label AS l, {DIST} AS d FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND b.vec_id % 20 <> 0), n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, v) AS rn FROM d),
c AS (SELECT q, l, count(*) AS c FROM n WHERE rn <= 5 GROUP BY ALL) SELECT q AS "query", arg_min(l, {{'c': -c, 'l': l}}) AS y_pred FROM c GROUP BY q""")
def knn_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label that the five nearest training rows of a test row have most."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    train = e.where("vec_id % 20 <> 0")
    return E.vote(E.neighbours(e.where("vec_id % 20 = 0"), train, "vec_id", "embedding", 5), train, "vec_id", "label")

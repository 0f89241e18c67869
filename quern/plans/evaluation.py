"""Labels, metrics and data-quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators import ensembles as E
from quern.operators import metrics as M
from quern.operators import protocol as P
from quern.operators import relational as R
from quern.plans.common import Registry, table

REGISTRY = Registry()
query = REGISTRY.add


@query("SELECT CAST(2 * quality + toxic AS BIGINT) AS label_joint, CAST(quality = toxic AS INT) AS sa, count(*) AS n FROM labels GROUP BY ALL")
def label_joint_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "labels").select((2 * F.col("quality") + F.col("toxic")).cast("long").alias("label_joint"), (F.col("quality") == F.col("toxic")).cast("int").alias("sa"))
    return x.groupBy("label_joint", "sa").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN n_chars > 4000 THEN 1 WHEN n_chars > 800 THEN 0 END AS rule FROM documents)
SELECT d.doc_id, CASE WHEN quality IS NOT NULL AND rule IS NOT NULL AND quality <> rule THEN NULL ELSE coalesce(quality, rule) END AS label,
CASE WHEN quality IS NULL AND rule IS NULL THEN 'none' WHEN rule IS NULL THEN 'medium' WHEN quality IS NULL THEN 'low' WHEN quality = rule THEN 'high' ELSE 'conflict' END AS confidence
FROM d LEFT JOIN labels USING (doc_id)""")
def label_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of one label: agreement is high, a conflict nulls it, one alone is medium or low."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 4000, 1).when(F.col("n_chars") > 800, 0).alias("rule"))
    q, r = F.col("quality"), F.col("rule")
    label = F.when(q != r, F.lit(None)).otherwise(F.coalesce(q, r))
    how = F.when(q.isNull() & r.isNull(), "none").when(r.isNull(), "medium").when(q.isNull(), "low").when(q == r, "high").otherwise("conflict")
    return d.join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", label.cast("int").alias("label"), how.alias("confidence"))


#: A rule's predictions of four classes over line items, by ship year.
PRED_SQL = """WITH p AS (SELECT year(l_shipdate) AS y, l_orderkey * 10 + l_linenumber AS id,
  CAST(2 * CAST(l_returnflag <> 'N' AS INT) + CAST(l_linestatus = 'O' AS INT) AS INT) AS y_true,
  CAST(2 * CAST(l_quantity > 20 AS INT) + CAST(l_discount > 0.05 AS INT) AS INT) AS y_pred, l_quantity, l_discount, l_tax FROM lineitem)
"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = lambda c: c.cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").cast("long").alias("y"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        (2 * flag(F.col("l_returnflag") != "N") + flag(F.col("l_linestatus") == "O")).alias("y_true"), (2 * flag(F.col("l_quantity") > 20) + flag(F.col("l_discount") > 0.05)).alias("y_pred"), "l_quantity", "l_discount", "l_tax",
    )


@query(PRED_SQL + "SELECT t AS y_true, q AS y_pred, (SELECT count(*) FROM p WHERE y_true = t AND y_pred = q) AS n FROM (SELECT unnest([0, 1, 2, 3]) AS t), (SELECT unnest([0, 1, 2, 3]) AS q)")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion(predictions(spark, sf_dir), [0, 1, 2, 3])


BAL_SQL = PRED_SQL + ", r AS (SELECT y, y_true, avg(CAST(y_true = y_pred AS DOUBLE)) AS r, count(*) AS n FROM p GROUP BY ALL), b AS (SELECT y, avg(r) AS bal, sum(n) AS n FROM r GROUP BY y) "


@query(BAL_SQL + "SELECT CAST(y AS BIGINT) AS y, round(bal, 6) AS bal_acc FROM b")
def balanced_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.balanced_accuracy(predictions(spark, sf_dir), ["y"]).select("y", F.round("bal_acc", 6).alias("bal_acc"))


@query(PRED_SQL + """, k AS (SELECT y, unnest([0, 1, 2, 3]) AS k FROM (SELECT DISTINCT y FROM p)),
m AS (SELECT k.y, k.k, CAST(count(*) FILTER (y_true = k.k) AS DOUBLE) AS t, CAST(count(*) FILTER (y_pred = k.k) AS DOUBLE) AS q, CAST(count(*) FILTER (y_true = k.k AND y_pred = k.k) AS DOUBLE) AS c FROM k JOIN p ON p.y = k.y GROUP BY ALL),
s AS (SELECT y, sum(t) AS s, sum(c) AS c, sum(t * q) AS tp, sum(t * t) AS tt, sum(q * q) AS pp FROM m GROUP BY y)
SELECT CAST(y AS BIGINT) AS y, round(CASE WHEN (s * s - pp) * (s * s - tt) = 0 THEN 0 ELSE (c * s - tp) / sqrt((s * s - pp) * (s * s - tt)) END, 6) AS mcc FROM s""")
def mcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mcc(predictions(spark, sf_dir), ["y"]).select("y", F.round("mcc", 6).alias("mcc"))


PROBS = ["l_quantity", "l_discount * 400", "l_tax * 500", "25.0D"]


def with_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of four classes as a distribution."""
    s = predictions(spark, sf_dir).withColumn("s", F.array(*map(F.expr, PROBS)))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x)
    return s.withColumn("probs", F.transform("s", lambda x: x / total))


TOP_SQL = PRED_SQL + """, q AS (SELECT y, id, row_number() OVER () AS rid, y_true, [l_quantity, l_discount * 400, l_tax * 500, 25.0::DOUBLE] AS s FROM p),
z AS (SELECT y, id, rid, y_true, [x / (s[1] + s[2] + s[3] + s[4]) FOR x IN s] AS probs FROM q),
e AS (SELECT y, id, rid, y_true, k - 1 AS k, probs[k] AS pr FROM z, unnest([1, 2, 3, 4]) AS u(k)),
t AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY pr DESC, k) AS rn FROM e) """


@query(TOP_SQL + "SELECT CAST(y AS BIGINT) AS y, round(sum(CAST(rn <= 2 AND k = y_true AS DOUBLE)) / count(DISTINCT rid), 6) AS top2 FROM t GROUP BY y")
def top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.top2_accuracy(with_probs(spark, sf_dir), ["y"], "probs").select("y", F.round("top2", 6).alias("top2"))


@query(TOP_SQL + "SELECT id, y_true, CAST(k AS INT) AS y_pred FROM t WHERE rn = 1 AND pr > 0.45 AND k <> y_true")
def confident_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = with_probs(spark, sf_dir).withColumn("y_pred", (F.array_position("probs", F.array_max("probs")) - 1).cast("int"))
    return M.confident_errors(p, "probs", 0.45).select("id", "y_true", "y_pred")


@query(PRED_SQL + ", s AS (SELECT y, CAST(y_true // 2 = y_true % 2 AS INT) AS a, CAST(y_pred // 2 = y_pred % 2 AS INT) AS b FROM p), r AS (SELECT y, a, avg(CAST(a = b AS DOUBLE)) AS r FROM s GROUP BY ALL) SELECT CAST(y AS BIGINT) AS y, round(avg(r), 6) AS pair_acc FROM r GROUP BY y")
def pair_acc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.pair_accuracy(predictions(spark, sf_dir), ["y"]).select("y", F.round("pair_acc", 6).alias("pair_acc"))


@query(BAL_SQL + "SELECT CASE WHEN y % 2 = 0 THEN 'tscv' ELSE 'grouped' END AS family, round(avg(bal), 6) AS mean, round(stddev_samp(bal), 6) AS std_samp, round(stddev_pop(bal), 6) AS std_pop, round(sum(bal * n) / sum(n), 6) AS weighted_mean FROM b GROUP BY ALL")
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    folds = M.balanced_accuracy(p, ["y"]).join(p.groupBy("y").agg(F.count("*").alias("n")), "y").withColumn("family", F.when(F.col("y") % 2 == 0, "tscv").otherwise("grouped"))
    return M.fold_summary(folds, ["family"], "bal_acc", "n").select("family", *[F.round(c, 6).alias(c) for c in ("mean", "std_samp", "std_pop", "weighted_mean")])


PURITY_SQL = """WITH c AS (SELECT o_orderpriority, CAST(year(o_orderdate) AS BIGINT) AS y, o_orderstatus AS l, count(*) AS c FROM orders GROUP BY ALL),
t AS (SELECT o_orderpriority, y, CAST(sum(c) AS BIGINT) AS n, arg_min(l, {'k': -c, 'l': l}) AS mode_label, CAST(max(c) AS DOUBLE) / sum(c) AS purity, greatest(0, log2(sum(c)) - sum(c * log2(c)) / sum(c)) AS entropy FROM c GROUP BY ALL) """


def _purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.purity(table(spark, sf_dir, "orders").select("o_orderpriority", F.year("o_orderdate").cast("long").alias("y"), "o_orderstatus"), ["o_orderpriority", "y"], "o_orderstatus")


@query(PURITY_SQL + "SELECT o_orderpriority, y, n, mode_label, round(purity, 6) AS purity, round(entropy, 6) AS entropy FROM t")
def purity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _purity(spark, sf_dir).select("o_orderpriority", "y", "n", "mode_label", F.round("purity", 6).alias("purity"), F.round("entropy", 6).alias("entropy"))


@query(PURITY_SQL + "SELECT round(sum(purity * n) / sum(n), 6) AS weighted_purity FROM t")
def weighted_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.weighted_purity(_purity(spark, sf_dir)).select(F.round("weighted_purity", 6).alias("weighted_purity"))


@query(PURITY_SQL + "SELECT round(coalesce(sum(n) FILTER (n >= 400), 0) / sum(n), 6)::DOUBLE AS big_share, round(coalesce(sum(n) FILTER (n >= 400 AND purity >= 0.35), 0) / sum(n), 6)::DOUBLE AS pure_share FROM t")
def group_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.group_coverage(_purity(spark, sf_dir), 400, 0.35).select(F.round("big_share", 6).alias("big_share"), F.round("pure_share", 6).alias("pure_share"))


@query("WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n), 6)::DOUBLE AS weight FROM c")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.class_weights(table(spark, sf_dir, "embeddings"), "label").select("label", "n", F.round("weight", 6).alias("weight"))


@query("WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, n, round(n / sum(n) OVER (), 6)::DOUBLE AS share FROM c")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.frequency(table(spark, sf_dir, "events"), "event_type").select("event_type", "n", F.round("share", 6).alias("share"))


MODELS_SQL = """WITH m AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y_true, model, CASE model WHEN 'a' THEN o_orderkey % 3 WHEN 'b' THEN o_custkey % 3 ELSE CAST(substr(o_orderpriority, 1, 1) AS BIGINT) % 3 END AS y_pred FROM orders, (SELECT unnest(['a', 'b', 'c']) AS model)) """


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("*", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("model"))
    pred = F.when(F.col("model") == "a", F.col("o_orderkey") % 3).when(F.col("model") == "b", F.col("o_custkey") % 3).otherwise(F.substring("o_orderpriority", 1, 1).cast("long") % 3)
    return o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("y_true"), "model", pred.alias("y_pred"))


@query(MODELS_SQL + ", c AS (SELECT id, y_true, y_pred, count(*) AS c FROM m GROUP BY ALL) SELECT id, CAST(sum(c) AS BIGINT) AS n, arg_min(y_pred, {'k': -c, 'l': y_pred}) AS usual FROM c GROUP BY id HAVING bool_and(y_true <> y_pred)")
def always_wrong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.always_wrong(models(spark, sf_dir), "id")


@query(MODELS_SQL + "SELECT id, count(*) AS n FROM m GROUP BY id HAVING NOT bool_or(y_true = y_pred)")
def wrong_in_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.wrong_in_all(models(spark, sf_dir), "id")


@query(MODELS_SQL + ", r AS (SELECT id, bool_or(y_true = y_pred) FILTER (model = 'a') AS a, bool_or(y_true = y_pred) FILTER (model = 'b') AS b FROM m GROUP BY id) SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'only_a' WHEN b THEN 'only_b' ELSE 'neither' END AS kind, count(*) AS n FROM r GROUP BY ALL")
def model_complementarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.complementarity(models(spark, sf_dir), "id", "a", "b")


NULL_SEEDS = list(range(10))


@query("""WITH d AS (SELECT concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_returnflag AS f, l_extendedprice FROM lineitem), n AS (SELECT f, count(*) AS n FROM d GROUP BY f), c AS (SELECT f, sum(n) OVER (ORDER BY f) AS upto, sum(n) OVER (ORDER BY f) - n AS since FROM n),
s AS (SELECT s, l_extendedprice, row_number() OVER (PARTITION BY s ORDER BY substr(md5(CAST(s AS VARCHAR) || '|' || CAST(id AS VARCHAR)), 1, 15)) - 1 AS place FROM d, (SELECT unnest(range(0, 10)) AS s)),
h AS (SELECT s, f, avg(l_extendedprice) AS v FROM s JOIN c ON place >= since AND place < upto GROUP BY ALL), r AS (SELECT f, avg(l_extendedprice) AS v FROM d GROUP BY f)
SELECT h.f AS flag, round(avg(CAST(h.v >= r.v AS DOUBLE)), 6) AS p_value, round(quantile_cont(h.v, 0.75), 4) AS null_p75 FROM h JOIN r ON h.f = r.f GROUP BY ALL""")
def null_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each flag's mean price against those of runs with the flags dealt anew to all rows."""
    l = table(spark, sf_dir, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_returnflag").alias("flag"), "l_extendedprice")
    real = l.groupBy("flag").agg(F.avg("l_extendedprice").alias("v"))
    null = P.shuffled_labels(l, "id", "flag", NULL_SEEDS).groupBy(F.col("null_label").alias("flag"), "seed").agg(F.avg("l_extendedprice").alias("v"))
    return M.empirical_p(real, null, "flag", "v").select("flag", F.round("p_value", 6).alias("p_value"), F.round("null_p75", 4).alias("null_p75"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, round(avg(CAST((l_returnflag = 'N') = (l_linestatus = 'O') AS DOUBLE)), 6) AS agreement FROM lineitem")
def correlation_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = ((F.col("l_returnflag") == "N") == (F.col("l_linestatus") == "O")).cast("double")
    return table(spark, sf_dir, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.round(F.avg(same), 6).alias("agreement"))


@query("""WITH w AS (SELECT *, exp(-((l_extendedprice / 1e4) - min(l_extendedprice / 1e4) OVER (PARTITION BY l_orderkey)) / 0.5922) AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, round(e / sum(e) OVER (PARTITION BY l_orderkey), 6) AS weight FROM w""")
def boltzmann_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 1e4).alias("e"))
    return E.boltzmann(l, "l_orderkey", "e").select("l_orderkey", "l_linenumber", F.round("weight", 6).alias("weight"))


@query("""WITH m AS (SELECT l_suppkey, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS mu FROM lineitem GROUP BY ALL)
SELECT l_suppkey, round(any_value(mu), 4) AS mean, round(sqrt(sum(l_quantity * (l_extendedprice - mu) ** 2) / sum(l_quantity)), 4) AS std FROM lineitem JOIN m USING (l_suppkey) GROUP BY l_suppkey""")
def weighted_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.weighted_stats(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice", "l_quantity").select("l_suppkey", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


IMPUTE_SQL = """WITH n AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 <> 0 THEN l_quantity END AS q, CASE WHEN l_suppkey % 3 <> 0 THEN l_tax END AS t FROM lineitem) """


def _with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 5 != 0, F.col("l_quantity")).alias("q"), F.when(F.col("l_suppkey") % 3 != 0, F.col("l_tax")).alias("t"))


@query(IMPUTE_SQL + "SELECT l_orderkey, l_linenumber, coalesce(q, (SELECT median(q) FROM n)) AS q, coalesce(t, (SELECT median(t) FROM n)) AS t FROM n")
def median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.median_impute(_with_nulls(spark, sf_dir), ["q", "t"])


@query(IMPUTE_SQL + "SELECT 'q' AS \"column\", count(*) FILTER (q IS NULL) AS n_null FROM n UNION ALL SELECT 't', count(*) FILTER (t IS NULL) FROM n")
def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.null_counts(_with_nulls(spark, sf_dir).select("q", "t"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
ASSEMBLE_SQL = "WITH o AS (SELECT o_custkey, count(*) AS ord_n, sum(o_totalprice) AS ord_total FROM orders GROUP BY ALL), a AS (SELECT c_custkey AS row_id, c_acctbal AS acc_bal, coalesce(ord_n, 0) AS ord_n, coalesce(ord_total, 0) AS ord_total, " + ", ".join(f"CAST(c_mktsegment = '{s}' AS INT) AS seg_{s}" for s in SEGMENTS) + " FROM customer LEFT JOIN o ON c_custkey = o_custkey) "


def _assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    ordered = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("row_id")).agg(F.count("*").alias("ord_n"), F.sum("o_totalprice").alias("ord_total"))
    orders = c.select(F.col("c_custkey").alias("row_id")).join(ordered, "row_id", "left").fillna(0)
    own = c.select(F.col("c_custkey").alias("row_id"), F.col("c_acctbal").alias("acc_bal"))
    return R.assemble([own, orders, c.select(F.col("c_custkey").alias("row_id"), *R.one_hot(F.col("c_mktsegment"), SEGMENTS, "seg_"))], "row_id")


@query(ASSEMBLE_SQL + "SELECT row_id, acc_bal, ord_n, round(ord_total, 2) AS ord_total, " + ", ".join(f"seg_{s}" for s in SEGMENTS) + " FROM a")
def assemble_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assembled(spark, sf_dir).withColumn("ord_total", F.round("ord_total", 2))


@query(ASSEMBLE_SQL + "SELECT 'account' AS \"group\", 1::BIGINT AS n_columns, round(sum(abs(acc_bal)), 2) AS total FROM a UNION ALL SELECT 'orders', 2, round(sum(ord_n + ord_total), 2) FROM a UNION ALL SELECT 'segment', 5, CAST(sum(" + " + ".join(f"seg_{s}" for s in SEGMENTS) + ") AS DOUBLE) FROM a")
def prefix_group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = R.group_importance(_assembled(spark, sf_dir), {"account": ("acc_",), "orders": ("ord_",), "segment": ("seg_",)})
    return g.select("group", "n_columns", F.round("total", 2).alias("total"))


@query("SELECT o_custkey, o_orderkey, o_totalprice, CAST(rn AS INT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(w).alias("rn")).where("rn <= 3")


@query("(SELECT 'best' AS side, p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5) UNION ALL (SELECT 'worst', p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 5)")
def worst_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    side = lambda name, key: p.orderBy(key, "p_partkey").limit(5).select(F.lit(name).alias("side"), "p_partkey", "p_retailprice")
    return side("best", F.desc("p_retailprice")).unionByName(side("worst", F.asc("p_retailprice")))

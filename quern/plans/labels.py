"""Label queries: derived labels, sources and their reconciliation, recovery, flags and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import labels as L
from quern.functions import vectors as V
from quern.operators import ensembles as E
from quern.operators import metrics as M
from quern.operators import relational as R
from quern.plans.common import Registry, table

REGISTRY = Registry()
query = REGISTRY.add

#: Two axes and an independent sign of their agreement, each null for some documents.
AXES_SQL = """WITH x AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN quality END AS ca, CASE WHEN doc_id % 7 <> 0 THEN toxic END AS cb, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 2 = 0 END AS syn FROM labels) """


def axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    return table(spark, sf_dir, "labels").select("doc_id", F.when(n % 5 != 0, F.col("quality")).alias("ca"), F.when(n % 7 != 0, F.col("toxic")).alias("cb"), F.when(n % 3 != 0, n % 2 == 0).alias("syn"))


@query(AXES_SQL + "SELECT doc_id, CAST(ca = cb AS INT) AS sa, CAST(2 * ca + cb AS INT) AS joint, CAST(2 * ca + CAST(syn AS INT) AS INT) AS joint_sa FROM x")
def joint_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived labels; null where a part is."""
    ca, cb = F.col("ca"), F.col("cb")
    return axes(spark, sf_dir).select("doc_id", L.same(ca, cb).alias("sa"), L.joint(ca, cb).alias("joint"), L.joint(ca, F.col("syn").cast("int")).alias("joint_sa"))


@query(AXES_SQL + """, k AS (SELECT *, CASE WHEN ca IS NOT NULL AND cb IS NOT NULL THEN CASE WHEN syn IS NULL THEN 'medium' WHEN (ca = cb) = syn THEN 'high' ELSE 'conflict' END WHEN syn IS NOT NULL THEN 'low_optical_only' ELSE 'none' END AS confidence FROM x)
SELECT doc_id, CASE WHEN confidence IN ('high', 'medium') THEN ca END AS a, CASE WHEN confidence IN ('high', 'medium') THEN cb END AS b, confidence,
CASE confidence WHEN 'high' THEN 'cip+optical' WHEN 'medium' THEN 'cip_only' WHEN 'low_optical_only' THEN 'optical_only' ELSE confidence END AS source FROM k""")
def label_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return axes(spark, sf_dir).select("doc_id", L.reconciled(F.col("ca"), F.col("cb"), F.col("syn")).alias("r")).select("doc_id", "r.*")


@query("""WITH x AS (SELECT p_partkey AS n FROM part), t AS (SELECT n, CASE WHEN n % 3 <> 0 THEN n % 8 END AS ta, CASE WHEN n % 3 <> 0 THEN n % 5 END AS tb, CASE WHEN n % 2 = 0 THEN n % 8 + CAST(n % 11 = 0 AS INT) END AS ra, CASE WHEN n % 2 = 0 THEN n % 5 + CAST(n % 13 = 0 AS INT) END AS rb FROM x)
SELECT n AS p_partkey, coalesce(ta, ra) AS a, coalesce(tb, rb) AS b, CASE WHEN ta IS NOT NULL AND ra IS NOT NULL THEN CASE WHEN ta = ra AND tb = rb THEN 'high' ELSE 'low' END WHEN ta IS NULL AND ra IS NULL THEN 'failed' ELSE 'medium' END AS confidence FROM t""")
def mapping_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    template = F.when(n % 3 != 0, n % 8), F.when(n % 3 != 0, n % 5)
    mapper = F.when(n % 2 == 0, n % 8 + (n % 11 == 0).cast("int")), F.when(n % 2 == 0, n % 5 + (n % 13 == 0).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", L.located(template, mapper).alias("m")).select("p_partkey", "m.*")


@query("""SELECT d.doc_id, coalesce(quality, CASE WHEN n_chars > 4000 THEN 1 WHEN n_chars < 800 THEN 0 END) AS label,
CASE WHEN quality IS NOT NULL THEN 'given' WHEN n_chars > 4000 OR n_chars < 800 THEN 'recovered' ELSE 'none' END AS source FROM documents d LEFT JOIN labels USING (doc_id)""")
def label_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second rule for rows that are still without a label."""
    rule = F.when(F.col("n_chars") > 4000, 1).when(F.col("n_chars") < 800, 0)
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    source = F.when(F.col("quality").isNotNull(), "given").when(rule.isNotNull(), "recovered").otherwise("none")
    return d.select("doc_id", F.coalesce("quality", rule).alias("label"), source.alias("source"))


@query(AXES_SQL + "SELECT doc_id, CAST(CASE WHEN syn THEN ca ELSE 1 - ca END AS INT) AS cb, CAST(2 * ca + CASE WHEN syn THEN ca ELSE 1 - ca END AS INT) AS joint FROM x WHERE ca IS NOT NULL AND syn IS NOT NULL")
def factorised_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four classes from two heads: the first axis, and whether the axes agree."""
    x = axes(spark, sf_dir).where("ca IS NOT NULL AND syn IS NOT NULL")
    cb = L.other_axis(F.col("ca"), F.col("syn").cast("int"))
    return x.select("doc_id", cb.cast("int").alias("cb"), L.joint(F.col("ca"), cb).alias("joint"))


TYPES = {"is_metal": ("ECONOMY BRUSHED STEEL", "LARGE POLISHED STEEL", "SMALL PLATED COPPER"), "is_large": ("LARGE POLISHED STEEL",), "is_none": ("NO SUCH TYPE",)}


@query("SELECT p_partkey, " + ", ".join(f"CAST(coalesce(p_type IN ({', '.join(map(repr, v))}), false) AS INT) AS aux_{k}" for k, v in TYPES.items()) + ", p_size AS aux_size FROM part")
def membership_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags for fixed sets, all columns but the key renamed with a prefix, one block selected by it."""
    p = table(spark, sf_dir, "part").select("p_partkey", *R.flags(F.col("p_type"), TYPES), F.col("p_size").alias("size"))
    both = R.prefixed(p, "aux_", ("p_partkey",)).withColumn("other", F.lit(1))
    return R.select_prefixes(both, include=("aux_",), always=("p_partkey",))


@query("SELECT c_custkey, coalesce(n_name, 'nowhere') AS name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 1) ON c_nationkey = n_nationkey")
def dimension_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").where("n_nationkey % 4 <> 1").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("name"))
    return R.lookup(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), nation, "c_nationkey", "name", "nowhere").select("c_custkey", "name")


@query("""WITH a(key, w_z, w_e) AS (VALUES ('1-URGENT', 0.98, 0.02), ('2-HIGH', 0.9, 0.1)), b(key, w_z, w_e) AS (VALUES ('F', 0.95, 0.05), ('O', 0.7, 0.3))
SELECT o_orderkey, CAST(coalesce(a.w_z, b.w_z, 0.5) AS DOUBLE) AS w_z, round(CAST(coalesce(a.w_z, b.w_z, 0.5) * (o_totalprice / 1000) + coalesce(a.w_e, b.w_e, 0.5) * coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END, 0) AS DOUBLE), 7) AS blend
FROM orders LEFT JOIN a ON o_orderpriority = a.key LEFT JOIN b ON o_orderstatus = b.key""")
def two_level_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights by one key, else by another, else even; then a weighted blend in which null counts as 0."""
    pair = "struct<w_z: double, w_e: double>"
    table_ = lambda name, rows: spark.createDataFrame(rows, f"{name} string, w {pair}")
    first = table_("o_orderpriority", [("1-URGENT", (0.98, 0.02)), ("2-HIGH", (0.9, 0.1))])
    second = table_("o_orderstatus", [("F", (0.95, 0.05)), ("O", (0.7, 0.3))])
    even = F.struct(F.lit(0.5).alias("w_z"), F.lit(0.5).alias("w_e"))
    o = R.cascade(table(spark, sf_dir, "orders"), [(first, "o_orderpriority"), (second, "o_orderstatus")], "w", even, "known")
    e = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey").cast("double"))
    return o.select("o_orderkey", "w.w_z", F.round(V.blend(F.col("o_totalprice") / 1000, e, F.col("w.w_z"), F.col("w.w_e")), 7).alias("blend"))


@query("SELECT o_orderkey, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'P'")
def attach_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata by key, one row for each or an error."""
    meta = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "n_name")
    return R.attach(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey"), meta, "o_custkey").select("o_orderkey", "c_mktsegment", "n_name")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM orders" for c in ("o_custkey", "o_orderstatus", "o_orderdate")))
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.distinct_counts(table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderdate"), ["o_custkey", "o_orderstatus", "o_orderdate"])


@query("WITH c AS (SELECT o_custkey, o_orderstatus AS s, count(*) AS c FROM orders GROUP BY ALL) SELECT o_custkey, arg_min(s, {'k': -c, 's': s}) AS majority FROM c GROUP BY o_custkey")
def majority_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.majority_class(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus")


@query("""SELECT o_custkey, coalesce(bool_and(o_totalprice > 60000) FILTER (o_orderstatus = 'F'), false) AND coalesce(bool_and(o_totalprice > 60000) FILTER (o_orderstatus = 'O'), false) AS "all" FROM orders GROUP BY o_custkey""")
def all_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a flag holds in every row of every axis."""
    return M.all_of(table(spark, sf_dir, "orders").withColumn("dear", F.col("o_totalprice") > 60000), "o_custkey", "o_orderstatus", "dear", ["F", "O"])


@query("SELECT doc_id, CAST((ca IS NULL) AS INT) + CAST((cb IS NULL) AS INT) + CAST((syn IS NULL) AS INT) AS n_null FROM (" + AXES_SQL + "SELECT * FROM x)")
def row_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.row_nulls(axes(spark, sf_dir), "doc_id", ["ca", "cb", "syn"])


@query("""WITH g AS (SELECT c_nationkey, c_mktsegment, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey), s AS (SELECT n_regionkey, c_mktsegment AS v, count(*) AS c FROM g GROUP BY ALL), m AS (SELECT n_regionkey, c_nationkey AS v, count(*) AS c FROM g GROUP BY ALL)
SELECT n_regionkey, CAST(sum(s.c) AS BIGINT) AS n, round(sum(s.c) / (SELECT count(*) FROM g), 6)::DOUBLE AS share, arg_min(s.v, {'k': -s.c, 'v': s.v}) AS mode_label, round(max(s.c) / sum(s.c), 6)::DOUBLE AS purity,
(SELECT arg_min(m.v, {'k': -m.c, 'v': m.v}) FROM m WHERE m.n_regionkey = s.n_regionkey) AS category, (SELECT round(max(m.c) / sum(m.c), 6)::DOUBLE FROM m WHERE m.n_regionkey = s.n_regionkey) AS category_share FROM s GROUP BY n_regionkey""")
def cluster_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as clusters: their segments as labels, their nations as categories."""
    g = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = M.cluster_profile(g, "n_regionkey", "c_mktsegment", "c_nationkey")
    return out.select("n_regionkey", "n", "mode_label", "category", *[F.round(c, 6).alias(c) for c in ("share", "purity", "category_share")])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ALL ORDER BY n DESC, event_type LIMIT 3")
def most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.most_common(table(spark, sf_dir, "events"), "event_type", 3)


@query("""WITH t AS (SELECT *, CASE WHEN l_returnflag = 'A' AND l_quantity > 20 THEN 0 WHEN l_returnflag = 'A' THEN 1 WHEN abs(l_extendedprice - 30000) / 30000 < 0.2 THEN 2 ELSE 3 END AS tier FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(tier AS INT) AS tier FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY tier, l_extendedprice DESC, l_linenumber) AS rn FROM t) WHERE rn = 1""")
def best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item that meets the best tier, of several the dearest."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_quantity")
    tiers = [(F.col("l_returnflag") == "A") & (F.col("l_quantity") > 20), F.col("l_returnflag") == "A", F.abs(F.col("l_extendedprice") - 30000) / 30000 < 0.2]
    return R.best_of(l, ["l_orderkey"], tiers, [-F.col("l_extendedprice"), F.col("l_linenumber")]).select("l_orderkey", "l_linenumber", "l_extendedprice", "tier")


@query("SELECT l_orderkey, l_returnflag, l_extendedprice, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_extendedprice, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def lowest_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_extendedprice", "l_linenumber")
    return E.lowest(l, ["l_orderkey", "l_returnflag"], "l_extendedprice", "l_linenumber")


@query("""WITH e AS (SELECT *, exp(l_quantity / 5 - max(l_quantity / 5) OVER (PARTITION BY l_orderkey)) AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, round(e / sum(e) OVER (PARTITION BY l_orderkey), 6) AS share FROM e""")
def group_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return R.softmax(l, ["l_orderkey"], "l_quantity", 5.0).select("l_orderkey", "l_linenumber", F.round("share", 6).alias("share"))

"""Cleaning queries: audited filters, two-pass predicates, blacklists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import parse
from quern.operators import audit
from quern.operators import relational as R
from quern.plans.common import Registry, table
from quern.sources import tables

REGISTRY = Registry()
query = REGISTRY.add


def order_rules() -> list[audit.Rule]:
    """Rules over ``orders``, in the order they apply."""
    return [
        audit.Rule("01_missing_key", "missing customer", F.col("o_custkey").isNull() | (F.trim(F.coalesce("o_orderstatus", F.lit(""))) == "")),
        audit.Rule("02_status", "pending status", F.col("o_orderstatus") == "P"),
        audit.Rule("03_priority", "unspecified priority", F.lower(F.coalesce("o_orderpriority", F.lit(""))).contains("not specified")),
        audit.Rule("04_price", "price under 10000", F.col("o_totalprice") < 10000),
        audit.Rule("05_year", "ordered before 1996", F.year("o_orderdate") < 1996),
    ]


RULES_SQL = """
WITH a AS (SELECT *, CASE
  WHEN o_custkey IS NULL OR trim(coalesce(o_orderstatus, '')) = '' THEN 1
  WHEN o_orderstatus = 'P' THEN 2
  WHEN lower(coalesce(o_orderpriority, '')) LIKE '%not specified%' THEN 3
  WHEN o_totalprice < 10000 THEN 4
  WHEN year(o_orderdate) < 1996 THEN 5 END AS n FROM orders),
s(step_no, step, reason) AS (VALUES (1, '01_missing_key', 'missing customer'), (2, '02_status', 'pending status'),
  (3, '03_priority', 'unspecified priority'), (4, '04_price', 'price under 10000'), (5, '05_year', 'ordered before 1996'))
"""


@query(
    RULES_SQL
    + """, c AS (SELECT s.step_no, s.step, (SELECT count(*) FROM a WHERE a.n = s.step_no) AS dropped, (SELECT count(*) FROM a) AS total FROM s),
o AS (SELECT *, total - sum(dropped) OVER (ORDER BY step_no) AS rows_out FROM c),
i AS (SELECT *, coalesce(lag(rows_out) OVER (ORDER BY step_no), total) AS rows_in FROM o)
SELECT CAST(step_no AS BIGINT) AS step_no, step, CAST(rows_in AS BIGINT) AS rows_in, CAST(rows_out AS BIGINT) AS rows_out, CAST(dropped AS BIGINT) AS dropped,
  CAST(CASE WHEN rows_in = 0 THEN 0 ELSE round(dropped * 100.0 / rows_in, 4) END AS DOUBLE) AS pct_dropped FROM i"""
)
def clean_audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = order_rules()
    return audit.step_summary(audit.with_reasons(table(spark, sf_dir, "orders"), rules), rules)


@query(RULES_SQL + "SELECT s.step, a.o_orderkey AS row_id, s.reason FROM a JOIN s ON a.n = s.step_no")
def clean_row_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.row_audit(audit.with_reasons(table(spark, sf_dir, "orders"), order_rules()), "o_orderkey")


@query(r"""SELECT doc_id, CASE WHEN k THEN 'keyword' ELSE 'structure' END AS how FROM (SELECT doc_id, text,
  (lower(coalesce(text, '')) LIKE '%licensed under%' OR lower(coalesce(text, '')) LIKE '%all rights reserved%' OR lower(coalesce(source, '')) LIKE '%src1') AS k FROM documents)
  WHERE k OR regexp_matches(coalesce(text, ''), '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')""")
def two_pass_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords in either of two columns, or, for rows without one only, a structural test."""
    text = F.lower(F.coalesce("text", F.lit("")))
    keyword = text.contains("licensed under") | text.contains("all rights reserved") | F.lower(F.coalesce("source", F.lit(""))).endswith("src1")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", keyword.alias("k"))
    structure = F.coalesce("text", F.lit("")).rlike(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}")
    return d.select("doc_id", F.when(F.col("k"), "keyword").when(structure, "structure").alias("how")).where("how IS NOT NULL")


BLACKLIST = ["idiot", "scum", "token =", "licensed under", "$$$"]


@query("""SELECT doc_id FROM documents WHERE NOT (""" + " OR ".join(f"contains(lower(concat_ws(' ', text, source)), '{w}')" for w in BLACKLIST) + ")")
def blacklist_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(~parse.contains_any(F.concat_ws(" ", "text", "source"), BLACKLIST)).select("doc_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))")
def membership_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of some priorities (a fixed list) whose customer is in some segments (a semi join)."""
    customers = table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    o = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_custkey")
    return o.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_semi")


@query("""SELECT user_id, event_type, CAST(epoch_ms(date_trunc('day', ts)) AS BIGINT) AS day, min(event_id) AS event_id, CAST(min_by(value, event_id) AS DOUBLE) AS value FROM events GROUP BY ALL""")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.unix_millis(F.date_trunc("day", "ts")).alias("day"), "event_id", "value")
    return R.keep_first(e, ["user_id", "event_type", "day"], "event_id")


@query("""WITH k AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) || '||' || CAST(l_suppkey AS VARCHAR) AS key FROM lineitem)
SELECT key, CAST(dense_rank() OVER (ORDER BY key) - 1 AS BIGINT) AS group_id FROM k""")
def substrate_group_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = parse.composite_key(F.col("l_partkey"), F.col("l_suppkey"))
    return R.group_ids(table(spark, sf_dir, "lineitem").select(key.alias("key")), "key")


@query("""WITH c AS (SELECT l_partkey, l_suppkey, min(l_returnflag) AS lo, max(l_returnflag) AS hi FROM lineitem GROUP BY ALL),
k AS (SELECT l_partkey, min(lo) AS klo, max(hi) AS khi FROM c GROUP BY ALL)
SELECT l_partkey, l_suppkey, CASE WHEN lo <> hi THEN 'A' WHEN klo <> khi THEN 'B' ELSE 'none' END AS kind FROM c JOIN k USING (l_partkey)""")
def contradiction_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.contradictions(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", "l_returnflag")


CUTOFFS = [(1996, 1997, 1998), (1997, 1998, 1999), (1998, 1999, 2000), (1999, 2000, 2001), (2000, 2001, 2002)]


@query("""WITH c(split_name, a, b, c) AS (VALUES """ + ", ".join(f"('tscv_fold{i}', {a}, {b}, {c})" for i, (a, b, c) in enumerate(CUTOFFS, 1)) + """),
y AS (SELECT o_orderkey AS row_id, year(o_orderdate) AS y FROM orders),
r AS (SELECT split_name, row_id, CASE WHEN y <= a THEN 'train' WHEN y <= b THEN 'val' WHEN y >= c THEN 'test' END AS role FROM y, c)
SELECT split_name, row_id, role FROM r WHERE role IS NOT NULL AND split_name IN (SELECT split_name FROM r WHERE role IS NOT NULL GROUP BY 1 HAVING count(DISTINCT role) = 3)""")
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fold has no test year and is dropped."""
    return R.temporal_split(table(spark, sf_dir, "orders"), "o_orderkey", F.year("o_orderdate"), CUTOFFS)


SEEDS = [1, 2, 3, 4, 5]


def group_sql(key: str, name: str, seeds: list[int], val: float) -> str:
    return f"""WITH s AS (SELECT seed, o_orderkey AS row_id, {key} AS g,
  CAST(('0x' || substr(md5(CAST(seed AS VARCHAR) || '|' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0 AS p FROM orders, (SELECT unnest({seeds}) AS seed)),
r AS (SELECT '{name}' || seed AS split_name, row_id, g, CASE WHEN p < 0.2 THEN 'test' WHEN p < 0.2 + 0.8 * {val} THEN 'val' ELSE 'train' END AS role FROM s)
"""


GROUP_SQL = group_sql("o_custkey", "grouped_seed", SEEDS, 0.125)
REPORT_SQL = """, a AS (SELECT split_name, row_id, count(DISTINCT role) AS n FROM r GROUP BY ALL),
g AS (SELECT split_name, g, max(CAST(role = 'train' AS INT)) * max(CAST(role = 'test' AS INT)) AS shared FROM r GROUP BY ALL)
SELECT split_name, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(CAST(n > 1 AS INT)) AS BIGINT) AS overlapping,
  (SELECT CAST(sum(shared) AS BIGINT) FROM g WHERE g.split_name = a.split_name) AS shared_groups FROM a GROUP BY split_name"""


def _group_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.group_split(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", SEEDS)


@query(GROUP_SQL + "SELECT split_name, row_id, role FROM r")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _group_splits(spark, sf_dir).select("split_name", "row_id", "role")


def exact_sql(rows: str, key: str, row_id: str, seeds: list[int]) -> str:
    """Groups ranked by the hash of (seed, group); the first ceil(n / 5) test, the next ceil(m / 8) of the m others val."""
    place = "substr(md5(CAST(seed AS VARCHAR) || '|' || g), 1, 15)"
    return f"""WITH d AS (SELECT {row_id} AS row_id, coalesce(CAST({key} AS VARCHAR), '') AS g FROM {rows}), o AS (SELECT g, seed, row_number() OVER (PARTITION BY seed ORDER BY {place}) AS k, count(*) OVER (PARTITION BY seed) AS n
  FROM (SELECT DISTINCT g FROM d), (SELECT unnest({seeds}) AS seed)),
c AS (SELECT *, (n + 4) // 5 AS t FROM o)
SELECT 'exact_seed' || seed AS split_name, row_id, CASE WHEN k <= t THEN 'test' WHEN k <= t + (n - t + 7) // 8 THEN 'val' ELSE 'train' END AS role FROM d JOIN c USING (g)"""


@query(exact_sql("documents", "coalesce(lang, '') || '/' || coalesce(source, '') || '/' || coalesce(n_chars, 0) // 50", "doc_id", SEEDS))
def exact_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a language, source and length class stay together; exact shares of groups for every seed."""
    length = F.floor(F.coalesce("n_chars", F.lit(0)) / 50).cast("string")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")), length).alias("g"))
    return R.exact_group_split(d, "doc_id", "g", SEEDS).select("split_name", "row_id", "role")


@query(group_sql("strftime(o_orderdate, '%Y%m') || o_orderpriority", "scaffold", [42], 0.15 / 0.8) + "SELECT split_name, row_id, role FROM r")
def scaffold_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a derived structure in place of a group id: here the month and priority."""
    o = table(spark, sf_dir, "orders").withColumn("scaffold", F.concat(F.date_format("o_orderdate", "yyyyMM"), "o_orderpriority"))
    return R.group_split(o, "o_orderkey", "scaffold", [42], val=0.15 / 0.8, name="scaffold").select("split_name", "row_id", "role")


@query(GROUP_SQL + REPORT_SQL)
def split_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.split_report(_group_splits(spark, sf_dir))


@query(GROUP_SQL + """SELECT split_name, row_id, role FROM r JOIN orders ON row_id = o_orderkey
WHERE o_orderstatus <> 'P' AND o_totalprice > 50000 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def masked_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold rows that are valid, in scope and gold."""
    gold = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") > 0).alias("gold"))
    o = table(spark, sf_dir, "orders").join(gold, "o_custkey", "left")
    rows = o.select(F.col("o_orderkey").alias("row_id"), (F.col("o_orderstatus") != "P").alias("valid"), (F.col("o_totalprice") > 50000).alias("scope"), "gold")
    return R.masked(_group_splits(spark, sf_dir), rows, ["valid", "scope", "gold"]).select("split_name", "row_id", "role")


@query("SELECT o_custkey, count(*) AS n, CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS classes FROM orders GROUP BY ALL HAVING count(*) >= 10 AND count(DISTINCT o_orderstatus) >= 2")
def support_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.supported(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", rows=10)


@query("""SELECT o_orderkey AS row_id, CASE WHEN row_number() OVER (ORDER BY o_orderkey) > count(*) OVER () - greatest(1, count(*) OVER () // 10) THEN 'val' ELSE 'train' END AS role FROM orders""")
def validation_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.validation_tail(table(spark, sf_dir, "orders"), "o_orderkey")


@query("""WITH q AS (SELECT quantile_cont(o_orderkey, 0.25) AS a, quantile_cont(o_orderkey, 0.5) AS b, quantile_cont(o_orderkey, 0.75) AS c FROM orders),
p AS (SELECT o_orderkey AS row_id, CAST(a < o_orderkey AS INT) + CAST(b < o_orderkey AS INT) + CAST(c < o_orderkey AS INT) AS part FROM orders, q)
SELECT 'fold' || f AS split_name, row_id, CASE WHEN part = f THEN 'test' ELSE 'train' END AS role FROM p, (SELECT unnest([1, 2, 3]) AS f) WHERE part <= f""")
def sequential_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sequential_folds(table(spark, sf_dir, "orders"), "o_orderkey", 3)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def incremental_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache of labelled ids leaves to compute."""
    return tables.missing_keys(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT doc_id, quality, toxic FROM labels WHERE toxic = 0 UNION ALL SELECT doc_id, 9 AS quality, toxic FROM labels WHERE toxic = 1""")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "labels")
    return tables.upsert(old, old.where("toxic = 1").withColumn("quality", F.lit(9)), ["doc_id"])

"""Mixing sources to target weights, in DataFrame functions only.

Each row gets a hash-random key (MD5 of its doc_id). A source's rows are range-sorted by that key:
the key's leading bits name one of 4096 ranges, whose sizes are summed first, so that a running sum
over at most 4096 range totals of a source, plus one inside each range, gives every row's distributed
prefix sum of sizes. The source's budget then cuts that order exactly: whole epochs for all of its
rows, one more pass up to the cut, and the row at the cut in part. A hot source spreads over its
ranges, so no task holds a source.

Defined results: null text has size 0; null sources are one source, last; rows with equal keys are
ordered by doc_id and size, so reruns agree; an empty table gives no rows; an all-empty corpus has
targets and takes of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.work import WORD, free, save

RANGE_HEX = 3


def text_size(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(per_source: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """source, source_size → weight and target: shares by weight, held at ``most`` times the source's size, the excess reshared.

    The fixed point is a water level L with target = min(most * size, L * weight). Sources sorted by
    most * size / weight are held one after another. Holding a source below the level of the rest
    raises that level, holding one above it lowers it, so the level is the largest met on the way.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long")
    s = per_source.select("source", "source_size", weight.alias("weight"))
    s = s.withColumn("cap", F.col("source_size") * most)
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = (
        s.withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("rest_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level_here", F.col("rest") / F.col("rest_weight"))
    )
    s = s.withColumn("level", F.max("level_here").over(everything))
    return s.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def mix(df: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and the row's whole epochs and words of the last pass."""
    key = _key(F.col("doc_id"))
    base = save(df.select("doc_id", "source", text_size(F.col("text")).alias("size"), key.alias("key"), F.substring(key, 1, RANGE_HEX).alias("range")), "mix")
    ranges = base.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    up = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("source", "range", F.coalesce(F.sum("range_size").over(up), F.lit(0)).alias("base"))
    goal = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    goal = goal.withColumn("budget", F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * most))
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))).withColumn("left", F.col("budget") - F.col("epochs") * F.col("source_size"))
    plan = ranges.alias("r").join(goal.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source"))).select("r.source", "range", "base", "source_size", "target", "epochs", "left")
    rows = base.alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source")) & (F.col("b.range") == F.col("p.range"))).select("b.*", "p.base", "source_size", "target", "epochs", "left")
    inside = W.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("start")))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).alias("taken"), "epochs", last.alias("last_pass"), (F.col("start") < F.col("left")).alias("in_last_pass"))


def mixed_documents(df: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """The mix as rows of ``df``: a row for each epoch that takes it, the row at the cut whole.

    Of each source only its whole epochs and the key at which its last pass is cut are joined to the rows,
    so no text is moved while that table is small enough for Spark to broadcast it. Rows of size 0 count as
    taken once for each whole epoch and stay in the last pass if they lie before the cut. Rows with the
    same source and doc_id share one plan.
    """
    cut = F.max(F.when(F.col("in_last_pass"), _key(F.col("doc_id"))))
    plan = mix(df, weights, most).groupBy("source").agg(F.max("epochs").alias("epochs"), cut.alias("cut"))
    name = {x: free(df, f"__{x}") for x in ("source", "epochs", "cut", "epoch")}
    plan = save(plan, "plan").select(*[F.col(x).alias(name[x]) for x in ("source", "epochs", "cut")])
    out = df.join(plan, df["source"].eqNullSafe(plan[name["source"]]))
    times = F.col(name["epochs"]) + F.coalesce((_key(F.col("doc_id")) <= F.col(name["cut"])).cast("int"), F.lit(0))
    out = out.where(times > 0).withColumn(name["epoch"], F.explode(F.sequence(F.lit(1), times.cast("int"))))
    return out.select(*[f"`{c}`" for c in df.columns])


#: DuckDB SQL for the columns of the query.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap,
        CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
r AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS DOUBLE)
        / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS here
      FROM w WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max(here) AS level FROM r),
g AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), level * weight) AS target FROM r, l),
b AS (SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), 3 * source_size) AS budget FROM g),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b),
x AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.budget - e.epochs * e.source_size AS remaining,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, remaining - start)) AS BIGINT) AS taken
FROM x
"""

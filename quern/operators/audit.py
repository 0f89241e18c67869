"""Row-audited filtering: every dropped row keeps the step and reason it was dropped for.

Rules are evaluated once, in order, into two columns; the first rule that applies wins. The kept rows
are those with no reason, so keeping, listing and summing up the drops read the same projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Rows where ``drop`` is true leave at ``step`` for ``reason``; null counts as false."""

    step: str
    reason: str
    drop: Column


def with_reasons(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds drop_order (1-based, null if kept), drop_step and drop_reason."""
    order = step = reason = None
    for i, r in enumerate(rules, 1):
        hit = F.coalesce(r.drop, F.lit(False))
        order = F.when(hit, F.lit(i)) if order is None else order.when(hit, F.lit(i))
        step = F.when(hit, F.lit(r.step)) if step is None else step.when(hit, F.lit(r.step))
        reason = F.when(hit, F.lit(r.reason)) if reason is None else reason.when(hit, F.lit(r.reason))
    return df.withColumns({"drop_order": order, "drop_step": step, "drop_reason": reason})


def kept(audited: DataFrame) -> DataFrame:
    return audited.where("drop_order IS NULL").drop("drop_order", "drop_step", "drop_reason")


def row_audit(audited: DataFrame, row_id: str) -> DataFrame:
    """step, row_id, reason of every dropped row."""
    return audited.where("drop_order IS NOT NULL").select(F.col("drop_step").alias("step"), F.col(row_id).cast("long").alias("row_id"), F.col("drop_reason").alias("reason"))


def step_summary(audited: DataFrame, rules: list[Rule]) -> DataFrame:
    """step_no, step, rows_in, rows_out, dropped, pct_dropped of each step, chained on the step before.

    One pass over the data: a conditional count for each rule, unpivoted to a row for each step.
    """
    counts = audited.agg(F.count("*").alias("total"), *[F.count(F.when(F.col("drop_order") == i, 1)).alias(f"d{i}") for i in range(1, len(rules) + 1)])
    steps = counts.select("total", F.explode(F.array(*[F.struct(F.lit(i).alias("step_no"), F.lit(r.step).alias("step"), F.col(f"d{i}").alias("dropped")) for i, r in enumerate(rules, 1)])).alias("s")).select("total", "s.*")
    so_far = F.sum("dropped").over(W.orderBy("step_no"))
    steps = steps.withColumn("rows_out", F.col("total") - so_far)
    steps = steps.withColumn("rows_in", F.coalesce(F.lag("rows_out").over(W.orderBy("step_no")), F.col("total")))
    pct = F.when(F.col("rows_in") == 0, F.lit(0.0)).otherwise(F.round(F.col("dropped") * 100.0 / F.col("rows_in"), 4))
    return steps.select(F.col("step_no").cast("long").alias("step_no"), "step", F.col("rows_in").cast("long"), F.col("rows_out").cast("long"), F.col("dropped").cast("long"), pct.cast("double").alias("pct_dropped"))

"""Evaluation and data-quality operators over (label, prediction) tables: two-level aggregates, no collected groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def confusion(p: DataFrame, labels: list[int]) -> DataFrame:
    """y_true, y_pred, n for every pair of labels, zeros included."""
    spark = p.sparkSession
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, labels))).alias("y_true")).select("y_true", F.explode(F.array(*map(F.lit, labels))).alias("y_pred"))
    counts = p.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    return grid.join(counts, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("n"))


def balanced_accuracy(p: DataFrame, by: list[str]) -> DataFrame:
    """Mean recall over the classes present."""
    recall = p.groupBy(*by, "y_true").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("r"))
    return recall.groupBy(*by).agg(F.avg("r").alias("bal_acc"))


def mcc(p: DataFrame, by: list[str]) -> DataFrame:
    """Multiclass Matthews correlation from the marginals; 0 where undefined."""
    cells = p.groupBy(*by, "y_true", "y_pred").agg(F.count("*").cast("double").alias("n"))
    long = cells.select(*by, "n", (F.col("y_true") == F.col("y_pred")).cast("double").alias("hit"), F.explode(F.array(F.struct(F.col("y_true").alias("k"), F.lit(1.0).alias("t")), F.struct(F.col("y_pred").alias("k"), F.lit(0.0).alias("t")))).alias("s"))
    per = long.groupBy(*by, "s.k").agg(F.sum(F.col("n") * F.col("s.t")).alias("t"), F.sum(F.col("n") * (1 - F.col("s.t"))).alias("p"), F.sum(F.col("n") * F.col("s.t") * F.col("hit")).alias("c"))
    s = per.groupBy(*by).agg(F.sum("t").alias("s"), F.sum("c").alias("c"), F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("p") * F.col("p")).alias("pp"))
    den = F.sqrt((F.col("s") * F.col("s") - F.col("pp")) * (F.col("s") * F.col("s") - F.col("tt")))
    return s.select(*by, F.when(den == 0, F.lit(0.0)).otherwise((F.col("c") * F.col("s") - F.col("tp")) / den).alias("mcc"))


def top2_accuracy(p: DataFrame, by: list[str], probs: str) -> DataFrame:
    """Share of rows whose label is among the two likeliest classes; ties to the smaller class."""
    ranked = F.slice(F.array_sort(F.transform(F.col(probs), lambda x, i: F.struct((-x).alias("p"), i.alias("k")))), 1, 2)
    return p.groupBy(*by).agg(F.avg(F.exists(ranked, lambda r: r["k"] == F.col("y_true")).cast("double")).alias("top2"))


def pair_accuracy(p: DataFrame, by: list[str]) -> DataFrame:
    """Balanced accuracy of four classes 2a + b folded to a == b."""
    same = lambda c: (F.floor(F.col(c) / 2) == F.col(c) % 2).cast("int")
    return balanced_accuracy(p.select(*by, same("y_true").alias("y_true"), same("y_pred").alias("y_pred")), by).withColumnRenamed("bal_acc", "pair_acc")


def fold_summary(folds: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Mean, sample and population std and weighted mean of a metric over folds."""
    return folds.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std_samp"), F.stddev_pop(value).alias("std_pop"), (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("weighted_mean"))


def purity(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """Of each group, nulls kept: n, the commonest label (ties to the smallest), its share, Shannon entropy in bits."""
    c = df.groupBy(*by, label).agg(F.count("*").alias("c"))
    agg = c.groupBy(*by).agg(F.sum("c").alias("n"), F.min(F.struct((-F.col("c")).alias("k"), F.col(label).alias("l"))).alias("m"), F.sum(F.col("c") * F.log2("c")).alias("e"))
    return agg.select(*by, "n", F.col("m.l").alias("mode_label"), (-F.col("m.k") / F.col("n")).alias("purity"), F.greatest(F.lit(0.0), F.log2("n") - F.col("e") / F.col("n")).alias("entropy"))


def weighted_purity(table: DataFrame) -> DataFrame:
    return table.agg((F.sum(F.col("purity") * F.col("n")) / F.sum("n")).alias("weighted_purity"))


def group_coverage(table: DataFrame, least: int = 10, pure: float = 0.85) -> DataFrame:
    """Shares of rows in groups of at least ``least`` rows, and in those of them that are pure."""
    big = F.col("n") >= least
    share = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)) / F.sum("n")
    return table.agg(share(big).alias("big_share"), share(big & (F.col("purity") >= pure)).alias("pure_share"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """label, n, weight = rows / (classes * n)."""
    c = df.groupBy(label).agg(F.count("*").alias("n"))
    every = W.partitionBy()
    return c.select(label, "n", (F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))).alias("weight"))


def always_wrong(p: DataFrame, row: str) -> DataFrame:
    """Rows that every prediction misses: how often predicted, and the commonest wrong one (ties to the smallest)."""
    c = p.groupBy(row, "y_true", "y_pred").agg(F.count("*").alias("c"))
    g = c.groupBy(row).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("y_true") != F.col("y_pred"), F.col("c")).otherwise(0)).alias("wrong"), F.min(F.struct((-F.col("c")).alias("k"), F.col("y_pred").alias("l"))).alias("m"))
    return g.where("wrong = n").select(row, "n", F.col("m.l").alias("usual"))


def wrong_in_all(p: DataFrame, row: str) -> DataFrame:
    """Rows that no model gets right, and how many tried."""
    return p.groupBy(row).agg(F.count("*").alias("n"), F.bool_or(F.col("y_true") == F.col("y_pred")).alias("hit")).where("NOT hit").select(row, "n")


def majority_class(p: DataFrame, by: list[str], label: str) -> DataFrame:
    """The commonest label of each group, ties to the smallest."""
    c = p.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("c"))
    return c.groupBy(*by).agg(F.min(F.struct((-F.col("c")).alias("k"), F.col(label).alias("l"))).alias("m")).select(*by, F.col("m.l").alias("majority"))


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """column, n_distinct of each column, nulls left out; exact."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("s")).select("s.*")
    return long.where("value IS NOT NULL").distinct().groupBy("column").agg(F.count("*").alias("n_distinct"))


def all_of(df: DataFrame, key: str, axis: str, flag: str, axes: list) -> DataFrame:
    """key, all: whether the flag holds on every axis; an axis without a row counts as false."""
    held = [F.coalesce(F.bool_and(F.when(F.col(axis) == a, F.col(flag))), F.lit(False)) for a in axes]
    out = held[0]
    for h in held[1:]:
        out = out & h
    return df.groupBy(key).agg(out.alias("all"))


def cluster_profile(df: DataFrame, cluster: str, label: str, category: str) -> DataFrame:
    """Of each cluster: n, share of all rows, commonest label and its purity, commonest category and its share."""
    labels = purity(df, [cluster], label).select(cluster, "n", "mode_label", "purity")
    common = purity(df, [cluster], category).select(cluster, F.col("mode_label").alias("category"), F.col("purity").alias("category_share"))
    every = W.partitionBy()
    return labels.join(common, cluster).withColumn("share", F.col("n") / F.sum("n").over(every))


def most_common(df: DataFrame, by: str, k: int) -> DataFrame:
    """The k commonest values, ties to the smallest."""
    return df.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(k)


def complementarity(p: DataFrame, row: str, a: str, b: str) -> DataFrame:
    """Rows that both models, only a, only b, neither get right."""
    hit = (F.col("y_true") == F.col("y_pred")).cast("int")
    r = p.groupBy(row).agg(F.max(F.when(F.col("model") == a, hit)).alias("a"), F.max(F.when(F.col("model") == b, hit)).alias("b")).dropna()
    kind = F.when((F.col("a") == 1) & (F.col("b") == 1), "both").when(F.col("a") == 1, "only_a").when(F.col("b") == 1, "only_b").otherwise("neither")
    return r.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def empirical_p(real: DataFrame, null: DataFrame, key: str, value: str) -> DataFrame:
    """Share of null values at least as large as the real one, and the null's 75th percentile."""
    j = null.select(key, F.col(value).alias("__n")).join(real.select(key, F.col(value).alias("__r")), key)
    return j.groupBy(key).agg(F.avg((F.col("__n") >= F.col("__r")).cast("double")).alias("p_value"), F.percentile("__n", 0.75).alias("null_p75"))


def frequency(df: DataFrame, by: str) -> DataFrame:
    """Value, n, share; null is a value."""
    c = df.groupBy(by).agg(F.count("*").alias("n"))
    return c.select(by, "n", (F.col("n") / F.sum("n").over(W.partitionBy())).alias("share"))


def confident_errors(p: DataFrame, probs: str, over: float = 0.8) -> DataFrame:
    return p.where((F.array_max(probs) > over) & (F.col("y_true") != F.col("y_pred")))

"""Model queries over MLlib: fits run distributed; folds and stages are DataFrames. No SQL can stand beside them."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import metrics as M
from quern.plans.common import Registry, table

REGISTRY = Registry()
query = REGISTRY.add
SEED = 42


def data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, y, x and a fold in 0..4 by hash."""
    e = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL AND label IS NOT NULL")
    return e.select("vec_id", F.col("label").cast("double").alias("y"), array_to_vector(F.col("embedding").cast("array<double>")).alias("x"), F.pmod(F.xxhash64("vec_id"), F.lit(5)).alias("fold"))


def evaluated(spark: SparkSession, sf_dir: str, model) -> DataFrame:
    """Fit on folds 1 to 4, predict fold 0."""
    d = data(spark, sf_dir)
    fitted = model.fit(d.where("fold <> 0"))
    return _labelled(fitted.transform(d.where("fold = 0")))


@query()
def ml_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random forest, the stand-in for extremely randomised trees."""
    return evaluated(spark, sf_dir, RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=30, maxDepth=8, seed=SEED))


@query()
def ml_ovr_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One boosted forest for each class, the stand-in for boosted multiclass trees."""
    return evaluated(spark, sf_dir, OneVsRest(classifier=GBTClassifier(maxIter=3, maxDepth=3, seed=SEED), featuresCol="x", labelCol="y", parallelism=2))


@query()
def ml_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled, clustered, then profiled: size, commonest label, purity and entropy of each cluster."""
    d = data(spark, sf_dir)
    p = Pipeline(stages=[StandardScaler(inputCol="x", outputCol="z", withMean=True), KMeans(k=10, featuresCol="z", seed=SEED)]).fit(d).transform(d)
    return M.purity(p.select("prediction", F.col("y").cast("int").alias("label")), ["prediction"], "label")


@query()
def ml_kmeans_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of squared distances of scaled rows to their centre, for k = 2 to 10."""
    d = data(spark, sf_dir)
    z = StandardScaler(inputCol="x", outputCol="z", withMean=True).fit(d).transform(d).select("z").cache()
    rows = [(k, float(KMeans(k=k, featuresCol="z", seed=SEED, maxIter=10).fit(z).summary.trainingCost)) for k in range(2, 11)]
    z.unpersist()
    return spark.createDataFrame(rows, "k int, inertia double")


#: Depth and trees of the forests tried.
CONFIGS = [(4, 10), (6, 10), (8, 20)]


@query()
def ml_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forests of several configurations fitted on folds 2 to 4; the one that does best on fold 1 is scored on fold 0, which has no say."""
    d = data(spark, sf_dir)
    train, rows = d.where("fold >= 2"), []
    accuracy = lambda m, fold: M.balanced_accuracy(_labelled(m.transform(d.where(F.col("fold") == fold))), []).first()["bal_acc"]
    models = [RandomForestClassifier(featuresCol="x", labelCol="y", maxDepth=depth, numTrees=trees, seed=SEED).fit(train) for depth, trees in CONFIGS]
    vals = [accuracy(m, 1) for m in models]
    best = vals.index(max(vals))
    for i, ((depth, trees), val) in enumerate(zip(CONFIGS, vals, strict=True)):
        rows.append((depth, trees, float(val), float(accuracy(models[i], 0)) if i == best else None))
    return spark.createDataFrame(rows, "depth int, trees int, val double, test double")


def _labelled(predicted: DataFrame) -> DataFrame:
    return predicted.select("vec_id", F.col("y").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"))


@query()
def ml_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 components, fitted on the training folds only; signs are arbitrary."""
    d = data(spark, sf_dir)
    m = PCA(k=16, inputCol="x", outputCol="z").fit(d.where("fold <> 0"))
    return m.transform(d).select("vec_id", vector_to_array("z").alias("components"))


@query()
def ml_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold probabilities of a forest feed a logistic regression; each fold's test rows never train it."""
    d = data(spark, sf_dir)
    oof = None
    for k in range(1, 5):
        m = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=10, maxDepth=6, seed=SEED).fit(d.where(F.col("fold").isin([f for f in range(1, 5) if f != k])))
        part = m.transform(d.where(F.col("fold") == k)).select("vec_id", "y", F.col("probability").alias("p"))
        oof = part if oof is None else oof.unionByName(part)
    base = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=10, maxDepth=6, seed=SEED).fit(d.where("fold <> 0"))
    top = LogisticRegression(featuresCol="p", labelCol="y", maxIter=30).fit(oof)
    return top.transform(base.transform(d.where("fold = 0")).select("vec_id", "y", F.col("probability").alias("p"))).select("vec_id", F.col("y").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"))


@query()
def ml_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature importances of the forest, one row a feature."""
    m = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=10, maxDepth=6, seed=SEED).fit(data(spark, sf_dir).where("fold <> 0"))
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(m.featureImportances.toArray())], "feature int, importance double")

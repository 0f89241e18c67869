"""Sources and sinks: probed CSV scans, split files, prediction files, audited outputs, upserts, incremental caches."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators import relational as R


def read_csv_known(spark: SparkSession, path: str, wanted: list[str], encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header: those of ``wanted`` that exist, as strings, quoted newlines allowed; only they are parsed. None at all is an error."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding=encoding)
    known = [f"`{c}`" for c in wanted if c in df.columns]
    if not known:
        raise ValueError(f"{path} has none of the columns {wanted}")
    return df.select(*known)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def first_existing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first table that exists: CSV by its name's end, else Parquet."""
    for p in paths:
        if exists(spark, p):
            return spark.read.csv(p, header=True, inferSchema=True) if p.endswith(".csv") else spark.read.parquet(p)
    raise FileNotFoundError(paths)


def load_features(spark: SparkSession, folder: str) -> DataFrame:
    return first_existing(spark, [f"{folder}/{n}" for n in ("features.parquet", "features", "features.csv")])


def load_labels(spark: SparkSession, folder: str) -> DataFrame:
    return first_existing(spark, [f"{folder}/{n}" for n in ("labels.parquet", "labels", "labels.csv")])


def read_arrays(spark: SparkSession, glob: str) -> DataFrame:
    """Two-dimensional ``.npy`` files → file (name without its end), row, values: a row for each of the array's. A file is one task's work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.load(io.BytesIO(content), allow_pickle=False)
                x = x.reshape(len(x), -1)
                name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                for at in range(0, len(x), 4096):
                    part = x[at : at + 4096].astype(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part))), pa.array(list(part), pa.list_(pa.float64()))], names=["file", "row", "values"])

    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInArrow(run, "file string, row bigint, values array<double>")


def read_splits(spark: SparkSession, folder: str) -> DataFrame:
    """``{train, val, test}`` JSON files → split_name (file stem), role, row_id."""
    roles = ("train", "val", "test")
    schema = T.StructType([T.StructField(r, T.ArrayType(T.LongType())) for r in roles])
    df = spark.read.schema(schema).json(f"{folder}/*.json", multiLine=True).withColumn("split_name", F.regexp_extract(F.col("_metadata.file_name"), r"([^/]*)\.json$", 1))
    return df.select("split_name", F.explode(F.map_from_arrays(F.array(*map(F.lit, roles)), F.array(*roles))).alias("role", "ids")).select("split_name", "role", F.explode("ids").alias("row_id"))


def read_predictions(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Prediction CSVs; ``model`` and ``split`` from stems like model_split_fold.csv: the split is what follows the last known family name."""
    df = spark.read.schema(schema).csv(glob, header=True).withColumn("stem", F.regexp_extract(F.col("_metadata.file_name"), r"([^/]*)\.csv$", 1))
    family = r"^(.*)_((?:tscv|scaffold|grouped).*)$"
    return df.withColumn("model", F.regexp_extract("stem", family, 1)).withColumn("split", F.regexp_extract("stem", family, 2)).drop("stem")


def aligned(features: DataFrame, labels: DataFrame, target: str, row_id: str = "row_id") -> DataFrame:
    """Features joined with one label by row id: null features are 0, null labels stay null. Raises on lost or doubled rows."""
    out = features.join(labels.select(row_id, F.col(target).alias("y")), row_id)
    a, b = features.count(), out.count()
    if a != b:
        raise ValueError(f"alignment on {row_id} changed {a} rows to {b}")
    return out.fillna(0, subset=[c for c in features.columns if c != row_id])


def append_block(base: DataFrame, extra: DataFrame, prefixes: tuple[str, ...], row_id: str = "row_id") -> DataFrame:
    """``base`` with the columns of ``extra`` that have one of the prefixes. Both must have the same rows: anything else is an error."""
    return R.assemble([base, R.select_prefixes(extra, include=prefixes, always=(row_id,))], row_id)


def row_total(df: DataFrame) -> int:
    """Rows, not lines: quoted line ends count for nothing."""
    return df.count()


def missing_keys(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """What an incremental cache still has to compute."""
    return wanted.join(cache.select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` with other keys, and all of ``new``."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def write_clean(clean: DataFrame, audit: DataFrame, summary: DataFrame, folder: str, subset: str | None = None) -> None:
    """Clean table, row audit and step summary; ``subset``: a partition column, so that its values are read alone."""
    w = clean.write.mode("overwrite")
    (w.partitionBy(subset) if subset else w).parquet(f"{folder}/clean")
    audit.write.mode("overwrite").partitionBy("step").parquet(f"{folder}/row_audit")
    summary.write.mode("overwrite").parquet(f"{folder}/step_summary")


def write_predictions(predictions: DataFrame, folder: str) -> None:
    """model, split and a row for each prediction, a folder for each model and split; runs again replace only theirs."""
    predictions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "split").parquet(folder)


def write_report(audit: DataFrame, folder: str) -> None:
    """The audit as CSV, for reading by eye."""
    audit.write.mode("overwrite").csv(folder, header=True)


def manifest(df: DataFrame, groups: dict[str, tuple[str, ...]]) -> dict:
    """Feature names and the width of each prefix group."""
    return {"features": df.columns, "widths": {g: sum(c.startswith(p) for c in df.columns) for g, p in groups.items()}}

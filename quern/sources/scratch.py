"""Shared working folder and materialisation.

Intermediate tables are written as Parquet to the folder named by ``spark.checkpoint.dir``; every
executor can read them again, so a lost executor costs a task retry and nothing else.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Paths made within open ``Temporary`` blocks, innermost last.
_open: list[list[tuple[SparkSession, str]]] = []


class Temporary:
    """A block whose intermediate tables are removed at its end, but for those kept.

    Tables made within it must be used up by then; what is written out to be kept outlives it.
    """

    def __enter__(self) -> Temporary:
        self.kept: set[str] = set()
        _open.append([])
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written out, for use after the block."""
        path = new_path(df.sparkSession, "kept")
        df.write.parquet(path)
        self.kept.add(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def __exit__(self, *_) -> None:
        for spark, path in _open.pop():
            if path not in self.kept:
                _remove(spark, path)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where unset on a single machine (tests), a temporary one is set. Unset on a cluster, it's an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/quern/{label}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    if _open:
        _open[-1].append((spark, path))
    return path


def _remove(spark: SparkSession, path: str) -> None:
    """Best effort: at interpreter exit the JVM may be gone."""
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001
        pass


def save(df: DataFrame, label: str, **options) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors. ``options``: of the writer."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""What the operators share: words, free column names, tables; working folders come from the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.sources.scratch import new_path, save  # noqa: F401

#: One word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
#: ASCII white space, for trim functions.
SPACE_CHARS = " \t\n\x0b\x0c\r"


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

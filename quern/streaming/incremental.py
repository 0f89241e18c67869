"""The incremental cache as a stream: each micro-batch computes what the cache lacks, and no more."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quern.sources import tables


def fill_cache(stream: DataFrame, cache: str, key: str, compute: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Appends ``compute`` of the rows with new keys to the Parquet table ``cache``, one row a key; ends when the source has no more.

    A batch that is run again after a failure finds its keys in the cache, so nothing is computed or written twice.
    Rows with a null key are left out.
    """

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        new = rows.where(rows[key].isNotNull()).dropDuplicates([key])
        if tables.exists(spark, cache):
            new = tables.missing_keys(new, spark.read.parquet(cache), key)
        compute(new).write.mode("append").parquet(cache)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Latest observation of each property and half-year over a growing folder of period rows."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from plotwise.functions.scalars import finite, half_year
from plotwise.session import scratch_dir


def latest_stream(stream: DataFrame, metric: str) -> DataFrame:
    """(id, bucket, key, value) in complete or update mode; the state is one row for each property and half-year."""
    v = finite(F.col(metric))
    rows = stream.select(F.col("property_id").alias("id"), F.col("as_of_date").alias("key"), half_year(F.col("as_of_date")).alias("bucket"), "row_id", v.alias("value"))
    rows = rows.where(F.col("value").isNotNull() & F.col("key").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"))
    return rows.groupBy("id", "bucket").agg(F.max(F.struct("key", "row_id", "value")).alias("v")).select("id", "bucket", "v.key", "v.value")


def run_available(spark: SparkSession, folder: str, schema, metric: str, out: str, pattern: str = "*.parquet") -> DataFrame:
    """Feed all files that are there through the stream, one micro-batch after another; returns what was written last.

    Each batch overwrites its own subfolder of `out`, so a batch that runs again leaves the same files.
    """
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    seen: list[int] = []

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        seen.append(epoch)

    state = f"{scratch_dir(spark)}/plotwise-stream-{os.urandom(6).hex()}"
    q = latest_stream(stream, metric).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/epoch={max(seen)}")

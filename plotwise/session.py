"""Session defaults and the durable cut of lineage used by every multi-pass operator."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Tables up to this many estimated bytes may be broadcast; the estimate is always computed, never assumed.
BROADCAST_LIMIT_BYTES = 24 * 1024 * 1024

_OWN: list[str] = []  # the folder made on a local master, removed at exit


def session(app: str = "plotwise", master: str = "local[8]", partitions: int = 8) -> SparkSession:
    """A local session with the settings the library expects; a cluster brings its own."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Where that is unset, a folder of our own on a local master; on a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not re.match(r"local(\[[^,]*(,[^,]*)?\])?$", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="plotwise-checkpoint-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return _OWN[0]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to scratch_dir() unless the session has a folder already."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(scratch_dir(spark))


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder once and read it from there: survives the loss of executors.

    With spark.cleaner.referenceTracking.cleanCheckpoints, as in session(), the files go when nothing refers to them any more.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, for work that is heavy for its bytes: files that come in fewer partitions than there are cores are dealt out; others stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def broadcast_if_small(df: DataFrame, row_bytes: Column | int, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Mark df for broadcast only after its size has been measured.

    row_bytes is the estimated size of a row. df should be cheap to read (materialized): measuring is one aggregate over it.
    Beyond the limit df comes back as it is and the join shuffles.
    """
    size = df.select(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)).alias("b")).first()["b"] or 0
    return F.broadcast(df) if size <= limit else df


__all__ = ["BROADCAST_LIMIT_BYTES", "broadcast_if_small", "ensure_checkpoint_dir", "materialize", "scratch_dir", "session", "spread"]

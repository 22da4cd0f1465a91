"""Writers: publishing behind a quality gate, quarantine, ledgers, reports, run records and CSV files, on any file system."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plotwise.operators.search import csv_lines
from plotwise.sources.files import Files

_POINTER = "_CURRENT"


def replace(df: DataFrame, target: str) -> str:
    """Make df the table at target: a new version beside the others, then one pointer file swapped. Returns the version's path.

    Readers of published() have the old table or the new one, never none. The version before stays for those still reading it;
    older ones go. A write that fails leaves the table as it was.
    """
    files = Files(df.sparkSession)
    version = f"version-{uuid.uuid4().hex}"
    df.write.parquet(f"{target}/{version}")
    before = _current(files, target)
    files.write(f"{target}/{_POINTER}", version.encode())
    for e in files.list(target):
        if e.is_folder and e.name.startswith("version-") and e.name not in (version, before):
            files.delete(e.path)
    return f"{target}/{version}"


def _current(files: Files, target: str) -> str | None:
    return files.read(f"{target}/{_POINTER}").decode() if files.exists(f"{target}/{_POINTER}") else None


def published(spark: SparkSession, target: str, schema: str | None = None) -> DataFrame:
    """The table at target; where there is none an empty one of the schema, or FileNotFoundError without a schema."""
    version = _current(Files(spark), target)
    if version is None:
        if schema is None:
            raise FileNotFoundError(target)
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{target}/{version}")


def publish(df: DataFrame, target: str, errors: int) -> bool:
    """Replace the table at target, but only if there are no errors; else the old one stays and the new one goes to quarantine."""
    if errors:
        df.write.mode("overwrite").parquet(target + ".quarantine")
        return False
    replace(df, target)
    return True


def save_ledger(ledger: DataFrame, target: str) -> None:
    """A ledger in place of the old one, with the time of saving."""
    replace(ledger.withColumn("updated_at", F.current_timestamp()), target)


def cached(known: DataFrame, new: DataFrame, key: str, target: str) -> None:
    """A small dimension such as a cache of addresses written back: what is known, and new keys."""
    replace(known.unionByName(new.join(known.select(key), key, "left_anti")), target)


def report(df: DataFrame, folder: str, run_id: str) -> None:
    """A report under its run and as the latest one."""
    df.write.mode("overwrite").json(f"{folder}/run={run_id}")
    df.write.mode("overwrite").json(f"{folder}/latest")


def audited(spark: SparkSession, run_id: str, folder: str, run: Callable[[], dict]) -> dict:
    """Run something and keep its record (what it returns, run_id and status) as folder/run_id.json.

    A failure is recorded there and under quarantine with its type and message, and raised again.
    """
    files = Files(spark)
    write = lambda at, record: files.write(at, json.dumps(record, ensure_ascii=False, default=str).encode())
    try:
        record = {"run_id": run_id, "status": "succeeded", **run()}
    except Exception as e:
        failed = {"run_id": run_id, "status": "failed", "error": {"type": type(e).__name__, "message": str(e)}}
        write(f"{folder}/{run_id}.json", failed)
        write(f"{folder}/quarantine/{run_id}.json", failed)
        raise
    write(f"{folder}/{run_id}.json", record)
    return record


#: The columns of an export, in their order.
CSV_COLUMNS = ("id", "reit_code", "reit", "name", "type", "region", "address", "lat", "lng", "price", "book_value", "appraisal", "cap", "discount_rate", "terminal_cap_rate", "occupancy", "noi", "leasable_area", "leased_area", "tenants")


def write_csv(df: DataFrame, columns: list[str], folder: str, header: list[str] | None = None) -> None:
    """Text files of quoted lines, and `header.csv` with the byte-order mark and the plain header; put together they are the export."""
    csv_lines(df, columns).write.mode("overwrite").text(folder)
    Files(df.sparkSession).write(f"{folder}/header.csv", ("\ufeff" + ",".join(header or columns) + "\n").encode())

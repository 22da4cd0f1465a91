"""Readers for the parquet tables of a scale folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table `name`; Catalyst prunes its columns and pushes its filters."""
    return spark.read.parquet(f"{folder}/{name}.parquet")

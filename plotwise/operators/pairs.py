"""Pairs of rows that share a key, where a key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plotwise.session import broadcast_if_small, materialize


def hot_salts(df: DataFrame, keys: list[str], hot_key: int) -> DataFrame:
    """(keys, _salts) of keys of more than hot_key rows: in how many parts each is split. There are at most rows / hot_key of them; the list is broadcast if its measured size allows."""
    hot = df.groupBy(*keys).count().where(F.col("count") > hot_key).select(*keys, F.ceil(F.col("count") / hot_key).cast("int").alias("_salts"))
    return broadcast_if_small(materialize(hot), 200)


def part_of(salts: Column, *row: str) -> Column:
    return F.pmod(F.xxhash64(*row), salts).cast("int")


def up_to(low: Column, salts: Column) -> Column:
    return F.sequence(low, salts - 1)


def pairs_by_key(df: DataFrame, keys: list[str], row: str, hot_key: int = 4000) -> DataFrame:
    """(a, b) with a < b of the rows of each key. df holds each (keys, row) once; null keys pair with nothing.

    The rows of a hot key are split in parts of about hot_key rows, and each two parts, and each with itself, meet in a group of
    their own: no group has more than about hot_key rows a side. Splitting one side only would put all rows of the other in each.
    """
    df = df.select(*keys, row).dropna()
    both = df.join(hot_salts(df, keys, hot_key), keys, "left")
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    both = both.select(*keys, row, salts.alias("_salts"), part_of(salts, row).alias("_p"))
    left = both.select(*keys, F.col(row).alias("_a"), F.col("_p").alias("_i"), F.explode(up_to(F.col("_p"), F.col("_salts"))).alias("_j"))
    right = both.select(*keys, F.col(row).alias("_b"), F.col("_p").alias("_j"), F.explode(F.sequence(F.lit(0), F.col("_p"))).alias("_i"))
    met = left.join(right, [*keys, "_i", "_j"]).where((F.col("_i") < F.col("_j")) | (F.col("_a") < F.col("_b")))
    return met.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))

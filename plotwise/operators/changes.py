"""Differences of two datasets at property, period and metric level, and content fingerprints and snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plotwise.functions.scalars import METRICS, blank
from plotwise.sources.files import Files

#: The fields of a property that are compared.
MASTER = ("name", "reit", "reit_code", "type", "region", "address", "lat", "lng")


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, the last by order; rows with a blank key are dropped."""
    rest = [c for c in df.columns if c not in keys]
    ok = reduce(lambda a, k: a & ~blank(F.col(k).cast("string")), keys, F.lit(True))
    return df.where(ok).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order)).alias("_v")).select(*keys, "_v.*")


def diff_rows(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): added, removed or shared; one full outer join."""
    a, b = before.select(*keys, F.lit(1).alias("_a")), after.select(*keys, F.lit(1).alias("_b"))
    change = F.when(F.col("_a").isNull(), F.lit("added")).when(F.col("_b").isNull(), F.lit("removed")).otherwise(F.lit("shared"))
    return a.join(b, keys, "full").select(*keys, change.alias("change"))


def diff_fields(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, field, before, after) of shared rows: fields that differ, null-safe, as text. One join for all fields."""
    a = before.select(*keys, F.struct(*(F.col(f).cast("string").alias(f) for f in fields)).alias("_a"))
    b = after.select(*keys, F.struct(*(F.col(f).cast("string").alias(f) for f in fields)).alias("_b"))
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.col("_a")[f].alias("before"), F.col("_b")[f].alias("after")) for f in fields))
    return a.join(b, keys).select(*keys, F.inline(F.filter(cells, lambda c: ~c["before"].eqNullSafe(c["after"]))))


def diff_metrics(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, change, before, after, delta) of shared rows: metrics added, removed or changed; NaN counts as null."""
    v = lambda m: F.when(~F.isnan(F.col(m)), F.col(m)).alias(m)
    a, b = before.select(*keys, F.struct(*map(v, METRICS)).alias("_a")), after.select(*keys, F.struct(*map(v, METRICS)).alias("_b"))

    def cell(m: str) -> Column:
        x, y = F.col("_a")[m], F.col("_b")[m]
        change = F.when(x.isNull(), F.lit("added")).when(y.isNull(), F.lit("removed")).otherwise(F.lit("changed"))
        return F.when(~x.eqNullSafe(y), F.struct(F.lit(m).alias("field"), change.alias("change"), x.alias("before"), y.alias("after"), (y - x).alias("delta")))

    return a.join(b, keys).select(*keys, F.inline(F.filter(F.array(*map(cell, METRICS)), lambda c: c.isNotNull())))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, fingerprint): a digest of the content that doesn't depend on the order of rows.

    Row digests are added up in four lanes, so the dataset is never sorted or collected; repeated rows count.
    """
    return _digest(df.select(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in columns)).alias("text")))


def dataset_fingerprint(tables: dict[str, DataFrame]) -> DataFrame:
    """(rows, fingerprint): one digest of all rows and columns of several tables, in any order of rows.

    Each row counts as JSON under its table's name, so nulls, empty texts and separators within texts stay apart.
    """
    texts = [df.select(F.concat(F.lit(name), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).alias("text")) for name, df in tables.items()]
    return _digest(reduce(DataFrame.unionByName, texts))


def _digest(df: DataFrame) -> DataFrame:
    h = F.sha2(F.encode("text", "UTF-8"), 256)
    lanes = [F.sum(F.conv(F.substring(h, 1 + 12 * k, 12), 16, 10).cast("decimal(20,0)")) for k in range(4)]
    joined = F.concat_ws("-", *(F.coalesce(x, F.lit(0)).cast("string") for x in lanes))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.encode(joined, "UTF-8"), 256).alias("fingerprint"))


def archive(df: DataFrame, columns: list[str], folder: str, keep: int = 12) -> str:
    """Write df under its fingerprint unless it is there already; keep the newest. Returns the snapshot's path."""
    files = Files(df.sparkSession)
    path = f"{folder}/snapshot={fingerprint(df, columns).first()['fingerprint'][:20]}"
    if not files.exists(f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    kept = sorted((e for e in files.list(folder) if e.name.startswith("snapshot=")), key=lambda e: e.modified, reverse=True)
    for e in kept[max(keep, 1) :]:
        files.delete(e.path)
    return path

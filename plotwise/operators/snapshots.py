"""What changed between consecutive full deliveries of a table.

The rows of a key over all deliveries are gaps and islands: an interval runs on while the next delivery holds the key with
equal values. Starts, ends and adjacencies of the intervals are the change events, so one shuffle on the key answers for all
deliveries at once; no delivery is joined with another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Printable ASCII and its full-width forms, and the ideographic space.
_ASCII = "".join(map(chr, range(0x21, 0x7F)))
_WIDE = "".join(chr(ord(c) + 0xFEE0) for c in _ASCII)

#: Divisors to million_jpy.
_TO_MILLION = {"million_jpy": 1.0, "thousand_jpy": 1e3, "jpy": 1e6}


def plain_id(c: Column) -> Column:
    """An id without character width, case and surrounding white space; null where nothing is left."""
    narrow = F.translate(c, _WIDE + "　", _ASCII + " ")
    bare = F.lower(F.regexp_replace(narrow, r"(?U)^[\s\p{Cf}]+|[\s\p{Cf}]+$", ""))
    return F.when(bare != "", bare)


def in_million_jpy(value: Column, unit: Column) -> Column:
    """An amount in million_jpy; a null or unknown unit counts as million_jpy."""
    unit = F.lower(F.trim(unit))
    divisor = F.lit(1.0)
    for name, by in _TO_MILLION.items():
        divisor = F.when(unit == name, F.lit(by)).otherwise(divisor)
    return value / divisor


def _differs(a: Column, b: Column, tolerance: float) -> Column:
    """Null against a value differs, null against null doesn't; NaN is equal to NaN only."""
    nan = F.coalesce(F.isnan(a), F.lit(False)) != F.coalesce(F.isnan(b), F.lit(False))
    both = F.coalesce(F.abs(a - b) > tolerance, F.lit(False)) & ~F.isnan(F.coalesce(a - b, F.lit(0.0)))
    return (a.isNull() != b.isNull()) | nan | both


def states(df: DataFrame, order: list[str], values: dict[str, Column], key: Column, snapshot: str) -> DataFrame:
    """(k, s, v): the row that counts of each key and delivery, the greatest by `order`; combined before the shuffle."""
    v = F.struct(*(c.alias(n) for n, c in values.items()))
    src = df.select(key.alias("k"), F.col(snapshot).alias("s"), F.struct(*order).alias("o"), v.alias("v")).where("k is not null and s is not null")
    return src.groupBy("k", "s").agg(F.max_by("v", "o").alias("v"))


def intervals(rows: DataFrame, values: list[str], tolerance: float) -> DataFrame:
    """(k, valid_from, valid_to, v): runs of consecutive deliveries in which a key's values stay equal.

    Equal row hashes settle most steps; where hashes differ the values are compared within the tolerance, each with the
    delivery before. v is that of the run's first delivery.
    """
    w = Window.partitionBy("k").orderBy("s")
    hashed = rows.withColumn("h", F.xxhash64("v"))
    before = hashed.withColumn("ps", F.lag("s").over(w)).withColumn("pv", F.lag("v").over(w)).withColumn("ph", F.lag("h").over(w))
    differ = F.lit(False)
    for n in values:
        differ = differ | _differs(F.col("v")[n], F.col("pv")[n], tolerance)
    starts = F.col("ps").isNull() | (F.col("s") != F.col("ps") + 1) | F.when(F.col("h") == F.col("ph"), F.lit(False)).otherwise(differ)
    island = before.withColumn("island", F.sum(F.when(starts, 1).otherwise(0)).over(w))
    return island.groupBy("k", "island").agg(F.min("s").alias("valid_from"), F.max("s").alias("valid_to"), F.min_by("v", "s").alias("v")).drop("island")


def events(runs: DataFrame, first: int, last: int) -> DataFrame:
    """(snapshot_no, id, change) of intervals: 'added' and 'changed' at starts, 'removed' after ends, from first + 1 to last."""
    w = Window.partitionBy("k").orderBy("valid_from")
    seen = runs.withColumn("before", F.lag("valid_to").over(w)).withColumn("after", F.lead("valid_from").over(w))
    adjacent = F.coalesce(F.col("before") == F.col("valid_from") - 1, F.lit(False))
    start = F.when(F.col("valid_from") > first, F.struct(F.col("valid_from").alias("snapshot_no"), F.when(adjacent, "changed").otherwise("added").alias("change")))
    followed = F.coalesce(F.col("after") == F.col("valid_to") + 1, F.lit(False))
    end = F.when((F.col("valid_to") < last) & ~followed, F.struct((F.col("valid_to") + 1).cast("int").alias("snapshot_no"), F.lit("removed").alias("change")))
    found = F.filter(F.array(start, end), lambda e: e.isNotNull())
    return seen.select(F.col("k").alias("id"), F.inline(found)).select("snapshot_no", "id", "change")


def property_states(df: DataFrame) -> DataFrame:
    """States of property_snapshot: the latest loaded_at counts (then the greater row_id), appraisal in million_jpy.

    Rows with a null or blank id or a null snapshot_no take no part. A null loaded_at is the earliest.
    """
    values = {"cap": F.col("cap"), "appraisal": in_million_jpy(F.col("appraisal"), F.col("appraisal_unit"))}
    return states(df, ["loaded_at", "row_id"], values, plain_id(F.col("id")), "snapshot_no")


def property_intervals(df: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Validity intervals of property_snapshot: id, valid_from, valid_to, cap, appraisal."""
    runs = intervals(property_states(df), ["cap", "appraisal"], tolerance)
    return runs.select(F.col("k").alias("id"), "valid_from", "valid_to", F.col("v.cap").alias("cap"), F.col("v.appraisal").alias("appraisal"))


def property_changes(df: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(snapshot_no, id, change) of property_snapshot; empty for fewer than two deliveries."""
    span = df.agg(F.min("snapshot_no").alias("a"), F.max("snapshot_no").alias("b")).first()  # two numbers
    if span["a"] is None:
        span = {"a": 0, "b": 0}
    return events(intervals(property_states(df), ["cap", "appraisal"], tolerance), span["a"], span["b"])

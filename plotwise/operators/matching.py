"""Names that are equal or contained in one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plotwise.functions.scalars import event_name
from plotwise.session import materialize

PREFIX = 6


def contained_names(left: DataFrame, right: DataFrame, name: str = "name", prefix: int = PREFIX) -> DataFrame:
    """(left_name, right_name): distinct names of which one contains the other, by an equi-join.

    The shorter name's first characters (all of a name shorter than `prefix`) must stand somewhere in the longer: each name
    is found under its start, and looked for under its substrings of the lengths that starts have. Both sides' names are put
    together first, so each is written and cut once. Blank names match nothing.

    Spark takes cut names for as many bytes as whole ones, so it would broadcast them through the driver at many times the
    limit; the hint keeps both joined sides shuffled.
    """
    side = lambda df, on_left: df.select(F.col(name).alias("raw"), F.lit(on_left).alias("l"), F.lit(not on_left).alias("r"))
    once = lambda df, key: df.groupBy(key).agg(F.bool_or("l").alias("l"), F.bool_or("r").alias("r"))
    written = once(side(left, True).unionByName(side(right, False)), "raw").select(event_name(F.col("raw")).alias("name"), "l", "r")
    names = materialize(once(written, "name")).where("name <> ''")
    lengths = sorted(n for (n,) in names.select(F.least(F.length("name"), F.lit(prefix))).distinct().collect())  # at most `prefix` numbers

    size = F.length("name")

    def pieces_of(n: int) -> Column:
        at = F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.xxhash64(F.substring(F.col("name"), i, F.lit(n))))
        return F.when(size >= n, at).otherwise(F.array().cast("array<bigint>"))

    cut = F.flatten(F.array(*map(pieces_of, lengths or [1])))
    starts = names.select(F.xxhash64(F.substring("name", 1, prefix)).alias("key"), F.struct("name", "l", "r").alias("inner"))
    pieces = names.select(F.struct("name", "l", "r").alias("outer"), F.explode(F.array_distinct(cut)).alias("key"))
    met = starts.join(pieces.hint("merge"), "key").where(F.contains("outer.name", "inner.name"))
    pair = lambda a, b, met: F.when(met, F.struct(F.col(f"{a}.name").alias("left_name"), F.col(f"{b}.name").alias("right_name")))
    both = F.array(pair("inner", "outer", F.col("inner.l") & F.col("outer.r")), pair("outer", "inner", F.col("outer.l") & F.col("inner.r") & (F.col("inner.name") != F.col("outer.name"))))
    return met.select(F.inline(F.filter(both, lambda x: x.isNotNull())))

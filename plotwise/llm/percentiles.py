"""Percentiles of very large numeric columns by radix selection, and mergeable states with a bounded error.

A double becomes an integer of the same order. One histogram of the leading digit per group tells which digit holds each
target rank; only rows under those digits are counted by the next digit, and after four digits of 16 bits the value at the
rank is known exactly. A histogram holds at most 65,536 counts a group however many rows there are, is combined before the
shuffle, and no group's values ever meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plotwise.session import broadcast_if_small, materialize

_TWO52 = float(1 << 52)
DIGITS = 4
DIGIT_BITS = 16
RESERVED = {"metric", "key", "digit", "c", "n", "p", "at", "rank", "left", "prefix", "upto", "x", "x0", "x1", "value", "bucket", "whole"}


def order_key(x: Column) -> Column:
    """A BIGINT ordered as the doubles are (the bits of the magnitude, negative below zero); null for null and NaN, 0 for both zeros."""
    m = F.abs(x)
    guess = F.floor(F.log2(F.when(m > 0, m)))
    # The logarithm may be off by one next to powers of two.
    e = F.when(m < F.pow(F.lit(2.0), guess), guess - 1).when(m / F.pow(F.lit(2.0), guess) >= 2, guess + 1).otherwise(guess)
    e = F.least(F.lit(1023), e)
    normal = (e + 1023) * F.lit(1 << 52) + ((m / F.pow(F.lit(2.0), e) - 1) * _TWO52).cast("bigint")
    tiny = (m * F.lit(2.0**537) * F.lit(2.0**537)).cast("bigint")
    bits = F.when(m == 0, F.lit(0).cast("bigint")).when(m == float("inf"), F.lit(2047 << 52)).when(m < F.lit(2.0**-1022), tiny).otherwise(normal)
    return F.when(x.isNotNull() & ~F.isnan(x), F.when(x < 0, -bits).otherwise(bits))


def key_value(key: Column) -> Column:
    """The double of an order_key."""
    bits = F.abs(key)
    e, m = F.shiftright(bits, 52), bits.bitwiseAND(F.lit((1 << 52) - 1))
    normal = (1 + m / _TWO52) * F.pow(F.lit(2.0), e - 1023)
    size = F.when(e == 0, m * F.lit(2.0**-537) * F.lit(2.0**-537)).when(e == 2047, F.lit(float("inf"))).otherwise(normal)
    return F.when(key < 0, -size).otherwise(size)


def _digit(key: Column, k: int) -> Column:
    """Digit k of the key, the sign in the first."""
    shifted = F.shiftright(key, 64 - DIGIT_BITS * (k + 1))
    return (shifted if k == 0 else shifted.bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))).cast("int")


def _values(df: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(groups, metric, key) of every value that counts; group columns keep their nulls as a group of their own."""
    if taken := RESERVED & set(groups):
        raise ValueError(f"group columns may not be named {sorted(taken)}")
    cells = F.array(*(F.struct(F.lit(c).alias("metric"), order_key(F.col(c).cast("double")).alias("key")) for c in columns))
    return df.select(*groups, F.inline(cells)).where("key is not null")


def _same(a: str, b: str, names: Sequence[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return out


def percentiles(df: DataFrame, groups: Sequence[str], columns: Sequence[str], probs: Sequence[float], also: Sequence[str] | None = None) -> DataFrame:
    """(groups, metric, whole, p, n, value): exact percentiles, interpolated between the two nearest ranks.

    n is the number of values that count; null and NaN don't, infinities do. Groups without any value have no row. Repeated
    rows count each time. also: some of the groups, for which there are rows as well, with `whole` true and the other groups
    null; their histograms are the sums of the finer groups' ones, so the data aren't read again for them.
    The data are read three times: for the first and the second digit, each a bounded histogram combined before the shuffle,
    and for the values that share both digits with a target rank. These are a millionth part of a continuous column, and few
    distinct values of any other; they are kept with their counts, and the last two digits follow from them.
    """
    groups = list(groups)
    fine, names = [*groups, "metric"], [*groups, "metric", "whole"]
    shared = [*(groups if also is None else also), "metric"]
    values = _values(df, groups, columns)

    def with_whole(hist: DataFrame) -> DataFrame:
        one = hist.withColumn("whole", F.lit(False))
        if also is None:
            return one
        summed = hist.groupBy(*shared, "prefix", "digit").agg(F.sum("c").alias("c"))
        rest = [F.lit(None).cast(df.schema[g].dataType).alias(g) for g in groups if g not in also]
        return one.unionByName(summed.select("*", *rest, F.lit(True).alias("whole")))

    first = values.groupBy(*fine, _digit(F.col("key"), 0).alias("digit")).agg(F.count(F.lit(1)).alias("c")).withColumn("prefix", F.lit(0).cast("bigint"))
    hist = materialize(with_whole(first))
    sizes = hist.groupBy(*names).agg(F.sum("c").alias("n"))
    place = F.transform(F.array(*(F.lit(float(p)) for p in probs)), lambda p: F.struct(p.alias("p"), ((F.col("n") - 1) * p).alias("at")))
    asked = materialize(sizes.select(*names, "n", F.inline(place)))  # a row for each group and percentile
    ranks = asked.select(*names, F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct()
    # rank: the target as it was asked; left: what is left of it under the prefix followed so far.
    state = ranks.withColumn("left", F.col("rank")).withColumn("prefix", F.lit(0).cast("bigint"))
    kept = None
    for k in range(DIGITS):
        if k > 0:
            followed = broadcast_if_small(state.select(*shared, "prefix").distinct(), 100)
            under = lambda rows: rows.withColumn("prefix", F.shiftright("key", 64 - DIGIT_BITS * k)).alias("v").join(followed.alias("f"), _same("v", "f", [*shared, "prefix"])).select("v.*")  # noqa: B023, E731
            if k == 2:  # equal values are one row from here on, and the data aren't read again
                kept = materialize(under(values).groupBy(*fine, "key").agg(F.count(F.lit(1)).alias("c")))
            rows = under(values).withColumn("c", F.lit(1)) if kept is None else under(kept)
            hist = with_whole(rows.groupBy(*fine, "prefix", _digit(F.col("key"), k).alias("digit")).agg(F.sum("c").alias("c")))
        w = Window.partitionBy(*names, "prefix").orderBy("digit")
        upto = hist.withColumn("upto", F.sum("c").over(w))
        met = state.alias("s").join(upto.alias("h"), _same("s", "h", [*names, "prefix"]) & (F.col("s.left") < F.col("h.upto")) & (F.col("s.left") >= F.col("h.upto") - F.col("h.c")))
        prefix = F.col("h.digit").cast("bigint") if k == 0 else F.shiftleft(F.col("s.prefix"), DIGIT_BITS) + F.col("h.digit")
        state = materialize(met.select(*(F.col(f"s.{n}") for n in names), "s.rank", (F.col("s.left") - (F.col("h.upto") - F.col("h.c"))).alias("left"), prefix.alias("prefix")))
    found = state.select(*names, "rank", key_value(F.col("prefix")).alias("x"))
    low = asked.withColumn("rank", F.floor("at")).alias("a").join(found.alias("l"), _same("a", "l", [*names, "rank"])).select("a.*", F.col("l.x").alias("x0")).withColumn("rank", F.ceil("at"))
    both = low.alias("a").join(found.alias("h"), _same("a", "h", [*names, "rank"])).select("a.*", F.col("h.x").alias("x1"))
    share = F.col("at") - F.floor("at")
    value = F.when((F.col("x0") == F.col("x1")) | (share == 0), F.col("x0")).otherwise(F.col("x0") + (F.col("x1") - F.col("x0")) * share)
    return both.select(*names, "p", "n", value.alias("value"))


def sketch(df: DataFrame, groups: Sequence[str], columns: Sequence[str], bits: int = 24) -> DataFrame:
    """A mergeable state: (groups, metric, bucket, c), counts by the leading bits of the order key.

    With 24 bits (the sign, 11 of exponent, 12 of fraction) a value in a bucket is known to a relative error of at most
    2**-12 whatever the data; states of partitions, loads or days add up by merge(), in any order, without further loss.
    """
    return _values(df, groups, columns).groupBy(*groups, "metric", F.shiftright("key", 64 - bits).alias("bucket")).agg(F.count(F.lit(1)).alias("c"))


def merge(state: DataFrame, groups: Sequence[str]) -> DataFrame:
    """States added up to coarser groups."""
    return state.groupBy(*groups, "metric", "bucket").agg(F.sum("c").alias("c"))


def sketch_percentiles(state: DataFrame, groups: Sequence[str], probs: Sequence[float], bits: int = 24) -> DataFrame:
    """(groups, metric, p, n, low, high): bounds between which the value at rank floor((n - 1) p) lies."""
    names = [*groups, "metric"]
    w = Window.partitionBy(*names)
    upto = F.sum("c").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = state.withColumn("n", F.sum("c").over(w)).withColumn("upto", upto)
    place = F.transform(F.array(*(F.lit(float(p)) for p in probs)), lambda p: F.struct(p.alias("p"), F.floor((F.col("n") - 1) * p).alias("at")))
    rows = rows.select(*names, "n", "bucket", "c", "upto", F.inline(place)).where((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("c")))
    first = F.shiftleft(F.col("bucket"), 64 - bits)
    return rows.select(*names, "p", "n", key_value(first).alias("low"), key_value(first + F.lit((1 << (64 - bits)) - 1)).alias("high"))

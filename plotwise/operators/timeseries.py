"""Irregular reporting dates as series: keys, half-year buckets, distributions, gaps and deltas.

A period table has id, as_of_date, period_no, period (label) and pos, the place of the row among its property's periods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plotwise.functions.scalars import finite, half_year, half_year_label, period_key, period_label


def keyed(periods: DataFrame, metric: str) -> DataFrame:
    """(id, pos, key, label, bucket, value): the metric of each period; NaN and infinities count as null."""
    key = period_key(F.col("as_of_date"), F.col("period_no"), F.col("pos"))
    rows = periods.where("id is not null").select("id", "pos", key.alias("key"), period_label(F.col("as_of_date"), F.col("period"), F.col("period_no"), key).alias("label"), finite(F.col(metric)).alias("value"))
    return rows.withColumn("bucket", half_year(F.col("key")))


def raw_series(rows: DataFrame) -> DataFrame:
    """(id, key, value): of several periods with a key the last one's value, even if it is null."""
    return rows.groupBy("id", "key").agg(F.max_by(F.struct("value"), "pos").alias("v")).select("id", "key", "v.value")


def half_year_series(rows: DataFrame) -> DataFrame:
    """(id, bucket, value): the latest observation that isn't null in each half-year, then the later place."""
    some = rows.where("value is not null")
    return some.groupBy("id", "bucket").agg(F.max_by("value", F.struct("key", "pos")).alias("value"))


def timeline(rows: DataFrame, key: str = "key") -> DataFrame:
    """(key, label), each key once with the label of its first period; half-years with their own labels."""
    label = F.min_by("label", F.struct("pos", "id")).alias("label") if key == "key" else F.first(half_year_label(F.col("bucket"))).alias("label")
    return rows.groupBy(F.col(key).alias("key")).agg(label)


def dense(series: DataFrame, places: DataFrame, key: str = "bucket") -> DataFrame:
    """Every id at every key of places, a timeline of any length, null where it has no value."""
    by_id = series.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(key, "value"))).alias("m"))
    return by_id.crossJoin(places).withColumn("value", F.try_element_at("m", F.col(key))).drop("m")


def least_samples(selected: int) -> int:
    """How many values a point must have to be shown: one for up to eight selected properties, else a tenth, at least three."""
    return 1 if selected <= 8 else max(3, -(-selected // 10))


def quartiles(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, n, average, q1, median, q3) of the values that aren't null: exact, interpolated between the two nearest ranks.

    Equal values are counted before the shuffle and the ranks read off running counts in the order of the values, so a group
    of any size streams through sorted spills and is never held in memory.
    """
    some = rows.where(F.col(value).isNotNull())
    totals = some.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("average"))
    counts = some.groupBy(*keys, F.col(value).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = counts.withColumn("_upto", F.sum("_c").over(w)).join(totals, keys)
    out = []
    for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")):
        at = (F.col("n") - 1) * p
        value_at = lambda rank: F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank), F.col("_x")))
        low, high = value_at(F.floor(at)), value_at(F.ceil(at))
        out.append((low + (high - low) * (F.first(at) - F.floor(F.first(at)))).alias(name))
    return met.groupBy(*keys).agg(F.first("n").alias("n"), F.first("average").alias("average"), *out)


def distribution(series: DataFrame, least: int | Column, key: str = "bucket") -> DataFrame:
    """(key, n, average, q1, median, q3): exact quartiles; all but n null where fewer than `least` values."""
    rows = quartiles(series.select(F.col(key).alias("key"), "value"), ["key"])
    return rows.select("key", "n", *(F.when(F.col("n") >= least, F.col(c)).alias(c) for c in ("average", "q1", "median", "q3")))


def summary(rows: DataFrame) -> DataFrame:
    """(id, first, latest, change, n) of the values that aren't null."""
    some = rows.where("value is not null")
    at = F.struct("key", "pos")
    s = some.groupBy("id").agg(F.min_by("value", at).alias("first"), F.max_by("value", at).alias("latest"), F.count("value").alias("n"))
    return s.select("id", "first", "latest", (F.col("latest") - F.col("first")).alias("change"), "n")


def prior_delta(rows: DataFrame) -> DataFrame:
    """(id, latest, prior, delta): the last two values that aren't null; one value has no delta."""
    w = Window.partitionBy("id").orderBy(F.col("key").desc(), F.col("pos").desc())
    last = rows.where("value is not null").withColumn("k", F.row_number().over(w)).where("k <= 2")
    return last.groupBy("id").agg(F.max(F.when(F.col("k") == 1, F.col("value"))).alias("latest"), F.max(F.when(F.col("k") == 2, F.col("value"))).alias("prior")).withColumn("delta", F.col("latest") - F.col("prior"))


def segments(grid: DataFrame, *values: str) -> DataFrame:
    """(id, start, stop, n): maximal runs of consecutive places at which all values are given. grid: id, ix and the values."""
    given = F.lit(True)
    for v in values:
        given = given & F.col(v).isNotNull()
    w = Window.partitionBy("id").orderBy("ix")
    runs = grid.where("id is not null").withColumn("given", given).where("given").withColumn("island", F.col("ix") - F.row_number().over(w))
    return runs.groupBy("id", "island").agg(F.min("ix").alias("start"), F.max("ix").alias("stop"), F.count(F.lit(1)).alias("n")).drop("island")


def gap_edges(grid: DataFrame, value: str = "value") -> DataFrame:
    """(id, start, stop): the places on both sides of each gap between values."""
    w = Window.partitionBy("id").orderBy("ix")
    some = grid.where(F.col(value).isNotNull()).withColumn("before", F.lag("ix").over(w))
    return some.where(F.col("ix") > F.col("before") + 1).select("id", F.col("before").alias("start"), F.col("ix").alias("stop"))


def latest_either(periods: DataFrame, a: str, b: str, properties: DataFrame | None = None) -> DataFrame:
    """(id, key, a, b, spread): the latest period with either value and b - a there.

    Where that period lacks one of them, or a property has no such period, the property's own value stands in.
    """
    key = period_key(F.col("as_of_date"), F.col("period_no"), F.col("pos"))
    rows = periods.where("id is not null").select("id", "pos", key.alias("key"), finite(F.col(a)).alias("a"), finite(F.col(b)).alias("b")).where("a is not null or b is not null")
    last = rows.groupBy("id").agg(F.max_by(F.struct("key", "a", "b"), F.struct("key", "pos")).alias("v")).select("id", "v.key", "v.a", "v.b")
    if properties is not None:
        own = properties.where("id is not null").select("id", finite(F.col(a)).alias("_a"), finite(F.col(b)).alias("_b"))
        last = own.join(last, "id", "left").select("id", "key", F.coalesce("a", "_a").alias("a"), F.coalesce("b", "_b").alias("b"))
    return last.select("id", "key", F.col("a").alias(a), F.col("b").alias(b), (F.col("b") - F.col("a")).alias("spread"))


def recent(periods: DataFrame, n: int) -> DataFrame:
    """Rows of each id's n greatest period numbers, ties kept."""
    w = Window.partitionBy("id").orderBy(F.col("period_no").desc_nulls_last())
    return periods.withColumn("_r", F.dense_rank().over(w)).where(F.col("_r") <= n).drop("_r")


# --- single values and arrays ---------------------------------------------------------------------------------------------------

#: The metrics that are offered first, in their order; up to how many properties are shown one by one.
OFFERED = ("cap", "terminal_cap_rate", "noi", "occupancy", "appraisal")
INDIVIDUAL_LIMIT = 8


def quantile(sorted_values: Column, p: Column | float) -> Column:
    """The quantile of a sorted array, interpolated between the two nearest ranks; p is clamped to 0..1; null for an empty array."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p if isinstance(p, Column) else F.lit(float(p))))
    at = (F.size(sorted_values) - 1) * p
    low, high = F.get(sorted_values, F.floor(at).cast("int")), F.get(sorted_values, F.ceil(at).cast("int"))
    return F.when(F.size(sorted_values) > 0, low + (high - low) * (at - F.floor(at)))


def series_mode(requested: Column, selected: Column, limit: int = INDIVIDUAL_LIMIT) -> Column:
    """average or individual as requested; else average for more than `limit` properties."""
    return F.when(requested.isin("average", "individual"), requested).when(selected > limit, "average").otherwise("individual")


def nearest_index(x: Column, left: Column, width: Column, length: Column) -> Column:
    """The place in a timeline that a pointer at x is nearest to, on a plot from left; halves go up; null for an empty timeline."""
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - left) / F.when(width > 0, width)))
    return F.when(x.isNull() | (length < 1), F.lit(None)).when((length == 1) | (width <= 0), 0).otherwise(F.floor(ratio * (length - 1) + 0.5)).cast("int")


def with_default_period(properties: DataFrame, period: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """The periods, and for each property without any one made of its own values: no number, no date, its metrics."""
    bare = properties.where("id is not null").join(period.select("id"), "id", "left_anti")
    made = bare.select("id", F.lit(0).cast("bigint").alias("pos"), F.lit(None).cast("int").alias("period_no"), F.lit(None).cast("string").alias("period"), F.lit(None).cast("string").alias("as_of_date"), *metrics)
    return period.select(*made.columns).unionByName(made)


def sorted_periods(periods: DataFrame, *columns: str) -> DataFrame:
    """(id, periods): each property's periods as an array in the order of their keys; a property has few."""
    key = period_key(F.col("as_of_date"), F.col("period_no"), F.col("pos"))
    return periods.where("id is not null").groupBy("id").agg(F.sort_array(F.collect_list(F.struct(key.alias("key"), "pos", *columns))).alias("periods"))


def current(ordered: DataFrame) -> DataFrame:
    """(id, the members of the last period) of sorted_periods()."""
    return ordered.select("id", F.element_at("periods", -1).alias("_p")).select("id", "_p.*")


def default_metric(offered: tuple[str, ...] = OFFERED) -> Column:
    """An aggregate: the first offered metric with any finite value, else the last one offered."""
    return F.coalesce(*(F.when(F.count(finite(F.col(m))) > 0, F.lit(m)) for m in offered), F.lit(offered[-1]))


def yield_metric(wanted: Column) -> Column:
    """The rate that a map is coloured by: the terminal cap rate if asked for, else the cap rate."""
    return F.when(wanted == "terminal_cap_rate", F.col("terminal_cap_rate")).otherwise(F.col("cap"))


def axis_bounds(rows: DataFrame, value: str, *keys: str, padding: float = 0.1, ceiling: float | None = None) -> DataFrame:
    """(keys, low, high) of the finite values with a padding of their spread, at least padding where all are equal; high at most `ceiling`."""
    v = finite(F.col(value))
    at = rows.groupBy(*keys).agg(F.min(v).alias("_a"), F.max(v).alias("_b"))
    pad = F.when(F.col("_b") > F.col("_a"), (F.col("_b") - F.col("_a")) * padding).otherwise(F.lit(padding))
    high = F.col("_b") + pad
    return at.select(*keys, (F.col("_a") - pad).alias("low"), (F.least(high, F.lit(float(ceiling))) if ceiling is not None else high).alias("high"))


def latest_date(*tables: DataFrame, column: str = "as_of_date") -> DataFrame:
    """(as_of_date): the greatest date of all tables; texts that aren't dates don't count."""
    out = None
    for t in tables:
        one = t.select(F.when(F.col(column).rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.col(column)).alias("d"))
        out = one if out is None else out.unionByName(one)
    return out.agg(F.max("d").alias("as_of_date"))

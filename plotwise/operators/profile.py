"""Column profiles of each load from one scan, and what went wrong from load to load.

Constraints are declared per column and compiled into one plan, whose state can be merged in any order. There are two states:
sketches(), one aggregate without an explode, of bounded size for a load of any size (counts, ranges, broken rules, a sketch of
the distinct values and one of the ranks), which partitions, days or late files keep and add up; and state(), the count of each
value, for the columns whose definition asks for exact medians and distinct counts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from plotwise.functions.scalars import METRICS
from plotwise.operators.quality import RANGES

KEYS = ["table_name", "column_name", "feed_id", "load_no"]


@dataclass(frozen=True)
class ColumnCheck:
    """A column and what is asked of it; numeric columns may have a range, text columns a pattern and a validity test."""

    name: str
    numeric: bool
    source: str = ""
    low: float | None = None
    high: float | None = None
    low_included: bool = True
    date: bool = False
    time: bool = False

    @property
    def column(self) -> Column:
        return F.col(self.source or self.name)


@dataclass(frozen=True)
class Limits:
    """Thresholds of the comparison of a load with the one before."""

    null_rate: float = 0.151
    shift: float = 10.02
    distinct_least: int = 10
    distinct_fraction: int = 5


@dataclass(frozen=True)
class TableChecks:
    table: str
    checks: tuple[ColumnCheck, ...] = field(default_factory=tuple)


#: What the project profiles.
PERIOD = TableChecks("property_period", (ColumnCheck("occupancy", True, low=0.0, high=100.0), ColumnCheck("as_of_date", False, date=True)))
REPORT = TableChecks("quality_report", (ColumnCheck("evidence_coverage_percent", True, source="totals.evidence_coverage_percent", low=0.0, high=100.0),))
#: All columns for the descriptive profile; feed_id and load_no are the load itself.
PERIOD_ALL = TableChecks("property_period", (
    *(ColumnCheck(c, True, low=low, low_included=included, high=high) for c in METRICS for low, included, high in [RANGES.get(c, (None, True, None))]),
    ColumnCheck("row_id", True), ColumnCheck("period_no", True), ColumnCheck("loaded_at", True, time=True), *(ColumnCheck(c, False) for c in ("property_id", "reit", "reit_code", "type", "period")), ColumnCheck("as_of_date", False, date=True),
))
REPORT_ALL = TableChecks("quality_report", (
    *(ColumnCheck(c, True, source=f"totals.{c}", low=0.0, high=100.0 if c.endswith("_percent") else None) for c in ("properties", "periods", "numeric_values", "evidence_complete", "evidence_coverage_percent", "with_coordinates", "coordinate_coverage_percent", "duplicate_ids", "errors", "warnings")),
    ColumnCheck("report_id", True), *(ColumnCheck(c, False) for c in ("status", "schema_version", "generated_at", "import_run_id")),
))


#: Columns whose values rise from load to load.
RISING = ("row_id", "report_id", "loaded_at", "period_no")


def state(df: DataFrame, spec: TableChecks) -> DataFrame:
    """The mergeable state: (table_name, column_name, feed_id, load_no, num, txt, n). Null values keep num and txt null.

    Rows with a null feed_id or load_no belong to no load and take no part. Timestamps are numbers: seconds since 1970.
    """
    cells = F.array(*(F.struct(F.lit(c.name).alias("column_name"), ((c.column.cast("timestamp") if c.time else c.column).cast("double") if c.numeric else F.lit(None).cast("double")).alias("num"), (F.lit(None).cast("string") if c.numeric else c.column.cast("string")).alias("txt")) for c in spec.checks))
    long = df.where("feed_id is not null and load_no is not null").select(F.lit(spec.table).alias("table_name"), "feed_id", F.col("load_no").cast("int").alias("load_no"), F.inline(cells))
    return long.groupBy(*KEYS, "num", "txt").agg(F.count(F.lit(1)).alias("n"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """The state of both inputs of a and b together."""
    return a.unionByName(b).groupBy(*KEYS, "num", "txt").agg(F.sum("n").alias("n"))


def is_iso_date(c: Column) -> Column:
    """Whether a text is a real date written YYYY-MM-DD; null for null."""
    shaped = c.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & ~c.startswith("0000")
    return F.when(c.isNotNull(), shaped & F.try_to_date(F.when(shaped, c), "yyyy-MM-dd").isNotNull())


def form(c: Column) -> Column:
    """The form of a text: digits as 9, Latin letters as a, other letters as x, the rest as it is."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[a-zA-Z]", "a"), r"[0-9]", "9"), r"(?U)[\p{L}&&[^a]]", "x")


def metrics(merged: DataFrame, specs: list[TableChecks]) -> DataFrame:
    """One row for each column of a load: rows, nulls, distinct, low, high, mean, median, out_of_range, bad_pattern, forms, form_set.

    forms is the number of the texts' forms, form_set the forms themselves in order (none for numeric columns).
    NaN is a value: greater than all others, out of any range, one distinct value. The median is exact, the mean of the two
    middle values if their count is even; it walks the sorted distinct values of the load, never all rows.
    """
    bounds = F.lit(False)
    bad_date = F.lit(False)
    for spec in specs:
        for c in spec.checks:
            at = (F.col("table_name") == spec.table) & (F.col("column_name") == c.name)
            if c.low is not None or c.high is not None:
                out = F.isnan("num")
                out = out | (F.col("num") < c.low if c.low_included else F.col("num") <= c.low) if c.low is not None else out
                out = out | (F.col("num") > c.high) if c.high is not None else out
                bounds = F.when(at, F.coalesce(out, F.lit(False))).otherwise(bounds)
            if c.date:
                bad_date = F.when(at, F.coalesce(~is_iso_date(F.col("txt")), F.lit(False))).otherwise(bad_date)
    given = F.col("num").isNotNull() | F.col("txt").isNotNull()
    w = Window.partitionBy(*KEYS)
    ordered = w.orderBy(F.col("num").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = F.when(F.col("num").isNotNull(), F.col("n")).otherwise(0)
    ranked = merged.withColumn("upto", F.sum(counted).over(ordered)).withColumn("total", F.sum(counted).over(w))
    holds = lambda rank: F.col("num").isNotNull() & (F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)
    low, high = F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2)
    some = F.when(given, F.col("n"))
    text_form = F.when(F.col("txt").isNotNull(), form(F.col("txt")))
    return ranked.groupBy(*KEYS).agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(~given, F.col("n"))), F.lit(0)).alias("nulls"), F.count(some).alias("distinct"),
        F.min("num").alias("low"), F.max("num").alias("high"), (F.sum(F.col("num") * F.col("n")) / F.sum(F.when(F.col("num").isNotNull(), F.col("n")))).alias("mean"),
        ((F.max(F.when(holds(low), F.col("num"))) + F.max(F.when(holds(high), F.col("num")))) / 2).alias("median"),
        F.coalesce(F.sum(F.when(bounds, F.col("n"))), F.lit(0)).alias("out_of_range"), F.coalesce(F.sum(F.when(bad_date, F.col("n"))), F.lit(0)).alias("bad_pattern"), F.count_distinct(text_form).alias("forms"), F.sort_array(F.collect_set(text_form)).alias("form_set"),
    )


def _name(c: ColumnCheck, what: str) -> str:
    return f"{c.name}|{what}"


_SUMS, _LEAST, _MOST, _DISTINCT = ("given", "nans", "outside", "broken", "total"), ("low", "low_form"), ("high", "high_form"), ("distinct", "forms")


def sketches(df: DataFrame, spec: TableChecks) -> DataFrame:
    """(feed_id, load_no, rows, `column|figure`...): the bounded state of each load; rows without a feed or a load belong to none."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in spec.checks:
        v = (c.column.cast("timestamp") if c.time else c.column).cast("double") + 0.0 if c.numeric else c.column.cast("string")
        aggs.append(F.count(v).alias(_name(c, "given")))
        aggs.append(F.hll_sketch_agg(F.when(v.isNotNull(), F.xxhash64(v))).alias(_name(c, "distinct")))
        if c.numeric:
            out = F.isnan(v) if c.low is not None or c.high is not None else F.lit(False)
            out = out | (v < c.low if c.low_included else v <= c.low) if c.low is not None else out
            out = out | (v > c.high) if c.high is not None else out
            figures = {"nans": F.count_if(F.isnan(v)), "outside": F.count_if(F.coalesce(out, F.lit(False))), "low": F.min(v), "high": F.max(v), "total": F.sum(v), "ranks": F.kll_sketch_agg_double(F.when(~F.isnan(v), v))}
        else:
            f = form(v)
            figures = {"broken": F.count_if(F.coalesce(~is_iso_date(v), F.lit(False)) if c.date else F.lit(False)), "forms": F.hll_sketch_agg(F.when(f.isNotNull(), F.xxhash64(f))), "low_form": F.min(f), "high_form": F.max(f)}
        aggs += [a.alias(_name(c, n)) for n, a in figures.items()]
    return df.where("feed_id is not null and load_no is not null").groupBy("feed_id", F.col("load_no").cast("int").alias("load_no")).agg(*aggs)


def merged_sketches(*states: DataFrame) -> DataFrame:
    """The state of all states' inputs together."""
    every = states[0]
    for s in states[1:]:
        every = every.unionByName(s)
    how = {**dict.fromkeys(_SUMS, F.sum), **dict.fromkeys(_LEAST, F.min), **dict.fromkeys(_MOST, F.max), **dict.fromkeys(_DISTINCT, F.hll_union_agg), "ranks": F.kll_merge_agg_double}
    of = lambda c: F.sum(c) if c == "rows" else how[c.rsplit("|", 1)[1]](f"`{c}`")
    return every.groupBy("feed_id", "load_no").agg(*(of(c).alias(c) for c in every.columns if c not in ("feed_id", "load_no")))


def profiled(state: DataFrame, spec: TableChecks) -> DataFrame:
    """The columns of metrics() from sketches(), low_form and high_form, the least and the greatest form, in place of form_set.

    distinct and forms are estimates within about two per cent, and exact up to some hundred values. The median is a value of the
    column, the lower of two middle ones, NaN left out; exact up to 200 values and else within about one per cent of the ranks.
    """
    null_text, null_number = F.lit(None).cast("string"), F.lit(None).cast("double")

    def row(c: ColumnCheck) -> Column:
        at = lambda n: F.col(f"`{_name(c, n)}`")
        if c.numeric:
            n = at("given")
            median = F.kll_sketch_get_quantile_double(F.when(n > at("nans"), at("ranks")), F.lit(0.5))
            figures = (at("low"), at("high"), at("total") / F.when(n > 0, n), median, at("outside"), F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), null_text, null_text)
        else:
            figures = (null_number, null_number, null_number, null_number, F.lit(0).cast("bigint"), at("broken"), F.hll_sketch_estimate(at("forms")), at("low_form"), at("high_form"))
        names = ("low", "high", "mean", "median", "out_of_range", "bad_pattern", "forms", "low_form", "high_form")
        return F.struct(F.lit(c.name).alias("column_name"), F.col("rows"), (F.col("rows") - at("given")).alias("nulls"), F.hll_sketch_estimate(at("distinct")).alias("distinct"), *(v.alias(k) for k, v in zip(names, figures, strict=True)))

    return state.select(F.lit(spec.table).alias("table_name"), "feed_id", "load_no", F.inline(F.array(*map(row, spec.checks))))


def findings(profile: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(table_name, column_name, feed_id, load_no, finding): each load against load_no - 1 of its feed, and on its own."""
    w = Window.partitionBy("table_name", "column_name", "feed_id").orderBy("load_no")
    share = F.col("nulls") / F.col("rows")
    follows = F.lag("load_no").over(w) == F.col("load_no") - 1
    seen = profile.withColumn("share", share).withColumn("p_share", F.when(follows, F.lag(share).over(w))).withColumn("p_median", F.when(follows, F.lag("median").over(w)))
    given = F.col("rows") - F.col("nulls")
    numeric = F.col("median").isNotNull()
    rules = {
        "null_rate": F.abs(F.col("share") - F.col("p_share")) > limits.null_rate,
        "shift": F.abs(F.col("median") - F.col("p_median")) > limits.shift,
        "out_of_range": F.col("out_of_range") > 0,
        "distinct": numeric & (given >= limits.distinct_least) & (F.col("distinct") * limits.distinct_fraction < given),
        "pattern": F.col("bad_pattern") > 0,
    }
    found = F.filter(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())), lambda x: x.isNotNull())
    return seen.select(*KEYS, F.explode(found).alias("finding"))


def control_limits(profile: DataFrame, sigmas: float = 3.0, least: int = 4, rising: tuple[str, ...] = RISING) -> DataFrame:
    """Loads whose null share, mean or distinct count leaves mean ± sigmas deviations of the feed's earlier loads.

    Needs `least` earlier loads; a constant history flags any other value. Means that are NaN, and those of columns that rise from
    load to load by their nature, aren't compared. Columns: the load, metric, value, low, high.
    """
    mean = F.when(~F.isnan("mean") & ~F.col("column_name").isin(*rising), F.col("mean"))
    figures = F.array(*(F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in (("null_share", F.col("nulls") / F.col("rows")), ("mean", mean), ("distinct", F.col("distinct")))))
    long = profile.select(*KEYS, F.inline(figures))
    w = Window.partitionBy("table_name", "column_name", "feed_id", "metric").orderBy("load_no").rowsBetween(Window.unboundedPreceding, -1)
    seen = long.withColumn("k", F.count("value").over(w)).withColumn("m", F.avg("value").over(w)).withColumn("d", F.stddev_samp("value").over(w))
    seen = seen.withColumn("low", F.col("m") - sigmas * F.col("d")).withColumn("high", F.col("m") + sigmas * F.col("d"))
    return seen.where((F.col("k") >= least) & ((F.col("value") < F.col("low") - 1e-9) | (F.col("value") > F.col("high") + 1e-9))).select(*KEYS, "metric", "value", "low", "high")

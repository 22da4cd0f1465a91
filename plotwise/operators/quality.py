"""Data-quality rules over property and period records and their evidence, declared as data and evaluated in shared scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plotwise.functions.scalars import METRICS, blank, percent

#: Field -> (low, low included, high). No noi: it may be anything.
RANGES = {
    "occupancy": (0.0, True, 100.0), "cap": (0.0, False, 20.0), "discount_rate": (0.0, False, 20.0), "terminal_cap_rate": (0.0, False, 20.0), "price": (0.0, True, None), "book_value": (0.0, True, None),
    "appraisal": (0.0, True, None), "leasable_area": (0.0, True, None), "leased_area": (0.0, True, None), "tenants": (0.0, True, None),
}
#: Fields that a property must have, and the group of those without one.
REQUIRED = ("id", "reit", "reit_code", "name", "type", "address")
UNCLASSIFIED = "未分類"


def duplicate_ids(df: DataFrame, key: str = "id") -> DataFrame:
    """(id, rows): ids that occur more than once; blank ids don't count."""
    return df.where(~blank(F.col(key))).groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def missing_fields(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """(id, missing): rows that lack required fields, with the fields' names."""
    names = F.concat_ws(",", *(F.when(blank(F.col(c)), F.lit(c)) for c in required))
    return df.select("id", names.alias("missing")).where("missing <> ''")


def long_metrics(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, field, value): every metric of every row, nulls included; one scan, no shuffle."""
    cells = F.array(*(F.struct(F.lit(m).alias("field"), F.col(m).cast("double").alias("value")) for m in METRICS))
    return df.select(*keys, F.inline(cells))


def outside(field: str, v: Column) -> Column:
    """Whether a value is outside the field's range. NaN is outside a range with two ends, but not below one that only begins."""
    if field not in RANGES:
        return F.lit(False)
    low, included, high = RANGES[field]
    below = v < low if included else v <= low
    return below if high is None else below | F.isnan(v) | (v > high)


def out_of_range(long: DataFrame) -> DataFrame:
    """Rows of long_metrics outside their field's range."""
    v = F.col("value")
    bad = F.lit(False)
    for f in RANGES:
        bad = bad | ((F.col("field") == f) & outside(f, v))
    return long.where(v.isNotNull() & bad)


def coordinate_state(lat: Column, lng: Column) -> Column:
    """missing, invalid or valid."""
    bad = F.isnan(lat) | F.isnan(lng) | ~lat.between(-90, 90) | ~lng.between(-180, 180)
    return F.when(lat.isNull() | lng.isNull(), F.lit("missing")).when(bad, F.lit("invalid")).otherwise(F.lit("valid"))


#: Fixed value: how far the leased area may exceed the leasable one.
AREA_SLACK = 1.02


def area_beyond(slack: float = AREA_SLACK) -> Column:
    """Whether a record's leased area exceeds its leasable area by more than the slack; null and NaN don't."""
    leased, leasable = F.col("leased_area"), F.col("leasable_area")
    return F.coalesce(~F.isnan(leased) & ~F.isnan(leasable) & (leased > leasable * slack), F.lit(False))


def area_exceeded(df: DataFrame, key: str, slack: float = AREA_SLACK) -> DataFrame:
    """Rows whose leased area exceeds the leasable area by more than the slack."""
    return df.where(area_beyond(slack)).select(key, "leased_area", "leasable_area")


def item_complete(item: Column) -> Column:
    """Whether an evidence item names its document, time, code, unit, place and parser; page 0 and blank texts name nothing."""
    loc, ext = item["locator"], item["extraction"]
    placed = F.coalesce(loc["page"] != 0, F.lit(False)) | (~blank(loc["sheet"]) & (~blank(loc["cell"]) | ~blank(loc["cell_range"])))
    for c in (item["source_document_id"], item["retrieved_at"], item["metric_code"], item["unit"], ext["parser"], ext["parser_version"]):
        placed = placed & ~blank(c)
    return F.coalesce(placed, F.lit(False))


def evidence_complete(e: DataFrame) -> Column:
    """item_complete() of a table whose rows are evidence items."""
    return item_complete(F.struct(*(F.col(c) for c in ("locator", "extraction", "source_document_id", "retrieved_at", "metric_code", "unit"))))


def dictionary_of(field: Column, which: int) -> Column:
    """The code (0) or unit (1) of a field in the metric dictionary."""
    return F.try_element_at(F.create_map(*(F.lit(x) for f, m in METRICS.items() for x in (f, m[which]))), field)


def evidence_consistent(field: Column, code: Column, unit: Column) -> Column:
    """Whether code and unit are the dictionary's."""
    return F.coalesce((code == dictionary_of(field, 0)) & (unit == dictionary_of(field, 1)), F.lit(False))


def with_recorded(e: DataFrame, properties: DataFrame, periods: DataFrame) -> DataFrame:
    """e with `recorded`: the values that records have for its property and field, null where they have none.

    Records are the rows of the property (id) and those of its periods (id, as_of_date) dated as the evidence's observed_at.
    """
    pick = F.coalesce(*(F.when(F.col("field") == m, F.col(m).cast("double")) for m in METRICS)).alias("_v")
    asked = e.select("property_id", "field").dropna().distinct()
    # Only the metric that is asked for goes on from a record; records that no evidence names go no further than the join.
    top = properties.where("id is not null").select(F.col("id").alias("property_id"), *METRICS)
    fixed = asked.join(top, "property_id").select("property_id", "field", pick).where("_v is not null").groupBy("property_id", "field").agg(F.collect_set("_v").alias("_fixed"))
    keys = ["property_id", "field", "observed_at"]
    below = periods.where("id is not null and as_of_date is not null").select(F.col("id").alias("property_id"), F.col("as_of_date").alias("observed_at"), *METRICS)
    dated = e.select(*keys).dropna().distinct().join(below, ["property_id", "observed_at"]).select(*keys, pick).where("_v is not null").groupBy(*keys).agg(F.collect_set("_v").alias("_dated"))
    none = F.array().cast("array<double>")
    both = F.concat(F.coalesce("_fixed", none), F.coalesce("_dated", none))
    return e.join(fixed, ["property_id", "field"], "left").join(dated, ["property_id", "field", "observed_at"], "left").withColumn("recorded", F.when(F.size(both) > 0, both)).drop("_fixed", "_dated")


def value_consistent(value: Column, recorded: Column) -> Column:
    """Whether the value is one of the recorded ones to 1e-9; true where nothing is recorded to compare it with."""
    near = lambda r: F.coalesce((F.abs(r - value) <= 1e-9) | (F.isnan(r) & F.isnan(value)), F.lit(False))
    return recorded.isNull() | F.exists(recorded, near)


def by_metric(long: DataFrame) -> DataFrame:
    """(field, available, rows, coverage): every metric, also those without values."""
    return long.groupBy("field").agg(F.count("value").alias("available"), F.count(F.lit(1)).alias("rows")).withColumn("coverage", percent(F.col("available"), F.col("rows")))


def by_group(properties: DataFrame, group: str = "reit_code") -> DataFrame:
    """(group, properties, numeric_values, with_coordinates, coordinate_coverage); blank groups together."""
    numeric = F.aggregate(F.array(*(F.when(F.col(m).isNotNull() & ~F.isnan(F.col(m)), 1).otherwise(0) for m in METRICS)), F.lit(0), lambda a, x: a + x)
    valid = F.when(coordinate_state(F.col("lat"), F.col("lng")) == "valid", 1).otherwise(0)
    g = F.when(blank(F.col(group)), F.lit(UNCLASSIFIED)).otherwise(F.col(group))
    out = properties.groupBy(g.alias("grp")).agg(F.count(F.lit(1)).alias("properties"), F.sum(numeric).alias("numeric_values"), F.sum(valid).alias("with_coordinates"))
    return out.withColumn("coordinate_coverage", percent(F.col("with_coordinates"), F.col("properties")))


def first_issues(issues: DataFrame, order: list[str], n: int = 20, by: str = "field") -> DataFrame:
    """The first n issues of each class."""
    from pyspark.sql import Window

    return issues.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_k") <= n).drop("_k")

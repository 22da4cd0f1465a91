"""The quality gate over a dataset: totals, checks, figures by group and by metric, and the status that decides on publishing.

A dataset is properties (id, a group, REQUIRED, lat, lng, METRICS, evidence) and periods (id, METRICS, evidence), where
evidence maps a metric to its item. Property and period records pass the same rules. Everything follows from one aggregate by
group without an explode: each metric's counts are columns of it, turned into rows only when a row for each group is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plotwise.functions.scalars import METRICS, blank, percent
from plotwise.operators import quality

#: The checks, in their order, with their severity.
CHECKS = (
    ("unique_property_id", "error"), ("required_fields", "error"), ("numeric_ranges", "error"), ("evidence_completeness", "error"), ("evidence_consistency", "error"),
    ("coordinates", "warning"), ("leased_area_consistency", "warning"),
)
_CELL = ("available", "complete", "mismatched", "outside")


def evidence_maps(evidence: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, evidence): a map field -> item, of several items of a field the last by order. Rows with null keys or fields are left out."""
    some = evidence.dropna(subset=[*keys, "field"])
    item = F.struct("metric_code", "unit", "value", "source_document_id", "retrieved_at", "locator", "extraction")
    last = some.groupBy(*keys, "field").agg(F.max_by(item, order).alias("item"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("field", "item"))).alias("evidence"))  # an item for each field


def records(properties: DataFrame, periods: DataFrame, group: str) -> DataFrame:
    """Both kinds of records with their property's group; periods of unknown properties are left out."""
    grp = F.when(blank(F.col(group)), F.lit(quality.UNCLASSIFIED)).otherwise(F.col(group)).alias("grp")
    coordinate = quality.coordinate_state(F.col("lat"), F.col("lng"))
    lacks = F.lit(False)
    for c in quality.REQUIRED:
        lacks = lacks | blank(F.col(c))
    top = properties.select("id", grp, F.lit(True).alias("is_property"), lacks.alias("lacks"), coordinate.alias("coordinate"), *METRICS, "evidence")
    owner = properties.where("id is not null").groupBy("id").agg(F.max(grp).alias("grp"))
    below = periods.select("id", *METRICS, "evidence").join(owner, "id")
    return top.unionByName(below.withColumns({"is_property": F.lit(False), "lacks": F.lit(False), "coordinate": F.lit("")}))


def _cells(field: str) -> dict[str, Column]:
    """What is counted of a metric: values, those with complete evidence, with evidence of something else, and out of range."""
    code, unit = METRICS[field]
    value, item = F.col(field).cast("double"), F.try_element_at("evidence", F.lit(field))
    given = value.isNotNull()
    complete = given & quality.item_complete(item)
    right = F.coalesce((item["metric_code"] == code) & (item["unit"] == unit) & (F.abs(item["value"] - value) <= 1e-9), F.lit(False))
    return {"available": given, "complete": complete, "mismatched": complete & ~right, "outside": given & quality.outside(field, value)}


def counts(rows: DataFrame) -> DataFrame:
    """One row for each group with all counts: those of records, and `metric|count` for each metric."""
    own = {
        "properties": F.col("is_property"), "periods": ~F.col("is_property"), "lacking": F.col("lacks"), "no_coordinates": F.col("coordinate") == "missing",
        "bad_coordinates": F.col("coordinate") == "invalid", "with_coordinates": F.col("coordinate") == "valid", "areas": quality.area_beyond(),
    }
    cells = {f"{m}|{n}": c for m in METRICS for n, c in _cells(m).items()}
    return rows.groupBy("grp").agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in {**own, **cells}.items()))


def _sum(which: str) -> Column:
    out = F.lit(0).cast("bigint")
    for m in METRICS:
        out = out + F.col(f"`{m}|{which}`")
    return out


def by_group(counted: DataFrame) -> DataFrame:
    """(grp, properties, periods, numeric_values, evidence_complete, with_coordinates and the two coverages in percent)."""
    rows = counted.select("grp", "properties", "periods", _sum("available").alias("numeric_values"), _sum("complete").alias("evidence_complete"), "with_coordinates")
    return rows.withColumns({"evidence_coverage": percent(F.col("evidence_complete"), F.col("numeric_values")), "coordinate_coverage": percent(F.col("with_coordinates"), F.col("properties"))})


def _whole(counted: DataFrame) -> DataFrame:
    return counted.agg(*(F.coalesce(F.sum(f"`{c}`"), F.lit(0)).alias(c) for c in counted.columns if c != "grp"))


def by_metric(counted: DataFrame) -> DataFrame:
    """(field, available, evidence_complete, coverage) of every metric, also of those without values."""
    cells = F.array(*(F.struct(F.lit(m).alias("field"), F.col(f"`{m}|available`").alias("available"), F.col(f"`{m}|complete`").alias("evidence_complete")) for m in METRICS))
    return _whole(counted).select(F.inline(cells)).withColumn("coverage", percent(F.col("evidence_complete"), F.col("available")))


def totals(counted: DataFrame, properties: DataFrame) -> DataFrame:
    """One row: the totals, errors, warnings and the status: failed with any error, else warning with any warning, else passed.

    Duplicates count distinct ids; a record breaks as many rules as it breaks; missing coordinates and areas are warnings.
    """
    doubled = quality.duplicate_ids(properties).agg(F.count(F.lit(1)).alias("duplicate_ids"))
    t = _whole(counted).join(doubled)  # one row each
    t = t.withColumns({"numeric_values": _sum("available"), "evidence_complete": _sum("complete"), "mismatched": _sum("mismatched"), "out_of_range": _sum("outside")})
    t = t.withColumn("errors", F.col("duplicate_ids") + F.col("lacking") + F.col("bad_coordinates") + F.col("out_of_range") + F.col("numeric_values") - F.col("evidence_complete") + F.col("mismatched"))
    t = t.withColumn("warnings", F.col("no_coordinates") + F.col("areas"))
    status = F.when(F.col("errors") > 0, "failed").when(F.col("warnings") > 0, "warning").otherwise("passed")
    return t.withColumns({"evidence_coverage": percent(F.col("evidence_complete"), F.col("numeric_values")), "coordinate_coverage": percent(F.col("with_coordinates"), F.col("properties")), "status": status})


TOTALS = ("status", "properties", "periods", "numeric_values", "evidence_complete", "evidence_coverage", "with_coordinates", "coordinate_coverage", "duplicate_ids", "errors", "warnings")


def checks(total: DataFrame) -> DataFrame:
    """(place, code, severity, status, n): the seven checks; the one on coordinates shows warning also for impossible ones."""
    n = {
        "unique_property_id": F.col("duplicate_ids"), "required_fields": F.col("lacking"), "numeric_ranges": F.col("out_of_range"), "evidence_completeness": F.col("numeric_values") - F.col("evidence_complete"),
        "evidence_consistency": F.col("mismatched"), "coordinates": F.col("no_coordinates") + F.col("bad_coordinates"), "leased_area_consistency": F.col("areas"),
    }
    bad = {"error": "failed", "warning": "warning"}
    rows = (F.struct(F.lit(k).alias("place"), F.lit(c).alias("code"), F.lit(s).alias("severity"), F.when(n[c] == 0, "passed").otherwise(bad[s]).alias("status"), n[c].alias("n")) for k, (c, s) in enumerate(CHECKS))
    return total.select(F.inline(F.array(*rows)))


def importer_issues(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, field, value): what an importer reports beside the gate: a cap rate that isn't above 0 and below 20, an occupancy outside 0 to 100."""
    cap, occ = F.col("cap"), F.col("occupancy")
    bad = F.array(F.when(cap.isNotNull() & ~((cap > 0) & (cap < 20)), F.struct(F.lit("cap").alias("field"), cap.alias("value"))), F.when(occ.isNotNull() & ~occ.between(0, 100), F.struct(F.lit("occupancy").alias("field"), occ.alias("value"))))
    return rows.select(*keys, F.inline(F.filter(bad, lambda x: x.isNotNull())))

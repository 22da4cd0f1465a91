"""What of a record may be shown outside: allowed columns only, with defaults; names, ids, hashes and raw paths stay behind.

Each is one projection of the stored report or supplement; members that aren't listed can't appear in its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plotwise.functions.scalars import safe_url

#: The figures that are shown of each report.
QUALITY_TOTALS = ("properties", "periods", "numeric_values", "evidence_complete", "evidence_coverage_percent", "with_coordinates", "coordinate_coverage_percent", "duplicate_ids", "errors", "warnings")
CHANGE_TOTALS = (
    "previous_properties", "current_properties", "properties_added", "properties_removed", "properties_changed", "master_field_changes", "periods_added", "periods_removed",
    "metric_values_added", "metric_values_removed", "metric_values_changed", "evidence_relinked",
)


def numbers(parent: Column | None, names: tuple[str, ...]) -> list[Column]:
    """The named figures of a struct or of the row itself, 0 where they are null."""
    at = (lambda n: parent[n]) if parent is not None else F.col
    return [F.coalesce(at(n), F.lit(0)).alias(n) for n in names]


def import_status(runs: DataFrame) -> DataFrame:
    """(run_id, status, finished_at, same_inputs, layout_status): layout_statuses is a map; none of them counts as new."""
    states = F.map_values("layout_statuses")
    layout = F.when(F.array_contains(states, "changed"), "changed").when((F.size(states) > 0) & F.forall(states, lambda s: s == "unchanged"), "unchanged").otherwise("new")
    return runs.select("run_id", "status", "finished_at", F.col("same_inputs_as_run_id").isNotNull().alias("same_inputs"), F.coalesce(layout, F.lit("new")).alias("layout_status"))


def quality_status(reports: DataFrame) -> DataFrame:
    """(status, generated_at, the totals) of quality reports."""
    return reports.select("status", "generated_at", *numbers(F.col("totals"), QUALITY_TOTALS))


def change_status(totals: DataFrame) -> DataFrame:
    """(status, the totals) of change reports."""
    return totals.select("status", *numbers(None, CHANGE_TOTALS))


def item(e: Column) -> Column:
    """An evidence item without its document, its sheet and who reviewed it."""
    loc, ext = e["locator"], e["extraction"]
    return F.struct(
        *(e[c].alias(c) for c in ("metric_code", "value", "unit", "observed_at", "retrieved_at")), F.struct(*(loc[c].alias(c) for c in ("type", "page", "bbox"))).alias("locator"),
        F.struct(*(ext[c].alias(c) for c in ("parser", "parser_version", "method", "confidence"))).alias("extraction"), F.struct(e["review"]["status"].alias("status")).alias("review"),
    )


def documents(rows: DataFrame) -> DataFrame:
    """(publisher, reit_code, title, period, as_of_date, url, retrieved_at) of source documents; a URL that isn't http or https is ''."""
    return rows.select("publisher", "reit_code", "title", "period", "as_of_date", F.coalesce(safe_url(F.col("url")), F.lit("")).alias("url"), "retrieved_at")

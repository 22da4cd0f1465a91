"""Operators over cells of sheets: finding rows and headers, turning wide tables long, layouts and their digests.

Cells have a sheet key, col (letters), row and a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plotwise.functions.scalars import column_number


def find_row(cells: DataFrame, keys: list[str], predicate: Column, max_row: int) -> DataFrame:
    """(keys, row): the first row up to max_row with a cell that satisfies the predicate."""
    return cells.where((F.col("row") <= max_row) & predicate).groupBy(*keys).agg(F.min("row").alias("row"))


def header_map(cells: DataFrame, keys: list[str], header: DataFrame, value: str = "value") -> DataFrame:
    """(keys, name, col): the column of each name in the header row; of equal names the last column."""
    met = cells.join(header.select(*keys, "row"), [*keys, "row"])
    named = met.withColumn("name", F.trim(F.col(value))).where("name <> ''")
    return named.groupBy(*keys, "name").agg(F.max_by("col", column_number(F.col("col"))).alias("col"))


def rows_by_columns(cells: DataFrame, keys: list[str], columns: dict[str, str], value: str = "value") -> DataFrame:
    """(keys, row, names...): one row per sheet row, a column for each wanted letter; one aggregation, no pivot query."""
    wanted = cells.where(F.col("col").isin(*columns))
    return wanted.groupBy(*keys, "row").agg(*(F.max(F.when(F.col("col") == c, F.col(value))).alias(n) for c, n in columns.items()))


def wide_to_long(rows: DataFrame, keys: list[str], groups: dict[str, dict[str, str]], name: str = "period") -> DataFrame:
    """A row for each group of columns that has any value: groups: label -> {output column: input column}."""
    outs = list(next(iter(groups.values())))
    cells = F.array(*(F.struct(F.lit(label).alias(name), *(F.col(m[o]).alias(o) for o in outs)) for label, m in groups.items()))
    any_value = F.lit(False)
    for o in outs:
        any_value = any_value | F.col(o).isNotNull()
    return rows.select(*keys, F.inline(cells)).where(any_value)


def missing_names(required: DataFrame, present: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """Required (keys, name) that aren't present."""
    return required.join(present.select(*keys, name).distinct(), [*keys, name], "left_anti")


def layout_fingerprint(layout: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, fingerprint): a digest of a document's sheets that doesn't depend on their order. A document has few sheets."""
    line = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return layout.groupBy(*keys).agg(F.sha2(F.encode(F.array_join(F.sort_array(F.collect_list(line)), "\n"), "UTF-8"), 256).alias("fingerprint"))

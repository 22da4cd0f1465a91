"""Filters, sorts, selections and exports over property rows."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from plotwise.functions.scalars import RADIUS_DEFAULT, RADIUS_HIGH, RADIUS_LOW, blank, clamp_radius, csv_value, finite
from plotwise.operators.geo import EARTH_RADIUS_KM, haversine_km, valid_coordinate
from plotwise.session import materialize


def equals(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows with the wanted values; an empty or missing value is no filter."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]) if kv[1] else d, wanted.items(), df)


def contains_text(df: DataFrame, text: str, fields: tuple[str, ...] = ("name", "address", "reit")) -> DataFrame:
    """Rows whose fields, joined by spaces, hold the text; case and outer white space don't matter."""
    needle = text.strip().lower()
    return df.where(F.contains(F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in map(F.col, fields)))), F.lit(needle))) if needle else df


def in_range(df: DataFrame, field: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Both bounds inclusive; without bounds nulls pass, with one they don't."""
    v = finite(F.col(field))
    df = df.where(v >= low) if low is not None else df
    return df.where(v <= high) if high is not None else df


def in_bounds(df: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    return df.where(F.col("lat").between(south, north) & F.col("lng").between(west, east) & valid_coordinate(F.col("lat"), F.col("lng")))


def clamped_radius(km: float | None) -> float:
    """A search radius within its bounds; the default for none, negative ones and what isn't a number."""
    return min(RADIUS_HIGH, max(RADIUS_LOW, km)) if km is not None and math.isfinite(km) and km >= 0 else RADIUS_DEFAULT


def within_radius(df: DataFrame, lat: float, lng: float, km: float | None) -> DataFrame:
    """Rows at most km away, clamped, with the distance; a box around the circle goes to the scan before any trigonometry.

    The box crosses the 180th meridian where the circle does, and has all longitudes where the circle holds a pole.
    """
    km = clamped_radius(km)
    reach = km / 111.19492664455873 * (1 + 1e-9)
    box = F.col("lat").between(lat - reach, lat + reach)
    if abs(lat) + reach < 90:
        wide = math.degrees(math.asin(min(1.0, math.sin(math.radians(reach)) / math.cos(math.radians(lat))))) * (1 + 1e-9)
        x = F.col("lng")
        box = box & (x.between(lng - wide, lng + wide) | (x >= lng - wide + 360) | (x <= lng + wide - 360))
    some = df.where(box & valid_coordinate(F.col("lat"), F.col("lng")))
    return some.withColumn("km", haversine_km(F.col("lat"), F.col("lng"), F.lit(lat), F.lit(lng))).where(F.col("km") <= km)


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """df with `rank`, its place from 1 in the total order, without bringing the table into one task.

    The rows are range-partitioned and sorted; a partition's rows are numbered there and shifted by the sizes of the
    partitions before it.
    """
    parts = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").count().withColumn("_before", F.sum("count").over(Window.orderBy("_part")) - F.col("count"))  # a row for each partition
    numbered = parts.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return numbered.join(F.broadcast(sizes.drop("count")), "_part").withColumn("rank", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def sort_order(field: str, descending: bool, *ties: str) -> list[Column]:
    """Nulls last either way, then the ties."""
    c = F.col(field)
    return [c.desc_nulls_last() if descending else c.asc_nulls_last(), *(F.col(t).asc_nulls_last() for t in ties)]


def bounded_selection(existing: DataFrame, added: DataFrame, limit: int) -> DataFrame:
    """(id, ord): what was selected stays, then the added in their order, each once, up to the limit. Both have id and ord."""
    both = existing.select("id", F.struct(F.lit(0).alias("s"), F.col("ord").cast("bigint").alias("o")).alias("at")).unionByName(added.select("id", F.struct(F.lit(1).alias("s"), F.col("ord").cast("bigint").alias("o")).alias("at")))
    first = both.groupBy("id").agg(F.min("at").alias("at")).orderBy("at", "id").limit(limit)
    return first.select("id", F.row_number().over(Window.orderBy("at", "id")).alias("ord"))  # at most `limit` rows


def facets(df: DataFrame, *columns: str) -> DataFrame:
    """(facet, value): the distinct values that aren't blank of each column; one scan."""
    return df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in columns)))).where(~blank(F.col("value"))).distinct()


def csv_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """One quoted line for each row; quotes doubled, nulls empty."""
    return df.select(F.concat_ws(",", *(csv_value(F.col(c)) for c in columns)).alias("line"))


#: The sorts that are offered, as field-direction; area is the leasable area.
SORTS = ("name-asc", "cap-asc", "cap-desc", "terminal_cap_rate-asc", "terminal_cap_rate-desc", "price-desc", "price-asc", "occupancy-desc", "area-desc")
#: Fixed value: how many properties may be selected.
SELECTION = 50


def offered_sort(name: str) -> list[Column]:
    """The order of an offered sort: nulls last either way, then by name; names in Japanese collation. ValueError for any other."""
    if name not in SORTS:
        raise ValueError(f"unknown sort {name}")
    field, direction = name.rsplit("-", 1)
    field = {"area": "leasable_area"}.get(field, field)
    by_name = F.collate("name", "ja").asc_nulls_last()
    if field == "name":
        return [by_name, F.col("id").asc_nulls_last()]
    c = finite(F.col(field))
    return [c.desc_nulls_last() if direction == "desc" else c.asc_nulls_last(), by_name, F.col("id").asc_nulls_last()]


def search(df: DataFrame, equal: dict[str, str | None] | None = None, text: str = "", ranges: dict[str, tuple[float | None, float | None]] | None = None, bounds: tuple[float, float, float, float] | None = None, circle: tuple[float, float, float | None] | None = None) -> DataFrame:
    """Attributes, then the box, then the circle, as one plan: Catalyst puts all predicates into the scan where it can.

    bounds: south, north, west, east. circle: lat, lng, km; adds the distance km. What isn't given filters nothing.
    """
    df = contains_text(equals(df, **(equal or {})), text)
    for field, (low, high) in (ranges or {}).items():
        df = in_range(df, field, low, high)
    if bounds:
        df = in_bounds(df, *bounds)
    return within_radius(df, *circle) if circle else df


def restored_selection(saved: DataFrame, properties: DataFrame, limit: int = SELECTION) -> DataFrame:
    """(id, ord): the saved ids (id, ord) that still exist, each once, in their order, up to the limit."""
    known = saved.join(properties.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("ord").alias("o")).orderBy("o", "id").limit(limit)
    return known.select("id", F.row_number().over(Window.orderBy("o", "id")).alias("ord"))  # at most `limit` rows


def selected(properties: DataFrame, selection: DataFrame) -> DataFrame:
    """The selected properties; their order is that of the dataset, whatever the selection's."""
    return properties.join(selection.select("id"), "id", "left_semi")


def extent(df: DataFrame) -> DataFrame:
    """(south, north, west, east, n) of the rows with valid coordinates; nulls where there are none."""
    some = df.where(valid_coordinate(F.col("lat"), F.col("lng")))
    return some.agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lng").alias("west"), F.max("lng").alias("east"), F.count(F.lit(1)).alias("n"))


def destination(lat: Column, lng: Column, km: Column, bearing: Column) -> Column:
    """struct(lat, lng): the point km away (clamped as a search radius) in the direction of the bearing in degrees; null without a point."""
    d = clamp_radius(km) / EARTH_RADIUS_KM
    p, t = F.radians(lat), F.radians(bearing)
    q = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(t))
    x = F.radians(lng) + F.atan2(F.sin(t) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(q))
    return F.when(valid_coordinate(lat, lng), F.struct(F.degrees(q).alias("lat"), F.degrees(x).alias("lng")))

"""Properties comparable to given ones, by a weighted score."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from plotwise.functions.scalars import finite
from plotwise.operators.geo import EARTH_RADIUS_KM, valid_coordinate
from plotwise.operators.pairs import hot_salts, part_of
from plotwise.session import BROADCAST_LIMIT_BYTES, materialize

#: Fixed values: (derived column, difference at which the penalty is full, weight).
_PENALTIES = (("area", math.log(4.0), 20.0), ("amount", math.log(4.0), 10.0), ("cap", 1.5, 15.0), ("tcr", 1.5, 15.0), ("occ", 10.0, 10.0))
_KM_FULL, _KM_WEIGHT = 50.0, 30.0
#: A row beyond the full distance scores at most this.
_FAR_SCORE = 100 - int(_KM_WEIGHT)
#: Edge of a cell in km, more than the full distance; slack of the bounds, far above the rounding of distances and scores; estimated bytes of a query.
_CELL_KM, _SLACK, _QUERY_BYTES = _KM_FULL * 1.001, 1e-5, 240


def derived(df: DataFrame, prefix: str) -> DataFrame:
    """What the score and its bounds need of a row, worked out once before rows meet: radians, cosine, logarithms, the place in space in km and its cell; null where missing."""
    ok = valid_coordinate(F.col("lat"), F.col("lng"))
    lat = F.when(ok, F.radians("lat"))
    log = lambda c: F.when(finite(F.col(c)) > 0, F.ln(F.when(F.col(c) > 0, F.col(c))))
    lng = F.when(ok, F.radians("lng"))
    x, y, z = (EARTH_RADIUS_KM * c for c in (F.cos(lat) * F.cos(lng), F.cos(lat) * F.sin(lng), F.sin(lat)))
    cols = {"lat": lat, "cos": F.cos(lat), "lng": lng, "x": x, "y": y, "z": z, "area": log("leasable_area"), "amount": log("price"), "cap": finite(F.col("cap")), "tcr": finite(F.col("terminal_cap_rate")), "occ": finite(F.col("occupancy"))}
    return df.select(F.col("id").alias(f"{prefix}id"), "type", *(c.alias(prefix + n) for n, c in cols.items()))


def _penalty(off: Column, full: float, weight: float) -> Column:
    """In proportion up to the weight; half of it where a value is missing."""
    return F.when(off.isNull(), weight / 2).when(off < full, off * (weight / full)).otherwise(weight)


def score(a: str, b: str) -> Column:
    """100 less the penalties for distance, area, price, rates and occupancy, rounded half up, at least 0."""
    x = lambda n: (F.col(a + n), F.col(b + n))
    (p, q), (u, v), (c, d) = x("lat"), x("lng"), x("cos")
    h = F.pow(F.sin((q - p) / 2), 2) + c * d * F.pow(F.sin((v - u) / 2), 2)
    lost = _penalty(F.round(2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.when(h < 1, h).when(h.isNotNull(), 1.0))), 6), _KM_FULL, _KM_WEIGHT)
    for n, full, weight in _PENALTIES:
        lost = lost + _penalty(F.abs(F.col(a + n) - F.col(b + n)), full, weight)
    return F.greatest(F.lit(0.0), F.floor(F.round(100 - lost, 9) + 0.5)).cast("int")


def _lost(a: str, b: str, stretch: float) -> Column:
    """The penalties without trigonometry and rounding, the distance taken as `stretch` times the straight line, which is shorter than the arc by less than 3 in a million."""
    d = [F.col(a + n) - F.col(b + n) for n in "xyz"]
    km = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    part = lambda off, full, weight: F.least(F.coalesce(off * (weight / full), F.lit(weight / 2)), F.lit(weight))
    lost = part(km, _KM_FULL / stretch, _KM_WEIGHT)
    for n, full, weight in _PENALTIES:
        lost = lost + part(F.abs(F.col(a + n) - F.col(b + n)), full, weight)
    return lost


def _cell(*at: Column) -> Column:
    i, j, k = at
    return (i * 1000 + j) * 1000 + k


def _meet(rows: DataFrame, queries: DataFrame, *keys: str) -> DataFrame:
    """Rows and queries with equal keys; the rows of hot keys are split. Never broadcast, since queries may have been multiplied."""
    salts = hot_salts(rows, [*keys], 20_000)
    n = F.coalesce(F.col("_salts"), F.lit(1))
    r = rows.join(salts, [*keys], "left").withColumn("_part", part_of(n, "r_id")).drop("_salts")
    q = queries.join(salts, [*keys], "left").withColumn("_part", F.explode(F.sequence(F.lit(0), n - 1))).drop("_salts")
    return r.join(q.hint("merge"), [*keys, "_part"]).where(F.col("q_id") != F.col("r_id"))


def _of_type(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """All rows of a query's type; the queries are broadcast if their number allows."""
    if queries.count() * _QUERY_BYTES <= BROADCAST_LIMIT_BYTES:
        return rows.join(F.broadcast(queries), "type").where(F.col("q_id") != F.col("r_id"))
    return _meet(rows, queries, "type")


def _near(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows and queries of a type in cells of space that touch: all that are within the full distance."""
    floor = lambda p, n: F.floor(F.col(p + n) / _CELL_KM) + 500
    steps = F.array(*(F.lit((i * 1000 + j) * 1000 + k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)))
    r = rows.where("r_lat is not null").withColumn("cell", _cell(*(floor("r_", n) for n in "xyz")))
    q = queries.where("q_lat is not null").withColumn("step", F.explode(steps)).withColumn("cell", _cell(*(floor("q_", n) for n in "xyz")) + F.col("step")).drop("step")
    return _meet(r, q, "type", "cell")


def _least(met: DataFrame, k: int, at_least: int = 0) -> DataFrame:
    """(q_id, n, least): of a query's rows, how many surely score at_least, and the score that k of them, or all if there are fewer, surely reach."""
    sure = met.withColumn("score", F.floor(100.5 - _SLACK - _lost("q_", "r_", 1 + _SLACK)).cast("int"))
    counts = sure.where(F.col("score") >= at_least).groupBy("q_id", "score").count()
    above = F.coalesce(F.sum("count").over(Window.partitionBy("q_id").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("above", above).groupBy("q_id").agg(F.sum("count").alias("n"), F.min(F.when(F.col("above") < k, F.col("score"))).alias("least"))


def candidates(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """Pairs of derived() queries (q_) and rows (r_) of a type, among them the k best of each query and all that tie with them.

    Bounds of the score without trigonometry tell which rows can be left out. A query that has k rows above 70 within the
    full distance (50 km) needs only those rows and the ones without coordinates, since a row beyond it loses 30. The other queries, and
    those without coordinates, meet all rows of their type. Of what meets, only pairs that can reach the score that k rows
    surely have go on.
    """
    near = _least(_near(rows, queries), k, _FAR_SCORE + 1).where(F.col("n") >= k).select("q_id", "least")
    q = materialize(queries.join(near, "q_id", "left"))
    found, other = q.where("least is not null"), materialize(q.where("least is null").drop("least"))
    other = materialize(other.join(_least(_of_type(rows, other), k).select("q_id", "least"), "q_id"))
    reaches = _lost("q_", "r_", 1.0) <= 100.5 + _SLACK - F.col("least")
    columns = [*queries.columns, *(c for c in rows.columns if c != "type")]
    apart = found.where(F.col("least") <= 100 - int(_KM_WEIGHT / 2))
    met = (_near(rows, found), _of_type(rows.where("r_lat is null"), apart), _of_type(rows, other))
    out = [m.where(reaches).select(*columns) for m in met]
    return out[0].unionByName(out[1]).unionByName(out[2])


def comparables(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """(base_id, id, score, rank): for each query the k most similar rows of its type, itself left out, ties by id.

    Exact scores are worked out only for candidates(), which hold all rows that can be among the k best.
    """
    q, r = materialize(derived(queries, "q_")), materialize(derived(rows, "r_"))
    best = candidates(q, r, k).select(F.col("q_id").alias("base_id"), F.col("r_id").alias("id"), score("q_", "r_").alias("score"))
    w = Window.partitionBy("base_id").orderBy(F.col("score").desc(), "id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

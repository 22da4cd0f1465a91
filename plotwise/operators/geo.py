"""Distances, neighbours within a radius, and the areas that contain a point.

Both joins are equi-joins on grid cells. A pair of points or a point and an area is compared exactly only if a cell brings
them together; points in a cell that lies wholly inside an area are accepted without a test.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from plotwise.operators.pairs import hot_salts, part_of
from plotwise.session import broadcast_if_small, materialize

EARTH_RADIUS_KM = 6371.0


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance on a sphere of radius 6,371 km; null if any coordinate is null."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    a = F.least(F.lit(1.0), a)
    return 2 * EARTH_RADIUS_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def valid_coordinate(lat: Column, lng: Column) -> Column:
    """True for finite coordinates within ±90 and ±180 that aren't both zero; never null."""
    ok = ~F.isnan(lat) & ~F.isnan(lng) & lat.between(-90, 90) & lng.between(-180, 180) & ~((lat == 0) & (lng == 0))
    return F.coalesce(ok, F.lit(False))


def points(df: DataFrame, key: str = "id", lat: str = "lat", lng: str = "lng") -> DataFrame:
    """(pid, plat, plng): the distinct keys with valid coordinates, written once for all joins that read them."""
    pts = df.select(F.col(key).alias("pid"), F.col(lat).cast("double").alias("plat"), F.col(lng).cast("double").alias("plng"))
    return materialize(pts.where(F.col("pid").isNotNull() & valid_coordinate(F.col("plat"), F.col("plng"))).distinct())


def near_pairs(df: DataFrame, radius_km: float, key: str = "id", lat: str = "lat", lng: str = "lng", cell_factor: float = 2.0, hot_cell: int = 4000, fine: int = 8, pts: DataFrame | None = None) -> DataFrame:
    """(left_id, right_id, km): each two different keys at most radius_km apart, the smaller key first, once.

    The sphere is cut into bands of latitude of cell_factor radii and each band into columns of about that width, so cells
    keep their size at any latitude and wrap at the 180th meridian. The left side visits the one to four cells its circle
    touches, the right side stays in its own. The cover adapts to the density: cells of more than hot_cell points are cut into
    fine x fine smaller ones, and of these a circle visits those it touches; those wholly inside it accept all their points at
    once, and only those on its border, and the cells that weren't cut, take the test of the distance. Cells that are still hot
    (many points at one place) are split on both sides, so no group has more than about hot_cell rows of the right side.
    Rows with a null key or an invalid coordinate take no part; repeated rows count once; an empty table gives no rows.
    pts: points() of df, if there are any already.
    """
    if not radius_km > 0 or math.degrees(radius_km / EARTH_RADIUS_KM) * cell_factor > 60:
        raise ValueError("radius_km must be positive and much smaller than the earth")
    pts = points(df, key, lat, lng) if pts is None else pts
    reach = math.degrees(radius_km / EARTH_RADIUS_KM) * (1 + 1e-9)
    height = reach * cell_factor

    def columns(band: Column) -> Column:
        middle = F.least(F.lit(90.0), F.greatest(F.lit(-90.0), (band + 0.5) * height - 90))
        return F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(middle)) / height).cast("int"))

    def column_of(x: Column, band: Column) -> Column:
        return F.floor((x + 180) / (360.0 / columns(band))).cast("int")

    plat, plng = F.col("plat"), F.col("plng")
    band = F.floor((plat + 90) / height).cast("int")
    own = pts.withColumn("band", band).withColumn("col", F.pmod(column_of(plng, F.col("band")), columns(F.col("band"))))
    cell = ["band", "col"]
    dense = broadcast_if_small(materialize(own.groupBy(*cell).count().where(F.col("count") > hot_cell).select(*cell, F.lit(True).alias("dense"))), 24)
    width, step = 360.0 / columns(F.col("band")), height / fine
    at = lambda x, start, size: F.least(F.lit(fine - 1), F.greatest(F.lit(0), F.floor((x - start) / size).cast("int")))
    south, west = F.col("band") * height - 90, F.col("col") * width - 180
    sub = at(plat, south, step) * fine + at(plng, west, width / fine)
    own = own.join(dense, cell, "left").withColumn("sub", F.when(F.col("dense"), sub).otherwise(-1))

    # Widest difference in longitude of a point within reach; all of them where the circle holds a pole.
    spread = F.when(F.abs(plat) + reach >= 90, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), math.sin(math.radians(reach)) / F.cos(F.radians(plat))))) * (1 + 1e-9))
    bands = F.sequence(F.floor((plat - reach + 90) / height).cast("int"), F.floor((plat + reach + 90) / height).cast("int"))

    def cells(b: Column) -> Column:
        around = F.when(F.col("spread") >= 180, F.sequence(F.lit(0), columns(b) - 1)).otherwise(F.sequence(column_of(plng - F.col("spread"), b), column_of(plng + F.col("spread"), b)))
        return F.array_distinct(F.transform(around, lambda c: F.struct(b.alias("band"), F.pmod(c, columns(b)).alias("col"))))

    visits = pts.withColumn("spread", spread).select("pid", "plat", "plng", "spread", F.inline(F.flatten(F.transform(bands, cells)))).join(dense, cell, "left")

    def smaller(k: Column) -> Column:
        """A smaller cell with whether the circle touches it and holds it: the path to its farthest corner is no longer than this bound."""
        dy = F.abs(plat - (south + (F.floor(k / fine) + 0.5) * step))
        dx = F.abs(F.pmod(west + (F.pmod(k, F.lit(fine)) + 0.5) * (width / fine) - plng + 180, F.lit(360.0)) - 180)
        far_y, far_x = dy + step / 2, dx + width / fine / 2
        bound = F.radians(F.sqrt(F.pow(far_y, 2) + F.pow(far_x * F.cos(F.radians(F.greatest(F.lit(0.0), F.abs(plat) - far_y))), 2))) * EARTH_RADIUS_KM
        touched = (dy - step / 2 <= reach) & (dx - width / fine / 2 <= F.col("spread"))
        return F.struct(k.cast("int").alias("sub"), touched.alias("touched"), (bound <= radius_km * (1 - 1e-9)).alias("inside"))

    whole = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(True).alias("touched"), F.lit(False).alias("inside")))
    parts = F.filter(F.transform(F.sequence(F.lit(0), F.lit(fine * fine - 1)), smaller), lambda x: x["touched"])
    visits = visits.select("pid", "plat", "plng", *cell, F.inline(F.when(F.col("dense"), parts).otherwise(whole)))
    at_cell = [*cell, "sub"]
    hot = hot_salts(own, at_cell, hot_cell)
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    side = lambda rows: rows.join(hot, at_cell, "left").withColumn("n", salts).withColumn("p", part_of(F.col("n"), "pid", "plat", "plng"))
    every = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    left = side(visits).select(*at_cell, "inside", F.col("p").alias("i"), every.alias("j"), F.col("pid").alias("a"), F.col("plat").alias("alat"), F.col("plng").alias("alng"))
    right = side(own).select(*at_cell, every.alias("i"), F.col("p").alias("j"), F.col("pid").alias("b"), F.col("plat").alias("blat"), F.col("plng").alias("blng"))
    km = haversine_km(F.col("alat"), F.col("alng"), F.col("blat"), F.col("blng"))
    # The latitude test costs one comparison and throws out most pairs before any trigonometry.
    met = left.join(right, [*at_cell, "i", "j"]).where((F.col("a") < F.col("b")) & (F.col("inside") | (F.abs(F.col("alat") - F.col("blat")) <= reach)))
    near = met.where(F.when(F.col("inside"), F.lit(True)).otherwise(km <= radius_km)).select(F.col("a").alias("left_id"), F.col("b").alias("right_id"), km.alias("km"))
    # Only an id whose rows give several places can meet the same partner twice.
    if pts.groupBy("pid").count().where("count > 1").isEmpty():
        return near
    return near.groupBy("left_id", "right_id").agg(F.min("km").alias("km"))


def near_counts(df: DataFrame, radius_km: float, **how) -> DataFrame:
    """(id, neighbours) of each key with any: how many keys are within the radius. It grows with the rows; pairs are counted where they meet."""
    near = near_pairs(df, radius_km, **how)
    return near.select(F.explode(F.array("left_id", "right_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("neighbours"))


# --- areas ---------------------------------------------------------------------------------------------------------------

_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")


def parse_wkt(wkt: str | None) -> list[list[np.ndarray]]:
    """The polygons of a POLYGON or MULTIPOLYGON, each a list of rings (exterior first) of longitude and latitude.

    Null, empty or other texts give no polygon. Repeated points are dropped and rings closed.
    """
    text = (wkt or "").strip()
    if not re.match(r"(?i)(MULTI)?POLYGON", text):
        return []
    polygons: list[list[np.ndarray]] = []
    for piece in re.findall(r"\(\s*(\([^()]*\)(?:\s*,\s*\([^()]*\))*)\s*\)", text):
        rings = []
        for ring in re.findall(r"\(([^()]*)\)", piece):
            pts = [tuple(map(float, _NUMBER.findall(p)[:2])) for p in ring.split(",")]
            pts = [p for k, p in enumerate(pts) if len(p) == 2 and (k == 0 or p != pts[k - 1])]
            if pts and pts[0] != pts[-1]:
                pts.append(pts[0])
            rings.append(np.array(pts, dtype=float).reshape(-1, 2))
        if rings and len(rings[0]) >= 4:
            polygons.append([r for r in rings if len(r) >= 4])
    return polygons


def _inside(edges: np.ndarray, ring: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which points are in the exterior ring (0) and in no hole."""
    out = np.zeros(len(x), dtype=bool)
    rings = int(ring.max()) + 1
    for at in range(0, len(x), max(1, 2_000_000 // len(edges))):
        px, py = x[at : at + max(1, 2_000_000 // len(edges)), None], y[at : at + max(1, 2_000_000 // len(edges)), None]
        cross = (edges[:, 1] > py) != (edges[:, 3] > py)
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = cross & (px < (edges[:, 2] - edges[:, 0]) * (py - edges[:, 1]) / (edges[:, 3] - edges[:, 1]) + edges[:, 0])
        odd = np.stack([hit[:, ring == k].sum(1) % 2 == 1 for k in range(rings)], 1)
        out[at : at + len(px)] = odd[:, 0] & ~odd[:, 1:].any(1)
    return out


def _touching(e: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """Which edges meet their boxes, borders included; one box for each edge."""
    ax, ay, bx, by = e.T
    near = (np.minimum(ax, bx) <= x1) & (np.maximum(ax, bx) >= x0) & (np.minimum(ay, by) <= y1) & (np.maximum(ay, by) >= y0)
    side = [(bx - ax) * (cy - ay) - (by - ay) * (cx - ax) for cx, cy in ((x0, y0), (x0, y1), (x1, y0), (x1, y1))]
    return near & (np.minimum.reduce(side) <= 0) & (np.maximum.reduce(side) >= 0)


MAX_LEVEL = 26


def cover_polygon(rings: list[np.ndarray], depth: int) -> Iterator[tuple[int, int, int, bool, list[list[list[float]]]]]:
    """Quadtree cells (level, ix, iy, interior, edges by ring) that cover the polygon.

    Cells that no edge meets are either wholly inside (interior) or left out; the others are cut again, down to `depth`
    levels below the level whose cells are as large as the polygon. A boundary cell carries just the edges that a ray from
    one of its points to the east can meet.
    """
    edges = np.concatenate([np.hstack([r[:-1], r[1:]]) for r in rings])
    ring = np.concatenate([np.full(len(r) - 1, k) for k, r in enumerate(rings)])
    (lx, ly), (hx, hy) = edges.reshape(-1, 2).min(0), edges.reshape(-1, 2).max(0)
    start = max(0, min(MAX_LEVEL - 1, int(math.floor(math.log2(360.0 / max(hx - lx, hy - ly, 1e-9))))))
    last, slack = min(MAX_LEVEL, start + depth), 1e-9
    size = 360.0 / 2**start
    cols, rows = np.arange(math.floor((lx + 180) / size), math.floor((hx + 180) / size) + 1), np.arange(math.floor((ly + 90) / size), math.floor((hy + 90) / size) + 1)
    ix, iy = (a.ravel() for a in np.meshgrid(cols, rows))
    # All cells of a level at once, each with the edges that met its parent: pairs of a cell's place and an edge's.
    of_cell, of_edge = np.repeat(np.arange(len(ix)), len(edges)), np.tile(np.arange(len(edges)), len(ix))
    for level in range(start, last + 1):
        size = 360.0 / 2**level
        x0, y0 = ix * size - 180, iy * size - 90
        meets = _touching(edges[of_edge], x0[of_cell] - slack, y0[of_cell] - slack, (x0 + size)[of_cell] + slack, (y0 + size)[of_cell] + slack)
        of_cell, of_edge = of_cell[meets], of_edge[meets]
        border = np.bincount(of_cell, minlength=len(ix)) > 0
        free = np.nonzero(~border)[0]
        for k in free[_inside(edges, ring, x0[free] + size / 2, y0[free] + size / 2)]:
            yield level, int(ix[k]), int(iy[k]), True, []
        if level == last:
            low, high, right = np.minimum(edges[:, 1], edges[:, 3]), np.maximum(edges[:, 1], edges[:, 3]), np.maximum(edges[:, 0], edges[:, 2])
            for k in np.nonzero(border)[0]:
                ray = np.nonzero((low <= y0[k] + size + slack) & (high >= y0[k] - slack) & (right >= x0[k] - slack))[0]
                yield level, int(ix[k]), int(iy[k]), False, [edges[ray[ring[ray] == r]].tolist() for r in range(len(rings))]
            return
        kept = np.nonzero(border)[0]
        place = np.full(len(ix), -1)
        place[kept] = np.arange(len(kept))
        ix, iy = (np.repeat(2 * a[kept], 4) + np.tile(d, len(kept)) for a, d in ((ix, [0, 0, 1, 1]), (iy, [0, 1, 0, 1])))
        of_cell, of_edge = np.repeat(place[of_cell] * 4, 4) + np.tile([0, 1, 2, 3], len(of_cell)), np.repeat(of_edge, 4)


def cover_areas(areas: DataFrame, key: str = "area_id", wkt: str = "wkt", depth: int = 6) -> DataFrame:
    """(area, level, ix, iy, interior, rings) of all polygons of all areas; one row of geometry at a time, in Arrow batches."""

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for area, text in zip(batch["area"], batch["wkt"], strict=True):
                rows = [(area, *cell) for rings in parse_wkt(text) for cell in cover_polygon(rings, depth)]
                for at in range(0, len(rows), 5000):
                    yield pd.DataFrame(rows[at : at + 5000], columns=["area", "level", "ix", "iy", "interior", "rings"])

    src = areas.select(F.col(key).cast("string").alias("area"), F.col(wkt).alias("wkt")).where("area is not null and wkt is not null")
    # A shape is a lot of work and few bytes: a small table would come in one task.
    src = src.repartition(areas.sparkSession.sparkContext.defaultParallelism)
    return src.mapInPandas(cover, "area string, level int, ix int, iy int, interior boolean, rings array<array<array<double>>>")


def _odd(edges: Column) -> Column:
    """Whether a ray to the east from (plng, plat) meets an odd number of the edges."""
    x, y = F.col("plng"), F.col("plat")

    def met(e: Column) -> Column:
        return ((e[1] > y) != (e[3] > y)) & (x < (e[2] - e[0]) * (y - e[1]) / F.when(e[3] == e[1], F.lit(1.0)).otherwise(e[3] - e[1]) + e[0])

    return F.size(F.filter(edges, met)) % 2 == 1


def containing_areas(df: DataFrame, areas: DataFrame, key: str = "id", lat: str = "lat", lng: str = "lng", area: str = "area_id", wkt: str = "wkt", depth: int = 6, pts: DataFrame | None = None) -> DataFrame:
    """(point_id, area_id): each point with each area that contains it, holes left out, once.

    Adaptive coverage: the polygons become quadtree cells, the points meet them by an equi-join on the cell. Interior cells
    accept at once; only points in boundary cells take the exact ray test, against the few edges the cell carries. The
    coverage is broadcast if its measured size allows, else the join shuffles and AQE splits hot cells. Null keys, invalid
    coordinates, null or unreadable shapes take no part; empty tables give no rows. A point on an edge may fall either way.
    pts: points() of df, if there are any already.
    """
    spark = df.sparkSession
    pts = points(df, key, lat, lng) if pts is None else pts
    cover = materialize(cover_areas(areas, area, wkt, depth))
    levels = sorted(r["level"] for r in cover.select("level").distinct().collect())  # at most MAX_LEVEL + 1
    if not levels:
        return spark.createDataFrame([], f"point_id {pts.schema['pid'].dataType.simpleString()}, area_id string")
    size = lambda level: F.lit(360.0) / F.pow(F.lit(2.0), level)
    at = F.transform(F.array(*map(F.lit, levels)), lambda k: F.struct(k.alias("level"), F.floor((F.col("plng") + 180) / size(k)).cast("int").alias("ix"), F.floor((F.col("plat") + 90) / size(k)).cast("int").alias("iy")))
    visits = pts.select("pid", "plat", "plng", F.inline(at))
    cover = broadcast_if_small(cover, F.lit(64) + 48 * F.aggregate("rings", F.lit(0), lambda n, r: n + F.size(r)))
    met = visits.join(cover, ["level", "ix", "iy"])
    exact = _odd(F.col("rings")[0]) & ~F.exists(F.slice("rings", F.lit(2), F.size("rings")), _odd)
    inside = met.where(F.when(F.col("interior"), F.lit(True)).otherwise(exact))
    return inside.select(F.col("pid").alias("point_id"), F.col("area").alias("area_id")).distinct()

"""The general pipeline operators against brute force on small inputs, edge cases included."""

import datetime
import json
import math
import random

import pytest

from plotwise.operators import geo, nested, profile, snapshots

TS = datetime.datetime(2024, 1, 1)


def km(a, b):
    (p, q), (r, s) = [(math.radians(x), math.radians(y)) for x, y in (a, b)]
    h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("hot", [3, 4000])
def test_near_pairs(spark, hot):
    rnd = random.Random(3)
    at = {}
    for k in range(40):
        for base in ((35.0, 139.0), (0.001, 179.9999), (89.9999, 10.0), (-68.0, -30.0)):
            lat, lng = base[0] + rnd.uniform(-0.003, 0.003), base[1] + rnd.uniform(-0.003, 0.003)
            at[f"{base[0]}-{k:02}"] = (max(-90, min(90, lat)), lng - 360 if lng > 180 else lng)
    for k in range(5):
        at[f"same-{k}"] = (35.0, 139.0)
    want = {(a, b) for a in at for b in at if a < b and km(at[a], at[b]) <= 0.15}
    rows = [(k, float(v[0]), float(v[1]), "x") for k, v in at.items()] + [("same-1", 35.0, 139.0, "again"), (None, 35.0, 139.0, ""), ("n", None, 139.0, ""), ("nan", math.nan, 139.0, ""), ("zero", 0.0, 0.0, ""), ("far", 91.0, 0.0, "")]
    df = spark.createDataFrame(rows, "id string, lat double, lng double, band string")
    got = [(r.left_id, r.right_id) for r in geo.near_pairs(df, 0.15, hot_cell=hot).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert geo.near_pairs(df.limit(0), 0.15).count() == 0


def test_containing_areas(spark):
    areas = spark.createDataFrame([
        ("hole", "POLYGON ((0 0, 10 0, 10 10, 10 10, 0 10, 0 0), (4 4, 4 6, 6 6, 6 4, 4 4))"), ("two", "MULTIPOLYGON (((20 0, 22 0, 22 2, 20 2, 20 0)), ((21 1, 30 1, 30 9, 21 9, 21 1)))"),
        ("null", None), ("empty", "POLYGON EMPTY"), ("bad", "LINE (1 1)"),
    ], "area_id string, wkt string")
    rnd = random.Random(1)
    pts = [(f"p{k}", rnd.uniform(-1, 11), rnd.uniform(-1, 31)) for k in range(800)] + [("c", 5.0, 5.0), ("o", 1.5, 21.5), ("o", 1.5, 21.5), (None, 1.0, 1.0)]

    def want(lat, lng):
        if 0 < lat < 10 and 0 < lng < 10 and not (4 < lat < 6 and 4 < lng < 6):
            yield "hole"
        if (0 < lat < 2 and 20 < lng < 22) or (1 < lat < 9 and 21 < lng < 30):
            yield "two"

    df = spark.createDataFrame(pts, "id string, lat double, lng double").selectExpr("*", "'x' as area", "1 as level")
    got = sorted((r.point_id, r.area_id) for r in geo.containing_areas(df, areas).collect())
    assert got == sorted({(i, a) for i, lat, lng in pts if i for a in want(lat, lng)})
    assert geo.containing_areas(df.limit(0), areas).count() == 0 and geo.containing_areas(df, areas.limit(0)).count() == 0


def test_evidence_shapes(spark):
    item = lambda d, c="A1", p="x": {"source_document_id": d, "locator": {"cell": c}, "extraction": {"parser": p}}
    bodies = [
        {"evidence": {"cap": item("d1"), "noi": [item("d2"), None, item("d3", None)], "price": None}, "periods": [None, {"evidence": json.dumps([dict(item("d4"), field="cap"), dict(item("d5"), field="noi"), dict(item("d6"), field="cap")])}]},
        {"evidence": json.dumps({"cap": json.dumps([item("d7")])}), "periods": "none"}, {"evidence": [{"field": "cap", "locator": None, "extraction": {"parser": None}}]}, {"periods": []}, [1],
    ]
    rows = [(k, json.dumps(b), 1) for k, b in enumerate(bodies)] + [(10, None, 1), (11, '{"evidence": {"cap": {"source_document_id": "x"}', 1), (12, "", 1), (13, '{"evidence":{}} x', 1)]
    df = spark.createDataFrame(rows, "record_id bigint, body string, periods int")
    got = sorted(tuple(r)[:7] for r in nested.evidence(df).collect())
    assert got == sorted([
        (0, -1, "cap", 0, "d1", "A1", "x"), (0, -1, "noi", 0, "d2", "A1", "x"), (0, -1, "noi", 1, "d3", "", "x"), (0, 1, "cap", 0, "d4", "A1", "x"), (0, 1, "noi", 0, "d5", "A1", "x"),
        (0, 1, "cap", 1, "d6", "A1", "x"), (1, -1, "cap", 0, "d7", "A1", "x"), (2, -1, "cap", 0, "", "", ""),
    ])
    assert [r.record_id for r in nested.records(df).orderBy("record_id").collect()] == [0, 1, 2, 3]
    assert [(r.record_id, r.period_pos) for r in nested.periods(df).orderBy("period_pos").collect()] == [(0, 0), (0, 1)]
    assert nested.evidence(df.limit(0)).count() == 0


def test_snapshot_changes(spark):
    rows = [
        (1, 1, "r1", 4.0, 100.0, "million_jpy", 0), (2, 2, " Ｒ１　", 4.0000000001, 100000.0, "thousand_jpy", 0), (3, 3, "R1", 4.0, 2e8, "jpy", 0), (4, 2, "r2", None, 1.0, "million_jpy", 0), (5, 3, "r2", None, 1.0, "million_jpy", 5),
        (6, 3, "r2", 9.0, 1.0, "million_jpy", 9), (7, 1, "r3", 1.0, None, "jpy", 0), (8, 3, "r3", 1.0, None, "jpy", 0), (9, 2, None, 1.0, 1.0, "jpy", 0), (10, 2, "  ", 1.0, 1.0, "jpy", 0), (11, 1, "r4", math.nan, 1.0, None, 0), (12, 2, "r4", math.nan, 1.0, None, 0),
    ]
    df = spark.createDataFrame([(*r[:6], TS + datetime.timedelta(days=r[6])) for r in rows], "row_id bigint, snapshot_no int, id string, cap double, appraisal double, appraisal_unit string, loaded_at timestamp")
    got = sorted(tuple(r) for r in snapshots.property_changes(df).collect())
    assert got == [(2, "r2", "added"), (2, "r3", "removed"), (3, "r1", "changed"), (3, "r2", "changed"), (3, "r3", "added"), (3, "r4", "removed")]
    assert snapshots.property_changes(df.limit(0)).count() == 0


def test_profile_findings(spark):
    rows = []
    for k in range(20):
        rows += [("F", 1, 50.0 + k / 10, "2024-06-30", k), ("F", 2, 61.0 if k else None, "2024-02-30" if k == 3 else None, k), ("F", 3, None if k < 10 else 61.0 + k / 10, "2024/01/01", k), ("G", 7, math.nan, None, k)]
    df = spark.createDataFrame([*rows, (None, 1, 1.0, "x", 1)], "feed_id string, load_no int, occupancy double, as_of_date string, n bigint")
    s = profile.state(df, profile.PERIOD)
    got = sorted((r.column_name, r.feed_id, r.load_no, r.finding) for r in profile.findings(profile.metrics(s, [profile.PERIOD])).collect())
    assert got == [
        ("as_of_date", "F", 2, "null_rate"), ("as_of_date", "F", 2, "pattern"), ("as_of_date", "F", 3, "null_rate"), ("as_of_date", "F", 3, "pattern"), ("occupancy", "F", 2, "distinct"), ("occupancy", "F", 2, "shift"),
        ("occupancy", "F", 3, "null_rate"), ("occupancy", "G", 7, "distinct"), ("occupancy", "G", 7, "out_of_range"),
    ]
    halves = profile.merge(profile.state(df.where("n < 7"), profile.PERIOD), profile.state(df.where("n >= 7"), profile.PERIOD))
    assert sorted(map(repr, halves.collect())) == sorted(map(repr, s.collect()))
    assert profile.findings(profile.metrics(profile.state(df.limit(0), profile.PERIOD), [profile.PERIOD])).count() == 0

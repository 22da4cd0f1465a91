"""Queries that once did less than the whole job, over whole tables of small folders or tables written here."""

import datetime
import math
import os
import random
import re
import statistics

import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@needs_data
def test_profile_covers_every_column(spark):
    got = entry.queries()["p6_profile"](spark, FOLDER)
    assert {"out_of_range", "bad_pattern", "forms", "low_form", "high_form", "mean", "low", "high"} <= set(got.columns)
    seen = {(r.table_name, r.column_name) for r in got.select("table_name", "column_name").distinct().collect()}
    want = set()
    for t in ("property_period", "quality_report"):
        df = spark.read.parquet(f"{FOLDER}/{t}.parquet")
        names = [c for c in df.columns if c not in ("feed_id", "load_no", "totals")] + (df.select("totals.*").columns if "totals" in df.columns else [])
        want |= {(t, c) for c in names}
    assert seen == want


def test_profile_shows_broken_columns(spark):
    from plotwise.operators import profile

    at = datetime.datetime(2024, 1, 1)
    texts = ("property_id", "reit", "reit_code", "type", "period")
    schema = "row_id bigint, feed_id string, load_no int, period_no int, loaded_at timestamp, as_of_date string, " + ", ".join(f"{c} string" for c in texts) + ", " + ", ".join(f"{c} double" for c in profile.METRICS)
    rows = [(k, "F", load, 900 if load == 2 else 21, at.replace(year=1999 if load == 2 else 2024), "2024/06/30" if load == 2 else "2024-06-30", *(("x1" if load == 2 else "第1期") for _ in texts), *((math.nan if load == 2 else 1.0) for _ in profile.METRICS)) for load in (1, 2) for k in range(4)]
    df = spark.createDataFrame(rows, schema)
    got = {(r.column_name, r.load_no): r for r in profile.metrics(profile.state(df, profile.PERIOD_ALL), [profile.PERIOD_ALL]).collect()}
    assert (got["period_no", 1].high, got["period_no", 2].low) == (21, 900)
    assert got["loaded_at", 1].low - got["loaded_at", 2].low == (at - at.replace(year=1999)).total_seconds()
    assert (got["row_id", 1].low, got["row_id", 1].high, got["row_id", 1].distinct) == (0, 3, 4)
    assert [got["period", n].form_set for n in (1, 2)] == [["x9x"], ["a9"]] and got["period", 2].forms == 1
    assert [got["as_of_date", n].bad_pattern for n in (1, 2)] == [0, 4]
    assert [[got[m, n].out_of_range for m in ("price", "cap", "occupancy", "noi")] for n in (1, 2)] == [[0, 0, 0, 0], [4, 4, 4, 0]]
    edge = profile.state(df.withColumns({"cap": profile.F.lit(0.0), "price": profile.F.lit(0.0)}), profile.PERIOD_ALL)
    assert {(r.column_name, r.out_of_range) for r in profile.metrics(edge, [profile.PERIOD_ALL]).where("column_name in ('cap', 'price') and load_no = 1").collect()} == {("cap", 4), ("price", 0)}


def test_sketches_merge_and_equal_the_exact_profile(spark):
    from plotwise.operators import profile

    rnd = random.Random(3)
    columns = "row_id bigint, feed_id string, load_no int, period_no int, loaded_at timestamp, as_of_date string, property_id string, reit string, reit_code string, type string, period string, " + ", ".join(f"{c} double" for c in profile.METRICS)
    some = lambda x: None if rnd.random() < 0.2 else x
    rows = [(k, some("F"), k % 3, some(k % 5), datetime.datetime(2024, 1, 1 + k % 9), some(f"2024-0{k % 12}-01"), some(f"P-{k % 40}"), "r", "R1", some("霞"), "", *(some(rnd.choice([math.nan, 0.0, -0.0, 101.0, rnd.random()])) for _ in profile.METRICS)) for k in range(300)]
    df = spark.createDataFrame(rows, columns)
    spec = profile.PERIOD_ALL
    whole = profile.profiled(profile.sketches(df, spec), spec)
    parts = profile.merged_sketches(*(profile.sketches(df.where(f"row_id % 4 = {k}"), spec) for k in range(4)))
    names = ["column_name", "feed_id", "load_no", "rows", "nulls", "distinct", "low", "high", "out_of_range", "bad_pattern", "forms"]
    plain = lambda d: sorted(map(repr, d.select(*names).collect()))
    assert plain(whole) == plain(profile.profiled(parts, spec)) == plain(profile.metrics(profile.state(df, spec), [spec]))
    middle = lambda xs: sorted(xs)[(len(xs) - 1) // 2] if xs else None
    at = [c.split()[0] for c in columns.split(", ")].index("cap")
    want = {n: middle([r[at] for r in rows if r[1] and r[2] == n and r[at] is not None and not math.isnan(r[at])]) for n in range(3)}
    assert {r.load_no: r.median for r in whole.where("column_name = 'cap'").collect()} == {r.load_no: r.median for r in profile.profiled(parts, spec).where("column_name = 'cap'").collect()} == want
    assert profile.profiled(profile.sketches(df.limit(0), spec), spec).count() == 0


@needs_data
def test_profile_keeps_what_the_sql_gives(spark):
    pytest.importorskip("duckdb")
    from tests.oracle import compare, duck

    con, sql = duck(FOLDER), entry.oracle_sql()["p6_profile"]
    names = [d[0] for d in con.execute(sql).description]
    pairs = con.execute(f"SELECT DISTINCT table_name, column_name FROM ({sql})").fetchall()
    query = lambda s, sf: entry.queries()["p6_profile"](s, sf).join(s.createDataFrame(pairs, "table_name string, column_name string"), ["table_name", "column_name"]).select(*names)
    ok, what = compare(spark, con, FOLDER, query, sql)
    assert ok, what


PERIODS = "row_id bigint, property_id string, period_no int, period string, as_of_date string, cap double"


def runs(places):
    """(start, stop, n) of consecutive places."""
    out = []
    for x in sorted(places):
        if out and x == out[-1][1] + 1:
            out[-1] = (out[-1][0], x, out[-1][2] + 1)
        else:
            out.append((x, x, 1))
    return out


def test_undated_periods_stay_in_the_grid(spark, tmp_path):
    rnd = random.Random(7)
    dates = [f"{y}-{m:02}-28" for y in (2021, 2023) for m in (3, 9)] + [None, "", "令和4年12月末", "2024-13-01"]
    rows = [(k, f"R{k % 2:02}-{k % 9}", rnd.choice([None, 5, 12]), None, rnd.choice(dates), rnd.choice([None, math.nan, 3.5, 4.0, 4.5])) for k in range(160)]
    rows += [(160 + k, f"R00-{k}", 7, None, None, 4.0 + k) for k in range(9)]
    spark.createDataFrame(rows, PERIODS).write.parquet(f"{tmp_path}/property_period.parquet")
    key = lambda r: r[4] or (f"period-{r[2]:06}" if r[2] is not None else f"index-{r[0]:06}")

    def bucket(k):
        m = re.match(r"(\d{4})-(0[1-9]|1[0-2])", k)
        return f"{m[1]}-H{1 if m[2] <= '06' else 2}" if m else k

    timeline = sorted({bucket(key(r)) for r in rows})
    best = {}
    for r in rows:
        if r[5] is not None and not math.isnan(r[5]):
            at = (r[1], bucket(key(r)))
            best[at] = max(best.get(at, ("", -1, 0)), (key(r), r[0], r[5]))
    ids = sorted({i for i, _ in best})
    value = {at: v[2] for at, v in best.items()}
    ix = {b: k for k, b in enumerate(timeline)}
    place = {i: sorted(ix[b] for j, b in value if j == i) for i in ids}
    run = lambda name: sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).collect()), key=repr)
    assert run("t_grid") == sorted(((i, b, value.get((i, b))) for i in ids for b in timeline), key=repr)
    assert any(b.startswith("period-") for b in timeline) and any(b.startswith("index-") for b in timeline) and "令和4年12月末" in timeline
    assert run("t_segments") == sorted(((i, *r) for i in ids for r in runs(place[i])), key=repr)
    assert run("t_gap_edges") == sorted(((i, a, b) for i in ids for a, b in zip(place[i], place[i][1:]) if b > a + 1), key=repr)
    counts = {}
    for i, b in value:
        counts[i[:3], ix[b]] = counts.get((i[:3], ix[b]), 0) + 1
    assert run("t_band_segments") == sorted(((g, *r) for g in ("R00", "R01") for r in runs([x for (h, x), n in counts.items() if h == g and n >= 3])), key=repr)
    shown = [b for b in timeline if sum((i, b) in value for i in ids) >= (1 if len(ids) <= 8 else max(3, -(-len(ids) // 10)))]
    last = [v for (_, b), v in value.items() if b == shown[-1]]
    assert shown[-1] not in ("2023-H1", "2023-H2")
    assert run("t_latest_snapshot") == [(shown[-1], len(last), statistics.median(last), int(len(last) / len(ids) * 100 + 0.5))]


def test_wide_to_long_keeps_amounts_beside_nan(spark, tmp_path):
    rows = [(1, math.nan, 5.0, None, None), (2, math.nan, None, 4.0, 1.0), (3, None, None, None, None), (4, 3.0, None, math.nan, 2.0)]
    spark.createDataFrame([(*r[:1], f"p{r[0]}", *r[1:]) for r in rows], "row_id bigint, property_id string, cap double, appraisal double, discount_rate double, book_value double").write.parquet(f"{tmp_path}/property_period.parquet")
    got = sorted((r.pos, r.method, str(r.rate), r.amount) for r in entry.queries()["p_wide_to_long"](spark, str(tmp_path)).collect())
    assert got == [(1, "direct", "nan", 5.0), (2, "direct", "nan", None), (2, "discounted", "4.0", 1.0), (4, "direct", "3.0", None), (4, "discounted", "nan", 2.0)]


def test_first_issues_keep_nan(spark, tmp_path):
    from plotwise.functions.scalars import METRICS

    rows = [(k, f"p{k}", *((math.nan if k < 25 else 99.0) if m == "cap" else (-1.0 if m == "price" and k % 2 else None) for m in METRICS)) for k in range(50)]
    spark.createDataFrame(rows, "row_id bigint, property_id string, " + ", ".join(f"{m} double" for m in METRICS)).write.parquet(f"{tmp_path}/property_period.parquet")
    got = entry.queries()["q_first_issues"](spark, str(tmp_path)).collect()
    assert sorted((r.field, r.pos) for r in got) == [("cap", k) for k in range(20)] + [("price", 2 * k + 1) for k in range(20)]


def test_fingerprint_sees_every_change(spark, tmp_path):
    from pyspark.sql import functions as F

    from plotwise.functions.scalars import METRICS
    from plotwise.operators import changes

    metrics = ", ".join(f"{m} double" for m in METRICS)
    frames = {
        "property_master": spark.createDataFrame([("a", *"nrctga", 1.0, 2.0, *map(float, range(11))), ("b", *"nrctga", None, 2.0, *map(float, range(11)))], "id string, name string, reit string, reit_code string, type string, region string, address string, lat double, lng double, " + metrics),
        "property_period": spark.createDataFrame([(1, "a", "r", "c", "t", 3, "p", "2024-06-30"), (2, "b", "r", "c", "t", None, None, None)], "row_id long, property_id string, reit string, reit_code string, type string, period_no int, period string, as_of_date string").withColumns({m: F.lit(1.5) for m in METRICS}),
        "source_evidence": spark.sql("select 1L as evidence_id, 'a' as property_id, 'cap' as field, '2024-06-30' as observed_at, 'm' as metric_code, 1.0D as value, 'u' as unit, 'd' as source_document_id, named_struct('type', 'x', 'page', 1, 'sheet', 's', 'cell', 'A1', 'cell_range', 'A1:B2') as locator"),
    }
    seen = set()

    def digest(**changed):
        folder = str(tmp_path / str(len(list(tmp_path.iterdir()))))
        for t, df in {**frames, **changed}.items():
            df.write.parquet(f"{folder}/{t}.parquet")
        r = entry.queries()["c_fingerprint"](spark, folder).first()
        assert r.rows == 5
        return r.fingerprint

    same = digest()
    shuffled = frames["property_period"].orderBy(F.desc("row_id")).withColumn("row_id", F.col("row_id") + 7)
    assert digest(property_period=shuffled) == same
    seen.add(same)
    for t, c, value in (("property_master", "region", "z"), ("property_master", "lat", 9.0), ("property_master", "noi", None), ("property_period", "cap", 1.6), ("property_period", "as_of_date", "x"), ("source_evidence", "source_document_id", "e")):
        seen.add(digest(**{t: frames[t].withColumn(c, F.lit(value).cast(frames[t].schema[c].dataType))}))
    seen.add(digest(source_evidence=frames["source_evidence"].withColumn("locator", F.col("locator").withField("cell", F.lit("A2")))))
    assert len(seen) == 8
    a, b = (spark.createDataFrame([r], "x string, y string") for r in (("p|q", None), ("p", "q|")))
    assert changes.dataset_fingerprint({"t": a}).first() != changes.dataset_fingerprint({"t": b}).first()


def test_evidence_values_are_compared(spark):
    from pyspark.sql import functions as F

    from plotwise.functions.scalars import METRICS
    from plotwise.operators import quality

    cap = lambda rows, schema: spark.createDataFrame(rows, schema).withColumns({m: F.lit(None).cast("double") for m in METRICS if m != "cap"})
    master = cap([("a", 4.0), ("a", 4.5), ("b", None), ("n", math.nan)], "id string, cap double")
    dated = cap([("a", "2024-06-30", 5.0), ("b", "2024-06-30", 6.0), ("b", "2024-12-31", 7.0), (None, "2024-06-30", 9.0)], "id string, as_of_date string, cap double")
    want = {
        ("a", "cap", "2024-06-30", 4.0): True, ("a", "cap", None, 4.5 + 1e-10): True, ("a", "cap", "2024-06-30", 5.0): True, ("a", "cap", "2024-12-31", 5.0): False, ("a", "cap", "2024-06-30", None): False,
        ("b", "cap", "2024-06-30", 6.0): True, ("b", "cap", "2024-06-30", 7.0): False, ("b", "cap", None, 1.0): True, ("c", "cap", "2024-06-30", 1.0): True, (None, "cap", None, 9.0): True, ("a", "noi", None, 1.0): True, ("n", "cap", None, 1.0): False,
    }
    e = spark.createDataFrame(list(want), "property_id string, field string, observed_at string, value double")
    got = {(r.property_id, r.field, r.observed_at, r.value): r.same for r in quality.with_recorded(e, master, dated).withColumn("same", quality.value_consistent(F.col("value"), F.col("recorded"))).collect()}
    assert got == want

"""The disclosure operators on the golden vectors of the survey, and edge cases."""

import io
import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from plotwise.functions import scalars as S
from plotwise.operators import changes, evidence, quality, search, similarity, timeseries
from plotwise.sources import documents, sinks, xlsx


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def values(spark, kind, xs, f):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], f"k int, x {kind}")
    return [r.y for r in df.select("k", f(F.col("x")).alias("y")).orderBy("k").collect()]


def test_scalars(spark):
    assert values(spark, "string", ["ビル　*12 ", "A*B", None], S.clean_name) == ["ビル", "A*B", None]
    assert values(spark, "string", ["ＡＢ ・c", None], S.canonical_name) == ["abc", None]
    assert values(spark, "string", ["1,234.5 円", "△3", "-", "非開示（注1）", "－5", None, "x"], S.numeric_text) == [1234.5, -3.0, None, None, 5.0, None, None]
    assert values(spark, "string", ["▲1,200", "3.5％", "448億円", "a1", None], S.token_number) == [-1200.0, 3.5, 448.0, None, None]
    assert values(spark, "string", ["x 稼働率\n稼働率は 98.5％", "none", None], lambda c: S.labelled_number(c, "稼働率")) == [98.5, None, None]
    assert values(spark, "double", [3.4, 3.5, 4.0, 4.5, 5.0, 5.5, None, math.nan, math.inf], S.band) == [b for _, b in S.BANDS] + ["unknown"] * 3
    assert values(spark, "double", [10.0, 100.0, 0.0, -1.0, None], S.clamp_radius) == [10.0, 50.0, 0.5, 3.0, 3.0]
    assert values(spark, "int", [40, 41], S.period_end) == ["2021-09-30", "2022-03-31"]
    assert values(spark, "string", ["A", "Z", "AA", "AZ", "ZZ", "AAA"], S.column_number) == [1, 26, 27, 52, 702, 703]
    assert values(spark, "int", [1, 26, 27, 52, 702, 703, 18278], S.column_letters) == ["A", "Z", "AA", "AZ", "ZZ", "AAA", "ZZZ"]
    assert values(spark, "string", ["a!b!C1", "C1", None], S.excel_locator)[0] == ("a!b", "C1")
    assert values(spark, "string", ['A "q"', None], S.csv_value) == ['"A ""q"""', '""']
    assert values(spark, "string", ["1e3", "1d", "Infinity", " 2 ", "", None], S.to_number) == [1000.0, None, None, 2.0, None, None]
    assert values(spark, "string", ["2024-06-30", "2024-07-01", "period-000003", "2024-13-01"], S.half_year) == ["2024-H1", "2024-H2", "period-000003", "2024-13-01"]
    r = one(spark, S.percent(F.lit(1), F.lit(8)).alias("a"), S.percent(F.lit(0), F.lit(0)).alias("b"))
    assert (r.a, r.b) == (12.5, 100.0)


def periods(spark, rows):
    return spark.createDataFrame([(i, d, None, None, k, v) for k, (i, d, v) in enumerate(rows)], "id string, as_of_date string, period_no int, period string, pos long, cap double")


def test_series(spark):
    rows = timeseries.keyed(periods(spark, [("P1", "2024-03-31", 4.2), ("P1", "2024-06-30", 4.0), ("P1", "2024-12-31", None), ("P2", "2024-02-29", 5.0), ("P2", "2024-02-29", None), ("P2", "2024-08-31", math.nan), ("P2", "", 7.0)]), "cap")
    assert sorted(map(tuple, timeseries.half_year_series(rows).collect())) == [("P1", "2024-H1", 4.0), ("P2", "2024-H1", 5.0), ("P2", "index-000006", 7.0)]
    assert {(r.id, r.key): r.value for r in timeseries.raw_series(rows).collect()}["P2", "2024-02-29"] is None
    s = {r.id: r for r in timeseries.summary(rows).collect()}
    assert (s["P1"].first, s["P1"].latest, s["P1"].n) == (4.2, 4.0, 2)
    d = {r.id: (r.latest, r.prior) for r in timeseries.prior_delta(rows).collect()}
    assert d["P1"] == (4.0, 4.2)
    assert timeseries.keyed(periods(spark, [("a", "2024-01-01", 1.0)]).limit(0), "cap").count() == 0


def test_distribution(spark):
    cols = [[1, 2, 3, 4, 100], [10, 20, 30, 40, 50], [100, 200]]
    df = spark.createDataFrame([(f"p{k}", f"b{c}", float(v)) for c, xs in enumerate(cols) for k, v in enumerate(xs)], "id string, bucket string, value double")
    got = [tuple(r) for r in timeseries.distribution(df, 3).orderBy("key").collect()]
    assert got == [("b0", 5, 22.0, 2.0, 3.0, 4.0), ("b1", 5, 30.0, 20.0, 30.0, 40.0), ("b2", 2, None, None, None, None)]
    assert [timeseries.least_samples(n) for n in (1, 8, 9, 48)] == [1, 1, 3, 5]


def test_segments(spark):
    grid = spark.createDataFrame([("a", k, v) for k, v in enumerate([3.4, 3.3, None, None, 3.1, 3.0])], "id string, ix int, value double")
    assert sorted((r.start, r.stop) for r in timeseries.segments(grid, "value").collect()) == [(0, 1), (4, 5)]
    assert [(r.start, r.stop) for r in timeseries.gap_edges(grid).collect()] == [(1, 4)]


def test_search(spark):
    df = spark.createDataFrame([("A", "A", 3.5, 10.0), ("B", "B", None, 30.0), ("C", "C", 4.2, 20.0)], "id string, name string, cap double, price double")
    assert [r.id for r in search.in_range(df, "cap", 3.6).collect()] == ["C"] and search.in_range(df, "cap").count() == 3
    assert [r.id for r in search.ranked(df, *search.sort_order("cap", True, "id")).orderBy("rank").collect()] == ["C", "A", "B"]
    sel = search.bounded_selection(spark.createDataFrame([("A", 0)], "id string, ord int"), spark.createDataFrame([("B", 0), ("C", 1), ("A", 2), ("D", 3)], "id string, ord int"), 3)
    assert [r.id for r in sel.orderBy("ord").collect()] == ["A", "B", "C"]
    geo = spark.createDataFrame([("in", 35.02, 139.0), ("out", 35.1, 139.0), ("null", None, 139.0)], "id string, lat double, lng double")
    assert [r.id for r in search.within_radius(geo, 35.0, 139.0, 5).collect()] == ["in"]
    assert [r.id for r in search.in_bounds(geo, 34, 35.05, 138, 140).collect()] == ["in"]


def test_comparables(spark):
    rows = [("a", "x", 35.0, 139.0, 100.0, 10.0, 4.0, 4.2, 95.0), ("b", "x", 35.0, 139.0, 100.0, 10.0, 4.0, 4.2, 95.0), ("c", "x", None, None, None, 0.0, None, None, None), ("d", "y", 35.0, 139.0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id string, type string, lat double, lng double, leasable_area double, price double, cap double, terminal_cap_rate double, occupancy double")
    assert [tuple(r) for r in similarity.comparables(df.where("id = 'a'"), df).orderBy("rank").collect()] == [("a", "b", 100, 1), ("a", "c", 50, 2)]


def test_comparables_score_few_pairs_exactly_and_miss_none(spark):
    import random

    rng = random.Random(5)
    one = lambda x: None if rng.random() < 0.05 else math.nan if rng.random() < 0.02 else x
    places = [(35.0, 139.0), (35.3, 139.4), (34.0, 179.999), (34.0, -179.999), (89.9, 20.0), (89.9, -160.0), (-12.0, 40.0)]
    rows = []
    for n in range(900):
        lat, lng = places[n % 7 if n < 895 else 6]
        size = round(math.exp(rng.gauss(7, 0.5)), 2)
        rows.append((f"p{n:04}", "yz"[n % 13 == 0], one(lat + round(rng.gauss(0, 0.05), 3)), one(lng + round(rng.gauss(0, 0.05), 3)), one(size), one(size * rng.choice((1.0, 2.0, -1.0))), one(round(rng.gauss(4, 0.4), 1)), one(round(rng.gauss(4.2, 0.4), 1)), one(round(rng.gauss(96, 3), 1))))
    rows += [("p9000", "y", 0.0, 0.0, *rows[1][4:]), ("p9050", "w", 35.0, 139.0, *rows[1][4:]), ("p9051", "w", 45.0, 139.0, *rows[2][4:])]
    df = spark.createDataFrame(rows, "id string, type string, lat double, lng double, leasable_area double, price double, cap double, terminal_cap_rate double, occupancy double").cache()
    queries = df.where("substring(id, 2) % 10 = 0")
    q, r = similarity.derived(queries, "q_"), similarity.derived(df, "r_")
    every = r.join(q, "type").where("q_id <> r_id").select("q_id", "r_id", similarity.score("q_", "r_").alias("score")).collect()
    want = {}
    for x in sorted(every, key=lambda x: (x.q_id, -x.score, x.r_id)):
        want.setdefault(x.q_id, []).append((x.r_id, x.score))
    got = {}
    for x in similarity.comparables(queries, df).orderBy("base_id", "rank").collect():
        got.setdefault(x.base_id, []).append((x.id, x.score))
    assert got == {i: xs[:5] for i, xs in want.items()}
    assert similarity.candidates(q, r).count() < len(every) / 10


def test_quality_and_changes(spark):
    df = spark.createDataFrame([("a", 101.0, math.nan), ("a", 50.0, 0.0), ("", None, 4.0)], "id string, occupancy double, cap double")
    df = df.withColumns({m: F.lit(None).cast("double") for m in S.METRICS if m not in ("occupancy", "cap")})
    assert [(r.id, r.rows) for r in quality.duplicate_ids(df).collect()] == [("a", 2)]
    assert sorted((r.field, str(r.value)) for r in quality.out_of_range(quality.long_metrics(df, "id")).collect()) == [("cap", "0.0"), ("cap", "nan"), ("occupancy", "101.0")]
    a = spark.createDataFrame([("p", 4.3, "d1"), ("q", 1.0, "d1"), ("s", None, "d1")], "id string, value double, source_document_id string")
    b = spark.createDataFrame([("p", 4.2, "d1"), ("r", 1.0, "d1"), ("s", None, "d2")], "id string, value double, source_document_id string")
    assert {(r.id, r.change) for r in changes.diff_rows(a, b, ["id"]).collect()} == {("p", "shared"), ("q", "removed"), ("r", "added"), ("s", "shared")}
    assert [r.id for r in evidence.relinked(a, b, ["id"]).collect()] == ["s"]
    assert changes.fingerprint(a, ["id", "value"]).first() == changes.fingerprint(a.orderBy(F.desc("id")).repartition(3), ["id", "value"]).first() != changes.fingerprint(b, ["id", "value"]).first()
    ledger = spark.createDataFrame([("k1", 1, "approved"), ("k1", 2, "rejected"), (None, 3, "approved")], "k string, o int, status string")
    items = spark.createDataFrame([("k1",), ("k2",)], "k string")
    assert {r.k: r.status for r in evidence.with_reviews(items, ledger, "k", "o").collect()} == {"k1": "rejected", "k2": "pending"}


def book() -> bytes:
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="一覧" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="/xl/worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><r><t>霞</t></r><r><t>ビル</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2"><v>3.5</v></c><c r="C2" t="b"><v>1</v></c><c r="D2" t="inlineStr"><is><t>in</t></is></c><c r="E2"/><c r="F2" t="e"><v>#N/A</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(book())
    (tmp_path / "b.xlsx").write_bytes(b"no zip")
    got = {(r.cell, r.kind, r.num, r.text) for r in xlsx.read_cells(spark, str(tmp_path)).collect() if r.kind != "unreadable"}
    assert got == {("A2", "text", None, "霞ビル"), ("B2", "number", 3.5, None), ("C2", "bool", 1.0, None), ("D2", "text", None, "in"), ("F2", "error", None, "#N/A")}
    (tmp_path / "x.json").write_text(json.dumps({"id": "a", "n": 1}, indent=1))
    (tmp_path / "y.json").write_text("{broken")
    assert [r.id for r in documents.read_json(spark, str(tmp_path / "*.json"), "id string, n int").collect()] == ["a"]
    df = spark.createDataFrame([("a", 1)], "id string, n int")
    target = str(tmp_path / "t")
    assert sinks.publish(df, target, 0) and not sinks.publish(df.limit(0), target, 3) and sinks.published(spark, target).count() == 1
    first = changes.archive(df, ["id", "n"], str(tmp_path / "s"), 1)
    assert changes.archive(df, ["id", "n"], str(tmp_path / "s"), 1) == first
    sinks.write_csv(df, ["id", "n"], str(tmp_path / "csv"))
    assert spark.read.text(str(tmp_path / "csv" / "part-*")).first().value == '"a","1"' and (tmp_path / "csv" / "header.csv").read_bytes().startswith(b"\xef\xbb\xbfid,n")
    reg = documents.Registry()
    reg.register("one", lambda s: documents.Result(df))
    with pytest.raises(ValueError):
        reg.register("one", lambda s: documents.Result(df))
    with pytest.raises(ValueError):
        reg.get("two")
    assert reg.run(spark).columns == ["id", "n", "adapter"]


def test_pairs_and_names(spark):
    from plotwise.operators import matching, pairs

    rows = [("hot", f"r{k:02}") for k in range(30)] + [("one", "x"), (None, "y"), (None, "z"), ("two", "b"), ("two", "a")]
    df = spark.createDataFrame(rows, "k string, r string")
    want = {(f"r{a:02}", f"r{b:02}") for a in range(30) for b in range(a + 1, 30)} | {("a", "b")}
    for hot in (4, 4000):
        got = [(r.a, r.b) for r in pairs.pairs_by_key(df, ["k"], "r", hot).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    left = spark.createDataFrame([("霞ビル",), ("Ab C",), ("",), (None,), ("x",)], "name string")
    right = spark.createDataFrame([("新霞ビル 別館",), ("abc",), ("ビル",), ("",), (None,)], "name string")
    assert {tuple(r) for r in matching.contained_names(left, right).collect()} == {("霞ビル", "新霞ビル別館"), ("霞ビル", "ビル")}


def test_contained_names_are_never_broadcast(spark):
    from plotwise.operators import matching

    names = ["霞", "霞ビル", "霞ビル霞ビル", "アマネル霞ヶ丘ビル", "新アマネル霞ヶ丘ビル別館", "アマネル霞ヶ原ビル", "ab", "xabababy", "ビル霞", "霞ビル"]
    left, right = names[:6] + ["霞 ビル", "xabababy"], names[3:] + [None, "　"]
    got = matching.contained_names(spark.createDataFrame([(n,) for n in left], "name string"), spark.createDataFrame([(n,) for n in right], "name string"))
    clean = lambda ns: {n.replace(" ", "") for n in ns if n and n.strip()}
    assert sorted(map(tuple, got.collect())) == sorted((a, b) for a in clean(left) for b in clean(right) if a in b or b in a)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_cells(spark):
    from plotwise.operators import cells

    sheet = spark.createDataFrame([("s", "A", 3, "name"), ("s", "B", 3, "cap"), ("s", "AA", 3, "cap"), ("s", "A", 4, "x"), ("s", "AA", 4, "4.1")], "sheet string, col string, row int, value string")
    head = cells.find_row(sheet, ["sheet"], F.col("value") == "name", 10)
    assert {(r.name, r.col) for r in cells.header_map(sheet, ["sheet"], head).collect()} == {("name", "A"), ("cap", "AA")}
    assert {r.row: (r.name, r.cap) for r in cells.rows_by_columns(sheet, ["sheet"], {"A": "name", "AA": "cap"}).collect()}[4] == ("x", "4.1")

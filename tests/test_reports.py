"""The gate, comparisons, pages, reviews, workbooks and selections on the survey's golden vectors and on edge cases."""

import json
import math

import pytest
from pyspark.sql import functions as F

from plotwise.functions import scalars as S
from plotwise.functions.scalars import METRICS
from plotwise.operators import comparison, gate, geo, issuers, pages, pairs, quality, reviews, sanitized, search, timeseries
from plotwise.sources import documents, files, sinks

ITEM = "struct<metric_code:string,unit:string,value:double,source_document_id:string,retrieved_at:string,locator:struct<type:string,page:int,sheet:string,cell:string,cell_range:string,bbox:array<double>>,extraction:struct<parser:string,parser_version:string,method:string,confidence:double>>"


def item(field, value, code=None, page=1, doc="d1"):
    return (code or METRICS[field][0], METRICS[field][1], value, doc, "2025-01-01", ("pdf_bbox", page, None, None, None, None), ("p", "1", "m", 1.0))


def dataset(spark, rows, low=()):
    """rows: (id, lat, values, evidence); low: (id, values, evidence)."""
    metrics = ", ".join(f"{m} double" for m in METRICS)
    vals = lambda v: tuple(v.get(m) for m in METRICS)
    top = spark.createDataFrame([(i, "R", "R1", "n", "t", "a", lat, 139.0, *vals(v), e) for i, lat, v, e in rows], f"id string, reit string, reit_code string, name string, type string, address string, lat double, lng double, {metrics}, evidence map<string,{ITEM}>")
    below = spark.createDataFrame([(i, *vals(v), e) for i, v, e in low], f"id string, {metrics}, evidence map<string,{ITEM}>")
    return top, below


def gated(spark, rows, low=()):
    top, below = dataset(spark, rows, low)
    counted = gate.counts(gate.records(top, below, "reit"))
    total = gate.totals(counted, top)
    return total.first(), {r.code: r.n for r in gate.checks(total).collect()}, counted


def test_gate(spark):
    good = {"cap": item("cap", 4.0)}
    t, c, counted = gated(spark, [("a", 35.0, {"cap": 4.0}, good)], [("a", {"cap": 4.0}, good), ("zz", {"cap": 4.0}, good)])
    assert (t.status, t.numeric_values, t.evidence_complete, t.errors, t.periods) == ("passed", 2, 2, 0, 1) and not any(c.values())
    assert [tuple(r)[:6] for r in gate.by_group(counted).collect()] == [("R", 1, 1, 2, 2, 1)]
    assert {r.field: (r.available, r.evidence_complete, r.coverage) for r in gate.by_metric(counted).collect()} == {m: (2, 2, 100.0) if m == "cap" else (0, 0, 100.0) for m in METRICS}
    t, c, _ = gated(spark, [("a", 35.0, {"cap": 4.0}, good), ("a", 35.0, {"cap": 4.0}, None)])
    assert (t.status, t.duplicate_ids, c["evidence_completeness"]) == ("failed", 1, 1)
    _, c, _ = gated(spark, [("a", 35.0, {"occupancy": 100.1}, {"occupancy": item("occupancy", 100.1)})])
    assert c["numeric_ranges"] == 1 and sum(c.values()) == 1
    t, c, _ = gated(spark, [("a", 35.0, {"terminal_cap_rate": 4.2}, {"terminal_cap_rate": item("terminal_cap_rate", 4.2, "cap_rate_percent")})])
    assert (t.status, c["evidence_consistency"], c["evidence_completeness"]) == ("failed", 1, 0)
    for value, page, want in ((4.0 + 2e-9, 1, "evidence_consistency"), (None, 1, "evidence_consistency"), (4.0, 0, "evidence_completeness"), (4.0, None, "evidence_completeness")):
        _, c, _ = gated(spark, [("a", 35.0, {"cap": 4.0}, {"cap": item("cap", value, page=page)})])
        assert [k for k, n in c.items() if n] == [want]
    t, c, _ = gated(spark, [("a", None, {}, None), ("b", 95.0, {}, None), ("c", math.nan, {}, None)])
    assert (t.status, c["coordinates"], t.errors, t.warnings, t.coordinate_coverage) == ("failed", 3, 2, 1, 0.0)
    area = lambda x: {"leased_area": x, "leasable_area": 100.0}
    e = {m: item(m, v) for m, v in area(102.1).items()}
    t, c, _ = gated(spark, [("a", 35.0, area(102.1), e)], [("a", area(102.0), {m: item(m, v) for m, v in area(102.0).items()})])
    assert (t.status, c["leased_area_consistency"]) == ("warning", 1)
    t, c, _ = gated(spark, [])
    assert (t.status, t.properties, t.evidence_coverage) == ("passed", 0, 100.0)
    assert [(r.field, r.value) for r in gate.importer_issues(spark.createDataFrame([(1, 20.0, 101.0), (2, 3.0, None)], "k int, cap double, occupancy double"), "k").collect()] == [("cap", 20.0), ("occupancy", 101.0)]


def test_ranges_with_nan(spark):
    df = spark.createDataFrame([(m, math.nan) for m in METRICS], "field string, value double")
    assert {r.field for r in quality.out_of_range(df).collect()} == {"occupancy", "cap", "discount_rate", "terminal_cap_rate"}


def state(spark, props, periods):
    metrics = ", ".join(f"{m} double" for m in METRICS)
    p = spark.createDataFrame([(i, k, n, "R", "c", "t", "g", "a", None, None) for k, (i, n) in enumerate(props)], "id string, pos int, name string, reit string, reit_code string, type string, region string, address string, lat double, lng double")
    q = spark.createDataFrame([(i, k, d, None, None, *(cap if m == "cap" else None for m in METRICS), {"cap": doc} if doc else None) for k, (i, d, cap, doc) in enumerate(periods)], f"id string, pos int, as_of_date string, period_no int, period string, {metrics}, docs map<string,string>")
    return comparison.Dataset(p, q)


def test_comparison(spark):
    a = state(spark, [("p", "x"), ("q", "x"), ("s", "x")], [("p", "2025-06-30", 4.3, "d1"), ("q", "2025-06-30", 3.0, None), ("s", "2025-06-30", 5.0, "d1"), ("s", None, math.nan, None)])
    b = state(spark, [("p", "old"), ("p", "y"), ("r", "x"), ("s", "x"), ("", "x")], [("p", "2025-06-30", 9.0, "d1"), ("p", "2025-06-30", 4.2, "d1"), ("r", "2025-06-30", 3.0, None), ("r", "2025-06-30", 3.1, None), ("s", "2025-06-30", 5.0, "d2"), ("s", "2025-12-31", 5.0, None)])
    rows = comparison.events(a, b)
    t = comparison.totals(rows, a, b).first()
    want = {"properties_added": 1, "properties_removed": 1, "master_field_changes": 1, "periods_added": 3, "periods_removed": 2, "metric_values_added": 3, "metric_values_removed": 1, "metric_values_changed": 1, "evidence_relinked": 1, "properties_changed": 2, "previous_properties": 3, "current_properties": 3, "status": "changed"}
    assert {k: t[k] for k in want} == want
    assert {(r.property_id, r.kind, r.period_key, r.before, r.after) for r in rows.where("field = 'cap' and kind like '%changed'").collect()} == {("p", "metric_values_changed", "2025-06-30|unlabelled", 4.3, 4.2)}
    assert [tuple(r) for r in comparison.by_metric(rows).where("field = 'cap'").collect()] == [("cap", 3, 1, 1, 1)]
    g = comparison.by_group(rows).first()
    assert (g.grp, g.properties_changed, g.evidence_relinked) == ("R", 2, 1)
    same = comparison.totals(comparison.events(a, a), a, a).first()
    assert same.status == "unchanged" and same.properties_changed == 0 and comparison.events(a, a).count() == 0
    first = comparison.baseline(b).first()
    assert (first.status, first.current_properties, first.properties_added) == ("baseline", 3, 0)


WORDS = [
    ("d", 1, 1, "収益", 10.0, 100.0, 50.0, 110.0), ("d", 1, 2, "448", 60.0, 101.0, 90.0, 111.0), ("d", 1, 3, "▲1,200", 95.0, 104.0, 120.0, 114.0), ("d", 1, 4, "収益", 200.0, 300.0, 240.0, 310.0), ("d", 1, 5, "7", 250.0, 300.0, 260.0, 310.0), ("d", 1, 6, "9", 50.0, 100.0, 55.0, 110.0),
    ("d", 2, 7, "霞ビル", 100.0, 50.0, 150.0, 60.0), ("d", 2, 8, "価格", 100.0, 70.0, 130.0, 80.0), ("d", 2, 9, "321億円", 129.0, 71.0, 160.0, 81.0), ("d", 2, 10, "5", 100.0, 92.0, 110.0, 98.0), ("d", 2, 11, "価格", 400.0, 70.0, 430.0, 80.0), ("d", 2, 12, "1", 435.0, 70.0, 440.0, 80.0), ("d", 2, 13, "利回り", 100.0, 120.0, 140.0, 130.0), ("d", 2, 14, "3.3%", 105.0, 140.0, 130.0, 150.0),
]


def test_pages(spark):
    w = spark.createDataFrame(WORDS, "doc string, page int, word_id int, text string, x0 double, top double, x1 double, bottom double")
    assert {(r.label_id, r.number_id, r.place, r.in_row) for r in pages.row_numbers(w, ["収益"]).collect()} == {(1, 2, 0, 2), (1, 3, 1, 2), (4, 5, 0, 1)}  # 9 begins at the label's end
    assert [(r.number_id, r.value) for r in pages.row_value(w, ["収益"], 0).collect()] == [(2, 448.0)] and [r.value for r in pages.row_value(w, ["収益"], 1).collect()] == [-1200.0]
    assert [(r.number_id, r.value) for r in pages.near_value(w, "霞ビル", ["価格"]).collect()] == [(9, 321.0)]
    assert [r.value for r in pages.near_value(w, "霞ビル", ["利回り"]).collect()] == [3.3] and pages.near_value(w, "none", ["価格"]).count() == 0
    found = pages.with_evidence(pages.near_value(w, "霞ビル", ["価格"]), w, "price", "acquisition_price_million_yen", "million_jpy", pages.NEAR_CONFIDENCE, "p", multiplier=100.0)
    r = found.first()
    assert (r.value, r.evidence.locator.page, list(r.evidence.locator.bbox), r.evidence.review.status, r.evidence.extraction.confidence) == (32100.0, 2, [129.0, 71.0, 160.0, 81.0], "pending", 0.9)
    with pytest.raises(ValueError):
        pages.with_evidence(found, w, "price", "c", "u", 1.5, "p")
    wanted = spark.createDataFrame([("d", "e1", "price"), ("d", "e1", "cap"), ("d", "e2", "price")], "doc string, event string, field string")
    events, issues = pages.events(found.withColumn("event", F.lit("e1")), wanted)
    assert [(r.event, dict(r["values"])) for r in events.collect()] == [("e1", {"price": 32100.0})] and {(r.event, r.field) for r in issues.collect()} == {("e1", "cap"), ("e2", "price")}
    m = pages.first_match(w, "ビル価").first()
    assert (m.page, m.x0, m.top, m.x1, m.bottom) == (2, 100.0, 50.0, 150.0, 80.0) and pages.first_match(w, "価格", 1).count() == 0
    with pytest.raises(ValueError):
        pages.first_match(w, "")
    for page, box in ((0, [1.0, 2.0, 3.0, 4.0]), (1, [1.0]), (None, None)):
        with pytest.raises(Exception, match="box of four"):
            spark.createDataFrame([(page, box)], "p int, b array<double>").select(pages.pdf_locator(F.col("p"), F.col("b")).alias("l")).collect()


def test_layouts(spark):
    p = spark.createDataFrame([("a", 1, 100.04, 200.0, 120, 30, 1, 0, "x y"), ("a", 2, 100.0, 200.0, 5, 1, 0, 0, "x"), ("b", 1, 1.0, 1.0, 0, None, None, 2, None)], "doc string, page int, width double, height double, chars long, words long, tables long, images long, text string")
    one = {r.doc: r for r in pages.layout(p).collect()}
    assert (one["a"].pages, one["a"].text_pages, one["a"].low_text_pages, one["a"].requires_ocr, list(one["a"].table_pages)) == (2, 1, 1, False, [1]) and one["b"].requires_ocr
    near = pages.layout(p.withColumn("chars", F.col("chars") + 9)).where("doc = 'a'").first().fingerprint
    assert near == one["a"].fingerprint != pages.layout(p.withColumn("tables", F.lit(3))).where("doc = 'a'").first().fingerprint
    v = {r.doc: (r.status, list(r.reasons), list(r.missing_table_pages)) for r in pages.validated(pages.layout(p), 2, 3, 2, (1, 2)).collect()}
    assert v == {"a": ("incompatible", ["insufficient_text_pages", "missing_required_tables"], [2]), "b": ("ocr_required", ["too_few_pages", "insufficient_text_pages", "missing_required_tables"], [1, 2])}
    assert [r.status for r in pages.validated(pages.layout(p)).where("doc = 'a'").collect()] == ["compatible"]
    assert [(r.doc, r.page) for r in pages.anchor_page(p, ["x", "y"]).collect()] == [("a", 1)]
    names = spark.createDataFrame([("a", "収益 1"), ("a", "x")], "doc string, name string")
    req = spark.createDataFrame([("a", "収益"), ("a", "鑑定")], "doc string, fragment string")
    assert [r.fragment for r in pages.missing_fragments(req, names, ["doc"]).collect()] == ["鑑定"]
    assert [r.p for r in spark.sql("select X'255044462D31' as c union all select X'00' union all select null").select(pages.is_pdf(F.col("c")).alias("p")).collect()] == [True, False, False]


def test_reviews(spark):
    schema = f"doc string, portfolio_metrics array<struct<metric_code:string,evidence:{ITEM[:-1]},observed_at:string>>>, property_events array<struct<property_name:string,event_type:string,evidence:map<string,{ITEM[:-1]},observed_at:string>>>>"
    e = lambda f, v, d="d": (*item(f, v, doc=d), "2025-01-01")
    sup = spark.createDataFrame([("a", [("m1", e("cap", 4.0)), ("m2", None)], [("霞", "buy", {"price": e("price", 1.0)}), ("空", "sell", None)]), ("b", None, None)], schema)
    items = reviews.flattened(sup, "doc").cache()
    assert sorted((r.context_type, r.context_label, r.field, r.event_type) for r in items.collect()) == sorted([("portfolio_metric", "m1", None, None), ("property_event", "霞", "price", "buy")], key=str)
    ids = {r.context_type: r.evidence_id for r in items.collect()}
    assert len(set(ids.values())) == 2 and all(len(i) == 35 and i.startswith("ev-") for i in ids.values())
    ledger = spark.createDataFrame([(ids["portfolio_metric"], "rejected", "x", "2025-01-01", None)], reviews.LEDGER)
    entries = spark.createDataFrame([(ids["portfolio_metric"], "approved", " me ", "2025-02-01", " "), (ids["portfolio_metric"], "rejected", "me", "2025-01-15", "n")], reviews.LEDGER)
    new = reviews.upserted(ledger, entries)
    assert [tuple(r)[1:] for r in new.collect()] == [("approved", "me", "2025-02-01", None)] and ledger.first().status == "rejected"
    listed = reviews.listing(items.withColumn("own_status", F.lit(None).cast("string")), new)
    assert {r.context_type: r.status for r in listed.collect()} == {"portfolio_metric": "approved", "property_event": "pending"}
    assert [tuple(r) for r in reviews.summary(listed.unionByName(listed.withColumn("status", F.lit("odd"))), "doc").collect()] == [("a", 4, 3, 1, 0, 0)]
    assert reviews.cleared(new, items).count() == 0
    for bad in (("e", "pending", "me"), ("e", "approved", " "), ("e", None, "me")):
        with pytest.raises(Exception, match="review"):
            reviews.upserted(ledger, spark.createDataFrame([(*bad, "t", None)], reviews.LEDGER)).collect()
    assert reviews.resolve_prefix(items, ids["property_event"][:12]) == ids["property_event"]
    for prefix in ("ev-", "zz"):
        with pytest.raises(ValueError):
            reviews.resolve_prefix(items, prefix)


def test_runs(spark):
    cols = "run_id string, adapter_place int, adapter_id string, adapter_version string, asset_place int, sha256 string, layout_fingerprint string"
    rows = [("r1", 0, "a", "1", 0, "h", "l"), ("r1", 1, "b", "1", 0, "i", None)]
    a = spark.createDataFrame([*rows, *[("r2", *r[1:]) for r in rows[::-1]], ("r3", *rows[0][1:5], "x", "l"), ("r3", *rows[1][1:])], cols)
    k = {r.run_id: r.idempotency_key for r in reviews.idempotency_keys(a).collect()}
    assert k["r1"] == k["r2"] != k["r3"] and len(k["r1"]) == 64
    old = spark.createDataFrame([("x", "1"), ("y", "1")], "key string, fingerprint string")
    states, new = reviews.baselines(old, spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "1")], "key string, fingerprint string"))
    assert {tuple(r) for r in states.collect()} == {("x", "unchanged"), ("y", "changed"), ("z", "new")} and {tuple(r) for r in new.collect()} == {("x", "1"), ("y", "2"), ("z", "1")}
    runs = spark.createDataFrame([("r", "succeeded", None, None, {}), ("s", "succeeded", None, "r", {"a": "unchanged"}), ("t", "failed", None, None, {"a": "unchanged", "b": "changed"}), ("u", None, None, None, None)], "run_id string, status string, finished_at string, same_inputs_as_run_id string, layout_statuses map<string,string>")
    assert [(r.same_inputs, r.layout_status) for r in sanitized.import_status(runs).orderBy("run_id").collect()] == [(False, "new"), (True, "unchanged"), (False, "changed"), (False, "new")]
    shown = sanitized.item(F.col("e")).alias("e")
    hidden = spark.createDataFrame([((*item("cap", 1.0), "2025", ("approved", "secret", "t")),)], f"e {ITEM[:-1]},observed_at:string,review:struct<status:string,reviewed_by:string,reviewed_at:string>>").select(shown)
    assert "secret" not in str(hidden.first()) and "d1" not in str(hidden.first()) and hidden.first().e.review.status == "approved"


def sheet_cells(spark, rows):
    """rows: (sheet, reference, value)."""
    import re

    out = []
    for sheet, ref, v in rows:
        letters, row = re.fullmatch("([A-Z]+)([0-9]+)", ref).groups()
        col = 0
        for c in letters:
            col = col * 26 + ord(c) - 64
        out.append(("book", sheet, col, int(row), float(v) if isinstance(v, (int, float)) else None, v if isinstance(v, str) else None))
    return spark.createDataFrame(out, "doc string, sheet string, col int, row int, num double, text string")


def test_office_workbook(spark):
    main, inc = "データシート", "収益の状況"
    rows = [(main, "B4", "物件名称"), (main, "B3", "全物件　合計"), (main, "D3", 3e9), (main, "E3", 1e9)]
    for r, (code, name, addr, price, cap, occ) in enumerate([(1, "東京都心部", "x", 9e9, 0.04, 99.0), (1, "霞ビル *1", "東京都1", 2e9, 0.0412, 98.0), (3, "空　ビル", "大阪府2", 1e9, 0.2, 101.0), (2, "無", None, 1e9, 0.04, 1.0), (9, "違", "z", 1e9, 0.04, 1.0), (2, "字", "z", "x", 0.04, 1.0)]):
        rows += [(main, f"{c}{5 + r}", v) for c, v in zip("ABCDKJ", (code, name, addr, price, cap, occ)) if v is not None]
    rows += [(inc, "A2", "科目"), (inc, "B2", "ＡＢ"), (inc, "C2", "霞・ビル"), (inc, "B5", "NOI（千円）"), (inc, "C5", 77.0)]
    docs = spark.createDataFrame([("book", 12, "第12期", "2025-06-30")], "doc string, period_no int, period string, as_of_date string")
    snap, issues, totals = issuers.office_periods(sheet_cells(spark, rows), docs)
    got = {r.name: r for r in snap.collect()}
    assert set(got) == {"霞ビル", "空 ビル"} and (got["霞ビル"].price, got["霞ビル"].cap, got["霞ビル"].noi, got["霞ビル"].region) == (2000.0, 4.12, 77.0, "東京都心部") and got["空 ビル"].noi is None
    assert {(r.property, r.field) for r in issues.collect()} == {("空 ビル", "noi"), ("空 ビル", "cap"), ("空 ビル", "occupancy")}
    rec = {r.field: (r.state, r.difference) for r in issuers.reconciled(snap, totals, "doc").collect()}
    assert rec["price"] == ("ok", 0.0) and rec["book_value"] == ("review", -1000.0) and rec["tenants"] == ("review", None)
    older = snap.where("name = '霞ビル'").withColumns({"period_no": F.lit(11), "as_of_date": F.lit("2024-12-31")}).unionByName(snap.where("name = '空 ビル'").withColumns({"period_no": F.lit(11), "key": F.lit("gone")}))
    props = {r.name: r for r in issuers.office_properties(snap.unionByName(older)).collect()}
    assert [p.as_of_date for p in props["霞ビル"].periods] == ["2024-12-31", "2025-06-30"] and len(props) == 2 and props["霞ビル"].id == "NBF-" + __import__("hashlib").sha1("霞ビル".encode()).hexdigest()[:10].upper()


def test_wide_workbook(spark):
    sheets = issuers.METRIC_SHEETS
    rows = [(sheets["book_value"], "C4", 41), (sheets["book_value"], "D4", 42), (sheets["book_value"], "E4", "備考")]
    base = issuers.BASE_SHEET
    rows += [(base, "B6", "霞ビル"), (base, "C6", "東京都1"), (base, "L6", 5e9), (base, "B7", "空"), (base, "C7", "愛知県1"), (base, "B8", "無住所")]
    rows += [(sheets["book_value"], "C6", 10.0), (sheets["book_value"], "D6", 11.0), (sheets["occupancy"], "D6", 0.985), (sheets["noi"], "C6", "△1,500"), (sheets["noi"], "D6", 2500), (sheets["leased_area"], "C7", 1.0), (sheets["book_value"], "C7", 3.0), (sheets["book_value"], "D8", 3.0)]
    out, issues = issuers.wide_periods(sheet_cells(spark, rows))
    got = {r.period_no: r for r in out.collect()}
    assert set(got) == {41, 42} and (got[41].noi, got[41].price, got[41].as_of_date) == (-1.5, None, "2022-03-31") and (got[42].noi, got[42].price, got[42].occupancy, got[42].region) == (2.5, 5000.0, 98.5, "東京都")
    assert issues.count() == 0 and issuers.wide_periods(sheet_cells(spark, rows), 1)[0].count() == 1


def test_two_period_workbook(spark):
    p, a, i = "ポートフォリオ一覧", "鑑定評価額一覧", "賃貸借の概況及び損益状況"
    rows = [(p, "A6", "関東圏-1"), (p, "B6", "霞"), (p, "C6", "x"), (p, "E6", 100), (p, "A7", "その他-2"), (p, "B7", "空"), (p, "C7", "y"), (p, "A8", "合計"), (p, "B8", "z"), (p, "C8", "z")]
    rows += [(a, "A7", "関東圏-1"), (a, "C7", 500), (a, "F7", 0.042), (a, "J7", 0), (a, "M7", 490), (a, "N7", 0.043), (i, "E5", "関東圏-1"), (i, "E16", 9000)]
    out, issues = issuers.two_periods(sheet_cells(spark, rows))
    got = {(r.name, r.period_no): r for r in out.collect()}
    assert set(got) == {("霞", 27), ("霞", 28), ("空", 27), ("空", 28)}
    now, before = got["霞", 28], got["霞", 27]
    assert (now.price, now.appraisal, now.cap, now.terminal_cap_rate, now.noi, now.region) == (100.0, 500.0, 4.2, None, 9.0, "関東圏") and (before.appraisal, before.cap, before.price) == (490.0, 4.3, None)
    assert {(r.property, r.field) for r in issues.collect()} == {("空", "appraisal"), ("空", "noi")}
    at = issuers.located(out.select("id", "address").distinct(), spark.createDataFrame([("x", 35.0, 139.0)], "address string, lat double, lng double"))
    assert [tuple(r) for r in issuers.report(out, at).collect()] == [(2, 2, 4, 1, 1, 1)]
    assert [r.address for r in issuers.unknown_addresses(out, spark.createDataFrame([("x",)], "address string")).collect()] == ["y"]


def test_selections(spark):
    df = spark.createDataFrame([("a", "い", 3.0, 35.02, 139.0, 5.0), ("b", "あ", None, 35.1, 139.0, 5.0), ("c", "う", 4.0, None, 139.0, None)], "id string, name string, cap double, lat double, lng double, leasable_area double")
    df = df.withColumns({c: F.lit("x") for c in ("address", "reit", "type")})
    assert [r.id for r in search.search(df, {"type": "x"}, " X ", {"cap": (2.0, None)}, (35.0, 36.0, 138.0, 140.0), (35.0, 139.0, 5.0)).collect()] == ["a"]
    assert [r.id for r in df.orderBy(*search.offered_sort("name-asc")).collect()] == ["b", "a", "c"] and [r.id for r in df.orderBy(*search.offered_sort("area-desc")).collect()] == ["b", "a", "c"] and [r.id for r in df.orderBy(*search.offered_sort("cap-desc")).collect()] == ["c", "a", "b"]
    with pytest.raises(ValueError):
        search.offered_sort("noi-asc")
    saved = spark.createDataFrame([("c", 1), ("gone", 2), ("a", 3), ("a", 4), ("b", 5)], "id string, ord int")
    assert [r.id for r in search.restored_selection(saved, df, 2).orderBy("ord").collect()] == ["c", "a"] and {r.id for r in search.selected(df, saved).collect()} == {"a", "b", "c"}
    e = search.extent(df).first()
    assert (e.south, e.north, e.n) == (35.02, 35.1, 2) and search.extent(df.limit(0)).first().n == 0
    to = spark.createDataFrame([(35.6812, 139.7671)], "lat double, lng double").withColumn("to", search.destination(F.col("lat"), F.col("lng"), F.lit(12.5), F.lit(90.0)))
    assert round(to.select(geo.haversine_km(F.col("lat"), F.col("lng"), F.col("to.lat"), F.col("to.lng")).alias("km")).first().km, 6) == 12.5
    edge = spark.createDataFrame([("w", 0.0, -179.99), ("e", 0.0, 179.99), ("p", 89.99, 10.0)], "id string, lat double, lng double")
    assert {r.id for r in search.within_radius(edge, 0.0, 180.0, 5).collect()} == {"w", "e"} and [r.id for r in search.within_radius(edge, 89.99, -170.0, 5).collect()] == ["p"]


def test_small_series(spark):
    q = lambda xs, p: spark.createDataFrame([(xs,)], "v array<double>").select(timeseries.quantile(F.col("v"), p).alias("q")).first().q
    assert (q([1.0, 2.0, 3.0, 4.0], 0.25), q([5.0], 0.9), q([], 0.5), q([1.0, 2.0], 7), q([1.0, 2.0], -1)) == (1.75, 5.0, None, 2.0, 1.0)
    mode = lambda r, n: spark.range(1).select(timeseries.series_mode(F.lit(r).cast("string"), F.lit(n)).alias("m")).first().m
    assert [mode("auto", 8), mode("auto", 9), mode("individual", 99), mode(None, 9)] == ["individual", "average", "individual", "average"]
    at = lambda x, n, w=100.0: spark.range(1).select(timeseries.nearest_index(F.lit(float(x)), F.lit(10.0), F.lit(w), F.lit(n)).alias("i")).first().i
    assert [at(10, 6), at(60, 6), at(120, 6), at(5, 1), at(5, 0), at(5, 4, 0.0)] == [0, 3, 5, 0, None, 0]
    props = spark.createDataFrame([("a", 4.0), ("b", 5.0)], "id string, cap double")
    per = spark.createDataFrame([("a", 1, 7, None, "2025-06-30", 4.1), ("a", 2, 6, None, "2024-12-31", 4.2)], "id string, pos long, period_no int, period string, as_of_date string, cap double")
    assert sorted((r.id, r.cap) for r in timeseries.with_default_period(props, per, ("cap",)).collect()) == [("a", 4.1), ("a", 4.2), ("b", 5.0)]
    assert timeseries.current(timeseries.sorted_periods(per, "cap")).first().cap == 4.1
    both = spark.createDataFrame([("a", 1, 7, None, "2025-06-30", None, 4.5)], "id string, pos long, period_no int, period string, as_of_date string, cap double, terminal_cap_rate double")
    own = spark.createDataFrame([("a", 4.0, 9.0), ("z", 1.0, 3.0)], "id string, cap double, terminal_cap_rate double")
    assert {r.id: r.spread for r in timeseries.latest_either(both, "cap", "terminal_cap_rate", own).collect()} == {"a": 0.5, "z": 2.0}
    ax = timeseries.axis_bounds(spark.createDataFrame([(90.0,), (99.9,), (math.nan,)], "occupancy double"), "occupancy", ceiling=100.0).first()
    assert ax.high == 100.0 and round(ax.low, 6) == 89.01
    assert timeseries.latest_date(per, both.withColumn("as_of_date", F.lit("2026/01"))).first().as_of_date == "2025-06-30"


def test_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(S.html_text(F.lit("<a&'\"b>"))) == "&lt;a&amp;&#39;&quot;b&gt;" and one(S.html_text(F.lit(None))) == ""
    assert (one(S.shown(F.lit(1234.5), 1, "%")), one(S.shown(F.lit(None), 1)), one(S.shown(F.lit(math.nan), 1))) == ("1,234.5%", "—", "—")
    assert one(S.event_name(F.lit("霞ビル　Ｂ棟（追加取得）"))) == "霞ビルB棟" and one(S.event_name(F.lit(None))) == ""
    m = F.expr("map('b', 7, 'a', 0, 'c', 9)")
    assert (one(S.item_or(m, "a", 5)), one(S.item_or(m, "z", 5)), one(S.first_value(m, lambda v: v))) == (0, 5, 7)


def test_files_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "id string, n int")
    t = str(tmp_path / "t")
    assert sinks.published(spark, t, "id string, n int").count() == 0
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, t)
    for n in (1, 2, 3):
        sinks.replace(df.withColumn("n", F.lit(n)), t)
    assert sinks.published(spark, t).first().n == 3 and len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("version-")]) == 2
    sinks.save_ledger(df, str(tmp_path / "l"))
    assert sinks.published(spark, str(tmp_path / "l")).first().updated_at is not None
    sinks.cached(df, spark.createDataFrame([("a", 9), ("b", 2)], "id string, n int"), "id", t)
    assert {tuple(r) for r in sinks.published(spark, t).collect()} == {("a", 1), ("b", 2)}
    runs = str(tmp_path / "runs")
    assert sinks.audited(spark, "r1", runs, lambda: {"rows": 3})["status"] == "succeeded"
    with pytest.raises(ZeroDivisionError):
        sinks.audited(spark, "r2", runs, lambda: {"rows": 1 // 0})
    assert json.loads((tmp_path / "runs" / "quarantine" / "r2.json").read_text())["error"]["type"] == "ZeroDivisionError" and json.loads((tmp_path / "runs" / "r2.json").read_text())["status"] == "failed"
    f = files.Files(spark)
    a, b = str(tmp_path / "a.bin"), str(tmp_path / "b.bin")
    assert f.migrate(a, b) == "absent"
    f.write(a, b"x\x00\xff")
    assert f.migrate(a, b) == "moved" and f.read(b) == b"x\x00\xff"
    f.write(a, b"x\x00\xff")
    assert f.migrate(a, b) == "duplicate" and not f.exists(a)
    f.write(a, b"y")
    with pytest.raises(ValueError):
        f.migrate(a, b)
    assert files.inside("/r", "x/../y") == "/r/y"
    for p in ("../y", "/etc/x", "x/../../y"):
        with pytest.raises(ValueError):
            files.inside("/r", p)
    assert files.blocked("/private/../secret/x?y", ("/secret",)) and files.blocked("/.env.local", ()) and not files.blocked("/secretly", ("/secret",))


def test_documents(spark, tmp_path):
    for n, body in (("a", {"portfolio_metrics": ["x"], "property_events": []}), ("b", {"portfolio_metrics": []})):
        (tmp_path / f"{n}.json").write_text(json.dumps(body))
    schema = "portfolio_metrics array<string>, property_events array<string>"
    whole = documents.supplements(spark, [f"{tmp_path}/a*.json", f"{tmp_path}/*a.json"], schema)
    assert [list(r.portfolio_metrics) for r in whole.collect()] == [["x"]] and documents.supplements(spark, [f"{tmp_path}/z*"], schema).count() == 0
    with pytest.raises(Exception, match="property_events"):
        documents.supplements(spark, [f"{tmp_path}/b.json"], schema).collect()
    (tmp_path / "s.json").write_text(json.dumps({"nbf": {"reit": "R", "periods": [{"no": "1"}, {"no": "2", "reit": "Q"}]}, "glp": {"url": "u"}}))
    got = {(r.source, r.place): dict(r.settings) for r in documents.source_configs(spark, str(tmp_path / "s.json")).collect()}
    assert got == {("nbf", 0): {"reit": "R", "no": "1"}, ("nbf", 1): {"reit": "Q", "no": "2"}, ("glp", 0): {"url": "u"}}
    with pytest.raises(ValueError):
        documents.document_adapter(str(tmp_path), "../x", None, None)
    p = spark.createDataFrame([("a", 1, 1.0, 1.0, 50, 5, 0, 0, "t")], "doc string, page int, width double, height double, chars long, words long, tables long, images long, text string")
    r = documents.document_adapter(str(tmp_path), "x.pdf", lambda at: p, lambda d: d.select("doc"))(spark)
    assert r.rows.count() == 1 and r.assets == [f"{tmp_path}/x.pdf"]
    with pytest.raises(ValueError, match="too_few_pages"):
        documents.document_adapter(str(tmp_path), "x.pdf", lambda at: p, lambda d: d, min_pages=3)(spark)


def test_workbook_adapter(spark, tmp_path):
    from tests.test_operators import book

    (tmp_path / "a.xlsx").write_bytes(book())
    run = documents.workbook_adapter(str(tmp_path), lambda c: (c, c.limit(0)), ("一覧",), ("一",))
    assert run(spark).rows.where("text = '霞ビル'").count() == 1
    with pytest.raises(ValueError, match="収益"):
        documents.workbook_adapter(str(tmp_path), lambda c: (c, c.limit(0)), ("一覧",), ("収益",))(spark)


def test_dense_cells(spark):
    import random

    rnd = random.Random(4)
    pts = [(f"p{k:03}", 35 + rnd.random() * 0.004, 139 + rnd.random() * 0.004) for k in range(150)] + [(f"q{k}", 35.0, 180 - 0.0004 * k) for k in range(9)] + [(f"r{k}", 35.0, -180 + 0.0004 * k) for k in range(9)] + [(f"s{k}", 35.001, 139.001) for k in range(30)]
    df = spark.createDataFrame(pts, "id string, lat double, lng double")
    plain = {(r.left_id, r.right_id): round(r.km, 9) for r in geo.near_pairs(df, 0.15).collect()}

    def km(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h))

    assert set(plain) == {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and km(a, b) <= 0.15}
    for hot, fine in ((3, 8), (10, 3), (40, 8)):
        got = geo.near_pairs(df, 0.15, hot_cell=hot, fine=fine).collect()
        assert len(got) == len(plain) and {(r.left_id, r.right_id): round(r.km, 9) for r in got} == plain


def test_hot_keys_meet_in_small_groups(spark, monkeypatch):
    df = spark.createDataFrame([("k", f"r{k:04}") for k in range(1000)], "k string, r string")
    groups = []
    join = type(df).join

    def seen(left, right, on=None, how=None):
        if on == ["k", "_i", "_j"]:
            groups.extend(max(r["count"] for r in side.groupBy("_i", "_j").count().collect()) for side in (left, right))
        return join(left, right, on, how)

    monkeypatch.setattr(type(df), "join", seen)
    assert pairs.pairs_by_key(df, ["k"], "r", 100).count() == 1000 * 999 // 2 and groups and max(groups) <= 200

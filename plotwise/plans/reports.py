"""Queries of whole reports and pipelines: the quality gate, comparisons, pages, reviews, selections and issuers' workbooks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plotwise.functions import scalars as S
from plotwise.functions.scalars import METRICS
from plotwise.operators import comparison, gate, geo, issuers, pages, quality, reviews, sanitized, search, timeseries
from plotwise.operators.changes import MASTER
from plotwise.plans import domain as D
from plotwise.session import materialize
from plotwise.sources.tables import table

M = list(METRICS)


# --- the quality gate -------------------------------------------------------------------------------------------------------


def _dataset(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Rows of property_master with the last item of each metric, and periods with the last item of their date."""
    pm, ev = table(spark, sf, "property_master"), table(spark, sf, "source_evidence")
    own = gate.evidence_maps(ev, ["property_id"], "evidence_id").withColumnRenamed("property_id", "id")
    dated = gate.evidence_maps(ev, ["property_id", "observed_at"], "evidence_id").withColumnsRenamed({"property_id": "id", "observed_at": "as_of_date"})
    below = table(spark, sf, "property_period").select(F.col("property_id").alias("id"), "as_of_date", *M)
    return pm.join(own, "id", "left"), below.join(dated, ["id", "as_of_date"], "left")


def _counts(spark, sf):
    top, below = _dataset(spark, sf)
    return materialize(gate.counts(gate.records(top, below, "reit_code")))  # a row for each issuer


def _totals(spark, sf):
    return gate.totals(_counts(spark, sf), table(spark, sf, "property_master").select("id"))


def q_gate_totals(spark, sf):
    """Totals, errors, warnings and status of the dataset."""
    return _totals(spark, sf).select(*gate.TOTALS)


def q_gate_checks(spark, sf):
    """The seven checks."""
    return gate.checks(_totals(spark, sf))


def q_gate_by_group(spark, sf):
    """Properties, periods, values, evidence and coordinates of each issuer."""
    return gate.by_group(_counts(spark, sf))


def q_gate_by_metric(spark, sf):
    """Values and complete evidence of each metric over all records."""
    return gate.by_metric(_counts(spark, sf))


def q_importer_issues(spark, sf):
    """Cap rates and occupancies that an importer reports."""
    return gate.importer_issues(table(spark, sf, "property_period"), "row_id")


# --- comparison of two states -------------------------------------------------------------------------------------------------


def _state(spark, sf, delivery: int, loads: str, first: bool) -> comparison.Dataset:
    """A delivery's properties, and the periods of some loads, each metric with the first or the last document of its date."""
    ident = lambda c: F.lower(F.trim(F.col(c))).alias("id")
    ps = table(spark, sf, "property_snapshot").where(F.col("snapshot_no") == delivery)
    given = ("name", "reit_code")
    top = ps.select(ident("id"), F.col("row_id").alias("pos"), *(F.col(c) if c in given else F.lit(None).cast("string").alias(c) for c in MASTER))
    e = table(spark, sf, "source_evidence").dropna(subset=["property_id", "observed_at", "field"])
    pick = F.min_by if first else F.max_by
    docs = e.groupBy(ident("property_id"), F.col("observed_at").alias("as_of_date"), "field").agg(pick("source_document_id", "evidence_id").alias("d"))
    docs = docs.groupBy("id", "as_of_date").agg(F.map_from_entries(F.collect_list(F.struct("field", "d"))).alias("docs"))  # a document for each metric
    pp = table(spark, sf, "property_period").where(loads).select(ident("property_id"), F.col("row_id").alias("pos"), "as_of_date", "period_no", "period", *M)
    return comparison.Dataset(top, pp.join(docs, ["id", "as_of_date"], "left"))


def _both(spark, sf):
    return _state(spark, sf, 1, "load_no <= 9", True), _state(spark, sf, 5, "load_no >= 2", False)


def c_report_events(spark, sf):
    """All differences between the first and the last state."""
    return comparison.events(*_both(spark, sf), "reit_code")


def c_report_totals(spark, sf):
    """Totals of the differences and the status."""
    a, b = _both(spark, sf)
    return comparison.totals(materialize(comparison.events(a, b, "reit_code")), a, b)


def c_report_by_group(spark, sf):
    """Differences by issuer."""
    return comparison.by_group(c_report_events(spark, sf))


def c_report_by_metric(spark, sf):
    """Differences by metric."""
    return comparison.by_metric(c_report_events(spark, sf))


def c_baseline(spark, sf):
    """The report of a first delivery."""
    return comparison.baseline(_both(spark, sf)[1])


# --- pages and reviews ---------------------------------------------------------------------------------------------------------


def _pages(spark, sf):
    """Evidence in documents as pages: a page has its items' codes as characters and words, tables by their parser."""
    e = table(spark, sf, "source_evidence").where("source_document_id is not null and locator.page is not null")
    at = e.groupBy(F.col("source_document_id").alias("doc"), F.col("locator.page").alias("page"))
    rows = at.agg(F.sum(F.coalesce(F.length("metric_code"), F.lit(0))).alias("chars"), F.count(F.lit(1)).alias("words"), F.count_if(F.col("extraction.parser") == "page_table").alias("tables"), F.count_if(F.col("locator.bbox").isNull()).alias("images"))
    return rows.select("*", F.lit(595.27).alias("width"), F.lit(841.89).alias("height"))


def d_layout(spark, sf):
    """Pages, texts, tables and the digest of each document's layout."""
    return pages.layout(_pages(spark, sf)).withColumn("table_pages", F.array_join(F.col("table_pages").cast("array<string>"), ","))


def d_validated(spark, sf):
    """Which layouts are compatible with at most nine pages, two of them text, and a table on pages 1 and 2."""
    v = pages.validated(pages.layout(_pages(spark, sf)), 1, 9, 2, (1, 2))
    return v.select("doc", "status", F.array_join("reasons", ",").alias("reasons"), F.array_join(F.col("missing_table_pages").cast("array<string>"), ",").alias("missing"))


def d_figures(spark, sf):
    """The first number of each page's label row as a figure in other units, with its place."""
    w = D.words(spark, sf)
    f = pages.with_evidence(pages.row_value(w, ["cap", "noi"], 0), w, "noi", "noi_million_yen", "million_jpy", pages.ROW_CONFIDENCE, "row_reader", multiplier=100.0)
    return f.select("doc", "page", F.round("value", 4).alias("value"), F.array_join(F.transform("evidence.locator.bbox", lambda x: F.format_string("%.2f", x)), ",").alias("bbox"), "evidence.extraction.confidence", "evidence.review.status")


def r_summary(spark, sf):
    """Items of each document by the state of their review."""
    return reviews.summary(table(spark, sf, "source_evidence").select("source_document_id", F.col("review.status").alias("status")), "source_document_id")


def _decisions(spark, sf, status: str):
    e = table(spark, sf, "source_evidence").where(F.col("review.status") == status).where("property_id is not null and field is not null and observed_at is not null")
    key = F.concat_ws("|", "property_id", "field", "observed_at")
    last = e.groupBy(key.alias("evidence_id")).agg(F.max("evidence_id").alias("at"))
    return last.select("evidence_id", F.lit(status).alias("status"), F.lit(" reader ").alias("reviewed_by"), F.format_string("%012d", "at").alias("reviewed_at"), F.lit("  ").alias("note"))


def r_upserted(spark, sf):
    """The ledger of approvals after the rejections of the same values were entered."""
    return reviews.upserted(_decisions(spark, sf, "approved"), _decisions(spark, sf, "rejected"))


def r_cleared(spark, sf):
    """The ledger of approvals without those of values that were rejected too."""
    return reviews.cleared(_decisions(spark, sf, "approved"), _decisions(spark, sf, "rejected")).select("evidence_id", "status", "reviewed_at")


def r_idempotency(spark, sf):
    """A digest of the documents of each issuer."""
    d = table(spark, sf, "source_document").where("reit_code is not null")
    a = d.select(F.col("reit_code").alias("run_id"), F.lit(0).alias("adapter_place"), F.col("reit_code").alias("adapter_id"), F.lit("1.0").alias("adapter_version"), F.col("document_id").alias("asset_place"), "sha256", F.col("title").alias("layout_fingerprint"))
    return reviews.idempotency_keys(a)


def r_layout_states(spark, sf):
    """Each feed's schema of the last load against that of the first."""
    q = table(spark, sf, "quality_report")
    at = lambda n: q.where(F.col("load_no") == n).groupBy(F.col("feed_id").alias("key")).agg(F.max("schema_version").alias("fingerprint"))
    return reviews.baselines(at(1), at(10))[0]


def r_run_totals(spark, sf):
    """Adapters, properties and issues of each run, a run being all feeds' loads of a number."""
    return reviews.run_totals(table(spark, sf, "quality_report").select(F.col("load_no").alias("run_id"), F.col("feed_id").alias("adapter_id"), F.col("totals.properties").alias("properties"), F.col("totals.errors").alias("issues")))


def s_quality_status(spark, sf):
    """What may be shown of the quality reports."""
    return sanitized.quality_status(table(spark, sf, "quality_report"))


def s_documents(spark, sf):
    """What may be shown of the source documents."""
    return sanitized.documents(table(spark, sf, "source_document"))


def u_event_sources(spark, sf):
    """Distinct titles and addresses of each publisher's documents, the last read of equal ones."""
    d = table(spark, sf, "source_document").select("publisher", F.col("title").alias("document"), "url", "document_id", F.struct("retrieved_at", "document_id").alias("o"))
    return pages.event_sources(d, ["publisher"], "o").drop("o")


def u_missing_fragments(spark, sf):
    """Pieces of sheet names that no sheet of a document holds."""
    names = table(spark, sf, "source_evidence").where("source_document_id is not null and locator.sheet is not null").select(F.col("source_document_id").alias("doc"), F.col("locator.sheet").alias("name")).distinct()
    wanted = names.select("doc").distinct().select("doc", F.explode(F.array(*map(F.lit, ("NOI", "評価", "Port")))).alias("fragment"))
    return pages.missing_fragments(wanted, names, ["doc"])


# --- search and selections -----------------------------------------------------------------------------------------------------


def f_pipeline(spark, sf):
    """Attributes, box and circle in one plan."""
    p = D.properties(spark, sf, "name", "address", "reit", "type", "lat", "lng", "cap", "price")
    rows = search.search(p, {"type": "オフィス"}, "県", {"cap": (2.0, 6.0), "price": (None, 90000.0)}, (33.0, 38.0, 130.0, 140.0), (35.5, 135.0, 500.0))
    return rows.select("id", F.round("km", 6).alias("km"))


def g_extent(spark, sf):
    """The box around all valid points."""
    return search.extent(D.positions(spark, sf).distinct())


def g_destination(spark, sf):
    """From every point 12.5 km to the north-east, and the way back."""
    p = D.positions(spark, sf).distinct()
    to = search.destination(F.col("lat"), F.col("lng"), F.lit(12.5), F.lit(45.0))
    rows = p.withColumn("to", to).where("to is not null")
    return rows.select("id", F.round("to.lat", 6).alias("lat"), F.round("to.lng", 6).alias("lng"), F.round(geo.haversine_km(F.col("lat"), F.col("lng"), F.col("to.lat"), F.col("to.lng")), 6).alias("km"))


def o_name_sort(spark, sf):
    """Place of each property by name in Japanese collation."""
    return search.ranked(D.properties(spark, sf, "name"), *search.offered_sort("name-asc")).select("id", "name", "rank")


def o_area_sort(spark, sf):
    """Place of each property by leasable area, largest first, then by name in Japanese collation."""
    return search.ranked(D.properties(spark, sf, "name", "leasable_area"), *search.offered_sort("area-desc")).select("id", "leasable_area", "rank")


def _saved(spark, sf):
    """A selection made from deliveries: every id of them, by when it was first delivered."""
    ps = table(spark, sf, "property_snapshot")
    return ps.where("id is not null").groupBy("id").agg(F.min("row_id").alias("ord"))


def j_restored(spark, sf):
    """The first fifty saved ids that are still properties."""
    return search.restored_selection(_saved(spark, sf), D.positions(spark, sf))


def j_selected(spark, sf):
    """The properties of the saved selection."""
    return search.selected(D.properties(spark, sf, "name", "price"), _saved(spark, sf))


# --- series and scalars ---------------------------------------------------------------------------------------------------------


def t_raw_timeline(spark, sf):
    """Every key of the periods with the label of its first period."""
    return timeseries.timeline(D._keyed(spark, sf), "key")


def a_quantiles(spark, sf):
    """The tenth and the ninetieth percentile of each property's caps."""
    rows = timeseries.half_year_series(D._keyed(spark, sf)).groupBy("id").agg(F.sort_array(F.collect_list("value")).alias("v"))  # a value for each half-year
    return rows.select("id", F.round(timeseries.quantile(F.col("v"), 0.1), 9).alias("p10"), F.round(timeseries.quantile(F.col("v"), 0.9), 9).alias("p90"), timeseries.quantile(F.col("v"), 7.0).alias("highest"))


def t_current(spark, sf):
    """The last of each property's periods in their order."""
    return timeseries.current(timeseries.sorted_periods(D.periods(spark, sf), "period_no", "cap"))


def t_default_period(spark, sf):
    """Periods of all properties of the last delivery, one made of its own values for those without any."""
    ps = table(spark, sf, "property_snapshot").where("snapshot_no = 5 and id is not null").groupBy("id").agg(F.max_by("cap", "row_id").alias("cap"))
    rows = D.periods(spark, sf).join(ps.select("id"), "id", "left_semi")
    return timeseries.with_default_period(ps, rows, ("cap",)).select("id", "pos", "as_of_date", "cap")


def t_default_metric(spark, sf):
    """The first offered metric that each property has."""
    return D.periods(spark, sf).where("id is not null").groupBy("id").agg(timeseries.default_metric().alias("metric"))


def a_axis(spark, sf):
    """Bounds of an axis for each issuer's occupancies."""
    return timeseries.axis_bounds(table(spark, sf, "property_period"), "occupancy", "reit_code", ceiling=100.0).withColumns({c: F.round(c, 9) for c in ("low", "high")})


def a_latest_date(spark, sf):
    """The latest date of periods and documents."""
    return timeseries.latest_date(table(spark, sf, "property_period"), table(spark, sf, "source_document"))


def j_evidence_fallback(spark, sf):
    """The document of each period's cap rate: the period's own evidence, else the property's."""
    e = table(spark, sf, "source_evidence").where("field = 'cap' and property_id is not null")
    own = e.groupBy(F.col("property_id").alias("id")).agg(F.max_by(F.struct("source_document_id"), "evidence_id").alias("own"))
    dated = e.where("observed_at is not null").groupBy(F.col("property_id").alias("id"), F.col("observed_at").alias("as_of_date")).agg(F.max_by(F.struct("source_document_id"), "evidence_id").alias("dated"))
    rows = D.periods(spark, sf).select("id", "pos", "as_of_date").join(dated, ["id", "as_of_date"], "left").join(own, "id", "left")
    return rows.select("pos", F.coalesce("dated", "own")["source_document_id"].alias("source_document_id"))


def x_scalars(spark, sf):
    """Conversions of units, bands, ids and texts of each row of property_master."""
    pm = table(spark, sf, "property_master")
    v = F.col
    return pm.select(
        "id", "loaded_at", S.million_yen(v("price")).alias("million"), S.percent_from_fraction(S.finite(v("cap"))).alias("percent"), S.zero_to_null(v("noi")).alias("noi"), issuers.thousand_to_million(v("noi")).alias("thousand"), S.clamp_radius(v("cap")).alias("radius"),
        S.document_id(F.encode(v("id"), "UTF-8")).alias("document"), S.round_to(v("price"), 25.0).alias("bucket"), S.safe_url(F.concat(v("source"), F.lit("://x"))).alias("url"), S.html_text(F.concat(F.lit("<"), v("name"), F.lit("&'\""))).alias("html"),
        S.shown(v("leasable_area"), 2, " m2").alias("shown"), S.canonical_name(v("name")).alias("canonical"), S.region_of(v("address"), {"east": ("翠陵県", "灯台県"), "west": ("琴浜県",)}).alias("region"), timeseries.yield_metric(F.when(v("type") == "オフィス", "terminal_cap_rate")).alias("rate"),
        timeseries.series_mode(F.lit(None).cast("string"), F.length("id")).alias("mode"), timeseries.nearest_index(S.finite(v("cap")), F.lit(1.0), F.lit(6.0), F.lit(5)).alias("ix"),
    )


def x_map_values(spark, sf):
    """Members of evidence by key: with a default, their number, and the first page given."""
    own = gate.evidence_maps(table(spark, sf, "source_evidence"), ["property_id"], "evidence_id")
    code = F.transform_values("evidence", lambda _, v: v["metric_code"])
    return own.select("property_id", S.item_or(code, "cap", "none").alias("cap"), F.size(F.map_keys("evidence")).alias("n"), S.first_value(F.col("evidence"), lambda v: v["locator"]["page"]).alias("page"))


# --- issuers' workbooks -----------------------------------------------------------------------------------------------------------


def _workbooks(spark, sf):
    """Each load of property_period as an issuer's workbook: a list below a header, totals above, incomes in columns of their own sheet."""
    pp = table(spark, sf, "property_period").where("feed_id is not null and load_no is not null and property_id is not null")
    doc = F.concat_ws("-", "feed_id", "load_no")
    k = F.row_number().over(Window.partitionBy("feed_id", "load_no").orderBy("row_id"))
    r = pp.select(doc.alias("doc"), k.alias("k"), *(S.finite(F.col(m)).alias(m) for m in M), "property_id", "type")
    num = lambda sheet, row, col, v: F.struct(F.lit(sheet).alias("sheet"), col.alias("col"), row.alias("row"), v.cast("double").alias("num"), F.lit(None).cast("string").alias("text"))
    txt = lambda sheet, row, col, v: F.struct(F.lit(sheet).alias("sheet"), col.alias("col"), row.alias("row"), F.lit(None).cast("double").alias("num"), v.alias("text"))
    row, main, income = F.col("k") + 5, "データシート", "収益状況"
    at = {**issuers._OFFICE}
    yen, rate = ("price", "book_value", "appraisal"), ("cap", "discount_rate", "terminal_cap_rate")
    cell = lambda m: F.col(m) * 1e6 if m in yen else F.col(m) / 100 if m in rate else F.col(m)
    cells = [num(main, row, F.lit(1), F.pmod("k", F.lit(3)) + 1), txt(main, row, F.lit(2), F.concat("property_id", F.lit("　*1"))), txt(main, row, F.lit(3), F.col("type")), *(num(main, row, F.lit(c), cell(m)) for m, c in at.items())]
    cells += [txt(income, F.lit(3), F.col("k") + 1, F.col("property_id")), num(income, F.lit(6), F.col("k") + 1, F.col("noi"))]
    head = F.array(txt(main, F.lit(5), F.lit(2), F.lit("物件名")), txt(main, F.lit(4), F.lit(2), F.lit("全物件 計")), txt(income, F.lit(3), F.lit(1), F.lit("科目")), txt(income, F.lit(6), F.lit(1), F.lit("NOI")))
    body = r.select("doc", F.inline(F.array(*cells))).where("num is not null or text is not null")
    docs = pp.groupBy(doc.alias("doc")).agg(F.max("load_no").alias("period_no"), F.lit("p").alias("period"), F.lit("2025-01-01").alias("as_of_date"))
    return body.unionByName(docs.select("doc", F.inline(head))), docs


def n_office_periods(spark, sf):
    """Loads written as workbooks and read again by the issuer's normalizer."""
    rows, _, _ = issuers.office_periods(*_workbooks(spark, sf))
    return rows.select("doc", "row", "name", "region", "address", "period_no", *(F.round(m, 3).alias(m) for m in M))


def n_office_issues(spark, sf):
    """What the normalizer reports, by document and field."""
    _, issues, _ = issuers.office_periods(*_workbooks(spark, sf))
    return issues.groupBy("doc", "field").agg(F.count(F.lit(1)).alias("n"))


def n_reconciled(spark, sf):
    """Sums of a workbook's properties against totals that leave out its last row."""
    rows, _, _ = issuers.office_periods(*_workbooks(spark, sf))
    rows = materialize(rows)
    last = rows.withColumn("z", F.max("row").over(Window.partitionBy("doc"))).where("row < z")
    sums = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("_n")).join(last.groupBy("doc").agg(*(F.sum(c).alias(c) for c in issuers.TOLERANCES)), "doc", "left").drop("_n")
    out = issuers.reconciled(rows, sums, "doc")
    return out.select("doc", "field", "state", *(F.round(c, 3).alias(c) for c in ("source", "normalized", "difference")))


QUERIES = {f.__name__: f for f in (
    q_gate_totals, q_gate_checks, q_gate_by_group, q_gate_by_metric, q_importer_issues, c_report_events, c_report_totals, c_report_by_group, c_report_by_metric, c_baseline, d_layout, d_validated, d_figures, r_summary, r_upserted, r_cleared,
    r_idempotency, r_layout_states, r_run_totals, s_quality_status, s_documents, u_event_sources, u_missing_fragments, f_pipeline, g_extent, g_destination, o_name_sort, o_area_sort, j_restored, j_selected, t_raw_timeline, a_quantiles, t_current,
    t_default_period, t_default_metric, a_axis, a_latest_date, j_evidence_fallback, x_scalars, x_map_values, n_office_periods, n_office_issues, n_reconciled,
)}

# --- SQL --------------------------------------------------------------------------------------------------------------------------

_ITEM = "struct_pack(c := metric_code, u := unit, v := value, d := source_document_id, t := retrieved_at, l := locator, x := extraction)"
_IS = lambda c: f"coalesce({c}, '') <> ''"
_DONE = "coalesce((coalesce(e.l.page <> 0, false) OR ({s} AND ({c} OR {r}))) AND ".format(s=_IS("e.l.sheet"), c=_IS("e.l.cell"), r=_IS("e.l.cell_range")) + " AND ".join(_IS(f"e.{c}") for c in ("d", "t", "c", "u")) + f" AND {_IS('e.x.parser')} AND {_IS('e.x.parser_version')}, false)"
_GRP = f"coalesce(nullif(reit_code, ''), '{quality.UNCLASSIFIED}')"


def _cell_sql() -> str:
    out = []
    for m, (code, unit) in METRICS.items():
        right = f"coalesce(e.c = '{code}' AND e.u = '{unit}' AND NOT isnan(e.v) AND NOT isnan(value) AND abs(e.v - value) <= 1e-9, false)"
        low, included, high = quality.RANGES.get(m, (None, True, None))
        beyond = "false" if m not in quality.RANGES else f"(value {'<' if included else '<='} {low}" + (f" OR isnan(value) OR value > {high}" if high is not None else "") + ")"
        for src in (f"SELECT {_GRP} AS grp, {m} AS value, i.e FROM property_master r LEFT JOIN ip i ON i.id = r.id AND i.field = '{m}'", f"SELECT o.grp, r.{m} AS value, i.e FROM property_period r JOIN owner o ON o.id = r.property_id LEFT JOIN ih i ON i.id = r.property_id AND i.at = r.as_of_date AND i.field = '{m}'"):
            out.append(f"SELECT grp, '{m}' AS field, {_DONE} AS complete, {_DONE} AND NOT {right} AS mismatched, {beyond} AS outside FROM ({src}) WHERE value IS NOT NULL")
    return " UNION ALL ".join(out)


_AREA = "coalesce(leased_area > leasable_area * 1.02::DOUBLE AND NOT isnan(leased_area) AND NOT isnan(leasable_area), false)"
_VALIDC = "(NOT isnan(lat) AND NOT isnan(lng) AND lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180)"
_GATE = f"""WITH ip AS (SELECT property_id AS id, field, arg_max({_ITEM}, evidence_id) AS e FROM source_evidence WHERE property_id IS NOT NULL AND field IS NOT NULL GROUP BY 1, 2),
  ih AS (SELECT property_id AS id, observed_at AS at, field, arg_max({_ITEM}, evidence_id) AS e FROM source_evidence WHERE property_id IS NOT NULL AND observed_at IS NOT NULL AND field IS NOT NULL GROUP BY 1, 2, 3),
  owner AS (SELECT id, max({_GRP}) AS grp FROM property_master WHERE id IS NOT NULL GROUP BY id), cell AS ({_cell_sql()}),
  top AS (SELECT {_GRP} AS grp, count(*) AS properties, count(*) FILTER ({' OR '.join(f"coalesce({c}, '') = ''" for c in quality.REQUIRED)}) AS lacking, count(*) FILTER (lat IS NULL OR lng IS NULL) AS nowhere, count(*) FILTER (lat IS NOT NULL AND lng IS NOT NULL AND NOT {_VALIDC}) AS bad, count(*) FILTER (lat IS NOT NULL AND lng IS NOT NULL AND {_VALIDC}) AS placed, count(*) FILTER ({_AREA}) AS areas FROM property_master GROUP BY 1),
  low AS (SELECT o.grp, count(*) AS periods, count(*) FILTER ({_AREA}) AS areas FROM property_period r JOIN owner o ON o.id = r.property_id GROUP BY 1),
  cg AS (SELECT grp, count(*) AS n, count(*) FILTER (complete) AS ok FROM cell GROUP BY grp),
  tot AS (SELECT (SELECT sum(properties) FROM top) AS properties, (SELECT coalesce(sum(periods), 0) FROM low) AS periods, (SELECT count(*) FROM cell) AS numeric_values, (SELECT count(*) FROM cell WHERE complete) AS evidence_complete, (SELECT sum(placed) FROM top) AS with_coordinates,
    (SELECT count(*) FROM (SELECT id FROM property_master WHERE coalesce(id, '') <> '' GROUP BY id HAVING count(*) > 1)) AS duplicate_ids, (SELECT sum(lacking) FROM top) AS lacking, (SELECT count(*) FROM cell WHERE outside) AS outside, (SELECT count(*) FROM cell WHERE mismatched) AS mismatched,
    (SELECT sum(nowhere) FROM top) AS nowhere, (SELECT sum(bad) FROM top) AS bad, (SELECT sum(areas) FROM top) + (SELECT coalesce(sum(areas), 0) FROM low) AS areas)"""
_PCT = D._PCT
_GATE_TOTALS = f"""SELECT CASE WHEN errors > 0 THEN 'failed' WHEN warnings > 0 THEN 'warning' ELSE 'passed' END AS status, * EXCLUDE (lacking, outside, mismatched, nowhere, bad, areas), {_PCT('evidence_complete', 'numeric_values')} AS evidence_coverage, {_PCT('with_coordinates', 'properties')} AS coordinate_coverage FROM
  (SELECT * , CAST(duplicate_ids + lacking + bad + outside + numeric_values - evidence_complete + mismatched AS BIGINT) AS errors, CAST(nowhere + areas AS BIGINT) AS warnings FROM tot)"""
_CHECK_N = {"unique_property_id": "duplicate_ids", "required_fields": "lacking", "numeric_ranges": "outside", "evidence_completeness": "numeric_values - evidence_complete", "evidence_consistency": "mismatched", "coordinates": "nowhere + bad", "leased_area_consistency": "areas"}

_EID = "lower(trim({c}))"
_DKEY = "concat_ws('|', coalesce(nullif(as_of_date, ''), 'undated'), coalesce(CAST(period_no AS VARCHAR), nullif(period, ''), 'unlabelled'))"


def _compare_sql() -> str:
    nan = ", ".join(f"CASE WHEN NOT isnan({m}) THEN {m} END AS {m}" for m in M)
    props = lambda n: f"SELECT lower(trim(id)) AS id, name, reit_code FROM property_snapshot WHERE snapshot_no = {n} AND coalesce(trim(id), '') <> '' QUALIFY row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY row_id DESC) = 1"
    rows = lambda w: f"SELECT lower(trim(property_id)) AS id, row_id AS pos, as_of_date AS at, {_DKEY} AS key, {nan} FROM property_period WHERE {w} AND property_id IS NOT NULL"
    last = lambda t: f"SELECT * FROM {t} QUALIFY row_number() OVER (PARTITION BY id, key ORDER BY pos DESC) = 1"
    docs = lambda f: f"SELECT lower(trim(property_id)) AS id, observed_at AS at, field, {f}(struct_pack(d := source_document_id), evidence_id).d AS d FROM source_evidence WHERE property_id IS NOT NULL AND observed_at IS NOT NULL AND field IS NOT NULL GROUP BY 1, 2, 3"
    none, num = "NULL::VARCHAR", "NULL::DOUBLE"
    event = lambda kind, period=none, field=none, bt=none, at=none, b=num, a=num: f"SELECT id AS property_id, grp, {kind} AS kind, {period} AS period_key, {field} AS field, {bt} AS before_text, {at} AS after_text, {b} AS before, {a} AS after"
    parts = [event("'properties_' || state") + " FROM j WHERE state <> 'shared'"]
    parts += [event("'master_field_changes'", field=f"'{c}'", bt=f"a_{c}", at=f"b_{c}") + f" FROM j WHERE state = 'shared' AND a_{c} IS DISTINCT FROM b_{c}" for c in ("name", "reit_code")]
    for t, s in (("qb", "added"), ("qa", "removed")):
        parts.append(event(f"'periods_{s}'", "key") + f" FROM {t} JOIN j USING (id) WHERE state = '{s}'")
        parts += [event(f"'metric_values_{s}'", "key", f"'{m}'", **({"a": m} if s == "added" else {"b": m})) + f" FROM {t} JOIN j USING (id) WHERE state = '{s}' AND {m} IS NOT NULL" for m in M]
    parts.append(event("CASE WHEN xk IS NULL THEN 'periods_added' ELSE 'periods_removed' END", "coalesce(xk, yk)") + " FROM f WHERE xk IS NULL OR yk IS NULL")
    for m in M:
        kind = f"CASE WHEN x_{m} IS NULL THEN 'metric_values_added' WHEN y_{m} IS NULL THEN 'metric_values_removed' ELSE 'metric_values_changed' END"
        parts.append(event(kind, "coalesce(xk, yk)", f"'{m}'", b=f"x_{m}", a=f"y_{m}") + f" FROM f WHERE x_{m} IS DISTINCT FROM y_{m}")
        parts.append(f"SELECT f.id, grp, 'evidence_relinked', xk, '{m}', da.d, db.d, x_{m}, y_{m} FROM f JOIN da ON da.id = f.id AND da.at = xat AND da.field = '{m}' JOIN db ON db.id = f.id AND db.at = yat AND db.field = '{m}' WHERE x_{m} = y_{m} AND coalesce(da.d, '') <> '' AND coalesce(db.d, '') <> '' AND da.d <> db.d")
    xs = ", ".join(f"x.{m} AS x_{m}, y.{m} AS y_{m}" for m in M)
    return f"""WITH pa AS ({props(1)}), pb AS ({props(5)}), qa AS ({rows('load_no <= 9')}), qb AS ({rows('load_no >= 2')}), la AS ({last('qa')}), lb AS ({last('qb')}), da AS ({docs('arg_min')}), db AS ({docs('arg_max')}),
      j AS (SELECT coalesce(pa.id, pb.id) AS id, CASE WHEN pa.id IS NULL THEN 'added' WHEN pb.id IS NULL THEN 'removed' ELSE 'shared' END AS state, coalesce(nullif(pb.reit_code, ''), nullif(pa.reit_code, ''), '{quality.UNCLASSIFIED}') AS grp, pa.name AS a_name, pb.name AS b_name, pa.reit_code AS a_reit_code, pb.reit_code AS b_reit_code FROM pa FULL JOIN pb ON pa.id = pb.id),
      f AS (SELECT j.id, j.grp, z.* EXCLUDE (id) FROM (SELECT coalesce(x.id, y.id) AS id, x.key AS xk, y.key AS yk, x.at AS xat, y.at AS yat, {xs} FROM la x FULL JOIN lb y ON x.id = y.id AND x.key = y.key) z JOIN j ON j.id = z.id AND j.state = 'shared'),
      ev AS ({' UNION ALL '.join(parts)})"""


_COMPARE = _compare_sql()
_N = lambda k: f"count(*) FILTER (kind = '{k}') AS {k}"
_CHANGED = "count(DISTINCT CASE WHEN kind NOT IN ('properties_added', 'properties_removed') AND property_id NOT IN (SELECT id FROM j WHERE state <> 'shared') THEN property_id END) AS properties_changed"
_PAGES = "p AS (SELECT source_document_id AS doc, locator.page AS page, CAST(sum(coalesce(length(metric_code), 0)) AS BIGINT) AS chars, count(*) AS words, count(*) FILTER (extraction.parser = 'page_table') AS tables, count(*) FILTER (locator.bbox IS NULL) AS images FROM source_evidence WHERE source_document_id IS NOT NULL AND locator.page IS NOT NULL GROUP BY 1, 2)"
_LAYOUT = f"WITH {_PAGES}, l AS (SELECT doc, count(*) AS pages, count(*) FILTER (chars >= 20) AS text_pages, count(*) FILTER (chars < 20) AS low_text_pages, count(*) FILTER (chars >= 20) = 0 AS requires_ocr, coalesce(string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) FILTER (tables > 0), '') AS table_pages, list(page) FILTER (tables > 0) AS tp, sha256(string_agg(concat_ws('|', page, 595.3, 841.9, CAST(round_even(chars / 100, 0) * 100 AS BIGINT), CAST(round_even(words / 25, 0) * 25 AS BIGINT), tables, images), chr(10) ORDER BY page)) AS fingerprint FROM p GROUP BY doc)"
_DECIDED = lambda s: f"(SELECT concat_ws('|', property_id, field, observed_at) AS evidence_id, '{s}' AS status, format('{{:012d}}', max(evidence_id)) AS reviewed_at FROM source_evidence WHERE review.status = '{s}' AND property_id IS NOT NULL AND field IS NOT NULL AND observed_at IS NOT NULL GROUP BY 1)"
_SAVED = "s AS (SELECT id, min(row_id) AS o FROM property_snapshot WHERE id IS NOT NULL GROUP BY id)"
_HAV = D._HAV.format(a="p.", b="q.")
_FN = lambda c: f"CASE WHEN isfinite({c}) THEN {c} END"
_BOOK = f"""b AS (SELECT feed_id || '-' || load_no AS doc, CAST(row_number() OVER (PARTITION BY feed_id, load_no ORDER BY row_id) AS INT) AS k, load_no, property_id AS name, type AS address, {', '.join(f'{_FN(m)} AS {m}' for m in M)} FROM property_period WHERE feed_id IS NOT NULL AND load_no IS NOT NULL AND property_id IS NOT NULL),
  g AS (SELECT *, arg_max(struct_pack(n := noi), k) OVER (PARTITION BY doc, name) AS inc FROM b), n AS (SELECT doc, CAST(k + 5 AS INT) AS row, name, CASE k % 3 + 1 WHEN 1 THEN '東京都心部' WHEN 2 THEN '東京周辺都市部' ELSE '地方都市部' END AS region, address, load_no AS period_no, {', '.join(f'round({m}, 3) AS {m}' for m in M if m != 'noi')}, round(inc.n, 3) AS noi FROM g WHERE k <= 200 AND price IS NOT NULL AND coalesce(address, '') <> '')"""

SQL = {
    "q_gate_totals": f"{_GATE} {_GATE_TOTALS}",
    "q_gate_checks": f"{_GATE} " + " UNION ALL ".join(f"SELECT {k} AS place, '{c}' AS code, '{s}' AS severity, CASE WHEN {_CHECK_N[c]} = 0 THEN 'passed' ELSE '{'failed' if s == 'error' else 'warning'}' END AS status, CAST({_CHECK_N[c]} AS BIGINT) AS n FROM tot" for k, (c, s) in enumerate(gate.CHECKS)),
    "q_gate_by_group": f"{_GATE} SELECT top.grp, properties, coalesce(periods, 0) AS periods, coalesce(n, 0) AS numeric_values, coalesce(ok, 0) AS evidence_complete, placed AS with_coordinates, {_PCT('coalesce(ok, 0)', 'coalesce(n, 0)')} AS evidence_coverage, {_PCT('placed', 'properties')} AS coordinate_coverage FROM top LEFT JOIN low USING (grp) LEFT JOIN cg USING (grp)",
    "q_gate_by_metric": f"{_GATE} SELECT m.field, count(c.field) AS available, count(*) FILTER (c.complete) AS evidence_complete, {_PCT('count(*) FILTER (c.complete)', 'count(c.field)')} AS coverage FROM (VALUES {', '.join(f'({m!r})' for m in M)}) AS m(field) LEFT JOIN cell c ON c.field = m.field GROUP BY m.field",
    "q_importer_issues": "SELECT row_id, 'cap' AS field, cap AS value FROM property_period WHERE NOT (cap > 0 AND cap < 20) UNION ALL SELECT row_id, 'occupancy', occupancy FROM property_period WHERE occupancy NOT BETWEEN 0 AND 100",
    "c_report_events": f"{_COMPARE} SELECT * FROM ev",
    "c_report_totals": f"{_COMPARE} SELECT {', '.join(map(_N, comparison.KINDS))}, {_CHANGED}, (SELECT count(*) FROM pa) AS previous_properties, (SELECT count(*) FROM pb) AS current_properties, CASE WHEN count(*) > 0 THEN 'changed' ELSE 'unchanged' END AS status FROM ev",
    "c_report_by_group": f"{_COMPARE} SELECT grp, {', '.join(_N(k) for k in comparison.KINDS if k != 'master_field_changes')}, {_CHANGED} FROM ev GROUP BY grp",
    "c_report_by_metric": f"{_COMPARE} SELECT m.field, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {n}" for k, n in (("metric_values_added", "added"), ("metric_values_removed", "removed"), ("metric_values_changed", "changed"), ("evidence_relinked", "evidence_relinked"))) + f" FROM (VALUES {', '.join(f'({m!r})' for m in M)}) AS m(field) LEFT JOIN ev ON ev.field = m.field GROUP BY m.field",
    "c_baseline": "SELECT " + ", ".join(f"CAST(0 AS BIGINT) AS {k}" for k in (*comparison.KINDS, "properties_changed", "previous_properties")) + ", count(DISTINCT lower(trim(id))) FILTER (lower(trim(id)) <> '') AS current_properties, 'baseline' AS status FROM property_snapshot WHERE snapshot_no = 5",
    "d_layout": f"{_LAYOUT} SELECT doc, pages, text_pages, low_text_pages, requires_ocr, table_pages, fingerprint FROM l",
    "d_validated": f"{_LAYOUT}, v AS (SELECT doc, requires_ocr, concat_ws(',', CASE WHEN NOT list_contains(coalesce(tp, []), 1) THEN '1' END, CASE WHEN NOT list_contains(coalesce(tp, []), 2) THEN '2' END) AS missing, pages, text_pages FROM l), w AS (SELECT *, concat_ws(',', CASE WHEN pages > 9 THEN 'too_many_pages' END, CASE WHEN text_pages < 2 THEN 'insufficient_text_pages' END, CASE WHEN missing <> '' THEN 'missing_required_tables' END) AS reasons FROM v) SELECT doc, CASE WHEN requires_ocr THEN 'ocr_required' WHEN reasons = '' THEN 'compatible' ELSE 'incompatible' END AS status, reasons, missing FROM w",
    "d_figures": f"WITH {D._BOX}, one AS (SELECT doc, page, number_id, value FROM rown WHERE place = 0 QUALIFY row_number() OVER (PARTITION BY doc, page ORDER BY in_row DESC, lx0, label_id) = 1) SELECT doc, page, round(o.value * 100, 4) AS value, array_to_string([format('{{:.2f}}', round_even(x, 2)) FOR x IN e.locator.bbox], ',') AS bbox, 0.98::DOUBLE AS confidence, 'pending' AS status FROM one o JOIN source_evidence e ON e.evidence_id = o.number_id",
    "r_summary": "SELECT source_document_id, count(*) AS total, count(*) FILTER (coalesce(review.status, '') NOT IN ('approved', 'rejected', 'not_required')) AS pending, " + ", ".join(f"count(*) FILTER (review.status = '{s}') AS {s}" for s in reviews.DECISIONS) + " FROM source_evidence GROUP BY 1",
    "r_upserted": f"SELECT coalesce(r.evidence_id, a.evidence_id) AS evidence_id, coalesce(r.status, a.status) AS status, CASE WHEN r.status IS NULL THEN ' reader ' ELSE 'reader' END AS reviewed_by, coalesce(r.reviewed_at, a.reviewed_at) AS reviewed_at, CASE WHEN r.status IS NULL THEN '  ' END AS note FROM {_DECIDED('approved')} a FULL JOIN {_DECIDED('rejected')} r USING (evidence_id)",
    "r_cleared": f"SELECT * FROM {_DECIDED('approved')} a WHERE evidence_id NOT IN (SELECT evidence_id FROM {_DECIDED('rejected')})",
    "r_idempotency": "SELECT reit_code AS run_id, sha256(string_agg(concat_ws('|', reit_code, '1.0', coalesce(sha256, ''), coalesce(title, '')), chr(10) ORDER BY document_id, title)) AS idempotency_key FROM source_document WHERE reit_code IS NOT NULL GROUP BY reit_code",
    "r_layout_states": "WITH a AS (SELECT feed_id AS key, max(schema_version) AS f FROM quality_report WHERE load_no = 1 GROUP BY 1), b AS (SELECT feed_id AS key, max(schema_version) AS f FROM quality_report WHERE load_no = 10 GROUP BY 1) SELECT b.key, CASE WHEN a.f IS NULL THEN 'new' WHEN a.f = b.f THEN 'unchanged' ELSE 'changed' END AS state FROM b LEFT JOIN a USING (key) WHERE b.f IS NOT NULL",
    "r_run_totals": "SELECT load_no AS run_id, count(DISTINCT feed_id) AS adapters, CAST(coalesce(sum(totals.properties), 0) AS BIGINT) AS properties, CAST(coalesce(sum(totals.errors), 0) AS BIGINT) AS issues FROM quality_report GROUP BY load_no",
    "s_quality_status": "SELECT status, generated_at, " + ", ".join(f"coalesce(totals.{c}, 0) AS {c}" for c in sanitized.QUALITY_TOTALS) + " FROM quality_report",
    "s_documents": "SELECT publisher, reit_code, title, period, as_of_date, CASE WHEN regexp_matches(url, '^https?://') THEN url ELSE '' END AS url, retrieved_at FROM source_document",
    "u_event_sources": "SELECT publisher, coalesce(title, '') AS document, coalesce(url, '') AS url, arg_max(document_id, struct_pack(r := retrieved_at, d := document_id)) AS document_id FROM source_document GROUP BY 1, 2, 3",
    "u_missing_fragments": "WITH n AS (SELECT DISTINCT source_document_id AS doc, locator.sheet AS name FROM source_evidence WHERE source_document_id IS NOT NULL AND locator.sheet IS NOT NULL) SELECT d.doc, f.fragment FROM (SELECT DISTINCT doc FROM n) d, (VALUES ('NOI'), ('評価'), ('Port')) AS f(fragment) WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc = d.doc AND contains(n.name, f.fragment))",
    "f_pipeline": f"WITH {D._PROP}, q AS (SELECT 35.5 AS lat, 135.0 AS lng), d AS (SELECT p.*, {_HAV} AS km FROM prop p, q WHERE {D._VALID.format(p='p.')}) SELECT id, round(km, 6) AS km FROM d WHERE km <= 50 AND type = 'オフィス' AND contains(coalesce(name, '') || ' ' || coalesce(address, '') || ' ' || coalesce(reit, ''), '県') AND isfinite(cap) AND cap BETWEEN 2 AND 6 AND isfinite(price) AND price <= 90000 AND lat BETWEEN 33 AND 38 AND lng BETWEEN 130 AND 140",
    "g_extent": f"SELECT min(lat) AS south, max(lat) AS north, min(lng) AS west, max(lng) AS east, count(*) AS n FROM (SELECT DISTINCT id, lat, lng FROM property_master) WHERE {D._VALID.format(p='')}",
    "g_destination": f"WITH p AS (SELECT DISTINCT id, lat, lng, radians(lat) AS f FROM property_master WHERE {D._VALID.format(p='')}), a AS (SELECT *, asin(sin(f) * cos(12.5 / 6371) + cos(f) * sin(12.5 / 6371) * cos(radians(45))) AS g FROM p) SELECT id, round(degrees(g), 6) AS lat, round(lng + degrees(atan2(sin(radians(45)) * sin(12.5 / 6371) * cos(f), cos(12.5 / 6371) - sin(f) * sin(g))), 6) AS lng, 12.5::DOUBLE AS km FROM a",
    "j_restored": f"WITH {_SAVED} SELECT id, CAST(row_number() OVER (ORDER BY o, id) AS INT) AS ord FROM s WHERE id IN (SELECT id FROM property_master) ORDER BY o, id LIMIT 50",
    "j_selected": f"WITH {D._PROP}, {_SAVED} SELECT id, name, price FROM prop WHERE id IN (SELECT id FROM s)",
    "t_raw_timeline": f"WITH {D._KEYED} SELECT key, arg_min(coalesce(substr(nullif(as_of_date, ''), 1, 7), nullif(period, ''), '第' || period_no || '期', key), struct_pack(p := pos, i := id)) AS label FROM k GROUP BY key",
    "a_quantiles": f"WITH {D._SERIES} SELECT id, round(quantile_cont(value, 0.1), 9) AS p10, round(quantile_cont(value, 0.9), 9) AS p90, max(value) AS highest FROM series GROUP BY id",
    "t_current": f"SELECT id, key, pos, period_no, cap FROM (SELECT property_id AS id, {D._KEY} AS key, row_id AS pos, period_no, cap FROM property_period WHERE property_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY id ORDER BY key DESC, pos DESC) = 1",
    "t_default_period": "WITH s AS (SELECT id, arg_max(struct_pack(c := cap), row_id).c AS cap FROM property_snapshot WHERE snapshot_no = 5 AND id IS NOT NULL GROUP BY id) SELECT property_id AS id, row_id AS pos, as_of_date, cap FROM property_period WHERE property_id IN (SELECT id FROM s) UNION ALL SELECT id, 0, NULL, cap FROM s WHERE NOT EXISTS (SELECT 1 FROM property_period p WHERE p.property_id = s.id)",
    "t_default_metric": "SELECT property_id AS id, coalesce(" + ", ".join(f"CASE WHEN count(*) FILTER (isfinite({m})) > 0 THEN '{m}' END" for m in timeseries.OFFERED) + ", 'appraisal') AS metric FROM property_period WHERE property_id IS NOT NULL GROUP BY 1",
    "a_axis": "WITH b AS (SELECT reit_code, min(occupancy) FILTER (isfinite(occupancy)) AS a, max(occupancy) FILTER (isfinite(occupancy)) AS z FROM property_period GROUP BY 1), c AS (SELECT *, CASE WHEN z > a THEN (z - a) * 0.1 ELSE 0.1 END AS pad FROM b) SELECT reit_code, round(a - pad, 9) AS low, round(CASE WHEN z IS NULL THEN 100 ELSE least(z + pad, 100) END, 9) AS high FROM c",
    "a_latest_date": "SELECT max(d) AS as_of_date FROM (SELECT as_of_date AS d FROM property_period UNION ALL SELECT as_of_date FROM source_document) WHERE regexp_full_match(d, '[0-9]{4}-[0-9]{2}-[0-9]{2}')",
    "j_evidence_fallback": "WITH o AS (SELECT property_id AS id, arg_max(struct_pack(d := source_document_id), evidence_id) AS o FROM source_evidence WHERE field = 'cap' AND property_id IS NOT NULL GROUP BY 1), h AS (SELECT property_id AS id, observed_at AS at, arg_max(struct_pack(d := source_document_id), evidence_id) AS h FROM source_evidence WHERE field = 'cap' AND property_id IS NOT NULL AND observed_at IS NOT NULL GROUP BY 1, 2) SELECT row_id AS pos, CASE WHEN h IS NOT NULL THEN h.d ELSE o.d END AS source_document_id FROM property_period p LEFT JOIN h ON h.id = p.property_id AND h.at = p.as_of_date LEFT JOIN o ON o.id = p.property_id",
    "x_scalars": f"""SELECT id, loaded_at, round_even(price / 1e6, 3) AS million, round_even({_FN('cap')} * 100, 3) AS percent, CASE WHEN noi <> 0 THEN noi END AS noi, noi / 1000 AS thousand, CASE WHEN isfinite(cap) AND cap >= 0 THEN least(50.0, greatest(0.5, cap)) ELSE 3.0 END AS radius, 'doc-' || substr(sha256(id), 1, 20) AS document, round_even(price / 25, 0) * 25 AS bucket,
      CASE WHEN source LIKE 'http' OR source LIKE 'https' THEN source || '://x' END AS url, '&lt;' || replace(replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '"', '&quot;'), '''', '&#39;') || '&amp;&#39;&quot;' AS html, coalesce(format('{{:,.2f}}', {_FN('leasable_area')}) || ' m2', '—') AS shown, regexp_replace(lower(regexp_replace(translate(name, '{D._WIDE}', '{D._NARROW}'), '[\\s　]', '', 'g')), '[・･]', '', 'g') AS canonical,
      CASE WHEN starts_with(address, '翠陵県') OR starts_with(address, '灯台県') THEN 'east' WHEN starts_with(address, '琴浜県') THEN 'west' ELSE 'other' END AS region, CASE WHEN type = 'オフィス' THEN terminal_cap_rate ELSE cap END AS rate, CASE WHEN length(id) > 8 THEN 'average' ELSE 'individual' END AS mode, CASE WHEN isfinite(cap) THEN CAST(floor(greatest(0.0, least(1.0, (cap - 1) / 6)) * 4 + 0.5) AS INT) END AS ix FROM property_master""",
    "x_map_values": "WITH i AS (SELECT property_id, field, arg_max(struct_pack(c := metric_code, p := locator.page), evidence_id) AS e FROM source_evidence WHERE property_id IS NOT NULL AND field IS NOT NULL GROUP BY 1, 2) SELECT property_id, coalesce(max(e.c) FILTER (field = 'cap'), 'none') AS cap, CAST(count(*) AS INT) AS n, arg_min(e.p, field) FILTER (e.p <> 0) AS page FROM i GROUP BY property_id",
    "n_office_periods": f"WITH {_BOOK} SELECT * FROM n",
    "n_office_issues": f"WITH {_BOOK}, i AS (SELECT doc, 'cap' AS field FROM n WHERE NOT (cap > 0 AND cap < 20) UNION ALL SELECT doc, 'occupancy' FROM n WHERE occupancy NOT BETWEEN 0 AND 100) SELECT doc, field, count(*) AS n FROM i GROUP BY doc, field",
    "n_reconciled": f"WITH {_BOOK}, z AS (SELECT *, max(row) OVER (PARTITION BY doc) AS z FROM n), s AS (" + " UNION ALL ".join(f"SELECT doc, '{c}' AS field, {t} AS tolerance, sum({c}) FILTER (row < z) AS source, round_even(sum(coalesce({c}, 0)), 3) AS normalized FROM z GROUP BY doc" for c, t in issuers.TOLERANCES.items()) + ") SELECT doc, field, CASE WHEN abs(round_even(normalized - source, 3)) <= tolerance THEN 'ok' ELSE 'review' END AS state, round(source, 3) AS source, round(normalized, 3) AS normalized, round(normalized - source, 3) AS difference FROM s",
}

"""Queries of the disclosure operators over the property tables, each with its SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from plotwise.functions import scalars as S
from plotwise.functions.scalars import METRICS
from plotwise.operators import cells, changes, evidence, matching, pages, quality, search, similarity, timeseries
from plotwise.session import broadcast_if_small, materialize, scratch_dir
from plotwise.sources.tables import table
from plotwise.streaming import half_year

M = list(METRICS)


def properties(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """property_master with the latest import of each id; only the columns asked for are read, all without any."""
    pm = table(spark, sf, "property_master")
    rest = [c for c in (columns or pm.columns) if c != "id"]
    return pm.groupBy("id").agg(F.max_by(F.struct(*rest), "loaded_at").alias("v")).select("id", "v.*")


def positions(spark: SparkSession, sf: str) -> DataFrame:
    """(id, lat, lng), which never differ within an id: rows are filtered before repeated ones are put together, down to the scan."""
    return table(spark, sf, "property_master").select("id", "lat", "lng")


def periods(spark: SparkSession, sf: str) -> DataFrame:
    """property_period as periods of a property, in the order of their rows."""
    return table(spark, sf, "property_period").withColumnsRenamed({"property_id": "id", "row_id": "pos"})


_PROP = "prop AS (SELECT * FROM property_master QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1)"
_KEY = "coalesce(nullif(as_of_date, ''), 'period-' || lpad(CAST(period_no AS VARCHAR), 6, '0'), 'index-' || lpad(CAST(row_id AS VARCHAR), 6, '0'))"
_FIN = lambda c: f"CASE WHEN isfinite({c}) THEN {c} END"


def _bucket(k: str) -> str:
    return f"CASE WHEN regexp_matches({k}, '^[0-9]{{4}}-(0[1-9]|1[0-2])') THEN substr({k}, 1, 4) || CASE WHEN substr({k}, 6, 2) <= '06' THEN '-H1' ELSE '-H2' END ELSE {k} END"


_KEYED = f"k AS (SELECT property_id AS id, row_id AS pos, {_KEY} AS key, as_of_date, period, period_no, {_FIN('cap')} AS value FROM property_period WHERE property_id IS NOT NULL), kb AS (SELECT *, {_bucket('key')} AS bucket FROM k)"
_SERIES = f"{_KEYED}, series AS (SELECT id, bucket, value FROM kb WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, bucket ORDER BY key DESC, pos DESC) = 1)"
_HAV = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lng - {a}lng) / 2), 2))))"
_VALID = "({p}lat BETWEEN -90 AND 90 AND {p}lng BETWEEN -180 AND 180 AND NOT isnan({p}lat) AND NOT isnan({p}lng) AND NOT ({p}lat = 0 AND {p}lng = 0))"


# --- search ---------------------------------------------------------------------------------------------------------------


def s_facets(spark, sf):
    """Distinct values of the filter columns."""
    return search.facets(table(spark, sf, "property_master"), "reit_code", "type", "region")


def f_search_text(spark, sf):
    """Free text over name, address and issuer."""
    return search.contains_text(properties(spark, sf, "name", "address", "reit"), " ミヅキ ").select("id", "name")


def f_equality(spark, sf):
    """Equality filters; an empty value filters nothing."""
    return search.equals(properties(spark, sf, "type", "reit_code", "region"), type="物流", reit_code="", region=None).select("id", "type")


def f_ranges(spark, sf):
    """Combined numeric ranges."""
    df = properties(spark, sf, "cap", "terminal_cap_rate", "occupancy", "price", "leasable_area")
    for field, low, high in (("cap", 3.0, 4.5), ("terminal_cap_rate", None, 5.0), ("occupancy", 90.0, None), ("price", 1000.0, 60000.0), ("leasable_area", None, None)):
        df = search.in_range(df, field, low, high)
    return df.select("id", "cap", "occupancy", "price")


def f_bounds(spark, sf):
    """Bounding box."""
    return search.in_bounds(positions(spark, sf), 33.0, 38.0, 130.0, 140.0).distinct()


def f_radius(spark, sf):
    """Radius search with the distance."""
    return search.within_radius(positions(spark, sf), 36.2, 134.4, 50.0).select("id", F.round("km", 6).alias("km")).distinct()


def o_sort_nulls_last(spark, sf):
    """Place of each property by price, greatest first, nulls last, then by name and id."""
    rows = properties(spark, sf, "name", "price")
    return search.ranked(rows, *search.sort_order("price", True, "name", "id")).select("id", "price", "rank")


def o_bounded_selection(spark, sf):
    """A selection of ten ids, extended to 50 by a bounding box."""
    p = positions(spark, sf).distinct()
    number = F.regexp_extract("id", "([0-9]+)$", 1).cast("bigint")
    kept = p.orderBy(F.desc("id")).limit(10).select("id", number.alias("ord"))
    return search.bounded_selection(kept, search.in_bounds(p, 33.0, 38.0, 130.0, 140.0).select("id", number.alias("ord")), 50)


def k_csv_lines(spark, sf):
    """Quoted CSV lines."""
    columns = ["id", "name", "reit", "region", "tenants", "source"]
    return search.csv_lines(properties(spark, sf, *columns), columns)


def x_bands(spark, sf):
    """Properties by yield band."""
    return properties(spark, sf, "cap").groupBy(S.band(F.col("cap")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def m_comparables(spark, sf):
    """The five most comparable properties of every property whose number is divisible by 50, against all."""
    p = materialize(properties(spark, sf, "type", "lat", "lng", "leasable_area", "price", "cap", "terminal_cap_rate", "occupancy"))
    q = p.where(F.regexp_extract("id", "([0-9]+)$", 1).cast("bigint") % 50 == 0)
    return similarity.comparables(q, p)


# --- time series ----------------------------------------------------------------------------------------------------------


def _keyed(spark, sf, metric="cap"):
    return timeseries.keyed(periods(spark, sf), metric)


def t_raw_series(spark, sf):
    """Raw series of cap, the last of equal keys."""
    return timeseries.raw_series(_keyed(spark, sf))


def t_half_year_series(spark, sf):
    """Latest cap of each property and half-year."""
    return timeseries.half_year_series(_keyed(spark, sf))


def t_timeline(spark, sf):
    """The half-year timeline."""
    return timeseries.timeline(_keyed(spark, sf), "bucket")


def _places(keyed):
    """Every key of the half-year timeline with its place ix in it, from 0."""
    keys = timeseries.timeline(keyed, "bucket").select(F.col("key").alias("bucket"))
    places = materialize(search.ranked(keys, F.col("bucket")).select("bucket", (F.col("rank") - 1).cast("int").alias("ix")))
    return broadcast_if_small(places, F.lit(32) + F.octet_length("bucket"))


def t_grid(spark, sf):
    """Every property with a value at every key of the half-year timeline, undated periods under their own keys, nulls included."""
    k = _keyed(spark, sf)
    return timeseries.dense(timeseries.half_year_series(k), _places(k)).select("id", "bucket", "value")


def _placed(spark, sf):
    k = _keyed(spark, sf)
    return timeseries.half_year_series(k).join(_places(k), "bucket")


def t_segments(spark, sf):
    """Runs of consecutive places of the timeline with values."""
    return timeseries.segments(_placed(spark, sf), "value")


def t_gap_edges(spark, sf):
    """Places of the timeline on both sides of gaps."""
    return timeseries.gap_edges(_placed(spark, sf))


def t_band_segments(spark, sf):
    """Runs of consecutive places of the timeline at which an issuer has quartiles."""
    k = _keyed(spark, sf)
    rows = timeseries.half_year_series(k)
    q = timeseries.quartiles(rows.select(F.substring("id", 1, 3).alias("id"), "bucket", "value"), ["id", "bucket"]).where("n >= 3").join(_places(k), "bucket")
    return timeseries.segments(q.withColumn("low", F.least("q1", "q3")).withColumn("high", F.greatest("q1", "q3")), "low", "high")


def a_distribution(spark, sf):
    """Average and quartiles of cap by half-year, masked below the least sample size."""
    rows = materialize(timeseries.half_year_series(_keyed(spark, sf)))
    least = timeseries.least_samples(rows.select("id").distinct().count())
    return timeseries.distribution(rows, least).withColumns({c: F.round(c, 9) for c in ("average", "q1", "median", "q3")})


def t_latest_snapshot(spark, sf):
    """The last key of the timeline with a median, and the coverage there in percent."""
    rows = materialize(timeseries.half_year_series(_keyed(spark, sf)))
    n = rows.select("id").distinct().count()
    d = timeseries.distribution(rows, timeseries.least_samples(n)).where("median is not null").orderBy(F.desc("key")).limit(1)
    return d.select("key", "n", F.round("median", 9).alias("median"), F.floor(F.col("n") / max(n, 1) * 100 + 0.5).cast("int").alias("coverage"))


def t_summary(spark, sf):
    """First, latest, change and number of cap values."""
    return timeseries.summary(_keyed(spark, sf))


def t_prior_delta(spark, sf):
    """Change from the value before the last."""
    return timeseries.prior_delta(_keyed(spark, sf))


def p_spread(spark, sf):
    """Terminal less going-in rate on the latest period with either; the property's own rates where that lacks one."""
    return timeseries.latest_either(periods(spark, sf), "cap", "terminal_cap_rate", properties(spark, sf, "cap", "terminal_cap_rate"))


def t_recent(spark, sf):
    """Rows of the last ten periods of each property."""
    return timeseries.recent(periods(spark, sf), 10).select("id", "pos", "period_no")


def t_stream_half_year(spark, sf):
    """The half-year series by a stream over the period files."""
    path = f"{sf}/property_period.parquet"
    whole = os.path.isdir(path)
    out = f"{scratch_dir(spark)}/plotwise-half-year-{os.urandom(6).hex()}"
    return half_year.run_available(spark, path if whole else sf, spark.read.parquet(path).schema, "cap", out, "*.parquet" if whole else "property_period.parquet")


# --- quality --------------------------------------------------------------------------------------------------------------


def q_duplicates(spark, sf):
    """Ids imported more than once."""
    return quality.duplicate_ids(table(spark, sf, "property_master"))


def q_required(spark, sf):
    """Rows without required fields."""
    pm = table(spark, sf, "property_master")
    return quality.missing_fields(pm, (*quality.REQUIRED, "region")).groupBy("missing").agg(F.count(F.lit(1)).alias("n"))


def q_ranges(spark, sf):
    """Metrics out of range, by field, over properties and periods."""
    p = quality.long_metrics(properties(spark, sf, *M), "id")
    h = quality.long_metrics(periods(spark, sf), "id")
    return quality.out_of_range(p.unionByName(h)).groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("properties"))


def q_coordinates(spark, sf):
    """Missing, invalid and valid coordinates."""
    return properties(spark, sf, "lat", "lng").groupBy(quality.coordinate_state(F.col("lat"), F.col("lng")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


def q_area(spark, sf):
    """Leased area beyond 99 % of the leasable area."""
    return quality.area_exceeded(periods(spark, sf), "pos", 0.99)


def q_area_rule(spark, sf):
    """Leased area beyond the slack that the gate allows."""
    return quality.area_exceeded(periods(spark, sf), "pos")


def q_evidence(spark, sf):
    """Complete and consistent evidence by field: code, unit and recorded value; consistency only of complete evidence."""
    e = quality.with_recorded(table(spark, sf, "source_evidence"), table(spark, sf, "property_master"), periods(spark, sf))
    same = quality.evidence_consistent(F.col("field"), F.col("metric_code"), F.col("unit")) & quality.value_consistent(F.col("value"), F.col("recorded"))
    e = e.select(F.coalesce("field", F.lit("")).alias("field"), quality.evidence_complete(e).alias("ok"), same.alias("same"))
    return e.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("complete"), F.count_if(F.col("ok") & ~F.col("same")).alias("inconsistent"), S.percent(F.count_if("ok"), F.count(F.lit(1))).alias("coverage"))


def q_by_metric(spark, sf):
    """Availability of each metric."""
    return quality.by_metric(quality.long_metrics(properties(spark, sf, *M), "id"))


def q_by_group(spark, sf):
    """Totals by issuer."""
    return quality.by_group(properties(spark, sf, "reit_code", "lat", "lng", *M))


def q_first_issues(spark, sf):
    """The first twenty values out of range of each metric."""
    bad = quality.out_of_range(quality.long_metrics(periods(spark, sf), "pos"))
    return quality.first_issues(bad, ["pos"]).select("pos", "field", "value")


# --- changes --------------------------------------------------------------------------------------------------------------


def _sides(spark, sf):
    """Two datasets: the first nine loads and the last nine of each feed, one row for each property and period."""
    pp = table(spark, sf, "property_period").withColumn("as_of_date", F.coalesce("as_of_date", F.lit("undated")))
    rows = lambda p: changes.last_wins(p.drop("feed_id", "loaded_at"), ["property_id", "period_no"], "row_id")
    return rows(pp.where("load_no <= 9")), rows(pp.where("load_no >= 2"))


def c_entities(spark, sf):
    """Properties added and removed between the first and the last delivery."""
    ps = table(spark, sf, "property_snapshot")
    ids = lambda n: ps.where(F.col("snapshot_no") == n).select(F.lower(F.trim("id")).alias("id")).distinct()
    return changes.diff_rows(ids(1), ids(5), ["id"]).where("change <> 'shared'")


def c_periods(spark, sf):
    """Periods added, removed and shared, by property."""
    d = changes.diff_rows(*_sides(spark, sf), ["property_id", "period_no"])
    return d.groupBy("property_id", "change").agg(F.count(F.lit(1)).alias("n"))


def c_metrics(spark, sf):
    """Metric values that differ in shared periods."""
    d = changes.diff_metrics(*_sides(spark, sf), ["property_id", "period_no"])
    return d.withColumns({c: F.round(c, 6) for c in ("before", "after", "delta")})


def c_by_metric(spark, sf):
    """Changes by metric, every metric listed."""
    d = changes.diff_metrics(*_sides(spark, sf), ["property_id", "period_no"]).groupBy("field").agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed")))
    every = spark.createDataFrame([(m,) for m in M], "field string")
    return every.join(d, "field", "left").fillna(0)


def c_master(spark, sf):
    """Master fields that differ between the first and the last import of an id."""
    pm = table(spark, sf, "property_master")
    both = pm.groupBy("id").agg(F.min("loaded_at").alias("a"), F.max("loaded_at").alias("b")).where("a < b")
    one = lambda c: pm.join(both.select("id", F.col(c).alias("loaded_at")), ["id", "loaded_at"])
    d = changes.diff_fields(one("a"), one("b"), ["id"], [c for c in changes.MASTER if c not in ("lat", "lng")])
    return d.select("id", "field", "before", "after")


def c_fingerprint(spark, sf):
    """Row count and content digest of properties, their periods and evidence, master fields and all metrics; the same in any order of rows.

    What says when or by which run something was read (row numbers, loads, times, sources) takes no part.
    """
    evidence_at = ("type", "page", "sheet", "cell", "cell_range")
    return changes.dataset_fingerprint({
        "property": table(spark, sf, "property_master").select("id", *changes.MASTER, *M),
        "period": table(spark, sf, "property_period").select("property_id", "reit", "reit_code", "type", "period_no", "period", "as_of_date", *M),
        "evidence": table(spark, sf, "source_evidence").select("property_id", "field", "observed_at", "metric_code", "value", "unit", "source_document_id", *(F.col(f"locator.{c}").alias(c) for c in evidence_at)),
    })


# --- evidence and audit -----------------------------------------------------------------------------------------------------


def e_build(spark, sf):
    """Evidence maps of properties with a reference for each of three metrics, as flat rows."""
    p = properties(spark, sf, "name", "price", "cap", "noi").select("id", "price", "cap", "noi", *(F.concat(F.lit(f"Sheet!1!{c}"), F.length("name").cast("string")).alias(f"ref_{m}") for m, c in (("price", "A"), ("cap", "B"), ("noi", "C"))))
    e = evidence.build(p, {m: f"ref_{m}" for m in ("price", "cap", "noi")}, "id")
    return e.select("id", F.explode("evidence").alias("field", "e")).select("id", "field", "e.metric_code", "e.sheet", "e.cell")


def a_review_summary(spark, sf):
    """Evidence by review status."""
    return evidence.status_counts(table(spark, sf, "source_evidence").select(F.col("review.status").alias("s")), "s")


def j_latest_review(spark, sf):
    """Evidence items with the status of the last review of the same value."""
    e = table(spark, sf, "source_evidence").where("property_id is not null and field is not null and observed_at is not null")
    key = F.concat_ws("|", "property_id", "field", "observed_at")
    ledger = e.where("review.status is not null").select(key.alias("k"), F.col("evidence_id").alias("o"), F.col("review.status").alias("status"))
    return evidence.with_reviews(e.select("evidence_id", key.alias("k")), ledger, "k", "o").select("evidence_id", "status")


def j_unmatched_snapshots(spark, sf):
    """Rows of deliveries whose id, as written, isn't that of a property."""
    return evidence.unmatched(table(spark, sf, "property_snapshot"), table(spark, sf, "property_master"), "id", "id").select("row_id", "id")


def a_catalog(spark, sf):
    """Documents and evidence items by issuer."""
    return evidence.catalog(table(spark, sf, "source_document"), table(spark, sf, "source_evidence"), "reit_code")


def a_layout(spark, sf):
    """Extent of each sheet of each document, and its cells with a value."""
    e = table(spark, sf, "source_evidence").select("source_document_id", "locator.sheet", "locator.cell", "value").where("source_document_id is not null and sheet is not null")
    return evidence.sheet_layout(e, "source_document_id", "sheet")


def p_layout_status(spark, sf):
    """Each feed's status over its loads' schema versions against the load before."""
    from pyspark.sql import Window

    w = Window.partitionBy("feed_id").orderBy("load_no")
    q = table(spark, sf, "quality_report").withColumn("p", F.lag("schema_version").over(w))
    state = F.when(F.col("p").isNull(), F.lit("new")).when(F.col("p") == F.col("schema_version"), F.lit("unchanged")).otherwise(F.lit("changed"))
    return evidence.reduced_status(q.select("feed_id", state.alias("s")), "s", "feed_id")


def a_recon(spark, sf):
    """Reported against counted properties of each load, to a tolerance of two."""
    pp = table(spark, sf, "property_period").where("feed_id is not null").groupBy("feed_id", "load_no").agg(F.count_distinct("property_id").alias("counted"))
    q = table(spark, sf, "quality_report").select("feed_id", "load_no", F.col("totals.properties").alias("reported"))
    diff = F.col("counted") - F.col("reported")
    return q.join(pp, ["feed_id", "load_no"], "left").select("feed_id", "load_no", "reported", "counted", diff.alias("difference"), F.when(F.abs(diff) <= 2, F.lit("ok")).otherwise(F.lit("review")).alias("state"))


def a_history_hist(spark, sf):
    """How many properties have 1, 2, ... period rows, up to the most that any has."""
    return evidence.history_histogram(table(spark, sf, "property_period"), "property_id")


def j_previous_run(spark, sf):
    """The newest earlier passed run with the same inputs."""
    q = table(spark, sf, "quality_report").select(F.col("import_run_id").alias("run_id"), F.concat_ws("|", "feed_id", "schema_version").alias("idempotency_key"), F.when(F.col("status") == "passed", F.lit("succeeded")).otherwise(F.col("status")).alias("status"))
    return evidence.previous_run(q)


def u_union_sources(spark, sf):
    """Properties and snapshots as one bag of (kind, id, cap)."""
    a = table(spark, sf, "property_master").select(F.lit("master").alias("kind"), "id", "cap")
    return a.unionByName(table(spark, sf, "property_snapshot").select(F.lit("snapshot").alias("kind"), "id", "appraisal_unit", "cap"), allowMissingColumns=True)


# --- scalars --------------------------------------------------------------------------------------------------------------


def x_clean_name(spark, sf):
    """Clean names and stable ids."""
    n = S.clean_name(F.concat("name", F.when(F.length("name") % 2 == 0, F.lit("　 *12 ")).otherwise(F.lit("　"))))
    return table(spark, sf, "property_master").where("name is not null").select("id", n.alias("name"), S.stable_id("P", n).alias("stable_id")).distinct()


def x_labelled_number(spark, sf):
    """The number after a label in each document."""
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", S.labelled_number(F.col("text"), "稼働率").alias("value"), S.labelled_number(F.col("text"), "in period").alias("period"))


def x_numeric_text(spark, sf):
    """The numbers that addresses and written dates begin with."""
    a = table(spark, sf, "property_master").select("id", S.numeric_text(F.col("address")).alias("value"))
    return a.unionByName(table(spark, sf, "property_period").select(F.col("row_id").cast("string").alias("id"), S.numeric_text(F.col("as_of_date")).alias("value")))


def x_evidence_id(spark, sf):
    """Evidence ids and the text of their places."""
    e = table(spark, sf, "source_evidence")
    parts = (F.col(c) for c in ("property_id", "field", "observed_at", "source_document_id", "locator.sheet", "locator.cell"))
    return e.select("evidence_id", S.evidence_id(*parts).alias("ev"), S.position_text(F.col("locator")).alias("position"))


def x_period_key(spark, sf):
    """Keys, labels and half-years of periods."""
    key = S.period_key(F.col("as_of_date"), F.col("period_no"), F.col("pos"))
    return periods(spark, sf).select("pos", key.alias("key"), S.half_year(key).alias("bucket"), S.half_year_label(S.half_year(key)).alias("bucket_label"), S.period_label(F.col("as_of_date"), F.col("period"), F.col("period_no"), key).alias("label"), S.period_end(F.col("period_no")).alias("closing"))


# --- cells and names ------------------------------------------------------------------------------------------------------


def _cells(spark, sf):
    e = table(spark, sf, "source_evidence").where("source_document_id is not null and locator.sheet is not null")
    ref = F.col("locator.cell")
    return e.where(ref.rlike(r"\A[A-Z]{1,3}[0-9]+\z")).select(F.col("source_document_id").alias("doc"), "locator.sheet", F.regexp_extract(ref, "[A-Z]+", 0).alias("col"), F.regexp_extract(ref, "[0-9]+", 0).cast("int").alias("row"), F.col("field").alias("value"), "evidence_id")


def words(spark, sf):
    """Evidence with a box as words of pages: prices, cap rates and NOIs are labels, the others are their values."""
    e = table(spark, sf, "source_evidence").where("source_document_id is not null and locator.page is not null and size(locator.bbox) = 4")
    b, label = F.col("locator.bbox"), F.col("field").isin("cap", "noi", "price")
    text = F.when(label, F.col("field")).otherwise(F.col("value").cast("decimal(20,2)").cast("string"))
    return e.select(F.col("source_document_id").alias("doc"), "locator.page", F.col("evidence_id").alias("word_id"), text.alias("text"), b[0].alias("x0"), b[1].alias("top"), b[2].alias("x1"), b[3].alias("bottom"))


def p_find_row(spark, sf):
    """The first row, up to the 200th, of each sheet that has a cap rate."""
    return cells.find_row(_cells(spark, sf), ["doc", "sheet"], F.col("value") == "cap", 200)


def p_header_map(spark, sf):
    """The columns of the fields in the first row of each sheet."""
    c = _cells(spark, sf)
    return cells.header_map(c, ["doc", "sheet"], cells.find_row(c, ["doc", "sheet"], F.lit(True), 1 << 30))


def p_wide_to_long(spark, sf):
    """Rates of periods, wide to long, rows without any value left out; NaN is a value."""
    return cells.wide_to_long(periods(spark, sf), ["pos"], {"direct": {"rate": "cap", "amount": "appraisal"}, "discounted": {"rate": "discount_rate", "amount": "book_value"}}, "method")


def j_same_row(spark, sf):
    """The numbers right of each label (cap, noi) in its row of a page, in their order."""
    return pages.row_numbers(words(spark, sf), ["cap", "noi"]).select("doc", "page", "label_id", "number_id", "value", "place", "in_row")


def j_row_value(spark, sf):
    """The first number of the richest row of a label on each page."""
    return pages.row_value(words(spark, sf), ["cap", "noi"], 0)


def j_nearest_number(spark, sf):
    """The number of the label (cap, noi) nearest to a price on each page."""
    return pages.near_value(words(spark, sf), "price", ["cap", "noi"])


def u_missing_required(spark, sf):
    """Fields that a document with sheets has no cell for."""
    c = _cells(spark, sf)
    required = c.select("doc").distinct().select("doc", F.explode(F.array(*map(F.lit, M))).alias("value"))
    return cells.missing_names(required, c, ["doc"], "value")


def c_layout_fingerprint(spark, sf):
    """A digest of the sheets of each document."""
    return cells.layout_fingerprint(a_layout(spark, sf), ["source_document_id"], ["sheet", "max_row", "max_column", "non_empty_cells"])


def j_name_match(spark, sf):
    """Names of delivered properties that contain a property's name, or are contained in one."""
    return matching.contained_names(table(spark, sf, "property_master"), table(spark, sf, "property_snapshot"))


QUERIES = {f.__name__: f for f in (
    s_facets, f_search_text, f_equality, f_ranges, f_bounds, f_radius, o_sort_nulls_last, o_bounded_selection, k_csv_lines, x_bands, m_comparables, t_raw_series, t_half_year_series, t_timeline, t_grid, t_segments, t_gap_edges,
    t_band_segments, a_distribution, t_latest_snapshot, t_summary, t_prior_delta, p_spread, t_recent, t_stream_half_year, q_duplicates, q_required, q_ranges, q_coordinates, q_area, q_area_rule, q_evidence, q_by_metric, q_by_group, q_first_issues,
    c_entities, c_periods, c_metrics, c_by_metric, c_master, c_fingerprint, e_build, a_review_summary, j_latest_review, j_unmatched_snapshots, a_catalog, a_layout, p_layout_status, a_recon, a_history_hist, j_previous_run, u_union_sources,
    x_clean_name, x_labelled_number, x_numeric_text, x_evidence_id, x_period_key,
    p_find_row, p_header_map, p_wide_to_long, j_same_row, j_row_value, j_nearest_number, u_missing_required, c_layout_fingerprint, j_name_match,
)}

_HY = "regexp_matches(bucket, '^[0-9]{4}-H[12]$')"
_TIMELINE = "tl AS (SELECT bucket, CAST(row_number() OVER (ORDER BY bucket) - 1 AS INT) AS ix FROM (SELECT DISTINCT bucket FROM kb))"
_GRIDSQL = f"{_SERIES}, {_TIMELINE}, g AS (SELECT i.id, b.bucket, s.value, b.ix FROM (SELECT DISTINCT id FROM series) i CROSS JOIN tl b LEFT JOIN series s ON s.id = i.id AND s.bucket = b.bucket)"
_SEG = "(SELECT id, ix, ix - row_number() OVER (PARTITION BY id ORDER BY ix) AS island FROM {src})"
_DIST = "SELECT bucket AS key, count(*) AS n, avg(value) AS a, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM {src} GROUP BY bucket"
_LEAST = "(SELECT CASE WHEN count(DISTINCT id) <= 8 THEN 1 ELSE greatest(3, CAST(ceil(count(DISTINCT id) / 10.0) AS INT)) END FROM {src})"
_LONGSQL = lambda src, key: " UNION ALL ".join(f"SELECT {key}, '{m}' AS field, CAST({m} AS DOUBLE) AS value FROM {src}" for m in M)


def _outside() -> str:
    out = []
    for f, (low, included, high) in quality.RANGES.items():
        out.append(f"(field = '{f}' AND (value {'<' if included else '<='} {low}" + (f" OR isnan(value) OR value > {high}" if high is not None else "") + "))")
    return "(" + " OR ".join(out) + ")"


_SIDE = "SELECT * FROM property_period WHERE {w} AND property_id IS NOT NULL AND property_id <> '' AND period_no IS NOT NULL QUALIFY row_number() OVER (PARTITION BY property_id, period_no ORDER BY row_id DESC) = 1"
_SIDES = f"a AS ({_SIDE.format(w='load_no <= 9')}), b AS ({_SIDE.format(w='load_no >= 2')})"
_NUM = lambda c: f"CASE WHEN NOT isnan({c}) THEN {c} END"
_DIFFSQL = f"{_SIDES}, d AS (" + " UNION ALL ".join(f"SELECT property_id, period_no, '{m}' AS field, {_NUM('a.' + m)} AS before, {_NUM('b.' + m)} AS after FROM a JOIN b USING (property_id, period_no)" for m in M) + "), dd AS (SELECT *, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' ELSE 'changed' END AS change FROM d WHERE before IS DISTINCT FROM after)"
_NB = lambda c: f"coalesce({c}, '') <> ''"
_COMPLETE = f"coalesce((coalesce(locator.page <> 0, false) OR ({_NB('locator.sheet')} AND ({_NB('locator.cell')} OR {_NB('locator.cell_range')}))) AND " + " AND ".join(_NB(c) for c in ("source_document_id", "retrieved_at", "metric_code", "unit", "extraction.parser", "extraction.parser_version")) + ", false)"
_SAME = "coalesce((CASE field " + " ".join(f"WHEN '{f}' THEN metric_code = '{c}' AND unit = '{u}'" for f, (c, u) in METRICS.items()) + " END), false)"
_PICK = "CASE e.field " + " ".join(f"WHEN '{m}' THEN r.{m}" for m in M) + " END"
_HIT = f"count({_PICK}) AS given, bool_or(coalesce(abs({_PICK} - e.value) <= 1e-9 AND NOT isnan(e.value) OR (isnan({_PICK}) AND isnan(e.value)), false)) AS hit"
_RECORDED = f"WITH s AS (SELECT evidence_id, {_HIT} FROM source_evidence e JOIN property_master r ON r.id = e.property_id GROUP BY evidence_id), h AS (SELECT evidence_id, {_HIT} FROM source_evidence e JOIN property_period r ON r.property_id = e.property_id AND r.as_of_date = e.observed_at GROUP BY evidence_id)"
# Names hold no compatibility forms but wide Latin and digits and the ideographic space.
_WIDE, _NARROW = ("".join(chr(c + off) for c in range(0x21, 0x7F) if chr(c) != "'") for off in (0xFEE0, 0))
_EVENT_NAME = f"regexp_replace(regexp_replace(translate(coalesce(name, ''), '{_WIDE}', '{_NARROW}'), '[\\s　]', '', 'g'), '[(（]追加取得[)）]', '', 'g')"
_PCT = lambda a, b: f"CASE WHEN {b} = 0 THEN 100.0 ELSE round_even({a} / {b} * 100, 1) END"
_SCALED = lambda f, s, w: f"CASE WHEN q.{f} IS NULL OR p.{f} IS NULL THEN {w / 2} ELSE least(abs(q.{f} - p.{f}) / {s}, 1.0) * {w} END"
_RATIO = lambda f, w: f"coalesce(CASE WHEN q.{f} > 0 AND p.{f} > 0 THEN least(abs(ln(q.{f} / p.{f})) / ln(4.0), 1.0) * {w} END, {w / 2})"

_CELLS = "c AS (SELECT source_document_id AS doc, locator.sheet AS sheet, regexp_extract(locator.cell, '[A-Z]+') AS col, CAST(regexp_extract(locator.cell, '[0-9]+') AS INT) AS row, field AS value FROM source_evidence WHERE source_document_id IS NOT NULL AND locator.sheet IS NOT NULL AND regexp_full_match(locator.cell, '[A-Z]{1,3}[0-9]+'))"
_LAYOUT = "WITH c AS (SELECT source_document_id, locator.sheet AS sheet, locator.cell AS cell, value FROM source_evidence WHERE source_document_id IS NOT NULL AND locator.sheet IS NOT NULL AND regexp_full_match(locator.cell, '[A-Z]{1,3}[0-9]+')), x AS (SELECT *, CAST(regexp_extract(cell, '[0-9]+') AS INT) AS r, list_reduce([CAST(0 AS INT)] || [ascii(z) - 64 FOR z IN string_split(regexp_extract(cell, '[A-Z]+'), '')], lambda n, v: n * 26 + v) AS q FROM c) SELECT source_document_id, sheet, max(r) AS max_row, max(q) AS max_column, count(DISTINCT cell) FILTER (value IS NOT NULL) AS non_empty_cells FROM x GROUP BY ALL"
_BOX = """w AS (SELECT source_document_id AS doc, locator.page AS page, evidence_id AS id, field, CASE WHEN field NOT IN ('cap', 'noi', 'price') OR field IS NULL THEN CAST(CAST(value AS DECIMAL(20,2)) AS DOUBLE) END AS value, locator.bbox[1] AS x0, locator.bbox[3] AS x1, (locator.bbox[1] + locator.bbox[3]) / 2 AS cx, (locator.bbox[2] + locator.bbox[4]) / 2 AS cy
    FROM source_evidence WHERE source_document_id IS NOT NULL AND locator.page IS NOT NULL AND len(locator.bbox) = 4), lab AS (SELECT * FROM w WHERE field IN ('cap', 'noi')), num AS (SELECT * FROM w WHERE value IS NOT NULL),
  rown AS (SELECT l.doc, l.page, l.id AS label_id, l.x0 AS lx0, n.id AS number_id, n.value, CAST(row_number() OVER (PARTITION BY l.doc, l.page, l.id ORDER BY n.x0, n.id) - 1 AS INT) AS place, count(*) OVER (PARTITION BY l.doc, l.page, l.id) AS in_row FROM lab l JOIN num n ON l.doc = n.doc AND l.page = n.page AND abs(n.cy - l.cy) <= 5.5 AND n.x0 > l.x1)"""

SQL = {
    "s_facets": " UNION ".join(f"SELECT '{c}' AS facet, {c} AS value FROM property_master WHERE coalesce({c}, '') <> ''" for c in ("reit_code", "type", "region")),
    "f_search_text": f"WITH {_PROP} SELECT id, name FROM prop WHERE contains(lower(coalesce(name, '') || ' ' || coalesce(address, '') || ' ' || coalesce(reit, '')), 'ミヅキ')",
    "f_equality": f"WITH {_PROP} SELECT id, type FROM prop WHERE type = '物流'",
    "f_ranges": f"WITH {_PROP} SELECT id, cap, occupancy, price FROM prop WHERE isfinite(cap) AND cap BETWEEN 3.0 AND 4.5 AND isfinite(terminal_cap_rate) AND terminal_cap_rate <= 5.0 AND isfinite(occupancy) AND occupancy >= 90 AND isfinite(price) AND price BETWEEN 1000 AND 60000",
    "f_bounds": f"WITH {_PROP} SELECT id, lat, lng FROM prop WHERE lat BETWEEN 33.0 AND 38.0 AND lng BETWEEN 130.0 AND 140.0",
    "f_radius": f"WITH {_PROP}, d AS (SELECT id, {_HAV.format(a='36.2 + 0 * ', b='').replace('36.2 + 0 * lat', '36.2').replace('36.2 + 0 * lng', '134.4')} AS km FROM prop WHERE {_VALID.format(p='')}) SELECT id, round(km, 6) AS km FROM d WHERE km <= 50.0",
    "o_sort_nulls_last": f"WITH {_PROP} SELECT id, price, row_number() OVER (ORDER BY price DESC NULLS LAST, name ASC NULLS LAST, id) AS rank FROM prop",
    "o_bounded_selection": f"""WITH {_PROP}, n AS (SELECT id, lat, lng, CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) AS o FROM prop),
      u AS (SELECT id, 0 AS s, o FROM (SELECT * FROM n ORDER BY id DESC LIMIT 10) UNION ALL SELECT id, 1, o FROM n WHERE lat BETWEEN 33.0 AND 38.0 AND lng BETWEEN 130.0 AND 140.0),
      f AS (SELECT id, min(struct_pack(s := s, o := o)) AS at_ FROM u GROUP BY id ORDER BY at_, id LIMIT 50) SELECT id, CAST(row_number() OVER (ORDER BY at_, id) AS INT) AS ord FROM f""",
    "k_csv_lines": f"WITH {_PROP} SELECT " + " || ',' || ".join(f"'\"' || replace(coalesce(CAST({c} AS VARCHAR), ''), '\"', '\"\"') || '\"'" for c in ("id", "name", "reit", "region", "tenants", "source")) + " AS line FROM prop",
    "x_bands": f"WITH {_PROP} SELECT CASE WHEN cap IS NULL OR NOT isfinite(cap) THEN 'unknown' WHEN cap >= 5.5 THEN 'over-5-5' WHEN cap >= 5 THEN '5-to-5-5' WHEN cap >= 4.5 THEN '4-5-to-5' WHEN cap >= 4 THEN '4-to-4-5' WHEN cap >= 3.5 THEN '3-5-to-4' ELSE 'under-3-5' END AS band, count(*) AS n FROM prop GROUP BY 1",
    "m_comparables": f"""WITH {_PROP}, f AS (SELECT id, type, CASE WHEN {_VALID.format(p='')} THEN lat END AS lat, lng, {', '.join(f'{_FIN(c)} AS {c}' for c in ('leasable_area', 'price', 'cap', 'terminal_cap_rate', 'occupancy'))} FROM prop),
      s AS (SELECT q.id AS base_id, p.id AS id, CAST(greatest(0.0, floor(round(100 - (CASE WHEN q.lat IS NULL OR p.lat IS NULL THEN 15.0 ELSE least(round({_HAV.format(a='q.', b='p.')}, 6) / 50, 1.0) * 30 END + {_RATIO('leasable_area', 20)} + {_RATIO('price', 10)} + {_SCALED('cap', 1.5, 15)} + {_SCALED('terminal_cap_rate', 1.5, 15)} + {_SCALED('occupancy', 10, 10)}), 9) + 0.5)) AS INT) AS score
        FROM f q JOIN f p ON q.type = p.type AND q.id <> p.id WHERE CAST(regexp_extract(q.id, '([0-9]+)$', 1) AS BIGINT) % 50 = 0)
      SELECT *, CAST(row_number() OVER (PARTITION BY base_id ORDER BY score DESC, id) AS INT) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY base_id ORDER BY score DESC, id) <= 5""",
    "t_raw_series": f"WITH {_KEYED} SELECT id, key, value FROM k QUALIFY row_number() OVER (PARTITION BY id, key ORDER BY pos DESC) = 1",
    "t_half_year_series": f"WITH {_SERIES} SELECT * FROM series",
    "t_timeline": f"WITH {_KEYED} SELECT DISTINCT bucket AS key, CASE WHEN {_HY} THEN substr(bucket, 1, 4) || CASE WHEN bucket LIKE '%H1' THEN '-06' ELSE '-12' END ELSE bucket END AS label FROM kb",
    "t_grid": f"WITH {_GRIDSQL} SELECT id, bucket, value FROM g",
    "t_segments": f"WITH {_GRIDSQL} SELECT id, min(ix) AS start, max(ix) AS stop, count(*) AS n FROM {_SEG.format(src='g WHERE value IS NOT NULL')} GROUP BY id, island",
    "t_gap_edges": f"WITH {_GRIDSQL} SELECT id, before AS start, ix AS stop FROM (SELECT id, ix, lag(ix) OVER (PARTITION BY id ORDER BY ix) AS before FROM g WHERE value IS NOT NULL) WHERE ix > before + 1",
    "t_band_segments": f"WITH {_SERIES}, {_TIMELINE}, q AS (SELECT substr(id, 1, 3) AS id, ix FROM series JOIN tl USING (bucket) GROUP BY substr(id, 1, 3), ix HAVING count(*) >= 3) SELECT id, min(ix) AS start, max(ix) AS stop, count(*) AS n FROM {_SEG.format(src='q')} GROUP BY id, island",
    "a_distribution": f"WITH {_SERIES}, d AS ({_DIST.format(src='series')}) SELECT key, n, " + ", ".join(f"CASE WHEN n >= {_LEAST.format(src='series')} THEN round({c}, 9) END AS {o}" for c, o in (("a", "average"), ("q1", "q1"), ("q2", "median"), ("q3", "q3"))) + " FROM d",
    "t_latest_snapshot": f"WITH {_SERIES}, d AS ({_DIST.format(src='series')}) SELECT key, n, round(q2, 9) AS median, CAST(floor(n / (SELECT count(DISTINCT id) FROM series) * 100 + 0.5) AS INT) AS coverage FROM d WHERE n >= {_LEAST.format(src='series')} ORDER BY key DESC LIMIT 1",
    "t_summary": f"WITH {_KEYED}, s AS (SELECT id, arg_min(value, struct_pack(k := key, p := pos)) AS first, arg_max(value, struct_pack(k := key, p := pos)) AS latest, count(value) AS n FROM k WHERE value IS NOT NULL GROUP BY id) SELECT id, first, latest, latest - first AS change, n FROM s",
    "t_prior_delta": f"WITH {_KEYED}, r AS (SELECT id, value, row_number() OVER (PARTITION BY id ORDER BY key DESC, pos DESC) AS rn FROM k WHERE value IS NOT NULL), s AS (SELECT id, max(CASE WHEN rn = 1 THEN value END) AS latest, max(CASE WHEN rn = 2 THEN value END) AS prior FROM r WHERE rn <= 2 GROUP BY id) SELECT *, latest - prior AS delta FROM s",
    "p_spread": f"WITH {_PROP}, e AS (SELECT property_id AS id, row_id, {_KEY} AS key, {_FIN('cap')} AS cap, {_FIN('terminal_cap_rate')} AS tcr FROM property_period WHERE property_id IS NOT NULL), l AS (SELECT * FROM e WHERE cap IS NOT NULL OR tcr IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY key DESC, row_id DESC) = 1), b AS (SELECT p.id, l.key, coalesce(l.cap, {_FIN('p.cap')}) AS cap, coalesce(l.tcr, {_FIN('p.terminal_cap_rate')}) AS terminal_cap_rate FROM prop p LEFT JOIN l USING (id) WHERE p.id IS NOT NULL) SELECT *, terminal_cap_rate - cap AS spread FROM b",
    "t_recent": "SELECT property_id AS id, row_id AS pos, period_no FROM property_period QUALIFY dense_rank() OVER (PARTITION BY property_id ORDER BY period_no DESC NULLS LAST) <= 10",
    "t_stream_half_year": f"WITH k AS (SELECT property_id AS id, row_id AS pos, as_of_date AS key, cap AS value FROM property_period WHERE isfinite(cap) AND regexp_matches(as_of_date, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')) SELECT id, {_bucket('key')} AS bucket, key, value FROM k QUALIFY row_number() OVER (PARTITION BY id, {_bucket('key')} ORDER BY key DESC, pos DESC) = 1",
    "q_duplicates": "SELECT id, count(*) AS rows FROM property_master WHERE coalesce(id, '') <> '' GROUP BY id HAVING count(*) > 1",
    "q_required": "SELECT missing, count(*) AS n FROM (SELECT concat_ws(',', " + ", ".join(f"CASE WHEN coalesce({c}, '') = '' THEN '{c}' END" for c in (*quality.REQUIRED, "region")) + ") AS missing FROM property_master) WHERE missing <> '' GROUP BY missing",
    "q_ranges": f"WITH {_PROP}, l AS ({_LONGSQL('prop', 'id')} UNION ALL {_LONGSQL('property_period', 'property_id AS id')}) SELECT field, count(*) AS n, count(DISTINCT id) AS properties FROM l WHERE value IS NOT NULL AND {_outside()} GROUP BY field",
    "q_coordinates": f"WITH {_PROP} SELECT CASE WHEN lat IS NULL OR lng IS NULL THEN 'missing' WHEN isnan(lat) OR isnan(lng) OR lat NOT BETWEEN -90 AND 90 OR lng NOT BETWEEN -180 AND 180 THEN 'invalid' ELSE 'valid' END AS state, count(*) AS n FROM prop GROUP BY 1",
    "q_area": "SELECT row_id AS pos, leased_area, leasable_area FROM property_period WHERE leased_area > leasable_area * 0.99::DOUBLE AND NOT isnan(leased_area)",
    "q_area_rule": "SELECT row_id AS pos, leased_area, leasable_area FROM property_period WHERE leased_area > leasable_area * 1.02::DOUBLE AND NOT isnan(leased_area)",
    "q_evidence": f"{_RECORDED} SELECT field, count(*) AS n, count(*) FILTER (ok) AS complete, count(*) FILTER (ok AND NOT same) AS inconsistent, {_PCT('count(*) FILTER (ok)', 'count(*)')} AS coverage FROM (SELECT coalesce(field, '') AS field, {_COMPLETE} AS ok, {_SAME} AND (coalesce(s.given, 0) + coalesce(h.given, 0) = 0 OR coalesce(s.hit, false) OR coalesce(h.hit, false)) AS same FROM source_evidence e LEFT JOIN s USING (evidence_id) LEFT JOIN h USING (evidence_id)) GROUP BY field",
    "q_by_metric": f"WITH {_PROP}, l AS ({_LONGSQL('prop', 'id')}) SELECT field, count(value) AS available, count(*) AS rows, {_PCT('count(value)', 'count(*)')} AS coverage FROM l GROUP BY field",
    "q_by_group": f"WITH {_PROP} SELECT coalesce(nullif(reit_code, ''), '未分類') AS grp, count(*) AS properties, CAST(sum({' + '.join(f'CASE WHEN {m} IS NOT NULL AND NOT isnan({m}) THEN 1 ELSE 0 END' for m in M)}) AS BIGINT) AS numeric_values, count(*) FILTER (ok) AS with_coordinates, {_PCT('count(*) FILTER (ok)', 'count(*)')} AS coordinate_coverage FROM (SELECT *, coalesce(NOT isnan(lat) AND NOT isnan(lng) AND lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180, false) AS ok FROM prop) GROUP BY 1",
    "q_first_issues": f"WITH l AS ({_LONGSQL('property_period', 'row_id AS pos')}) SELECT * FROM l WHERE value IS NOT NULL AND {_outside()} QUALIFY row_number() OVER (PARTITION BY field ORDER BY pos) <= 20",
    "c_entities": "WITH a AS (SELECT DISTINCT lower(trim(id)) AS id FROM property_snapshot WHERE snapshot_no = 1 AND id IS NOT NULL), b AS (SELECT DISTINCT lower(trim(id)) AS id FROM property_snapshot WHERE snapshot_no = 5 AND id IS NOT NULL) SELECT id, 'removed' AS change FROM (FROM a EXCEPT FROM b) UNION ALL SELECT id, 'added' FROM (FROM b EXCEPT FROM a)",
    "c_periods": f"WITH {_SIDES} SELECT property_id, CASE WHEN a.row_id IS NULL THEN 'added' WHEN b.row_id IS NULL THEN 'removed' ELSE 'shared' END AS change, count(*) AS n FROM a FULL JOIN b USING (property_id, period_no) GROUP BY 1, 2",
    "c_metrics": f"WITH {_DIFFSQL} SELECT property_id, period_no, field, change, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) AS delta FROM dd",
    "c_by_metric": f"WITH {_DIFFSQL} SELECT f.field, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'changed') AS changed FROM (VALUES {', '.join(f'({m!r})' for m in M)}) AS f(field) LEFT JOIN dd ON dd.field = f.field GROUP BY f.field",
    "c_master": "WITH e AS (SELECT id, min(loaded_at) AS a, max(loaded_at) AS b FROM property_master GROUP BY id HAVING min(loaded_at) < max(loaded_at)), x AS (SELECT m.* FROM property_master m JOIN e ON m.id = e.id AND m.loaded_at = e.a), y AS (SELECT m.* FROM property_master m JOIN e ON m.id = e.id AND m.loaded_at = e.b) " + " UNION ALL ".join(f"SELECT x.id, '{c}' AS field, x.{c} AS before, y.{c} AS after FROM x JOIN y ON x.id = y.id WHERE x.{c} IS DISTINCT FROM y.{c}" for c in ("name", "reit", "reit_code", "type", "region", "address")),
    "e_build": f"WITH {_PROP} " + " UNION ALL ".join(f"SELECT id, '{m}' AS field, '{METRICS[m][0]}' AS metric_code, 'Sheet!1' AS sheet, '{c}' || length(name) AS cell FROM prop WHERE {m} IS NOT NULL AND name IS NOT NULL" for m, c in (("price", "A"), ("cap", "B"), ("noi", "C"))),
    "a_review_summary": "WITH s AS (SELECT CASE WHEN review.status IN ('approved', 'rejected', 'not_required') THEN review.status ELSE 'pending' END AS status FROM source_evidence) SELECT k.status, count(s.status) AS n FROM (VALUES ('approved'), ('rejected'), ('not_required'), ('pending')) AS k(status) LEFT JOIN s ON s.status = k.status GROUP BY k.status",
    "j_latest_review": "WITH e AS (SELECT evidence_id, concat_ws('|', property_id, field, observed_at) AS k, review.status AS s FROM source_evidence WHERE property_id IS NOT NULL AND field IS NOT NULL AND observed_at IS NOT NULL), l AS (SELECT k, arg_max(s, evidence_id) AS s FROM e WHERE s IS NOT NULL GROUP BY k) SELECT evidence_id, coalesce(l.s, 'pending') AS status FROM e LEFT JOIN l USING (k)",
    "j_unmatched_snapshots": "SELECT row_id, id FROM property_snapshot s WHERE NOT EXISTS (SELECT 1 FROM property_master p WHERE p.id = s.id)",
    "a_catalog": "WITH k AS (SELECT source_document_id AS document_id, count(*) AS k FROM source_evidence WHERE coalesce(source_document_id, '') <> '' GROUP BY 1) SELECT reit_code, count(*) AS documents, CAST(coalesce(sum(k), 0) AS BIGINT) AS evidence, count(k) AS cited FROM source_document LEFT JOIN k USING (document_id) GROUP BY reit_code",
    "a_layout": _LAYOUT,
    "p_layout_status": "WITH s AS (SELECT feed_id, CASE WHEN p IS NULL THEN 'new' WHEN p = schema_version THEN 'unchanged' ELSE 'changed' END AS s FROM (SELECT feed_id, schema_version, lag(schema_version) OVER (PARTITION BY feed_id ORDER BY load_no) AS p FROM quality_report)) SELECT feed_id, CASE WHEN bool_or(s = 'changed') THEN 'changed' WHEN bool_and(s = 'unchanged') THEN 'unchanged' ELSE 'new' END AS status FROM s GROUP BY feed_id",
    "a_recon": "WITH p AS (SELECT feed_id, load_no, count(DISTINCT property_id) AS counted FROM property_period GROUP BY 1, 2) SELECT feed_id, load_no, q.totals.properties AS reported, counted, counted - q.totals.properties AS difference, CASE WHEN abs(counted - q.totals.properties) <= 2 THEN 'ok' ELSE 'review' END AS state FROM quality_report q LEFT JOIN p USING (feed_id, load_no)",
    "a_history_hist": "WITH s AS (SELECT count(*) AS c FROM property_period WHERE property_id IS NOT NULL GROUP BY property_id) SELECT l AS length, count(s.c) AS n FROM range(1, (SELECT max(c) FROM s) + 1) AS r(l) LEFT JOIN s ON s.c = l GROUP BY l",
    "j_previous_run": "SELECT import_run_id AS run_id, max(CASE WHEN status = 'passed' THEN import_run_id END) OVER (PARTITION BY concat_ws('|', feed_id, schema_version) ORDER BY import_run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS same_inputs_as FROM quality_report",
    "u_union_sources": "SELECT 'master' AS kind, id, cap, NULL AS appraisal_unit FROM property_master UNION ALL SELECT 'snapshot', id, cap, appraisal_unit FROM property_snapshot",
    "x_clean_name": "WITH c AS (SELECT id, regexp_replace(regexp_replace(replace(name, '　', ' '), '^\\s+|\\s+$', '', 'g'), '\\s*\\*[0-9]+$', '') AS name FROM property_master WHERE name IS NOT NULL) SELECT DISTINCT id, name, 'P-' || upper(substr(sha1(name), 1, 10)) AS stable_id FROM c",
    "x_labelled_number": "SELECT doc_id, " + ", ".join(f"""try_cast(replace(list_filter([regexp_extract(substr(l, instr(l, '{w}') + {len(w)}), '[-+]?[0-9][0-9,]*(\\.[0-9]+)?') FOR l IN string_split(replace(text, E'\\r\\n', E'\\n'), E'\\n') IF contains(l, '{w}')], lambda v: v <> '')[1], ',', '') AS DOUBLE) AS {o}""" for w, o in (("稼働率", "value"), ("in period", "period"))) + " FROM documents WHERE text IS NOT NULL",
    "x_numeric_text": "WITH t AS (SELECT id, regexp_replace(a, '[,，\\s　]', '', 'g') AS t FROM (SELECT id, address AS a FROM property_master UNION ALL SELECT CAST(row_id AS VARCHAR), as_of_date FROM property_period)) SELECT id, CASE WHEN regexp_full_match(t, '|-|－|―|—|–|ー|非開示.*') THEN NULL WHEN regexp_matches(t, '^[△▲-]') THEN -try_cast(nullif(regexp_extract(t, '[0-9]+(\\.[0-9]+)?'), '') AS DOUBLE) ELSE try_cast(nullif(regexp_extract(t, '[0-9]+(\\.[0-9]+)?'), '') AS DOUBLE) END AS value FROM t",
    "x_evidence_id": "SELECT evidence_id, 'ev-' || substr(sha256(" + " || '|' || ".join(f"coalesce({c}, '')" for c in ("property_id", "field", "observed_at", "source_document_id", "locator.sheet", "locator.cell")) + "), 1, 32) AS ev, concat_ws(' / ', 'PDF p.' || locator.page, 'Sheet: ' || nullif(locator.sheet, ''), 'Cell: ' || nullif(coalesce(nullif(locator.cell, ''), locator.cell_range), '')) AS position FROM source_evidence",
    "x_period_key": f"WITH p AS (SELECT row_id AS pos, {_KEY} AS key, as_of_date, period, period_no FROM property_period), b AS (SELECT *, {_bucket('key')} AS bucket FROM p) SELECT pos, key, bucket, CASE WHEN {_HY} THEN substr(bucket, 1, 4) || CASE WHEN bucket LIKE '%H1' THEN '-06' ELSE '-12' END ELSE bucket END AS bucket_label, coalesce(substr(nullif(as_of_date, ''), 1, 7), nullif(period, ''), '第' || period_no || '期', key) AS label, format('{{:04d}}', CAST(2001 + floor((period_no + 1) / 2) AS INT)) || CASE WHEN period_no % 2 = 1 THEN '-03-31' ELSE '-09-30' END AS closing FROM b",
    "p_find_row": f"WITH {_CELLS} SELECT doc, sheet, min(row) AS row FROM c WHERE value = 'cap' AND row <= 200 GROUP BY doc, sheet",
    "p_header_map": f"WITH {_CELLS}, h AS (SELECT doc, sheet, min(row) AS row FROM c GROUP BY doc, sheet) SELECT doc, sheet, trim(value) AS name, arg_max(col, struct_pack(l := length(col), c := col)) AS col FROM c JOIN h USING (doc, sheet, row) WHERE trim(value) <> '' GROUP BY doc, sheet, trim(value)",
    "p_wide_to_long": "SELECT * FROM (SELECT row_id AS pos, 'direct' AS method, cap AS rate, appraisal AS amount FROM property_period UNION ALL SELECT row_id, 'discounted', discount_rate, book_value FROM property_period) WHERE rate IS NOT NULL OR amount IS NOT NULL",
    "j_same_row": f"WITH {_BOX} SELECT doc, page, label_id, number_id, value, place, in_row FROM rown",
    "j_row_value": f"WITH {_BOX} SELECT doc, page, number_id, value FROM rown WHERE place = 0 QUALIFY row_number() OVER (PARTITION BY doc, page ORDER BY in_row DESC, lx0, label_id) = 1",
    "j_nearest_number": f"""WITH {_BOX}, anchor AS (SELECT doc, page, cx, cy FROM w WHERE field = 'price' QUALIFY row_number() OVER (PARTITION BY doc, page ORDER BY id) = 1),
      one AS (SELECT l.* FROM lab l JOIN anchor a USING (doc, page) QUALIFY row_number() OVER (PARTITION BY doc, page ORDER BY sqrt(pow(l.cx - a.cx, 2) + pow(l.cy - a.cy, 2)), l.id) = 1),
      k AS (SELECT l.doc, l.page, n.id AS number_id, n.value, abs(n.cy - l.cy) <= 6 AND n.x0 >= l.x1 - 2 AS same, n.cy - l.cy > 0 AND n.cy - l.cy <= 24 AND abs(n.cx - l.cx) <= 80 AS below, sqrt(pow(n.cx - l.cx, 2) + pow(n.cy - l.cy, 2)) AS d FROM one l JOIN num n USING (doc, page))
      SELECT doc, page, number_id, value FROM k WHERE same OR below QUALIFY row_number() OVER (PARTITION BY doc, page ORDER BY d + CASE WHEN same THEN 0 ELSE 80 END, number_id) = 1""",
    "u_missing_required": f"WITH {_CELLS} SELECT d.doc, m.value FROM (SELECT DISTINCT doc FROM c) d, (VALUES {', '.join(f'({m!r})' for m in M)}) AS m(value) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc = d.doc AND c.value = m.value)",
    "c_layout_fingerprint": f"SELECT source_document_id, sha256(string_agg(line, chr(10) ORDER BY line)) AS fingerprint FROM (SELECT source_document_id, concat_ws('|', sheet, max_row, max_column, non_empty_cells) AS line FROM ({_LAYOUT})) GROUP BY source_document_id",
    "j_name_match": f"WITH a AS (SELECT DISTINCT {_EVENT_NAME} AS l FROM property_master), b AS (SELECT DISTINCT {_EVENT_NAME} AS r FROM property_snapshot) SELECT l AS left_name, r AS right_name FROM a JOIN b ON l <> '' AND r <> '' AND (contains(l, r) OR contains(r, l))",
}

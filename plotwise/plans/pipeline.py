"""Queries of the general training-data operators: neighbours and areas, nested records, snapshot changes, column profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plotwise.operators import geo, nested, profile, snapshots
from plotwise.sources.tables import table

RADIUS_KM = 0.15


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Properties at most 150 m apart, and the areas each property lies in."""
    pm = table(spark, sf, "property_master").select("id", "lat", "lng")
    pts = geo.points(pm)
    near = geo.near_pairs(pm, RADIUS_KM, pts=pts).select(F.lit("near").alias("kind"), "left_id", "right_id")
    inside = geo.containing_areas(pm, table(spark, sf, "area_ref").select("area_id", "wkt"), pts=pts)
    return near.unionByName(inside.select(F.lit("inside").alias("kind"), F.col("point_id").alias("left_id"), F.col("area_id").alias("right_id")))


def p1_near_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Number of neighbours within 150 m of each property that has any."""
    return geo.near_counts(table(spark, sf, "property_master"), RADIUS_KM)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """All evidence items of all bodies, with the keys of their parents."""
    rows = nested.evidence(table(spark, sf, "canonical_property_period"))
    return rows.select("record_id", "period_pos", "field", "item_pos", "source_document_id", "cell", "parser")


def p3_records(spark: SparkSession, sf: str) -> DataFrame:
    """The table of records."""
    return nested.records(table(spark, sf, "canonical_property_period"))


def p3_periods(spark: SparkSession, sf: str) -> DataFrame:
    """The table of periods, each with its record."""
    return nested.periods(table(spark, sf, "canonical_property_period"))


def p3_source_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """source_evidence flat."""
    return nested.source_evidence(table(spark, sf, "source_evidence"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Added, removed and changed ids of each delivery against the one before."""
    return snapshots.property_changes(table(spark, sf, "property_snapshot"))


def p4_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Validity intervals of the property snapshots."""
    rows = snapshots.property_intervals(table(spark, sf, "property_snapshot"))
    return rows.withColumns({"cap": F.round("cap", 6), "appraisal": F.round("appraisal", 6)})


def _profile(spark: SparkSession, sf: str, *specs: profile.TableChecks) -> DataFrame:
    states = [profile.state(table(spark, sf, s.table), s) for s in specs]
    merged = states[0]
    for s in states[1:]:
        merged = merged.unionByName(s)
    return profile.metrics(merged, list(specs))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Which column went wrong in which load."""
    return profile.findings(_profile(spark, sf, profile.PERIOD, profile.REPORT))


def _whole_profile(spark: SparkSession, sf: str) -> DataFrame:
    """All columns of both tables from their mergeable sketches."""
    parts = [profile.profiled(profile.sketches(table(spark, sf, s.table), s), s) for s in (profile.PERIOD_ALL, profile.REPORT_ALL)]
    return parts[0].unionByName(parts[1])


def p6_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The profile of every column of every load: ranges, forms and what breaks a range or a pattern included."""
    return _whole_profile(spark, sf).withColumns({"median": F.round("median", 6), "mean": F.when(F.col("column_name").isin(*profile.RISING), F.round("mean", 3)).otherwise(F.round("mean", 7))})


def p6_control(spark: SparkSession, sf: str) -> DataFrame:
    """Loads outside the control limits that their feed's history gives."""
    rows = profile.control_limits(_whole_profile(spark, sf))
    return rows.withColumns({c: F.round(c, 6) for c in ("value", "low", "high")})


_PLAIN = "nullif(lower(trim(replace(translate(id, '{wide}', '{ascii}'), '　', ' '), E' \\t\\n\\r\\f\\v')), '')".format(
    wide="".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F) if chr(c) != "'"), ascii="".join(chr(c) for c in range(0x21, 0x7F) if chr(c) != "'")
)
_STATES = f"""
states AS (
  SELECT s, k, arg_max(struct_pack(cap := cap, appraisal := a), struct_pack(l := loaded_at, r := row_id)) AS v
  FROM (SELECT snapshot_no AS s, {_PLAIN} AS k, cap, appraisal / CASE appraisal_unit WHEN 'jpy' THEN 1000000.0 WHEN 'thousand_jpy' THEN 1000.0 ELSE 1.0 END AS a, loaded_at, row_id FROM property_snapshot)
  WHERE k IS NOT NULL AND s IS NOT NULL GROUP BY s, k)"""
_DIFFERS = "((a.v.{c} IS NULL) <> (b.v.{c} IS NULL) OR coalesce(abs(a.v.{c} - b.v.{c}) > 1e-6, false))"
_CHANGED = f"({_DIFFERS.format(c='cap')} OR {_DIFFERS.format(c='appraisal')})"

def _form_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({c}, '[a-zA-Z]', 'a', 'g'), '[0-9]', '9', 'g'), '[^\\P{{L}}a]', 'x', 'g')"


def _profile_sql() -> str:
    parts = []
    for spec in (profile.PERIOD_ALL, profile.REPORT_ALL):
        for c in spec.checks:
            x = f"epoch({c.name})" if c.time else f"CAST({c.source or c.name} AS {'DOUBLE' if c.numeric else 'VARCHAR'})"
            out = [f"{x} {'<' if c.low_included else '<='} {c.low}"] if c.low is not None else []
            out += [f"{x} > {c.high}"] if c.high is not None else []
            bad = f"count(*) FILTER ({' OR '.join([*out, f'isnan({x})'])})" if out else "0"
            odd = f"count(*) FILTER ({x} IS NOT NULL AND NOT (regexp_full_match({x}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast({x} AS DATE) IS NOT NULL))" if c.date else "0"
            number = f"min({x}) AS low, max({x}) AS high, avg({x}) AS mean, quantile_disc({x}, 0.5) FILTER (NOT isnan({x})) AS median, {bad} AS out_of_range, 0 AS bad_pattern, 0 AS forms, NULL::VARCHAR AS low_form, NULL::VARCHAR AS high_form"
            form = _form_sql(x)
            text = f"NULL::DOUBLE AS low, NULL::DOUBLE AS high, NULL::DOUBLE AS mean, NULL::DOUBLE AS median, 0 AS out_of_range, {odd} AS bad_pattern, count(DISTINCT {form}) AS forms, min({form}) AS low_form, max({form}) AS high_form"
            parts.append(f"SELECT '{spec.table}' AS table_name, '{c.name}' AS column_name, feed_id, load_no, count(*) AS rows, count(*) - count({x}) AS nulls, count(DISTINCT {x}) AS \"distinct\", {number if c.numeric else text} FROM {spec.table} WHERE feed_id IS NOT NULL AND load_no IS NOT NULL GROUP BY feed_id, load_no")
    return " UNION ALL ".join(parts)


def _control_sql() -> str:
    mean = "CASE WHEN NOT isnan(mean) AND column_name NOT IN ({}) THEN mean END".format(", ".join(f"'{c}'" for c in profile.RISING))
    return f"""WITH p AS ({_profile_sql()}), f AS (SELECT table_name, column_name, feed_id, load_no, unnest([struct_pack(metric := 'null_share', value := nulls::DOUBLE / rows), struct_pack(metric := 'mean', value := {mean}), struct_pack(metric := 'distinct', value := "distinct"::DOUBLE)], recursive := true) FROM p),
      w AS (SELECT *, count(value) OVER h AS k, avg(value) OVER h AS m, stddev_samp(value) OVER h AS d FROM f WINDOW h AS (PARTITION BY table_name, column_name, feed_id, metric ORDER BY load_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT table_name, column_name, feed_id, load_no, metric, round(value, 6) AS value, round(m - 3 * d, 6) AS low, round(m + 3 * d, 6) AS high FROM w WHERE k >= 4 AND (value < m - 3 * d - 1e-9 OR value > m + 3 * d + 1e-9)"""


def _found_sql() -> str:
    base = []
    for t, c, x in (("property_period", "occupancy", "occupancy"), ("quality_report", "evidence_coverage_percent", "totals.evidence_coverage_percent")):
        base.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, feed_id, load_no, count(*) AS n, count({x}) AS k, count(DISTINCT {x}) AS d, quantile_cont({x}, 0.5) AS m, bool_or({x} < 0 OR {x} > 100) AS bad, false AS odd FROM {t} GROUP BY feed_id, load_no")
    base.append("SELECT 'property_period', 'as_of_date', feed_id, load_no, count(*), count(as_of_date), NULL, NULL, false, bool_or(as_of_date IS NOT NULL AND NOT (regexp_full_match(as_of_date, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(as_of_date AS DATE) IS NOT NULL)) FROM property_period GROUP BY feed_id, load_no")
    return f"""WITH s AS ({' UNION ALL '.join(base)}),
      j AS (SELECT a.*, abs((a.n - a.k)::DOUBLE / a.n - (b.n - b.k)::DOUBLE / b.n) AS dn, abs(a.m - b.m) AS dm FROM s a LEFT JOIN s b ON a.table_name = b.table_name AND a.column_name = b.column_name AND a.feed_id = b.feed_id AND a.load_no = b.load_no + 1)
      SELECT table_name, column_name, feed_id, load_no, finding FROM (
        SELECT *, 'null_rate' AS finding FROM j WHERE dn > 0.151 UNION ALL SELECT *, 'shift' FROM j WHERE dm > 10.02 UNION ALL SELECT *, 'out_of_range' FROM j WHERE bad
        UNION ALL SELECT *, 'distinct' FROM j WHERE k >= 10 AND d * 5 < k UNION ALL SELECT *, 'pattern' FROM j WHERE odd)"""


_NEAR = """p AS (SELECT DISTINCT id, lat, lng FROM property_master WHERE id IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lng) AND lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 AND NOT (lat = 0 AND lng = 0)),
  n AS (SELECT a.id AS x, b.id AS y FROM p a JOIN p b ON a.id < b.id AND b.lat BETWEEN a.lat - 0.002 AND a.lat + 0.002
        WHERE 2 * 6371 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))) <= 0.15)"""

QUERIES = {f.__name__: f for f in (p1_found, p1_near_counts, p3_found, p3_records, p3_periods, p3_source_evidence, p4_found, p4_intervals, p6_found, p6_profile, p6_control)}

SQL = {
    "p1_near_counts": f"WITH {_NEAR} SELECT id, count(*) AS neighbours FROM (SELECT x AS id FROM n UNION ALL SELECT y FROM n) GROUP BY id",
    "p3_records": """SELECT record_id, coalesce(j->>'$.record_version', '') AS record_version, coalesce(j->>'$.property_id', '') AS property_id, coalesce(j->>'$.reit_code', '') AS reit_code,
      coalesce(j->>'$.reporting_period.label', '') AS period_label, coalesce(j->>'$.reporting_period.as_of_date', '') AS as_of_date, coalesce(j->>'$.quality.status', '') AS quality_status, CAST(coalesce(json_array_length(j, '$.periods'), 0) AS INT) AS n_periods
      FROM (SELECT record_id, CAST(body AS JSON) AS j FROM property_json)""".replace("property_json", "(SELECT record_id, body FROM canonical_property_period WHERE json_valid(body))"),
    "p3_source_evidence": """SELECT evidence_id, property_id, field, coalesce(source_document_id, '') AS source_document_id, coalesce(locator.sheet, '') AS sheet, locator.page AS page, coalesce(locator.cell, '') AS cell,
      coalesce(extraction.parser, '') AS parser, coalesce(extraction.parser_version, '') AS parser_version, extraction.confidence AS confidence, coalesce(review.status, '') AS review_status FROM source_evidence""",
    "p4_found": f"""WITH {_STATES}, m AS (SELECT min(s) AS lo, max(s) AS hi FROM states)
      SELECT b.s AS snapshot_no, b.k AS id, CASE WHEN a.k IS NULL THEN 'added' ELSE 'changed' END AS change FROM states b LEFT JOIN states a ON a.k = b.k AND a.s = b.s - 1 WHERE b.s > (SELECT lo FROM m) AND (a.k IS NULL OR {_CHANGED})
      UNION ALL SELECT CAST(a.s + 1 AS INT), a.k, 'removed' FROM states a LEFT JOIN states b ON a.k = b.k AND a.s = b.s - 1 WHERE a.s < (SELECT hi FROM m) AND b.k IS NULL""",
    "p4_intervals": f"""WITH {_STATES}, f AS (SELECT b.k, b.s, b.v, CASE WHEN a.k IS NULL OR {_CHANGED} THEN 1 ELSE 0 END AS start FROM states b LEFT JOIN states a ON a.k = b.k AND a.s = b.s - 1),
      i AS (SELECT *, sum(start) OVER (PARTITION BY k ORDER BY s) AS island FROM f)
      SELECT k AS id, min(s) AS valid_from, max(s) AS valid_to, round(arg_min(v, s).cap, 6) AS cap, round(arg_min(v, s).appraisal, 6) AS appraisal FROM i GROUP BY k, island""",
    "p6_found": _found_sql(),
    "p6_profile": f"SELECT * REPLACE (round(median, 6) AS median, CASE WHEN column_name IN ({', '.join(f"'{c}'" for c in profile.RISING)}) THEN round(mean, 3) ELSE round(mean, 7) END AS mean) FROM ({_profile_sql()})",
    "p6_control": _control_sql(),
    "p3_periods": """SELECT record_id, CAST(i AS INT) AS period_pos, TRY_CAST(p->>'$.period_no' AS INT) AS period_no, coalesce(p->>'$.period', '') AS period, coalesce(p->>'$.as_of_date', '') AS as_of_date
      FROM (SELECT record_id, i, json_extract(j, '$.periods[' || i || ']') AS p FROM (SELECT record_id, CAST(body AS JSON) AS j FROM canonical_property_period WHERE json_valid(body)), range(0, 1000) AS r(i) WHERE i < json_array_length(j, '$.periods'))""",
}

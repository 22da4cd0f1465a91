"""Queries of the operators for language-model data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plotwise.llm import addresses, mixing, percentiles, subjects, tokens
from plotwise.session import broadcast_if_small, materialize
from plotwise.sources.tables import table


PROBS = (0.05, 0.25, 0.5, 0.75, 0.95)
RATES = ("cap", "terminal_cap_rate")


def p2_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Exact percentiles of the rates for each issuer and load, and (load_no 0) for each issuer over all loads."""
    pp = table(spark, sf, "property_period").select("reit_code", "reit", "load_no", *RATES)
    spelled = pp.where("reit is not null").groupBy("reit_code", F.regexp_replace("reit", r"(?U)\s", "").alias("reit")).count()
    names = spelled.groupBy("reit_code").agg(F.max_by("reit", F.struct("count", "reit")).alias("reit"))
    rows = percentiles.percentiles(pp, ["reit_code", "load_no"], RATES, PROBS, also=["reit_code"])
    rows = rows.withColumn("load_no", F.when(F.col("whole"), F.lit(0)).otherwise(F.col("load_no"))).alias("r").join(names.alias("m"), F.col("r.reit_code").eqNullSafe(F.col("m.reit_code")), "left")
    return rows.select("r.reit_code", "m.reit", "load_no", "metric", "p", "n", F.round("value", 9).alias("value"))


def p2_combined(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds of the percentiles over all loads, combined from the states of the separate loads."""
    pp = table(spark, sf, "property_period").select("reit_code", "load_no", *RATES)
    by_load = percentiles.sketch(pp, ["reit_code", "load_no"], RATES)
    return percentiles.sketch_percentiles(percentiles.merge(by_load, ["reit_code"]), ["reit_code"], PROBS)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Properties at the same place although the address is written differently."""
    return addresses.same_place(table(spark, sf, "property_master").select("id", "address"), table(spark, sf, "town_ref"))


def p5_places(spark: SparkSession, sf: str) -> DataFrame:
    """Each property's place, how many properties stand there, and with how many others it is at the same place."""
    return addresses.places(table(spark, sf, "property_master").select("id", "address"), table(spark, sf, "town_ref"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The ids of every text by byte_bpe_50k."""
    return tokens.encode(table(spark, sf, "documents").select("doc_id", "text"))


def p7_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Every text encoded and decoded again: doc_id and the text, '' for null texts."""
    return p7_ids(spark, sf).select("doc_id", tokens.decoded_text(F.col("ids")).alias("text"))


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf, "documents").select("doc_id", "source", "text"), ("doc_id", "source"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of mix_target whose source can't reach its share."""
    return mixing.short(_sizes(spark, sf), table(spark, sf, "mix_target"))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of each mix, dealt to shards and shuffled."""
    return mixing.mix(_sizes(spark, sf), table(spark, sf, "mix_target"))


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    """The shares that each mix reaches."""
    sizes, targets = materialize(_sizes(spark, sf)), table(spark, sf, "mix_target")
    return mixing.report(mixing.mix(sizes, targets), mixing.quotas(sizes, targets))


def _places(spark: SparkSession, sf: str) -> DataFrame:
    """(property_id, address): the kind of place each property's documents speak of, its type and region."""
    pm = table(spark, sf, "property_master").where("id is not null").groupBy(F.col("id").alias("property_id")).agg(F.max_by(F.concat_ws("|", "type", "region"), "loaded_at").alias("address"))
    return broadcast_if_small(materialize(pm), F.lit(48) + F.octet_length("property_id") + F.octet_length("address"))


def _subject_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    docs = table(spark, sf, "documents").select("doc_id", "text", "source", "property_id")
    return docs, table(spark, sf, "subject_label"), table(spark, sf, "subject_ref"), _places(spark, sf)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """The subjects of every document."""
    return subjects.subjects_of(*_subject_tables(spark, sf))


def p9_accuracies(spark: SparkSession, sf: str) -> DataFrame:
    """How accurate each labelling function is, as the latent model learned it, and how often it votes."""
    return subjects.accuracies(*_subject_tables(spark, sf))


def p9_composition(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus counted by subject."""
    return p9_found(spark, sf).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {f.__name__: f for f in (p2_percentiles, p2_combined, p5_found, p5_places, p7_ids, p7_decoded, p8_found, p8_mix, p8_report, p9_found, p9_composition, p9_accuracies)}

_LONG = " UNION ALL ".join(f"SELECT reit_code, load_no, '{c}' AS metric, {c} AS x FROM property_period WHERE {c} IS NOT NULL AND NOT isnan({c})" for c in RATES)
_PROBS = ", ".join(f"({p}::DOUBLE)" for p in PROBS)

SQL = {
    "p2_percentiles": f"""WITH long AS ({_LONG}), g AS (SELECT reit_code, load_no, metric, list(x ORDER BY x) AS xs FROM long GROUP BY reit_code, load_no, metric UNION ALL SELECT reit_code, 0, metric, list(x ORDER BY x) FROM long GROUP BY reit_code, metric),
      names AS (SELECT reit_code, arg_max(reit, struct_pack(n := n, r := reit)) AS reit FROM (SELECT reit_code, regexp_replace(reit, '[\\s　]', '', 'g') AS reit, count(*) AS n FROM property_period WHERE reit IS NOT NULL GROUP BY 1, 2) GROUP BY reit_code),
      v AS (SELECT reit_code, load_no, metric, p, len(xs) AS n, xs, (len(xs) - 1) * p AS pos FROM g, (VALUES {_PROBS}) AS q(p))
      SELECT v.reit_code, names.reit, load_no, metric, p, n, round(xs[CAST(floor(pos) AS BIGINT) + 1] + (xs[CAST(ceil(pos) AS BIGINT) + 1] - xs[CAST(floor(pos) AS BIGINT) + 1]) * (pos - floor(pos)), 9) AS value FROM v LEFT JOIN names ON v.reit_code IS NOT DISTINCT FROM names.reit_code""",
    # The bounds of the exact value's place among the states: its leading 12 bits of fraction, outward for negative values.
    "p2_combined": f"""WITH long AS ({_LONG}), g AS (SELECT reit_code, metric, list(x ORDER BY x) AS xs FROM long GROUP BY reit_code, metric), v AS (SELECT reit_code, metric, p, len(xs) AS n, xs[CAST(floor((len(xs) - 1) * p) AS BIGINT) + 1] AS x FROM g, (VALUES {_PROBS}) AS q(p)), b AS (SELECT *, CASE WHEN x <> 0 THEN pow(2.0, floor(log2(abs(x))) - 12) END AS u FROM v)
      SELECT reit_code, metric, p, n, CASE WHEN x = 0 THEN 0.0::DOUBLE WHEN x > 0 THEN floor(x / u) * u ELSE -(ceil(-x / u) * u) END AS low, CASE WHEN x = 0 THEN 1099511627775 * pow(2.0, -1074) WHEN x > 0 THEN floor(x / u) * u + u * (1 - pow(2.0, -40)) ELSE -(ceil(-x / u) * u - u * (1 - pow(2.0, -40))) END AS high FROM b""",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}

"""Evidence of values: building it, its places in documents, joining it with reviews and documents, layouts of sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from plotwise.functions.scalars import METRICS, blank, column_number
from plotwise.session import broadcast_if_small, materialize


def build(df: DataFrame, refs: dict[str, str], *keys: str) -> DataFrame:
    """(keys, evidence): a map field -> struct(metric_code, value, unit, sheet, cell) where both value and 'sheet!cell' exist.

    refs: metric field -> name of the column with its reference.
    """
    def entry(m: str, ref: str):
        code, unit = METRICS[m]
        at = F.col(ref)
        e = F.struct(F.lit(code).alias("metric_code"), F.col(m).alias("value"), F.lit(unit).alias("unit"), F.regexp_extract(at, r"(?s)\A(.*)!", 1).alias("sheet"), F.regexp_extract(at, r"!([^!]*)\z", 1).alias("cell"))
        return F.when(F.col(m).isNotNull() & at.contains("!"), F.struct(F.lit(m).alias("field"), e.alias("e")))

    entries = F.filter(F.array(*(entry(m, r) for m, r in refs.items())), lambda x: x.isNotNull())
    return df.select(*keys, F.map_from_entries(entries).alias("evidence"))


def latest_review(ledger: DataFrame, key: str, order: str) -> DataFrame:
    """The last entry of each key."""
    rest = [c for c in ledger.columns if c != key]
    return ledger.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_v")).select(key, "_v.*")


def with_reviews(evidence: DataFrame, ledger: DataFrame, key: str, order: str, default: str = "pending") -> DataFrame:
    """evidence with `status`: that of its last ledger entry, else the default."""
    last = latest_review(ledger.select(key, order, F.col("status").alias("_status")), key, order).select(key, "_status")
    return evidence.join(last, key, "left").withColumn("status", F.coalesce("_status", F.lit(default))).drop("_status")


def status_counts(df: DataFrame, status: str, known: tuple[str, ...] = ("approved", "rejected", "not_required", "pending")) -> DataFrame:
    """(status, n): every known status, unknown and null ones as pending."""
    s = F.when(F.col(status).isin(*known), F.col(status)).otherwise(F.lit("pending"))
    one = df.agg(*(F.coalesce(F.sum(F.when(s == k, 1).otherwise(0)), F.lit(0)).alias(k) for k in known))
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("status"), F.col(k).alias("n")) for k in known))))


def sheet_layout(cells: DataFrame, *keys: str, value: str = "value") -> DataFrame:
    """(keys, max_row, max_column, non_empty_cells) of cell references such as AB12; other texts don't count.

    Cells whose value is null or empty belong to the extent, but aren't counted.
    """
    ok = cells.where(F.col("cell").rlike(r"\A[A-Z]{1,3}[0-9]+\z"))
    filled = F.when(~blank(F.col(value).cast("string")), F.col("cell"))
    return ok.groupBy(*keys).agg(F.max(F.regexp_extract("cell", "[0-9]+", 0).cast("int")).alias("max_row"), F.max(column_number(F.regexp_extract("cell", "[A-Z]+", 0))).alias("max_column"), F.count_distinct(filled).alias("non_empty_cells"))


def unmatched(df: DataFrame, reference: DataFrame, key: str, ref_key: str) -> DataFrame:
    """Rows whose key the reference lacks; rows with a null key are unmatched too."""
    return df.join(reference.select(F.col(ref_key).alias(key)).distinct(), key, "left_anti")


def catalog(documents: DataFrame, evidence: DataFrame, group: str) -> DataFrame:
    """(group, documents, evidence, cited): documents and evidence items per group; evidence is counted per document first."""
    per_doc = evidence.where(~blank(F.col("source_document_id"))).groupBy(F.col("source_document_id").alias("document_id")).agg(F.count(F.lit(1)).alias("k"))
    met = documents.select("document_id", group).join(per_doc, "document_id", "left")
    return met.groupBy(group).agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("k"), F.lit(0)).alias("evidence"), F.count("k").alias("cited"))


def relinked(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, doc_before, doc_after): equal values whose documents are given on both sides and differ."""
    a = before.select(*keys, F.col("value").alias("_va"), F.col("source_document_id").alias("doc_before"))
    b = after.select(*keys, F.col("value").alias("_vb"), F.col("source_document_id").alias("doc_after"))
    return a.join(b, keys).where(F.col("_va").eqNullSafe(F.col("_vb")) & ~blank(F.col("doc_before")) & ~blank(F.col("doc_after")) & (F.col("doc_before") != F.col("doc_after"))).select(*keys, "doc_before", "doc_after")


def reduced_status(df: DataFrame, status: str, *keys: str) -> DataFrame:
    """(keys, status): changed if any is, unchanged if all are, else new."""
    s = F.col(status)
    any_changed = F.coalesce(F.bool_or(s == "changed"), F.lit(False))
    all_same = F.coalesce(F.bool_and(F.coalesce(s == "unchanged", F.lit(False))), F.lit(False))
    return df.groupBy(*keys).agg(F.when(any_changed, F.lit("changed")).when(all_same, F.lit("unchanged")).otherwise(F.lit("new")).alias("status"))


def history_histogram(df: DataFrame, key: str) -> DataFrame:
    """(length, n): how many keys have 1 to N rows, N the longest history there is; lengths that none has are 0."""
    sizes = materialize(df.where(F.col(key).isNotNull()).groupBy(key).count().groupBy(F.col("count").alias("length")).agg(F.count(F.lit(1)).alias("k")))
    longest = sizes.agg(F.max("length")).first()[0] or 0
    every = df.sparkSession.range(1, longest + 1).select(F.col("id").alias("length"))
    return every.join(broadcast_if_small(sizes, 24), "length", "left").select("length", F.coalesce("k", F.lit(0)).alias("n"))


def drift(current: DataFrame, baseline: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """(key, state): new, unchanged or changed against the baseline."""
    b = baseline.select(key, F.col(fingerprint).alias("_b"))
    state = F.when(F.col("_b").isNull(), F.lit("new")).when(F.col("_b") == F.col(fingerprint), F.lit("unchanged")).otherwise(F.lit("changed"))
    return current.join(b, key, "left").select(key, state.alias("state"))


def previous_run(runs: DataFrame) -> DataFrame:
    """(run_id, same_inputs_as): the newest earlier successful run with the same idempotency key."""
    w = Window.partitionBy("idempotency_key").orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)
    return runs.select("run_id", F.max(F.when(F.col("status") == "succeeded", F.col("run_id"))).over(w).alias("same_inputs_as"))

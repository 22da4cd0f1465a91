"""The life of a review: items of supplements, a ledger of decisions on them, and the audit of import runs.

A ledger is (evidence_id, status, reviewed_by, reviewed_at, note). Ledgers are never changed in place: each step gives a new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plotwise.functions.scalars import blank
from plotwise.operators.evidence import with_reviews

#: What a review may decide, and the states of the summary.
DECISIONS = ("approved", "rejected", "not_required")
STATES = ("pending", *DECISIONS)
LEDGER = "evidence_id string, status string, reviewed_by string, reviewed_at string, note string"


def item_id(item: Column) -> Column:
    """ev- and 32 hex digits over what an item says and where it stands, not over who reviewed or read it when."""
    loc = item["locator"]
    said = F.struct(*(item[c].alias(c) for c in ("metric_code", "observed_at", "source_document_id", "unit", "value")), *(loc[c].alias(f"locator_{c}") for c in ("bbox", "cell", "cell_range", "page", "sheet", "type")))
    return F.concat(F.lit("ev-"), F.substring(F.sha2(F.encode(F.to_json(said, {"ignoreNullFields": "false"}), "UTF-8"), 256), 1, 32))


def flattened(supplements: DataFrame, *keys: str) -> DataFrame:
    """(keys, evidence_id, context_type, context_label, field, event_type, item): the items of portfolio_metrics and of property_events.

    portfolio_metrics: ARRAY of struct(metric_code, evidence); property_events: ARRAY of struct(property_name, event_type,
    evidence MAP). Items without a metric code are none. One pass; nothing is shuffled.
    """
    null = F.lit(None).cast("string")

    def of_event(v: Column) -> Column:
        return F.transform(F.map_entries(v["evidence"]), lambda e: F.struct(F.lit("property_event").alias("context_type"), v["property_name"].alias("context_label"), e["key"].alias("field"), v["event_type"].alias("event_type"), e["value"].alias("item")))

    metrics = F.transform("portfolio_metrics", lambda m: F.struct(F.lit("portfolio_metric").alias("context_type"), m["metric_code"].alias("context_label"), null.alias("field"), null.alias("event_type"), m["evidence"].alias("item")))
    events = F.flatten(F.filter(F.transform("property_events", of_event), lambda xs: xs.isNotNull()))
    both = F.flatten(F.filter(F.array(metrics, events), lambda xs: xs.isNotNull()))
    some = F.filter(both, lambda x: ~blank(x["item"]["metric_code"]))
    rows = supplements.select(*keys, F.inline(some))
    return rows.withColumn("evidence_id", item_id(F.col("item")))


def upserted(ledger: DataFrame, entries: DataFrame) -> DataFrame:
    """The ledger with the entries in place of those of the same evidence.

    entries: the ledger's columns; of several for one evidence the last reviewed_at counts. A status that is no decision and a
    blank reviewer are errors when the result is read; reviewer and note are trimmed, a blank note is null.
    """
    check = F.when(~F.coalesce(F.col("status").isin(*DECISIONS), F.lit(False)), F.raise_error(F.concat(F.lit("unsupported review status: "), F.coalesce("status", F.lit("null"))))).when(blank(F.trim("reviewed_by")), F.raise_error(F.lit("the reviewer must not be blank")))
    note = F.trim("note")
    checked = entries.select("evidence_id", F.coalesce(check.cast("string"), F.col("status")).alias("status"), F.trim("reviewed_by").alias("reviewed_by"), "reviewed_at", F.when(note != "", note).alias("note"))
    last = checked.groupBy("evidence_id").agg(F.max_by(F.struct("status", "reviewed_by", "reviewed_at", "note"), F.coalesce("reviewed_at", F.lit(""))).alias("v")).select("evidence_id", "v.*")
    return ledger.select(*last.columns).join(last.select("evidence_id"), "evidence_id", "left_anti").unionByName(last)


def cleared(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    """The ledger without the reviews of these evidence ids."""
    return ledger.join(ids.select("evidence_id"), "evidence_id", "left_anti")


def listing(items: DataFrame, ledger: DataFrame, own_status: str = "own_status", order: str = "reviewed_at") -> DataFrame:
    """items with `status`: the ledger's last decision, else the item's own status, else pending."""
    met = with_reviews(items, ledger, "evidence_id", order, default="")
    return met.withColumn("status", F.coalesce(F.when(F.col("status") != "", F.col("status")), F.col(own_status), F.lit("pending")))


def summary(items: DataFrame, *keys: str) -> DataFrame:
    """(keys, total, pending, approved, rejected, not_required) by status; a status that is none of them is pending."""
    s = F.when(F.col("status").isin(*DECISIONS), F.col("status")).otherwise(F.lit("pending"))
    return items.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(s == k).alias(k) for k in STATES))


def resolve_prefix(items: DataFrame, prefix: str) -> str:
    """The one evidence id that begins so; ValueError where none or several do. At most two ids leave the executors."""
    found = [r[0] for r in items.where(F.startswith("evidence_id", F.lit(prefix))).select("evidence_id").distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{'no' if not found else 'more than one'} evidence id begins with {prefix}")
    return found[0]


# --- audit of import runs -----------------------------------------------------------------------------------------------------


def idempotency_keys(assets: DataFrame) -> DataFrame:
    """(run_id, idempotency_key): a digest of what a run has read: each adapter with its version and its files' hashes and layouts, in order.

    assets: run_id, adapter_place, adapter_id, adapter_version, asset_place, sha256, layout_fingerprint. A run reads few files.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    one = F.struct("adapter_place", "asset_place", F.concat_ws("|", *map(text, ("adapter_id", "adapter_version", "sha256", "layout_fingerprint"))).alias("line"))
    lines = F.transform(F.sort_array(F.collect_list(one)), lambda x: x["line"])
    return assets.groupBy("run_id").agg(F.sha2(F.encode(F.array_join(lines, "\n"), "UTF-8"), 256).alias("idempotency_key"))


def baselines(old: DataFrame, current: DataFrame, key: str = "key", fingerprint: str = "fingerprint") -> tuple[DataFrame, DataFrame]:
    """(states, new): each current layout new, unchanged or changed against the old fingerprints, and the fingerprints from now on."""
    met = old.select(key, F.col(fingerprint).alias("_o")).join(current.select(key, F.col(fingerprint).alias("_c")), key, "full")
    state = F.when(F.col("_o").isNull(), "new").when(F.col("_o") == F.col("_c"), "unchanged").otherwise("changed")
    return met.where("_c is not null").select(key, state.alias("state")), met.select(key, F.coalesce("_c", "_o").alias(fingerprint))


def run_totals(results: DataFrame) -> DataFrame:
    """(run_id, adapters, properties, issues) over one row for each adapter of a run: run_id, adapter_id, properties, issues."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return results.groupBy("run_id").agg(F.count_distinct("adapter_id").alias("adapters"), n("properties"), n("issues"))

"""What differs between two states of a dataset, from properties down to single values, as one table of events and its roll-ups.

A dataset is properties (id, MASTER fields) and periods (id, as_of_date, period_no, period, pos, METRICS, and optionally docs, a
map metric -> document). Each level is one full outer join on its key; the roll-ups aggregate the events, never the data.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plotwise.functions.scalars import METRICS, blank
from plotwise.operators.changes import MASTER, last_wins
from plotwise.operators.quality import UNCLASSIFIED

EVENTS = "property_id string, grp string, kind string, period_key string, field string, before_text string, after_text string, before double, after double"
#: Kinds of events, as the totals count them.
KINDS = ("properties_added", "properties_removed", "master_field_changes", "periods_added", "periods_removed", "metric_values_added", "metric_values_removed", "metric_values_changed", "evidence_relinked")


@dataclass(frozen=True)
class Dataset:
    properties: DataFrame
    periods: DataFrame


def diff_key(as_of: Column, period_no: Column, period: Column) -> Column:
    """A period's key in comparisons: its date or `undated`, and its number, else its label, else `unlabelled`."""
    some = lambda c: F.when(~blank(c), c)
    return F.concat_ws("|", F.coalesce(some(as_of), F.lit("undated")), F.coalesce(period_no.cast("string"), some(period), F.lit("unlabelled")))


def _plain(m: str) -> Column:
    v = F.col(m).cast("double")
    return F.when(~F.isnan(v), v)


def _periods(d: Dataset) -> DataFrame:
    docs = F.col("docs") if "docs" in d.periods.columns else F.lit(None).cast("map<string,string>")
    return d.periods.where("id is not null").select("id", "pos", diff_key(F.col("as_of_date"), F.col("period_no"), F.col("period")).alias("key"), F.struct(*(_plain(m).alias(m) for m in METRICS), docs.alias("docs")).alias("v"))


def _event(kind: str | Column, period: Column | None = None, field: Column | str | None = None, texts: tuple | None = None, values: tuple | None = None) -> Column:
    text, number = (lambda c: c.cast("string") if c is not None else F.lit(None).cast("string")), (lambda c: c.cast("double") if c is not None else F.lit(None).cast("double"))
    field = F.lit(field) if isinstance(field, str) else field
    a, b = texts or (None, None)
    x, y = values or (None, None)
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), text(period).alias("period_key"), text(field).alias("field"), text(a).alias("before_text"), text(b).alias("after_text"), number(x).alias("before"), number(y).alias("after"))


def _values(kind: str, period: Column, v: Column, added: bool) -> list[Column]:
    return [F.when(v[m].isNotNull(), _event(kind, period, m, values=(None, v[m]) if added else (v[m], None))) for m in METRICS]


def _given(events: list[Column]) -> Column:
    return F.filter(F.array(*events), lambda e: e.isNotNull())


def events(before: Dataset, after: Dataset, group: str = "reit") -> DataFrame:
    """All differences (EVENTS). Of repeated ids and of repeated periods of a shared property the last counts; blank ids don't.

    Periods and values of added and removed properties count as added and removed. NaN counts as null, and a value differs by
    any amount. A value that is the same is relinked if both documents are given and differ.
    """
    side = lambda d: last_wins(d.properties.select("id", "pos", group, *(c for c in MASTER if c != group)), ["id"], "pos")
    fields = lambda c: F.struct(*(F.col(m).cast("string").alias(m) for m in MASTER)).alias(c)
    grp = lambda c: F.when(~blank(F.col(group)), F.col(group)).alias(c)
    both = side(before).select("id", fields("a"), grp("ga")).join(side(after).select("id", fields("b"), grp("gb")), "id", "full")
    state = F.when(F.col("a").isNull(), F.lit("added")).when(F.col("b").isNull(), F.lit("removed")).otherwise(F.lit("shared"))
    both = both.select("id", state.alias("state"), F.coalesce("gb", "ga", F.lit(UNCLASSIFIED)).alias("grp"), "a", "b")
    master = [F.when((F.col("state") == "shared") & ~F.col("a")[m].eqNullSafe(F.col("b")[m]), _event("master_field_changes", field=m, texts=(F.col("a")[m], F.col("b")[m]))) for m in MASTER]
    whole = F.when(F.col("state") != "shared", _event(F.concat(F.lit("properties_"), F.col("state"))))
    out = [both.select("id", "grp", F.inline(_given([whole, *master])))]

    states = both.select("id", "state", "grp")
    a, b = _periods(before), _periods(after)
    key = F.col("key")
    for rows, name in ((b, "added"), (a, "removed")):
        met = rows.join(states.where(F.col("state") == name), "id")
        out.append(met.select("id", "grp", F.inline(_given([_event(f"periods_{name}", key), *_values(f"metric_values_{name}", key, F.col("v"), name == "added")]))))
    shared = states.where("state = 'shared'").select("id", "grp")
    last = lambda d, c: last_wins(d, ["id", "key"], "pos").select("id", "key", F.col("v").alias(c))
    met = last(a, "x").join(last(b, "y"), ["id", "key"], "full").join(shared, "id")
    x, y = F.col("x"), F.col("y")

    def value(m: str) -> list[Column]:
        kind = F.when(x[m].isNull(), F.lit("metric_values_added")).when(y[m].isNull(), F.lit("metric_values_removed")).otherwise(F.lit("metric_values_changed"))
        da, db = F.try_element_at(x["docs"], F.lit(m)), F.try_element_at(y["docs"], F.lit(m))
        linked = x[m].isNotNull() & ~blank(da) & ~blank(db) & (da != db)
        differs = ~x[m].eqNullSafe(y[m])
        return [F.when(differs, _event(kind, key, m, values=(x[m], y[m]))).when(linked, _event("evidence_relinked", key, m, texts=(da, db), values=(x[m], y[m])))]

    one_side = F.when(x.isNull(), _given([_event("periods_added", key), *_values("metric_values_added", key, y, True)])).when(y.isNull(), _given([_event("periods_removed", key), *_values("metric_values_removed", key, x, False)]))
    out.append(met.select("id", "grp", F.inline(F.when(x.isNull() | y.isNull(), one_side).otherwise(_given([e for m in METRICS for e in value(m)])))))
    return reduce(DataFrame.unionByName, out).withColumnRenamed("id", "property_id")


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts of all kinds, and of shared properties with any difference, each once. Events are combined by property first."""
    per = rows.groupBy(*keys, "property_id").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in KINDS))
    changed = (F.col("properties_added") + F.col("properties_removed")) == 0
    return per.groupBy(*keys).agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in KINDS), F.count_if(changed).alias("properties_changed"))


def by_group(rows: DataFrame) -> DataFrame:
    """(grp, the kinds, properties_changed) of the groups in which anything differs; master fields count in the totals only."""
    return _counted(rows, "grp").where(" + ".join(KINDS) + " > 0").drop("master_field_changes")


def by_metric(rows: DataFrame) -> DataFrame:
    """(field, added, removed, changed, evidence_relinked) of every metric, zeros included."""
    n = lambda k: F.count_if(F.col("kind") == k)
    some = rows.groupBy("field").agg(n("metric_values_added").alias("added"), n("metric_values_removed").alias("removed"), n("metric_values_changed").alias("changed"), n("evidence_relinked").alias("evidence_relinked"))
    return rows.sparkSession.createDataFrame([(m,) for m in METRICS], "field string").join(some, "field", "left").fillna(0)


def totals(rows: DataFrame, before: Dataset, after: Dataset) -> DataFrame:
    """One row: properties on both sides, the kinds, properties_changed and the status: changed if there is any event, else unchanged."""
    size = lambda d, c: d.properties.where(~blank(F.col("id"))).agg(F.count_distinct("id").alias(c))
    t = _counted(rows).join(size(before, "previous_properties")).join(size(after, "current_properties"))  # one row each
    return t.withColumn("status", F.when(sum((F.col(k) for k in KINDS), F.lit(0)) > 0, F.lit("changed")).otherwise(F.lit("unchanged")))


def baseline(after: Dataset) -> DataFrame:
    """The totals of a first delivery, which there is nothing to compare with: no differences, status `baseline`."""
    one = after.properties.where(~blank(F.col("id"))).agg(F.count_distinct("id").alias("current_properties"))
    return one.select(*(F.lit(0).cast("bigint").alias(k) for k in (*KINDS, "properties_changed", "previous_properties")), "current_properties", F.lit("baseline").alias("status"))

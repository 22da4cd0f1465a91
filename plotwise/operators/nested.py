"""Deeply nested JSON records turned into flat tables that keep the links from child to parent.

One higher-order projection per record: nested transform() calls attach the record's key and the place of each ancestor,
flatten() joins the arrays, and one inline() per target table emits its rows. Nothing is shuffled: a record's rows are made
where the record is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_ITEMS = "array<struct<field:string,item_pos:int,item:variant>>"


def _as_map(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _as_list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _text(v: Column, path: str) -> Column:
    """A scalar at the path as text, '' where it is missing, null or no scalar."""
    return F.coalesce(F.when(F.try_variant_get(v, path, "map<string,variant>").isNull() & F.try_variant_get(v, path, "array<variant>").isNull(), F.try_variant_get(v, path, "string")), F.lit(""))


def _let(value: Column, then) -> Column:
    """then(value) with value computed once."""
    return F.transform(F.array(value), then)[0]


def complete_json(text: Column) -> Column:
    """The text's JSON, null unless the whole text is one JSON value; the parser alone would overlook what follows it."""
    return _let(_as_list(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))), lambda xs: F.when(F.size(xs) == 1, xs[0]))


def decoded(v: Column) -> Column:
    """The value, or, where it is a text that holds JSON, that JSON."""
    is_nested = _as_map(v).isNotNull() | _as_list(v).isNotNull()
    return F.when(is_nested, v).otherwise(F.coalesce(complete_json(F.try_variant_get(v, "$", "string")), v))


def evidence_items(evidence: Column) -> Column:
    """Evidence in any of its shapes as an array of (field, item_pos, item).

    An object of field -> item or list of items, or a list of items with a member `field`; either as itself or as a text
    that holds it. Values that aren't objects are no items and don't count in item_pos; null evidence gives an empty array.
    """
    objects = lambda xs: F.filter(F.transform(xs, decoded), lambda x: _as_map(x).isNotNull())

    def of_object(v: Column) -> Column:
        def of_field(e: Column) -> Column:
            return _let(decoded(e["value"]), lambda x: F.transform(objects(F.coalesce(_as_list(x), F.array(x))), lambda y, i: F.struct(e["key"].alias("field"), i.cast("int").alias("item_pos"), y.alias("item"))))

        return F.flatten(F.transform(F.map_entries(_as_map(v)), of_field))

    def of_list(v: Column) -> Column:
        named = F.transform(objects(_as_list(v)), lambda x: F.struct(_text(x, "$.field").alias("field"), x.alias("item")))

        def by_field(xs: Column) -> Column:
            return F.flatten(F.transform(F.array_distinct(F.transform(xs, lambda x: x["field"])), lambda f: F.transform(F.filter(xs, lambda x: x["field"] == f), lambda x, i: F.struct(f.alias("field"), i.cast("int").alias("item_pos"), x["item"].alias("item")))))

        return _let(named, by_field)

    items = _let(decoded(evidence), lambda v: F.when(_as_map(v).isNotNull(), of_object(v)).when(_as_list(v).isNotNull(), of_list(v)))
    return F.coalesce(items, F.array().cast(_ITEMS))


def parsed(df: DataFrame, key: str, body: str) -> DataFrame:
    """(record_id, doc, periods): bodies that are complete JSON objects. Null, broken and other bodies leave no row.

    periods are (period_pos, period) of the body's list `periods`; elements keep their place even if they are null.
    """
    doc = df.select(F.col(key).alias("record_id"), complete_json(F.col(body)).alias("doc")).where(_as_map(F.col("doc")).isNotNull())
    periods = F.coalesce(_as_list(decoded(F.try_variant_get("doc", "$.periods", "variant"))), F.array().cast("array<variant>"))
    return doc.withColumn("periods", F.transform(periods, lambda p, i: F.struct(i.cast("int").alias("period_pos"), decoded(p).alias("period"))))


def records(df: DataFrame, key: str = "record_id", body: str = "body") -> DataFrame:
    """One row for each complete body: record_id and the record's own members."""
    doc = F.col("doc")
    return parsed(df, key, body).select(
        "record_id", *(_text(doc, f"$.{c}").alias(c) for c in ("record_version", "property_id", "reit_code")),
        _text(doc, "$.reporting_period.label").alias("period_label"), _text(doc, "$.reporting_period.as_of_date").alias("as_of_date"),
        _text(doc, "$.quality.status").alias("quality_status"), F.size("periods").alias("n_periods"),
    )


def periods(df: DataFrame, key: str = "record_id", body: str = "body") -> DataFrame:
    """One row for each element of a body's periods: record_id, period_pos and the period's own members."""
    rows = F.transform("periods", lambda p: F.struct(
        p["period_pos"].alias("period_pos"), F.try_variant_get(p["period"], "$.period_no", "int").alias("period_no"),
        _text(p["period"], "$.period").alias("period"), _text(p["period"], "$.as_of_date").alias("as_of_date"),
    ))
    return parsed(df, key, body).select("record_id", F.inline(rows))


def evidence(df: DataFrame, key: str = "record_id", body: str = "body") -> DataFrame:
    """One row for each evidence item: record_id, period_pos (-1: the record's own), field, item_pos and the item's members.

    Texts that are missing or null are '', numbers null. Repeated records give repeated rows; extra columns don't matter.
    """
    parents = F.concat(F.array(F.struct(F.lit(-1).alias("period_pos"), F.col("doc").alias("period"))), F.col("periods"))

    def of_parent(p: Column) -> Column:
        def row(x: Column) -> Column:
            item = x["item"]
            return F.struct(
                p["period_pos"].alias("period_pos"), x["field"].alias("field"), x["item_pos"].alias("item_pos"),
                _text(item, "$.source_document_id").alias("source_document_id"), _text(item, "$.locator.cell").alias("cell"), _text(item, "$.extraction.parser").alias("parser"),
                _text(item, "$.metric_code").alias("metric_code"), F.try_variant_get(item, "$.value", "double").alias("value"), _text(item, "$.unit").alias("unit"),
                _text(item, "$.locator.sheet").alias("sheet"), F.try_variant_get(item, "$.locator.page", "int").alias("page"), _text(item, "$.review.status").alias("review_status"),
            )

        return F.transform(evidence_items(F.try_variant_get(p["period"], "$.evidence", "variant")), row)

    return parsed(df, key, body).select("record_id", F.inline(F.flatten(F.transform(parents, of_parent))))


def source_evidence(df: DataFrame) -> DataFrame:
    """source_evidence flat: evidence_id, property_id, field and the members of locator and extraction, '' where missing."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return df.select(
        "evidence_id", "property_id", "field", text("source_document_id").alias("source_document_id"), text("locator.sheet").alias("sheet"), F.col("locator.page").alias("page"), text("locator.cell").alias("cell"),
        text("extraction.parser").alias("parser"), text("extraction.parser_version").alias("parser_version"), F.col("extraction.confidence").alias("confidence"), text("review.status").alias("review_status"),
    )

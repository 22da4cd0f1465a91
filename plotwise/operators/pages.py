"""Operators over pages of documents and the words on them: structure and drift of layouts, labels to numbers, figures with evidence.

pages: doc, page, width, height, chars, words, tables, images and text. words: doc, page, word_id, text, x0, top, x1, bottom.
A reader of any format can fill these tables; nothing here depends on one. Pages and words stay in the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plotwise.functions.scalars import round_to, token_number
from plotwise.session import broadcast_if_small, materialize

#: How far a number may stand off a label's row, in points; how far below and aside in the next row; what a next row
#: costs; how far before the label's end a number of its row may begin.
SAME_ROW, NEAR_ROW, NEXT_ROW, ASIDE, NEXT_ROW_COST, OVERLAP = 5.5, 6.0, 24.0, 80.0, 80.0, 2.0
#: Characters of a page that has text; sizes of the bands of characters and of words.
TEXT_CHARS, CHAR_BAND, WORD_BAND = 20, 100, 25
#: Confidence of a figure from a table's row, and of one found beside a label.
ROW_CONFIDENCE, NEAR_CONFIDENCE = 0.98, 0.9



def _x() -> Column:
    return (F.col("x0") + F.col("x1")) / 2


def _y() -> Column:
    return (F.col("top") + F.col("bottom")) / 2


def structure(pages: DataFrame) -> DataFrame:
    """(doc, page, width, height, chars, words, tables, images) with sizes to a tenth and missing counts as 0."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return pages.select("doc", "page", F.bround("width", 1).alias("width"), F.bround("height", 1).alias("height"), *map(n, ("chars", "words", "tables", "images")))


def layout(pages: DataFrame) -> DataFrame:
    """(doc, pages, text_pages, low_text_pages, requires_ocr, table_pages, fingerprint) of each document.

    The fingerprint holds sizes, bands of characters and words, and counts of tables and images, page by page, so that other
    figures on the same pages don't change it. A document's pages are few; its page structures are put together in one row.
    """
    p = structure(pages)
    texty = F.col("chars") >= TEXT_CHARS
    band = lambda c, size: round_to(F.col(c).cast("double"), size).cast("bigint")
    one = F.struct("page", F.concat_ws("|", "page", "width", "height", band("chars", CHAR_BAND), band("words", WORD_BAND), "tables", "images").alias("line"))
    out = p.groupBy("doc").agg(F.count(F.lit(1)).alias("pages"), F.count_if(texty).alias("text_pages"), F.sort_array(F.collect_list(one)).alias("all"), F.sort_array(F.collect_set(F.when(F.col("tables") > 0, F.col("page")))).alias("table_pages"))
    digest = F.sha2(F.encode(F.array_join(F.transform("all", lambda x: x["line"]), "\n"), "UTF-8"), 256)
    return out.select("doc", "pages", "text_pages", (F.col("pages") - F.col("text_pages")).alias("low_text_pages"), (F.col("text_pages") == 0).alias("requires_ocr"), "table_pages", digest.alias("fingerprint"))


def validated(layouts: DataFrame, min_pages: int = 1, max_pages: int | None = None, min_text_pages: int = 1, table_pages: tuple[int, ...] = ()) -> DataFrame:
    """layouts with missing_table_pages, reasons and status: ocr_required before compatible (no reasons) before incompatible."""
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, sorted(table_pages))).cast("array<int>"), F.col("table_pages").cast("array<int>")))
    broken = {"too_few_pages": F.col("pages") < min_pages, "too_many_pages": F.col("pages") > max_pages if max_pages is not None else F.lit(False), "insufficient_text_pages": F.col("text_pages") < min_text_pages, "missing_required_tables": F.size("missing_table_pages") > 0}
    reasons = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in broken.items())), lambda r: r.isNotNull())
    out = layouts.withColumn("missing_table_pages", missing).withColumn("reasons", reasons)
    return out.withColumn("status", F.when(F.col("requires_ocr"), "ocr_required").when(F.size("reasons") == 0, "compatible").otherwise("incompatible"))


def first_match(words: DataFrame, needle: str, page: int | None = None) -> DataFrame:
    """(doc, page, text, x0, top, x1, bottom): the first literal match in each document, its words' boxes put together.

    Words are read in the order of word_id; a match may run over several words that follow one another without a space between.
    An empty needle is an error.
    """
    if not needle:
        raise ValueError("the text looked for must not be empty")
    w = Window.partitionBy("doc", "page").orderBy("word_id")
    # A match begins in a word and needs no more words than it has characters.
    ahead = F.collect_list(F.struct("text", "x0", "top", "x1", "bottom")).over(w.rowsBetween(0, len(needle) - 1))
    some = (words if page is None else words.where(F.col("page") == page)).where(F.length("text") > 0)
    rows = some.withColumn("ahead", ahead).withColumn("joined", F.array_join(F.transform("ahead", lambda x: x["text"]), ""))
    at = F.instr("joined", needle)
    rows = rows.withColumn("at", at).where((F.col("at") > 0) & (F.col("at") <= F.length("text")))
    until = F.col("at") + len(needle) - 1
    ends = F.transform("ahead", lambda _, i: F.length(F.array_join(F.transform(F.slice("ahead", F.lit(1), i + 1), lambda x: x["text"]), "")))
    used = F.slice("ahead", F.lit(1), F.size(F.filter(ends, lambda e: e < until)) + 1)
    box = lambda c, f: f(F.transform(used, lambda x: x[c])).alias(c)
    found = rows.select("doc", "page", "word_id", F.lit(needle).alias("text"), box("x0", F.array_min), box("top", F.array_min), box("x1", F.array_max), box("bottom", F.array_max))
    return found.groupBy("doc").agg(F.min_by(F.struct("page", "text", "x0", "top", "x1", "bottom"), F.struct("page", "word_id")).alias("m")).select("doc", "m.*")


def anchor_page(pages: DataFrame, anchors: list[str]) -> DataFrame:
    """(doc, page): the first page of each document whose text holds all anchors."""
    hit = F.lit(True)
    for a in anchors:
        hit = hit & F.contains("text", F.lit(a))
    return pages.where(hit).groupBy("doc").agg(F.min("page").alias("page"))


def numbers(words: DataFrame) -> DataFrame:
    """The words that are numbers as a whole, with value, nx0, cx and cy, the centre."""
    return words.withColumn("value", token_number(F.regexp_replace(F.trim("text"), " ", ""))).where("value is not null").select("doc", "page", F.col("word_id").alias("number_id"), "value", F.col("x0").alias("nx0"), _x().alias("cx"), _y().alias("cy"))


def _meet(labels: DataFrame, words: DataFrame, reach: float) -> DataFrame:
    """Labels (ly) with the numbers of their page at most reach away in height: an equi-join on strips of the page."""
    strip = lambda c: F.floor(F.col(c) / reach).cast("bigint")
    near = labels.withColumn("strip", F.explode(F.sequence(strip("ly") - 1, strip("ly") + 1)))
    return near.join(numbers(words).withColumn("strip", strip("cy")), ["doc", "page", "strip"]).drop("strip")


def _labels(words: DataFrame, labels: list[str]) -> DataFrame:
    return words.where(F.col("text").isin(labels)).select("doc", "page", F.col("word_id").alias("label_id"), F.col("x0").alias("lx0"), F.col("x1").alias("lx1"), _x().alias("lx"), _y().alias("ly"))


def row_numbers(words: DataFrame, labels: list[str]) -> DataFrame:
    """(doc, page, label_id, lx0, number_id, value, place, in_row): numbers right of a label in its row, in order from 0, and how many."""
    met = _meet(_labels(words, labels), words, SAME_ROW).where((F.abs(F.col("cy") - F.col("ly")) <= SAME_ROW) & (F.col("nx0") > F.col("lx1")))
    row = Window.partitionBy("doc", "page", "label_id")
    return met.withColumn("place", F.row_number().over(row.orderBy("nx0", "number_id")) - 1).withColumn("in_row", F.count(F.lit(1)).over(row)).select("doc", "page", "label_id", "lx0", "number_id", "value", "place", "in_row")


def row_value(words: DataFrame, labels: list[str], index: int) -> DataFrame:
    """(doc, page, number_id, value): the number at `index` of a label's row; of several rows the one with most numbers, then the left-most."""
    rows = row_numbers(words, labels).where(F.col("place") == index)
    best = F.max_by(F.struct("number_id", "value"), F.struct("in_row", -F.col("lx0"), -F.col("label_id")))
    return rows.groupBy("doc", "page").agg(best.alias("b")).select("doc", "page", "b.*")


def near_value(words: DataFrame, anchor: str, labels: list[str]) -> DataFrame:
    """(doc, page, number_id, value): the number that belongs to a label near an anchor.

    The label is the one whose centre is nearest to that of the page's first anchor. Its number stands in its row, beginning no
    more than OVERLAP before the label's end, or in the row below; the nearest by the centres wins, rows below at a cost.
    """
    first = words.where(F.col("text") == anchor).groupBy("doc", "page").agg(F.min_by(F.struct(_x().alias("ax"), _y().alias("ay")), "word_id").alias("a"))
    label = _labels(words, labels).join(first, ["doc", "page"])
    off = F.hypot(F.col("lx") - F.col("a.ax"), F.col("ly") - F.col("a.ay"))
    label = label.groupBy("doc", "page").agg(F.min_by(F.struct("lx", "ly", "lx1"), F.struct(off.alias("o"), "label_id")).alias("l")).select("doc", "page", "l.*")
    met = _meet(label, words, NEXT_ROW)
    down, dx = F.col("cy") - F.col("ly"), F.col("cx") - F.col("lx")
    same = (F.abs(down) <= NEAR_ROW) & (F.col("nx0") >= F.col("lx1") - OVERLAP)
    below = (down > 0) & (down <= NEXT_ROW) & (F.abs(dx) <= ASIDE)
    cost = F.hypot(dx, down) + F.when(same, 0.0).otherwise(NEXT_ROW_COST)
    return met.where(same | below).groupBy("doc", "page").agg(F.min_by(F.struct("number_id", "value"), F.struct(cost.alias("c"), "number_id")).alias("b")).select("doc", "page", "b.*")


def pdf_locator(page: Column, bbox: Column) -> Column:
    """struct(type, page, bbox) with the box to two places; an error unless the page is at least 1 and the box has four numbers."""
    ok = (page >= 1) & (F.size(bbox) == 4)
    made = F.struct(F.lit("pdf_bbox").alias("type"), page.cast("int").alias("page"), F.transform(bbox, lambda x: F.bround(x, 2)).alias("bbox"))
    return F.when(F.coalesce(ok, F.lit(False)), made).otherwise(F.raise_error(F.lit("a place in a document needs a page from 1 on and a box of four numbers")))


def with_evidence(found: DataFrame, words: DataFrame, field: str, code: str, unit: str, confidence: float, parser: str, version: str = "1.0", multiplier: float = 1.0) -> DataFrame:
    """(doc, page, field, value, evidence) of found numbers, the value in the unit asked for and the evidence still to be reviewed."""
    if not 0 <= confidence <= 1:
        raise ValueError("confidence must be between 0 and 1")
    box = words.select("doc", "page", F.col("word_id").alias("number_id"), F.array("x0", "top", "x1", "bottom").alias("bbox"))
    value = F.col("value") * multiplier
    e = F.struct(F.lit(code).alias("metric_code"), value.alias("value"), F.lit(unit).alias("unit"), F.col("doc").alias("source_document_id"), pdf_locator(F.col("page"), F.col("bbox")).alias("locator"),
                 F.struct(F.lit(parser).alias("parser"), F.lit(version).alias("parser_version"), F.lit("deterministic_pdf_text").alias("method"), F.lit(float(confidence)).alias("confidence")).alias("extraction"),
                 F.struct(F.lit("pending").alias("status"), F.lit(None).cast("string").alias("reviewed_by"), F.lit(None).cast("string").alias("reviewed_at")).alias("review"))
    return found.join(box, ["doc", "page", "number_id"]).select("doc", "page", F.lit(field).alias("field"), value.alias("value"), e.alias("evidence"))


def events(figures: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, issues). wanted: doc, event, field; figures: doc, event, field, value, evidence.

    An event is a row (doc, event, values, evidence), both maps by field; one without any figure is dropped. Each wanted figure
    that wasn't found is an issue (doc, event, field, message).
    """
    met = wanted.select("doc", "event", "field").join(figures.select("doc", "event", "field", "value", "evidence"), ["doc", "event", "field"], "left")
    issues = met.where("evidence is null").select("doc", "event", "field", F.lit("no number found near its label").alias("message"))
    some = met.where("evidence is not null").groupBy("doc", "event")
    entry = lambda c: F.map_from_entries(F.collect_list(F.struct("field", c))).alias(f"{c}s" if c == "value" else c)
    return some.agg(entry("value"), entry("evidence")), issues


def event_sources(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, document, url, ...): the distinct sources of events by document and url, of equal ones the last."""
    rest = [c for c in rows.columns if c not in (*keys, "document", "url")]
    both = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("document", "url")})
    return both.groupBy(*keys, "document", "url").agg(F.max_by(F.struct(*rest), order).alias("v")).select(*keys, "document", "url", "v.*")


def is_pdf(content: Column) -> Column:
    """Whether a file's bytes begin as a PDF does."""
    return F.coalesce(F.substring(content, 1, 5) == F.lit("%PDF-").cast("binary"), F.lit(False))


def missing_fragments(required: DataFrame, layout_names: DataFrame, keys: list[str], fragment: str = "fragment", name: str = "name") -> DataFrame:
    """(keys, fragment): required pieces of names that no name of the same keys holds. A document has few names and pieces."""
    small = broadcast_if_small(materialize(required), 64)
    met = layout_names.select(*keys, name).join(small, keys).where(F.contains(F.col(name), F.col(fragment))).select(*keys, fragment).distinct()
    return required.join(met, [*keys, fragment], "left_anti")

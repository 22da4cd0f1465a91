"""Normalizers of issuers' workbooks: cells of sheets to properties, their periods and what doesn't fit.

cells: doc, sheet, col (number, from 1), row, num, text: one row for each cell that has a value, as sources.xlsx reads them
(columns()). A workbook has few sheets and rows; many workbooks are many keys, and every step is an aggregation or a join on doc.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plotwise.functions.scalars import METRICS, blank, canonical_name, clean_name, column_number, million_yen, numeric_text, percent_from_fraction, period_end, region_of, stable_id, zero_to_null
from plotwise.session import broadcast_if_small, materialize

#: Regions by the beginning of an address.
REGIONS = {
    "東京都": ("東京都",), "首都圏": ("神奈川県", "千葉県", "埼玉県", "茨城県", "栃木県", "群馬県"),
    "関西圏": ("大阪府", "京都府", "兵庫県", "滋賀県", "奈良県", "和歌山県"), "中部圏": ("愛知県", "岐阜県", "三重県", "静岡県"),
}
OTHER = "その他"
#: Region codes of the office issuer's list, and the tolerances of its totals.
REGION_LABELS = {1: "東京都心部", 2: "東京周辺都市部", 3: "地方都市部"}
TOLERANCES = {"price": 0.02, "book_value": 0.02, "appraisal": 0.02, "leasable_area": 5.0, "leased_area": 5.0, "tenants": 0.0}


def columns(cells: DataFrame) -> DataFrame:
    """The cells of sources.xlsx with what the normalizers read."""
    return cells.where("kind <> 'unreadable'").select(F.col("path").alias("doc"), "sheet", column_number(F.col("col")).alias("col"), "row", "num", "text")


def as_text(num: Column, text: Column) -> Column:
    """A cell as text; whole numbers without a fraction."""
    return F.coalesce(text, F.when(num == F.floor(num), num.cast("decimal(38,0)").cast("string")).otherwise(num.cast("string")))


def _cell() -> Column:
    return as_text(F.col("num"), F.col("text"))


def placed_rows(cells: DataFrame, sheet: str, numbers: dict[str, int], texts: dict[str, int]) -> DataFrame:
    """(doc, row, a column for each name): the cells of fixed columns of a sheet, by row; one aggregation."""
    wanted = cells.where((F.col("sheet") == sheet) & F.col("col").isin(*numbers.values(), *texts.values()))
    pick = lambda k, c: F.max(F.when(F.col("col") == k, c))
    return wanted.groupBy("doc", "row").agg(*(pick(k, F.col("num")).alias(n) for n, k in numbers.items()), *(pick(k, F.trim(_cell())).alias(n) for n, k in texts.items()))


def region_by_number(number: Column) -> Column:
    """The logistics issuer's region by the beginning of the property's number."""
    return F.when(number.startswith("関東圏"), "関東圏").when(number.startswith("関西圏"), "関西圏").otherwise(OTHER)


def thousand_to_million(c: Column) -> Column:
    return c / 1000


def located(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """rows with lat and lng of their address from the cache (address, lat, lng); null for addresses it doesn't know."""
    known = cache.groupBy("address").agg(F.max_by(F.struct("lat", "lng"), F.coalesce("lat", F.lit(-1e9))).alias("_at"))
    return rows.join(broadcast_if_small(materialize(known), 120), "address", "left").withColumns({"lat": F.col("_at.lat"), "lng": F.col("_at.lng")}).drop("_at")


def unknown_addresses(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """(address): what a geocoder would have to be asked for."""
    return rows.where(~blank(F.col("address"))).select("address").distinct().join(cache.select("address"), "address", "left_anti")


# --- the office issuer: a workbook for each period, incomes by column on a sheet of their own ----------------------------------

_OFFICE = {"price": 4, "book_value": 5, "appraisal": 6, "leasable_area": 7, "leased_area": 8, "tenants": 9, "occupancy": 10, "cap": 11, "discount_rate": 12, "terminal_cap_rate": 13}


def office_periods(cells: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(snapshots, issues, totals) of workbooks; documents: doc, period_no, period, as_of_date.

    Properties stand below the header row with a region code 1 to 3, an address and a price; regional subtotals are no
    properties. NOI is the column under the property's name on the income sheet, null where there is none, which is an issue,
    as are cap rates that aren't above 0 and below 20 and occupancies outside 0 to 100. totals are the workbooks' own sums.
    """
    main, income = "データシート", F.col("sheet").contains("収益")
    b = F.trim(_cell())
    header = cells.where((F.col("sheet") == main) & (F.col("col") == 2) & (F.col("row") <= 30) & b.isin("物件名称", "物件名")).groupBy("doc").agg(F.min("row").alias("header"))
    rows = placed_rows(cells, main, {"region_code": 1, **_OFFICE}, {"name": 2, "address": 3}).join(header, "doc").where(F.col("row").between(F.col("header") + 1, F.col("header") + 200))
    name = clean_name(F.col("name"))
    ok = F.col("region_code").isin(1, 2, 3) & ~F.coalesce(name.isin(*REGION_LABELS.values()), F.lit(False)) & ~blank(F.col("address")) & F.col("price").isNotNull()
    rows = rows.where(ok).withColumn("name", name).withColumn("key", canonical_name(F.col("name")))
    inc = cells.where(income)
    one = inc.groupBy("doc").agg(F.min("sheet").alias("sheet"))  # the first income sheet
    inc = inc.join(one, ["doc", "sheet"])
    top = inc.where((F.col("col") == 1) & (F.col("row") <= 30) & (b == "科目")).groupBy("doc").agg(F.min("row").alias("top"))
    noi = inc.where(F.col("col").isin(1, 2) & (F.col("row") <= 50) & F.contains(b, F.lit("NOI"))).groupBy("doc").agg(F.min("row").alias("noi_row"))
    names = inc.join(top, "doc").where("row = top").select("doc", "sheet", "col", canonical_name(_cell()).alias("key")).where("key <> ''").groupBy("doc", "key").agg(F.max("col").alias("income_col"), F.first("sheet").alias("income_sheet"))
    value = inc.join(noi, "doc").where("row = noi_row").select("doc", F.col("col").alias("income_col"), F.col("num").alias("noi"), "noi_row")
    met = rows.join(names, ["doc", "key"], "left").join(value, ["doc", "income_col"], "left").join(documents, "doc")
    yen = {c: million_yen(F.col(c)) for c in ("price", "book_value", "appraisal")}
    rate = {c: percent_from_fraction(F.col(c)) for c in ("cap", "discount_rate", "terminal_cap_rate")}
    labels = F.create_map(*(F.lit(x) for k, v in REGION_LABELS.items() for x in (float(k), v)))
    snapshots = met.withColumns({**yen, **rate, "region": F.try_element_at(labels, F.col("region_code"))})
    snapshots = snapshots.select("doc", "key", "name", "region", "address", "period_no", "period", "as_of_date", "row", *METRICS, F.col("income_col").isNotNull().alias("has_income"))
    bad = F.array(
        F.when(~F.col("has_income"), F.struct(F.lit("noi").alias("field"), F.lit(None).cast("double").alias("value"))),
        F.when(F.col("cap").isNotNull() & ~((F.col("cap") > 0) & (F.col("cap") < 20)), F.struct(F.lit("cap").alias("field"), F.col("cap").alias("value"))),
        F.when(F.col("occupancy").isNotNull() & ~F.col("occupancy").between(0, 100), F.struct(F.lit("occupancy").alias("field"), F.col("occupancy").alias("value"))),
    )
    issues = snapshots.select("doc", "period", F.col("name").alias("property"), F.inline(F.filter(bad, lambda x: x.isNotNull())))
    total = cells.where((F.col("sheet") == main) & (F.col("col") == 2) & (F.col("row") <= 40) & F.contains(_cell(), F.lit("全物件"))).groupBy("doc").agg(F.min("row").alias("row"))
    sums = placed_rows(cells, main, {c: _OFFICE[c] for c in TOLERANCES}, {}).join(total, ["doc", "row"]).drop("row")
    return snapshots.drop("has_income"), issues, sums.withColumns({c: million_yen(F.col(c)) for c in ("price", "book_value", "appraisal")})


def reconciled(snapshots: DataFrame, totals: DataFrame, *keys: str) -> DataFrame:
    """(keys, field, source, normalized, difference, tolerance, state) of each field with a tolerance: ok within it, else review."""
    own = snapshots.groupBy(*keys).agg(*(F.bround(F.sum(F.coalesce(c, F.lit(0.0))), 3).alias(f"_{c}") for c in TOLERANCES))
    cells = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("source"), F.coalesce(F.col(f"_{c}"), F.lit(0.0)).alias("normalized"), F.lit(t).alias("tolerance")) for c, t in TOLERANCES.items()))
    rows = totals.join(own, list(keys), "left").select(*keys, F.inline(cells)).withColumn("difference", F.bround(F.col("normalized") - F.col("source"), 3))
    return rows.withColumn("state", F.when(F.abs("difference") <= F.col("tolerance"), "ok").otherwise("review")).select(*keys, "field", "source", "normalized", "difference", "tolerance", "state")


def office_properties(snapshots: DataFrame, prefix: str = "NBF") -> DataFrame:
    """(id, name, region, address, METRICS, periods): the properties of the latest period with their whole history, by date.

    Properties that the latest period doesn't name are left out with their history. Periods don't repeat what the property says.
    """
    latest = snapshots.where(F.col("period_no") == snapshots.agg(F.max("period_no")).first()[0])
    current = latest.groupBy("key").agg(F.max_by(F.struct("name", "region", "address", *METRICS), "row").alias("v"))
    past = snapshots.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("as_of_date", "period_no", "period", *METRICS))).alias("periods"))  # a property has few periods
    digest = F.concat(F.lit(prefix + "-"), F.upper(F.substring(F.sha1(F.encode("key", "UTF-8")), 1, 10)))
    return current.join(past, "key").select(digest.alias("id"), "v.*", "periods")


# --- the issuer with a sheet for each metric and a column for each period --------------------------------------------------------

#: Its sheets.
METRIC_SHEETS = {
    "leasable_area": "期末賃貸可能面積", "leased_area": "期末賃貸面積", "occupancy": "期末入居率", "tenants": "期末テナント数",
    "book_value": "期末簿価", "appraisal": "鑑定機関による期末算定価格", "noi": "ＮＯＩ",
}
BASE_SHEET = "基礎データ"


def wide_periods(cells: DataFrame, latest: int = 10) -> tuple[DataFrame, DataFrame]:
    """(periods, issues): one row for each property and period from sheets that are wide in periods.

    The periods are the whole numbers in row 4 of the book value sheet, the last `latest` of them. A property needs a name, an
    address and a book value in the last period; a period counts if occupancy, book value, appraisal or NOI is given; the price
    belongs to the last period. NOI is in thousands and may be text. Properties without any period are issues.
    """
    metric = F.create_map(*(F.lit(x) for m, s in METRIC_SHEETS.items() for x in (s, m)))
    head = cells.where((F.col("sheet") == METRIC_SHEETS["book_value"]) & (F.col("row") == 4) & F.col("col").between(3, 99) & (F.col("num") == F.floor("num")))
    w = Window.partitionBy("doc").orderBy(F.desc("num"), F.desc("col"))
    head = head.withColumn("k", F.row_number().over(w)).where(F.col("k") <= latest).select("doc", "col", F.col("num").cast("int").alias("period_no"), (F.col("k") == 1).alias("is_last"))
    number = F.when(F.col("sheet") == METRIC_SHEETS["noi"], thousand_to_million(F.coalesce(F.col("num"), numeric_text(F.col("text"))))).when(F.col("sheet") == METRIC_SHEETS["occupancy"], percent_from_fraction(F.col("num"))).otherwise(F.col("num"))
    long = cells.where(F.col("sheet").isin(*METRIC_SHEETS.values()) & F.col("row").between(6, 159)).join(head, ["doc", "col"]).select("doc", "row", "period_no", "is_last", metric[F.col("sheet")].alias("m"), number.alias("v"))
    by_period = long.groupBy("doc", "row", "period_no").agg(F.max("is_last").alias("is_last"), *(F.max(F.when(F.col("m") == m, F.col("v"))).alias(m) for m in METRIC_SHEETS))
    base = placed_rows(cells, BASE_SHEET, {"price": 12}, {"name": 2, "address": 3}).where(F.col("row").between(6, 159) & ~blank(F.col("name")) & ~blank(F.col("address")))
    owned = by_period.where(F.col("is_last") & F.col("book_value").isNotNull()).select("doc", "row")
    some = F.coalesce(*(F.col(c) for c in ("occupancy", "book_value", "appraisal", "noi"))).isNotNull()
    rows = base.join(owned, ["doc", "row"]).join(by_period.where(some), ["doc", "row"])
    none = F.lit(None).cast("double")
    out = rows.select(
        "doc", "row", stable_id("JRE", canonical_name(F.col("name"))).alias("id"), "name", "address", region_of(F.col("address"), REGIONS, OTHER).alias("region"), "period_no", F.concat(F.lit("第"), F.col("period_no").cast("string"), F.lit("期")).alias("period"),
        period_end(F.col("period_no")).alias("as_of_date"), F.when(F.col("is_last"), million_yen(F.col("price"))).alias("price"), *METRIC_SHEETS, none.alias("cap"), none.alias("discount_rate"), none.alias("terminal_cap_rate"),
    )
    bare = base.join(by_period.where(some).select("doc", "row").distinct(), ["doc", "row"], "left_anti").join(owned, ["doc", "row"])
    return out, bare.select("doc", F.col("name").alias("property"), F.lit("no period").alias("message"))


# --- the logistics issuer: current and previous figures in columns of one sheet ---------------------------------------------------


def two_periods(cells: DataFrame, current: tuple[int, str, str] = (28, "第28期", "2026-02-28"), previous: tuple[int, str, str] = (27, "第27期", "2025-08-31")) -> tuple[DataFrame, DataFrame]:
    """(periods, issues): two rows for each property, the current period from three sheets and the previous one from the comparison columns.

    Rows count whose property number holds a region and a dash and that have a name and an address. A property that the
    appraisal or the income sheet doesn't know keeps nulls there and is an issue. Rates of 0 mean that there is none.
    """
    portfolio = placed_rows(cells, "ポートフォリオ一覧", {"price": 5, "leasable_area": 7, "leased_area": 8, "occupancy": 9, "tenants": 10}, {"number": 1, "name": 2, "address": 3})
    portfolio = portfolio.where(F.col("row").between(6, 179) & F.col("number").rlike("(?:圏|その他)-") & ~blank(F.col("name")) & ~blank(F.col("address")))
    appraisal = placed_rows(cells, "鑑定評価額一覧", {"appraisal": 3, "cap": 6, "discount_rate": 9, "terminal_cap_rate": 10, "book_value": 11, "p_appraisal": 13, "p_cap": 14}, {"number": 1}).where(F.col("row").between(7, 179) & ~blank(F.col("number")))
    last = appraisal.groupBy("doc", "number").agg(F.max_by(F.struct("appraisal", "cap", "discount_rate", "terminal_cap_rate", "book_value", "p_appraisal", "p_cap"), "row").alias("a"))
    sheet = cells.where((F.col("sheet") == "賃貸借の概況及び損益状況") & F.col("col").between(5, 159))
    heads = sheet.where("row = 5").select("doc", "col", F.trim(_cell()).alias("number")).groupBy("doc", "number").agg(F.max("col").alias("col"))
    noi = sheet.where("row = 16").select("doc", "col", thousand_to_million(F.coalesce(F.col("num"), numeric_text(F.col("text")))).alias("noi"))
    income = heads.join(noi, ["doc", "col"], "left").select("doc", "number", "noi", F.lit(True).alias("known"))
    met = portfolio.join(last, ["doc", "number"], "left").join(income, ["doc", "number"], "left")
    rate = lambda c: zero_to_null(percent_from_fraction(F.col(f"a.{c}")))
    none = F.lit(None).cast("double")

    def period(at: tuple[int, str, str], values: dict[str, Column]) -> Column:
        return F.struct(F.lit(at[0]).alias("period_no"), F.lit(at[1]).alias("period"), F.lit(at[2]).alias("as_of_date"), *(values.get(m, none).cast("double").alias(m) for m in METRICS))

    now = {**{c: F.col(c) for c in ("price", "leasable_area", "leased_area", "occupancy", "tenants", "noi")}, "appraisal": F.col("a.appraisal"), "book_value": F.col("a.book_value"), **{c: rate(c) for c in ("cap", "discount_rate", "terminal_cap_rate")}}
    before = {"appraisal": F.col("a.p_appraisal"), "cap": rate("p_cap")}
    rows = met.select("doc", "row", stable_id("GLP", canonical_name(F.col("name"))).alias("id"), "number", "name", "address", region_by_number(F.col("number")).alias("region"), F.inline(F.array(period(previous, before), period(current, now))))
    lacks = F.array(F.when(F.col("a").isNull(), F.lit("appraisal")), F.when(F.col("known").isNull(), F.lit("noi")))
    issues = met.select("doc", F.col("name").alias("property"), F.explode(F.filter(lacks, lambda x: x.isNotNull())).alias("field"))
    return rows, issues


def report(periods: DataFrame, located_rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, properties, periods, history_points, with_coordinates, with_noi, with_cap) of an import; the last period of a property is its current one."""
    last = periods.groupBy(*keys, "id").agg(F.max_by(F.struct("noi", "cap"), F.struct("as_of_date", "period_no")).alias("v"), F.count(F.lit(1)).alias("points"))
    at = located_rows.groupBy(*keys, "id").agg(F.max("lat").alias("lat"))
    n = periods.groupBy(*keys).agg(F.count_distinct("period_no").alias("periods"))
    one = last.join(at, [*keys, "id"], "left").groupBy(*keys).agg(F.count(F.lit(1)).alias("properties"), F.sum("points").alias("history_points"), F.count("lat").alias("with_coordinates"), F.count("v.noi").alias("with_noi"), F.count("v.cap").alias("with_cap"))
    return (one.join(n, list(keys)) if keys else one.join(n)).select(*keys, "properties", "periods", "history_points", "with_coordinates", "with_noi", "with_cap")

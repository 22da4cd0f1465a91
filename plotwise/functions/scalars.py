"""Scalar functions on columns: names, numbers, dates, locators, identifiers and penalties. All run in the JVM but nfkc()."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: Metric field -> (metric code, unit).
METRICS = {
    "price": ("acquisition_price_million_yen", "million_jpy"), "book_value": ("book_value_million_yen", "million_jpy"), "appraisal": ("appraisal_value_million_yen", "million_jpy"), "leasable_area": ("leasable_area_sqm", "sqm"),
    "leased_area": ("leased_area_sqm", "sqm"), "tenants": ("tenant_count", "count"), "occupancy": ("occupancy_rate_percent", "percent"), "cap": ("cap_rate_percent", "percent"), "discount_rate": ("discount_rate_percent", "percent"),
    "terminal_cap_rate": ("terminal_cap_rate_percent", "percent"), "noi": ("noi_million_yen", "million_jpy"),
}
#: Keys and lower bounds of the yield bands, each band reaching to the next one's bound; "unknown" for no value.
BANDS = ((None, "under-3-5"), (3.5, "3-5-to-4"), (4.0, "4-to-4-5"), (4.5, "4-5-to-5"), (5.0, "5-to-5-5"), (5.5, "over-5-5"))
#: Radius bounds in km.
RADIUS_LOW, RADIUS_HIGH, RADIUS_DEFAULT = 0.5, 50.0, 3.0


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC, which Spark has no expression for; Arrow batches."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def blank(c: Column) -> Column:
    """True for null and empty text; never null."""
    return F.coalesce(c, F.lit("")) == ""


def finite(c: Column) -> Column:
    """The number, null where it isn't finite."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def to_number(c: Column) -> Column:
    """A text's number, null unless the whole text is a plain decimal number."""
    t = F.trim(c)
    return finite(F.when(t.rlike(r"\A[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\z"), t).try_cast("double"))


def clean_name(c: Column) -> Column:
    """A name without a trailing footnote mark and outer white space; ideographic spaces become spaces."""
    return F.regexp_replace(F.translate(F.regexp_replace(c, r"(?U)\s*\*\d+\s*$", ""), "　", " "), r"(?U)^\s+|\s+$", "")


def canonical_name(c: Column) -> Column:
    """A name for comparison: NFKC, lower case, without white space and middle dots."""
    return F.regexp_replace(F.lower(nfkc(c)), r"(?U)[\s・･]", "")


def event_name(c: Column) -> Column:
    """A property's name as events write it: NFKC, without white space and the mark of a further share."""
    return F.regexp_replace(F.regexp_replace(nfkc(F.coalesce(c, F.lit(""))), r"(?U)\s", ""), r"[（(]追加取得[）)]", "")


def numeric_text(c: Column) -> Column:
    """The first number in a text: commas and spaces dropped, dashes and undisclosed values null, a leading △, ▲ or - negative."""
    t = F.regexp_replace(c, r"(?U)[,，\s]", "")
    size = F.regexp_extract(t, r"([0-9]+(?:\.[0-9]+)?)", 1)
    value = F.when(size != "", size).try_cast("double")
    return F.when(t.rlike(r"\A(?:|-|－|―|—|–|ー|非開示.*)\z"), F.lit(None)).otherwise(F.when(t.rlike(r"\A[△▲-]"), -value).otherwise(value))


def token_number(c: Column) -> Column:
    """A token's number if the whole token is one: sign or △▲, digits with commas, fraction, unit; else null."""
    # Fixed value: the form of such a token.
    ok = c.rlike(r"\A[▲△+-]?[0-9][0-9,]*(?:\.[0-9]+)?(?:%|％|pt|億円|百万円)?\z")
    value = F.when(ok, F.regexp_replace(F.regexp_extract(c, r"([0-9][0-9,]*(?:\.[0-9]+)?)", 1), ",", "")).try_cast("double")
    return F.when(c.rlike(r"\A[▲△-]"), -value).otherwise(value)


def labelled_number(text: Column, label: str) -> Column:
    """The first number after the label on the first line that has one; null where none has."""
    # Fixed value: the form of a number in a line.
    number = r"[-+]?[0-9][0-9,]*(?:\.[0-9]+)?"
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: x.contains(label))
    after = F.transform(lines, lambda x: F.regexp_extract(F.substr(x, F.instr(x, label) + len(label)), f"({number})", 1))
    return F.regexp_replace(F.get(F.filter(after, lambda x: x != ""), F.lit(0)), ",", "").try_cast("double")


def million_yen(c: Column) -> Column:
    return F.bround(c / 1e6, 3)


def percent_from_fraction(c: Column) -> Column:
    return F.bround(c * 100, 3)


def zero_to_null(c: Column) -> Column:
    return F.when(c != 0, c)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to one place, half to even; 100 where whole is 0."""
    return F.when(whole == 0, F.lit(100.0)).otherwise(F.bround(part / F.when(whole != 0, whole) * 100, 1))


def band(c: Column) -> Column:
    """The half-open yield band of a value; unknown for null and values that aren't finite."""
    v = finite(c)
    out = F.lit(BANDS[0][1])
    for low, name in BANDS[1:]:
        out = F.when(v >= low, F.lit(name)).otherwise(out)
    return F.when(v.isNull(), F.lit("unknown")).otherwise(out)


def clamp_radius(c: Column, default: float = RADIUS_DEFAULT) -> Column:
    """A radius within its bounds; the default for null, negative and not finite values."""
    v = finite(c)
    return F.when(v >= 0, F.least(F.lit(RADIUS_HIGH), F.greatest(F.lit(RADIUS_LOW), v))).otherwise(F.lit(default))


def stable_id(prefix: str, name: Column) -> Column:
    """prefix- and ten upper-case hex digits of the name's SHA-1."""
    return F.concat(F.lit(prefix + "-"), F.upper(F.substring(F.sha1(F.encode(name, "UTF-8")), 1, 10)))


def document_id(content: Column) -> Column:
    return F.concat(F.lit("doc-"), F.substring(F.sha2(content, 256), 1, 20))


def evidence_id(*parts: Column) -> Column:
    """ev- and 32 hex digits over the parts, joined by a separator; null parts count as empty."""
    joined = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit("ev-"), F.substring(F.sha2(F.encode(joined, "UTF-8"), 256), 1, 32))


def period_end(period_no: Column) -> Column:
    """The closing day of a numbered half-year period: odd ones end in March, even ones in September."""
    year = 2001 + F.floor((period_no + 1) / 2)
    return F.format_string("%04d-%s", year.cast("int"), F.when(F.pmod(period_no, F.lit(2)) == 1, "03-31").otherwise("09-30"))


def period_key(as_of: Column, period_no: Column, pos: Column) -> Column:
    """as_of_date, else the period's number, else the place in the array."""
    number = F.when(period_no.isNotNull(), F.concat(F.lit("period-"), F.lpad(period_no.cast("string"), 6, "0")))
    return F.coalesce(F.when(~blank(as_of), as_of), number, F.concat(F.lit("index-"), F.lpad(pos.cast("string"), 6, "0")))


def half_year(key: Column) -> Column:
    """YYYY-H1 or YYYY-H2 of a key that starts as a date; any other key as it is."""
    month = F.regexp_extract(key, r"^[0-9]{4}-([0-9]{2})", 1)
    return F.when(month.between("01", "12"), F.concat(F.substring(key, 1, 4), F.when(month <= "06", F.lit("-H1")).otherwise(F.lit("-H2")))).otherwise(key)


def half_year_label(bucket: Column) -> Column:
    return F.when(bucket.rlike("^[0-9]{4}-H1$"), F.concat(F.substring(bucket, 1, 4), F.lit("-06"))).when(bucket.rlike("^[0-9]{4}-H2$"), F.concat(F.substring(bucket, 1, 4), F.lit("-12"))).otherwise(bucket)


def period_label(as_of: Column, label: Column, period_no: Column, key: Column) -> Column:
    number = F.when(period_no.isNotNull(), F.concat(F.lit("第"), period_no.cast("string"), F.lit("期")))
    return F.coalesce(F.when(~blank(as_of), F.substring(as_of, 1, 7)), F.when(~blank(label), label), number, key)


def column_number(letters: Column) -> Column:
    """A spreadsheet column's number: A is 1, Z 26, AA 27."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64)


def column_letters(number: Column) -> Column:
    """A spreadsheet column's letters, up to three of them."""
    at = lambda n: F.char(n + 65)
    n = number.cast("int") - 1
    one, two, three = F.pmod(n, F.lit(26)), F.floor(n / 26).cast("int") - 1, F.floor((n - 26) / 676).cast("int") - 1
    return F.when(number <= 26, at(one)).when(number <= 702, F.concat(at(F.pmod(two, F.lit(26))), at(one))).otherwise(F.concat(at(three), at(F.pmod(two, F.lit(26))), at(one)))


def excel_locator(ref: Column) -> Column:
    """struct(sheet, cell) of 'sheet!cell', split at the last '!'; null without one."""
    pattern = r"(?s)\A(.*)!([^!]*)\z"
    return F.when(ref.rlike(pattern), F.struct(F.regexp_extract(ref, pattern, 1).alias("sheet"), F.regexp_extract(ref, pattern, 2).alias("cell")))


def round_to(c: Column, size: float) -> Column:
    """The multiple of size nearest to the value, half to even."""
    return F.bround(c / size) * size


def safe_url(c: Column) -> Column:
    return F.when(c.rlike(r"^https?://"), c)


def position_text(locator: Column) -> Column:
    """Where evidence stands: page, sheet and cell (or range), as far as given."""
    some = lambda prefix, x: F.when(~blank(x.cast("string")), F.concat(F.lit(prefix), x.cast("string")))
    return F.concat_ws(" / ", some("PDF p.", locator["page"]), some("Sheet: ", locator["sheet"]), some("Cell: ", F.coalesce(F.when(~blank(locator["cell"]), locator["cell"]), locator["cell_range"])))


def html_text(c: Column) -> Column:
    """A value as text of a page; nulls empty."""
    out = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def shown(c: Column, places: int, suffix: str = "") -> Column:
    """A number with separators of thousands, so many places and a suffix; a dash for null and what isn't finite."""
    v = finite(c.cast("double"))
    return F.coalesce(F.concat(F.format_number(v, places), F.lit(suffix)), F.lit("—"))


def item_or(m: Column, key: str, default) -> Column:
    """A map's value under the key, or the default for a missing key, a null value and a null map."""
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(default))


def first_value(m: Column, member: Callable[[Column], Column]) -> Column:
    """The first member() of a map's values, in the order of its keys, that is given and isn't 0."""
    values = F.transform(F.array_sort(F.map_keys(m)), lambda k: member(F.try_element_at(m, k)))
    return F.get(F.filter(values, lambda x: F.coalesce(x != 0, F.lit(False))), F.lit(0))


def csv_value(c: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), '"', '""'), F.lit('"'))


def region_of(address: Column, regions: dict[str, tuple[str, ...]], other: str = "other") -> Column:
    """The first region one of whose prefixes the address starts with."""
    out = F.lit(other)
    for name, prefixes in reversed(regions.items()):
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | F.coalesce(address.startswith(p), F.lit(False))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out

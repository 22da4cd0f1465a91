"""JSON documents, supplements and a registry of source adapters."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from plotwise.operators import cells as C
from plotwise.operators import issuers, pages
from plotwise.sources import xlsx
from plotwise.sources.files import Files, inside


def read_json(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """Whole-file JSON documents with a declared schema and `path`; files that aren't JSON are left out."""
    s = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = spark.read.schema(s.add("_corrupt_record", "string")).json(path, multiLine=True, mode="PERMISSIVE")
    rows = rows.withColumn("path", F.col("_metadata.file_path"))
    return rows.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def first_existing(spark: SparkSession, paths: Iterable[str], reader: Callable[[str], DataFrame]) -> DataFrame:
    """The first path that is there; raises FileNotFoundError where none is."""
    tried, files = list(paths), Files(spark)
    for p in tried:
        if files.exists(p):
            return reader(p)
    raise FileNotFoundError(", ".join(tried))


def or_empty(spark: SparkSession, path: str, schema: str, reader: Callable[[str], DataFrame]) -> DataFrame:
    """The table at the path, or an empty one where there is none."""
    return reader(path) if Files(spark).exists(path) else spark.createDataFrame([], schema)


@dataclass
class Result:
    """What an adapter gives: its rows, assets, layouts and issues."""

    rows: DataFrame
    assets: list[str] = field(default_factory=list)
    layouts: dict[str, str] = field(default_factory=dict)
    issues: list[str] = field(default_factory=list)


class Registry:
    """Adapters by id, in the order of registration."""

    def __init__(self) -> None:
        self._adapters: dict[str, Callable[[SparkSession], Result]] = {}

    def register(self, name: str, adapter: Callable[[SparkSession], Result]) -> None:
        if name in self._adapters:
            raise ValueError(f"adapter {name} is registered already")
        self._adapters[name] = adapter

    def get(self, name: str) -> Callable[[SparkSession], Result]:
        try:
            return self._adapters[name]
        except KeyError:
            raise ValueError(f"unknown adapter {name}") from None

    def select(self, names: Iterable[str] | None = None) -> list[str]:
        return list(self._adapters) if names is None else [n for n in names if self.get(n)]

    def run(self, spark: SparkSession, names: Iterable[str] | None = None) -> DataFrame:
        """The rows of the adapters together, each with its adapter's name."""
        out: DataFrame | None = None
        for n in self.select(names):
            rows = self.get(n)(spark).rows.withColumn("adapter", F.lit(n))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        if out is None:
            raise ValueError("no adapter selected")
        return out


def supplements(spark: SparkSession, patterns: Iterable[str], schema: StructType | str, lists: tuple[str, ...] = ("portfolio_metrics", "property_events")) -> DataFrame:
    """The JSON documents of all patterns, each file once, in the order of their paths; a document without one of the lists is an error when read."""
    files = Files(spark)
    paths = sorted({p for pattern in patterns for p in files.glob(pattern)})
    if not paths:
        return spark.createDataFrame([], StructType.fromDDL(schema) if isinstance(schema, str) else schema).withColumn("path", F.lit(""))
    rows = read_json(spark, paths, schema)
    for c in lists:
        rows = rows.withColumn(c, F.coalesce(c, F.raise_error(F.concat(F.lit(f"no list {c} in "), "path"))))
    return rows


def source_configs(spark: SparkSession, path: str) -> DataFrame:
    """(source, place, settings): the sources that a JSON document configures, one row for each period of a source, one for a source without periods."""
    doc = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("source", "body"))
    listed = F.from_json(F.get_json_object("body", "$.periods"), "array<map<string,string>>")
    own = F.map_filter(F.from_json("body", "map<string,string>"), lambda k, _: k != "periods")
    return doc.select("source", F.posexplode(F.coalesce(listed, F.array(F.create_map().cast("map<string,string>")))).alias("place", "p"), own.alias("own")).select("source", "place", F.map_concat(F.map_filter("own", lambda k, _: ~F.map_contains_key(F.col("p"), k)), "p").alias("settings"))


def _checked_layout(spark: SparkSession, cells: DataFrame, sheets: tuple[str, ...], fragments: tuple[str, ...]) -> list[str]:
    """What a workbook lacks, as issues; names of sheets are few."""
    names = cells.select("doc", F.col("sheet").alias("name")).distinct()
    docs = names.select("doc").distinct()
    wanted = lambda xs: docs.select("doc", F.explode(F.array(*map(F.lit, xs)).cast("array<string>")).alias("x"))
    lacking = C.missing_names(wanted(sheets).withColumnRenamed("x", "name"), names, ["doc"]).select("doc", F.concat(F.lit("sheet "), "name").alias("m"))
    lacking = lacking.unionByName(pages.missing_fragments(wanted(fragments).withColumnRenamed("x", "fragment"), names, ["doc"]).select("doc", F.concat(F.lit("sheet with "), "fragment").alias("m")))
    return [f"{r.doc}: {r.m} is missing" for r in lacking.orderBy("doc", "m").collect()]


def workbook_adapter(path: str, normalize: Callable[[DataFrame], tuple[DataFrame, DataFrame]], sheets: tuple[str, ...] = (), fragments: tuple[str, ...] = ()) -> Callable[[SparkSession], Result]:
    """An adapter of one workbook: its cells are read, its layout is checked, then it is normalized. A workbook that lacks a sheet raises ValueError."""

    def run(spark: SparkSession) -> Result:
        cells = issuers.columns(xlsx.read_cells(spark, path))
        lacking = _checked_layout(spark, cells, sheets, fragments)
        if lacking:
            raise ValueError("; ".join(lacking))
        rows, issues = normalize(cells)
        return Result(rows, [path], {}, [str(r.asDict()) for r in issues.limit(1000).collect()])  # a message for each property at most

    return run


def workbooks_adapter(folder: str, documents: DataFrame, prefix: str = "NBF") -> Callable[[SparkSession], Result]:
    """An adapter of one workbook for each period. documents: file (name in the folder), period_no, period, as_of_date."""

    def run(spark: SparkSession) -> Result:
        cells = issuers.columns(xlsx.read_cells(spark, folder))
        cells = cells.withColumn("doc", F.element_at(F.split("doc", "/"), -1))
        snapshots, issues, totals = issuers.office_periods(cells, documents.withColumnRenamed("file", "doc"))
        bad = issuers.reconciled(snapshots, totals, "doc").where("state = 'review'")
        messages = [str(r.asDict()) for r in issues.limit(1000).collect()] + [f"{r.doc}: {r.field} differs by {r.difference}" for r in bad.collect()]
        return Result(issuers.office_properties(snapshots, prefix), [r.file for r in documents.select("file").collect()], {}, messages)

    return run


def document_adapter(root: str, source: str, read_pages: Callable[[str], DataFrame], extract: Callable[[DataFrame], DataFrame], **limits) -> Callable[[SparkSession], Result]:
    """An adapter of a paged document under a root folder, with a reader of its pages; a path that leads out of the root raises ValueError.

    The layout is checked with pages.validated(**limits) before anything is extracted; one that isn't compatible raises ValueError.
    """
    at = inside(root, source)

    def run(spark: SparkSession) -> Result:
        rows = read_pages(at)
        layout = pages.validated(pages.layout(rows), **limits).first()
        if layout is None or layout.status != "compatible":
            raise ValueError(f"{source}: {layout.status if layout else 'no pages'} {layout.reasons if layout else ''}")
        return Result(extract(rows), [at], {at: layout.fingerprint})

    return run

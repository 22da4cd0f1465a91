"""Spreadsheets as tables of cells, read with the standard library from zipped XML."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, sheet string, cell string, col string, row int, kind string, num double, text string"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _texts(node: ET.Element) -> str:
    return "".join(t.text or "" for t in node.iter(_MAIN + "t"))


def _value(c: ET.Element, shared: list[str]) -> tuple[str, float | None, str | None] | None:
    """(kind, number, text) of a cell; None for one without a value."""
    kind, v = c.get("t", "n"), c.find(_MAIN + "v")
    if kind == "inlineStr":
        return "text", None, _texts(c)
    if v is None or v.text is None:
        return None
    if kind == "s":
        return "text", None, shared[int(v.text)]
    if kind in ("str", "e"):
        return ("error" if kind == "e" else "text"), None, v.text
    if kind == "b":
        return "bool", float(v.text == "1"), None
    try:
        return "number", float(v.text), None
    except ValueError:
        return "text", None, v.text


def cells_of(content: bytes) -> Iterator[tuple[str, str, str, int, str, float | None, str | None]]:
    """(sheet, cell, column, row, kind, number, text) of every cell that has a value."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [_texts(si) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(_MAIN + "si")] if "xl/sharedStrings.xml" in names else []
        rels = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(_MAIN + "sheet"):
            target = rels[sheet.get(_REL + "id")]
            part = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
            for _, node in ET.iterparse(io.BytesIO(z.read(part))):
                if node.tag == _MAIN + "c" and (m := re.fullmatch(r"([A-Z]+)([0-9]+)", node.get("r", ""))) and (v := _value(node, shared)):
                    yield sheet.get("name", ""), m[0], m[1], int(m[2]), *v
                    node.clear()


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """All cells of all workbooks at the path; a workbook is one task's work. Files that are no workbook have kind 'unreadable'."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                rows: list[tuple] = []
                try:
                    for cell in cells_of(content):
                        rows.append((p, *cell))
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
                except (zipfile.BadZipFile, KeyError, ET.ParseError, IndexError) as e:
                    rows.append((p, None, None, None, None, "unreadable", None, str(e)))
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    return files.mapInPandas(read, SCHEMA)

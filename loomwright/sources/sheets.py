"""Sheets of XLSX files, read with the standard library: a workbook is a zip of XML."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(data: bytes, sheet: str) -> list[list[str | None]]:
    """The cells of a sheet as texts, row by row."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        rid = next(s.get(f"{{{_NS['r']}}}id") for s in book.iterfind("m:sheets/m:sheet", _NS) if s.get("name") == sheet)
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        root = ElementTree.fromstring(z.read("xl/" + links[rid].lstrip("/").removeprefix("xl/")))
    out = []
    for row in root.iterfind("m:sheetData/m:row", _NS):
        cells: dict[int, str | None] = {}
        for c in row.iterfind("m:c", _NS):
            v, inline = c.find("m:v", _NS), c.find("m:is", _NS)
            text = "".join(t.text or "" for t in inline.iter(f"{{{_NS['m']}}}t")) if inline is not None else None if v is None else v.text
            cells[_column(c.get("r"))] = shared[int(text)] if c.get("t") == "s" and text is not None else text
        out.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return out


def read_excel(spark: SparkSession, path: str, sheet: str, columns: list[str]) -> DataFrame:
    """The named sheet of each workbook at path: columns as texts by the names in its first row, null where it lacks one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                head, *rows = sheet_rows(bytes(data), sheet) or [[]]
                at = {h: i for i, h in enumerate(head)}
                yield pd.DataFrame({c: [r[at[c]] if c in at and at[c] < len(r) else None for r in rows] for c in columns}, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ", ".join(f"`{c}` string" for c in columns))

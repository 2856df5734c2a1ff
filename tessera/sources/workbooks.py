"""Workbooks (xlsx) as frames: files are read by Spark from any store, one row a file, and
parsed in the tasks that have them."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The file that a row comes from.
FILE = "_workbook"

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _text(node) -> str:
    """Plain text of a string item, whose runs may be formatted."""
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _first_sheet(book: zipfile.ZipFile) -> str:
    """The part of the first sheet that the workbook lists."""
    sheet = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}sheets/{_MAIN}sheet")
    for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if r.get("Id") == sheet.get(_LINK):
            target = r.get("Target")
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError("the workbook lists no sheet")


def _column(reference: str) -> int:
    """0 for A, 25 for Z, 26 for AA."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheet_rows(data: bytes) -> Iterator[list[str | None]]:
    """The rows of the first sheet as text, missing cells as None, read as a stream of
    elements."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = book.namelist()
        known = [_text(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        with book.open(_first_sheet(book)) as part:
            for _, row in ElementTree.iterparse(part):
                if row.tag != f"{_MAIN}row":
                    continue
                out: list[str | None] = []
                for cell in row.iter(f"{_MAIN}c"):
                    at = _column(cell.get("r")) if cell.get("r") else len(out)
                    out += [None] * (at + 1 - len(out))
                    value, kind = cell.find(f"{_MAIN}v"), cell.get("t")
                    if kind == "inlineStr":
                        out[at] = _text(cell)
                    elif value is not None and value.text is not None:
                        out[at] = known[int(value.text)] if kind == "s" else {"1": "true", "0": "false"}[value.text] if kind == "b" else None if kind == "e" else value.text
                yield out
                row.clear()


def header(data: bytes) -> list[str]:
    """Names of the first row; columns without one are left out."""
    return [c for c in next(sheet_rows(data), []) if c]


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """All workbooks below a folder: a text column for every name that any first row has,
    and the file's name. Rows without any value are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    find = F.udf(header, T.ArrayType(T.StringType()))
    # As many names as there are different columns.
    names = [r.name for r in files.select(F.posexplode(find("content")).alias("i", "name")).groupBy("name").agg(F.min("i").alias("i")).orderBy("i", "name").collect()]

    def work(frames):
        for pdf in frames:
            for file, data in zip(pdf["file"], pdf["content"]):
                rows = sheet_rows(data)
                place = {c: i for i, c in reversed(list(enumerate(next(rows, []))))}
                found = [[r[place[n]] if n in place and place[n] < len(r) else None for n in names] for r in rows if any(v is not None for v in r)]
                yield pd.DataFrame([[file, *r] for r in found], columns=[FILE, *names], dtype=object)

    schema = T.StructType([T.StructField(n, T.StringType()) for n in (FILE, *names)])
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInPandas(work, schema)

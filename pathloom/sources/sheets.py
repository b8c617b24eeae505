"""Spreadsheets (Office Open XML): the first sheet of a workbook as rows, and rows as a workbook.

A workbook is one file of at most 1,048,576 rows, so it is read by one task and
written by the driver, row by row; more rows are an error and belong in a table.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Names and bounds of the format.
MOST_ROWS = 1_048_576
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_UNFIT = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]|_x[0-9A-Fa-f]{4}_")
_ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _letters(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _text(node) -> str:
    found = "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), found)


def rows_of(content: bytes) -> Iterator[list]:
    """Cells of the rows of the first sheet: text, numbers, booleans, None for empty ones."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = [_text(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        first = next(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"))
        links = ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = next(r.get("Target") for r in links if r.get("Id") == first.get(_RELATION))
        name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        with z.open(name) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: list = []
                for c in row.iter(f"{_MAIN}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at - len(cells) + 1)
                    kind, value = c.get("t", "n"), c.find(f"{_MAIN}v")
                    if kind == "inlineStr":
                        cells[at] = _text(c)
                    elif value is None or value.text is None:
                        continue
                    elif kind == "s":
                        cells[at] = shared[int(value.text)]
                    elif kind == "b":
                        cells[at] = value.text == "1"
                    elif kind in ("str", "e"):
                        cells[at] = None if kind == "e" else value.text
                    else:
                        cells[at] = float(value.text)
                yield cells
                row.clear()


def read_workbook(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the first sheet under ``schema``, whose names must stand in the first row; other columns are left out.

    Numbers become whole where the type is; empty cells are null.
    """
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    whole = {f.name for f in spark.createDataFrame([], schema).schema if f.dataType.simpleString() in ("int", "bigint", "smallint")}
    text = {f.name for f in spark.createDataFrame([], schema).schema if f.dataType.simpleString() == "string"}

    def value(name: str, x):
        if x is None:
            return None
        if name in text:
            return x if isinstance(x, str) else str(int(x)) if isinstance(x, float) and x == int(x) else str(x)
        return int(float(x)) if name in whole else x

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                rows = rows_of(content)
                header = next(rows, [])
                missing = [n for n in names if n not in header]
                if missing:
                    raise ValueError(f"missing columns: {', '.join(missing)}")
                at = [header.index(n) for n in names]
                part = []
                for row in rows:
                    part.append([value(n, row[i] if i < len(row) else None) for n, i in zip(names, at)])
                    if len(part) == 10_000:
                        yield pd.DataFrame(part, columns=names, dtype=object)
                        part = []
                yield pd.DataFrame(part, columns=names, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def _cell(reference: str, x) -> str:
    if x is None or x != x:
        return ""
    if isinstance(x, bool):
        return f'<c r="{reference}" t="b"><v>{int(x)}</v></c>'
    if isinstance(x, (int, float)):
        return f'<c r="{reference}"><v>{x!r}</v></c>'
    safe = escape(_UNFIT.sub(lambda m: "".join(f"_x{ord(c):04X}_" if c == m[0][0] else c for c in m[0]), str(x))).replace("\r", "_x000D_")
    return f'<c r="{reference}" t="inlineStr"><is><t xml:space="preserve">{safe}</t></is></c>'


def write_workbook(df: DataFrame, path: str) -> None:
    """Rows to the first sheet of a new workbook at ``path`` (a file the driver can write), names in the first row.

    To add a column to a sheet, read it, add the column and write it under a
    name of its own; a file is never replaced while it is read.
    """
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main = _MAIN[1:-1]
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, head + body)
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
            sheet.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
            rows = ([*df.columns], *()), df.toLocalIterator()
            n = 0
            for values in (row for source in rows for row in source):
                n += 1
                if n > MOST_ROWS:
                    raise ValueError(f"a sheet holds at most {MOST_ROWS} rows")
                cells = "".join(_cell(f"{_letters(i)}{n}", x) for i, x in enumerate(values))
                sheet.write(f'<row r="{n}">{cells}</row>'.encode())
            sheet.write(b"</sheetData></worksheet>")

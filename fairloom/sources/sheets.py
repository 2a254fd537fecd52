"""Workbooks (xlsx) as rows, and small results as workbooks. A workbook is a zip of XML files; one is read by one task."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairloom.operators.leaders import numbered_in_order

_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column(reference: str) -> int:
    """'AB12' -> 27"""
    n = 0
    for ch in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def cells(content: bytes, sheet: int = 1) -> list[list[str]]:
    """The rows of a sheet as texts, blanks as ''."""
    with zipfile.ZipFile(io.BytesIO(content)) as packed:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in packed.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_M}t")) for si in ElementTree.fromstring(packed.read("xl/sharedStrings.xml")).iter(f"{_M}si")]
        root = ElementTree.fromstring(packed.read(f"xl/worksheets/sheet{sheet}.xml"))
    out = []
    for row in root.iter(f"{_M}row"):
        line: list[str] = []
        for cell in row.iter(f"{_M}c"):
            at = _column(cell.get("r")) if cell.get("r") else len(line)
            line += [""] * (at + 1 - len(line))
            value = cell.find(f"{_M}v")
            if cell.get("t") == "inlineStr":
                line[at] = "".join(t.text or "" for t in cell.iter(f"{_M}t"))
            elif value is not None and value.text is not None:
                line[at] = shared[int(value.text)] if cell.get("t") == "s" else value.text
        out.append(line)
    return out


def sheet_rows(spark: SparkSession, path: str, names: Sequence[str] | None = None, first_row: int = 2, sheet: int = 1) -> DataFrame:
    """file_path, row_no and one text column for each name, from the workbooks under a path. Without names the first
    workbook's first row gives them. Rows before first_row, and wholly blank ones, are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path)
    if names is None:
        head = files.orderBy("path").select("content").first()
        names = [c.strip() or f"column_{i}" for i, c in enumerate(cells(bytes(head[0]), sheet)[0])] if head else []
    read = F.pandas_udf(lambda s: pd.Series([cells(bytes(x), sheet) for x in s]), "array<array<string>>")
    rows = files.select(F.col("path").alias("file_path"), F.posexplode(read(F.col("content"))).alias("row_no", "cells"))
    rows = rows.withColumn("row_no", F.col("row_no") + 1).where((F.col("row_no") >= first_row) & F.exists("cells", lambda c: F.trim(c) != ""))
    return rows.select("file_path", "row_no", *[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])


def workbook(header: Sequence[str], rows: Sequence[Sequence[object]], choices: dict[int, Sequence[str]] | None = None) -> bytes:
    """A workbook with a frozen header, a filter over it, and drop-down choices for columns (by number)."""

    def name(i: int) -> str:
        out = ""
        i += 1
        while i:
            i, r = divmod(i - 1, 26)
            out = chr(65 + r) + out
        return out

    def line(n: int, values: Sequence[object]) -> str:
        made = []
        for i, v in enumerate(values):
            if isinstance(v, (int, float)) and not isinstance(v, bool):
                made.append(f'<c r="{name(i)}{n}"><v>{v}</v></c>')
            elif v not in (None, ""):
                made.append(f'<c r="{name(i)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>')
        return f'<row r="{n}">{"".join(made)}</row>'

    last = f"{name(max(0, len(header) - 1))}{len(rows) + 1}"
    lists = "".join(f'<dataValidation type="list" allowBlank="1" sqref="{name(i)}2:{name(i)}{len(rows) + 1}"><formula1>"{escape(",".join(v))}"</formula1></dataValidation>' for i, v in (choices or {}).items())
    space = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    sheet = (
        f'<worksheet xmlns="{space}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>'
        f'<sheetData>{line(1, header)}{"".join(line(i, r) for i, r in enumerate(rows, 2))}</sheetData><autoFilter ref="A1:{last}"/>'
        + (f'<dataValidations count="{len(choices)}">{lists}</dataValidations>' if choices else "") + "</worksheet>"
    )
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kinds}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{space}" xmlns:r="{rel}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": sheet,
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as packed:
        for path, body in parts.items():
            packed.writestr(path, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + body)
    return out.getvalue()


def with_leftovers(rows: DataFrame, kept: Sequence[str], name: str = "notes", apart: Sequence[str] = ("file_path", "row_no")) -> DataFrame:
    """rows with the kept columns, and all others that are filled as one JSON object, in the order of the columns; null
    where none is filled. Columns apart stay as they are."""
    rest = [c for c in rows.columns if c not in (*kept, *apart)]
    filled = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, rest)), F.array(*[F.trim(F.col(c)) for c in rest])), lambda _, v: F.coalesce(v, F.lit("")) != "") if rest else F.create_map()
    return rows.select(*[c for c in apart if c in rows.columns], *kept, F.when(F.size(filled) > 0, F.to_json(filled)).alias(name))


def export_workbook(rows: DataFrame, path: str, labels: dict[str, str] | None = None, choices: dict[str, Sequence[str]] | None = None, most: int = 100_000) -> int:
    """Write an ordered result as a workbook with a row number; returns the rows. A sheet takes at most `most` rows: what
    is more goes on in further workbooks beside the first, path-2.xlsx and so on, numbered through. Each workbook is made
    in a task, and the driver holds one at a time."""
    header = ["#", *[(labels or {}).get(c, c) for c in rows.columns]]
    picks = {rows.columns.index(c) + 1: v for c, v in (choices or {}).items()}
    columns = rows.columns
    numbered = numbered_in_order(rows)
    n = "n_" if "n" in columns else "n"
    if n != "n":
        numbered = numbered_in_order(rows.select(F.struct(*columns).alias("row_"))).select("row_.*", F.col("n").alias(n))
    parts = numbered.withColumn("part_", F.floor((F.col(n) - 1) / most))

    def made(table: pa.Table) -> pa.Table:
        table = table.sort_by(n)
        body = workbook(header, [(r[n], *(r[c] for c in columns)) for r in table.to_pylist()], picks)
        return pa.table({"part": [table["part_"][0].as_py()], "rows": [table.num_rows], "content": pa.array([body], pa.binary())})

    total = 0
    for book in parts.groupBy("part_").applyInArrow(made, "part long, rows long, content binary").toLocalIterator():
        with open(path if book.part == 0 else re.sub(r"(\.xlsx)?$", f"-{book.part + 1}.xlsx", path, count=1), "wb") as out:
            out.write(book.content)
        total += book.rows
    if not total:
        with open(path, "wb") as out:
            out.write(workbook(header, [], picks))
    return total

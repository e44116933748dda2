"""CSV, XLSX and landing-folder sources; all columns are read as text."""

from __future__ import annotations

import fnmatch
import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from itertools import chain
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

from .delimited import read_csv  # noqa: F401  one of the readers of files

_BOM = "﻿"


def head(df: DataFrame, rows: int = 10) -> dict:
    """Headers, a sample and the number of rows, for a preview."""
    columns = [c for c in df.columns if c != "_order"]
    return {"headers": columns, "sample": [r.asDict() for r in df.select(*columns).limit(rows).collect()], "total": df.count()}


def glob_regex(pattern: str | None) -> str:
    """A case-insensitive expression for a file pattern; blank matches all."""
    return "(?i)^" + fnmatch.translate((pattern or "").strip() or "*").replace("(?s:", "(?:").replace(r"\Z", "").replace(r"\z", "") + "$"


def matching(files: DataFrame, pattern: str | None, column: str = "name") -> DataFrame:
    return files.where(F.col(column).rlike(glob_regex(pattern)))


def new_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files (connection_id, path) that no run has taken yet, failed ones included."""
    return files.join(ledger.select("connection_id", "path"), ["connection_id", "path"], "left_anti")


def due_files(files: DataFrame, connections: DataFrame, feeds: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files to take in: each of a connection's enabled feeds' folders and patterns, but no (connection, path) that the ledger has, failed ones included.

    ``files``: connection_id, path; ``feeds``: id, connection_id, remote_path,
    pattern, data_type, enabled; a file that several feeds want goes to the
    first of them.
    """
    f = feeds.where("enabled").join(connections.where("active").select(F.col("id").alias("connection_id"), "tenant_id"), "connection_id")
    f = f.select("connection_id", "tenant_id", F.col("id").alias("feed_id"), "data_type", F.coalesce(F.nullif(F.regexp_replace(F.trim("remote_path"), "/+$", ""), F.lit("")), F.lit(".")).alias("folder"), F.coalesce(F.nullif(F.trim("pattern"), F.lit("")), F.lit("*")).alias("pattern"))
    folder = F.coalesce(F.nullif(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.lit("")), F.lit("."))
    rows = new_files(files, ledger).withColumns({"folder": folder, "filename": F.substring_index("path", "/", -1)}).join(f, ["connection_id", "folder"])
    like = F.regexp_replace(F.regexp_replace(F.regexp_replace("pattern", r"([.+^$(){}|\\\[\]])", r"\\$1"), r"\*", ".*"), r"\?", ".")
    rows = rows.withColumn("like", F.concat(F.lit("(?is)^"), like, F.lit("$"))).where(F.regexp_like("filename", F.col("like")))
    return rows.groupBy("connection_id", "tenant_id", "path", "filename").agg(F.min_by(F.struct("feed_id", "data_type"), "feed_id").alias("f")).select("connection_id", "tenant_id", "f.feed_id", "f.data_type", "path", "filename")


def poll_ledger(ledger: DataFrame, taken: DataFrame, now: Column) -> DataFrame:
    """The ledger with the files taken (connection_id, feed_id, path, filename, size, import_id, error): imported, or failed with the reason; empty ones fail."""
    error = F.when(F.coalesce("size", F.lit(0)) == 0, "Empty or unreadable remote file.").otherwise(F.substring("error", 1, 500))
    rows = taken.withColumns({"error": error, "status": F.when(error.isNull(), "imported").otherwise("failed"), "import_id": F.when(error.isNull(), F.col("import_id")), "processed_at": now})
    return ledger.unionByName(rows, allowMissingColumns=True)


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(data: bytes) -> Iterator[list[str]]:
    """Rows of the first sheet as text, empty cells as empty strings."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        sheet = sorted(n for n in z.namelist() if re.match(r"xl/worksheets/sheet\d+\.xml$", n))[0]
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{{{_NS['m']}}}row"):
            cells: dict[int, str] = {}
            for i, c in enumerate(row.findall("m:c", _NS)):
                at, value, kind = _column(c.get("r")) if c.get("r") else i, c.find("m:v", _NS), c.get("t")
                text = "" if value is None else value.text or ""
                if kind == "s" and text:
                    text = shared[int(text)]
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                cells[at] = text
            yield [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]


class SheetReader(DataSourceReader):
    def __init__(self, path: str, width: int):
        self.path, self.width = path, width

    def read(self, partition):
        with open(self.path, "rb") as f:
            rows = sheet_rows(f.read())
        next(rows, None)
        for i, row in enumerate(rows, 2):
            row = (row + [""] * self.width)[: self.width]
            if any(v.strip() for v in row):
                yield (*row, i)


class SheetSource(DataSource):
    """``spark.read.format("sheet").load(path)``: the first sheet of an XLSX file on a folder that driver and executors share; ``read_workbook`` reads any file system."""

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def _header(self) -> list[str]:
        with open(self.options["path"], "rb") as f:
            return [h.replace(_BOM, "").strip() for h in next(sheet_rows(f.read()), [])]

    def schema(self) -> T.StructType:
        return T.StructType([*(T.StructField(h or f"column_{i}", T.StringType()) for i, h in enumerate(self._header())), T.StructField("_order", T.LongType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SheetReader(self.options["path"], len(schema.fields) - 1)


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all XLSX files under ``path``, on any file system that Spark reads: (file, order, cells)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(p, i, r) for p, c in zip(pdf["path"], pdf["content"], strict=True) for i, r in enumerate(sheet_rows(bytes(c)), 1)]
            yield pd.DataFrame(rows, columns=["file", "order", "cells"])

    return files.mapInPandas(run, "file string, order long, cells array<string>")


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """The first sheets of XLSX files on any file system under the header of the first file: text columns, blank rows left out, ``_order`` by file and row.

    A file is unpacked by one task, as its format asks; headers are trimmed and
    without a byte-order mark, an empty one is named by its place.
    """
    cells = read_sheets(spark, path)
    head = cells.where(F.col("order") == 1).orderBy("file").limit(1).collect()  # one row
    names = [h.replace(_BOM, "").strip() or f"column_{i}" for i, h in enumerate(head[0]["cells"])] if head else []
    rows = cells.where((F.col("order") > 1) & F.exists("cells", lambda v: F.length(F.trim(v)) > 0))
    return rows.select(*(F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)), F.struct("file", "order").alias("_order"))


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Headed CSV files in the folder ``path``, as many as ``df`` has partitions; one file only where it is asked for."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def workbook(sheets: dict[str, tuple[list[str], Iterable[tuple]]]) -> bytes:
    """An XLSX file of small tables, made in one process as its format asks, the summary first: names of up to 31 characters, headers frozen."""
    from xml.sax.saxutils import escape

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v}</v></c>"
        return f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'

    main, out = _NS["m"], io.BytesIO()
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    names = [re.sub(r"[\[\]:*?/\\]", " ", n)[:31] for n in sheets]
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml."
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kinds}worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}sheet.main+xml"/>{parts}</Types>')
        package = "http://schemas.openxmlformats.org/package/2006/relationships"
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, (header, rows) in enumerate(sheets.values(), 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as sheet:
                sheet.write(f'<worksheet xmlns="{main}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData>'.encode())
                for row in chain([header], rows):
                    sheet.write(f"<row>{''.join(map(cell, row))}</row>".encode())
                sheet.write(b"</sheetData></worksheet>")
    return out.getvalue()


#: Fixed value: the rows that a sheet of a workbook may hold below its header.
SHEET_ROWS = 1_048_575


def report(sheets: dict[str, DataFrame], rows: int = SHEET_ROWS) -> bytes:
    """A workbook of report tables. One with more than ``rows`` rows is an error, as a sheet can't hold it: export it with ``write_csv``."""
    for name, df in sheets.items():
        if df.limit(rows + 1).count() > rows:
            raise ValueError(f"{name} has more than {rows} rows; write it with write_csv")
    return workbook({name: (df.columns, map(tuple, df.toLocalIterator())) for name, df in sheets.items()})

"""Workbooks (.xlsx) read by executors: a file is a zip archive of XML, which the standard library reads.

A task reads a file, row by row; only the file's own bytes and its table of distinct texts are held. Cells are text, as
in the other readers: numbers as they are written, dates and times (by the cell's format) in ISO form, truth values as
TRUE and FALSE; errors and empty cells are null. Rows without cells are left out. Files come through Spark's own file
systems. Workbooks of the older binary kind (.xls) have to be converted.
"""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .readers import unlike

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: The built-in formats of dates and times.
_DATES = {*range(14, 23), *range(45, 48)}
ROWS = StructType([StructField("file", StringType()), StructField("row", IntegerType()), StructField("cells", ArrayType(StringType()))])


def _root(z: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(z.read(name)) if name in z.namelist() else None


def _texts(z: zipfile.ZipFile) -> list[str]:
    root = _root(z, "xl/sharedStrings.xml")
    runs = lambda si: (t.text or "" for part in si if part.tag in (f"{_MAIN}t", f"{_MAIN}r") for t in ([part] if part.tag == f"{_MAIN}t" else part.findall(f"{_MAIN}t")))
    return ["".join(runs(si)) for si in root.findall(f"{_MAIN}si")] if root is not None else []


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Places of the cell formats that show a date or a time."""
    root = _root(z, "xl/styles.xml")
    if root is None:
        return set()
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")) for f in root.iter(f"{_MAIN}numFmt")}
    dates = _DATES | {i for i, code in own.items() if re.search("[ymdhs]", code, re.I)}
    return {i for i, xf in enumerate(root.findall(f"{_MAIN}cellXfs/{_MAIN}xf")) if int(xf.get("numFmtId", 0)) in dates}


def _column(place: str) -> int:
    n = 0
    for c in place:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - ord("A") + 1
    return n - 1


def _moment(serial: str, base: datetime) -> str:
    at = base + timedelta(microseconds=round(float(serial) * 86_400_000) * 1000)
    return at.isoformat(" ")


def sheet(content: bytes, which: int | str = 0):
    """(number of the row, its cells as text) of a sheet, by its place or name."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        book, links = _root(z, "xl/workbook.xml"), _root(z, "xl/_rels/workbook.xml.rels")
        sheets = book.findall(f"{_MAIN}sheets/{_MAIN}sheet")
        found = sheets[which] if isinstance(which, int) else next((s for s in sheets if s.get("name") == which), None)
        if found is None:
            raise ValueError(f"no sheet {which!r}")
        target = next(r.get("Target") for r in links if r.get("Id") == found.get(_LINK))
        name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        setup = book.find(f"{_MAIN}workbookPr")
        late = setup is not None and setup.get("date1904") in ("1", "true")
        base, texts, dates = datetime(1904, 1, 1) if late else datetime(1899, 12, 30), _texts(z), _date_styles(z)

        def value(c) -> str | None:
            kind, v = c.get("t", "n"), c.find(f"{_MAIN}v")
            if kind == "inlineStr":
                return "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
            if v is None or v.text is None or kind == "e":
                return None
            if kind == "s":
                return texts[int(v.text)]
            if kind == "b":
                return "TRUE" if v.text == "1" else "FALSE"
            return _moment(v.text, base) if kind == "n" and int(c.get("s", 0)) in dates else v.text

        with z.open(name) as f:
            number = 0
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                number, cells, at = int(row.get("r", number + 1)), [], -1
                for c in row.findall(f"{_MAIN}c"):
                    at = _column(c.get("r")) if c.get("r") else at + 1
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = value(c)
                row.clear()
                if any(x is not None for x in cells):
                    yield number, cells


def rows(files: DataFrame, which: int | str = 0, first: bool | None = None) -> DataFrame:
    """ROWS of the workbooks of a table (path, content); with first, the first row of each alone, or with False the others."""
    arrow = to_arrow_schema(ROWS)

    def work(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                out = []
                found = sheet(content.as_py(), which)
                if first is not None:
                    head = next(found, None)
                    if first:
                        found = iter([head] if head else [])
                for number, cells in found:
                    out.append((path, number, cells))
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return files.select("path", "content").mapInArrow(work, ROWS)


def table(files: DataFrame, names: list[str], which: int | str = 0, schema: str | None = None) -> DataFrame:
    """The rows below the first one of each workbook, with their values by place; longer rows are cut off."""
    df = rows(files, which, first=False).select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return df if not schema else df.select(*[F.col(f"`{have}`").try_cast(f.dataType).alias(f.name) for have, f in zip(df.columns, StructType.fromDDL(schema))])


def read_excel(spark: SparkSession, paths: str | list[str], sheet: int | str = 0, schema: str | None = None) -> DataFrame:
    """The rows of workbooks (.xlsx) below their first one, which names the columns: that of the first workbook by name. A
    sheet is meant by its place, from 0, or its name. All columns are text without a schema."""
    some = [paths] if isinstance(paths, str) else list(paths)
    if any(p.lower().endswith(".xls") for p in some):
        raise NotImplementedError("workbooks of the binary kind (.xls) aren't read; save them as .xlsx")
    read = lambda p: spark.read.format("binaryFile").load(p)
    one = read(some).select("path").orderBy("path").first()
    if one is None:
        raise ValueError("no workbook there")
    head = rows(read(some).where(F.col("path") == one.path), sheet, first=True).first()
    names = unlike([c or f"_c{i}" for i, c in enumerate(head.cells)] if head else [])
    return table(read(some), names, sheet, schema)

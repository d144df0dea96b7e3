"""Spreadsheets in the public Office Open XML format: every sheet a table, its first row the header, by the standard library alone."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
ORDINAL = "_row"


def column_number(reference: str) -> int:
    """0 for A1, 26 for AA1."""
    n = 0
    for c in re.match("[A-Z]*", reference).group():
        n = 26 * n + ord(c) - 64
    return n - 1


def column_name(n: int) -> str:
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def text_of(node) -> str:
    return "".join(t.text or "" for t in node.iter(MAIN + "t"))


def sheets(raw: bytes) -> dict[str, list[list]]:
    """Sheet name -> rows of values (string, float, bool or None)."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = [text_of(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(MAIN + "sheet"):
            target = links[s.get(LINK)].lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else "xl/" + target))
            rows = []
            for row in root.iter(MAIN + "row"):
                values: list = []
                for c in row.iter(MAIN + "c"):
                    at = column_number(c.get("r")) if c.get("r") else len(values)
                    values += [None] * (at + 1 - len(values))
                    values[at] = value_of(c, shared)
                rows.append(values)
            out[s.get("name")] = rows
    return out


def value_of(cell, shared: list[str]):
    kind, v = cell.get("t"), cell.find(MAIN + "v")
    if kind == "inlineStr":
        return text_of(cell)
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return v.text == "1"
    return float(v.text) if kind in (None, "n") else v.text


def read_workbook(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Sheet name -> table with the rows' order in _row; a column is double where all its values are numbers, else string. Empty sheets are left out. The file is read by Spark, so any store works."""
    raw = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    out = {}
    for name, rows in sheets(raw).items():
        rows = [r for r in rows if any(v is not None for v in r)]
        if len(rows) < 2:
            continue
        header = [str(h) if h is not None else f"V{k + 1}" for k, h in enumerate(rows[0])]
        body = [(r + [None] * len(header))[: len(header)] for r in rows[1:]]
        numeric = [all(isinstance(r[k], float) or r[k] is None for r in body) and any(r[k] is not None for r in body) for k in range(len(header))]
        shown = lambda v: None if v is None else f"{v:.15g}" if isinstance(v, float) else str(v)
        body = [tuple(v if n else shown(v) for v, n in zip(r, numeric)) + (k,) for k, r in enumerate(body)]
        schema = ", ".join(f"`{h}` {'double' if n else 'string'}" for h, n in zip(header, numeric)) + f", {ORDINAL} int"
        out[name] = spark.createDataFrame(body, schema)
    return out


def sheet_xml(header: list[str], rows: list[tuple]) -> str:
    def cell(r: int, k: int, v) -> str:
        at = f"{column_name(k)}{r}"
        if v is None:
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{at}"><v>{v!r}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    lines = [f'<row r="{r}">{"".join(cell(r, k, v) for k, v in enumerate(row))}</row>' for r, row in enumerate([header, *rows], 1)]
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN[1:-1]}"><sheetData>{"".join(lines)}</sheetData></worksheet>'


def workbook(tables: dict[str, tuple[list[str], list[tuple]]]) -> bytes:
    """A workbook with a sheet for each name, (header, rows)."""
    relations = LINK[1:].rpartition("}")[0]
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        numbers = range(1, len(tables) + 1)
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in numbers)
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{relations}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        named = "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in zip(numbers, tables))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{MAIN[1:-1]}" xmlns:r="{relations}"><sheets>{named}</sheets></workbook>')
        linked = "".join(f'<Relationship Id="rId{k}" Type="{relations}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in numbers)
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{package}/relationships">{linked}</Relationships>')
        for k, (header, rows) in zip(numbers, tables.values()):
            z.writestr(f"xl/worksheets/sheet{k}.xml", sheet_xml(header, rows))
    return held.getvalue()


#: A sheet of the format has no more rows than this.
ROWS = 1_048_575


def export_workbook(groups: dict[str, DataFrame], path: str, names: list[str] | None = None, overwrite: bool = False) -> list[str]:
    """Writes metadata, a sheet a group; the names that do not exist come back. path: on any store that Hadoop reaches."""
    tables, spark = {}, None
    for n in names or groups:
        if n in groups:
            spark = groups[n].sparkSession
            rows = groups[n].limit(ROWS + 1).collect()  # bounded by what a sheet can hold
            if len(rows) > ROWS:
                raise ValueError(f"{n} has more rows than a sheet")
            tables[n] = groups[n].columns, [tuple(r) for r in rows]
    if tables:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, overwrite)
        stream.write(bytearray(workbook(tables)))
        stream.close()
    return [n for n in names or groups if n not in groups]

"""Annotation sheets as XLSX workbooks, written and read without a spreadsheet library.

A sheet is filled in by hand, so it has some hundreds of rows; ``MAX_ROWS`` is enforced.
"""

from __future__ import annotations

import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmill.functions import parsing as P

MAX_ROWS = 100_000
#: Columns of the sheet, their widths, and the answers that two of them offer.
COLUMNS = "asin review_no stratum country product_title text draft_aspects gold_aspects reviewed flag rationale".split()
WIDTHS = dict(zip(COLUMNS, (14, 10, 10, 12, 40, 80, 40, 40, 9, 8, 40)))
CHOICES = {"reviewed": ("x",), "flag": ("skip", "unsure")}

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


def _name(column: int) -> str:
    """A, B, ... Z, AA, ... of a column's number from 0."""
    out = ""
    column += 1
    while column:
        column, digit = divmod(column - 1, 26)
        out = chr(65 + digit) + out
    return out


def _cell(row: int, column: int, value: object) -> str:
    at = f"{_name(column)}{row}"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f'<c r="{at}"><v>{value}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape("" if value is None else str(value))}</t></is></c>' if value not in (None, "") else ""


def _sheet(rows: list[list], widths: list[int], choices: dict[int, tuple[str, ...]]) -> str:
    cells = "".join(f'<row r="{i}">' + "".join(_cell(i, j, v) for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
    columns = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1))
    lists = "".join(
        f'<dataValidation type="list" allowBlank="1" sqref="{_name(j)}2:{_name(j)}{max(len(rows), 2)}"><formula1>{escape(chr(34) + ",".join(values) + chr(34))}</formula1></dataValidation>'
        for j, values in choices.items()
    )
    views = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>' if choices else ""
    checks = f'<dataValidations count="{len(choices)}">{lists}</dataValidations>' if choices else ""
    return f'{_HEAD}<worksheet xmlns="{_MAIN}">{views}<cols>{columns}</cols><sheetData>{cells}</sheetData>{checks}</worksheet>'


def write_workbook(path: str, sheets: dict[str, str]) -> None:
    """A workbook of sheets (their XML by name)."""
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
    listed = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
    related = "".join(f'<Relationship Id="rId{i}" Type="{_DOC}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{_PACK}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{_PACK}/relationships"><Relationship Id="rId1" Type="{_DOC}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_DOC}"><sheets>{listed}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACK}/relationships">{related}</Relationships>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for name, xml in parts.items():
            out.writestr(name, _HEAD + xml)
        for i, xml in enumerate(sheets.values(), 1):
            out.writestr(f"xl/worksheets/sheet{i}.xml", xml)


def write_sheet(rows: DataFrame, path: str, instructions: str = "") -> None:
    """The annotation workbook: sheet ``gold`` with the rows (columns that are missing stay empty for the
    annotator) and lists of answers, and sheet ``instructions``. Control characters that spreadsheets
    refuse are left out."""
    kept = [P.strip_control(F.col(c).cast("string")).alias(c) if c != "review_no" else F.col(c).cast("int").alias(c) for c in COLUMNS if c in rows.columns]
    held = rows.select(*kept).limit(MAX_ROWS + 1).collect()
    if len(held) > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} rows to be read by hand")
    cells = [[r[c] if c in rows.columns else None for c in COLUMNS] for r in held]
    gold = _sheet([COLUMNS, *cells], list(WIDTHS.values()), {COLUMNS.index(c): v for c, v in CHOICES.items()})
    told = _sheet([[line] for line in instructions.splitlines()], [100], {})
    write_workbook(path, {"gold": gold, "instructions": told})


def read_cells(path: str, sheet: str = "gold") -> list[list[str]]:
    """The cells of a sheet as texts, blanks empty; rows as long as the first."""
    tag = lambda n: f"{{{_MAIN}}}{n}"
    with zipfile.ZipFile(path) as book:
        parse = lambda name: ElementTree.fromstring(book.read(name))
        targets = {r.get("Id"): r.get("Target") for r in parse("xl/_rels/workbook.xml.rels")}
        ids = {s.get("name"): s.get(f"{{{_DOC}}}id") for s in parse("xl/workbook.xml").iter(tag("sheet"))}
        if sheet not in ids:
            raise ValueError(f"{path} has no sheet {sheet!r}")
        text = lambda node: "".join(t.text or "" for t in node.iter(tag("t")))
        shared = [text(s) for s in parse("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in book.namelist() else []
        target = targets[ids[sheet]]
        rows: list[list[str]] = []
        for row in parse(target.lstrip("/") if target.startswith("/") else f"xl/{target}").iter(tag("row")):
            cells: dict[int, str] = {}
            for c in row.iter(tag("c")):
                column = 0
                for letter in re.match("[A-Z]+", c.get("r"))[0]:
                    column = column * 26 + ord(letter) - 64
                value = c.find(tag("v"))
                said = "" if value is None else value.text or ""
                cells[column - 1] = text(c) if c.get("t") == "inlineStr" else shared[int(said)] if c.get("t") == "s" else said
            rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    width = len(rows[0]) if rows else 0
    return [(r + [""] * width)[:width] for r in rows]


def read_sheet_xlsx(spark: SparkSession, path: str, sheet: str = "gold") -> DataFrame:
    """A sheet of a workbook as a table of texts named by its first row."""
    head, *rows = read_cells(path, sheet) or [[]]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in head))

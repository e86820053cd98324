"""Workbooks (xlsx) by the standard library: a zip of XML parts."""

from __future__ import annotations

import datetime as dt
import re
import zipfile
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Built-in number formats of dates and times; fixed values of the format.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
MOST_ROWS = 1_048_575


def _place(ref: str) -> tuple[int, int]:
    letters, digits = re.match(r"([A-Z]+)(\d+)", ref).groups()
    column = 0
    for c in letters:
        column = column * 26 + ord(c) - 64
    return int(digits) - 1, column - 1


def _letters(column: int) -> str:
    out = ""
    column += 1
    while column:
        column, rest = divmod(column - 1, 26)
        out = chr(65 + rest) + out
    return out


def sheet_rows(path: str, sheet: str | None = None, cells: str | None = None) -> list[list]:
    """The rows of a sheet (the first, if none is named), or of a range such as C3:D5."""
    with zipfile.ZipFile(path) as book:
        names = set(book.namelist())
        strings = []
        if "xl/sharedStrings.xml" in names:
            strings = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ET.fromstring(book.read("xl/sharedStrings.xml"))]
        formats: list[str] = []
        if "xl/styles.xml" in names:
            style = ET.fromstring(book.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in style.iter(f"{MAIN}numFmt")}
            for xf in style.find(f"{MAIN}cellXfs") or ():
                n = int(xf.get("numFmtId", 0))
                code = re.sub(r'"[^"]*"|\\.', "", own.get(n, ""))
                formats.append("duration" if "[h" in code.lower() or n == 46 else "date" if n in DATE_FORMATS or re.search(r"[dyhs]|m{3}", code.lower()) else "")
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        sheets = {s.get("name"): targets[s.get(f"{REL}id")] for s in ET.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")}
        if sheet is not None and sheet not in sheets:
            raise KeyError(f"there is no sheet {sheet}; there are: {', '.join(sheets)}")
        target = sheets[sheet] if sheet is not None else next(iter(sheets.values()))
        tree = ET.fromstring(book.read("xl/" + target.removeprefix("/xl/").lstrip("/")))
    grid: dict[tuple[int, int], object] = {}
    for c in tree.iter(f"{MAIN}c"):
        value, kind = c.find(f"{MAIN}v"), c.get("t", "n")
        if kind == "inlineStr":
            got = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
        elif value is None or value.text is None or kind == "e":
            continue
        elif kind == "s":
            got = strings[int(value.text)]
        elif kind == "b":
            got = value.text == "1"
        elif kind in ("str", "d"):
            got = value.text
        else:
            form = formats[int(c.get("s", 0))] if formats and int(c.get("s", 0)) < len(formats) else ""
            got = _number(value.text, form)
        grid[_place(c.get("r"))] = got
    if cells:
        (top, left), (bottom, right) = map(_place, cells.split(":"))
    else:
        top, left = 0, 0
        bottom, right = max((r for r, _ in grid), default=-1), max((c for _, c in grid), default=-1)
    return [[grid.get((r, c)) for c in range(left, right + 1)] for r in range(top, bottom + 1)]


def _number(text: str, form: str):
    x = float(text)
    if form == "duration":
        return round(x * 86400, 6)
    if form == "date":
        moment = dt.datetime(1899, 12, 30) + dt.timedelta(microseconds=round(x * 86_400_000) * 1000)
        return moment.date().isoformat() if x == int(x) else moment.isoformat(sep=" ")
    return int(x) if x.is_integer() and abs(x) < 1 << 53 else x


def write_xlsx(names: list[str], rows: list[tuple], path, sheet: str = "Sheet1") -> None:
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a sheet has at most {MOST_ROWS} rows")

    def cell(r: int, c: int, v) -> str:
        ref = f'r="{_letters(c)}{r + 1}"'
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c {ref} t="b"><v>{int(v)}</v></c>'
        if isinstance(v, dt.datetime):
            return f'<c {ref} s="2"><v>{(v - dt.datetime(1899, 12, 30)) / dt.timedelta(days=1)!r}</v></c>'
        if isinstance(v, dt.date):
            return f'<c {ref} s="1"><v>{(v - dt.date(1899, 12, 30)).days}</v></c>'
        if isinstance(v, dt.timedelta):
            return f'<c {ref} s="3"><v>{v / dt.timedelta(days=1)!r}</v></c>'
        if isinstance(v, (int, float)) and (not isinstance(v, int) or abs(v) < 1 << 53) and v == v and abs(v) != float("inf"):
            return f"<c {ref}><v>{v!r}</v></c>"
        return f'<c {ref} t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    body = "".join(f'<row r="{r + 1}">{"".join(cell(r, c, v) for c, v in enumerate(row))}</row>' for r, row in enumerate([tuple(names), *rows]))
    head, ns = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', MAIN.strip("{}")
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    xfs = "".join(f'<xf numFmtId="{n}" applyNumberFormat="1"/>' for n in (0, 14, 22, 46))
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{ns}" xmlns:r="{office}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{office}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{ns}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="4">{xfs}</cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{ns}"><sheetData>{body}</sheetData></worksheet>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, head + text)

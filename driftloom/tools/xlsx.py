"""A small reader and writer of workbooks: sheets of text cells, from the zip and XML parts of the format."""

from __future__ import annotations

import re
import zipfile
from pathlib import Path
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class WorkbookError(ValueError):
    pass


def _column(reference: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def _letters(index: int) -> str:
    out = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        out = chr(65 + rest) + out
    return out


def read_workbook(path: str | Path) -> dict[str, list[list[str | None]]]:
    """Rows of cells by sheet name; empty cells are None."""
    try:
        with zipfile.ZipFile(path) as z:
            shared = []
            if "xl/sharedStrings.xml" in z.namelist():
                shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
            targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
            out = {}
            for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
                target = targets[sheet.get(f"{_REL}id")]
                name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
                out[sheet.get("name")] = _rows(ET.fromstring(z.read(name)), shared)
            return out
    except (OSError, KeyError, zipfile.BadZipFile, ET.ParseError) as e:
        raise WorkbookError(f"cannot read workbook: {path}: {e}") from e


def _rows(sheet: ET.Element, shared: list[str]) -> list[list[str | None]]:
    rows: list[list[str | None]] = []
    for row in sheet.iter(f"{_MAIN}row"):
        at = int(row.get("r") or len(rows) + 1)
        while len(rows) < at - 1:
            rows.append([])
        cells: list[str | None] = []
        for c in row.iter(f"{_MAIN}c"):
            i = _column(c.get("r")) if c.get("r") else len(cells)
            cells += [None] * (i - len(cells))
            value = c.find(f"{_MAIN}v")
            text = value.text if value is not None else None
            if c.get("t") == "s" and text is not None:
                text = shared[int(text)]
            elif c.get("t") == "inlineStr":
                text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
            elif c.get("t") == "b":
                text = {"1": "true", "0": "false"}.get(text, text)
            cells.append(text)
        rows.append(cells)
    return rows


def write_workbook(path: str | Path, sheets: dict[str, list[list[str]]]) -> Path:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_REL[1:-1]}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:-1]}"><sheets>{names}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{i}" Type="{_REL[1:-1]}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r}">' + "".join(f'<c r="{_letters(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for c, v in enumerate(row) if v not in (None, "")) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
    return path

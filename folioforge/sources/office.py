"""Office files as blocks: zip archives of XML read with the standard library; PDF where a reader is installed."""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame

Block = tuple[str, str, list[str], dict]

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_P = "{http://schemas.openxmlformats.org/package/2006/relationships}"
_D = "{http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_MEDIA = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp"}


class BadFile(ValueError):
    """A file that its format's reader cannot read."""


def _plain(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _archive(data: bytes, kind: str) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise BadFile(f"not a readable {kind} file") from e


def _xml(archive: zipfile.ZipFile, name: str) -> ET.Element | None:
    try:
        return ET.fromstring(archive.read(name))
    except KeyError:
        return None
    except ET.ParseError as e:
        raise BadFile(f"broken part {name}") from e


def _related(archive: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Relationship id -> path inside the archive."""
    folder, name = posixpath.split(part)
    root = _xml(archive, f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels")
    if root is None:
        return {}
    return {r.get("Id", ""): posixpath.normpath(posixpath.join(folder, t)) if not (t := r.get("Target", "")).startswith("/") else t[1:] for r in root.iter(f"{_P}Relationship")}


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def _address(a1: str) -> tuple[int, int]:
    m = re.match(r"([A-Z]+)(\d+)$", a1)
    if not m:
        raise BadFile(f"bad cell address {a1!r}")
    column = 0
    for c in m[1]:
        column = column * 26 + ord(c) - 64
    return int(m[2]), column


# --- text documents -----------------------------------------------------------------------------------------


def _run_text(node: ET.Element) -> str:
    return "".join(x.text or "" if x.tag == f"{_W}t" else "\n" if x.tag in (f"{_W}br", f"{_W}cr") else "\t" for x in node.iter() if x.tag in (f"{_W}t", f"{_W}br", f"{_W}cr", f"{_W}tab"))


def _style_levels(archive: zipfile.ZipFile) -> dict[str, int]:
    root, out = _xml(archive, "word/styles.xml"), {}
    for style in root.iter(f"{_W}style") if root is not None else ():
        name = style.find(f"{_W}name")
        label = name.get(f"{_W}val", "") if name is not None else ""
        if m := re.match(r"heading ([1-6])$", label, re.IGNORECASE):
            out[style.get(f"{_W}styleId", "")] = int(m[1])
    return out


def docx_blocks(data: bytes) -> list[Block]:
    """Headings by style, runs of list paragraphs as one list, tables by rows; everything else paragraphs."""
    archive = _archive(data, "DOCX")
    root = _xml(archive, "word/document.xml")
    body = root.find(f"{_W}body") if root is not None else None
    if body is None:
        raise BadFile("a DOCX file without a body")
    levels = _style_levels(archive)
    out: list[Block] = []
    path: dict[int, str] = {}
    items: list[str] = []

    def here() -> list[str]:
        return [path[k] for k in sorted(path)]

    def flush() -> None:
        if items:
            out.append(("list", _plain("\n".join(f"- {x}" for x in items)), here(), {}))
            items.clear()

    for node in body:
        if node.tag == f"{_W}p":
            text = _plain(_run_text(node))
            style = node.find(f"{_W}pPr/{_W}pStyle")
            label = style.get(f"{_W}val", "") if style is not None else ""
            m = re.match(r"Heading([1-6])$", label)
            level = levels.get(label) or (int(m[1]) if m else None)
            if not text:
                continue
            if level:
                flush()
                path = {k: v for k, v in path.items() if k < level} | {level: text}
                out.append(("heading", text, here(), {}))
            elif node.find(f"{_W}pPr/{_W}numPr") is not None or label.startswith("List"):
                items.append(text)
            else:
                flush()
                out.append(("paragraph", text, here(), {}))
        elif node.tag == f"{_W}tbl":
            flush()
            rows = [" | ".join(_plain(" ".join(_run_text(p) for p in c.iter(f"{_W}p"))) for c in r.iter(f"{_W}tc")) for r in node.iter(f"{_W}tr")]
            if text := _plain("\n".join(rows)):
                out.append(("table", text, here(), {}))
    flush()
    return out


# --- workbooks ----------------------------------------------------------------------------------------------

_BUILTIN_DATES = frozenset((*range(14, 23), *range(45, 48)))


def _date_styles(archive: zipfile.ZipFile) -> set[int]:
    root = _xml(archive, "xl/styles.xml")
    if root is None:
        return set()
    custom = {int(f.get("numFmtId", 0)): f.get("formatCode", "") for f in root.iter(f"{_S}numFmt")}
    out = set()
    for k, xf in enumerate(root.findall(f"{_S}cellXfs/{_S}xf")):
        number = int(xf.get("numFmtId", 0))
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", custom.get(number, ""))
        if number in _BUILTIN_DATES or re.search(r"[ymdhs]", code, re.IGNORECASE):
            out.add(k)
    return out


def sheet_cells(data: bytes) -> list[tuple[str, int, int, str]]:
    """(sheet, row, column, text) of all cells that are not empty."""
    archive = _archive(data, "XLSX")
    book = _xml(archive, "xl/workbook.xml")
    if book is None:
        raise BadFile("an XLSX file without a workbook")
    strings_xml = _xml(archive, "xl/sharedStrings.xml")
    strings = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in strings_xml.iter(f"{_S}si")] if strings_xml is not None else []
    dates, parts, out = _date_styles(archive), _related(archive, "xl/workbook.xml"), []
    for sheet in book.iter(f"{_S}sheet"):
        root = _xml(archive, parts.get(sheet.get(f"{_R}id", ""), ""))
        for cell in root.iter(f"{_S}c") if root is not None else ():
            value, kind = cell.find(f"{_S}v"), cell.get("t", "n")
            text = value.text or "" if value is not None else ""
            if kind == "s" and text:
                text = strings[int(text)]
            elif kind == "inlineStr":
                text = "".join(t.text or "" for t in cell.iter(f"{_S}t"))
            elif kind == "b" and text:
                text = "true" if text == "1" else "false"
            elif kind == "n" and text and int(cell.get("s", 0)) in dates:
                text = (datetime(1899, 12, 30) + timedelta(days=float(text))).strftime("%Y-%m-%dT%H:%M:%S.000Z")
            elif kind == "n" and re.fullmatch(r"-?\d+\.0+", text):
                text = text.split(".")[0]
            if text := _plain(text):
                out.append((sheet.get("name", ""), *_address(cell.get("r", "")), text))
    return out


def regions(cells: list[tuple[str, int, int, str]]) -> list[Block]:
    """A table block for each run of neighbouring rows with a cell, with its bounding range."""
    sheets: dict[str, dict[int, dict[int, str]]] = {}
    for sheet, r, c, text in cells:
        sheets.setdefault(sheet, {}).setdefault(r, {})[c] = text
    out: list[Block] = []
    for sheet, rows in sheets.items():
        run: list[int] = []
        for r in [*sorted(rows), None]:
            if run and (r is None or r != run[-1] + 1):
                lo, hi = min(min(rows[k]) for k in run), max(max(rows[k]) for k in run)
                text = "\n".join(" | ".join(rows[k].get(c, "") for c in range(lo, hi + 1)) for k in run)
                out.append(("table", _plain(text), [sheet], {"sheet": sheet, "cell_range": f"{column_letters(lo)}{run[0]}:{column_letters(hi)}{run[-1]}"}))
                run = []
            run.append(r)
    return out


def xlsx_blocks(data: bytes) -> list[Block]:
    return regions(sheet_cells(data))


def pdf_blocks(data: bytes) -> list[Block]:
    """One paragraph per page that has text. Needs the optional package pypdf."""
    try:
        from pypdf import PdfReader
        from pypdf.errors import PyPdfError
    except ImportError as e:
        raise BadFile("PDF files need the optional package pypdf") from e
    try:
        pages = [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages]
    except PyPdfError as e:
        raise BadFile("not a readable PDF file") from e
    return [("paragraph", _plain(t), [], {"page": n}) for n, t in enumerate(pages, 1) if _plain(t)]


READERS = {"docx": docx_blocks, "xlsx": xlsx_blocks, "pdf": pdf_blocks}


# --- pictures -----------------------------------------------------------------------------------------------


def _media_type(name: str) -> str | None:
    return _MEDIA.get(name.rpartition(".")[2].lower())


def docx_images(data: bytes) -> list[tuple[str, bytes, dict]]:
    """(media type, bytes, location) in the order of the text; pictures that no part places come last."""
    archive = _archive(data, "DOCX")
    parts, placed = _related(archive, "word/document.xml"), []
    root = _xml(archive, "word/document.xml")
    for blip in root.iter(f"{_A}blip") if root is not None else ():
        placed.append(parts.get(blip.get(f"{_R}embed", ""), ""))
    names = [*placed, *(n for n in sorted(archive.namelist()) if n.startswith("word/media/") and n not in placed)]
    return _unique([(kind, archive.read(n), {"image_index": k}) for k, n in enumerate(names, 1) if n in archive.NameToInfo and (kind := _media_type(n))])


def xlsx_images(data: bytes) -> list[tuple[str, bytes, dict]]:
    """(media type, bytes, location with sheet and anchor cell): workbook -> sheet -> drawing -> picture."""
    archive = _archive(data, "XLSX")
    book = _xml(archive, "xl/workbook.xml")
    parts, out, placed = _related(archive, "xl/workbook.xml"), [], set()
    for sheet in book.iter(f"{_S}sheet") if book is not None else ():
        part = parts.get(sheet.get(f"{_R}id", ""), "")
        for drawing in (d for d in _related(archive, part).values() if "/drawings/" in d and d.endswith(".xml")):
            root, media = _xml(archive, drawing), _related(archive, drawing)
            for anchor in root if root is not None else ():
                corner = anchor.find(f"{_D}from")
                cell = f"{column_letters(int(corner.findtext(f'{_D}col', '0')) + 1)}{int(corner.findtext(f'{_D}row', '0')) + 1}" if corner is not None else None
                for blip in anchor.iter(f"{_A}blip"):
                    name = media.get(blip.get(f"{_R}embed", ""), "")
                    if name in archive.NameToInfo and (kind := _media_type(name)):
                        placed.add(name)
                        out.append((kind, archive.read(name), {"sheet": sheet.get("name"), "cell_range": cell, "image_index": len(out) + 1}))
    for name in sorted(archive.namelist()):
        if name.startswith("xl/media/") and name not in placed and (kind := _media_type(name)):
            out.append((kind, archive.read(name), {"image_index": len(out) + 1}))
    return _unique(out)


def _unique(images: list[tuple[str, bytes, dict]]) -> list[tuple[str, bytes, dict]]:
    seen: set[bytes] = set()
    return [x for x in images if not ((h := hashlib.sha256(x[1]).digest()) in seen or seen.add(h))]


# --- on DataFrames --------------------------------------------------------------------------------------------

_LOCATION = "page int, sheet string, cell_range string, image_index int"


def office_blocks(files: DataFrame, key: str = "document_id") -> DataFrame:
    """files(key, source_type, content) -> (key, block_index, kind, text, heading_path, page, sheet, cell_range, image_index, error).

    A file that cannot be read gives one row with its error and no block.
    """
    rows = files.select(key, "source_type", "content")
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, block_index int, kind string, text string, heading_path array<string>, {_LOCATION}, error string"
    names = [key, "block_index", "kind", "text", "heading_path", "page", "sheet", "cell_range", "image_index", "error"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, kind, content in zip(frame[key], frame["source_type"], frame["content"], strict=True):
                try:
                    if kind not in READERS:
                        raise BadFile(f"no reader for {kind}")
                    found = READERS[kind](bytes(content or b""))
                except BadFile as e:
                    out.append((k, None, None, None, None, None, None, None, None, str(e)))
                    continue
                out += [(k, i, b, t, p, at.get("page"), at.get("sheet"), at.get("cell_range"), at.get("image_index"), None) for i, (b, t, p, at) in enumerate(found)]
            yield pd.DataFrame(out, columns=names).astype({"block_index": "Int32", "page": "Int32", "image_index": "Int32"})

    return rows.mapInPandas(run, schema)

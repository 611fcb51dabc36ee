"""Office documents to element rows: XLSX and DOCX by their XML, PDF by its plain text streams."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.text import file_type

MAX_MB = 5
SCHEMA = "path string, ord int, type string, level int, content string, items array<string>, rows array<array<string>>, attrs map<string,string>, error string"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
_D, _T, _C = "{http://purl.org/dc/elements/1.1/}", "{http://purl.org/dc/terms/}", "{http://schemas.openxmlformats.org/package/2006/metadata/core-properties}"
#: Properties of office documents and the elements of their core properties part.
DOCX_PROPERTIES = {
    "title": f"{_D}title", "author": f"{_D}creator", "comments": f"{_D}description", "category": f"{_C}category", "created": f"{_T}created", "modified": f"{_T}modified",
    "last_modified_by": f"{_C}lastModifiedBy", "revision": f"{_C}revision", "keywords": f"{_C}keywords", "subject": f"{_D}subject",
}
XLSX_PROPERTIES = {"title": f"{_D}title", "subject": f"{_D}subject", "creator": f"{_D}creator", "created": f"{_T}created", "modified": f"{_T}modified"}
_PICTURE = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
_PIC = "{http://schemas.openxmlformats.org/drawingml/2006/picture}"


def _element(type_: str, content: str = "", level: int = 0, items: list | None = None, rows: list | None = None, **attrs: str) -> dict:
    return {"type": type_, "level": level, "content": content, "items": items or [], "rows": rows or [], "attrs": attrs}


def _properties(z: zipfile.ZipFile, wanted: dict[str, str]) -> dict[str, str]:
    """The core properties that a document has, times without their zone."""
    if "docProps/core.xml" not in z.namelist():
        return {}
    core = ElementTree.fromstring(z.read("docProps/core.xml"))
    return {k: re.sub(r"Z$", "", v) if k in ("created", "modified") else v for k, at in wanted.items() if (v := core.findtext(at))}


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx(data: bytes) -> Iterator[dict]:
    """A heading and a table a sheet; rows without a value are left out, cells after the last value too."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        sheets = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]
        yield _element("metadata", source="workbook_properties", sheets="\n".join(sheets), **_properties(z, XLSX_PROPERTIES))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            rows = []
            for row in ElementTree.fromstring(z.read("xl/" + targets[sheet.get(f"{_R}id")].removeprefix("/xl/"))).iter(f"{_S}row"):
                cells: list[str] = []
                for c in row.iter(f"{_S}c"):
                    at = _column(c.get("r") or "") if c.get("r") else len(cells)
                    v = c.find(f"{_S}v")
                    text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else (v.text or "" if v is not None else "")
                    if c.get("t") == "s" and text:
                        text = shared[int(text)]
                    cells += [""] * (at + 1 - len(cells))
                    cells[at] = re.sub(r"^(-?\d+)\.0+$", r"\1", text)
                while cells and not cells[-1]:
                    cells.pop()
                if cells:
                    rows.append(cells)
            if rows:
                yield _element("heading", f"Sheet: {sheet.get('name')}", 2)
                yield _element("table", rows=rows)


def _runs(p) -> str:
    out = []
    for r in p.iter(f"{_W}r"):
        text = "".join(t.text or "" for t in r.iter(f"{_W}t"))
        if not text.strip():
            out.append(text)
            continue
        props = r.find(f"{_W}rPr")
        for name, mark in (("b", "**"), ("i", "*"), ("u", "__")):
            if props is not None and props.find(f"{_W}{name}") is not None and props.find(f"{_W}{name}").get(f"{_W}val") not in ("0", "false", "none"):
                text = f"{mark}{text}{mark}"
        out.append(text)
    return "".join(out).strip()


def _style(p) -> dict[str, str]:
    """Style, alignment, indentation and spacing of a paragraph, where it has them."""
    props = p.find(f"{_W}pPr")
    if props is None:
        return {}
    wanted = {"style": ("pStyle", "val"), "alignment": ("jc", "val"), "indent": ("ind", "left"), "space_before": ("spacing", "before"), "space_after": ("spacing", "after")}
    return {k: v for k, (tag, name) in wanted.items() if (x := props.find(f"{_W}{tag}")) is not None and (v := x.get(f"{_W}{name}"))}


def _images(z: zipfile.ZipFile, body) -> Iterator[dict]:
    """Pictures in the order of the text, by their relationships; one whose part isn't there is a warning."""
    names, targets = set(z.namelist()), {}
    if "word/_rels/document.xml.rels" in names:
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("word/_rels/document.xml.rels"))}
    n, seen = 0, set()
    for drawing in body.iter(f"{_W}drawing"):
        for blip in drawing.iter(f"{_PICTURE}blip"):
            link = blip.get(f"{_R}embed")
            part = "word/" + targets.get(link, "").removeprefix("/word/")
            if part not in names:
                yield _element("warning", f"Image relationship {link} not found")
                continue
            n += 1
            seen.add(part)
            told = [x.get(k) for t in (f"{_DRAWING}docPr", f"{_PIC}cNvPr") for x in drawing.iter(t) for k in ("descr", "title") if x.get(k)]
            size = next(({"width": e.get("cx", ""), "height": e.get("cy", "")} for e in drawing.iter(f"{_DRAWING}extent")), {})
            yield _element("image", part, src=part, alt_text=told[0] if told else f"Image {n}", image_number=str(n), **size)
    for part in sorted(x for x in names if x.startswith("word/media/") and x not in seen):
        n += 1
        yield _element("image", part, src=part, alt_text=f"Image {n}", image_number=str(n))


def docx(data: bytes) -> Iterator[dict]:
    """Properties, headings, lists (all items, flushed at another list, at what follows and at the end), tables, equations,
    then images. A list is ordered if its first item starts with a number, which then isn't part of the items."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if found := _properties(z, DOCX_PROPERTIES):
            yield _element("metadata", source="document_properties", **found)
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        items: list[str] = []
        listed = None

        def flush() -> Iterator[dict]:
            if items:
                ordered = bool(re.match(r"\d+\.?\s", items[0]))
                texts = [re.sub(r"^(\s*)\d+\.?\s+", r"\1", x) if ordered else x for x in items]
                yield _element("list", items=texts, level=1, ordered=str(ordered).lower(), list_id=listed or "")
                items.clear()

        for x in body:
            number = x.find(f"{_W}pPr/{_W}numPr") if x.tag == f"{_W}p" else None
            own = number.find(f"{_W}numId") if number is not None else None
            own = own.get(f"{_W}val") if own is not None else None
            if items and (number is None or own != listed):
                yield from flush()
            listed = own
            if x.tag == f"{_W}tbl":
                cell = lambda c: " ".join(t for p in c.iter(f"{_W}p") if (t := "".join(w.text or "" for w in p.iter(f"{_W}t")).strip()))
                style = x.find(f"{_W}tblPr/{_W}tblStyle")
                yield _element("table", rows=[[cell(c) for c in r.iter(f"{_W}tc")] for r in x.iter(f"{_W}tr")], **({"style": style.get(f"{_W}val", "")} if style is not None else {}))
            elif x.tag == f"{_W}p":
                style = _style(x)
                heading = re.fullmatch(r"Heading\s*(\d)", style.get("style", ""))
                text = _runs(x)
                if number is not None:
                    depth = number.find(f"{_W}ilvl")
                    items.append("    " * int(depth.get(f"{_W}val", "0") if depth is not None else 0) + text)
                elif heading:
                    yield _element("heading", text, int(heading[1]), **style)
                elif text:
                    yield _element("paragraph", text, **style)
                for m in x.iter(f"{_M}oMath"):
                    yield _element("math", "".join(t.text or "" for t in m.iter(f"{_M}t")))
        yield from flush()
        yield from _images(z, body)


#: Heading forms of plain page text with their levels, and list marks.
PDF_HEADINGS = ((r"(?:Chapter|Book)\s+\w+.*", 1), (r"(?:Section|Part)\s+\w+.*", 2), (r"\d+\.\d+\s+\S.*", 3), (r"\d+\.\s+\S.*", 3), (r"[A-Z][A-Z0-9 ,&-]{3,}", 2))
PDF_LIST = r"^\s*(?:[•‣▪*-]|\d+[.)]|[a-z][.)]|\[[ x]\])\s+"


def _pdf_text(stream: bytes) -> str:
    out = []
    for m in re.finditer(rb"\((?:\\.|[^\\()])*\)\s*(?:Tj|'|\")|\[(?:[^\]\\]|\\.)*\]\s*TJ|T\*|\bTd\b|\bTD\b|\bET\b", stream):
        got = m[0]
        if got.endswith((b"T*", b"Td", b"TD", b"ET")):
            out.append("\n")
            continue
        for s in re.findall(rb"\(((?:\\.|[^\\()])*)\)", got):
            s = re.sub(rb"\\(\d{1,3})", lambda o: bytes([int(o[1], 8) & 255]), s)
            out.append(re.sub(rb"\\(.)", rb"\1", s).decode("latin-1"))
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip()


def page_elements(text: str) -> Iterator[dict]:
    """Paragraphs, headings, lists and grid tables of a page's text."""
    items: list[str] = []
    for block in re.split(r"\n\s*\n", text):
        rows = [[c.strip() for c in re.split(r"\s*\|\s*|\s{3,}", x.strip(" |"))] for x in block.split("\n") if x.strip()]
        if len(rows) >= 2 and all(len(r) >= 2 for r in rows):
            yield _element("table", rows=rows)
            continue
        for line in filter(None, map(str.strip, block.split("\n"))):
            level = next((n for p, n in PDF_HEADINGS if len(line) <= 100 and line[-1] not in ".?!" and re.fullmatch(p, line)), None)
            if level is None and re.match(PDF_LIST, line):
                items.append(re.sub(PDF_LIST, "", line))
                continue
            if items:
                yield _element("list", items=items, level=1)
                items = []
            yield _element("heading", line, level) if level else _element("paragraph", line)
    if items:
        yield _element("list", items=items, level=1)


def _pdf_information(data: bytes) -> dict[str, str]:
    """Texts of the document information, dates as ISO."""
    link = re.search(rb"/Info\s+(\d+)\s+(\d+)\s+R", data)
    found = re.search(rb"(?:^|\s)%s\s+%s\s+obj\s*<<(.*?)>>" % (link[1], link[2]), data, re.S) if link else None
    out = {}
    for name, text in re.findall(rb"/(\w+)\s*\(((?:\\.|[^\\()])*)\)", found[1]) if found else []:
        value = re.sub(rb"\\(.)", rb"\1", text).decode("latin-1")
        date = re.fullmatch(r"(?:D:)?(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d).*", value) if name.endswith(b"Date") else None
        out[name.decode()] = "{}-{}-{}T{}:{}:{}".format(*date.groups()) if date else value
    return {k: v for k, v in out.items() if v}


def pdf(data: bytes) -> Iterator[dict]:
    """Document information, then pages with plain or deflated text streams, numbered; images are numbered rows without
    their data, and streams of other filters are warnings. A file without any text stream is refused, not guessed at."""
    if not data.startswith(b"%PDF"):
        raise ValueError("not a PDF")
    if found := _pdf_information(data):
        yield _element("metadata", source="pdf_metadata", **found)
    n = images = 0
    for m in re.finditer(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", data, re.S):
        head = m[1].replace(b" ", b"")
        if b"/Subtype/Image" in head:
            images += 1
            kind = re.search(rb"/Filter/(\w+)", head)
            form = {b"DCTDecode": "jpeg", b"JPXDecode": "jp2"}.get(kind[1] if kind else b"", "png")
            yield _element("image", "", alt_text=f"Image {images}", image_number=str(images), format=form)
            continue
        if b"/Filter" in head and b"FlateDecode" not in head:
            yield _element("warning", "a stream with a filter that isn't read")
            continue
        stream = zlib.decompress(m[2]) if b"FlateDecode" in head else m[2]
        if b"Tj" in stream or b"TJ" in stream:
            n += 1
            yield _element("heading", f"Page {n}", 2)
            yield from page_elements(_pdf_text(stream))
    if not n:
        raise ValueError("no plain text stream found")


CONVERTERS = {"pdf": pdf, "docx": docx, "xlsx": xlsx}


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of files under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def elements(found: DataFrame, max_mb: float = MAX_MB) -> DataFrame:
    """Element rows of files (path, length, content); a file that can't be converted is one row with an error."""
    kind = file_type("path")
    why = F.when(kind.isNull(), "unsupported file type").when(F.col("length") > max_mb * (1 << 20), "file too large")
    judged = found.select("path", kind.alias("kind"), why.alias("why"), F.when(why.isNull(), F.col("content")).alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, kind, why, content in zip(b["path"], b["kind"], b["why"], b["content"], strict=True):
                try:
                    if why:
                        raise ValueError(why)
                    if kind not in CONVERTERS:
                        raise ValueError(f"no converter for {kind}")
                    made = [{"path": path, "ord": i, **e, "error": None} for i, e in enumerate(CONVERTERS[kind](bytes(content)))]
                except Exception as e:  # noqa: BLE001  a file's failure is its row's result
                    made = [{"path": path, "ord": 0, **_element("error"), "error": f"{e}"}]
                rows += made
            yield pd.DataFrame(rows, columns=["path", "ord", "type", "level", "content", "items", "rows", "attrs", "error"]).astype({"level": "Int32"})

    return judged.mapInPandas(run, SCHEMA)


def warnings(found: DataFrame) -> DataFrame:
    """(path, success, warnings) of element rows: a file's error and warnings in order."""
    told = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("type") == "warning", F.col("content"))
    listed = F.array_sort(F.collect_list(F.when(told.isNotNull(), F.struct("ord", told.alias("text")))))
    return found.groupBy("path").agg((F.count("error") == 0).alias("success"), F.transform(listed, lambda x: x["text"]).alias("warnings"))

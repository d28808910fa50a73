"""Parsers of single files: bytes in, an outcome row out, never an exception.

An outcome is (status, parser, error, blocks, outline, page_count, images).
Blocks are (ix, text, page_no, kind, level): ``level`` marks headings.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.sources import pdf

PARSED = (
    "path string, status string, parser string, error string, encoding string, page_count int, image_count int, "
    "blocks array<struct<ix:int,text:string,page_no:int,kind:string,level:int>>, "
    "outline array<struct<ord:int,level:int,title:string,path:string>>"
)
_HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")
_BLOCK_ENDS = {"p", "div", "li", "td", "th", "tr", "table", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6"}
_SILENT = {"script", "style", "noscript", "head", "title"}
_WORDS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SHEETS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_SLIDES = "{http://schemas.openxmlformats.org/drawingml/2006/main}"

Block = tuple[str, int, str, int | None]  # text, page, kind, heading level


def decode(data: bytes) -> tuple[str, str]:
    """Text and the encoding that fits: UTF-8, Turkish Windows, Latin-1."""
    for name in ("utf-8-sig", "cp1254", "latin-1"):
        try:
            return data.decode(name), name
        except UnicodeDecodeError:
            continue
    raise AssertionError("latin-1 decodes anything")


def outline(headings: list[tuple[int, str]]) -> list[tuple[int, int, str, str]]:
    """Preorder (ord, level, title, path); levels may be skipped."""
    open_: list[tuple[int, str]] = []
    out = []
    for i, (level, title) in enumerate(headings):
        open_ = [x for x in open_ if x[0] < level] + [(level, title)]
        out.append((i, level, title, " > ".join(t for _, t in open_)))
    return out


def plain(text: str) -> list[Block]:
    parts = (p.strip() for p in re.split(r"\n\s*\n", text))
    return [(p, 1, "text", None) for p in parts if p]


def markdown(text: str) -> list[Block]:
    out: list[Block] = []
    held: list[str] = []
    for line in [*text.splitlines(), None]:
        found = _HEADING.match(line) if line is not None else None
        if line is None or found:
            body = "\n".join(held).strip()
            if body:
                out.append((body, 1, "text", None))
            held = []
            if found and found[2]:
                out.append((found[2], 1, "heading", len(found[1])))
        else:
            held.append(line)
    return out


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[Block] = []
        self.held: list[str] = []
        self.silent, self.level = 0, None

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        self.held = []
        if text:
            self.out.append((text, 1, "heading" if self.level else "text", self.level))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SILENT:
            self.silent += 1
        elif re.fullmatch(r"h[1-6]", tag):
            self.flush()
            self.level = int(tag[1])
        elif tag == "br":
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in _BLOCK_ENDS:
            self.flush()
            if re.fullmatch(r"h[1-6]", tag):
                self.level = None

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.held.append(data)


def html(text: str) -> list[Block]:
    page = _Page()
    page.feed(text)
    page.close()
    page.flush()
    return page.out


_RELATIONS = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


class _Package:
    """Parts of an office file, and what they point at."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())

    def xml(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(name))

    def links(self, name: str) -> dict[str, str]:
        """Part names by the ids that a part knows them by."""
        folder, _, file = name.rpartition("/")
        rels = f"{folder}/_rels/{file}.rels"
        if rels not in self.names:
            return {}
        target = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(f"{folder}/{t}")
        return {r.get("Id", ""): target(r.get("Target", "")) for r in self.xml(rels).iter(_RELATIONS)}


def _joined(cells: list[list[str]]) -> str:
    return "\n".join(" | ".join(r) for r in cells if any(c for c in r))


def docx(data: bytes) -> list[Block]:
    out: list[Block] = []
    body = _Package(data).xml("word/document.xml").find(f"{_WORDS}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_WORDS}t")).strip()

    def cells(row: ElementTree.Element) -> list[str]:
        """A cell that goes on from the one above is empty; one over several
        columns is followed by empty ones."""
        out: list[str] = []
        for c in row.findall(f"{_WORDS}tc"):
            merge = c.find(f"{_WORDS}tcPr/{_WORDS}vMerge")
            goes_on = merge is not None and merge.get(f"{_WORDS}val", "continue") == "continue"
            span = c.find(f"{_WORDS}tcPr/{_WORDS}gridSpan")
            wide = int(span.get(f"{_WORDS}val", "1")) if span is not None else 1
            out += ["" if goes_on else text(c), *[""] * (wide - 1)]
        return out

    for e in body if body is not None else []:
        if e.tag == f"{_WORDS}tbl":
            out.append((_joined([cells(r) for r in e.iter(f"{_WORDS}tr")]), 1, "table", None))
        elif e.tag == f"{_WORDS}p" and text(e):
            style = next((s.get(f"{_WORDS}val", "") for s in e.iter(f"{_WORDS}pStyle")), "")
            found = re.fullmatch(r"(?i)heading\s*(\d)", style)
            level = 1 if style.lower() == "title" else int(found[1]) + 1 if found else None
            out.append((text(e), 1, "heading" if level else "text", level))
    return out


def _column(reference: str) -> int:
    """The number of a cell's column, from a reference such as AB12."""
    out = 0
    for ch in re.match(r"[A-Za-z]*", reference)[0].upper():
        out = out * 26 + ord(ch) - 64
    return out - 1


def xlsx(data: bytes) -> list[Block]:
    package = _Package(data)
    shared: list[str] = []
    if "xl/sharedStrings.xml" in package.names:
        root = package.xml("xl/sharedStrings.xml")
        shared = ["".join(t.text or "" for t in s.iter(f"{_SHEETS}t")) for s in root.iter(f"{_SHEETS}si")]
    files = package.links("xl/workbook.xml")
    out: list[Block] = []
    page = 0
    for sheet in package.xml("xl/workbook.xml").iter(f"{_SHEETS}sheet"):
        rows = []
        for r in package.xml(files[sheet.get(_LINK, "")]).iter(f"{_SHEETS}row"):
            cells: dict[int, str] = {}
            for c in r.iter(f"{_SHEETS}c"):
                v = c.find(f"{_SHEETS}v")
                raw = "".join(t.text or "" for t in c.iter(f"{_SHEETS}t")) if v is None else v.text or ""
                at = _column(c.get("r", "")) if c.get("r") else max(cells, default=-1) + 1
                cells[at] = (shared[int(raw)] if c.get("t") == "s" and raw else raw).strip()
            rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        body = _joined(rows)
        if body:
            page += 1
            out += [(sheet.get("name", ""), page, "heading", 1), (body, page, "table", None)]
    return out


def pptx(data: bytes) -> list[Block]:
    package = _Package(data)
    files = package.links("ppt/presentation.xml")
    listed = [e.get(_LINK, "") for e in package.xml("ppt/presentation.xml").iter() if e.tag.endswith("}sldId")]
    out: list[Block] = []
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_SLIDES}t")).strip()
    for page, link in enumerate(listed, 1):
        root = package.xml(files[link])
        in_table = {p for t in root.iter(f"{_SLIDES}tbl") for p in t.iter(f"{_SLIDES}p")}
        titled = {p for s in root.iter() if s.tag.endswith("}sp") and any(x.get("type") in ("title", "ctrTitle") for x in s.iter() if x.tag.endswith("}ph")) for p in s.iter(f"{_SLIDES}p")}
        for p in root.iter(f"{_SLIDES}p"):
            if p not in in_table and text(p):
                out.append((text(p), page, "heading" if p in titled else "text", 1 if p in titled else None))
        for t in root.iter(f"{_SLIDES}tbl"):
            out.append((_joined([[text(c) for c in r.iter(f"{_SLIDES}tc")] for r in t.iter(f"{_SLIDES}tr")]), page, "table", None))
    return out


def _unavailable(what: str) -> Callable[[bytes], list[Block]]:
    def parse(data: bytes) -> list[Block]:
        raise RuntimeError(f"{what} is not installed")

    return parse


@dataclass(frozen=True)
class Parser:
    """One link of the chain: what it costs, what it takes, how it reads."""

    name: str
    cost: int
    suffixes: dict[str, Callable]
    textual: bool = False


_IMAGES = (".png", ".jpg", ".jpeg", ".tif", ".tiff")
#: Links that need libraries which are not there keep their place, and say so.
CHAIN = (
    Parser("text", 5, {".txt": plain, ".md": markdown, ".markdown": markdown, ".html": html, ".htm": html}, True),
    Parser("docx", 10, {".docx": docx}),
    Parser("pdf", 10, {".pdf": pdf.read}),
    Parser("pptx", 10, {".pptx": pptx}),
    Parser("xlsx", 10, {".xlsx": xlsx}),
    Parser("ocr", 100, {s: _unavailable("OCR") for s in (".pdf", *_IMAGES)}),
    Parser("docling", 200, {".pdf": _unavailable("a layout parser")}),
)
_BY_NAME = {p.name: p for p in CHAIN}


def suffix(path: str) -> str:
    found = re.search(r"\.[^./]*$", path.lower())
    return found[0] if found else ""


def handlers(path: str) -> list[str]:
    """Names of the parsers that take a file, the cheapest first."""
    return [p.name for p in sorted(CHAIN, key=lambda p: (p.cost, p.name)) if suffix(path) in p.suffixes]


def candidates(path: Column) -> Column:
    """The same as an array column."""
    ending = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    order = sorted(CHAIN, key=lambda p: (p.cost, p.name))
    return F.array_compact(F.array(*[F.when(ending.isin(*p.suffixes), p.name) for p in order]))


def parse(path: str, data: bytes, name: str | None = None) -> tuple:
    """An outcome row for one file, by a parser or by the first that takes it."""
    names = handlers(path)
    if not names or name is not None and name not in names:
        return path, "failed", name or "none", f"no parser can handle {suffix(path) or 'a file without a suffix'}", None, 0, 0, [], []
    used = _BY_NAME[name or names[0]]
    try:
        text, encoding = decode(data) if used.textual else (None, None)
        blocks = used.suffixes[suffix(path)](text if used.textual else data)
        if not blocks:
            raise ValueError("the file has no text")
    except Exception as e:  # noqa: BLE001  a bad file is a row, not a failed job
        return path, "failed", used.name, f"{type(e).__name__}: {e}", None, 0, 0, [], []
    heads = outline([(level, text) for text, _, kind, level in blocks if kind == "heading" and level])
    rows = [(i, *b) for i, b in enumerate(blocks)]
    return path, "ok", used.name, None, encoding, max(b[1] for b in blocks), 0, rows, heads


def parse_files(files: DataFrame) -> DataFrame:
    """Outcomes of ``files`` (path, content), by the parser named in ``parser``
    if there is such a column."""
    named = "parser" in files.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "status", "parser", "error", "encoding", "page_count", "image_count", "blocks", "outline"]
        block = ("ix", "text", "page_no", "kind", "level")
        head = ("ord", "level", "title", "path")
        for pdf_ in batches:
            wanted = pdf_["parser"] if named else [None] * len(pdf_)
            rows = [parse(p, bytes(c or b""), n) for p, c, n in zip(pdf_["path"], pdf_["content"], wanted, strict=True)]
            rows = [(*r[:7], [dict(zip(block, b, strict=True)) for b in r[7]], [dict(zip(head, h, strict=True)) for h in r[8]]) for r in rows]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content", *(["parser"] if named else [])).mapInPandas(run, PARSED)

"""Files to text blocks: text, Markdown, notebooks, web pages, Office documents. A file that cannot be read becomes a
row with a status, never an error."""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions.text import file_kind
from tracelode.functions.udfs import decoded

TEXT_LIMIT, PACKED_LIMIT, OUTPUT_LIMIT = 20 << 20, 1 << 30, 2_000
SCHEMA = "path string, sha string, status string, note string, blocks array<struct<text:string,unit:string,start:int>>"
Block = tuple[str, str, int]


def notebook(text: str) -> list[Block]:
    """One block for each cell that is not empty, with its text outputs, cut at OUTPUT_LIMIT characters."""
    out = []
    for n, cell in enumerate(json.loads(text).get("cells", []), 1):
        join = lambda x: "".join(x) if isinstance(x, list) else x or ""
        parts = [join(cell.get("source"))]
        for o in cell.get("outputs", []):
            shown = join(o.get("text") or (o.get("data") or {}).get("text/plain"))
            if len(shown) > OUTPUT_LIMIT:
                shown = f"{shown[:OUTPUT_LIMIT]}\n[{len(shown) - OUTPUT_LIMIT} more characters]"
            parts.append(shown)
        whole = "\n".join(p for p in parts if p.strip())
        if whole.strip():
            out.append((whole, "cell", n))
    return out


class _Page(HTMLParser):
    """Text of a page's main part as Markdown: headings, list items, table rows and links; no navigation or scripts."""

    SKIPPED = {"script", "style", "nav", "footer", "header", "aside", "form", "noscript", "template", "svg", "button"}
    BREAKS = {"p", "div", "section", "article", "br", "li", "tr", "ul", "ol", "table", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.main: list[str] = []
        self.depth = self.inside = 0
        self.title = ""
        self._in_title = False

    def _put(self, text: str) -> None:
        self.out.append(text)
        if self.inside:
            self.main.append(text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._in_title = tag == "title"
        self.depth += tag in self.SKIPPED
        self.inside += tag in ("main", "article")
        if tag in self.BREAKS:
            self._put("\n\n" if tag[0] == "h" and tag[1:].isdigit() or tag == "p" else "\n")
        if re.fullmatch("h[1-6]", tag):
            self._put("#" * int(tag[1]) + " ")
        if tag == "li":
            self._put("- ")
        if tag in ("td", "th"):
            self._put(" | ")

    def handle_endtag(self, tag: str) -> None:
        self._in_title = False
        self.depth -= tag in self.SKIPPED and self.depth > 0
        if tag in self.BREAKS:
            self._put("\n")
        self.inside -= tag in ("main", "article") and self.inside > 0

    def handle_data(self, data: str) -> None:
        if self._in_title:
            self.title += data
        elif not self.depth:
            self._put(re.sub(r"\s+", " ", data))


def page_text(html: str, least: int = 200) -> str | None:
    """The main text of a page; None below `least` characters."""
    page = _Page()
    page.feed(html)
    for parts in (page.main, page.out):
        text = re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", "".join(parts))).strip()
        if len(text) >= least:
            return text
    return None


def charset(content_type: str | None, data: bytes) -> str | None:
    """What a page says of its encoding: the header first, then its own meta element."""
    for pattern, source in ((r"charset=[\"']?([\w\-]+)", content_type or ""), (r"<meta[^>]+charset=[\"']?([\w\-]+)", data[:2048].decode("latin-1"))):
        if m := re.search(pattern, source, re.I):
            return m[1]
    return None


def _xml_texts(data: bytes, paragraph: str, run: str) -> list[str]:
    root = ElementTree.fromstring(data)
    return ["".join(t.text or "" for t in p.iter(run)) for p in root.iter(paragraph)]


_W, _A, _S = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "{http://schemas.openxmlformats.org/drawingml/2006/main}", "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx(data: bytes) -> list[Block]:
    """Paragraphs of a document, headings marked by level, table cells by bars."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out, seen = [], set()
    for element in root.iter():
        if element.tag == f"{_W}tr":
            cells = ["".join(t.text or "" for t in c.iter(f"{_W}t")).replace("|", r"\|") for c in element.iter(f"{_W}tc")]
            seen.update(id(p) for p in element.iter(f"{_W}p"))
            out.append("| " + " | ".join(cells) + " |")
        elif element.tag == f"{_W}p" and id(element) not in seen:
            text = "".join(t.text or "" for t in element.iter(f"{_W}t"))
            style = element.find(f"{_W}pPr/{_W}pStyle")
            level = re.fullmatch(r"Heading(\d)", style.get(f"{_W}val", "")) if style is not None else None
            if text.strip():
                out.append(("#" * int(level[1]) + " " if level else "") + text)
    return [("\n\n".join(out), "line", 1)] if out else []


def pptx(data: bytes) -> list[Block]:
    """One block for each slide."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        blocks = [("\n".join(t for t in _xml_texts(z.read(n), f"{_A}p", f"{_A}t") if t.strip()), "page", i) for i, n in slides]
    return [b for b in blocks if b[0]]


def spreadsheet(data: bytes) -> list[Block]:
    """One block of tab-separated values for each sheet."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = _xml_texts(z.read("xl/sharedStrings.xml"), f"{_S}si", f"{_S}t") if "xl/sharedStrings.xml" in z.namelist() else []
        out = []
        for i, name in sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n))):
            rows = []
            for row in ElementTree.fromstring(z.read(name)).iter(f"{_S}row"):
                cells = []
                for c in row.iter(f"{_S}c"):
                    v = c.find(f"{_S}v")
                    inline = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    cells.append(shared[int(v.text)] if v is not None and c.get("t") == "s" else inline or (v.text if v is not None else "") or "")
                rows.append("\t".join(cells))
            if any(r.strip() for r in rows):
                out.append(("\n".join(rows), "page", i))
    return out


def read(kind: str, data: bytes) -> tuple[str, str, list[Block]]:
    """(status, note, blocks) of one file's bytes."""
    try:
        if kind == "unsupported" or kind == "pdf":
            return "unsupported", "" if kind == "unsupported" else "no PDF reader is installed", []
        if kind in ("docx", "pptx", "spreadsheet"):
            if len(data) > PACKED_LIMIT:
                return "too_large", "over 1 GiB", []
            blocks = {"docx": docx, "pptx": pptx, "spreadsheet": spreadsheet}[kind](data)
            return ("ok", "", blocks) if blocks else ("needs_ocr", "no text in it", [])
        if len(data) > TEXT_LIMIT:
            return "too_large", "over 20 MiB", []
        if b"\0" in data[:8192] and not data.startswith((b"\xff\xfe", b"\xfe\xff")):
            return "binary", "", []
        text = decoded(data)
        if kind == "notebook":
            return "ok", "", notebook(text)
        if kind == "html":
            main = page_text(text)
            return ("ok", "", [(main, "line", 1)]) if main else ("needs_ocr", "no main text", [])
        return "ok", "", [(text, "line", 1)] if text.strip() else []
    except Exception as error:  # noqa: BLE001 - a broken file is a row, not a failure
        return "error", f"{type(error).__name__}: {error}"[:200], []


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = pa.list_(pa.struct([("text", pa.string()), ("unit", pa.string()), ("start", pa.int32())]))
    for batch in batches:
        for row in batch.to_pylist():
            status, note, blocks = read(row["kind"], row["content"] or b"")
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["path"]]), pa.array([hashlib.sha256(row["content"] or b"").hexdigest()]), pa.array([status]), pa.array([note]), pa.array([[{"text": t, "unit": u, "start": s} for t, u, s in blocks]], block)], names=["path", "sha", "status", "note", "blocks"]
            )


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, modified, kind, content) of all files below a folder, read by the cluster."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.regexp_replace("path", "^file:/*", "/")
    return rows.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), file_kind(path).alias("kind"), "content")


def parsed(rows: DataFrame) -> DataFrame:
    """(path, sha, status, note, blocks) of files."""
    return rows.select("path", "kind", "content").mapInArrow(_read, SCHEMA)


def links(text: str) -> list[tuple[str, str]]:
    """(title, address) of Markdown links and bare addresses, each once, in order; a bare one's title is the line before."""
    found: dict[str, tuple[int, str]] = {}
    for m in re.finditer(r"\[([^\]\n]*)\]\((https?://[^\s)]+)\)", text):
        found.setdefault(m[2], (m.start(), m[1]))
    for m in re.finditer(r"https?://[^\s<>)\]\"']+", text):
        url = m[0].rstrip(".,;:!?")
        before = text[: m.start()].rstrip("\n ").rsplit("\n", 1)[-1].strip() if "\n" in text[: m.start()] else ""
        found.setdefault(url, (m.start(), before))
    return [(title, url) for url, (_, title) in sorted(found.items(), key=lambda x: x[1][0])]

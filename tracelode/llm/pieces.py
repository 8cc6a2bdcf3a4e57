"""Problem 4: oversized texts cut into pieces at natural boundaries, by a hierarchy of separators.

A Markdown heading always begins a piece. Between headings the text is taken apart at paragraphs, an over-long
paragraph at lines, then sentences, words and at last characters, until every part fits; neighbouring parts are packed
greedily into pieces of at most `limit` characters. A piece after the first of its section begins up to `overlap`
characters before the end of the one before, at the earliest boundary there, so consecutive pieces overlap; no overlap
reaches back over a heading. Pieces are verbatim spans of the text.

Defined cases: null ids, null texts and texts within the limit have no pieces here; blank stretches belong to the piece before
them; repeated rows count once; a missing `start` counts as 1; a null path is not Markdown. Extra columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1500, 150
_HEADING = re.compile(r"(#{1,6})[ \t]+(?=[^\s])([^\n]*)")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})([^\n]*)")
#: From the largest unit to the smallest; each match ends a part.
_SEPARATORS = (
    re.compile(r"\n[ \t\r]*\n\s*"),
    re.compile(r"\n"),
    re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？｡][」』”’）]*\s*|[।॥؟]\s*"),
    re.compile(r"\s+"),
)


def headings(text: str) -> list[tuple[int, int, str]]:
    """(offset, level, title) of every heading line outside code fences."""
    found, fence, at = [], None, 0
    for line in text.split("\n"):
        mark = _FENCE.match(line)
        if fence is None:
            if mark and not (mark[1][0] == "`" and "`" in mark[2]):
                fence = mark[1]
            elif title := _HEADING.match(line):
                found.append((at, len(title[1]), title[2].strip().rstrip("#").strip()))
        elif mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not mark[2].strip():
            fence = None
        at += len(line) + 1
    return found


def boundaries(text: str, begin: int, end: int, most: int, level: int = 0) -> list[int]:
    """Ends of consecutive parts of text[begin:end], each of at most `most` characters."""
    if end - begin <= most:
        return [end] if end > begin else []
    if level == len(_SEPARATORS):
        cuts, at = [], begin
        while end - at > most:
            to = at + most
            while to > at + 1 and (unicodedata.combining(text[to]) or text[to] in "‍︎️"):
                to -= 1
            if to == at + 1:
                to = at + most
            cuts.append(to)
            at = to
        return [*cuts, end]
    out, at = [], begin
    for m in _SEPARATORS[level].finditer(text, begin, end):
        if m.end() > at:
            out += boundaries(text, at, m.end(), most, level + 1)
            at = m.end()
    return out + boundaries(text, at, end, most, level + 1)


def spans(text: str, markdown: bool, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(begin, end, index of its heading or -1) of every piece."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    marks = [h[0] for h in headings(text)] if markdown else []
    starts = sorted({0, *marks})
    pieces = []
    for begin, end in zip(starts, [*starts[1:], len(text)]):
        heading = marks.index(begin) if begin in marks else -1
        ends = boundaries(text, begin, end, max(1, limit - overlap))
        fine = sorted({begin, *ends, *(m.end() for s in _SEPARATORS for m in s.finditer(text, begin, end))}) if overlap and ends and end - begin > limit else []
        at, i = begin, 0
        while i < len(ends):
            j = i
            while j + 1 < len(ends) and ends[j + 1] - at <= limit:
                j += 1
            pieces.append((at, ends[j], heading))
            i = j + 1
            if i < len(ends):
                # back by the overlap, but never so far that the next part would not fit
                least = max(ends[j] - overlap, ends[i] - limit, at + 1)
                k = bisect_left(fine, least) if fine else 0
                at = fine[k] if fine and k < len(fine) and fine[k] <= ends[j] else ends[j]
    return pieces


def located(text: str, section: str | None, start: int | None, lines: bool, markdown: bool, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[str | None, int, int, int, int, str, bool, int]]:
    """(section, start, end, first offset, end offset, text, whether a heading begins it, its line) of every piece. Lines are counted on from `start` where the
    unit is a line; pages and cells stay what they are."""
    first = 1 if start is None else start
    marks = headings(text) if markdown else []
    paths, stack = [], [x for x in (section or "").split(" > ") if x]
    for _, level, title in marks:
        stack = [*stack[: level - 1], title]
        paths.append(" > ".join(stack))
    out = []
    for begin, end, heading in spans(text, markdown, limit, overlap):
        inside = text[begin:end].rstrip()
        line = first + text.count("\n", 0, begin)
        a, b = (line, line + inside.count("\n")) if lines else (first, first)
        out.append((paths[heading] if heading >= 0 else section, a, b, begin, end, text[begin:end], heading >= 0 and marks[heading][0] == begin, line))
    return out


_PIECES = "id bigint, piece int, section string, `start` int, `end` int, first int, last int, text string, heading boolean, line bigint"


def _cut(batches: Iterator[pa.RecordBatch], limit: int, overlap: int) -> Iterator[pa.RecordBatch]:
    names = ["id", "piece", "section", "start", "end", "first", "last", "text", "heading", "line"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.int64()]
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            pieces = located(r["text"], r["section"], r["start"], r["unit"] in (None, "line"), bool(r["md"]), limit, overlap)
            rows += [(r["id"], i, *p) for i, p in enumerate(pieces)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def oversized(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    return chunks.where((F.length("text") > limit) & F.col("id").isNotNull()).select("id", "section", "unit", "start", "text", F.coalesce(F.col("path").endswith(".md"), F.lit(False)).alias("md")).distinct()


def pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every chunk above the limit; first and last are code-point offsets in the chunk's text."""
    return oversized(chunks, limit).mapInArrow(partial(_cut, limit=limit, overlap=overlap), _PIECES)


def section_starts(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, line) at which a piece has to begin: the first of each text, and those that begin with a heading."""
    return pieces(chunks, limit, overlap).where("piece = 0 or heading").select("id", "line").distinct()

"""Columns, sections and blocks of one page in plain Python: the rules of `operators.geometry` over a page's lines in memory.

A line is a tuple (line_idx, text, x0, y0, x1, y1); a missing x0 or x1 counts as 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from statistics import median

import pyarrow as pa

from quiresmith.functions.pages import is_lower

COLUMN_GAP, BANNER, MIN_SHARE, MIN_COUNT = 0.12, 0.58, 0.2, 4
LINK, STOP, WHOLE_BOLD = re.compile(r"http|www\.", re.I | re.A), re.compile(r"[.!,);:]\Z"), re.compile(r"\*\*[^\n\r\x85  ]+?\*\*\Z")
Line = tuple[int, str, float, float, float, float]


def pages_of(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Line]]]:
    """(page_id, lines) of batches (page_id, line_idx, text, x0, y0, x1, y1, ...) that hold a page's lines side by side."""
    for batch in it:
        ids = batch.column(0).to_pylist()
        rows = list(zip(*(batch.column(k).to_pylist() for k in range(1, 7)), strict=True))
        start = 0
        for k in range(1, len(ids) + 1):
            if k == len(ids) or ids[k] != ids[start]:
                yield ids[start], rows[start:k]
                start = k


def columns(lines: list[Line], page_width: float) -> tuple[list[int], int]:
    """Of each line its column, and how many there are; one where the split is doubtful."""
    edges = [x[2] or 0.0 for x in lines]
    starts: list[float] = []
    last = None
    for x in sorted(edges):
        if last is None or x - last > page_width * COLUMN_GAP:
            starts.append(x)
        last = x
    if len(lines) < 4 or len(starts) == 1:
        return [0] * len(lines), 1
    nearest = {x: min(range(len(starts)), key=lambda i: (abs(x - starts[i]), i)) for x in set(edges)}
    near = [nearest[x] for x in edges]
    if min(Counter(near).values()) < max(float(MIN_COUNT), len(lines) * MIN_SHARE):
        return [0] * len(lines), 1
    return near, len(starts)


def sections(lines: list[Line], page_width: float) -> tuple[list[bool], list[int]]:
    """Of each line whether it is a banner, and its section in reading order."""
    col, n = columns(lines, page_width)
    banner = [n > 1 and (x[4] or 0.0) - (x[2] or 0.0) > page_width * BANNER for x in lines]
    keys = [(0, c, x[0]) if b else (1, c, 0) for x, c, b in zip(lines, col, banner, strict=True)]
    top: dict[tuple, float] = {}
    for x, k in zip(lines, keys, strict=True):
        top[k] = min(top.get(k, x[3]), x[3])
    place = {k: i for i, k in enumerate(sorted(top, key=lambda k: (top[k], k)))}
    return banner, [place[k] for k in keys]


def font_heading(text: str, height: float, mid: float) -> bool:
    if not (0 < len(text) < 60 and mid > 0 and height > mid * 1.35) or text.startswith("**") or not any(map(is_lower, text)):
        return False
    return not text[0].isdecimal() and not LINK.search(text) and not STOP.search(text)


def blocks(lines: list[Line], page_width: float) -> list[tuple[int, int, list[str]]]:
    """(section, block, lines) in reading order."""
    parts: dict[int, list[Line]] = {}
    for x, s in zip(lines, sections(lines, page_width)[1], strict=True):
        parts.setdefault(s, []).append(x)
    gap = max(8.0, median(x[5] - x[3] for x in lines) * 1.4)
    out: list[tuple[int, int, list[str]]] = []
    for s in sorted(parts):
        mid = median(x[5] - x[3] for x in parts[s])
        before, block = None, 0
        held: list[tuple[tuple, int, str]] = []
        for i, text, _, y0, _, y1 in sorted(parts[s], key=lambda x: (x[3], x[0], x[1])):
            text = text.strip()
            if not text:
                continue
            if font_heading(text, y1 - y0, mid):
                text = f"**{text}**"
            bold = WHOLE_BOLD.match(text) is not None
            block += before is not None and (bold or before[1] or y0 - before[0] > gap)
            held.append(((y0, i), block, text))
            before = y1, bold
        last = {place: block for place, block, _ in held}  # lines of one place, where an id repeats, share the last one's block
        for place, _, text in held:
            if out and out[-1][:2] == (s, last[place]):
                out[-1][2].append(text)
            else:
                out.append((s, last[place], [text]))
    return out


def rows_of_pages(f: Callable[[int | None, list[Line]], list[tuple]], fields: list[tuple[str, pa.DataType]], together: int = 20_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of the rows that f makes of pages."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for page, lines in pages_of(it):
            held += f(page, lines)
            if len(held) >= together:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(zip(*held, strict=True), fields, strict=True)], [n for n, _ in fields])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(zip(*held, strict=True), fields, strict=True)], [n for n, _ in fields])

    return run

"""Document structure: headings with their path, text blocks, pipe and HTML tables as grids, packed windows.

Structure depends on the order of lines inside one document and on nothing outside it, so each document is read whole in the task
that holds it and nothing is shuffled; every operator yields long rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEADING = re.compile(r"^(#{1,6})\s*(.*?)\s*#*\s*$")
_CHAPTER = re.compile(r"^第\s*[一二三四五六七八九十百零〇\d]+\s*章")
_DOTTED = re.compile(r"^(\d+(?:\s*[.．]\s*\d+){0,5})(?=\s|[、．.]|$)")
_BRACKETED = re.compile(r"^[（(]?[一二三四五六七八九十\d]+[)）、]")
# Headings whose sections hold no facts.
NOISE_TITLES = frozenset((
    "目录", "目 录", "contents", "content", "前言", "序", "序言", "译者前言", "原书前言",
    "作者", "原书主编及作者", "图书在版编目", "版权页", "致读者", "感谢", "符号含义",
    "参考文献", "文献", "索引", "思考题", "附录", "推荐阅读书目",
))
_SEPARATOR = re.compile(r"^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)*\|?\s*$")
_HTML_TABLE = re.compile(r"<table\b.*?</table\s*>", re.I | re.S)
_ROW = re.compile(r"<tr\b[^>]*>(.*?)</tr\s*>", re.I | re.S)
_CELL = re.compile(r"<(t[hd])\b([^>]*)>(.*?)</t[hd]\s*>", re.I | re.S)
_SPAN = re.compile(r"(rowspan|colspan)\s*=\s*[\"']?(\d+)", re.I)
_TAG = re.compile(r"<[^>]+>")


def logical_level(title: str, marks: int) -> int:
    """Chapters are level 1, dotted numbers one level below their dots, bracketed numbers one below their marks."""
    if _CHAPTER.match(title):
        return 1
    dotted = _DOTTED.match(title)
    if dotted:
        return min(6, len(re.findall(r"[.．]", dotted[1])) + 2)
    return min(6, marks + 1 if _BRACKETED.match(title) else marks)


def headings_of(text: str) -> list[tuple[int, str, int, str, bool]]:
    """(line from 1, title, level, path, noise) of every heading; the path holds the open titles of lower levels and its own."""
    open_titles: dict[int, str] = {}
    out = []
    for number, line in enumerate(text.split("\n"), 1):
        found = _HEADING.match(line)
        if not found or not found[2]:
            continue
        title = re.sub(r"\s+", " ", found[2])
        level = logical_level(title, len(found[1]))
        for deeper in [x for x in open_titles if x >= level]:
            del open_titles[deeper]
        open_titles[level] = title
        path = " > ".join(open_titles[x] for x in sorted(open_titles))
        out.append((number, title, level, path, re.sub(r"\s+", "", title).lower() in NOISE_TITLES))
    return out


def split_pipe_row(line: str) -> list[str]:
    """Cells of a pipe row; a backslash keeps the next pipe, backticks keep all between them."""
    body = line.strip()
    body = body[1:] if body.startswith("|") else body
    body = body[:-1] if body.endswith("|") and not body.endswith("\\|") else body
    cells, cell, code, i = [], [], False, 0
    while i < len(body):
        ch = body[i]
        if ch == "\\" and body[i + 1 : i + 2] == "|":
            cell.append("|")
            i += 1
        elif ch == "|" and not code:
            cells.append("".join(cell).strip())
            cell = []
        else:
            code ^= ch == "`"
            cell.append(ch)
        i += 1
    return [*cells, "".join(cell).strip()]


def tables_of(text: str) -> list[tuple[int, int, str, str]]:
    """(first line, last line, kind, raw) of every table in line order; pipe tables inside HTML tables are not counted again."""
    found = []
    taken: set[int] = set()
    for m in _HTML_TABLE.finditer(text):
        first = text.count("\n", 0, m.start()) + 1
        last = first + m[0].count("\n")
        found.append((first, last, "html", m[0]))
        taken.update(range(first, last + 1))
    lines = text.split("\n")
    i = 1
    while i < len(lines):
        if i + 1 not in taken and _SEPARATOR.match(lines[i]) and "|" in lines[i - 1] and i not in taken:
            end = i + 1
            while end < len(lines) and "|" in lines[end] and end + 1 not in taken:
                end += 1
            found.append((i, end, "pipe", "\n".join(lines[i - 1 : end])))
            i = end
        i += 1
    return sorted(found)


Cell = tuple[int, int, str, bool, bool]


def grid_of(kind: str, raw: str) -> list[Cell]:
    """(row, column, text, header, copy) of a table, spans expanded: the first cell that claims a place keeps it, holes are empty,
    ragged rows are padded. A rowspan ends with the rows of the table, a colspan is taken as it is written."""
    if kind == "pipe":
        rows = [split_pipe_row(line) for at, line in enumerate(raw.split("\n")) if at != 1]
        width = max(map(len, rows), default=0)
        return [(r, c, re.sub(r"\s+", " ", row[c]) if c < len(row) else "", r == 0, False) for r, row in enumerate(rows) for c in range(width)]
    places: dict[tuple[int, int], tuple[str, bool, bool]] = {}
    rows = [[(tag, body, {name.lower(): max(1, int(n)) for name, n in _SPAN.findall(attributes)}) for tag, attributes, body in _CELL.findall(row)] for row in _ROW.findall(raw)]
    for r, row in enumerate(rows):
        c = 0
        for tag, body, spans in row:
            while (r, c) in places:
                c += 1
            label = re.sub(r"\s+", " ", html.unescape(_TAG.sub(" ", body))).strip()
            down, across = min(spans.get("rowspan", 1), len(rows) - r), spans.get("colspan", 1)
            for dr in range(down):
                for dc in range(across):
                    places.setdefault((r + dr, c + dc), (label, tag.lower() == "th", bool(dr or dc)))
            c += across
    height, width = (max((k[i] for k in places), default=-1) + 1 for i in (0, 1))
    return [(r, c, *places.get((r, c), ("", False, False))) for r in range(height) for c in range(width)]


def blocks_of(text: str) -> list[tuple[int, int, str, str]]:
    """(first line, last line, heading path, text) of every text block: blank lines, headings and tables end one; sections below
    noise headings are left out until a heading of the same or a higher level; images and rules are not text."""
    lines = text.split("\n")
    marks = {n: (level, path, noise) for n, _, level, path, noise in headings_of(text)}
    table_lines = {n for first, last, _, _ in tables_of(text) for n in range(first, last + 1)}
    out, held, path, silent = [], [], "", 0
    for number, line in enumerate([*lines, ""], 1):
        mark = marks.get(number)
        ends = mark or number in table_lines or not line.strip()
        if ends:
            if held:
                out.append((held[0][0], held[-1][0], path, "\n".join(x for _, x in held)))
                held = []
            if mark:
                level, path, noise = mark
                silent = level if noise and not silent else (0 if silent and level <= silent and not noise else silent)
        elif not silent and not re.match(r"^\s*(?:!\[[^\]]*\]\([^)]*\)|[-*_]{3,})\s*$", line):
            held.append((number, line.strip()))
    return out


def windows_of(text: str, limit: int, overlap: int = 1) -> list[tuple[int, str, str]]:
    """(number, path, text) windows of at most `limit` characters packed from blocks; a new heading closes a window that is half
    full, the last `overlap` blocks are repeated, a block above the limit is cut."""
    out: list[tuple[int, str, str]] = []
    held: list[str] = []
    path, fresh = "", 0

    def close() -> None:
        nonlocal held, fresh
        if fresh:
            out.append((len(out) + 1, path, "\n\n".join(held)))
        held, fresh = held[-overlap:] if overlap and fresh else [], 0

    for _, _, block_path, block in blocks_of(text):
        size = sum(map(len, held)) + 2 * len(held)
        if fresh and (size + len(block) > limit or block_path != path and size >= limit / 2):
            close()
        if block_path != path:
            held = held if fresh else []
        path = block_path
        for at in range(0, len(block), limit):
            part = block[at : at + limit]
            if sum(map(len, held)) + 2 * len(held) + len(part) > limit:
                if fresh:
                    close()
                held = []
            held.append(part)
            fresh += 1
    close()
    return out


def _exploder(documents: DataFrame, id_col: str, text_col: str, work: Callable[[str], list[tuple]], columns: str) -> DataFrame:
    id_type = documents.schema[id_col].dataType.simpleString()
    names = [id_col, *[c.split()[0] for c in columns.split(", ")]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(key, *row) for key, text in zip(frame.iloc[:, 0], frame.iloc[:, 1], strict=True) for row in work(text)]
            yield pd.DataFrame(rows, columns=names)

    narrow = documents.select(F.col(id_col), F.col(text_col)).where(F.col(text_col).isNotNull() & (F.col(text_col) != ""))
    return narrow.mapInPandas(run, f"`{id_col}` {id_type}, {columns}")


def headings(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, line, title, level, path, noise."""
    return _exploder(documents, id_col, text_col, headings_of, "line int, title string, level int, path string, noise boolean")


def text_blocks(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, first_line, last_line, path, block."""
    return _exploder(documents, id_col, text_col, blocks_of, "first_line int, last_line int, path string, block string")


def tables(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, table_no (in line order), first_line, last_line, kind, raw, path (the last heading before the table)."""

    def work(text: str) -> list[tuple]:
        marks = headings_of(text)
        return [(n, *t, next((m[3] for m in reversed(marks) if m[0] < t[0]), "")) for n, t in enumerate(tables_of(text), 1)]

    return _exploder(documents, id_col, text_col, work, "table_no int, first_line int, last_line int, kind string, raw string, path string")


def cells(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, table_no, r, c, cell, header, copied: the grid of every table in long form."""

    def work(text: str) -> list[tuple]:
        return [(n, *cell) for n, (_, _, kind, raw) in enumerate(tables_of(text), 1) for cell in grid_of(kind, raw)]

    return _exploder(documents, id_col, text_col, work, "table_no int, r int, c int, cell string, header boolean, copied boolean")


def packed_windows(documents: DataFrame, limit: int = 6500, overlap: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, window_no, path, window."""
    return _exploder(documents, id_col, text_col, lambda t: windows_of(t, limit, overlap), "window_no int, path string, window string")

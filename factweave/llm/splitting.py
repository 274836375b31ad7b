"""Problem 1: items larger than a limit, cut into pieces at the borders their own structure has.

A text is read as a tree (headings, then paragraphs, table rows, list items and lines, then sentences, clauses and words).
Siblings of one parent are merged from left to right up to the limit, and only a node that is larger than the limit is opened; what
comes out of an opened node is not merged with the siblings of that node. A heading stays with what follows it. Consecutive pieces
share a given number of code points.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.session import small_rows

_HEADING = re.compile(r"^(#{1,6})\s", re.M)
_TITLE = re.compile(r"^(#{1,6})\s+([^\n]*)", re.M)
_ONLY_HEADINGS = re.compile(r"(?:\s*^#{1,6}\s[^\n]*(?:\n|$))+\s*", re.M)
#: Where a node of one level is cut into children, coarsest first; a cut lies behind the match.
BORDERS = (
    ("paragraph", re.compile(r"\n[ \t]*\n+|</table>|</p>|</div>", re.I)),
    ("row", re.compile(r"\n+|</tr>|</li>|<br\s*/?>", re.I)),
    ("path", re.compile(r"\s+[>›»/|]\s+|[>›»]\s*(?=[^\s<])")),
    ("sentence", re.compile(r"[。！？!?…]+[”’」』）)\"']*\s*|(?<=[^\d\s])\.[\"'”’)]*\s+|[;；]\s*|</t[dh]>", re.I)),
    ("clause", re.compile(r"[，,：:、|]\s*|\s+[–—-]\s+")),
    ("word", re.compile(r"\s+|[/_>\-]+")),
)


def _heading_children(text: str, begin: int, end: int) -> list[tuple[int, int]]:
    """Sections below the highest heading level that occurs inside the span, its own first line aside."""
    marks = [(m.start(), len(m[1])) for m in _HEADING.finditer(text, begin, end) if m.start() > begin]
    if not marks:
        return []
    top = min(level for _, level in marks)
    cuts = [begin, *[at for at, level in marks if level == top], end]
    return list(zip(cuts, cuts[1:], strict=False))


def _border_children(text: str, begin: int, end: int, border: re.Pattern) -> list[tuple[int, int]]:
    cuts = [begin]
    for m in border.finditer(text, begin, end):
        if begin < m.end() < end:
            cuts.append(m.end())
    return list(zip(cuts, [*cuts[1:], end], strict=True)) if len(cuts) > 1 else []


def _safe(text: str, at: int, begin: int) -> int:
    """A place not inside a combining sequence, at most a few code points before the wanted one."""
    back = at
    while back > begin + 1 and back > at - 16 and back < len(text) and (unicodedata.combining(text[back]) or text[back] in "‍️" or text[back - 1] == "‍"):
        back -= 1
    return back


def _hard_children(text: str, begin: int, end: int, limit: int) -> list[tuple[int, int]]:
    spans = []
    while end - begin > limit:
        cut = _safe(text, begin + limit, begin)
        spans.append((begin, cut))
        begin = cut
    return [*spans, (begin, end)]


def pack_tree(text: str, limit: int, first_limit: int | None = None) -> list[tuple[int, int, str]]:
    """(begin, end, border) of consecutive spans that cover the text, none longer than limit (the first: first_limit).

    border names the level at which the span ends. An empty text gives one empty span.
    """
    first_limit = limit if first_limit is None else first_limit
    if len(text) <= first_limit:
        return [(0, len(text), "end")]

    def room(begin: int) -> int:
        return limit if begin else first_limit

    def spans_of(begin: int, end: int, level: int, border: str, body: int) -> list[tuple[int, int, str]]:
        """The node from body on, with the headings that stand from begin to body kept to its first piece."""
        if end - begin <= room(begin):
            return [(begin, end, border)]
        sections = _heading_children(text, body, end) if level == 0 else []
        if sections:
            children, name, deeper = sections, "heading", 0
        else:
            children, name, deeper = [], "", level
            while not children and deeper < len(BORDERS):
                name, pattern = BORDERS[deeper]
                children = _border_children(text, body, end, pattern)
                deeper += 1
            if not children:
                cut = _safe(text, begin + room(begin), begin)
                return [(begin, cut, "character"), *[(a, b, "character" if b < end else border) for a, b in _hard_children(text, cut, end, limit)]]
        out: list[tuple[int, int, str]] = []
        # a run of whole siblings that is still open to the next one
        run: tuple[int, int] | None = None
        for at, b in children:
            a = begin if at == body else at
            if run and b - run[0] <= room(run[0]):
                run = (run[0], b)
                continue
            if run and _ONLY_HEADINGS.fullmatch(text, *run):
                a, run = run[0], None
            if run:
                out.append((*run, name))
                run = None
            if b - a <= room(a):
                run = (a, b)
            else:
                out += spans_of(a, b, deeper, name if b < end else border, at)
        if run:
            out.append((*run, border))
        return out

    return spans_of(0, len(text), 0, "end", 0)


def heading_paths(text: str, begins: list[int]) -> list[list[str]]:
    """For each place, in ascending order, the titles of the headings it stands under, the one it stands on included."""
    paths, above = [], []
    marks = [(m.start(), len(m[1]), m[2].strip()) for m in _TITLE.finditer(text)]
    at = 0
    for begin in begins:
        while at < len(marks) and marks[at][0] <= begin:
            above = [x for x in above if x[0] < marks[at][1]] + [marks[at][1:]]
            at += 1
        paths.append([title for _, title in above])
    return paths


def cut_with_overlap(text: str, max_chars: int, overlap: int) -> list[tuple[int, int, str]]:
    """(begin, end, border) of pieces of at most max_chars; each begins `overlap` code points before the end of the one before."""
    overlap = max(0, min(overlap, max_chars - 1))
    core = pack_tree(text, max_chars - overlap, max_chars)
    return [(max(0, a - overlap) if i else a, b, border) for i, (a, b, border) in enumerate(core)]


PIECE = "array<struct<pos int, begin int, end int, border string, path array<string>, text string>>"


def split_oversized(jobs: DataFrame, limits: DataFrame, fields: tuple[str, ...] = ("evidence", "heading_path")) -> DataFrame:
    """One row per piece of every oversized field: job_id, field_name, pos (from 1), begin, end, border, path, text.

    path holds the headings a piece begins under, behind the overlap. jobs: job_id, kind, attempt and the fields; limits: kind,
    field_name, max_chars, overlap_chars (a small fixed table). A job handed out again is taken once, with the highest attempt that
    has a limit (ties: the longer field, then the later in order of code points), whether or not that attempt is oversized. Fields
    within their limit, null and empty fields and jobs without a kind or without a limit give no row. A limit below 1 is taken as 1.
    Whole texts are cut; of what is within its limit only ids are shuffled.
    """
    long = jobs.select(
        "job_id", "kind", "attempt", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])).alias("x")
    ).select("job_id", "kind", "attempt", "x.field_name", "x.text")
    small = limits.groupBy("kind", "field_name").agg(F.min("max_chars").alias("max_chars"), F.max("overlap_chars").alias("overlap_chars"))
    known = jobs.sparkSession.createDataFrame(small_rows(small.where("max_chars is not null and kind is not null")), small.schema)
    size = F.coalesce(F.length("text"), F.lit(0))
    over = (
        long.where("kind is not null")
        .join(F.broadcast(known), ["kind", "field_name"])
        .select("job_id", "field_name", F.coalesce("attempt", F.lit(0)).alias("attempt"), size.alias("size"), "max_chars", "overlap_chars", F.when(size > F.col("max_chars"), F.col("text")).alias("text"))
        .groupBy("job_id", "field_name")
        .agg(F.max_by(F.struct("text", "max_chars", "overlap_chars"), F.struct("attempt", "size", "text")).alias("j"))
        .where("j.text is not null")
    )

    @F.pandas_udf(PIECE)
    def cut(text: pd.Series, max_chars: pd.Series, overlap: pd.Series) -> pd.Series:
        def one(t: str, m: int, o: float) -> list[dict]:
            spans = cut_with_overlap(t, max(1, int(m)), 0 if pd.isna(o) else int(o))
            cores = [0, *[b for _, b, _ in spans[:-1]]]
            return [{"pos": i, "begin": a, "end": b, "border": border, "path": path, "text": t[a:b]} for i, ((a, b, border), path) in enumerate(zip(spans, heading_paths(t, cores), strict=True), 1)]

        return pd.Series([one(*x) for x in zip(text, max_chars, overlap, strict=True)])

    return over.select("job_id", "field_name", F.explode(cut("j.text", "j.max_chars", "j.overlap_chars")).alias("p")).select("job_id", "field_name", "p.*")



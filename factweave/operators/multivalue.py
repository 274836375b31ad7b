"""Problem 2: several values packed in one field, one value per row with its position.

A batch of strings is worked on as one array of code points: masks for quotes, brackets and delimiters, cumulative sums per row
for parity and depth, and child offsets from the positions that remain delimiters. Python touches single strings only where a
slash or comma may stand before a unit.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions.fold import fold_latin, fold_table, is_invisible, lookalike_table
from factweave.functions.units import resolve_unit

# What separates values. The weak ones also stand inside numbers, units and names.
STRONG = ";|、\n\t\r"
WEAK = ",/"
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
OPENING, CLOSING = "「『“‘《", "」』”’》"
SENTENCE_END = "。！？!?"
# Placeholders that hold a separator.
PLACEHOLDERS = ("n/a", "/")

#: Rows without any of these, or of the code points that fold to them, hold one value at most.
CANDIDATE = r"[;；|｜、\n\t\r,，/／①-⑳﹐﹑]|\\n|(^|[\s ])[0-9０-９]{1,2}[)）]"

_DROP = 0
_SPLIT = ord(";")


@lru_cache(maxsize=1)
def _lut() -> np.ndarray:
    """Code point to folded code point; 0 for what cannot be seen, which is dropped."""
    table = np.arange(0x110000, dtype=np.uint32)
    for code, text in fold_table().items():
        table[code] = ord(text[0]) if len(text) == 1 else (_DROP if not text else code)
    for code, text in lookalike_table().items():
        table[code] = ord(text)
    for code in range(0x80, 0x10000):
        if not 0xD800 <= code < 0xE000 and is_invisible(chr(code)):
            table[code] = _DROP
    return table


@lru_cache(maxsize=1)
def candidate() -> str:
    """The native filter that drops rows of one value before they reach Python: CANDIDATE, with all that folds to a separator."""
    folded = np.flatnonzero(np.isin(_lut()[:0x10000], _codes(STRONG + WEAK + CIRCLED)))
    return CANDIDATE + "|[" + "".join(f"\\x{{{code:x}}}" for code in folded) + "]"


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _isin(codes: np.ndarray, chars: str) -> np.ndarray:
    return np.isin(codes, _codes(chars))


def _row_cumsum(flags: np.ndarray, starts: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Inclusive cumulative sum that begins anew in each row."""
    total = np.cumsum(flags, dtype=np.int64)
    base = np.concatenate(([0], total))[starts]
    return total - base[row]


def _shift(codes: np.ndarray, row: np.ndarray, by: int) -> np.ndarray:
    """The code point `by` places further on, 0 beyond the row."""
    out = np.zeros_like(codes)
    if by > 0:
        out[:-by] = np.where(row[by:] == row[:-by], codes[by:], 0)
    elif by < 0:
        out[-by:] = np.where(row[:by] == row[-by:], codes[:by], 0)
    else:
        out[:] = codes
    return out


def _is_digit(codes: np.ndarray) -> np.ndarray:
    return (codes >= 48) & (codes <= 57)


def _is_latin(codes: np.ndarray) -> np.ndarray:
    return ((codes >= 65) & (codes <= 90)) | ((codes >= 97) & (codes <= 122))


@lru_cache(maxsize=65536)
def _unit_tail(text: str, whole: frozenset[str]) -> bool:
    """True if a text behind a name or number is a unit; a name of the list, written as it stands there ("Cp"), is none."""
    bare = text.strip()
    return bool(bare) and bare not in whole and resolve_unit(bare) is not None


#: Three and more whole numbers between commas that are no thousands and no locants.
_COMMA_LIST = re.compile(r"(?<![\d.,])\d+(?:,\d+){2,}(?![\d,]|\.\d|\s*-)")
_THOUSANDS = re.compile(r"[1-9]\d{0,2}(?:,\d{3})+")
_NUMBER = re.compile(r"[<>≤≥≈~+-]?\s*\d[\d.,]*(?:[×x]10\^[+-]?\d+|[eE][+-]?\d+)?")
_STRONG_CUT = re.compile("[" + re.escape(STRONG) + "]")


@lru_cache(maxsize=65536)
def _listed_commas(text: str) -> tuple[int, ...]:
    """Places of the commas of a folded text that part whole numbers from each other."""
    found = []
    for m in _COMMA_LIST.finditer(text):
        if not _THOUSANDS.fullmatch(m[0]):
            found += [m.start() + i for i, ch in enumerate(m[0]) if ch == ","]
    return tuple(found)


@lru_cache(maxsize=65536)
def _closed_list(text: str, whole: frozenset[str]) -> bool:
    """True for a folded text with a full stop at its end alone, if what stands between its separators are names of the list or numbers
    with at most a unit: a list that is closed like a sentence, not a sentence."""
    body = text.strip()
    if body[-1:] not in SENTENCE_END or any(ch in SENTENCE_END for ch in body[:-1]):
        return False
    parts = [p.strip() for p in _STRONG_CUT.split(body[:-1]) if p.strip()]
    rests = [None if p in whole or not (m := _NUMBER.match(p)) else p[m.end() :].strip() for p in parts]
    return len(parts) > 1 and all(p in whole or rest == "" or rest and resolve_unit(rest) is not None for p, rest in zip(parts, rests, strict=True))


def divided_names(names: Iterable[str]) -> list[tuple[str, str, str]]:
    """Names of the reference list that hold a separator themselves, cut there: (left, separator, right)."""
    parts = []
    for name in sorted({fold_latin(n) for n in names if n}):
        for at, ch in enumerate(name):
            if ch in STRONG + WEAK and 0 < at < len(name) - 1:
                parts.append((name[:at], ch, name[at + 1 :]))
    return parts


def split_batch(strings: pa.Array, names: list[tuple[str, str, str]], whole: frozenset[str] = frozenset()) -> pa.LargeListArray:
    """The list of values of every string of an Arrow array, in order; values are trimmed and unquoted.

    names: those of the list that hold a separator, cut there; whole: all of them. Null and empty strings give no value.
    """
    strings = strings.cast(pa.large_string()) if not pa.types.is_large_string(strings.type) else strings
    filled = pc.fill_null(strings, "")
    offsets = np.frombuffer(filled.buffers()[1], dtype=np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    raw = data.to_pybytes()[offsets[0] : offsets[-1]] if data is not None else b""
    as_bytes = np.frombuffer(raw, dtype=np.uint8)
    lead = np.concatenate(([0], np.cumsum((as_bytes & 0xC0) != 0x80)))
    code_offsets = lead[offsets - offsets[0]]
    codes = _codes(raw.decode("utf-8"))
    count = len(filled)
    row = np.repeat(np.arange(count), np.diff(code_offsets))
    folded = _lut()[codes]
    keep = folded != _DROP
    codes, folded, row = codes[keep], folded[keep], row[keep]
    if not len(codes):
        return _lists(np.zeros(0, dtype=np.int64), pa.array([], pa.string()), count)
    starts = np.searchsorted(row, np.arange(count))
    following, previous = _shift(folded, row, 1), _shift(folded, row, -1)

    # a backslash and an n that stand for a line break
    escaped = (folded == ord("\\")) & (following == ord("n"))
    if escaped.any():
        folded = folded.copy()
        folded[escaped] = ord("\n")
        folded[1:][escaped[:-1]] = ord("\n")
        following, previous = _shift(folded, row, 1), _shift(folded, row, -1)

    # enumeration marks: circled digits, and "1)" at the start or behind a space
    circled = _isin(folded, CIRCLED)
    digit = _is_digit(folded)
    before = (previous == 0) | (previous == 32)
    one = digit & before & (following == ord(")"))
    two = digit & before & _is_digit(following) & (_shift(folded, row, 2) == ord(")"))
    mark = circled | one | two
    mark[1:] |= one[:-1] | two[:-1]
    mark[2:] |= two[:-2]

    # quotes: parity of straight ones where they are balanced, depth of paired ones
    inside = np.zeros(len(folded), dtype=bool)
    quote_char = np.zeros(len(folded), dtype=bool)
    for quote in ('"', "'"):
        # between letters or digits it is an apostrophe
        is_quote = folded == ord(quote)
        if quote == "'":
            is_quote &= ~((_is_latin(previous) | _is_digit(previous)) & (_is_latin(following) | _is_digit(following)))
        if not is_quote.any():
            continue
        seen = _row_cumsum(is_quote, starts, row)
        even = np.bincount(row, weights=is_quote, minlength=count).astype(np.int64) % 2 == 0
        inside |= (seen % 2 == 1) & even[row]
        quote_char |= is_quote & even[row]
    opening, closing = _isin(codes, OPENING), _isin(codes, CLOSING)
    if opening.any():
        depth = _row_cumsum(opening.astype(np.int64) - closing.astype(np.int64), starts, row)
        level = np.bincount(row, weights=opening.astype(np.int64) - closing.astype(np.int64), minlength=count) == 0
        inside |= (depth > 0) & level[row]
        quote_char |= (opening | closing) & level[row]

    # brackets, the list brackets of a JSON array set aside
    last = np.concatenate((starts[1:], [len(folded)])) - 1
    nonempty = last >= starts
    list_row = np.zeros(count, dtype=bool)
    rows_at = np.flatnonzero(nonempty)
    list_row[rows_at] = (folded[starts[rows_at]] == ord("[")) & (folded[last[rows_at]] == ord("]"))
    frame = np.zeros(len(folded), dtype=bool)
    frame[starts[np.flatnonzero(list_row)]] = True
    frame[last[np.flatnonzero(list_row)]] = True
    step = ((_isin(folded, "([{") & ~frame).astype(np.int64) - (_isin(folded, ")]}") & ~frame).astype(np.int64)) * ~mark * ~inside
    balanced = np.bincount(row, weights=step, minlength=count) == 0
    in_brackets = (_row_cumsum(step, starts, row) > 0) & balanced[row]

    strong = _isin(folded, STRONG)
    weak = _isin(folded, WEAK)
    protected = inside | in_brackets

    # names that hold a separator; one other character is allowed, as names are typed freely
    lower = folded.copy()
    upper_case = (lower >= 65) & (lower <= 90)
    lower[upper_case] += 32
    for left, separator, right in names:
        at = folded == ord(separator)
        if not at.any():
            continue
        wrong = np.zeros(len(folded), dtype=np.int64)
        for distance, ch in enumerate(reversed(left), 1):
            wrong += _shift(lower, row, -distance) != ord(ch.lower())
        for distance, ch in enumerate(right, 1):
            wrong += _shift(lower, row, distance) != ord(ch.lower())
        protected |= at & (wrong <= 1)

    # commas in numbers and locants ("3,5-", "N,N-")
    comma = folded == ord(",")
    if comma.any():
        second, third = _shift(folded, row, -2), _shift(folded, row, 2)
        number = _is_digit(previous) & _is_digit(following)
        single_before = _is_latin(previous) & ((second == 0) | (second == ord(",")) | _isin(second, STRONG))
        single_after = _is_latin(following) & ((third == ord(",")) | (third == ord("-")))
        kept_comma = comma & (codes == ord(",")) & (number | single_before & single_after)
        # several whole numbers are a list, unless they are thousands or locants
        for r in np.flatnonzero(np.bincount(row, weights=comma & number, minlength=count) > 1):
            begin = starts[r]
            end = np.searchsorted(row, r, side="right")
            kept_comma[begin + np.asarray(_listed_commas("".join(map(chr, folded[begin:end]))), dtype=np.int64)] = False
        protected |= kept_comma

    # whole sentences
    stop = _isin(folded, SENTENCE_END)
    sentence = np.bincount(row, weights=stop, minlength=count) > 0
    closing_stop = np.zeros(len(folded), dtype=bool)
    for r in np.flatnonzero(sentence & (np.bincount(row, weights=strong & ~protected, minlength=count) > 0)):
        begin, end = starts[r], np.searchsorted(row, r, side="right")
        if _closed_list("".join(map(chr, folded[begin:end])), whole):
            sentence[r] = False
            closing_stop[begin:end] = stop[begin:end]
    protected |= sentence[row]

    # a slash behind a number belongs to its unit
    cut = (strong | mark) & ~protected
    segment = np.cumsum(cut, dtype=np.int64) + row
    slash = (folded == ord("/")) & ~protected
    if slash.any():
        previous_word = _is_latin(previous) | _is_digit(previous) | (previous == ord("."))
        number_start = digit & ~previous_word & ~mark & ~inside
        seen = np.cumsum(number_start, dtype=np.int64)
        segment_start = np.concatenate(([True], segment[1:] != segment[:-1]))
        base = np.maximum.accumulate(np.where(segment_start, np.arange(len(folded)), 0))
        in_segment = seen - seen[base] + number_start[base]
        protected |= slash & (in_segment > 0)

    # a unit behind a name: the rest of the segment after the first weak separator names a unit
    open_weak = weak & ~protected
    if open_weak.any():
        at = np.flatnonzero(open_weak)
        first_of = np.concatenate(([True], segment[at][1:] != segment[at][:-1]))
        heads = at[first_of]
        ends = np.searchsorted(segment, segment[heads], side="right")
        tail_segments = [
            segment[h] for h, e in zip(heads, ends, strict=True) if _unit_tail("".join(map(chr, codes[h + 1 : e])), whole)
        ]
        # "N/A" and the like
        begins = np.searchsorted(segment, segment[heads], side="left")
        tail_segments += [
            segment[h] for h, b, e in zip(heads, begins, ends, strict=True) if e - b <= 5 and "".join(map(chr, lower[b:e])).strip() in PLACEHOLDERS
        ]
        if tail_segments:
            protected |= weak & np.isin(segment, np.asarray(tail_segments))

    delimiter = ((strong | weak) & ~protected) | (mark & ~inside & ~sentence[row]) | frame
    # runs of kept code points between delimiters, rows and nothing else
    solid = ~delimiter
    begin = solid & np.concatenate(([True], delimiter[:-1] | (row[1:] != row[:-1])))
    at = np.flatnonzero(begin)
    if not len(at):
        return _lists(np.zeros(0, dtype=np.int64), pa.array([], pa.string()), count)
    piece = np.cumsum(begin) - 1
    kept = solid & ~quote_char & ~closing_stop
    space = _isin(folded, " \n\t\r")
    words = kept & ~space
    # trim: first and last code point of a piece that is not white space
    piece_kept = piece[words]
    positions = np.flatnonzero(words)
    if not len(positions):
        return _lists(np.zeros(0, dtype=np.int64), pa.array([], pa.string()), count)
    first = np.full(len(at), -1)
    final = np.full(len(at), -1)
    first[piece_kept[::-1]] = positions[::-1]
    final[piece_kept] = positions
    real = np.flatnonzero(first >= 0)
    take = np.zeros(len(folded) + 1, dtype=np.int64)
    np.add.at(take, first[real], 1)
    np.add.at(take, final[real] + 1, -1)
    wanted = (np.cumsum(take)[:-1] > 0) & kept
    text = codes[wanted].astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    size = np.where(codes[wanted] < 0x80, 1, np.where(codes[wanted] < 0x800, 2, np.where(codes[wanted] < 0x10000, 3, 4)))
    lengths = np.bincount(piece[wanted], weights=size, minlength=len(at)).astype(np.int64)[real]
    child_offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    values = pa.LargeStringArray.from_buffers(len(real), pa.py_buffer(child_offsets), pa.py_buffer(text)).cast(pa.string())
    return _lists(row[at[real]], values, count)


def _lists(parents: np.ndarray, values: pa.Array, count: int) -> pa.LargeListArray:
    """A list array of `count` lists from values in the order of their parents."""
    return pa.LargeListArray.from_arrays(pa.array(np.searchsorted(parents, np.arange(count + 1)), pa.int64()), values)


def flattened(lists: pa.LargeListArray) -> tuple[np.ndarray, pa.Array]:
    """(ordinal of the parent, value) of every value."""
    return pc.list_parent_indices(lists).to_numpy(), lists.flatten()


def positions_of(parents: np.ndarray) -> np.ndarray:
    """1, 2, ... within each run of one parent."""
    if not len(parents):
        return np.zeros(0, dtype=np.int64)
    new = np.concatenate(([True], parents[1:] != parents[:-1]))
    begin = np.maximum.accumulate(np.where(new, np.arange(len(parents)), 0))
    return np.arange(len(parents)) - begin + 1


def split_values(facts: DataFrame, names: Iterable[str], id_col: str = "row_id", fields: Iterable[str] = ("predicate_raw", "尾实体/取值文本"), keep_single: bool = False) -> DataFrame:
    """One row per value: id, field_name, pos (from 1, in the order written), value.

    Only fields that hold two or more values give rows, unless keep_single. Quotes and brackets protect what they enclose; a
    name of the reference list that holds a separator, a number in any writing, a locant, a unit behind a name and a sentence
    stay whole; empty pieces take no position. Null, empty and placeholder fields give no row. Repeated ids give repeated rows.
    names must be a small list (it is shipped with the tasks). No shuffle: one pass over the two columns read.
    """
    whole = frozenset(names)
    cut_names = divided_names(whole)
    fields = tuple(fields)
    id_type = facts.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for index, field in enumerate(fields, 1):
                column = batch.column(index)
                parents, values = flattened(split_batch(column, cut_names, whole))
                if not keep_single and len(parents):
                    several = np.bincount(parents, minlength=batch.num_rows)[parents] > 1
                    parents, values = parents[several], values.filter(pa.array(several))
                if len(parents):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(parents)), pa.array([field] * len(parents), pa.string()), pa.array(positions_of(parents), pa.int64()), values],
                        names=[id_col, "field_name", "pos", "value"],
                    )

    quoted = [F.col(f"`{f}`") for f in fields]
    narrow = facts.select(F.col(f"`{id_col}`").alias("id_"), *[q.alias(f"f{i}") for i, q in enumerate(quoted)])
    if not keep_single:
        narrow = narrow.select("id_", *[F.when(F.col(f"f{i}").rlike(candidate()), F.col(f"f{i}")).alias(f"f{i}") for i in range(len(fields))])
        narrow = narrow.where(F.coalesce(*[F.col(f"f{i}") for i in range(len(fields))]).isNotNull())
    return narrow.mapInArrow(work, f"`{id_col}` {id_type}, field_name string, pos bigint, value string")

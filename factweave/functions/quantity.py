"""Reading one quantity out of typed text: number or range, its unit, test conditions set aside."""

from __future__ import annotations

import re
from typing import NamedTuple

from factweave.functions.fold import fold_latin
from factweave.functions.units import CASED, DIMENSION, leading_power, unit_automaton, unit_key

#: Digits with commas or spaces between thousands, with a decimal comma, or with a point (and a stray space behind it).
_NUMBER = r"[+-]?(?:[1-9]\d{0,2}(?:,\d{3})+(?:\.\d+)?(?![\d,])|[1-9]\d{0,2}(?: \d{3})+(?:\.\d+)?(?![\d,^])|\d+,\d+(?![\d,.])|\d+(?:\.\s?\d+)?|\.\d+)"
_MANTISSA = _NUMBER + r"(?:\s*[×x*]\s*10\s*(?:\^\s*[+-]?\d+|[⁺⁻]?[⁰¹²³⁴⁵⁶⁷⁸⁹]+)|e[+-]?\d+)?"
NUMBER = re.compile(_MANTISSA)
VALUE = re.compile(rf"({_MANTISSA})(?:\s*(±|~|至|到|—|\.\.|-(?=\s*\d))\s*({_MANTISSA}))?")
CONDITION_PREFIX = re.compile(r"^(?:[^下时]|小时)*?(?:条件下|下|(?<!小)时)(?:的)?(?:测得|测定|测试|检测|实测)?(?:值)?(?:为|:|，|,)?\s*(?=[<>≤≥≈约不~+\-.\d])")
PAREN = re.compile(r"\([^()]*(?:\([^()]*\)[^()]*)*\)")
_LETTER = re.compile(r"[a-z0-9一-鿿]")
# Words before a number that bound it.
BOUNDS = {"≥": ">=", ">=": ">=", "不低于": ">=", "不小于": ">=", "至少": ">=", "≤": "<=", "<=": "<=", "不高于": "<=", "不大于": "<=", "不超过": "<=", ">": ">", "大于": ">", "<": "<", "小于": "<", "约": "~", "≈": "~"}
_BOUND = re.compile("(" + "|".join(map(re.escape, sorted(BOUNDS, key=len, reverse=True))) + r")\s*$")
_DECIMAL_COMMA = re.compile(r"\s*[+-]?(?:0,\d+|\d+,(?!\d{3}(?!\d))\d+|\d{4,},\d+)(?![\d,])")
#: The parts that may follow a time, each smaller than the one before, and how many of them make one of those.
_SMALLER = {"h": (("min", 60.0), ("s", 3600.0)), "min": (("s", 60.0),)}
_SUPERSCRIPT = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻", "0123456789+-")


class Quantity(NamedTuple):
    number: float | None
    lower: float | None
    upper: float | None
    comparator: str | None
    symbol: str | None
    power: int


def to_number(text: str) -> float | None:
    """A number in any of the written styles: thousands commas, a stray space after the point, ×10^n, e-notation."""
    if _DECIMAL_COMMA.match(text):
        text = text.replace(",", ".", 1)
    plain = text.replace(",", "").replace(" ", "").translate(_SUPERSCRIPT)
    plain = re.sub(r"[×x*]10\^?([+-]?\d+)$", r"e\1", plain)
    try:
        value = float(plain)
    except ValueError:
        return None
    return value if abs(value) != float("inf") else None


def unit_after(key: str, at: int) -> tuple[str | None, int, int]:
    """(symbol, power of ten before it, where it ends) of the longest unit that begins where a number ends."""
    rest = key[at:]
    body_at = at + len(rest) - len(rest.lstrip())
    power, body = leading_power(key[body_at:])
    start = len(key) - len(body)
    best: tuple[int, str] | None = None
    for end, (size, symbol) in unit_automaton().iter(key, start):
        begin = end - size + 1
        if begin > start:
            if begin > start + 32:
                break
            continue
        follows = key[end + 1 : end + 2]
        last = key[end]
        # a Latin unit must not run on into a word ("min" in "minor"); Chinese forms are longest-match only
        if last.isascii() and last.isalnum() and follows.isascii() and follows.isalnum():
            continue
        if best is None or size > best[0]:
            best = (size, symbol)
    return (best[1], power, start + best[0]) if best else (None, power, at)


def _cased_power(written: str, symbol: str, dimension: str | None) -> int:
    """The power of ten of a unit whose case is not that of the symbol, unless the dimension says that it is a slip."""
    return next((power for form, other, slip, power in CASED if symbol == other and written.lstrip().startswith(form) and dimension != slip), 0)


def read_quantity(text: str | None, dimension: str | None = None) -> Quantity | None:
    """The quantity a text states; None where it states no number.

    Conditions ("23 ℃下为 …", a bracket behind the value) are taken off first. Of several quantities the first decides whose unit is of
    the dimension asked for, else the first that has a unit. Two and three part times are one quantity in their largest unit. Null and
    empty text give None.
    """
    if not text:
        return None
    cased = fold_latin(text)
    key = unit_key(text)
    if not any(c.isdigit() for c in key):
        return None
    cased = " ".join(cased.split())
    key = CONDITION_PREFIX.sub("", key, count=1)
    # the same places in the text as it is cased, where folding the case moves none
    cased = cased[len(cased) - len(key) :] if len(cased) >= len(key) and cased[len(cased) - len(key) :].lower() == key else key
    bare, shown = _outer_brackets_off(key), _outer_brackets_off(cased)
    first: Quantity | None = None
    with_unit: Quantity | None = None
    position = 0
    while found := VALUE.search(bare, position):
        begin = found.start()
        before = bare[begin - 1] if begin else ""
        if before and (before.isascii() and before.isalnum() or before in "_"):
            position = max(found.end(), begin + 1)
            continue
        low, end, sign, high = to_number(found[1]), found.end(), found[2], to_number(found[3]) if found[2] else None
        if sign == "-" and (low is None or high is None or high <= low):
            # no range but a sign or a dash: the numbers stand alone
            sign, high, end = None, None, found.end(1)
        symbol, power, position = unit_after(bare, end)
        if symbol:
            power += _cased_power(shown[end:position], symbol, dimension)
        bound = _BOUND.search(bare[:begin])
        comparator = BOUNDS[bound[1]] if bound else None
        lower = upper = None
        number = low
        if sign and low is not None and high is not None:
            if sign == "±":
                lower, upper = low - abs(high), low + abs(high)
            else:
                lower, upper, number = min(low, high), max(low, high), (low + high) / 2
        elif number is not None and symbol in _SMALLER:
            number, position = _with_parts(bare, position, symbol, number)
        quantity = Quantity(number, lower, upper, comparator, symbol, power)
        if symbol and (dimension is None or DIMENSION.get(symbol) == dimension):
            return quantity
        if symbol:
            with_unit = with_unit or quantity
        first = first or quantity
    return with_unit or first


def _with_parts(key: str, at: int, symbol: str, number: float) -> tuple[float, int]:
    """A time and the smaller parts that follow it directly ("3小时20分")."""
    for smaller, parts in _SMALLER[symbol]:
        found = re.compile(r"\s*(\d+(?:\.\d+)?)").match(key, at)
        if not found:
            break
        part, power, end = unit_after(key, found.end())
        if part == smaller and power == 0:
            number, at = number + float(found[1]) / parts, end
    return number, at


def _outer_brackets_off(key: str) -> str:
    """Remove brackets that are not part of a unit such as W/(m·K)."""
    out, last = [], 0
    for found in PAREN.finditer(key):
        if found.start() and key[found.start() - 1] in "/·":
            continue
        out.append(key[last : found.start()])
        out.append(" ")
        last = found.end()
    out.append(key[last:])
    return "".join(out)

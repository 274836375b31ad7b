"""Code-point folding shared by the operators that read typed text: invisible characters, widths, composition, look-alikes."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# Letters of other scripts that are drawn like a Latin letter.
LOOKALIKE_FROM = "АВЕЅІЈКМНОРСТХаеѕіјорсухΑΒΕΖΗΙΚΜΝΟΡΤΥΧονʼ"
LOOKALIKE_TO = "ABESIJKMHOPCTXaesijopcyxABEZHIKMNOPTYXov'"

# Signs drawn alike.
SIGN_FROM = "‐‑‒–−－∕⁄⋅∙•・µ∶"
SIGN_TO = "------//····μ:"

# All code points that can change: the basic plane without surrogates, musical format characters, compatibility
# ideographs, and tags and variation selectors of the special-purpose plane.
FOLDED_PLANES = (*range(0x80, 0xD800), *range(0xE000, 0x10000), *range(0x1D100, 0x1D200), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200))


def is_invisible(ch: str) -> bool:
    """Format characters and variation selectors; line breaks and tabs are visible structure."""
    return unicodedata.category(ch) == "Cf" or "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef" or ch in "͏ᅟᅠㅤﾠ"


def fold_char(ch: str) -> str:
    """One code point in its plain form; '' for what cannot be seen."""
    if ch < "\x80":
        return ch
    if is_invisible(ch):
        return ""
    if unicodedata.category(ch) == "Zs":
        return " "
    at = SIGN_FROM.find(ch)
    if at >= 0:
        return SIGN_TO[at]
    kind = unicodedata.decomposition(ch)
    if kind.startswith(("<wide>", "<narrow>")) or "⺀" <= ch <= "⿕":
        return unicodedata.normalize("NFKC", ch)
    if kind and not kind.startswith("<") and " " not in kind:
        return unicodedata.normalize("NFC", ch)
    return ch


@lru_cache(maxsize=1)
def fold_table() -> dict[int, str]:
    """str.translate table over all planes, only the code points that change; look-alike letters are left alone."""
    table = {}
    for code in FOLDED_PLANES:
        ch = chr(code)
        folded = fold_char(ch)
        if folded != ch:
            table[code] = folded
    return table


@lru_cache(maxsize=1)
def lookalike_table() -> dict[int, str]:
    return {ord(a): b for a, b in zip(LOOKALIKE_FROM, LOOKALIKE_TO, strict=True)}


def fold(text: str) -> str:
    """Folded text, composed; letters of other scripts stay as they are."""
    return unicodedata.normalize("NFC", text.translate(fold_table()))


def fold_latin(text: str) -> str:
    """Folded text in which letters drawn like Latin ones are Latin, for units and codes."""
    return fold(text).translate(lookalike_table())

"""Values that only say that nothing is there."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and marks that stand for a missing value, folded and in lower case.
BLANK_WORDS = ("", "-", "--", "—", "——", "/", "\\", "n/a", "na", "null", "none", "nan", "无", "暂缺", "待补", "未知", "空", "?")

_RIM = r"[\s\p{Z}\p{Cf}]*"
#: One anchored pattern for all of them, with white space and unseen characters around, and the latter inside; text of another kind fails it at
#: its first characters.
BLANK = "(?i)^" + _RIM + "(?:" + "|".join(r"\p{Cf}*".join(map(re.escape, word)) for word in BLANK_WORDS) + ")" + _RIM + "$"


def plain(column: Column) -> Column:
    """Text without outer white space and without characters that cannot be seen; null stays null."""
    return F.trim(F.regexp_replace(F.regexp_replace(column, r"\p{Cf}", ""), r"[  -   　\s]+", " "))


def is_blank(column: Column) -> Column:
    """True for null, empty text and placeholder words."""
    return column.isNull() | column.rlike(BLANK)


def filled(column: Column) -> Column:
    """The value, or null where it is blank."""
    return F.when(~is_blank(column), column)

"""Native expressions over texts: language, clauses, windows, labelled fields, process and profile scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.values import let

NOT_CJK, ENGLISH_WORD = "[^㐀-鿿]+", "[A-Za-z]{2,}"
MARKUP = r"[<`]|\]\(|https?://"
# Where a sentence ends, and what is taken off the rim of a clause.
SENTENCE_BORDER = r"[。！？!?；;\n]+"
RIM = " \t\r\n，,。；;：:"


def visible_text(column: Column) -> Column:
    """Text without tags, link targets, addresses and code."""
    text = F.coalesce(column, F.lit(""))
    for pattern, by in ((r"<[^>]*>", " "), (r"\[([^\]]*)\]\([^)]*\)", " $1 "), (r"https?://\S+", " "), (r"`[^`]*`", " ")):
        text = F.regexp_replace(text, pattern, by)
    return text


def count_of(column: Column, pattern: str) -> Column:
    return F.regexp_count(column, F.lit(pattern))


def _seen(column: Column) -> Column:
    """The visible text; most texts hold nothing to take out."""
    written = F.coalesce(column, F.lit(""))
    return F.when(written.rlike(MARKUP), visible_text(column)).otherwise(written)


def _letters(text: Column) -> tuple[Column, Column]:
    """(Han characters, Latin letters) of a text."""
    latin = "".join(map(chr, (*range(65, 91), *range(97, 123))))
    return F.length(F.regexp_replace(text, NOT_CJK, "")), F.length(text) - F.length(F.translate(text, latin, ""))


def _chosen(text: Column, cjk: Column, latin: Column) -> Column:
    total = F.greatest(cjk + latin, F.lit(1))
    # few texts hold enough Latin letters to ask for their words
    worded = F.when(latin >= 12, count_of(text, ENGLISH_WORD) >= 3).otherwise(False)
    mixed = (cjk >= 2) & (cjk / total >= 0.04) & (latin / total >= 0.12)
    return F.when(~worded, "zh").when(mixed, "mixed").when(latin / total >= 0.72, "en").otherwise("zh")


def language(column: Column) -> Column:
    """'zh', 'en' or 'mixed' by the letters of both scripts in the visible text; text without letters counts as 'zh'."""

    def decided(text: Column) -> Column:
        cjk, latin = _letters(text)
        return let(F.struct(cjk.alias("cjk"), latin.alias("latin")), lambda n: _chosen(text, n["cjk"], n["latin"]))

    return let(_seen(column), decided)


def with_language(rows: DataFrame, column: str, name: str = "language") -> DataFrame:
    """The rows with the language of a column, by projections one above the other, so that all of it is generated code and nothing in it is
    computed twice; for many short texts."""
    seen = rows.withColumn("seen_", _seen(F.col(column)))
    cjk, latin = _letters(F.col("seen_"))
    counted = seen.withColumns({"cjk_": cjk, "latin_": latin})
    return counted.withColumn(name, _chosen(F.col("seen_"), F.col("cjk_"), F.col("latin_"))).drop("seen_", "cjk_", "latin_")


def clauses(column: Column) -> Column:
    """Non-empty clauses between sentence borders, trimmed of spaces and light punctuation."""
    parts = F.split(F.coalesce(column, F.lit("")), SENTENCE_BORDER)
    trimmed = F.transform(parts, lambda c: F.btrim(c, F.lit(RIM)))
    return F.filter(trimmed, lambda c: c != "")


def windows(column: Column, size: int) -> Column:
    """Consecutive windows of `size` characters, the last one shorter; none for null or empty text."""
    n = F.length(F.coalesce(column, F.lit("")))
    starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.substring(column, at, F.lit(size)))


def numeric_like(column: Column) -> Column:
    """True for a number with or without sign, comparator and unit, a range, or a short text with a digit."""
    text = F.regexp_replace(F.coalesce(column, F.lit("")), r"\s+", "")
    return (text != "") & (
        text.rlike(r"^[<>≤≥≈~～±+\-−]?(?:\d+(?:[.,]\d+)?|[.,]\d+)(?:%|‰|[a-zA-Z°℃·/^\-0-9]+)?$")
        | (text.rlike(r"\d(?:[-~～—至]|\.{2,})\d") & (F.length(text) <= 40))
        | (text.rlike(r"\d") & (F.length(text) <= 28))
    )


def subject_type(column: Column) -> Column:
    """A rough type of a subject by its last words."""
    return (
        F.when(column.rlike("(?i)(装置|设备|仪器|反应器|机)$"), "设备")
        .when(column.rlike("(?i)(方法|法|工艺|技术|process|method)$"), "方法")
        .when(column.rlike("(?i)(配方|共混物|复合材料|blend|composite)$"), "配方")
        .when(column.rlike("(涂料|清漆|树脂|填料|密封胶|环氧胶|石粉|陶瓷|合金|母粒|高分子膜)"), "材料")
        .otherwise("物质")
    )


def process_score(column: Column) -> Column:
    """How much a paragraph reads like a process: actions, numbered steps and sequence words, less for contents and history."""
    actions = count_of(column, "加入|混合|共混|复配|加热|保温|冷却|搅拌|过滤|干燥|脱模|过筛|静置|取样|升温|浇注")
    numbered = count_of(column, r"(?:步骤|第)\s*[0-9一二三四五六七八九十]+\s*步?|(?m)^\s*\d+[.)、]")
    ordered = count_of(column, "首先|然后|随后|接着|最后|再|后")
    contents = column.rlike(r"\.{4,}\s*\d+|目\s*录")
    return (
        F.when(ordered.__ge__(1) & (actions >= 2), 8).otherwise(0)
        + F.when((numbered >= 2) & (actions >= 2), 8).otherwise(0)
        + F.when(actions >= 5, 4).otherwise(0)
        - F.when((numbered >= 2) & (actions == 0), 5).otherwise(0)
        - F.when(contents, 12).otherwise(0)
    )


def span_supported(span: Column, evidence: Column) -> Column:
    """True if the evidence holds the span, with or without white space."""
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")
    return (bare(span) != "") & (F.contains(evidence, span) | F.contains(bare(evidence), bare(span)))


def english_alias(column: Column) -> Column:
    """An English name without unit, in lower case, plural folded."""
    text = F.lower(F.trim(F.regexp_replace(column, r"\s*[(\[].*?[)\]]\s*$", "")))
    text = F.regexp_replace(F.regexp_replace(text, r"[_\-\s]+", " "), r"ies$", "y")
    return F.regexp_replace(text, r"(?<=[a-z]{3})(?<![su])s$", "")

"""Native cleaning of scientific text: OCR spacing, formulas, property labels, subject names, conditions, model answers."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUBJECT_NAME = T.StructType([T.StructField("canonical", T.StringType()), T.StructField("key", T.StringType()), T.StructField("aliases", T.ArrayType(T.StringType()))])


def compact_ocr_numbers(column: Column, passes: int = 6) -> Column:
    """Digits torn apart by spaces around a point or inside a number of groups of three joined again."""
    step = lambda c: F.regexp_replace(F.regexp_replace(c, r"(\d)\s*\.\s+(\d)", "$1.$2"), r"(\d{1,3}) (\d{3})(?!\d)", "$1$2")
    return reduce(lambda c, _: step(c), range(passes), column)


def clean_math(column: Column) -> Column:
    """LaTeX marks of plain text removed: dollars, \\mathrm, sub- and superscript braces, degree signs as one character."""
    steps = (
        plain := (r"\\(?:mathrm|text|rm|mathbf)\s*\{([^{}]*)\}", "$1"),
        (r"\^\s*\{?\s*\\circ\s*\}?\s*C", "℃"),
        (r"\\(?:sim|thicksim)", "~"),
        (r"\\times", "×"),
        (r"\\(?:leq|le)\b", "≤"),
        (r"\\(?:geq|ge)\b", "≥"),
        (r"\\mu\b", "μ"),
        (r"[_^]\s*\{([^{}]*)\}", "$1"),
        plain,  # what held a brace until now
        (r"\\%", "%"),
        (r"\\[,;!]|\$", ""),
        (r"(?U)\s+", " "),
    )
    return F.trim(reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, column))


def clean_property(column: Column) -> Column:
    """A property label without number, possessive, unit and trailing symbol."""
    steps = ((r"^\s*[(（]?\d+[)）.、]\s*", ""), (r"^.*的(?=[^的]{2,})", ""), (r"\s*[（(\[][^（）()\[\]]*[)）\]]\s*$", ""), (r"\s*[,，/]\s*[^,，/一-鿿]*$", ""), (r"\s+[A-Za-zρσητλ]\s*$", ""))
    return F.trim(reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, F.coalesce(column, F.lit(""))))


@F.pandas_udf(SUBJECT_NAME)
def subject_name(raw: pd.Series) -> pd.DataFrame:
    """The canonical form of a subject name (NFKC, prefixes and quotes off, spacing single), its key and the names in brackets."""
    import re
    import unicodedata

    def one(text: str | None) -> tuple[str, str, list[str]]:
        name = unicodedata.normalize("NFKC", text or "")
        name = re.sub(r"^(?:关于|所谓|上述|该|本)\s*", "", re.sub(r"\s+", " ", name).strip(" \"'“”「」"))
        inner = [x.strip() for x in re.findall(r"\(([^()]*)\)", name) if x.strip()]
        outer = re.sub(r"\s*\([^()]*\)", "", name).strip()
        return name, re.sub(r"[\s\-]+", "", name).casefold(), [x for x in dict.fromkeys([outer, *inner]) if x and x != name]

    return pd.DataFrame([one(t) for t in raw], columns=["canonical", "key", "aliases"])


def canonical_conditions(column: Column) -> Column:
    """A JSON list of conditions as sorted distinct 'name=value unit' texts; the plain text in lower case where it is no JSON list."""
    parsed = F.from_json(column, "array<struct<name:string,normalized_name:string,value_text:string,value_num:double,unit:string>>")
    squeeze = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", ""))
    item = lambda x: F.concat(squeeze(F.coalesce(x["normalized_name"], x["name"])), F.lit("="), squeeze(F.coalesce(x["value_num"].cast("string"), x["value_text"])), F.lit(" "), squeeze(x["unit"]))
    return F.when(F.size(parsed) > 0, F.array_join(F.array_sort(F.array_distinct(F.transform(parsed, item))), "；")).otherwise(squeeze(column))


@F.pandas_udf(T.StringType())
def first_json(answer: pd.Series) -> pd.Series:
    """The first JSON object in a model's answer: the whole text, a fenced block, or the first one that decodes; null if there is none."""
    import json
    import re

    def one(text: str | None) -> str | None:
        if not text:
            return None
        fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
        for candidate in [text, *([fenced[1]] if fenced else [])]:
            try:
                found = json.loads(candidate)
            except ValueError:
                continue
            if isinstance(found, dict):
                return json.dumps(found, ensure_ascii=False, sort_keys=True)
        decoder = json.JSONDecoder()
        for m in re.finditer(r"\{", text):
            try:
                return json.dumps(decoder.raw_decode(text, m.start())[0], ensure_ascii=False, sort_keys=True)
            except ValueError:
                continue
        return None

    return answer.map(one)


def collapsed_series(text: str, count: int) -> list[str] | None:
    """A run of digits cut into `count` numbers of like size: the cut whose numbers have the most even number of digits and one
    decimal point each at most; None if there is no cut. Dynamic programming over the ends of the numbers."""
    if count < 1 or not text or any(c not in "0123456789." for c in text):
        return None
    size = len(text)
    ideal = size / count
    best: list[dict[int, tuple[float, int]]] = [{} for _ in range(count + 1)]
    best[0][0] = (0.0, -1)
    for n in range(1, count + 1):
        for begin, (cost, _) in best[n - 1].items():
            for end in range(begin + 1, min(size, begin + 12) + 1):
                part = text[begin:end]
                if part.count(".") > 1 or part[0] == "." or part[-1] == "." or len(part) > 1 and part[0] == "0" and part[1] != ".":
                    continue
                new = cost + (len(part) - ideal) ** 2
                if end not in best[n] or new < best[n][end][0]:
                    best[n][end] = (new, begin)
    if size not in best[count]:
        return None
    parts, end = [], size
    for n in range(count, 0, -1):
        begin = best[n][end][1]
        parts.append(text[begin:end])
        end = begin
    return parts[::-1]

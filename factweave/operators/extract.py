"""Text extraction: labelled fields, bound numbers, relations, compositions and process steps, one row per statement.

The statements with a fixed surface are native expressions. Where a statement depends on what stood before it in the same block
(a carried owner), the block is read in order inside its task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.text import clauses
from factweave.functions.values import parse_value

LABELLED = r"(?m)^\s*([^\s：:|#<][^：:|\n]{0,29}?)\s*[：:]\s*([^\n|]+?)\s*$"
BOUND = r"^(.{1,40}?)的([^的，。为]{2,12}?)(?:约)?为([^，。；]+)$"
COMPOSED = r"^(?:将)?(.{1,40}?)与(.{1,40}?)按(\d+(?:\.\d+)?)\s*[:：]\s*(\d+(?:\.\d+)?)(?:混合|共混|复配)"
# Verbs that join a subject and an object, with the kind of relation they state. The subject begins behind the last sentence that ends
# inside the clause before the verb.
RELATIONS = tuple(
    (kind, rf"^(?:(?:(?!{verbs}).)*(?:\S\.\s+(?=\p{{IsHan}})|\p{{Ll}}{{3}}\.\s+(?=\p{{Lu}})))?((?:(?!{verbs}).){least})(?:{verbs})(.+)$")
    for kind, verbs, least in (("classification", "是一种|属于", "+"), ("application", "可用于|多用于|适合作为|用作", "*"), ("causal", "导致|使得|引起", "+"), ("solubility", "可溶于", "*"))
)
# Actions of a process.
ACTIONS = ("加入", "混合", "共混", "复配", "加热", "升温", "保温", "冷却", "搅拌", "过滤", "干燥", "脱模", "脱泡", "过筛", "静置", "取样", "浇注", "预混")


def labelled_fields(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ord, label, value of every line `label：value`."""
    pairs = F.arrays_zip(F.regexp_extract_all(text_col, F.lit(LABELLED), F.lit(1)).alias("label"), F.regexp_extract_all(text_col, F.lit(LABELLED), F.lit(2)).alias("value"))
    return documents.select(id_col, F.posexplode(pairs).alias("ord", "p")).select(id_col, (F.col("ord") + 1).alias("ord"), F.col("p.label").alias("label"), F.col("p.value").alias("value"))


def clause_rows(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ord, clause."""
    return documents.select(id_col, F.posexplode(clauses(F.col(text_col))).alias("ord", "clause")).withColumn("ord", F.col("ord") + 1)


def bound_values(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ord, owner, property, value_text, value (parsed) of clauses that say what a property of an owner is."""
    found = clause_rows(documents, id_col, text_col).where(F.col("clause").rlike(BOUND))
    part = lambda i: F.trim(F.regexp_extract("clause", BOUND, i))
    owner = F.regexp_replace(part(1), r"^.*[，,]", "")
    return found.select(id_col, "ord", owner.alias("owner"), part(2).alias("property"), part(3).alias("value_text"), parse_value(part(3)).alias("value"))


def compositions(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ord, component, part, share of mixtures given by a ratio."""
    found = clause_rows(documents, id_col, text_col).where(F.col("clause").rlike(COMPOSED))
    part = lambda i: F.trim(F.regexp_extract("clause", COMPOSED, i))
    a, b = part(3).cast("double"), part(4).cast("double")
    members = F.array(*[F.struct(part(i).alias("component"), x.alias("part"), F.round(F.try_divide(x, a + b), 6).alias("share")) for i, x in ((1, a), (2, b))])
    return found.select(id_col, "ord", F.explode(members).alias("m")).select(id_col, "ord", "m.*")


def relations(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", patterns: tuple[tuple[str, str], ...] = RELATIONS) -> DataFrame:
    """id, ord, kind, subject, object; the first kind that a clause matches."""
    rows = clause_rows(documents, id_col, text_col)
    kind = F.coalesce(*[F.when(F.col("clause").rlike(p), F.lit(k)) for k, p in patterns])
    pick = lambda i: F.coalesce(*[F.when(F.col("kind") == k, F.trim(F.regexp_extract("clause", p, i))) for k, p in patterns])
    return rows.withColumn("kind", kind).where("kind is not null").select(id_col, "ord", "kind", pick(1).alias("subject"), pick(2).alias("object"))


def process_steps(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, process_ord, step_index, action, previous_action, next_action: the actions of a clause that holds two or more, in order."""
    found = F.regexp_extract_all(F.col("clause"), F.lit("(" + "|".join(ACTIONS) + ")"), F.lit(1))
    rows = clause_rows(documents, id_col, text_col).withColumn("actions", found).where(F.size("actions") >= 2)
    return rows.select(id_col, F.col("ord").alias("process_ord"), "actions", F.posexplode("actions").alias("at", "action")).select(
        id_col,
        "process_ord",
        (F.col("at") + 1).alias("step_index"),
        "action",
        F.when(F.col("at") > 0, F.try_element_at("actions", F.col("at"))).alias("previous_action"),
        F.try_element_at("actions", F.col("at") + 2).alias("next_action"),
    )


_OWNER = re.compile(r"([A-Z][A-Za-z\-]*[ -]?\d+[A-Z]?|[一-鿿]{1,4}-\d+ [一-鿿]+|改性[一-鿿]+型?|[А-Я][а-я]+-\d+)")
_STATED = re.compile(r"(?:的)?([一-鿿]{2,8}?)(?:约)?(?:为|是|达到?)\s*([-+]?\d+(?:\.\d+)?(?:×10\^[-+]?\d+)?\s*[^\s，。；、（）]{0,12})")
_PRONOUN = re.compile(r"^(?:其|该材料|该样品|它)")


def carried_values(block: str) -> list[tuple[int, str, str, str, bool]]:
    """(clause, owner, property, value, carried) read from left to right: a clause without an owner, or with a pronoun, takes the
    last one named; a named owner replaces it."""
    out, owner = [], ""
    for number, clause in enumerate(re.split(r"[。；;！？\n]+", block), 1):
        pronoun = _PRONOUN.match(clause.strip())
        clause = clause.strip()[pronoun.end() :] if pronoun else clause
        named = None if pronoun else _OWNER.search(clause)
        if named:
            owner = named[1]
        for m in _STATED.finditer(clause):
            if owner:
                out.append((number, owner, m[1].lstrip("的"), m[2].strip(), named is None))
    return out


def owner_bound_values(blocks: DataFrame, id_cols: list[str], block_col: str = "block") -> DataFrame:
    """id columns, clause, owner, property, value, carried; each block is read in order in the task that holds it."""
    schema = ", ".join(f"`{c}` {blocks.schema[c].dataType.simpleString()}" for c in id_cols)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(*key, *row) for *key, block in frame.itertuples(index=False) for row in carried_values(block or "")]
            yield pd.DataFrame(rows, columns=[*id_cols, "clause", "owner", "property", "value", "carried"])

    return blocks.select(*id_cols, block_col).mapInPandas(run, f"{schema}, clause int, owner string, property string, value string, carried boolean")


def abbreviations(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, name, short: names with a code in brackets."""
    pattern = r"([\p{L}][\p{L}\d \-]{1,30}?)\s*[（(]([A-Z][A-Z0-9\-]{1,11})[)）]"
    pairs = F.arrays_zip(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all(text_col, F.lit(pattern), F.lit(2)).alias("short"))
    return documents.select(id_col, F.explode(F.array_distinct(pairs)).alias("p")).select(id_col, F.trim("p.name").alias("name"), F.col("p.short").alias("short"))


# Conditions a clause can state, with the unit of the number that is caught.
CONDITIONS = (
    ("湿度", r"在(\d+(?:\.\d+)?)%湿度下", "%"),
    ("温度", r"在(-?\d+(?:\.\d+)?) ?℃", "℃"),
    ("保温时间", r"保温(\d+(?:\.\d+)?) ?min", "min"),
    ("升温速率", r"升温速率 ?(\d+(?:\.\d+)?) ?K/min", "K/min"),
)


def conditions(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ord, name, value, unit of the conditions of every clause, each distinct one once."""

    def caught(name: str, pattern: str, unit: str) -> Column:
        return F.transform(F.regexp_extract_all("clause", F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(name).alias("name"), x.alias("value"), F.lit(unit).alias("unit")))

    found = F.flatten(F.array(*[caught(*c) for c in CONDITIONS]))
    rows = clause_rows(documents, id_col, text_col).select(id_col, "ord", F.explode(F.array_distinct(found)).alias("c"))
    return rows.select(id_col, "ord", "c.name", F.col("c.value").cast("double").alias("value"), "c.unit")


def with_conditions(values: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Values with the conditions of their clause as one text, sorted by name."""
    text = F.concat("name", F.lit("="), F.col("value").cast("string"), F.lit(" "), "unit")
    packed = found.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(text)), "；").alias("condition_text"))
    return values.join(packed, keys, "left")

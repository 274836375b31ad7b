"""What kind of text a block, table or document is: roles, captions, profiles, process spans, handbook entries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.text import count_of
from factweave.operators.documents import _exploder, headings_of, tables_of

# Words of a heading that tell the role of its blocks, tried in this order, with the confidence each gives.
ROLES = (
    ("device_system", 0.88, "火帽|底火|雷管|点火具|导爆索|导火索|延期元件|火工品|起爆器|点火器|装置"),
    ("formulation", 0.84, "配方|体系|推进剂|混合炸药|延期药|点火药|传爆药"),
    ("process", 0.84, "制备|合成|加工|工艺|结晶|粉碎|混合|包覆|微胶囊|干燥|固化|聚合|装配|装压药"),
    ("experiment", 0.82, "试验|实验|测试|测定|检验|表征|分析方法|仪器"),
    ("method_model", 0.85, "模型|仿真|模拟|计算方法|专家系统|算法|有限元|数据库|知识库"),
    ("application_safety", 0.82, "安全|毒性|防护|储存|运输|危险|消防|泄漏|废弃|相容性|安定性"),
    ("comparison", 0.76, "比较|对比|差异|影响|关系|变化规律"),
    ("property", 0.80, "物理性质|化学性质|理化性质|性能|密度|熔点|爆速|燃速|比冲|感度|流变|力学"),
    ("theory", 0.84, "原理|机理|理论|定义|概念|分类|基本条件|发展史|一般特征|导论|概述"),
)
# Fields that identify a material, and the confidence they give behind the words of the heading.
IDENTITY = "(?:中文名称|英文名称|CAS(?:登记号)?|分子式|化学式|分子量|相对分子质量)\\s*[：:]"
IDENTITY_CONFIDENCE = 0.82
CAPTION = r"^\s*(?:表|Table)\s*\d+"


def block_role(path: Column, block: Column, roles: tuple[tuple[str, float, str], ...] = ROLES) -> Column:
    """struct<role, confidence>: devices and formulations by the words of the last heading, then identity fields in the block, then the
    other words, then unknown. roles: other words for other books."""
    title = F.coalesce(F.try_element_at(F.split(path, " > "), F.lit(-1)), F.lit(""))
    tests = [(name, value, title.rlike(words)) for name, value, words in roles]
    tests.insert(2, ("material_profile", IDENTITY_CONFIDENCE, F.coalesce(block, F.lit("")).rlike(IDENTITY)))
    role, confidence = F.when(F.lit(False), ""), F.when(F.lit(False), 0.0)
    for name, value, holds in tests:
        role, confidence = role.when(holds, name), confidence.when(holds, value)
    return F.struct(role.otherwise("unknown").alias("role"), confidence.otherwise(0.40).alias("confidence"))


def table_captions(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", look_back: int = 4) -> DataFrame:
    """id, table_no, title, title_source, context: the first line that is not blank among the lines above a table, if it looks like a
    caption; else no title and the heading path as context."""

    def work(text: str) -> list[tuple]:
        lines, marks = text.split("\n"), headings_of(text)
        out = []
        for n, (first, _, _, _) in enumerate(tables_of(text), 1):
            above = next((x.strip() for x in reversed(lines[max(0, first - 1 - look_back) : first - 1]) if x.strip()), "")
            context = next((m[3] for m in reversed(marks) if m[0] < first), "")
            caption = above if re.match(CAPTION, above) else ""
            out.append((n, caption, "caption" if caption else "context" if context else "unnamed", context))
        return out

    return _exploder(documents, id_col, text_col, work, "table_no int, title string, title_source string, context string")


def document_profile(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_codes, n_fields, n_tables, score, profile: repeated entries, a specification, or a monograph, by additive evidence."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = documents.select(
        id_col,
        count_of(text, r"(?m)^\s*[1-9]\d{5}(?!\d)").alias("n_codes"),
        count_of(text, r"(?m)^\s*[^\s：:|#<]{2,12}[：:]").alias("n_fields"),
        count_of(text, r"(?im)^\s*\|?\s*:?-{3,}|<table").alias("n_tables"),
    )
    score = (
        F.when(F.col("n_codes") >= 30, 0.45).otherwise(0.0) + F.when(F.col("n_codes") >= 200, 0.05).otherwise(0.0) + F.when(F.col("n_fields") >= F.greatest(F.lit(50), F.col("n_codes") * 2), 0.25).otherwise(0.0)
    )
    kind = F.when(F.col("score") >= 0.7, "repeated_entry").when((F.col("n_tables") >= 10) & (F.col("n_fields") >= 30), "specification").otherwise("monograph")
    return counted.withColumn("score", F.round(score, 6)).withColumn("profile", kind)


def entry_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, code, title, first_line, last_line of entries that begin with a six-digit code; an entry ends before the next one."""

    def work(text: str) -> list[tuple]:
        lines = text.split("\n")
        in_tables = {n for first, last, _, _ in tables_of(text) for n in range(first, last + 1)}
        starts = [(n, m[1], m[2].strip()) for n, line in enumerate(lines, 1) if n not in in_tables and (m := re.match(r"^\s*([1-9]\d{5})(?!\d)\s*(.*)$", line))]
        ends = [n - 1 for n, _, _ in starts[1:]] + [len(lines)] * bool(starts)
        return [(code, title, n, end) for (n, code, title), end in zip(starts, ends, strict=True)]

    return _exploder(documents, id_col, text_col, work, "code string, title string, first_line int, last_line int")


def process_spans(blocks: DataFrame, score: Column, keys: list[str], order: str, least: int = 8, go_on: int = 2) -> DataFrame:
    """keys, first, last, n_blocks, score of runs of blocks: a block of high score opens a run, following blocks above `go_on` belong to
    it. Runs are islands of one window per document, so no block is in two."""
    w = Window.partitionBy(*keys).orderBy(order)
    scored = blocks.select(*keys, order, score.alias("s"))
    marked = scored.withColumn("in_", F.col("s") >= go_on).withColumn("new_", (F.col("in_") & ~F.coalesce(F.lag("in_").over(w), F.lit(False))).cast("int"))
    islands = marked.withColumn("run", F.sum("new_").over(w)).where("in_")
    return islands.groupBy(*keys, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n_blocks"), F.max("s").alias("best"), F.sum("s").alias("score")).where(F.col("best") >= least).drop("best", "run")


def item_batches(rows: DataFrame, group: str, order: str, size: int, ranges: int = 64) -> DataFrame:
    """group, batch, n_items: items of each group in the order of a column of numbers, cut into batches of `size`.

    The numbers are cut into ranges, each sorted alone, and the counts of the ranges before it are added, so that a group with a third
    of all rows is spread over `ranges` tasks. Rows without a number come first; an empty table gives none.
    """
    least, most = rows.agg(F.min(order), F.max(order)).first()
    width = (float(most) - float(least)) / ranges + 1e-9 if least is not None else 1.0
    ranged = rows.select(group, order, F.coalesce(F.least(F.floor((F.col(order) - F.lit(least or 0)) / width), F.lit(ranges - 1)), F.lit(-1)).alias("range_"))
    counts = ranged.groupBy(group, "range_").agg(F.count("*").alias("n_"))
    before = counts.select(F.col(group).alias("g_"), F.col("range_").alias("b_"), (F.sum("n_").over(Window.partitionBy(group).orderBy("range_")) - F.col("n_")).alias("before_"))
    local = F.row_number().over(Window.partitionBy(group, "range_").orderBy(order)) - 1
    ranked = ranged.withColumn("local_", local).join(before, F.col(group).eqNullSafe(F.col("g_")) & (F.col("range_") == F.col("b_")))
    return ranked.withColumn("batch", F.floor((F.col("local_") + F.col("before_")) / size)).groupBy(group, "batch").agg(F.count("*").alias("n_items"))


def step_labels(text: Column) -> Column:
    """Sorted distinct numbers of the steps a text names."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?:步骤|第)\s*(\d{1,2})"), F.lit(1)), lambda x: x.cast("int"))))

"""Native predicates that judge single facts: surface faults, support by context, units, labels, subjects and candidates.

Every predicate is a Column over the fields of one row, so that all of them run in one pass inside generated code; nothing is
shuffled. Names of reasons, word lists and patterns are fixed values of the domain; lists that a deployment has its own of are
parameters.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.formula import molar_mass_of
from factweave.functions.values import let, normalize_unit
from factweave.operators.facts import reasons

# Patterns of surface faults.
SENTENCE_MARK = r"[。；;：:]"
MEASURE_SUBJECT = r"(?i)^(?:[-+−]?[0-9]+(?:[.,][0-9]+)?|[A-Za-z]|MPa|kPa|Pa|K|℃|°C|mm|cm|m|s|ms|μs|%|‰|ppm)$"
INDEX_EVIDENCE = r"(?:^|\n)\s*(?:第?[0-9]+章|[0-9]+(?:[.．][0-9]+)+)[^\n]{0,80}?(?:[.．·…]{2,}|[：:]\s*)?[0-9]{1,4}\s*$"
GLUED_NUMBERS = r"[0-9]+\.[0-9]+\.[0-9]+|\.[0-9]+\.[0-9]+"
AXIS_SUBJECT = r"^(?:数目|长度|面积|体积|质量|温度|压力){2,}$"
VERBAL = r"[的了为是在由可并即将使]"
DISCOURSE = r"^(?:并|且|而|则|因而|从而|因此|所以|实际|仅|不|可见|由此|这|该|其|它)"
LIST_MARK = r"[、,，;/；]"
# Properties and values that only point elsewhere.
INDEX_PROPERTIES = ("参考文献", "页码", "序号", "图号", "表号")
SUMMARY_VALUES = ("总计", "合计", "小计", "见图", "见表", "同上", "—", "-")
COMPOSITION_PROPERTIES = ("组成", "组成描述")
# The units that properties of a kind can have, in their normal form.
PROPERTY_UNITS: tuple[tuple[tuple[str, ...], tuple[str, ...]], ...] = (
    (("温度", "熔点", "沸点", "闪点", "自燃点", "爆发点", "分解温度", "峰顶温度", "玻璃化温度"), ("℃", "°C", "K")),
    (("燃速", "爆速"), ("mm/s", "cm/s", "m/s", "km/s")),
    (("粒度", "粒径"), ("um", "nm", "mm", "cm", "目")),
    (("密度",), ("g/cm3", "g/cm³", "kg/m3", "kg/m³")),
    (("黏度", "粘度"), ("Pa·s", "Pa.s", "P")),
    (
        ("含量", "质量分数", "体积分数", "纯度", "氮含量", "氧含量", "氯含量", "铝含量", "硼含量", "水分含量", "灰分含量", "挥发分含量", "固体含量", "有效成分含量", "金属含量", "氧化剂含量", "粘合剂含量", "黏合剂含量"),
        ("%", "‰", "ppm", "ppb", "vol%", "wt%"),
    ),
)
# Labels and values of labelled fields that are no single measurement.
LABELLED = "爆发点|分解温度|熔点|沸点|密度|燃速|爆速|粒度"
TWO_LABELS = rf"(?s)(?:{LABELLED}).{{0,50}}(?:{LABELLED})"
INNER_LABEL = r"(?:熔化热|熔融热|汽化热|生成热|密度|熔点|沸点|爆发点|分解温度|粒度|燃速|爆速)\s*[：:]"
ANY_NUMBER = r"[-+−]?[0-9]+(?:[.,][0-9]+)?"
DEFINITION = r"^(?:是指|定义为|指的是|表示|由.{0,100}所需的(?:最低|最小|最大)?(?:能量|压力|温度|时间))"
# Lines of a table of contents.
INDEX_LINE = r"^(?:(?:第?[0-9]+|[一二三四五六七八九十]+)\s*[章节篇部])?.{1,80}?(?:[.．·…]{2,}|[：:]\s*)?\s*[0-9]{1,4}$"
INDEX_SIGN = r"章|节|篇|部|目录|[.．·…]{2,}|[：:]"
# What is no property, and what the end of a property name says of its category.
NO_PROPERTY = r"(?i)^(?:[A-Za-z0-9μµαβγδΔ△]+|目|项|优等品|一等品|二等品|三等品|合格品|优级纯|分析纯|化学纯|通用|耐热|电气|中国|日本|[IVXⅠⅡⅢ]+型|[一二三四五六七八九十]+级)$"
NO_PROPERTY_END = r"(?:这里讨论|特点是|质量问题|数据转载|如下|分别为|组分为|配方为)$"
CODE_ONLY = r"^[A-Za-z0-9_.+\-=/()]+$"
PROPERTY_HINT = (
    r"(?:量|率|度|温度|压力|密度|时间|速度|强度|性能|系数|指数|值|点|距离|长度|直径|深度|高度|含量|组成|方法|用途|稳定性|感度|应力|应变|模量|气味|物态|反应性|情况|关系|功能|要求|描述|结论|分类|定义|位置|范围)$"
)
ELEMENT = r"^[一-鿿]{1,4}(?:\([A-Z][a-z]?\))?$"
ELEMENT_CONTEXT = r"元素|组成|含量|成分|指标"
SUFFIX_CATEGORIES: tuple[tuple[str, str], ...] = (
    ("制备工艺", r"(?:制备|合成|加工|装配|操作|工艺|流程).*(?:步骤|工序)$|^(?:制备工艺步骤|操作步骤)$"),
    ("组成/配方", r"(?:含量|用量|投料量|质量分数|质量百分比|摩尔比|配比|配方组成)$"),
    ("试验结果", r"(?:得率|收率|产率|转化率|误差|偏差|增量|损失率|变化率)$"),
    ("力学性能", r"(?:应力|应变|模量|强度|硬度|伸长率|断裂)$"),
    ("热性能", r"(?:分解峰|峰顶温度|活化能|升华热|热量|热值|热容|热导率)$"),
    ("燃烧性能", r"(?:燃速|燃烧时间|释能时间|释能功率|火焰温度|压力指数|比冲)$"),
    ("爆轰/爆炸性能", r"(?i)(?:爆速|爆压|爆热|威力|猛度|殉爆距离|临界直径|炸高|破甲深度|壁速|膨胀速度|TNT当量)$"),
    ("安全性能", r"(?:感度|爆发点|爆燃点|静电电压|起爆药量|装药量|卡片间隙|防护情况)$"),
    ("稳定性", r"(?:稳定性|安定性|半衰期|放气量)$"),
    ("相容性", r"(?:相容性|峰顶温度差|热量差值)$"),
    ("物理属性", r"(?:密度|粒度|粒径|灰分|水分|挥发分|筛余物|不溶物|蒸气压|气味|物态|黏度|粘度)$"),
    ("化学属性", r"(?:元素含量|氧系数|官能度|取代度|反应性|燃烧主产物)$"),
    ("模型/公式", r"(?:相关系数|影响系数|分形维数|拟合系数|回归系数)$"),
    ("测试/检测方法", r"(?:检验|试验|测试|测定|表征|分析方法)$"),
    ("应用", r"(?:适用性|适用范围|应用|用途)$"),
    ("定义/分类", r"(?:定义|分类|概念)$"),
    ("功能/作用", r"(?:功能|作用|作用影响|影响关系|因果关系|机理描述)$"),
    ("结构/连接", r"(?:组成描述|连接关系|安装位置|部件关系)$"),
    ("比较", r"(?:比较结论|比较关系|优缺点)$"),
    ("安全/储运", r"(?:安全要求|储存要求|贮存要求|运输要求|防护要求)$"),
    ("方法/模型", r"(?:方法|方法描述|方法步骤|模型描述|算法步骤)$"),
    ("试验结果", r"(?:试验结果|实验结果|测试结果)$"),
)


def stripped(column: Column) -> Column:
    """Text without white space at its ends; '' for null."""
    return F.regexp_replace(F.coalesce(column, F.lit("")), r"(?U)^\s+|\s+$", "")


def squeezed(column: Column) -> Column:
    """Text without any white space; '' for null."""
    return F.regexp_replace(F.coalesce(column, F.lit("")), r"(?U)\s+", "")


def property_of(attribute: Column, raw: Column) -> Column:
    """The attribute name, or what was written where there is none."""
    return stripped(F.when(F.coalesce(attribute, F.lit("")) != "", attribute).otherwise(raw))


def surface_faults(subject: Column, prop: Column, value: Column, evidence: Column, source: Column) -> Column:
    """Sorted array of the reasons for which the surface of a fact alone forbids its release; empty for a sound one."""
    s, v, e = stripped(subject), stripped(value), stripped(F.replace(F.coalesce(evidence, F.lit("")), F.lit("\\n"), F.lit("\n")))
    cs, cv = squeezed(subject), squeezed(value)
    opened = lambda c, ch: F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))
    return reasons({
        "missing_required_field": (s == "") | (prop == "") | (v == "") | (e == ""),
        "overlong_or_sentence_subject": (F.length(cs) > 80) | s.rlike(SENTENCE_MARK),
        "numeric_unit_or_variable_subject": cs.rlike(MEASURE_SUBJECT),
        "toc_or_page_index_evidence": e.rlike(INDEX_EVIDENCE),
        "glued_numeric_surface": cv.rlike(GLUED_NUMBERS),
        "overlong_value": F.length(v) > 1600,
        "unbalanced_subject": (opened(s, "(") != opened(s, ")")) | (opened(s, "（") != opened(s, "）")),
        "bibliographic_or_index_property": prop.isin(*INDEX_PROPERTIES),
        "summary_or_placeholder_value": cv.isin(*SUMMARY_VALUES),
        "concatenated_axis_subject": cs.rlike(AXIS_SUBJECT),
        "long_verbal_subject": (F.length(cs) >= 24) & cs.rlike(VERBAL),
        "discourse_or_deictic_subject": cs.rlike(DISCOURSE),
        "concatenated_table_component_value": F.coalesce(source, F.lit("")).startswith("table_") & prop.isin(*COMPOSITION_PROPERTIES) & (F.length(cv) > 36) & ~v.rlike(LIST_MARK),
    })


def support(subject: Column, prop: Column, raw_property: Column, value: Column, evidence: Column, context: Column, condition: Column, method: Column, source: Column,
            self_contained: Column | None = None, accepted: Column | None = None) -> Column:
    """struct<score, positive>: what the text around a fact adds to its confidence or takes from it, and the names of what speaks for it.

    context: evidence, section and table title joined. A fact counts as self-contained unless told otherwise.
    """
    around, text = squeezed(context), F.coalesce(evidence, F.lit(""))
    contains = lambda part: (part != "") & F.contains(around, part)
    of_text = F.coalesce(source, F.lit("")).startswith("text_")
    subject_in, property_in, value_in = contains(squeezed(subject)), contains(squeezed(prop)) | contains(squeezed(raw_property)), contains(squeezed(value))
    points = F.replace(text, F.lit(","), F.lit("."))
    numbers = F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(rf"({ANY_NUMBER})"), F.lit(1))
    numbers_in = ~value_in & (F.size(numbers) > 0) & F.forall(numbers, lambda n: F.contains(points, F.replace(n, F.lit(","), F.lit("."))))
    whole = F.lit(True) if self_contained is None else self_contained
    passed = F.lit(False) if accepted is None else accepted
    filled = lambda c: stripped(c) != ""
    parts = (
        ("subject_supported_by_context", subject_in, 0.05, F.when(of_text, -0.05).otherwise(0.0)),
        ("property_supported_by_context", property_in, 0.03, F.lit(0.0)),
        ("value_supported_by_evidence", value_in, 0.07, F.when(numbers_in, 0.05).when(of_text, -0.06).otherwise(0.0)),
        ("condition_bound", filled(condition), 0.02, F.lit(0.0)),
        ("method_bound", filled(method), 0.02, F.lit(0.0)),
        ("evidence_self_contained", whole, 0.03, F.lit(-0.10)),
        ("passed_source_gate", passed, 0.03, F.lit(0.0)),
    )
    total = F.lit(0.0)
    for _, holds, gain, otherwise in parts:
        total = total + F.when(holds, F.lit(gain)).otherwise(otherwise)
    named = [F.when(holds, F.lit(name)) for name, holds, _, _ in parts]
    named.insert(3, F.when(numbers_in, F.lit("numeric_value_supported_by_evidence")))
    return F.struct(F.round(total, 6).alias("score"), F.array_compact(F.array(*named)).alias("positive"))


def unit_fits(prop: Column, unit: Column) -> Column:
    """False where a property of a known kind has a unit of another one or none; null for properties of no known kind."""
    normal = normalize_unit(unit)
    out = None
    for properties, units in PROPERTY_UNITS:
        test = normal.isin(*units)
        out = F.when(prop.isin(*properties), test) if out is None else out.when(prop.isin(*properties), test)
    return out


def many_values(value: Column, source: Column) -> Column:
    """True for a labelled field whose value holds several labels or three and more numbers."""
    text = F.coalesce(value, F.lit(""))
    return (F.coalesce(source, F.lit("")) == "text_labeled_field") & (text.rlike(TWO_LABELS) | text.rlike(INNER_LABEL) | (F.regexp_count(text, F.lit(ANY_NUMBER)) >= 3))


def defines(value: Column, source: Column) -> Column:
    """True for a labelled field whose value is a definition in prose."""
    text = stripped(value)
    return (F.coalesce(source, F.lit("")) == "text_labeled_field") & text.rlike(DEFINITION) & ~text.rlike(ANY_NUMBER)


def index_line(line: Column) -> Column:
    """True for a line of a table of contents or a page reference."""
    text = stripped(F.regexp_replace(line, r"(?U)\s+", " "))
    return (text != "") & text.rlike(INDEX_LINE) & text.rlike(INDEX_SIGN)


def no_property(name: Column, source: Column) -> Column:
    """True for a label that names no property."""
    listed = name.rlike(NO_PROPERTY) | (F.length(name) > 32) | name.rlike(NO_PROPERTY_END) | name.rlike(CODE_ONLY)
    return (name == "") | listed | ((F.coalesce(source, F.lit("")) == "table_conditional_record") & ~name.rlike(PROPERTY_HINT))


def suffix_alignment(name: Column, unit: Column, context: Column, component: Column, fact_type: Column) -> Column:
    """struct<name, category, score, rule> for a label that the reference list does not hold, by what it ends in; null for none."""
    def found(label: Column, category: str, score: float, rule: str) -> Column:
        return F.struct(label.alias("name"), F.lit(category).alias("category"), F.lit(score).alias("score"), F.lit(rule).alias("rule"))

    of_mixture = (F.coalesce(component, F.lit("")) != "") | F.contains(F.coalesce(fact_type, F.lit("")), F.lit("组成"))
    element = name.rlike(ELEMENT) & F.coalesce(unit, F.lit("")).isin("%", "‰") & F.coalesce(context, F.lit("")).rlike(ELEMENT_CONTEXT)
    content = F.when(name.endswith("含量"), name).otherwise(F.concat(name, F.lit("含量")))
    out = F.when(name == "", F.lit(None)).when(of_mixture, found(name, "组成/配方", 0.92, "compiler_confirmed_component")).when(element, found(content, "组成/配方", 0.82, "element_content"))
    for category, pattern in SUFFIX_CATEGORIES:
        out = out.when(name.rlike(pattern), found(name, category, 0.76, "suffix_rule"))
    return out


def subject_actions(rows: DataFrame, denied: DataFrame, subject: str, action: str = "manual_review") -> DataFrame:
    """The rows with action: that of the list for a subject it names exactly, else 'keep'.

    denied: one column with the subject's name, a policy table; it is joined by equality, and broadcast only where Spark finds it small.
    """
    names = denied.select(stripped(F.col(denied.columns[0])).alias("denied_")).where("denied_ <> ''").distinct()
    joined = rows.join(names, stripped(F.col(subject)) == F.col("denied_"), "left")
    return joined.withColumn("action", F.when(F.col("denied_").isNotNull(), action).otherwise("keep")).drop("denied_")


def worth_a_review(confidence: Column, source: Column, found: Column, complete: Column, vetoes: Iterable[str], least: Mapping[str, float]) -> Column:
    """True for a fact that did not pass but deserves a review: complete, above the least confidence of its kind of source ('table_',
    'text_' or ''), and without a reason that vetoes it."""
    threshold = F.lit(float(least.get("", 0.0)))
    for prefix, value in sorted(least.items(), key=lambda kv: len(kv[0])):
        threshold = F.when(F.coalesce(source, F.lit("")).startswith(prefix), F.lit(float(value))).otherwise(threshold)
    return complete & (F.coalesce(confidence, F.lit(0.0)) >= threshold) & ~F.arrays_overlap(found, F.array(*map(F.lit, vetoes)))


# What no subject is, in Chinese and in English.
CHINESE_STOP = ("法", "图", "所", "称", "只", "仅", "均", "都", "不", "不仅", "缺点", "优点", "特点", "结果", "原因", "作用", "用途", "定义", "方法", "步骤", "条件", "性能", "材料", "体系", "过程")
CHINESE_END = ("只", "仅", "均", "都", "不", "不仅", "也", "的", "为", "而", "则", "所", "称", "可", "能", "会")
CHINESE_TRIGGERS = ("取决于", "决定于", "属于", "分为", "定义为", "称为", "用于", "用作", "具有", "含有", "包含", "导致", "影响", "提高", "降低", "采用", "通过", "位于", "连接", "分别为", "证明", "表明")
ENGLISH_STOP = (
    "it", "this", "that", "which", "they", "these", "those", "there", "only", "also", "therefore", "the result", "this result", "that result", "the method", "this method", "the process",
    "this process", "advantage", "disadvantage", "result", "method", "process", "property", "value", "condition",
)
ENGLISH_END = ("is", "are", "was", "were", "has", "have", "had", "can", "may", "might", "will", "would", "shall", "should", "could", "must", "only", "also", "therefore", "and", "or", "of", "for", "to")
ENGLISH_TRIGGERS = (
    "is defined as", "is known as", "also known as", "consists of", "is composed of", "contains", "comprises", "belongs to", "is classified as", "is used for", "is used as", "serves as",
    "results in", "leads to", "depends on", "is affected by", "is higher than", "is lower than",
)
ENGLISH_BACK = r"^(?:it|this|that|these|those|which|they|there)\b"
ENGLISH_WORD = r"[A-Za-z][A-Za-z0-9'/-]*"
SENTENCE_SIGN = r"[。；;!?！？]"
NO_LETTER = r"^[^\p{L}]+$"
SUBJECT_RIM = " ，,。.；;：:\t\r\n"


def _first(checks: Iterable[tuple[str, Column]]) -> Column:
    out = None
    for name, holds in checks:
        out = F.when(holds, F.lit(name)) if out is None else out.when(holds, F.lit(name))
    return out.otherwise("ok")


def subject_fault(subject: Column, language: Column) -> Column:
    """'ok' for a name that can be the subject of a fact, else the first reason why not; by the rules of its language ('zh', 'en', or
    'mixed', to which both apply)."""
    trimmed = F.btrim(F.regexp_replace(F.coalesce(subject, F.lit("")), r"(?U)\s+", " "), F.lit(SUBJECT_RIM))
    any_of = lambda value, words: F.lit(False) if not words else F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(value, w))

    def chinese(value: Column) -> Column:
        return _first((
            ("subject_too_short", F.length(value) < 2),
            ("subject_too_long", F.length(value) > 80),
            ("subject_stopword", value.isin(*CHINESE_STOP)),
            ("subject_bad_suffix", value.rlike(f"(?:{'|'.join(CHINESE_END)})$")),
            ("subject_contains_sentence_boundary", value.rlike(SENTENCE_SIGN)),
            ("subject_contains_relation_trigger", any_of(value, CHINESE_TRIGGERS)),
            ("subject_deictic_clause", F.contains(value, F.lit("上述")) & (F.length(value) > 10)),
            ("subject_numeric_or_symbol", value.rlike(NO_LETTER)),
            ("subject_clause_like", F.regexp_count(value, F.lit("[,，:：]")) >= 2),
        ))

    def english(value: Column) -> Column:
        lower = F.lower(value)
        words = F.regexp_extract_all(value, F.lit(f"({ENGLISH_WORD})"), F.lit(1))
        return _first((
            ("subject_too_short", F.length(value) < 2),
            ("subject_too_long", F.length(value) > 140),
            ("subject_stopword", lower.isin(*ENGLISH_STOP) | lower.rlike(ENGLISH_BACK)),
            ("subject_contains_sentence_boundary", value.rlike(SENTENCE_SIGN)),
            ("subject_numeric_or_symbol", (F.size(words) == 0) & value.rlike(NO_LETTER)),
            ("subject_clause_like", F.size(words) > 18),
            ("subject_bad_suffix", F.coalesce(F.lower(F.try_element_at(words, F.lit(-1))).isin(*ENGLISH_END), F.lit(False))),
            ("subject_contains_relation_trigger", any_of(lower, ENGLISH_TRIGGERS)),
            ("subject_clause_like", F.regexp_count(value, F.lit("[,;:]")) >= 2),
        ))

    def judged(value: Column) -> Column:
        foreign = english(value)
        return F.when(language == "zh", chinese(value)).when(foreign != "ok", foreign).when((language == "mixed") & any_of(value, CHINESE_TRIGGERS), "subject_contains_relation_trigger").otherwise("ok")

    return let(trimmed, judged)


def table_anomalies(rows: DataFrame, table: list[str], anonymous: str) -> DataFrame:
    """The table keys, n_rows, n_risks, n_doubled and the sorted reasons of tables that cannot be trusted as a whole.

    rows: the table keys, subject, prop, row_no, value, condition, risk (true for a row with a fault of its own). A value that one row
    states of several properties is doubled; samples without a name (by the pattern) that differ without a condition that tells them
    apart are a reason of their own. Three levels of partial aggregation on keys that begin with the table; no window and no row
    list, so that a table with a third of all rows is reduced before it is shuffled.
    """
    blank = F.coalesce(F.col("condition"), F.lit("")) == ""
    doubled = (
        rows.where("value <> ''").groupBy(*table, "subject", "row_no", "value").agg(F.count_distinct("prop").alias("n_props")).where("n_props >= 2").groupBy(*table).agg(F.count("*").alias("n_doubled"))
    )
    measured = rows.where(F.col("subject").rlike(anonymous)).groupBy(*table, "subject", "prop").agg(
        F.count("*").alias("n"), F.count_distinct(F.nullif(F.col("value"), F.lit(""))).alias("n_values"), F.count_distinct(F.coalesce("condition", F.lit(""))).alias("n_conditions"), F.bool_or(blank).alias("any_blank")
    )
    unnamed = measured.where("n >= 2 and n_values >= 2 and (n_conditions < n or any_blank)").select(*table).distinct().withColumn("unnamed", F.lit(True))
    counted = rows.groupBy(*table).agg(F.count("*").alias("n_rows"), F.count_if("risk").alias("own"))
    joined = counted.join(doubled, table, "left").join(unnamed, table, "left").withColumn("n_doubled", F.coalesce("n_doubled", F.lit(0)))
    risks = F.col("own") + F.when(F.col("n_doubled") >= 2, F.col("n_doubled")).otherwise(0)
    marked = joined.withColumn("n_risks", risks)
    misaligned = ((F.col("n_rows") >= 4) & (F.col("n_risks") >= F.greatest(F.lit(3), F.floor(F.col("n_rows") * 0.25 + 0.999)))) | (
        (F.col("n_rows") >= 2) & (F.col("n_risks") >= 2) & (F.col("n_risks") / F.col("n_rows") >= 0.5)
    )
    found = reasons({
        "table_column_alignment_anomaly": misaligned,
        "same_value_projected_to_multiple_properties": misaligned & (F.col("n_doubled") >= 2),
        "anonymous_sample_without_distinguishing_conditions": F.coalesce(F.col("unnamed"), F.lit(False)),
    })
    return marked.select(*table, "n_rows", "n_risks", "n_doubled", found.alias("reasons")).where("size(reasons) > 0")


def mass_conflicts(rows: DataFrame, keys: list[str], formula_properties: Iterable[str], mass_properties: Iterable[str]) -> DataFrame:
    """The keys of table rows whose stated molar mass is not that of the formula beside it (by more than 2 and more than 2.5 %), with
    both. rows: the keys, prop, value. Rows without a readable formula or mass give none."""
    of = lambda names: F.min(F.when(F.col("prop").isin(*names), F.col("value")))
    sides = rows.groupBy(*keys).agg(of(list(formula_properties)).alias("formula"), of(list(mass_properties)).alias("stated_"))
    number = F.regexp_extract("stated_", r"[0-9]+(?:\.[0-9]+)?", 0).try_cast("double")
    weighed = sides.where("formula is not null and stated_ is not null").withColumns({"mass": molar_mass_of("formula"), "stated": number})
    return weighed.where(~F.isnan("mass") & (F.abs(F.col("mass") - F.col("stated")) > F.greatest(F.lit(2.0), F.col("stated") * 0.025))).select(*keys, "formula", F.round("mass", 3).alias("mass"), "stated")

"""The 59-column contract of fact rows: names in order, schema, digest."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of a delivered fact in the order of the contract.
COLUMNS = (
    "fact_id", "graph_fact_key", "文档ID", "书名", "章节路径", "来源定位", "来源类型", "所属表格ID", "所属表格标题", "主体名称", "主体类型",
    "事实类型", "predicate_raw", "edge_verb", "fact_node_label", "attribute_category", "attribute_category_key", "attribute_name", "attribute_key", "尾实体/取值文本", "value_hidden",
    "value_display_policy", "value_display_reason", "normalized_value_text", "normalized_value_num", "normalized_unit", "数值", "范围下限", "范围上限", "单位", "数值类型", "value_type",
    "条件文本", "structured_condition_json", "condition_attributes", "方法名称", "process_id", "process_name", "process_type", "step_id", "step_index", "step_label", "step_action", "step_object",
    "step_condition_text", "step_result_text", "previous_step_id", "next_step_id", "component_name", "component_role", "component_amount_text", "component_amount_value",
    "component_amount_unit", "component_amount_attribute", "table_semantic_type", "condition_metric_role", "置信度", "抽取来源", "证据文本",
)
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])


def digest(columns: tuple[str, ...] | list[str] = COLUMNS) -> str:
    """SHA-256 of the header line."""
    return hashlib.sha256("\t".join(columns).encode("utf-8")).hexdigest()


def check_header(columns: list[str]) -> None:
    """Raise unless the columns are those of the contract, in its order."""
    if list(columns) != list(COLUMNS):
        wrong = [f"{i}: {a!r} instead of {b!r}" for i, (a, b) in enumerate(zip(columns, COLUMNS, strict=False)) if a != b]
        raise ValueError(f"header of {len(columns)} columns does not follow the contract; " + "; ".join(wrong[:5]))


def project(rows: DataFrame, given: dict[str, Column]) -> DataFrame:
    """Rows in the form of the contract: the columns given, '' for all others, everything text."""
    unknown = set(given) - set(COLUMNS)
    if unknown:
        raise ValueError(f"not in the contract: {sorted(unknown)}")
    return rows.select(*[F.coalesce(given[c].cast("string"), F.lit("")).alias(c) if c in given else F.lit("").alias(c) for c in COLUMNS])


def violations(rows: DataFrame) -> DataFrame:
    """row fact_id, reason of rows that break the contract: blank id, blank subject or evidence, confidence outside 0..1, control characters."""
    confidence = F.col("置信度").try_cast("double")
    checks = F.array(
        F.when(F.coalesce("fact_id", F.lit("")) == "", "blank_fact_id"),
        F.when(F.coalesce("主体名称", F.lit("")) == "", "blank_subject"),
        F.when(F.coalesce("证据文本", F.lit("")) == "", "blank_evidence"),
        F.when(confidence.isNull() | ~confidence.between(0, 1), "bad_confidence"),
        F.when(F.coalesce(F.col("`尾实体/取值文本`"), F.lit("")).rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), "control_character"),
    )
    return rows.select("fact_id", F.explode(F.array_compact(checks)).alias("reason"))

"""Table semantics on the long grid: header rows, axis features and roles, units of headers, and the unpivot into facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.text import numeric_like
from factweave.functions.values import parse_value
from factweave.operators.documents import _exploder, grid_of, tables_of

# Words of a header that tell what its column holds.
ROLE_WORDS = {
    "entity": ("材料", "名称", "样品", "试样", "配方", "产品", "物质", "组分"),
    "identifier": ("编号", "序号", "代号", "型号", "批次"),
    "condition": ("条件", "温度条件", "湿度", "升温速率", "频率", "气氛", "介质"),
    "method": ("方法", "标准", "仪器", "设备"),
    "note": ("备注", "说明", "现象", "结论"),
}
HEADER_UNIT = r"^(.*?)\s*(?:[（(]\s*(.+?)\s*[)）]|/\s*(.+?))\s*$"


def axis_features(cells: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per column of a table: id, table_no, c, label, n_cells, numeric_ratio, unique_ratio. Header rows give the label."""
    body = ~F.col("header")
    filled = body & (F.col("cell") != "")
    return cells.groupBy(id_col, "table_no", "c").agg(
        F.max_by(F.when(F.col("header"), F.col("cell")), F.when(F.col("header"), F.col("r"))).alias("label"),
        F.count_if(filled).alias("n_cells"),
        F.round(F.avg(F.when(filled, numeric_like(F.col("cell")).cast("int"))), 6).alias("numeric_ratio"),
        F.round(F.count_distinct(F.when(filled, F.col("cell"))) / F.greatest(F.count_if(filled), F.lit(1)), 6).alias("unique_ratio"),
    )


def axis_roles(features: DataFrame) -> DataFrame:
    """The features with role and confidence: additive evidence of words and ratios, the highest score wins, ties in the order of
    declaration; the confidence grows with the margin."""
    has = lambda words: F.coalesce(F.col("label"), F.lit("")).rlike("|".join(words))
    numeric, unique = F.coalesce("numeric_ratio", F.lit(0.0)), F.col("unique_ratio")
    scores = {
        "property": F.when(numeric >= 0.6, 0.7).otherwise(0.0) + F.when(has(["\\(", "（", "/"]), 0.2).otherwise(0.0),
        "entity": F.when(has(ROLE_WORDS["entity"]), 0.6).otherwise(0.0) + F.when((numeric < 0.35) & (unique >= 0.4), 0.3).otherwise(0.0) + F.when(F.col("c") == 0, 0.2).otherwise(0.0),
        "identifier": F.when(has(ROLE_WORDS["identifier"]), 0.7).otherwise(0.0),
        "condition": F.when(has(ROLE_WORDS["condition"]), 0.5).otherwise(0.0),
        "method": F.when(has(ROLE_WORDS["method"]), 0.6).otherwise(0.0),
        "note": F.when(has(ROLE_WORDS["note"]), 0.6).otherwise(0.0),
    }
    ranked = F.array(*[F.struct((-s).alias("minus"), F.lit(i).alias("at"), F.lit(role).alias("role")) for i, (role, s) in enumerate(scores.items())])
    order = F.array_sort(ranked)
    top, second = -F.element_at(order, 1)["minus"], -F.element_at(order, 2)["minus"]
    role = F.when(top > 0, F.element_at(order, 1)["role"]).otherwise("unknown")
    confidence = F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.98), 0.55 + 0.35 * (top - second))), 6)
    return features.withColumns({"role": role, "confidence": confidence})


def topology(roles: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per table: id, table_no, topology, n_columns and counts of the roles, by an ordered list of rules."""
    count = lambda role: F.count_if(F.col("role") == role)
    counted = roles.groupBy(id_col, "table_no").agg(
        F.count("*").alias("n_columns"), count("property").alias("n_property"), (count("entity") + count("identifier")).alias("n_subject"), count("condition").alias("n_condition")
    )
    kind = (
        F.when((F.col("n_subject") >= 1) & (F.col("n_property") >= 1) & (F.col("n_condition") >= 1), "subject_condition_property")
        .when((F.col("n_subject") >= 1) & (F.col("n_property") >= 1), "subject_property")
        .when((F.col("n_condition") >= 1) & (F.col("n_property") >= 1), "condition_response")
        .when(F.col("n_property") >= 2, "property_matrix")
        .when(F.col("n_columns") == 2, "key_value")
        .otherwise("unresolved")
    )
    return counted.withColumn("topology", kind)


def row_subject_facts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Unpivot with the first column as subject: id, table_no, r, c, subject, property, unit, value_text, value (parsed).

    The header label is cut into a property name and a unit. Empty cells give no fact, rows without a subject none either. Subject
    and label are known where the grid is built, so nothing is shuffled; numbers are parsed by native expressions.
    """

    def work(text: str) -> list[tuple]:
        out = []
        for n, (_, _, kind, raw) in enumerate(tables_of(text), 1):
            grid = grid_of(kind, raw)
            labels = {c: cell for r, c, cell, header, _ in grid if header and r == 0}
            subjects = {r: cell for r, c, cell, header, _ in grid if c == 0 and not header}
            out += [(n, r, c, subjects[r], labels.get(c), cell) for r, c, cell, header, _ in grid if c and cell and not header and subjects.get(r)]
        return out

    facts = _exploder(documents, id_col, text_col, work, "table_no int, r int, c int, subject string, label string, value_text string")
    name = F.coalesce(F.nullif(F.regexp_extract("label", HEADER_UNIT, 1), F.lit("")), F.col("label"))
    unit = F.coalesce(F.nullif(F.regexp_extract("label", HEADER_UNIT, 2), F.lit("")), F.nullif(F.regexp_extract("label", HEADER_UNIT, 3), F.lit("")))
    named = facts.select(id_col, "table_no", "r", "c", "subject", name.alias("property"), unit.alias("unit"), "value_text")
    return named.withColumn("value", parse_value(F.col("value_text"), F.col("unit")))


def best_conditions(candidates: DataFrame, record_keys: list[str]) -> DataFrame:
    """Scoped binding: per record, type and name the candidates of the highest priority stay; more than one distinct value among
    them is a conflict and all stay, else the most confident one does.

    candidates: the record keys, condition_type, name, value, priority, confidence, ord.
    """
    slot = Window.partitionBy(*record_keys, "condition_type", "name")
    top = candidates.withColumn("top_", F.max("priority").over(slot)).where("priority = top_")
    judged = top.withColumn("conflict", F.size(F.collect_set("value").over(slot)) > 1).withColumn(
        "place_", F.row_number().over(slot.orderBy(F.desc("confidence"), "ord"))
    )
    return judged.where("conflict or place_ = 1").drop("top_", "place_")


def header_rows(cells: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, table_no, r, explicit, numeric_ratio, is_header: rows with header cells are headers; without any, the first row is one if it
    is less numeric than the rows below it or made of short texts."""
    filled = F.col("cell") != ""
    rows = cells.groupBy(id_col, "table_no", "r").agg(
        F.bool_or(F.col("header") & filled).alias("explicit"),
        F.coalesce(F.round(F.avg(F.when(filled, numeric_like(F.col("cell")).cast("int"))), 6), F.lit(0.0)).alias("numeric_ratio"),
        F.coalesce(F.avg(F.when(filled, (F.length("cell") <= 30).cast("int"))), F.lit(0.0)).alias("short_ratio"),
    )
    table = Window.partitionBy(id_col, "table_no")
    later = F.avg(F.when((F.col("r") >= 1) & (F.col("r") <= 5), F.col("numeric_ratio"))).over(table)
    any_explicit = F.bool_or("explicit").over(table)
    guess = (F.col("r") == 0) & (F.col("numeric_ratio") < 0.5) & ((F.coalesce(later, F.lit(0.0)) > F.col("numeric_ratio") + 0.2) | (F.col("short_ratio") >= 0.8))
    return rows.withColumn("is_header", F.when(any_explicit, F.col("explicit")).otherwise(guess)).drop("short_ratio")


def row_header_columns(features: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, table_no, n_columns: how many leading columns (three at most) name their rows: little numbers, mostly distinct."""
    fits = (F.coalesce("numeric_ratio", F.lit(0.0)) <= 0.35) & (F.col("unique_ratio") >= 0.4)
    first_bad = features.groupBy(id_col, "table_no").agg(F.min(F.when(~fits, F.col("c"))).alias("bad"), F.max("c").alias("last"))
    return first_bad.select(id_col, "table_no", F.least(F.coalesce("bad", F.lit(1)), F.lit(3), F.col("last") + 1).alias("n_columns"))

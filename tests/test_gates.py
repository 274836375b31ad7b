"""The gates on small facts, with nulls, empty texts, ties and names that clash."""

from pyspark.sql import functions as F

from factweave.operators import gates as Q
from factweave.operators.facts import filtered
from factweave.operators.profile import item_batches

COLUMNS = "subject string, prop string, value string, evidence string, source string, faults string"


def test_surface_faults(spark):
    rows = [
        ("RX-1", "密度", "1.8", "RX-1的密度为1.8", "table_x", "x"),
        (None, "", None, "", None, "x"),
        ("MPa", "页码", "见图", "第3章 概述……12", "text_x", "x"),
        ("（甲", "密度", "1.2.3", "e", "", "x"),
        ("其性能", "组成", "甲" * 40, "e", "table_x", "x"),
        ("x" * 81, "密度", "y" * 1601, "e", "", "x"),
    ]
    df = spark.createDataFrame(rows, COLUMNS)
    found = [r[0] for r in df.select(Q.surface_faults(*[F.col(c) for c in ("subject", "prop", "value", "evidence", "source")])).collect()]
    assert found[0] == [] and found[1] == ["missing_required_field"]
    assert found[2] == ["bibliographic_or_index_property", "numeric_unit_or_variable_subject", "summary_or_placeholder_value", "toc_or_page_index_evidence"]
    assert found[3] == ["glued_numeric_surface", "unbalanced_subject"] and found[4] == ["concatenated_table_component_value", "discourse_or_deictic_subject"]
    assert found[5] == ["overlong_or_sentence_subject", "overlong_value"]


def test_support_units_and_labels(spark):
    df = spark.createDataFrame([("RX", "密度", "1.8", "RX的密度为 1.8", "g·cm-3", "text_labeled_field"), ("TB", "熔点", "8", None, None, None), ("x", "外观", "密度：1 熔点：2", "", "%", "text_labeled_field")], "s string, p string, v string, e string, u string, source string")
    c = F.col
    out = df.select(Q.support(c("s"), c("p"), c("p"), c("v"), c("e"), c("e"), F.lit(""), F.lit(None).cast("string"), c("source")).alias("j"), Q.unit_fits(c("p"), c("u")).alias("fits"), Q.many_values(c("v"), c("source")).alias("many")).collect()
    assert out[0].j.score == 0.18 and "value_supported_by_evidence" in out[0].j.positive and out[1].j.score == 0.03
    assert [r.fits for r in out] == [True, False, None] and [r.many for r in out] == [False, False, True]


def test_subjects_and_lines(spark):
    cases = {"RX-1 清漆": "ok", "材料": "subject_stopword", "甲": "subject_too_short", "甲的": "subject_bad_suffix", "甲用于乙": "subject_contains_relation_trigger", "12.5": "subject_numeric_or_symbol"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert [r[0] for r in df.select(Q.subject_fault(F.col("s"), F.lit("zh"))).collect()] == list(cases.values())
    english = {"nitro resin": "ok", "this resin": "subject_stopword", "resin that is": "subject_bad_suffix", "resin contains water": "subject_contains_relation_trigger", "it": "subject_stopword"}
    df = spark.createDataFrame([(k,) for k in english], "s string")
    assert [r[0] for r in df.select(Q.subject_fault(F.col("s"), F.lit("en"))).collect()] == list(english.values())
    lines = spark.createDataFrame([("第3章 概述……12",), ("密度为 12",), ("",), (None,)], "l string")
    assert [bool(r[0]) for r in lines.select(Q.index_line(F.col("l"))).collect()] == [True, False, False, False]


def test_tables_and_masses(spark):
    rows = [("b", "t", "某样品", "密度", str(i), f"{i}", "", False) for i in range(3)] + [("b", "u", "RX", p, "1", "5", "c", False) for p in ("a", "b")] + [("b", "u", "RX", p, "2", "6", "c", False) for p in ("a", "b")]
    df = spark.createDataFrame(rows, "book string, table_id string, subject string, prop string, row_no string, value string, condition string, risk boolean")
    found = {r.table_id: r for r in Q.table_anomalies(df, ["book", "table_id"], "^某").collect()}
    assert found["t"].reasons == ["anonymous_sample_without_distinguishing_conditions"]
    assert found["u"].n_doubled == 2 and found["u"].reasons == ["same_value_projected_to_multiple_properties", "table_column_alignment_anomaly"]
    assert Q.table_anomalies(df.limit(0), ["book", "table_id"], "^某").count() == 0
    masses = spark.createDataFrame([("1", "分子式", "H2O"), ("1", "分子量", "18.0"), ("2", "分子式", "H2O"), ("2", "分子量", "40"), ("3", "分子量", "1"), ("4", "分子式", "Xy"), ("4", "分子量", "3")], "k string, prop string, value string")
    assert [(r.k, r.mass, r.stated) for r in Q.mass_conflicts(masses, ["k"], ["分子式"], ["分子量"]).collect()] == [("2", 18.015, 40.0)]


def test_filters_subjects_and_batches(spark):
    df = spark.createDataFrame([("a", "x", 1), ("b", "y", 2), (None, "x", 3)], "s string, k string, action int")
    assert filtered(df, {"k": "x", "s": None}).count() == 2 and filtered(df, {"k": "both"}, {"k": {"both": ("x", "y")}}).count() == 3
    denied = spark.createDataFrame([("a ",), (None,), ("",)], "name string")
    assert sorted((r.s or "", r.action) for r in Q.subject_actions(df.drop("action"), denied, "s").collect()) == [("", "keep"), ("a", "manual_review"), ("b", "keep")]
    many = spark.range(1000).select(F.when(F.col("id") < 700, "a").otherwise("b").alias("g"), "id")
    out = {(r.g, r.batch): r.n_items for r in item_batches(many, "g", "id", 12, ranges=7).collect()}
    assert out["a", 0] == 12 and out["a", 58] == 4 and out["b", 24] == 12 and sum(out.values()) == 1000
    assert item_batches(many.limit(0), "g", "id", 12).count() == 0

from pyspark.sql import functions as F

from factweave.functions import cleanup as C
from factweave.functions.formula import molar_mass
from factweave.operators import alignment as A
from factweave.operators import profile as P


def test_formulas():
    assert abs(molar_mass("CuSO4·5H2O") - 249.68) < 0.01 and abs(molar_mass("Ca(OH)₂") - 74.09) < 0.01
    assert all(molar_mass(f) is None for f in (None, "", "Xx", "(CH3", "CH3)", "()", "H2.", "甲"))


def test_collapsed_series():
    assert C.collapsed_series("1.231.451.67", 3) == ["1.23", "1.45", "1.67"]
    assert C.collapsed_series("102030", 3) == ["10", "20", "30"]
    assert C.collapsed_series("", 2) is None and C.collapsed_series("1a", 1) is None and C.collapsed_series("12", 3) is None


def test_cleaning(spark):
    rows = spark.createDataFrame([(r"$\mathrm{密度}\times 10^{-3}$", "1) 试样的熔点（℃）"), (None, None)], "m string, p string")
    out = rows.select(C.clean_math(F.col("m")).alias("m"), C.clean_property(F.col("p")).alias("p")).collect()
    assert out[0].m == "密度×10-3" .replace("×10", "× 10") and out[0].p == "熔点" and out[1].m is None and out[1].p == ""
    names = spark.createDataFrame([("“关于 穆朔复合材料（KX-424）”",), (None,)], "s string").select(C.subject_name("s").alias("n")).collect()
    assert names[0].n.canonical == "穆朔复合材料(KX-424)" and names[0].n.aliases == ["穆朔复合材料", "KX-424"] and names[1].n.canonical == ""
    answers = spark.createDataFrame([('text {"a": 1} tail',), ("```json\n{\"b\": 2}\n```",), ("none",), (None,)], "t string").select(C.first_json("t")).collect()
    assert [r[0] for r in answers] == ['{"a": 1}', '{"b": 2}', None, None]
    conditions = spark.createDataFrame([('[{"name": "温度", "value_num": 20, "unit": "℃"}, {"name": "压力", "value_text": "高"}]',), ("[]",), (None,)], "c string")
    assert [r[0] for r in conditions.select(C.canonical_conditions(F.col("c"))).collect()] == ["压力=高 ；温度=20.0 ℃", "[]", ""]


def test_cleaning_reaches_every_value(spark, tmp_path):
    from __spark_entry__ import queries

    values = [r"$\mathrm{2.5}\times 10^{-3}$", r"$26 \mathrm{^{\circ}C}$", r"$86\% \sim 88\%$", r"x_{1} \leq 3 \mu m", "1 . 32 和 12 345", "Ca(OH)2", "5 ± 1 ℃", None]
    spark.createDataFrame(list(enumerate(values)), "row_id bigint, `尾实体/取值文本` string").write.parquet(str(tmp_path / "graph_import_ready_generalized.parquet"))
    out = queries()["cleaned_math"](spark, str(tmp_path)).orderBy("row_id").collect()
    assert [r.cleaned for r in out] == ["2.5× 10-3", "26 ℃", "86% ~ 88%", "x1 ≤ 3 μ m", "1 . 32 和 12 345", "Ca(OH)2", "5 ± 1 ℃", ""]
    assert out[4].compact == "1.32 和 12345" and out[5].mass == 74.092 and out[6].mass is None


def test_profiles(spark):
    text = "第1章\n100001 甲物\n中文名称：甲\n100002 乙物\n说明\n表 1 性能\n\n| a | b |\n|---|---|\n| 1 | 2 |\n"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")
    assert [(r.code, r.title, r.last_line - r.first_line) for r in P.entry_spans(docs).collect()] == [("100001", "甲物", 1), ("100002", "乙物", 7)]
    assert [(r.title, r.title_source) for r in P.table_captions(docs).collect()] == [("表 1 性能", "caption")]
    assert [r.n_codes for r in P.document_profile(docs).orderBy("doc_id").collect()] == [2, 0]
    blocks = spark.createDataFrame([(1, i, s) for i, s in enumerate([0, 8, 3, 0, 9, 1, 3])], "d int, o int, s int")
    assert sorted((r["first"], r["last"], r.score) for r in P.process_spans(blocks, F.col("s"), ["d"], "o").collect()) == [(1, 2, 11), (4, 4, 9)]


def test_alignment(spark):
    ontology = spark.createDataFrame([("密度", "密度", "基"), ("表观密度", "密度", "基"), ("熔点", "熔点", "热"), ("熔融温度", "熔点", "热")], "alias string, canonical_name string, attribute_category string")
    labels = spark.createDataFrame([("密度（g/cm3）",), ("平均密度",), ("密度熔点",), ("无关",)], "label string")
    out = {r.label: (r.canonical_name, r.status) for r in A.decide(A.candidates(labels, ontology)).collect()}
    assert out["密度（g/cm3）"] == ("密度", "exact") and out["平均密度"] == ("密度", "weak") and out["密度熔点"][1] == "ambiguous" and "无关" not in out


def test_headers_and_conditions(spark):
    from factweave.operators import documents as D
    from factweave.operators import extract as X
    from factweave.operators import tables as G

    html = "<table><tr><td>名</td><td>密度</td></tr><tr><td>甲</td><td>1.5</td></tr><tr><td>乙</td><td>1.7</td></tr></table>"
    docs = spark.createDataFrame([(1, html), (2, "在41%湿度下，在80 ℃保温5 min，在80 ℃放置。MP-1的密度为2"), (3, None)], "doc_id bigint, text string")
    assert [(r.r, r.is_header) for r in G.header_rows(D.cells(docs)).orderBy("r").collect()] == [(0, True), (1, False), (2, False)]
    assert G.row_header_columns(G.axis_features(D.cells(docs).withColumn("header", F.col("r") == 0))).first().n_columns == 1
    found = sorted((r.name, r.value) for r in X.conditions(docs).collect())
    assert found == [("保温时间", 5.0), ("温度", 80.0), ("湿度", 41.0)]
    assert X.with_conditions(X.bound_values(docs), X.conditions(docs), ["doc_id", "ord"]).first().condition_text is None

"""The table compiler on small tables of every layout."""

from factweave.operators.documents import grid_of
from factweave.operators.table_compiler import Table, cell_roles, compiled_facts, header_paths, label_path, name_and_unit, same_labels, table_plans


def pipe(*rows):
    return Table(grid_of("pipe", "\n".join([rows[0], "|---" * rows[0].count("|") + "|", *rows[1:]])))


def test_row_subjects():
    t = pipe("| 材料 | 密度 (g/cm3) | 熔点 (℃) |", "| RX-1 | 1.8 | 204 |", "| TB-2 | 1.93 | 350 |")
    assert (t.header_rows, t.row_headers) == (1, 1) and t.topology[:2] == ("entity_by_property", "row_subject")
    assert [(f[2], f[3], f[5], f[6], f[7], f[8], f[12]) for f in t.facts()][:2] == [("RX-1", "table_entity_axis", "密度", "g/cm3", "1.8", "measured_result", "ready"), ("RX-1", "table_entity_axis", "熔点", "℃", "204", "measured_result", "ready")]
    assert len(t.facts()) == 4 and all(0.8 < f[11] <= 0.98 for f in t.facts())


def test_conditions_and_samples_stay_with_their_row():
    t = pipe("| 样品号 | 升温速率 (K/min) | 分解温度 (℃) |", "| A1 | 5 | 240 |", "| A2 | 10 | 251 |")
    facts = t.facts()
    assert [(f[2], f[4], f[5], f[7], f[9]) for f in facts] == [("A1", "", "分解温度", "240", ["升温速率=5 K/min"]), ("A2", "", "分解温度", "251", ["升温速率=10 K/min"])]
    assert t.topology[0] == "condition_by_property"


def test_properties_in_rows():
    t = pipe("| 性能 | 沐胶 | 渝胶 |", "| 密度 (g/cm3) | 1.1 | 1.2 |", "| 拉伸强度 (MPa) | 20 | 30 |")
    assert {(f[2], f[5], f[6], f[7]) for f in t.facts()} == {("沐胶", "密度", "g/cm3", "1.1"), ("渝胶", "密度", "g/cm3", "1.2"), ("沐胶", "拉伸强度", "MPa", "20"), ("渝胶", "拉伸强度", "MPa", "30")}
    assert {f[3] for f in t.facts()} == {"column_header"}
    alone = pipe("| 项目 | 数值 |", "| 密度 (g/cm3) | 1.1 |", "| 熔点 (℃) | 80 |")
    assert alone.facts("沐胶")[0][2:4] == ("沐胶", "context") and alone.facts("沐胶")[0][12] == "candidate"


def test_topologies():
    assert pipe("| 物质 | 甲 | 乙 | 丙 |", "| 甲 | 相容 | 不相容 | 相容 |", "| 乙 | 相容 | 相容 | 相容 |", "| 丙 | 相容 | 相容 | 相容 |").topology[0] == "pairwise_compatibility"
    assert pipe("| 样品 | 实验值 | 计算值 | 误差 |", "| a | 1 | 2 | 1 |").topology[0] == "model_validation"
    assert pipe("| 配方 | 氧化剂 (%) | 粘合剂 (%) | 爆速 (m/s) |", "| F1 | 60 | 20 | 7000 |").topology[0] == "composition_and_performance"
    assert pipe("| 方法 | 特点 |", "| 热重法 | 简单 |", "| 浮力法 | 精确 |").topology[0] == "method_comparison"
    assert Table([]).topology[0] == "unresolved" and Table([]).facts() == []


def test_spanned_headers_give_paths():
    raw = "<table><tr><th rowspan=2>材料</th><th colspan=2>性能</th></tr><tr><th>密度/(g/cm3)</th><th>熔点/℃</th></tr><tr><td>A-1</td><td>1.2</td><td>80</td></tr></table>"
    t = Table(grid_of("html", raw))
    assert t.header_rows == 2 and [a.labels for a in t.columns] == [["材料"], ["性能", "密度/(g/cm3)"], ["性能", "熔点/℃"]]
    assert t.columns[0].role == "entity" and t.columns[2].unit == "℃" and t.header_confidence == 1.0


def test_small_parts():
    assert label_path(["a", " a ", "", "b", "a"]) == ["a", "b", "a"] and name_and_unit("热导率 (W/(m·K))") == ("热导率", "W/(m·K)") and name_and_unit("密度") == ("密度", "")
    assert same_labels(["甲", "乙", "丙", "丁"], ["甲", "乙", "丙"]) and not same_labels(["甲"], ["甲"])


def test_operators_on_documents(spark):
    text = "# 沐胶\n\n| 材料 | 密度 (g/cm3) |\n|---|---|\n| A-1 | 1.2 |\n| A-2 |  |\n"
    df = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x"), (3, "no table", "x")], "doc_id bigint, text string, subject string")
    assert [(r.doc_id, r.subject, r.property, r.value_text) for r in compiled_facts(df).collect()] == [(1, "A-1", "密度", "1.2")]
    assert table_plans(df).first().topology == "entity_by_property" and header_paths(df).count() == 4
    assert {r.role for r in cell_roles(df).collect()} == {"header", "subject_value", "measured_result", "empty"}
    assert compiled_facts(df.limit(0)).count() == 0

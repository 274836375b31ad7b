"""Structure, extraction and relational operators on small fixtures."""

from pyspark.sql import functions as F

from factweave.functions import text as T
from factweave.functions import values as V
from factweave.operators import documents as D
from factweave.operators import extract as X
from factweave.operators import facts as K
from factweave.operators import relational as R
from factweave.operators import tables as G

BOOK = """# 第1章 总论
## 1.1 性质
密度为1.58 g/cm3。其熔点为80 ℃。

| 材料 | 密度 (g/cm3) | 熔点 (℃) |
|---|---|---|
| RDX | 1.80 | 204 |
| TATB | 1.93 | 350 |

# 参考文献
[1] 不是事实
# 第2章 方法
<table><tr><th rowspan="2">甲</th><th colspan="2">乙</th></tr><tr><th>丙</th><th>丁</th></tr><tr><td>1</td><td>2</td></tr></table>
"""


def test_headings():
    found = D.headings_of(BOOK)
    assert [(h[1], h[2], h[4]) for h in found] == [("第1章 总论", 1, False), ("1.1 性质", 3, False), ("参考文献", 1, True), ("第2章 方法", 1, False)]
    assert found[1][3] == "第1章 总论 > 1.1 性质" and D.headings_of("") == []


def test_tables_and_grids():
    pipe, markup = D.tables_of(BOOK)
    assert pipe[2] == "pipe" and markup[2] == "html"
    grid = {(r, c): (t, h) for r, c, t, h, _ in D.grid_of(*pipe[2:])}
    assert grid[0, 1] == ("密度 (g/cm3)", True) and grid[2, 2] == ("350", False) and len(grid) == 9
    spans = {(r, c): (t, copy) for r, c, t, _, copy in D.grid_of(*markup[2:])}
    assert spans[1, 0] == ("甲", True) and spans[0, 2] == ("乙", True) and spans[1, 1] == ("丙", False) and spans[2, 2] == ("", False)
    assert D.split_pipe_row(r"| a \| b | `c|d` |") == ["a | b", "`c|d`"]


def test_blocks_leave_out_tables_and_noise():
    assert [b[3] for b in D.blocks_of(BOOK)] == ["密度为1.58 g/cm3。其熔点为80 ℃。"]


def test_windows_cover_and_keep_the_limit():
    text = "# A\n\n" + "\n\n".join("x" * n for n in (30, 50, 20, 90, 10, 250))
    found = D.windows_of(text, 100)
    assert all(len(w[2]) <= 100 for w in found) and sum(w[2].count("x") for w in found) >= 450


def test_table_facts(spark):
    docs = spark.createDataFrame([(1, BOOK), (2, None), (3, "")], "doc_id bigint, text string")
    facts = {(r.subject, r.property): (r.unit, r.value.value_num) for r in G.row_subject_facts(docs).where("table_no = 1").collect()}
    assert facts == {("RDX", "密度"): ("g/cm3", 1.8), ("RDX", "熔点"): ("℃", 204.0), ("TATB", "密度"): ("g/cm3", 1.93), ("TATB", "熔点"): ("℃", 350.0)}
    roles = {r.c: r.role for r in G.axis_roles(G.axis_features(D.cells(docs))).where("table_no = 1").collect()}
    assert roles == {0: "entity", 1: "property", 2: "property"}
    assert G.topology(G.axis_roles(G.axis_features(D.cells(docs)))).where("table_no = 1").first().topology == "subject_property"


def test_owner_is_carried():
    found = X.carried_values("MP-338的密度为1.5 g/cm3。其熔点为80 ℃。ZX-554的熔点为90 ℃")
    assert [(o, p, v, c) for _, o, p, v, c in found] == [("MP-338", "密度", "1.5 g/cm3", False), ("MP-338", "熔点", "80 ℃", True), ("ZX-554", "熔点", "90 ℃", False)]


def test_extractors_on_empty_and_null(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "将A-1与B-2按3:1混合，在60 ℃保温20 min后冷却")], "doc_id bigint, text string")
    assert [(r.component, r.share) for r in X.compositions(docs).orderBy(F.desc("share")).collect()] == [("A-1", 0.75), ("B-2", 0.25)]
    assert [r.action for r in X.process_steps(docs).orderBy("step_index").collect()] == ["混合", "保温", "冷却"]
    for f in (X.labelled_fields, X.bound_values, X.relations, X.abbreviations):
        f(docs).collect()


def test_language_and_clauses(spark):
    rows = spark.createDataFrame([("密度很高，含RDX",), ("The density of this material is high",), ("密度很高 the density of this material",), (None,)], "t string")
    assert [r[0] for r in rows.select(T.language(F.col("t"))).collect()] == ["zh", "en", "mixed", "zh"]
    assert spark.range(1).select(T.clauses(F.lit("甲。 ；乙，\n丙"))).first()[0] == ["甲", "乙", "丙"]


def test_conditions(spark):
    rows = [(1, "温度", "t", "20", 5, 0.9, 1), (1, "温度", "t", "20", 5, 0.8, 2), (1, "温度", "t", "30", 3, 0.99, 3), (2, "温度", "t", "20", 5, 0.9, 1), (2, "温度", "t", "25", 5, 0.8, 2)]
    df = spark.createDataFrame(rows, "record int, condition_type string, name string, value string, priority int, confidence double, ord int")
    out = sorted((r.record, r.value, r.conflict) for r in G.best_conditions(df, ["record"]).collect())
    assert out == [(1, "20", False), (2, "20", True), (2, "25", True)]


def test_dedup_ties_and_gate(spark):
    rows = spark.createDataFrame([("k", 2, 1.0), ("k", 1, 1.0), (None, 3, 0.5)], "k string, id int, s double")
    assert sorted((r.id, r.n_dropped) for r in K.keep_best(rows, ["k"], [-F.col("s"), F.col("id")]).collect()) == [(1, 1), (3, 0)]
    scored = rows.select(K.penalized(F.lit(0.5), K.reasons({"a": F.lit(True), "b": F.lit(None)}), {"a": 0.1}, 0.03).alias("x")).first().x
    assert abs(scored - 0.4) < 1e-9


def test_asof_and_intervals(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 5)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (1, 9, "c")], "k int, u int, v string")
    assert sorted(((r.k, r.t), r.v) for r in R.asof(left, right, ["k"], "t", "u", ["v"], bucket="2").collect()) == [((1, 1), None), ((1, 5), "b"), ((2, 5), None)]
    many = spark.createDataFrame([(k, t) for k in (1, 2) for t in range(0, 50, 3)], "k int, t int")
    marks = spark.createDataFrame([(k, u, f"{k}:{u}") for k in (1, 3) for u in (4, 17, 18, 33)], "k int, u int, v string")
    for width in ("1", "5", "1000"):
        found = {(r.k, r.t): r.v for r in R.asof(many, marks, ["k"], "t", "u", ["v"], bucket=width).collect()}
        assert found == {(k, t): next((f"1:{u}" for u in (33, 18, 17, 4) if k == 1 and u <= t), None) for k in (1, 2) for t in range(0, 50, 3)}
    a = spark.createDataFrame([(1, i, i + w) for i in range(0, 60, 7) for w in (0, 3, 25)], "k int, a int, b int")
    b = spark.createDataFrame([(1, i, i + w) for i in range(0, 60, 5) for w in (0, 11)], "k int, c int, d int")
    brute = a.crossJoin(b.drop("k")).where("a <= d and c <= b").count()
    assert R.overlaps(a, b, ["k"], ("a", "b"), ("c", "d"), 10).count() == brute


def test_tsv_escape(spark):
    cell = "a\\n\tb\n\\\\c\r"
    row = spark.range(1).select(V.escape_tsv(F.lit(cell)).alias("e")).select("e", V.unescape_tsv(F.col("e")).alias("u")).first()
    assert "\n" not in row.e and "\t" not in row.e and row.u == cell


def test_long_spans_are_whole():
    raw = "<table><tr><td rowspan=300>甲</td><td>0</td></tr>" + "".join(f"<tr><td>{i}</td></tr>" for i in range(1, 250)) + "<tr><td colspan=250>乙</td></tr></table>"
    cells = {(r, c): text for r, c, text, _, _ in D.grid_of("html", raw)}
    assert all(cells[r, 0] == "甲" and cells[r, 1] == str(r) for r in range(250))
    assert cells[250, 0] == "甲" and cells[250, 250] == "乙" and max(cells) == (250, 250)


def test_relations_of_any_length(spark):
    english, long = "Blend Selovite 627 with the resin and stir before sampling. ", "甲" * 60
    docs = spark.createDataFrame([(1, english + "可溶于酮类、酯类溶剂，遇水析出"), (2, f"{long}可用于{long}"), (3, "No. 5 树脂导致开裂"), (4, "可溶于水"), (5, "导致开裂"), (6, "甲属于乙属于丙"), (7, "It was 395.9 ℃. 可溶于水"), (8, english + "FE-79可溶于水")], "doc_id bigint, text string")
    found = [(r.doc_id, r.kind, r.subject, r.object) for r in X.relations(docs).orderBy("doc_id").collect()]
    assert found == [(1, "solubility", "", "酮类、酯类溶剂，遇水析出"), (2, "application", long, long), (3, "causal", "No. 5 树脂", "开裂"), (4, "solubility", "", "水"), (6, "classification", "甲", "乙属于丙"), (7, "solubility", "", "水"), (8, "solubility", "FE-79", "水")]

import zipfile

import pytest
from pyspark.sql import functions as F

from factweave.sources import contract as C
from factweave.sources import files as S
from factweave.streaming import deliveries as Q


def test_contract():
    assert len(C.COLUMNS) == 59 and len(set(C.COLUMNS)) == 59
    with pytest.raises(ValueError):
        C.check_header(list(C.COLUMNS[::-1]))


@pytest.mark.parametrize("quoted", [False, True])
def test_facts_round_trip(spark, tmp_path, quoted):
    cell = 'a\\n"b"\t=c\n末'
    rows = C.project(spark.range(2), {"fact_id": F.col("id"), "主体名称": F.lit("甲"), "证据文本": F.lit(cell), "置信度": F.lit("0.5"), "单位": F.lit(None)})
    S.write_facts(rows, str(tmp_path / "t"), quoted)
    back = S.read_facts(spark, str(tmp_path / "t"), quoted)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert S.content_digest(back) == S.content_digest(rows)
    if not quoted:
        assert S.physical_check(spark, str(tmp_path / "t")).first().n_wrong == 0
    assert C.violations(rows).count() == 0 and C.violations(rows.withColumn("置信度", F.lit("2"))).count() == 2
    with pytest.raises(ValueError):
        C.project(spark.range(1), {"other": F.lit(1)})


def test_books(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"\xef\xbb\xbf# A\r\nx\xff")
    (tmp_path / "b.md").write_bytes(b"y" * 100)
    books = S.read_books(spark, str(tmp_path), max_bytes=50)
    assert [(r.name, r.text) for r in books.collect()] == [("a", "# A\r\nx�")]
    assert [(r.line_no, r.line) for r in S.lines_of(books).collect()] == [(1, "# A"), (2, "x�")]


def test_historical(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("主体,值\n甲,1\n".encode("gb18030"))
    (tmp_path / "b.tsv").write_bytes("主体\t值\n乙\t2\n".encode("utf-8-sig"))
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "c.xlsx", "w") as book:
        book.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>主体</t></si><si><t>丙</t></si></sst>")
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet {space}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>值</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>3</v></c></row></sheetData></worksheet>')
    out = S.read_historical(spark, str(tmp_path)).collect()
    assert {(r.column_name, r.cell) for r in out} == {("主体", "甲"), ("值", "1"), ("主体", "乙"), ("值", "2"), ("主体", "丙"), ("值", "3")}


def test_manifest_and_ontology(spark, tmp_path):
    S.write_manifest(str(tmp_path / "m.json"), rows=3)
    assert S.read_manifest(str(tmp_path / "m.json"))["rows"] == 3
    (tmp_path / "bad.json").write_text('{"schema": "schema59-v1", "schema": "x"}')
    with pytest.raises(ValueError):
        S.read_manifest(str(tmp_path / "bad.json"))
    (tmp_path / "o.tsv").write_text("property_id\talias\tcanonical_name\tattribute_category\tpriority\np1\t密度\t密度\t基础\t3.7\np2\t\tx\ty\t1\n")
    assert [tuple(r) for r in S.read_ontology(spark, str(tmp_path / "o.tsv")).collect()] == [("p1", "密度", "密度", "基础", 3)]


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("=1+1", "release", "strict"), ("b", "reject", "strict")], "cell string, action string, stream string")
    S.export_rows(rows, str(tmp_path / "x"), "csv")
    assert {r.cell for r in spark.read.csv(str(tmp_path / "x"), header=True).collect()} == {"'=1+1", "b"}
    S.release(rows, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).where("action = 'release'").count() == 1
    S.append_audit(rows, str(tmp_path / "a"))
    S.append_audit(rows, str(tmp_path / "a"))
    assert spark.read.json(str(tmp_path / "a")).count() == 4


def test_import_stream_is_idempotent(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "fact_id string, at timestamp, v int"
    row = lambda k, v: spark.createDataFrame([(k, None, v)], schema)
    row("a", 1).union(row("a", 2)).union(row("b", 3)).write.parquet(source)
    stream = lambda: Q.read_deliveries(spark, source, schema)
    Q.import_stream(stream(), target, ["fact_id"], str(tmp_path / "ck")).awaitTermination()
    row("b", 9).union(row("c", 4)).write.mode("append").parquet(source)
    Q.import_stream(stream(), target, ["fact_id"], str(tmp_path / "ck")).awaitTermination()
    Q.import_stream(stream(), target, ["fact_id"], str(tmp_path / "ck2")).awaitTermination()
    out = spark.read.parquet(target).collect()
    assert sorted(r.fact_id for r in out) == ["a", "b", "c"]


def test_windowed_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.sql("SELECT 'a' AS fact_id, timestamp '2024-01-01 05:00:00' AS at UNION ALL SELECT 'a', timestamp '2024-01-01 06:00:00' UNION ALL SELECT 'b', timestamp '2024-01-02 06:00:00'").write.parquet(source)
    stream = Q.read_deliveries(spark, source, "fact_id string, at timestamp")
    query = Q.windowed_counts(stream, "at", "fact_id").writeStream.format("memory").queryName("w_").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.fact_id, r.n) for r in spark.table("w_").collect()} == {("a", 2), ("b", 1)}
    once = Q.first_deliveries(stream, "at", ["fact_id"]).writeStream.format("memory").queryName("o_").outputMode("append").trigger(availableNow=True).start()
    once.awaitTermination()
    assert spark.table("o_").count() == 2

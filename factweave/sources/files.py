"""Files: Markdown books, fact TSV in two dialects, historical tables, workbooks, manifests, audits, exports."""

from __future__ import annotations

import hashlib
import json
import re
import zipfile
from collections.abc import Iterator
from io import BytesIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions.values import escape_tsv, spreadsheet_safe, unescape_tsv
from factweave.sources.contract import COLUMNS, check_header, digest

#: Encodings tried on files of unknown origin, in this order.
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "utf-16")


def read_books(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """path, name, text of Markdown files; a byte order mark is dropped, bytes that are not UTF-8 are replaced, larger files left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(path)
    if max_bytes is not None:
        files = files.where(F.col("length") <= max_bytes)

    @F.pandas_udf("string")
    def decoded(content: pd.Series) -> pd.Series:
        return content.map(lambda b: b.decode("utf-8", "replace").removeprefix("﻿"))

    return files.select("path", F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("name"), decoded("content").alias("text"))


def lines_of(books: DataFrame) -> DataFrame:
    """path, line_no, line."""
    return books.select("path", F.posexplode(F.split("text", "\r?\n")).alias("at", "line")).select("path", (F.col("at") + 1).alias("line_no"), "line")


def write_facts(rows: DataFrame, path: str, quoted: bool = False) -> None:
    """Facts as tab-separated lines with a header. Cells are escaped to one physical line; the second dialect, which quotes cells and
    knows no escapes, is written with quoted."""
    check_header(rows.columns)
    cells = rows if quoted else rows.select(*[escape_tsv(F.col(f"`{c}`")).alias(c) for c in COLUMNS])
    options = {"sep": "\t", "header": "true", "emptyValue": "", "nullValue": ""} | ({"quote": '"', "escape": '"'} if quoted else {"quote": "", "escape": ""})
    cells.write.mode("overwrite").options(**options).csv(path)


def read_facts(spark: SparkSession, path: str, quoted: bool = False) -> DataFrame:
    """Facts of either dialect; the header must follow the contract."""
    options = {"sep": "\t", "header": "true", "nullValue": "\x00", "emptyValue": ""} | ({"quote": '"', "escape": '"', "multiLine": "true"} if quoted else {"quote": "", "escape": ""})
    found = spark.read.options(**options).csv(path)
    check_header(found.columns)
    rows = found.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in COLUMNS])
    return rows if quoted else rows.select(*[unescape_tsv(F.col(f"`{c}`")).alias(c) for c in COLUMNS])


def physical_check(spark: SparkSession, path: str) -> DataFrame:
    """n_lines, n_wrong: lines that do not have 58 tabs."""
    return spark.read.text(path).agg(F.count("*").alias("n_lines"), F.count_if(F.size(F.split("value", "\t")) != len(COLUMNS)).alias("n_wrong"))


def _table_of(content: bytes) -> list[tuple[int, str, str]]:
    """(row, column, cell) of a text table of unknown encoding and delimiter: the first encoding that decodes all of it, the delimiter
    that is more frequent in the first line."""
    text = ""
    for encoding in ENCODINGS:
        try:
            text = content.decode(encoding)
            break
        except UnicodeDecodeError:
            continue
    lines = text.splitlines()
    if not lines:
        return []
    import csv

    rows = list(csv.reader(lines, delimiter="\t" if lines[0].count("\t") >= lines[0].count(",") else ","))
    head = rows[0]
    return [(r, name, cell) for r, row in enumerate(rows[1:], 1) for name, cell in zip(head, row, strict=False)]


def _sheet_of(content: bytes) -> list[tuple[int, str, str]]:
    """(row, column, cell) of the first sheet of a workbook, shared and inline strings resolved."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in item.iter(f"{space}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{space}si")]
        sheet = ElementTree.fromstring(book.read("xl/worksheets/sheet1.xml"))
    rows: list[dict[str, str]] = []
    for row in sheet.iter(f"{space}row"):
        cells = {}
        for cell in row.iter(f"{space}c"):
            column = re.sub(r"\d", "", cell.get("r", ""))
            value = cell.find(f"{space}v")
            text = "".join(t.text or "" for t in cell.iter(f"{space}t")) if cell.get("t") == "inlineStr" else (value.text or "" if value is not None else "")
            cells[column] = shared[int(text)] if cell.get("t") == "s" and text else text
        rows.append(cells)
    return [(r, name, row[column]) for r, row in enumerate(rows[1:], 1) for column, name in rows[0].items() if column in row] if rows else []


def read_historical(spark: SparkSession, path: str) -> DataFrame:
    """path, row_no, column_name, cell of TSV, CSV and XLSX files of any of the known encodings, one file to a task."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(p, *x) for p, content in zip(frame["path"], frame["content"], strict=True) for x in (_sheet_of(content) if p.endswith(".xlsx") else _table_of(content))]
            yield pd.DataFrame(found, columns=["path", "row_no", "column_name", "cell"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{tsv,csv,xlsx}").load(path)
    return files.select("path", "content").mapInPandas(work, "path string, row_no int, column_name string, cell string")


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    """property_id, alias, canonical_name, attribute_category, priority; rows with a blank among the first four are dropped, a priority
    is read as a number and cut to an integer."""
    rows = spark.read.options(sep="\t", header="true", quote="").csv(path)
    missing = {"property_id", "alias", "canonical_name", "attribute_category"} - set(rows.columns)
    if missing:
        raise ValueError(f"ontology without {sorted(missing)}")
    priority = F.coalesce(F.col("priority").try_cast("double").cast("int"), F.lit(0)) if "priority" in rows.columns else F.lit(0)
    needed = [F.trim(c).alias(c) for c in ("property_id", "alias", "canonical_name", "attribute_category")]
    return rows.select(*needed, priority.alias("priority")).where("property_id <> '' and alias <> '' and canonical_name <> '' and attribute_category <> ''")


def write_manifest(path: str, **entries: object) -> dict:
    """A manifest beside an output, on whatever file system that lies: its entries with the digest of the contract."""
    manifest = {"schema": "schema59-v1", "header_sha256": digest(), **entries}
    location = _location(path)
    stream = location.getFileSystem(_active()._jsc.hadoopConfiguration()).create(location, True)
    stream.write(bytearray(json.dumps(manifest, ensure_ascii=False, sort_keys=True).encode()))
    stream.close()
    return manifest


def _active() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def _location(path: str):
    return _active()._jvm.org.apache.hadoop.fs.Path(path)


def read_manifest(path: str) -> dict:
    """A manifest, refused if a key occurs twice, the schema is another or the header digest is wrong."""

    def once(pairs: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("a key occurs twice")
        return dict(pairs)

    manifest = json.loads(_active().read.text(path, wholetext=True).first()[0], object_pairs_hook=once)
    if manifest.get("schema") != "schema59-v1" or manifest.get("header_sha256") != digest():
        raise ValueError("manifest of another schema")
    return manifest


def append_audit(rows: DataFrame, path: str) -> None:
    """Audit rows appended as JSON lines."""
    rows.write.mode("append").json(path)


def export_rows(rows: DataFrame, path: str, form: str = "csv") -> None:
    """Rows for spreadsheets or programs: csv and tsv with cells that are no formulas, json lines as they are."""
    if form == "json":
        rows.write.mode("overwrite").json(path)
        return
    safe = rows.select(*[spreadsheet_safe(F.col(f"`{c}`").cast("string")).alias(c) for c in rows.columns])
    safe.write.mode("overwrite").options(sep="," if form == "csv" else "\t", header="true", escape='"').csv(path)


def content_digest(rows: DataFrame) -> str:
    """A digest of the rows that does not depend on their order: row hashes are summed, nothing is sorted or collected."""
    packed = F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in rows.columns])
    total = rows.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.sha2(packed, 256), 1, 15), 16, 10).cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(f"{total.n}:{total.s}".encode()).hexdigest()


def release(rows: DataFrame, path: str, action_col: str = "action", stream_col: str = "stream") -> None:
    """Released, candidate and rejected rows of each stream in folders of their own."""
    rows.write.mode("overwrite").partitionBy(stream_col, action_col).parquet(path)


def jdbc_table(spark: SparkSession, url: str, name: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A relational table; partition is (column, lower bound, upper bound, number of parts) for parallel reads."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if partition:
        column, lower, upper, parts = partition
        reader = reader.options(partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts))
    return reader.load()

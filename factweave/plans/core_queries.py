"""Queries of the reference operators over the test tables, each beside its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.functions import text as T
from factweave.functions import values as V
from factweave.functions.blank import filled, is_blank
from factweave.operators import documents as D
from factweave.operators import extract as X
from factweave.operators import facts as K
from factweave.operators import relational as R
from factweave.operators import tables as G
from factweave.session import small_rows, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
FACTS = "graph_import_ready_generalized"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL if it has one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def facts(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The fact table with its long names in short: only the columns asked for reach the scan."""
    names = {
        "subject": "主体名称", "attribute": "attribute_name", "value_text": "尾实体/取值文本", "number": "数值", "lower": "范围下限", "upper": "范围上限",
        "unit": "单位", "condition": "条件文本", "source": "来源类型", "book": "文档ID", "locator": "来源定位", "table_id": "所属表格ID", "title": "所属表格标题",
        "path": "章节路径", "method": "方法名称", "evidence": "证据文本", "confidence": "置信度", "engine": "抽取来源", "category": "attribute_category",
    }
    return table(spark, d, FACTS).select(*[F.col(f"`{names.get(c, c)}`").alias(c) for c in columns])


SOURCE = "replace(lower(trim(\"来源类型\")), '-', '_')"
BLANK = "('', '-', '--', '—', '——', '/', '\\', 'n/a', 'na', 'null', 'none', 'nan', '无', '暂缺', '待补', '未知', '空', '?')"
LANGUAGE = """
    CASE WHEN cjk >= 2 AND latin >= 12 AND words >= 3 AND cjk / greatest(cjk + latin, 1) >= 0.04 AND latin / greatest(cjk + latin, 1) >= 0.12 THEN 'mixed'
         WHEN latin >= 12 AND words >= 3 AND latin / greatest(cjk + latin, 1) >= 0.72 THEN 'en' ELSE 'zh' END"""
VISIBLE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', ' \1 ', 'g'), 'https?://\S+', ' ', 'g'), '`[^`]*`', ' ', 'g')"""
COUNTED = """
    SELECT *, len(regexp_extract_all(v, '[㐀-鿿]'))::DOUBLE AS cjk, len(regexp_extract_all(v, '[A-Za-z]'))::DOUBLE AS latin, len(regexp_extract_all(v, '[A-Za-z]{2,}')) AS words"""
CLAUSES = r"""list_filter(list_transform(string_split_regex(coalesce(text, ''), '[。！？!?；;\n]+'), lambda c: trim(c, E' \t\r\n，,。；;：:')), lambda c: c <> '')"""


# --- texts -------------------------------------------------------------------------------------------------------------


@query(
    f"""
    WITH c AS (SELECT doc_id, unnest({CLAUSES}) AS clause FROM documents),
    l AS ({COUNTED} FROM (SELECT *, {VISIBLE.format("clause")} AS v FROM c)),
    r AS (SELECT {LANGUAGE} AS language, clause, len(clause) < 8 AS short, regexp_matches(clause, '[0-9]') AS has_number FROM l)
    SELECT language, CASE WHEN short THEN 'rejected' WHEN has_number THEN 'release' ELSE 'candidate' END AS action, count(*) AS n_clauses
    FROM r GROUP BY ALL
    """
)
def clause_release_profile(spark: SparkSession, d: str) -> DataFrame:
    rows = X.clause_rows(table(spark, d, "documents"))
    short, number = F.length("clause") < 8, F.col("clause").rlike("[0-9]")
    action = F.when(short, "rejected").when(number, "release").otherwise("candidate")
    return T.with_language(rows, "clause").groupBy("language", action.alias("action")).agg(F.count("*").alias("n_clauses"))


@query(f"WITH l AS ({COUNTED} FROM (SELECT doc_id, {VISIBLE.format('coalesce(text, chr(32))')} AS v FROM documents)) SELECT doc_id, {LANGUAGE} AS language FROM l")
def doc_language(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.language(F.col("text")).alias("language"))


@query(f"SELECT doc_id, generate_subscripts(l, 1) AS ord, unnest(l) AS clause FROM (SELECT doc_id, {CLAUSES} AS l FROM documents)")
def clause_split(spark: SparkSession, d: str) -> DataFrame:
    return X.clause_rows(table(spark, d, "documents"))


@query(
    """
    SELECT doc_id, w AS window_no, substring(text, (w - 1) * 4000 + 1, 4000) AS window_text
    FROM (SELECT doc_id, text, unnest(generate_series(1, (length(text) + 3999) // 4000)) AS w FROM documents WHERE length(text) > 0)
    """
)
def fixed_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(T.windows(F.col("text"), 4000)).alias("at", "window_text"))
    return rows.select("doc_id", (F.col("at") + 1).alias("window_no"), "window_text")


@query(
    r"""
    SELECT doc_id, generate_subscripts(a, 1) AS ord, unnest(a) AS label, unnest(b) AS value
    FROM (SELECT doc_id, regexp_extract_all(text, '(?m)^\s*([^\s：:|#<][^：:|\n]{0,29}?)\s*[：:]\s*([^\n|]+?)\s*$', 1) AS a,
                 regexp_extract_all(text, '(?m)^\s*([^\s：:|#<][^：:|\n]{0,29}?)\s*[：:]\s*([^\n|]+?)\s*$', 2) AS b FROM documents)
    """
)
def labelled_fields(spark: SparkSession, d: str) -> DataFrame:
    return X.labelled_fields(table(spark, d, "documents"))


def _clause_sql(columns: str, pattern: str) -> str:
    return f"""
    WITH c AS (SELECT doc_id, generate_subscripts(l, 1) AS ord, unnest(l) AS clause FROM (SELECT doc_id, {CLAUSES} AS l FROM documents))
    SELECT doc_id, ord, {columns} FROM c WHERE regexp_matches(clause, '{pattern}')"""


def _part(pattern: str, i: int) -> str:
    return f"trim(regexp_extract(clause, '{pattern}', {i}))"


@query(
    f"""
    SELECT doc_id, ord, unnest([a, b]) AS component, unnest([x, y]) AS part, unnest([round(x / (x + y), 6), round(y / (x + y), 6)]) AS share
    FROM ({_clause_sql(f"{_part(X.COMPOSED, 1)} AS a, {_part(X.COMPOSED, 2)} AS b, {_part(X.COMPOSED, 3)}::DOUBLE AS x, {_part(X.COMPOSED, 4)}::DOUBLE AS y", X.COMPOSED)})
    """
)
def compositions(spark: SparkSession, d: str) -> DataFrame:
    return X.compositions(table(spark, d, "documents"))


@query()
def relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations of clauses of any length. SQL without look-ahead cannot say where their subjects begin; they are tested on small cases."""
    return X.relations(table(spark, d, "documents"))


@query(
    f"""
    WITH c AS (SELECT doc_id, generate_subscripts(l, 1) AS ord, unnest(l) AS clause FROM (SELECT doc_id, {CLAUSES} AS l FROM documents)),
    a AS (SELECT doc_id, ord, regexp_extract_all(clause, '({"|".join(X.ACTIONS)})', 1) AS l FROM c)
    SELECT doc_id, ord AS process_ord, i AS step_index, l[i] AS action, CASE WHEN i > 1 THEN l[i - 1] END AS previous_action, l[i + 1] AS next_action
    FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM a WHERE len(l) >= 2)
    """
)
def process_steps(spark: SparkSession, d: str) -> DataFrame:
    return X.process_steps(table(spark, d, "documents"))


@query(
    """
    SELECT r.canonical AS subject, count(*) AS n_documents FROM documents d JOIN (SELECT DISTINCT canonical FROM subject_registry) r
    ON contains(d.text, r.canonical) GROUP BY r.canonical
    """
)
def subject_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Which documents name which subject: one automaton over the fixed registry instead of a join of every name with every text."""
    names = tuple(sorted({r.canonical for r in small_rows(table(spark, d, "subject_registry").select("canonical")) if r.canonical}))

    @F.pandas_udf("array<string>")
    def mentioned(texts: pd.Series) -> pd.Series:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name in names:
            automaton.add_word(name, name)
        automaton.make_automaton()
        return texts.map(lambda t: sorted({name for _, name in automaton.iter(t or "")}))

    rows = table(spark, d, "documents").select(F.explode(mentioned("text")).alias("subject"))
    return rows.groupBy("subject").agg(F.count("*").alias("n_documents"))


@query()
def document_headings(spark: SparkSession, d: str) -> DataFrame:
    return D.headings(table(spark, d, "documents"))


@query()
def text_blocks(spark: SparkSession, d: str) -> DataFrame:
    return D.text_blocks(table(spark, d, "documents"))


@query()
def document_tables(spark: SparkSession, d: str) -> DataFrame:
    return D.tables(table(spark, d, "documents"))


@query()
def table_cells(spark: SparkSession, d: str) -> DataFrame:
    return D.cells(table(spark, d, "documents"))


@query()
def table_roles(spark: SparkSession, d: str) -> DataFrame:
    return G.axis_roles(G.axis_features(D.cells(table(spark, d, "documents"))))


@query()
def table_topology(spark: SparkSession, d: str) -> DataFrame:
    return G.topology(G.axis_roles(G.axis_features(D.cells(table(spark, d, "documents")))))


@query()
def table_facts(spark: SparkSession, d: str) -> DataFrame:
    found = G.row_subject_facts(table(spark, d, "documents"))
    return found.select("doc_id", "table_no", "r", "c", "subject", "property", "unit", "value_text", F.col("value.value_num").alias("value_num"))


@query()
def owner_values(spark: SparkSession, d: str) -> DataFrame:
    return X.owner_bound_values(D.text_blocks(table(spark, d, "documents")), ["doc_id", "first_line"])


@query()
def packed_windows(spark: SparkSession, d: str) -> DataFrame:
    return D.packed_windows(table(spark, d, "documents"))


@query()
def abbreviations(spark: SparkSession, d: str) -> DataFrame:
    return X.abbreviations(table(spark, d, "documents"))


@query(
    """
    SELECT d.doc_id, coalesce(nullif(trim(d.lang), ''), '(blank)') AS given, b.lang AS book_lang FROM documents d JOIN source_books b ON d.book_id = b.book_id
    WHERE coalesce(lower(split_part(trim(d.lang), '-', 1)), '') <> b.lang
    """
)
def language_mismatch(spark: SparkSession, d: str) -> DataFrame:
    books = table(spark, d, "source_books").select("book_id", F.col("lang").alias("book_lang"))
    given = F.coalesce(F.nullif(F.trim("lang"), F.lit("")), F.lit("(blank)"))
    code = F.coalesce(F.lower(F.split_part(F.trim("lang"), F.lit("-"), F.lit(1))), F.lit(""))
    return table(spark, d, "documents").join(books, "book_id").where(code != F.col("book_lang")).select("doc_id", given.alias("given"), "book_lang")


# --- scalars -----------------------------------------------------------------------------------------------------------

PARSED = [
    ("1.80", "g/cm3", 1.8, None, None, None, "g/cm3", 0.88),
    ("10~20 ℃", None, None, 10.0, 20.0, None, "℃", 0.95),
    ("5±0.2 MPa", None, 5.0, 4.8, 5.2, None, "MPa", 0.95),
    ("≥98%", None, 98.0, None, None, ">=", "%", 0.88),
    ("1:2", None, None, 1.0, 2.0, None, None, 0.90),
    ("1. 32", None, 1.32, None, None, None, None, 0.88),
    ("6,86 kPa", None, 6.86, None, None, None, "kPa", 0.88),
    ("白色晶体", None, None, None, None, None, None, 0.25),
    ("", None, None, None, None, None, None, 0.0),
]


def _literal(x) -> str:
    return "NULL" if x is None else f"{x!r}"


_NUM = r"[-+]?[0-9]+(?:[.,][0-9]+)?(?:[eE][-+]?[0-9]+)?"
_AS_NUMBER = "try_cast(replace({}, ',', '') AS DOUBLE)"
# a torn decimal and a decimal comma, without look-around: the digits around them are put back
_NORMAL = r"""regexp_replace(regexp_replace(regexp_replace({}, '([0-9]),([0-9]{{1,2}})(\D|$)', '\1.\2\3', 'g'), '([0-9])[\s]*[.．][\s]+([0-9])', '\1.\2', 'g'), '[\s\x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}]+', ' ', 'g')"""
for _a, _b, _n, _signed in reversed(V.QUOTIENTS):
    _NORMAL = _NORMAL.replace("{}", f"regexp_replace({{}}, '(?i){_a}\\\\s*[·*]{'' if _signed else '?'}\\\\s*{_b}\\\\s*\\\\^?\\\\s*-\\\\s*{_n}\\\\b', '{_a}/{_b}{_n if _n > 1 else ''}', 'g')")


def parsed_sql(column: str, rows: str, kept: str) -> str:
    """SQL of the number parser over a column of rows: kept columns, value_num, lower_bound, upper_bound, comparator, is_ratio, parse_confidence."""
    joined = {"ratio": f"({_NUM})\\s*[:：/]\\s*({_NUM})", "plus": f"({_NUM})\\s*±\\s*({_NUM})", "span": f"({_NUM})\\s*{V.RANGE_SIGN}\\s*({_NUM})"}
    pick = lambda kind, i: _AS_NUMBER.format(f"regexp_extract(body, '{joined[kind]}', {i})")
    has = {k: f"regexp_matches(body, '{p}')" for k, p in joined.items()}
    has["ratio"] += " AND NOT regexp_matches(body, '(?:https?|[A-Za-z]):/')"
    signs = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.COMPARATOR_SIGN.items())
    return f"""
    SELECT {kept}, CASE WHEN ratio THEN NULL WHEN plus THEN {pick('plus', 1)} WHEN span THEN NULL ELSE {_AS_NUMBER.format(f"regexp_extract(body, '{_NUM}')")} END AS value_num,
      round(CASE WHEN ratio THEN {pick('ratio', 1)} WHEN plus THEN {pick('plus', 1)} - {pick('plus', 2)} WHEN span THEN {pick('span', 1)} END, 9) AS lower_bound,
      round(CASE WHEN ratio THEN {pick('ratio', 2)} WHEN plus THEN {pick('plus', 1)} + {pick('plus', 2)} WHEN span THEN {pick('span', 2)} END, 9) AS upper_bound,
      nullif(CASE sign {signs} ELSE sign END, '') AS comparator, ratio AS is_ratio,
      CASE WHEN t = '' THEN 0.0::DOUBLE WHEN ratio THEN 0.90::DOUBLE WHEN plus OR span THEN 0.95::DOUBLE WHEN regexp_matches(body, '{_NUM}') THEN 0.88::DOUBLE ELSE 0.25::DOUBLE END AS parse_confidence
    FROM (SELECT *, {has['ratio']} AS ratio, {has['plus']} AS plus, {has['span']} AS span
          FROM (SELECT *, regexp_extract(t, '^\\s*({V.COMPARATORS})', 1) AS sign, regexp_replace(t, '^\\s*(?:{V.COMPARATORS})\\s*', '') AS body
                FROM (SELECT *, {_NORMAL.format(f"translate(trim(coalesce({column}, '')), '−⁻•×—', '--·*–')")} AS t FROM {rows})))"""


@query(parsed_sql('"尾实体/取值文本"', FACTS, "row_id"))
def parse_value(spark: SparkSession, d: str) -> DataFrame:
    """Numbers, ranges, ratios and comparators of every value."""
    rows = facts(spark, d, "row_id", "value_text").select("row_id", V.parse_value(F.col("value_text")).alias("v"))
    return rows.select("row_id", "v.value_num", F.round("v.lower_bound", 9).alias("lower_bound"), F.round("v.upper_bound", 9).alias("upper_bound"), "v.comparator", "v.is_ratio", "v.parse_confidence")


@query(
    parsed_sql(
        "value_text",
        "(" + _clause_sql(f"regexp_replace({_part(X.BOUND, 1)}, '^.*[，,]', '') AS owner, {_part(X.BOUND, 2)} AS property, {_part(X.BOUND, 3)} AS value_text", X.BOUND) + ")",
        "doc_id, ord, owner, property, value_text",
    )
)
def bound_values(spark: SparkSession, d: str) -> DataFrame:
    found = X.bound_values(table(spark, d, "documents"))
    bounds = [F.round(f"value.{c}", 9).alias(c) for c in ("lower_bound", "upper_bound")]
    return found.select("doc_id", "ord", "owner", "property", "value_text", "value.value_num", *bounds, "value.comparator", "value.is_ratio", "value.parse_confidence")


@query(
    """
    SELECT row_id, CASE WHEN isfinite(n) THEN n END AS value_num FROM (
      SELECT row_id, try_cast(replace(translate("数值", '−', '-'), ',', '') AS DOUBLE) AS n FROM graph_import_ready_generalized)
    """
)
def numeric_projection(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d, "row_id", "number").select("row_id", V.to_double(F.col("number")).alias("value_num"))


@query(
    "WITH u AS (SELECT lower(regexp_replace(coalesce(\"单位\", ''), '[ \\t\\n\\r\\f\\v]+', '', 'g')) AS u FROM graph_import_ready_generalized) SELECT dimension, count(*) AS n FROM (SELECT CASE WHEN u = '' THEN '' "
    + " ".join("WHEN " + " OR ".join(f"contains(u, '{t}')" for t in tokens) + f" THEN '{name}'" for name, tokens in V.DIMENSION_TOKENS)
    + " ELSE '' END AS dimension FROM u) GROUP BY dimension"
)
def unit_dimension(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d, "unit").groupBy(V.unit_dimension(F.col("unit")).alias("dimension")).agg(F.count("*").alias("n"))


@query(
    """
    SELECT row_id, sha256(lower(trim(regexp_replace(coalesce("证据文本", ''), '[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')))) AS evidence_hash
    FROM graph_import_ready_generalized
    """
)
def evidence_hash(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d, "row_id", "evidence").select("row_id", V.evidence_hash(F.col("evidence")).alias("evidence_hash"))


@query(
    """
    SELECT row_id, coalesce(nullif(substring(regexp_replace(regexp_replace(lower(coalesce(attribute_name, '')), '[^0-9a-z一-鿿]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80), ''), 'unknown') AS slug
    FROM graph_import_ready_generalized
    """
)
def attribute_slug(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d, "row_id", "attribute").select("row_id", V.slug(F.col("attribute")).alias("slug"))


@query("SELECT row_id, coalesce(\"尾实体/取值文本\", '') AS restored FROM graph_import_ready_generalized")
def tsv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Escaping a cell to one physical line and back gives the cell."""
    return facts(spark, d, "row_id", "value_text").select("row_id", V.unescape_tsv(V.escape_tsv(F.col("value_text"))).alias("restored"))


@query("SELECT row_id, CASE WHEN regexp_matches(ltrim(\"尾实体/取值文本\"), '^[=+\\-@]') THEN '''' || \"尾实体/取值文本\" ELSE \"尾实体/取值文本\" END AS cell FROM graph_import_ready_generalized")
def spreadsheet_cells(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d, "row_id", "value_text").select("row_id", V.spreadsheet_safe(F.col("value_text")).alias("cell"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


# --- duplicates, conflicts, merges --------------------------------------------------------------------------------------

_VALUE_SQL = """CASE WHEN coalesce("数值", '') <> '' THEN 'num:' || "数值" ELSE 'text:' || coalesce("尾实体/取值文本", '') END"""


@query(
    """
    SELECT fact_id, row_id, ingested_at, n_dropped FROM (
      SELECT fact_id, row_id, ingested_at, count(*) OVER (PARTITION BY fact_id) - 1 AS n_dropped,
             row_number() OVER (PARTITION BY fact_id ORDER BY ingested_at, row_id) AS place
      FROM graph_import_ready_generalized) WHERE place = 1
    """
)
def redelivered_facts(spark: SparkSession, d: str) -> DataFrame:
    """The first delivery of every fact."""
    rows = facts(spark, d, "fact_id", "row_id", "ingested_at")
    return K.keep_best(rows, ["fact_id"], [F.coalesce("ingested_at", F.lit("9999-12-31").cast("timestamp")), F.col("row_id")])


@query(
    """
    SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_extendedprice, n_dropped FROM (
      SELECT *, count(*) OVER (PARTITION BY l_partkey, l_suppkey) - 1 AS n_dropped,
             row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS place FROM lineitem) WHERE place = 1
    """
)
def argmax_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return K.keep_best(rows, ["l_partkey", "l_suppkey"], [-F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")])


@query(
    f"""
    SELECT "主体名称" AS subject, attribute_name AS attribute, count(DISTINCT v) AS n_values, count(*) AS n_rows
    FROM (SELECT *, {_VALUE_SQL} AS v FROM graph_import_ready_generalized) GROUP BY ALL HAVING count(DISTINCT v) > 1
    """
)
def semantic_conflicts(spark: SparkSession, d: str) -> DataFrame:
    rows = facts(spark, d, "subject", "attribute", "number", "value_text")
    value = F.when(F.coalesce("number", F.lit("")) != "", F.concat(F.lit("num:"), "number")).otherwise(F.concat(F.lit("text:"), F.coalesce("value_text", F.lit(""))))
    return K.conflicts(rows, ["subject", "attribute"], value)


@query(
    """
    SELECT row_id, count(*) OVER (PARTITION BY "主体名称", attribute_name) AS corroboration FROM graph_import_ready_generalized
    WHERE "主体名称" IS NOT NULL AND attribute_name IS NOT NULL
    """
)
def corroboration(spark: SparkSession, d: str) -> DataFrame:
    rows = facts(spark, d, "row_id", "subject", "attribute").where("subject is not null and attribute is not null")
    return K.corroborated(rows, ["subject", "attribute"]).select("row_id", "corroboration")


@query(
    f"""
    SELECT s AS subject, a AS attribute, u AS unit, string_agg(DISTINCT r, '+' ORDER BY r) AS routes, min(e) AS evidence, min(nullif(trim(p), '')) AS path, count(*) AS n_rows
    FROM (SELECT lower(trim("主体名称", ' ')) AS s, lower(trim(attribute_name, ' ')) AS a, lower(trim("单位", ' ')) AS u, {SOURCE} AS r, "证据文本" AS e, "章节路径" AS p FROM graph_import_ready_generalized)
    WHERE r IS NOT NULL GROUP BY s, a, u
    """
)
def route_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = facts(spark, d, "subject", "attribute", "unit", "source", "evidence", "path")
    rows = rows.withColumns({c: F.lower(F.trim(c)) for c in ("subject", "attribute", "unit")}).withColumn("source", F.replace(F.lower(F.trim("source")), F.lit("-"), F.lit("_")))
    return K.merged_routes(rows.where("source is not null"), ["subject", "attribute", "unit"], "source", "evidence", ["path"])


@query(
    """
    WITH f AS (SELECT fact_id, row_id, ingested_at, ingested_at >= TIMESTAMP '2025-01-01' AS late FROM graph_import_ready_generalized WHERE ingested_at IS NOT NULL)
    SELECT fact_id, min(row_id) AS row_id FROM f WHERE late AND fact_id NOT IN (SELECT fact_id FROM f WHERE NOT late AND fact_id IS NOT NULL) GROUP BY fact_id
    """
)
def idempotent_import(spark: SparkSession, d: str) -> DataFrame:
    """A batch inserted with conflict-do-nothing into what came before."""
    rows = facts(spark, d, "fact_id", "row_id", "ingested_at").where("ingested_at is not null")
    late = F.col("ingested_at") >= F.lit("2025-01-01").cast("timestamp")
    return K.new_rows(rows.where(late).select("fact_id", "row_id"), rows.where(~late), ["fact_id"], [F.col("row_id")])


@query(
    """
    SELECT l_orderkey, l_linenumber, CASE WHEN p = l_linenumber - 1 THEN p END AS previous_step, CASE WHEN n = l_linenumber + 1 THEN n END AS next_step
    FROM (SELECT l_orderkey, l_linenumber, lag(l_linenumber) OVER w AS p, lead(l_linenumber) OVER w AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber))
    """
)
def step_relink(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").withColumn("step", F.col("l_linenumber"))
    return K.relink(rows, "l_orderkey", "l_linenumber", "step").drop("step")


@query(
    """
    SELECT process_id, count(*) AS n_steps, count(*) >= 2 AND min(i) = 1 AND max(i) = count(*) AND count(DISTINCT i) = count(*) AND count(DISTINCT row_id) = count(*) AS valid
    FROM (SELECT process_id, try_cast(step_index AS INT) AS i, row_id FROM graph_import_ready_generalized WHERE process_id <> '') GROUP BY process_id
    """
)
def chain_validity(spark: SparkSession, d: str) -> DataFrame:
    rows = facts(spark, d, "process_id", "step_index", "row_id").where("process_id <> ''").withColumn("i", F.col("step_index").try_cast("int"))
    return K.chain_valid(rows, "process_id", "i", "row_id")


# --- scoring and routing ------------------------------------------------------------------------------------------------

PENALTIES = {"blank_evidence": 0.08, "blank_locator": 0.05, "blank_unit": 0.04, "subject_not_in_registry": 0.07}
_REASON_SQL = f"""
    SELECT f.row_id, {SOURCE} AS source, coalesce(try_cast("置信度" AS DOUBLE), 0.5) AS base,
      list_sort(list_filter([
        CASE WHEN coalesce(lower(trim("证据文本")), '') IN {BLANK} THEN 'blank_evidence' END,
        CASE WHEN coalesce(lower(trim("来源定位")), '') IN {BLANK} THEN 'blank_locator' END,
        CASE WHEN coalesce(lower(trim("单位")), '') IN {BLANK} AND "数值类型" = '标量' THEN 'blank_unit' END,
        CASE WHEN r.canonical IS NULL THEN 'subject_not_in_registry' END], lambda x: x IS NOT NULL)) AS reasons
    FROM graph_import_ready_generalized f LEFT JOIN (SELECT DISTINCT canonical FROM subject_registry) r ON f."主体名称" = r.canonical"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    rows = facts(spark, d, "row_id", "subject", "source", "confidence", "evidence", "locator", "unit", "数值类型")
    known = table(spark, d, "subject_registry").select(F.col("canonical").alias("subject"), F.lit(True).alias("known")).distinct()
    found = K.reasons({
        "blank_evidence": is_blank(F.col("evidence")),
        "blank_locator": is_blank(F.col("locator")),
        "blank_unit": is_blank(F.col("unit")) & (F.col("数值类型") == "标量"),
        "subject_not_in_registry": F.col("known").isNull(),
    })
    base = F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.5))
    return rows.join(known, "subject", "left").select("row_id", F.replace(F.lower(F.trim("source")), F.lit("-"), F.lit("_")).alias("source"), base.alias("base"), found.alias("reasons"))


@query(
    f"""
    WITH j AS ({_REASON_SQL}),
    s AS (SELECT *, greatest(0.0, least(1.0, base - coalesce(list_sum(list_transform(reasons, lambda r: CASE r {" ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in PENALTIES.items())} ELSE 0.03::DOUBLE END)), 0.0))) AS score,
                 CASE WHEN source = 'table_conditional_record' THEN 0.52 WHEN source LIKE 'text_generalized%' THEN 0.62 WHEN source LIKE 'text_%' THEN 0.58 ELSE 0.60 END AS threshold FROM j)
    SELECT CASE WHEN len(reasons) >= 4 THEN 'reject' WHEN score >= threshold THEN 'release' WHEN score >= 0.38 THEN 'candidate' ELSE 'reject' END AS action, count(*) AS n_facts, round(avg(score), 6) AS mean_score
    FROM s GROUP BY action
    """
)
def release_gate(spark: SparkSession, d: str) -> DataFrame:
    judged = _judged(spark, d)
    score = K.penalized(F.col("base"), F.col("reasons"), PENALTIES, 0.03)
    threshold = K.source_threshold(F.coalesce("source", F.lit("")), {"table_conditional_record": 0.52}, {"text_": 0.58, "text_generalized": 0.62}, 0.60)
    scored = judged.withColumns({"score": score, "threshold": threshold})
    action = K.route(F.col("score"), F.col("threshold"), F.lit(0.38), F.size("reasons") >= 4)
    return scored.groupBy(action.alias("action")).agg(F.count("*").alias("n_facts"), F.round(F.avg("score"), 6).alias("mean_score"))


@query(f"WITH j AS ({_REASON_SQL}) SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM j) GROUP BY reason ORDER BY n DESC, reason LIMIT 20")
def top_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The report of the twenty most frequent reasons."""
    counted = _judged(spark, d).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "reason").limit(20)


@query(
    f"""
    WITH g AS (SELECT "主体名称" AS subject, count(*) AS n_evidence, count(DISTINCT "所属表格ID") AS n_tables, count(DISTINCT {SOURCE}) AS n_sources, avg(try_cast("置信度" AS DOUBLE)) AS m
               FROM graph_import_ready_generalized GROUP BY 1),
    s AS (SELECT subject, n_evidence, n_tables, n_sources, round(least(0.99, coalesce(m, 0.0) * 0.7 + least(0.22, log2(n_evidence + 1) * 0.05) + CASE WHEN n_sources > 1 THEN 0.05 ELSE 0.0 END), 6) AS score FROM g)
    SELECT *, CASE WHEN score >= 0.70 THEN 'confirmed' WHEN score >= 0.42 THEN 'candidate' ELSE 'rejected' END AS status FROM s
    """
)
def subject_evidence(spark: SparkSession, d: str) -> DataFrame:
    rows = facts(spark, d, "subject", "table_id", "source", "confidence").withColumn("source", F.replace(F.lower(F.trim("source")), F.lit("-"), F.lit("_")))
    return K.subject_scores(rows, "subject", "table_id", "source", F.col("confidence").try_cast("double"))


@query(
    """
    WITH p AS (SELECT "主体名称" AS subject, attribute_category AS kind, count(*) * 1000 + length(attribute_category) AS priority FROM graph_import_ready_generalized
               WHERE attribute_category <> '' AND "主体名称" IS NOT NULL GROUP BY 1, 2),
    m AS (SELECT *, max(priority) OVER (PARTITION BY subject) AS top FROM p)
    SELECT subject, min(kind) AS kind FROM m WHERE priority = top GROUP BY subject HAVING count(*) = 1
    """
)
def type_vote(spark: SparkSession, d: str) -> DataFrame:
    """The category most facts of a subject have; subjects with a tie are left undecided."""
    counted = facts(spark, d, "subject", "category").where("category <> '' and subject is not null").groupBy("subject", "category").agg((F.count("*") * 1000 + F.length("category")).alias("priority"))
    best = counted.groupBy("subject").agg(F.max_by("category", "priority").alias("kind"), F.max("priority").alias("top"))
    ties = counted.join(best, "subject").where("priority = top").groupBy("subject").agg(F.count("*").alias("n")).where("n = 1")
    return best.join(ties, "subject", "left_semi").select("subject", "kind")


@query(
    """
    WITH m AS (SELECT coalesce(nullif(trim("抽取来源"), ''), '(blank)') AS engine, coalesce(nullif(trim(attribute_category), ''), '(blank)') AS category,
                      "数值类型" = '标量' AS scalar, coalesce("单位", '') <> '' AS with_unit FROM graph_import_ready_generalized)
    SELECT CASE WHEN engine IS NOT NULL THEN 'engine' WHEN category IS NOT NULL THEN 'category' ELSE 'all' END AS "grouping", coalesce(engine, category, 'all') AS value,
           count(*) AS eligible, round(count(*) FILTER (WHERE scalar) / count(*), 6) AS scalar, round(count(*) FILTER (WHERE with_unit) / count(*), 6) AS with_unit
    FROM m GROUP BY GROUPING SETS ((), (engine), (category))
    """
)
def gold_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = facts(spark, d, "engine", "category", "unit", "数值类型")
    return R.gold_metrics(rows, {"scalar": F.col("数值类型") == "标量", "with_unit": F.coalesce("unit", F.lit("")) != ""}, ["engine", "category"])


# --- relational platform queries ----------------------------------------------------------------------------------------


@query("SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS p FROM orders) WHERE p = 1")
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return K.latest(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query(
    """
    WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS p FROM orders) WHERE p = 1)
    SELECT c_custkey, c_name, coalesce(o_totalprice, c_acctbal) AS amount, CASE WHEN o_orderkey IS NULL THEN 'raw' ELSE 'version' END AS origin
    FROM customer LEFT JOIN l ON c_custkey = o_custkey ORDER BY amount DESC, c_custkey LIMIT 50 OFFSET 10
    """
)
def effective_overlay(spark: SparkSession, d: str) -> DataFrame:
    """A page of base rows with the latest version laid over them."""
    version = K.latest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    rows = table(spark, d, "customer").join(version, F.col("c_custkey") == F.col("o_custkey"), "left")
    amount = F.coalesce("o_totalprice", "c_acctbal").alias("amount")
    origin = F.when(F.col("o_orderkey").isNull(), "raw").otherwise("version").alias("origin")
    return rows.select("c_custkey", "c_name", amount, origin).orderBy(F.desc("amount"), "c_custkey").offset(10).limit(50)


@query(
    """
    SELECT o_orderkey, o_totalprice AS amount, 'raw' AS origin FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)
    UNION ALL SELECT l_orderkey, max(l_extendedprice), 'version' FROM lineitem GROUP BY l_orderkey
    """
)
def export_snapshot(spark: SparkSession, d: str) -> DataFrame:
    versions = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("amount"))
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("amount"))
    return R.snapshot(rows, versions, "o_orderkey", ["amount"])


@query(
    """
    SELECT event_id, user_id, ts, found_id, found_ts FROM (
      SELECT e.event_id, e.user_id, e.ts, (SELECT max(s.ts) FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'signup' AND s.ts <= e.ts) AS found_ts FROM events e WHERE e.event_type = 'purchase') p
    LEFT JOIN (SELECT user_id AS u, ts AS t, max(event_id) AS found_id FROM events WHERE event_type = 'signup' GROUP BY 1, 2) s ON s.u = p.user_id AND s.t = p.found_ts
    """
)
def asof_event(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'signup'").groupBy("user_id", F.col("ts").alias("found_ts")).agg(F.max("event_id").alias("found_id"))
    return R.asof(left, right, ["user_id"], "ts", "found_ts", ["found_id", "found_ts"])


@query(
    """
    WITH o AS (SELECT o_custkey AS k, o_orderkey AS id, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS a FROM orders)
    SELECT x.id AS left_id, y.id AS right_id FROM o x JOIN o y ON x.k = y.k AND x.id < y.id AND x.a <= y.a + 30 AND y.a <= x.a + 30
    """
)
def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_diff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date"))
    spans = lambda p: table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias(f"{p}_id"), day.alias(f"{p}_a"), (day + 30).alias(f"{p}_b"))
    pairs = R.overlaps(spans("left"), spans("right"), ["k"], ("left_a", "left_b"), ("right_a", "right_b"), 31)
    return pairs.where("left_id < right_id").select("left_id", "right_id")


@query(
    r"""
    WITH t AS (SELECT "文档ID" AS book, "所属表格ID" AS table_id, try_cast(regexp_extract("来源定位", '^L(\d+)-L(\d+)', 1) AS BIGINT) AS a, try_cast(regexp_extract("来源定位", '^L(\d+)-L(\d+)', 2) AS BIGINT) AS b
               FROM graph_import_ready_generalized WHERE "所属表格ID" <> '')
    SELECT book, table_id, min(a) AS first_line, max(b) AS last_line, count(*) AS n_facts FROM t GROUP BY book, table_id
    """
)
def table_provenance(spark: SparkSession, d: str) -> DataFrame:
    line = lambda i: F.regexp_extract("locator", r"^L(\d+)-L(\d+)", i).try_cast("bigint")
    rows = facts(spark, d, "book", "table_id", "locator").where("table_id <> ''").withColumns({"a": line(1), "b": line(2)})
    return rows.groupBy("book", "table_id").agg(F.min("a").alias("first_line"), F.max("b").alias("last_line"), F.count("*").alias("n_facts"))


@query(
    f"""
    SELECT source, n_facts, mean_confidence, round_even((n_facts * 100)::DOUBLE / total::DOUBLE, 1) AS share FROM (
      SELECT coalesce(nullif({SOURCE}, ''), '(blank)') AS source, count(*) AS n_facts, round(avg(try_cast("置信度" AS DOUBLE)), 6) AS mean_confidence, sum(count(*)) OVER () AS total
      FROM graph_import_ready_generalized GROUP BY 1)
    """
)
def dashboard(spark: SparkSession, d: str) -> DataFrame:
    source = F.coalesce(F.nullif(F.replace(F.lower(F.trim("source")), F.lit("-"), F.lit("_")), F.lit("")), F.lit("(blank)"))
    counted = facts(spark, d, "source", "confidence").groupBy(source.alias("source")).agg(F.count("*").alias("n_facts"), F.round(F.avg(F.col("confidence").try_cast("double")), 6).alias("mean_confidence"))
    shared = spark.sql("SELECT *, (SELECT sum(n_facts) FROM {c}) AS total FROM {c}", c=counted)
    return shared.select("source", "n_facts", "mean_confidence", R.percent(F.col("n_facts"), F.col("total")).alias("share"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, count(DISTINCT user_id) AS n_users FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2025-01-01' GROUP BY event_type")
def usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").where((F.col("ts") >= F.lit("2024-01-01").cast("timestamp")) & (F.col("ts") < F.lit("2025-01-01").cast("timestamp")))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.count_distinct("user_id").alias("n_users"))


@query(
    """
    SELECT r_name, n_name, count(*) AS n_orders, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_done
    FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY ALL
    """
)
def review_summary(spark: SparkSession, d: str) -> DataFrame:
    orders, customer, nation, region = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    # the large table is reduced before the dimensions are joined to it
    counted = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("o"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    joined = counted.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.sum("n").alias("n_orders"), F.sum("o").alias("n_open"), F.sum("f").alias("n_done"))


@query("SELECT l_orderkey, CASE WHEN bool_and(l_linestatus = 'F') THEN 'completed' WHEN bool_or(l_linestatus = 'P') THEN 'partial' WHEN bool_and(l_linestatus = 'O') THEN 'open' ELSE 'running' END AS status FROM lineitem GROUP BY l_orderkey")
def status_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(R.status_of(F.col("l_linestatus")).alias("status"))


@query(
    """
    SELECT doc_id, stratum, turn FROM (SELECT doc_id, coalesce(lower(trim(source)), '(blank)') AS stratum, row_number() OVER (PARTITION BY coalesce(lower(trim(source)), '(blank)') ORDER BY n_chars DESC, doc_id) AS turn FROM documents)
    ORDER BY turn, stratum LIMIT 200
    """
)
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """The sampling operator: strata in turn, longest documents first."""
    rows = table(spark, d, "documents").select("doc_id", "n_chars", F.coalesce(F.lower(F.trim("source")), F.lit("(blank)")).alias("stratum"))
    return R.round_robin(rows, "stratum", [F.desc("n_chars"), F.col("doc_id")], 200).select("doc_id", "stratum", "turn")


@query(
    """
    SELECT date_trunc('month', extracted_at) AS month, count(*) AS n_facts, count(*) FILTER (WHERE ingested_at - extracted_at > INTERVAL 14 DAY) AS n_late
    FROM graph_import_ready_generalized WHERE extracted_at IS NOT NULL AND ingested_at IS NOT NULL GROUP BY 1
    """
)
def late_arrivals(spark: SparkSession, d: str) -> DataFrame:
    rows = facts(spark, d, "extracted_at", "ingested_at").where("extracted_at is not null and ingested_at is not null")
    late = F.unix_micros(F.col("ingested_at").cast("timestamp")) - F.unix_micros(F.col("extracted_at").cast("timestamp")) > 14 * 86_400_000_000
    return rows.groupBy(F.date_trunc("month", "extracted_at").cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("n_facts"), F.count_if(late).alias("n_late"))


_PROFILED = ("graph_fact_key", "章节路径", "来源定位", "来源类型", "所属表格标题", "主体名称", "predicate_raw", "attribute_name", "尾实体/取值文本", "数值", "单位", "条件文本", "方法名称", "置信度", "证据文本")


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) FILTER (WHERE coalesce(lower(trim("{c}")), '') NOT IN {BLANK}) AS n_filled, count(*) FILTER (WHERE "{c}" IS NULL) AS n_null FROM graph_import_ready_generalized"""
        for c in _PROFILED
    )
)
def column_fill(spark: SparkSession, d: str) -> DataFrame:
    """How far the columns are really filled; one pass over the table for all of them."""
    rows = table(spark, d, FACTS)
    counts = rows.agg(*[F.struct(F.count(filled(F.col(f"`{c}`"))).alias("n_filled"), F.count_if(F.col(f"`{c}`").isNull()).alias("n_null")).alias(f"c{i}") for i, c in enumerate(_PROFILED)])
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}.n_filled").alias("n_filled"), F.col(f"c{i}.n_null").alias("n_null")) for i, c in enumerate(_PROFILED)])
    return counts.select(F.explode(entries).alias("e")).select("e.*")


@query("SELECT row_id, fact_id, n FROM (SELECT row_id, fact_id, count(*) OVER (PARTITION BY fact_id) AS n FROM graph_import_ready_generalized) WHERE n > 1")
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = facts(spark, d, "row_id", "fact_id")
    repeated = rows.groupBy("fact_id").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(repeated, "fact_id").select("row_id", "fact_id", "n")


@query("SELECT book_id, title, edition, row_number() OVER (PARTITION BY source ORDER BY published_at, book_id) AS version FROM source_books")
def version_numbers(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("source").orderBy("published_at", "book_id")
    return table(spark, d, "source_books").select("book_id", "title", "edition", F.row_number().over(order).alias("version"))


@query(
    """
    SELECT s.book_id, s.source, coalesce(n, 0) AS n_facts, coalesce(m, 0) AS n_documents FROM source_books s
    LEFT JOIN (SELECT "文档ID" AS b, count(*) AS n FROM graph_import_ready_generalized GROUP BY 1) f ON f.b = s.book_id
    LEFT JOIN (SELECT book_id AS b, count(*) AS m FROM documents GROUP BY 1) d ON d.b = s.book_id
    """
)
def book_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Facts and documents per book; both sides are counted before they are joined, so a book with a tenth of all rows is one row."""
    n = facts(spark, d, "book").groupBy(F.col("book").alias("book_id")).agg(F.count("*").alias("n"))
    m = table(spark, d, "documents").groupBy("book_id").agg(F.count("*").alias("m"))
    joined = table(spark, d, "source_books").join(n, "book_id", "left").join(m, "book_id", "left")
    return joined.select("book_id", "source", F.coalesce("n", F.lit(0)).alias("n_facts"), F.coalesce("m", F.lit(0)).alias("n_documents"))


@query(
    """
    SELECT fact_id, bool_or(t) AS in_tables, bool_or(NOT t) AS in_text FROM (SELECT fact_id, "所属表格ID" <> '' AS t FROM graph_import_ready_generalized WHERE fact_id IS NOT NULL) GROUP BY fact_id
    """
)
def strict_membership(spark: SparkSession, d: str) -> DataFrame:
    rows = facts(spark, d, "fact_id", "table_id").where("fact_id is not null").withColumn("t", F.col("table_id") != "")
    return rows.groupBy("fact_id").agg(F.bool_or("t").alias("in_tables"), F.bool_or(~F.col("t")).alias("in_text"))

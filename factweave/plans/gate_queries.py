"""Queries of the gates over the whole fact table and all documents, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.functions import text as T
from factweave.functions.values import QUOTIENTS
from factweave.operators import documents as D
from factweave.operators import facts as K
from factweave.operators import gates as Q
from factweave.operators import table_compiler as C
from factweave.plans.core_queries import COUNTED, FACTS, LANGUAGE, VISIBLE, facts, query
from factweave.plans.problem_queries import reference_names
from factweave.session import table

WHITE = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(sql: str) -> str:
    return f"regexp_replace(coalesce({sql}, ''), '^{WHITE}+|{WHITE}+$', '', 'g')"


def _squeeze(sql: str) -> str:
    return f"regexp_replace(coalesce({sql}, ''), '{WHITE}+', '', 'g')"


def _has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{pattern}')"


def _in(column: str, values: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


_PROPERTY = _strip("CASE WHEN coalesce(attribute_name, '') <> '' THEN attribute_name ELSE predicate_raw END")
_FIELDS = f"""
    SELECT row_id, {_strip('"主体名称"')} AS s, {_squeeze('"主体名称"')} AS cs, {_PROPERTY} AS p, {_strip('"尾实体/取值文本"')} AS v, {_squeeze('"尾实体/取值文本"')} AS cv,
           {_strip("replace(coalesce(\"证据文本\", ''), '\\n', chr(10))")} AS e, coalesce("来源类型", '') AS source, try_cast("置信度" AS DOUBLE) AS confidence
    FROM {FACTS}"""
_FAULTS = f"""
    SELECT *, list_sort(list_filter([
      CASE WHEN s = '' OR p = '' OR v = '' OR e = '' THEN 'missing_required_field' END,
      CASE WHEN length(cs) > 80 OR {_has('s', Q.SENTENCE_MARK)} THEN 'overlong_or_sentence_subject' END,
      CASE WHEN {_has('cs', Q.MEASURE_SUBJECT)} THEN 'numeric_unit_or_variable_subject' END,
      CASE WHEN {_has('e', Q.INDEX_EVIDENCE)} THEN 'toc_or_page_index_evidence' END,
      CASE WHEN {_has('cv', Q.GLUED_NUMBERS)} THEN 'glued_numeric_surface' END,
      CASE WHEN length(v) > 1600 THEN 'overlong_value' END,
      CASE WHEN length(replace(s, '(', '')) <> length(replace(s, ')', '')) OR length(replace(s, '（', '')) <> length(replace(s, '）', '')) THEN 'unbalanced_subject' END,
      CASE WHEN {_in('p', Q.INDEX_PROPERTIES)} THEN 'bibliographic_or_index_property' END,
      CASE WHEN {_in('cv', Q.SUMMARY_VALUES)} THEN 'summary_or_placeholder_value' END,
      CASE WHEN {_has('cs', Q.AXIS_SUBJECT)} THEN 'concatenated_axis_subject' END,
      CASE WHEN length(cs) >= 24 AND {_has('cs', Q.VERBAL)} THEN 'long_verbal_subject' END,
      CASE WHEN {_has('cs', Q.DISCOURSE)} THEN 'discourse_or_deictic_subject' END,
      CASE WHEN starts_with(source, 'table_') AND {_in('p', Q.COMPOSITION_PROPERTIES)} AND length(cv) > 36 AND NOT {_has('v', Q.LIST_MARK)} THEN 'concatenated_table_component_value' END
    ], lambda x: x IS NOT NULL)) AS faults FROM ({_FIELDS})"""


def _faults(spark: SparkSession, d: str) -> DataFrame:
    rows = facts(spark, d, "row_id", "subject", "attribute", "predicate_raw", "value_text", "evidence", "source", "confidence")
    prop = Q.property_of(F.col("attribute"), F.col("predicate_raw"))
    return rows.withColumn("faults", Q.surface_faults(F.col("subject"), prop, F.col("value_text"), F.col("evidence"), F.col("source")))


@query(f"SELECT row_id, array_to_string(faults, '|') AS faults FROM ({_FAULTS}) WHERE len(faults) > 0")
def surface_hard_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Facts whose surface alone forbids their release, with the reasons."""
    return _faults(spark, d).where("size(faults) > 0").select("row_id", F.array_join("faults", "|").alias("faults"))


@query(
    f"""
    SELECT row_id, (s <> '' AND p <> '' AND v <> '' AND e <> '') AND coalesce(confidence, 0) >= (CASE WHEN starts_with(source, 'text_') THEN 0.55 WHEN starts_with(source, 'table_') THEN 0.35 ELSE 0.5 END)
             AND NOT list_has_any(faults, ['missing_required_field', 'numeric_unit_or_variable_subject', 'toc_or_page_index_evidence', 'glued_numeric_surface']) AS worth
    FROM ({_FAULTS})
    """
)
def review_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Which facts deserve a review even if they did not pass."""
    vetoes = ("missing_required_field", "numeric_unit_or_variable_subject", "toc_or_page_index_evidence", "glued_numeric_surface")
    complete = ~F.array_contains("faults", "missing_required_field")
    worth = Q.worth_a_review(F.col("confidence").try_cast("double"), F.col("source"), F.col("faults"), complete, vetoes, {"table_": 0.35, "text_": 0.55, "": 0.5})
    return _faults(spark, d).select("row_id", worth.alias("worth"))


_SUPPORT = f"""
    SELECT row_id, around, {_squeeze('"主体名称"')} AS cs, {_squeeze(_PROPERTY)} AS cp, {_squeeze('predicate_raw')} AS cr, {_squeeze('"尾实体/取值文本"')} AS cv,
           replace(coalesce("证据文本", ''), ',', '.') AS points, regexp_extract_all(coalesce("尾实体/取值文本", ''), '{Q.ANY_NUMBER}') AS numbers,
           starts_with(coalesce("来源类型", ''), 'text_') AS of_text, {_strip('"条件文本"')} <> '' AS condition, {_strip('"方法名称"')} <> '' AS method
    FROM (SELECT *, {_squeeze("concat(coalesce(\"证据文本\", ''), coalesce(\"章节路径\", ''), coalesce(\"所属表格标题\", ''))")} AS around FROM {FACTS})"""


@query(
    f"""
    WITH t AS ({_SUPPORT}),
    u AS (SELECT *, cs <> '' AND contains(around, cs) AS s_in, (cp <> '' AND contains(around, cp)) OR (cr <> '' AND contains(around, cr)) AS p_in, cv <> '' AND contains(around, cv) AS v_in FROM t),
    w AS (SELECT *, NOT v_in AND len(numbers) > 0 AND len(list_filter(numbers, lambda n: NOT contains(points, replace(n, ',', '.')))) = 0 AS n_in FROM u)
    SELECT row_id,
      round((CASE WHEN s_in THEN 0.05 WHEN of_text THEN -0.05 ELSE 0 END)::DOUBLE + (CASE WHEN p_in THEN 0.03 ELSE 0 END)::DOUBLE
        + (CASE WHEN v_in THEN 0.07 WHEN n_in THEN 0.05 WHEN of_text THEN -0.06 ELSE 0 END)::DOUBLE
        + (CASE WHEN condition THEN 0.02 ELSE 0 END)::DOUBLE + (CASE WHEN method THEN 0.02 ELSE 0 END)::DOUBLE + 0.03::DOUBLE, 6) AS score,
      array_to_string(list_filter([CASE WHEN s_in THEN 'subject_supported_by_context' END, CASE WHEN p_in THEN 'property_supported_by_context' END, CASE WHEN v_in THEN 'value_supported_by_evidence' END,
        CASE WHEN n_in THEN 'numeric_value_supported_by_evidence' END, CASE WHEN condition THEN 'condition_bound' END, CASE WHEN method THEN 'method_bound' END, 'evidence_self_contained'], lambda x: x IS NOT NULL), '|') AS positive
    FROM w
    """
)
def support_adjustments(spark: SparkSession, d: str) -> DataFrame:
    """What the text around every fact adds to its confidence or takes from it."""
    rows = facts(spark, d, "row_id", "subject", "attribute", "predicate_raw", "value_text", "evidence", "path", "title", "condition", "method", "source")
    context = F.concat(*[F.coalesce(c, F.lit("")) for c in ("evidence", "path", "title")])
    prop = Q.property_of(F.col("attribute"), F.col("predicate_raw"))
    judged = Q.support(F.col("subject"), prop, F.col("predicate_raw"), F.col("value_text"), F.col("evidence"), context, F.col("condition"), F.col("method"), F.col("source"))
    return rows.select("row_id", judged.alias("j")).select("row_id", "j.score", F.array_join("j.positive", "|").alias("positive"))


_UNIT_SQL = f"""replace(regexp_replace(replace(replace(translate(coalesce("单位", ''), '−⁻•×', '--·*'), '° C', '°C'), 'degC', '℃'), '{WHITE}+', '', 'g'), 'μ', 'u')"""

for _a, _b, _n, _signed in QUOTIENTS:
    _UNIT_SQL = f"regexp_replace({_UNIT_SQL}, '(?i)^{_a}[·*]{'' if _signed else '?'}{_b}\\^?-?{_n}$', '{_a}/{_b}{_n if _n > 1 else ''}')"


@query(
    f"""
    SELECT row_id, CASE {" ".join(f"WHEN {_in('p', ps)} THEN {_in('u', us)}" for ps, us in Q.PROPERTY_UNITS)} END AS fits
    FROM (SELECT row_id, {_PROPERTY} AS p, {_UNIT_SQL} AS u FROM {FACTS})
    WHERE {" OR ".join(_in('p', ps) for ps, _ in Q.PROPERTY_UNITS)}
    """
)
def unit_compatibility(spark: SparkSession, d: str) -> DataFrame:
    """Whether the unit of every fact is one its property can have."""
    rows = facts(spark, d, "row_id", "attribute", "predicate_raw", "unit")
    return rows.select("row_id", Q.unit_fits(Q.property_of(F.col("attribute"), F.col("predicate_raw")), F.col("unit")).alias("fits")).where("fits is not null")


@query(
    f"""
    SELECT row_id, {_has('v', Q.TWO_LABELS)} OR {_has('v', Q.INNER_LABEL)} OR len(regexp_extract_all(v, '{Q.ANY_NUMBER}')) >= 3 AS many_values,
           {_has(_strip('v'), Q.DEFINITION)} AND NOT {_has('v', Q.ANY_NUMBER)} AS definition
    FROM (SELECT row_id, coalesce("尾实体/取值文本", '') AS v FROM {FACTS} WHERE "来源类型" = 'text_labeled_field')
    """
)
def labelled_values(spark: SparkSession, d: str) -> DataFrame:
    """Labelled fields that hold several values or a definition."""
    rows = facts(spark, d, "row_id", "value_text", "source").where("source = 'text_labeled_field'")
    return rows.select("row_id", Q.many_values(F.col("value_text"), F.col("source")).alias("many_values"), Q.defines(F.col("value_text"), F.col("source")).alias("definition"))


@query(
    f"""
    SELECT doc_id, count(*) AS n_lines FROM (
      SELECT doc_id, {_strip(f"regexp_replace(line, '{WHITE}+', ' ', 'g')")} AS l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL))
    WHERE l <> '' AND {_has('l', Q.INDEX_LINE)} AND {_has('l', Q.INDEX_SIGN)} GROUP BY doc_id
    """
)
def index_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of every document that look like a table of contents; counted inside the document, nothing is shuffled."""
    lines = F.filter(F.split("text", "\n"), Q.index_line)
    return table(spark, d, "documents").select("doc_id", F.size(lines).cast("bigint").alias("n_lines")).where("n_lines > 0")


@query(
    f"""
    SELECT row_id, name = '' OR {_has('name', Q.NO_PROPERTY)} OR length(name) > 32 OR {_has('name', Q.NO_PROPERTY_END)} OR {_has('name', Q.CODE_ONLY)}
             OR (source = 'table_conditional_record' AND NOT {_has('name', Q.PROPERTY_HINT)}) AS no_property
    FROM (SELECT row_id, {_strip('predicate_raw')} AS name, coalesce("来源类型", '') AS source FROM {FACTS})
    """
)
def property_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels that name no property."""
    return facts(spark, d, "row_id", "predicate_raw", "source").select("row_id", Q.no_property(Q.stripped(F.col("predicate_raw")), F.col("source")).alias("no_property"))


@query(
    f"""
    WITH t AS (SELECT row_id, {_strip('predicate_raw')} AS name, CASE WHEN coalesce(normalized_unit, '') <> '' THEN normalized_unit ELSE coalesce("单位", '') END AS u,
                 concat_ws(' ', coalesce("章节路径", ''), coalesce("所属表格标题", ''), coalesce("证据文本", ''), coalesce("事实类型", '')) AS context,
                 coalesce(component_name, '') <> '' OR contains(coalesce("事实类型", ''), '组成') AS mixture FROM {FACTS}),
    e AS (SELECT *, {_has('name', Q.ELEMENT)} AND u IN ('%', '‰') AND {_has('context', Q.ELEMENT_CONTEXT)} AS element FROM t WHERE name <> ''),
    c AS (SELECT *, CASE WHEN mixture OR element THEN '组成/配方' {" ".join(f"WHEN {_has('name', p)} THEN '{c}'" for c, p in Q.SUFFIX_CATEGORIES)} END AS category FROM e)
    SELECT row_id, CASE WHEN NOT mixture AND element AND NOT ends_with(name, '含量') THEN name || '含量' ELSE name END AS name, category,
           CASE WHEN mixture THEN 0.92::DOUBLE WHEN element THEN 0.82::DOUBLE ELSE 0.76::DOUBLE END AS score
    FROM c WHERE category IS NOT NULL
    """
)
def suffix_alignments(spark: SparkSession, d: str) -> DataFrame:
    """Categories of labels by what they end in."""
    rows = facts(spark, d, "row_id", "predicate_raw", "normalized_unit", "unit", "path", "title", "evidence", "事实类型", "component_name")
    unit = F.when(F.coalesce("normalized_unit", F.lit("")) != "", F.col("normalized_unit")).otherwise(F.col("unit"))
    context = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("path", "title", "evidence", "事实类型")])
    aligned = Q.suffix_alignment(Q.stripped(F.col("predicate_raw")), unit, context, F.col("component_name"), F.col("事实类型"))
    return rows.select("row_id", aligned.alias("a")).where("a is not null").select("row_id", "a.name", "a.category", "a.score")


@query(
    f"""
    SELECT action, count(*) AS n FROM (
      SELECT CASE WHEN r.canonical IS NOT NULL THEN 'manual_review' ELSE 'keep' END AS action
      FROM {FACTS} f LEFT JOIN (SELECT DISTINCT trim(canonical) AS canonical FROM subject_registry WHERE status <> 'confirmed' AND trim(canonical) <> '') r ON {_strip('f."主体名称"')} = r.canonical)
    GROUP BY action
    """
)
def subject_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Facts of subjects that the registry has not confirmed go to manual review."""
    denied = table(spark, d, "subject_registry").where("status <> 'confirmed'").select("canonical")
    return Q.subject_actions(facts(spark, d, "subject"), denied, "subject").groupBy("action").agg(F.count("*").alias("n"))


@query(
    """
    WITH a AS (SELECT row_id, graph_fact_key AS k, trim("条件文本") AS t, coalesce(try_cast("置信度" AS DOUBLE), 0) AS confidence FROM graph_import_ready_generalized
               WHERE trim(coalesce("条件文本", '')) <> '' AND graph_fact_key IS NOT NULL),
    p AS (SELECT *, regexp_extract(t, '^(.*?)\\s*([-+]?[0-9]+(?:[.,][0-9]+)?)\\s*(\\S*)$', ['name', 'number', 'unit']) AS x FROM a),
    q AS (SELECT k, row_id, confidence, CASE WHEN x.number <> '' THEN x.name ELSE t END AS name, CASE WHEN x.number <> '' THEN round(CAST(replace(x.number, ',', '.') AS DOUBLE), 12) END AS number, lower(coalesce(x.unit, '')) AS unit FROM p)
    SELECT k AS graph_key, name, number, unit, max(confidence) AS confidence, count(*) AS n_rows FROM q GROUP BY ALL
    """
)
def condition_atoms(spark: SparkSession, d: str) -> DataFrame:
    """The conditions of every fact key, each once, with the highest confidence: numbers are compared as numbers."""
    pattern = r"^(.*?)\s*([-+]?[0-9]+(?:[.,][0-9]+)?)\s*(\S*)$"
    rows = facts(spark, d, "graph_fact_key", "condition", "confidence").select(
        F.col("graph_fact_key").alias("graph_key"), F.trim("condition").alias("t"), F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)).alias("confidence")
    ).where("graph_key is not null and t <> ''")
    part = lambda i: F.regexp_extract("t", pattern, i)
    number = F.round(F.replace(part(2), F.lit(","), F.lit(".")).try_cast("double"), 12)
    atoms = rows.select("graph_key", "confidence", F.when(part(2) != "", part(1)).otherwise(F.col("t")).alias("name"), number.alias("number"), F.lower(part(3)).alias("unit"))
    return atoms.groupBy("graph_key", "name", "number", "unit").agg(F.max("confidence").alias("confidence"), F.count("*").alias("n_rows"))


@query(
    """
    SELECT count(*) AS n, round(sum(try_cast("置信度" AS DOUBLE)), 6) AS total FROM graph_import_ready_generalized
    WHERE "抽取来源" = 'engine_table' AND "来源类型" IN ('table_conditional_record', 'llm_table_direct') AND try_cast("置信度" AS DOUBLE) >= 0.6
    """
)
def filtered_facts(spark: SparkSession, d: str) -> DataFrame:
    """Equality filters, of which any may be missing, with a status that stands for two values."""
    rows = K.filtered(facts(spark, d, "engine", "source", "confidence"), {"engine": "engine_table", "source": "table", "book": None}, {"source": {"table": ("table_conditional_record", "llm_table_direct")}})
    number = F.col("confidence").try_cast("double")
    return rows.where(number >= 0.6).agg(F.count("*").alias("n"), F.round(F.sum(number), 6).alias("total"))


@query(
    """
    WITH f AS (SELECT fact_id, row_id, ingested_at, row_number() OVER (PARTITION BY fact_id ORDER BY ingested_at DESC NULLS LAST, row_id DESC) AS back, row_number() OVER (PARTITION BY fact_id ORDER BY ingested_at NULLS FIRST, row_id) AS fore,
                 count(*) OVER (PARTITION BY fact_id) AS n FROM graph_import_ready_generalized)
    SELECT i.fact_id, coalesce(v.row_id, r.row_id) AS row_id, v.row_id IS NOT NULL AS versioned
    FROM (SELECT DISTINCT fact_id FROM f) i LEFT JOIN (SELECT * FROM f WHERE n > 1 AND back = 1) v ON i.fact_id = v.fact_id LEFT JOIN (SELECT * FROM f WHERE fore = 1) r ON i.fact_id = r.fact_id
    """
)
def export_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every item of an export with its latest version if it has one, else its raw row; one partial aggregation instead of two joins."""
    rows = table(spark, d, FACTS).select("fact_id", "row_id", "ingested_at")
    old = F.struct(F.col("ingested_at").isNotNull(), "ingested_at", "row_id")
    return rows.groupBy("fact_id").agg(F.max_by("row_id", old).alias("last"), F.min_by("row_id", old).alias("first"), F.count("*").alias("n")).select(
        "fact_id", F.when(F.col("n") > 1, F.col("last")).otherwise(F.col("first")).alias("row_id"), (F.col("n") > 1).alias("versioned")
    )


@query(
    """
    SELECT row_number() OVER (ORDER BY status <> 'confirmed', score DESC, canonical) AS place, canonical FROM subject_registry
    """
)
def registry_order(spark: SparkSession, d: str) -> DataFrame:
    """The registry, a fixed table, in its order: confirmed first, then by score and name."""
    order = Window.orderBy(F.col("status") != "confirmed", F.desc("score"), "canonical")
    return table(spark, d, "subject_registry").select(F.row_number().over(order).cast("bigint").alias("place"), "canonical")


_LINES = "CAST(nullif(regexp_extract(\"来源定位\", '^L([0-9]+)-L([0-9]+)', {}), '') AS BIGINT)"


@query(
    f"""
    WITH l AS (SELECT row_id, "文档ID" AS book, coalesce("所属表格ID", '') AS t, {_LINES.format(1)} AS a, {_LINES.format(2)} AS b FROM {FACTS}),
    c AS (SELECT book, t, min(a) AS a, max(b) AS b FROM l WHERE t <> '' AND a IS NOT NULL AND book IS NOT NULL GROUP BY book, t)
    SELECT l.row_id, count(*) AS n_tables FROM l JOIN c ON l.book = c.book AND NOT (c.b < l.a OR c.a > l.b) WHERE l.t = '' AND l.a IS NOT NULL GROUP BY l.row_id
    """
)
def locator_tables(spark: SparkSession, d: str) -> DataFrame:
    """For facts without a table, how many tables of their book overlap their lines. The tables of a book are few; they are gathered
    into one array a book, so that a book with a tenth of all facts is joined by one row, and broadcast where Spark finds them small."""
    line = lambda i: F.nullif(F.regexp_extract("locator", r"^L([0-9]+)-L([0-9]+)", i), F.lit("")).cast("bigint")
    rows = facts(spark, d, "row_id", "book", "table_id", "locator").select("row_id", "book", F.coalesce("table_id", F.lit("")).alias("t"), line(1).alias("a"), line(2).alias("b"))
    known = rows.where("t <> '' and a is not null and book is not null").groupBy("book", "t").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    catalog = known.groupBy("book").agg(F.collect_list(F.struct("a", "b")).alias("tables"))
    met = F.size(F.filter("tables", lambda t: ~((t["b"] < F.col("a")) | (t["a"] > F.col("b")))))
    return rows.where("t = '' and a is not null").join(catalog, "book").select("row_id", met.cast("bigint").alias("n_tables")).where("n_tables > 0")


# --- compiled tables ----------------------------------------------------------------------------------------------------

# the rows of pipe tables, by line: a header line above a separator, and the lines with a pipe behind it, HTML tables set aside
_PIPE_ROWS = f"""
    WITH x AS (SELECT doc_id, regexp_replace(text, '(?is)<table\\b.*?</table>', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
    l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM x),
    m AS (SELECT *, lead(line) OVER w AS after, contains(line, '|') AS piped FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
    h AS (SELECT *, sum(CASE WHEN NOT piped THEN 1 ELSE 0 END) OVER w AS run, regexp_matches(coalesce(after, ''), '^\\s*\\|?\\s*:?-{{3,}}:?\\s*(\\|\\s*:?-{{3,}}:?\\s*)*\\|?\\s*$') AND piped AS head FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
    b AS (SELECT doc_id, run, min(n) AS top FROM h WHERE head GROUP BY doc_id, run),
    r AS (SELECT h.doc_id, h.run, h.n - b.top AS k, list_transform(string_split(regexp_replace(trim(h.line), '^\\||\\|$', '', 'g'), '|'), lambda c: trim(regexp_replace(c, '{WHITE}+', ' ', 'g'))) AS cells
          FROM h JOIN b ON h.doc_id = b.doc_id AND h.run = b.run WHERE h.piped AND h.n >= b.top AND h.n <> b.top + 1)"""


def _words(spark: SparkSession, d: str) -> dict[str, tuple[str, ...]]:
    """The words of the compiler, with the names of the property reference list, a fixed table, among those of properties."""
    return C.WORDS | {"property": (*C.WORDS["property"], *reference_names(spark, d))}


@query()
def compiled_table_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of all tables by the reading their plan asks for."""
    found = C.compiled_facts(table(spark, d, "documents"), words=_words(spark, d))
    return found.withColumns({"conditions": F.array_join("conditions", "；"), "reasons": F.array_join("reasons", "|")})


@query(
    f"""
    {_PIPE_ROWS},
    t AS (SELECT doc_id, run, cells AS head FROM r WHERE k = 0)
    SELECT r.doc_id, r.cells[1] AS subject, trim(regexp_extract(t.head[i], '^(.*?)\\s*\\(.*\\)$', 1)) AS property, r.cells[i] AS value_text, count(*) AS n
    FROM r JOIN t ON r.doc_id = t.doc_id AND r.run = t.run, range(2, 1 + len(t.head)) g(i)
    WHERE r.k > 1 AND r.cells[1] <> '' AND r.cells[i] <> '' GROUP BY ALL
    """
)
def compiled_pipe_facts(spark: SparkSession, d: str) -> DataFrame:
    """The facts of pipe tables that name their rows: what the compiler finds in texts without their HTML tables, as SQL finds it by lines."""
    documents = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"(?is)<table\b.*?</table>", "").alias("text"))
    found = C.compiled_facts(documents, words=_words(spark, d))
    return found.groupBy("doc_id", "subject", "property", "value_text").agg(F.count("*").alias("n"))


@query()
def table_plans(spark: SparkSession, d: str) -> DataFrame:
    """Topology, orientation, confidence and axes of all tables."""
    plans = C.table_plans(table(spark, d, "documents"), words=_words(spark, d))
    axes = F.array_join(F.array_sort(F.transform(F.map_entries("axes"), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"].cast("array<string>"), ",")))), ";")
    return plans.withColumns({"unresolved": F.array_join("unresolved", "|"), "axes": axes})


@query()
def table_header_paths(spark: SparkSession, d: str) -> DataFrame:
    """Label paths and roles of all columns and rows of all tables."""
    return C.header_paths(table(spark, d, "documents"), words=_words(spark, d)).withColumn("labels", F.array_join("labels", "/"))


@query()
def table_cell_roles(spark: SparkSession, d: str) -> DataFrame:
    """How many cells of each role every table has."""
    return C.cell_roles(table(spark, d, "documents"), words=_words(spark, d)).groupBy("doc_id", "table_no", "role").agg(F.count("*").alias("n"))


# --- subjects and whole tables ------------------------------------------------------------------------------------------


def _words_in(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_SUBJECTS = f"""
    WITH d AS (SELECT "主体名称" AS subject, count(*) AS n FROM {FACTS} GROUP BY 1),
    c AS ({COUNTED} FROM (SELECT *, {VISIBLE.format("coalesce(subject, '')")} AS v FROM d)),
    l AS (SELECT subject, n, {LANGUAGE} AS language, trim(regexp_replace(coalesce(subject, ''), '{WHITE}+', ' ', 'g'), E' ，,。.；;：:\\t\\r\\n') AS t FROM c),
    w AS (SELECT *, lower(t) AS lo, regexp_extract_all(t, '{Q.ENGLISH_WORD.replace(chr(39), chr(39) * 2)}') AS words FROM l),
    e AS (SELECT *,
      CASE WHEN length(t) < 2 THEN 'subject_too_short' WHEN length(t) > 80 THEN 'subject_too_long' WHEN {_in('t', Q.CHINESE_STOP)} THEN 'subject_stopword'
           WHEN regexp_matches(t, '(?:{"|".join(Q.CHINESE_END)})$') THEN 'subject_bad_suffix' WHEN {_has('t', Q.SENTENCE_SIGN)} THEN 'subject_contains_sentence_boundary'
           WHEN {_words_in('t', Q.CHINESE_TRIGGERS)} THEN 'subject_contains_relation_trigger' WHEN contains(t, '上述') AND length(t) > 10 THEN 'subject_deictic_clause'
           WHEN {_has('t', Q.NO_LETTER)} THEN 'subject_numeric_or_symbol' WHEN len(regexp_extract_all(t, '[,，:：]')) >= 2 THEN 'subject_clause_like' ELSE 'ok' END AS zh,
      CASE WHEN length(t) < 2 THEN 'subject_too_short' WHEN length(t) > 140 THEN 'subject_too_long' WHEN {_in('lo', Q.ENGLISH_STOP)} OR {_has('lo', Q.ENGLISH_BACK)} THEN 'subject_stopword'
           WHEN {_has('t', Q.SENTENCE_SIGN)} THEN 'subject_contains_sentence_boundary' WHEN len(words) = 0 AND {_has('t', Q.NO_LETTER)} THEN 'subject_numeric_or_symbol'
           WHEN len(words) > 18 THEN 'subject_clause_like' WHEN {_in("lower(words[-1])", Q.ENGLISH_END)} THEN 'subject_bad_suffix'
           WHEN {_words_in('lo', Q.ENGLISH_TRIGGERS)} THEN 'subject_contains_relation_trigger' WHEN len(regexp_extract_all(t, '[,;:]')) >= 2 THEN 'subject_clause_like' ELSE 'ok' END AS en FROM w)"""


@query(
    f"""
    {_SUBJECTS}
    SELECT subject, CASE WHEN language = 'zh' THEN zh WHEN en <> 'ok' THEN en WHEN language = 'mixed' AND {_words_in('t', Q.CHINESE_TRIGGERS)} THEN 'subject_contains_relation_trigger' ELSE 'ok' END AS fault, n FROM e
    """
)
def subject_faults(spark: SparkSession, d: str) -> DataFrame:
    """Whether every name can be the subject of a fact; each name is judged once."""
    names = facts(spark, d, "subject").groupBy("subject").agg(F.count("*").alias("n"))
    return names.select("subject", Q.subject_fault(F.col("subject"), T.language(F.col("subject"))).alias("fault"), "n")


ANONYMOUS = r"^(?:某|一种|若干|不同|试样|对照组|批次|复测样)"


@query(
    f"""
    WITH r AS (SELECT f."文档ID" AS book, "所属表格ID" AS t, x.s AS subject, x.p AS prop, regexp_extract(coalesce("来源定位", ''), '(?:^|;)R([0-9]+)(?:;|$)', 1) AS row_no, x.cv AS value, coalesce("条件文本", '') AS condition, len(x.faults) > 0 AS risk
               FROM {FACTS} f JOIN ({_FAULTS}) x ON f.row_id = x.row_id WHERE "来源类型" = 'table_conditional_record' AND coalesce("所属表格ID", '') <> '' AND "文档ID" IS NOT NULL),
    d AS (SELECT book, t, count(*) AS n_doubled FROM (SELECT book, t FROM r WHERE value <> '' GROUP BY book, t, subject, row_no, value HAVING count(DISTINCT prop) >= 2) GROUP BY book, t),
    m AS (SELECT DISTINCT book, t FROM (SELECT book, t, count(*) AS n, count(DISTINCT nullif(value, '')) AS v, count(DISTINCT condition) AS c, bool_or(condition = '') AS b FROM r WHERE {_has('subject', ANONYMOUS)} GROUP BY book, t, subject, prop)
          WHERE n >= 2 AND v >= 2 AND (c < n OR b)),
    c AS (SELECT r.book, r.t, count(*) AS n_rows, count(*) FILTER (WHERE risk) AS own, coalesce(any_value(d.n_doubled), 0) AS n_doubled, bool_or(m.book IS NOT NULL) AS unnamed
          FROM r LEFT JOIN d ON r.book = d.book AND r.t = d.t LEFT JOIN m ON r.book = m.book AND r.t = m.t GROUP BY r.book, r.t),
    k AS (SELECT *, own + CASE WHEN n_doubled >= 2 THEN n_doubled ELSE 0 END AS n_risks FROM c),
    a AS (SELECT *, (n_rows >= 4 AND n_risks >= greatest(3, floor(n_rows * 0.25 + 0.999))) OR (n_rows >= 2 AND n_risks >= 2 AND n_risks / n_rows >= 0.5) AS bad FROM k)
    SELECT book, t AS table_id, n_rows, n_risks, n_doubled, array_to_string(list_filter([CASE WHEN unnamed THEN 'anonymous_sample_without_distinguishing_conditions' END,
           CASE WHEN bad AND n_doubled >= 2 THEN 'same_value_projected_to_multiple_properties' END, CASE WHEN bad THEN 'table_column_alignment_anomaly' END], lambda x: x IS NOT NULL), '|') AS reasons
    FROM a WHERE unnamed OR bad
    """
)
def table_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """Tables that cannot be trusted as a whole."""
    rows = facts(spark, d, "book", "table_id", "subject", "attribute", "predicate_raw", "value_text", "evidence", "source", "locator", "condition")
    prop = Q.property_of(F.col("attribute"), F.col("predicate_raw"))
    faults = Q.surface_faults(F.col("subject"), prop, F.col("value_text"), F.col("evidence"), F.col("source"))
    parts = rows.where("source = 'table_conditional_record' and coalesce(table_id, '') <> '' and book is not null").select(
        "book", "table_id", Q.stripped(F.col("subject")).alias("subject"), prop.alias("prop"), F.regexp_extract(F.coalesce("locator", F.lit("")), "(?:^|;)R([0-9]+)(?:;|$)", 1).alias("row_no"),
        Q.squeezed(F.col("value_text")).alias("value"), F.coalesce("condition", F.lit("")).alias("condition"), (F.size(faults) > 0).alias("risk"),
    )
    return Q.table_anomalies(parts, ["book", "table_id"], ANONYMOUS).withColumn("reasons", F.array_join("reasons", "|"))


@query()
def mass_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Table rows whose molar mass is not that of their formula."""
    rows = facts(spark, d, "book", "table_id", "attribute", "predicate_raw", "value_text", "source", "locator").where("source = 'table_conditional_record'")
    parts = rows.select("book", "table_id", F.regexp_extract(F.coalesce("locator", F.lit("")), "(?:^|;)R([0-9]+)(?:;|$)", 1).alias("row_no"), Q.property_of(F.col("attribute"), F.col("predicate_raw")).alias("prop"), F.col("value_text").alias("value"))
    return Q.mass_conflicts(parts, ["book", "table_id", "row_no"], ("分子式", "化学式", "经验式", "假定分子式", "理论分子式"), ("相对分子质量", "分子量", "摩尔质量"))


# --- keys of facts ------------------------------------------------------------------------------------------------------

_DECIMAL = "CASE WHEN {0} = '' THEN '' WHEN try_cast(replace({0}, ',', '.') AS DECIMAL(38,12)) IS NOT NULL THEN regexp_replace(regexp_replace(CAST(try_cast(replace({0}, ',', '.') AS DECIMAL(38,12)) AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') ELSE lower(" + _squeeze("{0}") .replace("{", "{{").replace("}", "}}").replace("{{0}}", "{0}") + ") END"


def _plain(column: str) -> str:
    return "lower(" + _squeeze(f"translate(coalesce({column}, ''), '−–—', '---')") + ")"


def _number(column: str) -> str:
    return _DECIMAL.format(f"trim(coalesce({column}, ''))")


@query(
    f"""
    WITH k AS (SELECT {_plain('"主体名称"')} AS s, {_plain('attribute_name')} AS p, {_number('"数值"')} AS n, {_number('"范围下限"')} AS a, {_number('"范围上限"')} AS b, {_plain('"尾实体/取值文本"')} AS t, {_plain('"单位"')} AS u, {_plain('"条件文本"')} AS c FROM {FACTS})
    SELECT s || '|' || p || '|' || (CASE WHEN n <> '' THEN 'num:' || n WHEN a <> '' OR b <> '' THEN 'range:' || a || '~' || b ELSE 'text:' || t END) || '|' || u || '|' || c AS semantic_key, count(*) AS n_rows
    FROM k GROUP BY 1 HAVING count(*) > 1
    """
)
def semantic_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Facts that say the same: subject, property, value, unit and condition in their canonical form."""
    rows = facts(spark, d, "subject", "attribute", "number", "lower", "upper", "value_text", "unit", "condition")
    value = K.semantic_value(F.col("number"), F.col("lower"), F.col("upper"), F.col("value_text"))
    key = K.semantic_key(F.col("subject"), F.col("attribute"), value, F.col("unit"), F.col("condition"))
    return rows.groupBy(key.alias("semantic_key")).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


@query(
    """
    WITH r AS (SELECT lower(trim(graph_fact_key, ' ')) AS k, concat_ws('|', lower(trim(coalesce("主体名称", ''), ' ')), lower(trim(coalesce(attribute_name, ''), ' ')), lower(trim(coalesce("尾实体/取值文本", ''), ' ')), lower(trim(coalesce("单位", ''), ' ')), lower(trim(coalesce("条件文本", ''), ' '))) AS s
               FROM graph_import_ready_generalized WHERE trim(coalesce(graph_fact_key, ''), ' ') <> '')
    SELECT k AS graph_key, left(sha256(k), 24) AS conflict_group, count(DISTINCT s) AS n_signatures, count(*) AS n_rows FROM r GROUP BY k HAVING count(DISTINCT s) > 1
    """
)
def merge_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Graph keys whose rows say different things, with the id of their conflict group: five fields make the signature."""
    folded = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    rows = facts(spark, d, "graph_fact_key", "subject", "attribute", "value_text", "unit", "condition")
    signed = rows.select(folded("graph_fact_key").alias("graph_key"), F.concat_ws("|", *[folded(c) for c in ("subject", "attribute", "value_text", "unit", "condition")]).alias("s")).where("graph_key <> ''")
    once = signed.groupBy("graph_key", "s").agg(F.count("*").alias("n"))
    found = once.groupBy("graph_key").agg(F.count("*").alias("n_signatures"), F.sum("n").alias("n_rows")).where("n_signatures > 1")
    return found.select("graph_key", F.substring(F.sha2("graph_key", 256), 1, 24).alias("conflict_group"), "n_signatures", "n_rows")


# --- structure of documents against SQL over lines ----------------------------------------------------------------------


@query(
    f"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text <> ''),
    h AS (SELECT doc_id, n, length(regexp_extract(line, '^(#{{1,6}})', 1)) AS marks, regexp_replace(regexp_extract(line, '^#{{1,6}}{WHITE}*(.*?){WHITE}*#*{WHITE}*$', 1), '{WHITE}+', ' ', 'g') AS title FROM l WHERE starts_with(line, '#')),
    d AS (SELECT *, regexp_extract(title, '^([0-9]+(?: *[.．] *[0-9]+){{0,5}})(?: |[、．.]|$)', 1) AS dotted FROM h WHERE title <> '')
    SELECT doc_id, n AS line, title, CASE WHEN regexp_matches(title, '^第 *[一二三四五六七八九十百零〇0-9]+ *章') THEN 1
             WHEN dotted <> '' THEN least(6, len(regexp_extract_all(dotted, '[.．]')) + 2)
             WHEN regexp_matches(title, '^[（(]?[一二三四五六七八九十0-9]+[)）、]') THEN least(6, marks + 1) ELSE marks END AS level
    FROM d
    """
)
def heading_levels(spark: SparkSession, d: str) -> DataFrame:
    """Every heading with its logical level, as SQL finds it line by line."""
    return D.headings(table(spark, d, "documents")).select("doc_id", F.col("line").cast("bigint").alias("line"), "title", F.col("level").cast("bigint").alias("level"))


@query(
    f"""
    {_PIPE_ROWS},
    p AS (SELECT doc_id, count(*) AS n FROM b GROUP BY doc_id),
    g AS (SELECT doc_id, len(regexp_extract_all(text, '(?is)<table\\b.*?</table\\s*>')) AS n FROM documents WHERE text IS NOT NULL)
    SELECT g.doc_id, g.n AS n_html, coalesce(p.n, 0) AS n_pipe FROM g LEFT JOIN p ON g.doc_id = p.doc_id WHERE g.n + coalesce(p.n, 0) > 0
    """
)
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    """HTML and pipe tables of every document."""
    found = D.tables(table(spark, d, "documents"))
    return found.groupBy("doc_id").agg(F.count_if(F.col("kind") == "html").alias("n_html"), F.count_if(F.col("kind") == "pipe").alias("n_pipe"))


@query(
    f"""
    WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?is)<table\\b.*?</table\\s*>')) AS raw FROM documents WHERE text IS NOT NULL),
    r AS (SELECT doc_id, unnest(regexp_extract_all(raw, '(?is)<tr\\b[^>]*>(.*?)</tr\\s*>', 1)) AS row_ FROM t),
    c AS (SELECT doc_id, unnest(regexp_extract_all(row_, '(?is)<t[hd]\\b[^>]*>.*?</t[hd]\\s*>')) AS cell FROM r),
    x AS (SELECT doc_id, starts_with(lower(cell), '<th') AS header, trim(regexp_replace(html_, '{WHITE}+', ' ', 'g'), ' ') AS cell
          FROM (SELECT doc_id, cell, replace(replace(replace(replace(replace(regexp_replace(cell, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&') AS html_ FROM c))
    SELECT doc_id, header, cell, count(*) AS n FROM x WHERE cell <> '' GROUP BY ALL
    """
)
def html_cells(spark: SparkSession, d: str) -> DataFrame:
    """The cells of HTML tables that hold a text, spans counted once."""
    only = table(spark, d, "documents").select("doc_id", F.array_join(F.regexp_extract_all("text", F.lit(r"(?is)(<table\b.*?</table\s*>)"), F.lit(1)), "\n\n").alias("text"))
    return D.cells(only).where("not copied and cell <> ''").groupBy("doc_id", "header", "cell").agg(F.count("*").alias("n"))

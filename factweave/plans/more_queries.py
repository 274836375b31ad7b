"""Further queries of the reference operators: profiles, roles, alignment, projections, cleaning, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.functions import cleanup as C
from factweave.functions import text as T
from factweave.functions import values as V
from factweave.functions.formula import molar_mass_of
from factweave.operators import alignment as A
from factweave.operators import documents as D
from factweave.operators import profile as P
from factweave.operators import relational as R
from factweave.operators import tables as G
from factweave.operators import extract as X
from factweave.plans.core_queries import BLANK, CLAUSES, SOURCE, facts, query
from factweave.session import table
from factweave.sources import contract

RANKED = "replace(lower(trim(\"来源类型\", ' ')), '-', '_')"


@query()
def block_roles(spark: SparkSession, d: str) -> DataFrame:
    rows = D.text_blocks(table(spark, d, "documents"))
    return rows.select(P.block_role(F.col("path"), F.col("block")).alias("r")).groupBy("r.role").agg(F.count("*").alias("n_blocks"), F.round(F.avg("r.confidence"), 6).alias("confidence"))


@query()
def table_captions(spark: SparkSession, d: str) -> DataFrame:
    return P.table_captions(table(spark, d, "documents"))


@query(
    r"""
    WITH c AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '(?m)^\s*[1-9]\d{5}(?:\D|$)')) AS n_codes,
                      len(regexp_extract_all(coalesce(text, ''), '(?m)^\s*[^\s：:|#<]{2,12}[：:]')) AS n_fields,
                      len(regexp_extract_all(coalesce(text, ''), '(?im)^\s*\|?\s*:?-{3,}|<table')) AS n_tables FROM documents),
    s AS (SELECT *, round(CASE WHEN n_codes >= 30 THEN 0.45 ELSE 0 END + CASE WHEN n_codes >= 200 THEN 0.05 ELSE 0 END + CASE WHEN n_fields >= greatest(50, n_codes * 2) THEN 0.25 ELSE 0 END, 6)::DOUBLE AS score FROM c)
    SELECT *, CASE WHEN score >= 0.7 THEN 'repeated_entry' WHEN n_tables >= 10 AND n_fields >= 30 THEN 'specification' ELSE 'monograph' END AS profile FROM s
    """
)
def document_profile(spark: SparkSession, d: str) -> DataFrame:
    return P.document_profile(table(spark, d, "documents"))


@query()
def process_spans(spark: SparkSession, d: str) -> DataFrame:
    return P.process_spans(D.text_blocks(table(spark, d, "documents")), T.process_score(F.col("block")), ["doc_id"], "first_line")


@query()
def entry_spans(spark: SparkSession, d: str) -> DataFrame:
    return P.entry_spans(table(spark, d, "documents"))


@query(
    """
    SELECT book AS book, batch, count(*) AS n_items FROM (SELECT "文档ID" AS book, (row_number() OVER (PARTITION BY "文档ID" ORDER BY row_id) - 1) // 12 AS batch FROM graph_import_ready_generalized) GROUP BY book, batch
    """
)
def review_batches(spark: SparkSession, d: str) -> DataFrame:
    return P.item_batches(facts(spark, d, "book", "row_id"), "book", "row_id", 12)


@query()
def property_alignment(spark: SparkSession, d: str) -> DataFrame:
    reference = table(spark, d, "supplementary_property_aliases").select("alias", F.col("canonical").alias("canonical_name"), F.col("subcategory").alias("attribute_category"))
    labels = facts(spark, d, "predicate_raw").where("predicate_raw is not null and predicate_raw <> ''").select(F.col("predicate_raw").alias("label")).distinct()
    return A.decide(A.candidates(labels, reference))


@query()
def table_facts_59(spark: SparkSession, d: str) -> DataFrame:
    """Table facts in the form of the contract."""
    rows = G.row_subject_facts(table(spark, d, "documents"))
    number, lower, upper = F.col("value.value_num"), F.col("value.lower_bound"), F.col("value.upper_bound")
    shown = V.value_projection(number, lower, upper)
    parts = (F.col("doc_id").cast("string"), F.col("table_no").cast("string"), F.col("r").cast("string"), F.col("c").cast("string"), F.col("subject"), F.col("property"), F.col("value_text"))
    return contract.project(
        rows,
        {
            "fact_id": V.short_id("fact:", 20, *parts), "graph_fact_key": V.short_id("gfk:", 40, F.col("subject"), F.col("property"), F.col("value_text"), F.col("unit")), "文档ID": F.col("doc_id"),
            "来源类型": F.lit("table_conditional_record"), "所属表格ID": F.format_string("T%05d", F.col("table_no")), "来源定位": F.format_string("R%d;C%d", F.col("r"), F.col("c")), "主体名称": F.col("subject"),
            "主体类型": T.subject_type(F.col("subject")), "事实类型": F.lit("属性事实"), "predicate_raw": F.col("property"), "edge_verb": F.lit("具有"), "attribute_name": F.col("property"),
            "attribute_key": F.concat(F.lit("attr:"), V.slug(F.col("property"))), "尾实体/取值文本": F.col("value_text"), "value_hidden": shown["hidden"], "数值类型": shown["kind"], "数值": number,
            "范围下限": lower, "范围上限": upper, "单位": F.col("unit"), "normalized_unit": V.normalize_unit(F.col("unit")), "置信度": F.col("value.parse_confidence"), "抽取来源": F.lit("engine_table"),
        },
    )


@query()
def cleaned_math(spark: SparkSession, d: str) -> DataFrame:
    """LaTeX cleaning, torn numbers joined and the molar mass of every value, whatever it holds. SQL cannot say the rules; they are tested
    on small cases."""
    cleaned = facts(spark, d, "row_id", "value_text").select("row_id", C.clean_math(F.coalesce("value_text", F.lit(""))).alias("cleaned"))
    return cleaned.select("row_id", "cleaned", C.compact_ocr_numbers(F.col("cleaned")).alias("compact"), F.round(molar_mass_of("cleaned"), 3).alias("mass"))


@query()
def subject_names(spark: SparkSession, d: str) -> DataFrame:
    names = facts(spark, d, "subject").where("subject is not null").distinct()
    return names.select("subject", C.subject_name("subject").alias("n")).select("subject", "n.canonical", "n.key", F.array_join("n.aliases", "|").alias("aliases"))


@query(
    f"""
    WITH f AS (SELECT row_id, fact_id, CASE WHEN regexp_matches(lower(coalesce(graph_fact_key, '')), '[0-9a-f]{{40}}') THEN 'g:' || sha256(lower(trim(graph_fact_key, ' '))) ELSE 'f:' || sha256(coalesce(fact_id, '')) END AS k FROM graph_import_ready_generalized)
    SELECT k AS dedup_key, min(row_id) AS row_id, count(*) AS n FROM f GROUP BY k
    """
)
def import_keys(spark: SparkSession, d: str) -> DataFrame:
    """The first row per import key: the graph key where there is one, else the fact id."""
    graph = F.coalesce("graph_fact_key", F.lit(""))
    key = F.when(F.lower(graph).rlike("[0-9a-f]{40}"), F.concat(F.lit("g:"), F.sha2(F.lower(F.trim(graph)), 256))).otherwise(F.concat(F.lit("f:"), F.sha2(F.coalesce("fact_id", F.lit("")), 256)))
    return facts(spark, d, "row_id", "fact_id", "graph_fact_key").groupBy(key.alias("dedup_key")).agg(F.min("row_id").alias("row_id"), F.count("*").alias("n"))


@query(
    f"""
    WITH t AS (SELECT f.row_id, coalesce(s.trust, -1) AS trust, coalesce(try_cast("置信度" AS DOUBLE), 0.0) AS c, length(coalesce("证据文本", '')) AS e, "主体名称" AS subject, attribute_name AS attribute, coalesce("数值", '') AS number
               FROM graph_import_ready_generalized f LEFT JOIN source_trust s ON s.source_type = {RANKED})
    SELECT subject, attribute, number, row_id FROM (SELECT *, row_number() OVER (PARTITION BY subject, attribute, number ORDER BY trust DESC, c DESC, e DESC, row_id) AS p FROM t) WHERE p = 1 AND subject IS NOT NULL AND attribute IS NOT NULL
    """
)
def cross_source_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Per statement the row of the most trusted source, then of the highest confidence, then of the longest evidence."""
    rows = facts(spark, d, "row_id", "subject", "attribute", "number", "source", "confidence", "evidence").where("subject is not null and attribute is not null")
    trust = F.broadcast(table(spark, d, "source_trust").select(F.col("source_type").alias("s"), "trust"))
    ranked = rows.withColumn("s", F.replace(F.lower(F.trim("source")), F.lit("-"), F.lit("_"))).join(trust, "s", "left")
    order = F.struct(-F.coalesce("trust", F.lit(-1)), -F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)), -F.length(F.coalesce("evidence", F.lit(""))), "row_id")
    return ranked.groupBy("subject", "attribute", F.coalesce("number", F.lit("")).alias("number")).agg(F.min_by("row_id", order).alias("row_id"))


@query(
    """
    SELECT row_id, contains(regexp_replace(coalesce("证据文本", ''), '[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{202f}\\x{3000}]+', '', 'g'), regexp_replace("主体名称", '[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{202f}\\x{3000}]+', '', 'g')) AS supported
    FROM graph_import_ready_generalized WHERE "主体名称" <> ''
    """
)
def span_support(spark: SparkSession, d: str) -> DataFrame:
    """Does the evidence hold the subject, apart from white space."""
    rows = facts(spark, d, "row_id", "subject", "evidence").where("subject <> ''")
    return rows.select("row_id", T.span_supported(F.col("subject"), F.coalesce("evidence", F.lit(""))).alias("supported"))


@query(
    """
    SELECT source AS source, conflict_group, n_sources FROM (
      SELECT DISTINCT k AS conflict_group, len(list_distinct(list(v) OVER (PARTITION BY k))) AS nv, len(list_distinct(list(s) OVER (PARTITION BY k))) AS n_sources, s AS source FROM (
        SELECT regexp_extract(lower(graph_fact_key), '([0-9a-f]{40})', 1) AS k, coalesce("数值", '') AS v, coalesce(replace(lower(trim("来源类型", ' ')), '-', '_'), '') AS s FROM graph_import_ready_generalized) WHERE k <> '') WHERE nv > 1
    """
)
def conflict_groups(spark: SparkSession, d: str) -> DataFrame:
    """Graph keys whose rows differ in their number, with the sources that take part; both counted by partial aggregation."""
    rows = facts(spark, d, "graph_fact_key", "number", "source").select(
        F.regexp_extract(F.lower("graph_fact_key"), "([0-9a-f]{40})", 1).alias("conflict_group"), F.coalesce("number", F.lit("")).alias("v"), F.coalesce(F.replace(F.lower(F.trim("source")), F.lit("-"), F.lit("_")), F.lit("")).alias("source")
    ).where("conflict_group <> ''")
    groups = rows.groupBy("conflict_group").agg(F.count_distinct("v").alias("nv"), F.count_distinct("source").alias("n_sources")).where("nv > 1").drop("nv")
    return rows.select("conflict_group", "source").distinct().join(groups, "conflict_group").select("source", "conflict_group", "n_sources")


@query(
    """
    SELECT user_id, event_id, event_type, (SELECT max(p.ts) FROM events p WHERE p.user_id = e.user_id AND p.ts < e.ts AND p.ts >= e.ts - INTERVAL 1 DAY) AS before_ts FROM events e WHERE event_type = 'purchase'
    """
)
def bounded_look_back(spark: SparkSession, d: str) -> DataFrame:
    """The nearest earlier event of the user within a day: a running last value, kept if it is near enough."""
    times = table(spark, d, "events").groupBy("user_id", "ts").agg(F.collect_list(F.when(F.col("event_type") == "purchase", F.struct("event_id", "event_type"))).alias("hits"))
    earlier = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts"))
    near = F.when(earlier >= F.col("ts") - F.expr("INTERVAL 1 DAY"), earlier)
    return times.withColumn("before_ts", near).select("user_id", F.explode("hits").alias("h"), "before_ts").select("user_id", "h.event_id", "h.event_type", "before_ts")


@query(
    """
    WITH i AS (SELECT source, book_id, edition * 100 AS a, edition * 100 + 150 AS b FROM source_books), p AS (SELECT source AS ps, book_id AS point_id, edition * 100 + 120 AS x FROM source_books)
    SELECT point_id, book_id FROM p JOIN i ON ps = source AND x BETWEEN a AND b
    """
)
def point_in_interval(spark: SparkSession, d: str) -> DataFrame:
    books = table(spark, d, "source_books")
    intervals = books.select("source", "book_id", (F.col("edition") * 100).alias("a"), (F.col("edition") * 100 + 150).alias("b"))
    points = books.select("source", F.col("book_id").alias("point_id"), (F.col("edition") * 100 + 120).alias("x"))
    return R.point_in_interval(points, intervals, ["source"], "x", ("a", "b"), 100).select("point_id", "book_id")


@query(
    f"""
    SELECT source, count(*) AS n, count(DISTINCT fact_id) AS n_ids, count(*) FILTER (WHERE coalesce(lower(trim("证据文本", ' ')), '') IN {BLANK}) AS n_no_evidence
    FROM (SELECT *, coalesce({SOURCE}, '') AS source FROM graph_import_ready_generalized) GROUP BY source
    """
)
def release_counters(spark: SparkSession, d: str) -> DataFrame:
    from factweave.functions.blank import is_blank

    rows = facts(spark, d, "fact_id", "source", "evidence")
    source = F.coalesce(F.replace(F.lower(F.trim("source")), F.lit("-"), F.lit("_")), F.lit(""))
    return rows.groupBy(source.alias("source")).agg(F.count("*").alias("n"), F.count_distinct("fact_id").alias("n_ids"), F.count_if(is_blank(F.col("evidence"))).alias("n_no_evidence"))


# --- lines in order ------------------------------------------------------------------------------------------------------

_LINES = "SELECT doc_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text <> '')"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text <> ''").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return rows.select("doc_id", (F.col("at") + 1).alias("line_no"), "line")


@query(
    f"""
    SELECT doc_id, line_no, last_value(CASE WHEN regexp_matches(line, '^#{{1,6}}\\s') THEN trim(ltrim(line, '#')) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS heading
    FROM ({_LINES}) WHERE line <> ''
    """
)
def heading_carried(spark: SparkSession, d: str) -> DataFrame:
    """Every line with the heading above it: a value carried forward inside one document."""
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    title = F.when(F.col("line").rlike(r"^#{1,6}\s"), F.trim(F.ltrim(F.col("line"), F.lit("#"))))
    return _lines(spark, d).where("line <> ''").select("doc_id", "line_no", F.last(title, ignorenulls=True).over(order).alias("heading"))


@query(
    rf"""
    WITH l AS (SELECT *, regexp_matches(line, '^\s*\|.*\|\s*$') AS p, regexp_matches(line, '^[\s|:-]+$') AS s FROM ({_LINES})),
    m AS (SELECT *, CASE WHEN p AND NOT coalesce(lag(p) OVER w, false) THEN 1 ELSE 0 END AS begins FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
    g AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY line_no) AS group_no FROM m)
    SELECT doc_id, group_no::BIGINT AS group_no, min(line_no) AS first_line, max(line_no) AS last_line, count(*) FILTER (WHERE NOT s) AS n_rows FROM g WHERE p GROUP BY doc_id, group_no
    """
)
def pipe_line_groups(spark: SparkSession, d: str) -> DataFrame:
    """Runs of lines that begin and end with a bar, separator rows not counted: gaps and islands inside one document."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    rows = _lines(spark, d).withColumns({"p": F.col("line").rlike(r"(?s)^\s*\|.*\|\s*$"), "s": F.col("line").rlike(r"^[\s|:-]+$")})
    marked = rows.withColumn("begins", (F.col("p") & ~F.coalesce(F.lag("p").over(w), F.lit(False))).cast("int"))
    grouped = marked.withColumn("group_no", F.sum("begins").over(w)).where("p")
    return grouped.groupBy("doc_id", "group_no").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count_if(~F.col("s")).alias("n_rows"))


@query(
    f"""
    WITH l AS (SELECT *, regexp_matches(line, '^(其|该材料|它)') AS deictic, regexp_extract(line, '([A-Z]{{2}}-[0-9]+[A-Z]?)', 1) AS code FROM ({_LINES}) WHERE line <> ''),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM l)
    SELECT a.doc_id, a.line_no, a.deictic, max(b.line_no) AS found_line FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k - 4 AND a.k - 1 AND b.code <> '' WHERE a.code = '' GROUP BY a.doc_id, a.line_no, a.deictic
    """
)
def nearest_antecedent(spark: SparkSession, d: str) -> DataFrame:
    """For lines that name no code, those that begin with a word that only points back among them, the nearest of the four lines before them that does: a bounded frame, no self-join."""
    rows = _lines(spark, d).where("line <> ''").withColumns({"deictic": F.col("line").rlike("^(其|该材料|它)"), "code": F.regexp_extract("line", "([A-Z]{2}-[0-9]+[A-Z]?)", 1)})
    frame = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(-4, -1)
    found = F.max(F.when(F.col("code") != "", F.col("line_no"))).over(frame)
    return rows.withColumn("found_line", found).where("code = '' and found_line is not null").select("doc_id", "line_no", "deictic", "found_line")


@query(
    """
    SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?:步骤|第)\\s*(\\d{1,2})', 1), lambda x: x::INT)))::VARCHAR AS labels FROM documents WHERE text <> ''
    """
)
def step_labels(spark: SparkSession, d: str) -> DataFrame:
    labels = P.step_labels(F.col("text"))
    return table(spark, d, "documents").where("text <> ''").select("doc_id", F.concat(F.lit("["), F.array_join(labels, ", "), F.lit("]")).alias("labels"))


# --- joins and sets ------------------------------------------------------------------------------------------------------


@query(
    """
    SELECT b.book_id, b.title, count(*) AS n_facts FROM graph_import_ready_generalized f JOIN source_books b ON f."书名" = b.title
    WHERE NOT EXISTS (SELECT 1 FROM source_books x WHERE x.book_id = b.book_id AND x.source = 'web_page') GROUP BY ALL
    """
)
def book_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Books matched by title, those of excluded kinds left out; facts are counted per title before the join."""
    books = table(spark, d, "source_books")
    counted = facts(spark, d, "书名").groupBy(F.col("书名").alias("title")).agg(F.count("*").alias("n"))
    kept = books.join(books.where("source = 'web_page'").select("book_id"), "book_id", "left_anti")
    return counted.join(kept, "title").groupBy("book_id", "title").agg(F.sum("n").alias("n_facts"))


@query(
    """
    SELECT j.job_id, j.attempt, coalesce(l.max_chars, -1) AS max_chars, CASE WHEN l.kind IS NULL THEN 'no_limit' WHEN length(j.evidence) > l.max_chars THEN 'over' ELSE 'within' END AS state
    FROM llm_jobs j LEFT JOIN job_limits l ON l.kind = j.kind AND l.field_name = 'evidence'
    """
)
def job_records(spark: SparkSession, d: str) -> DataFrame:
    """Every job with its limit; a missing one is filled in and told apart."""
    limits = table(spark, d, "job_limits").where("field_name = 'evidence'").select("kind", "max_chars", F.lit(True).alias("known"))
    rows = table(spark, d, "llm_jobs").join(F.broadcast(limits), "kind", "left")
    state = F.when(F.col("known").isNull(), "no_limit").when(F.length("evidence") > F.col("max_chars"), "over").otherwise("within")
    return rows.select("job_id", "attempt", F.coalesce("max_chars", F.lit(-1)).alias("max_chars"), state.alias("state"))


@query("SELECT job_id, max(attempt) AS attempt, count(*) AS n_deliveries FROM llm_jobs GROUP BY job_id")
def job_attempts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "llm_jobs").groupBy("job_id").agg(F.max("attempt").alias("attempt"), F.count("*").alias("n_deliveries"))


@query(
    """
    SELECT row_id, left("证据文本", 8000) AS preview, length("证据文本") > 8000 AS truncated FROM graph_import_ready_generalized WHERE "证据文本" IS NOT NULL
    """
)
def truncated_evidence(spark: SparkSession, d: str) -> DataFrame:
    rows = facts(spark, d, "row_id", "evidence").where("evidence is not null")
    return rows.select("row_id", F.substring("evidence", 1, 8000).alias("preview"), (F.length("evidence") > 8000).alias("truncated"))


@query(
    f"""
    WITH r AS (SELECT row_id, list_filter([CASE WHEN coalesce(lower(trim("单位", ' ')), '') IN {BLANK} THEN 'unit' END, CASE WHEN coalesce(lower(trim("条件文本", ' ')), '') IN {BLANK} THEN 'condition' END,
                      CASE WHEN coalesce(lower(trim("方法名称", ' ')), '') IN {BLANK} THEN 'method' END], lambda x: x IS NOT NULL) AS found FROM graph_import_ready_generalized)
    SELECT array_to_string(list_sort(list_intersect(found, ['unit'])), '+') AS hard, array_to_string(list_sort(list_filter(found, lambda x: x <> 'unit')), '+') AS soft, count(*) AS n FROM r GROUP BY ALL
    """
)
def reason_algebra(spark: SparkSession, d: str) -> DataFrame:
    """Reasons cut into hard and soft ones by set operations on arrays."""
    from factweave.functions.blank import is_blank
    from factweave.operators.facts import reasons

    rows = facts(spark, d, "unit", "condition", "method")
    found = rows.select(reasons({"unit": is_blank(F.col("unit")), "condition": is_blank(F.col("condition")), "method": is_blank(F.col("method"))}).alias("found"))
    hard_list = F.array(F.lit("unit"))
    hard = F.array_join(F.array_sort(F.array_intersect("found", hard_list)), "+")
    soft = F.array_join(F.array_sort(F.array_except("found", hard_list)), "+")
    return found.groupBy(hard.alias("hard"), soft.alias("soft")).agg(F.count("*").alias("n"))


@query(
    """
    WITH g AS (SELECT fact_id, 1 AS p, row_id FROM graph_import_ready_generalized WHERE "数值类型" = '标量' UNION ALL SELECT fact_id, 2, row_id FROM graph_import_ready_generalized WHERE "数值类型" <> '标量'),
    s AS (SELECT DISTINCT fact_id FROM graph_import_ready_generalized WHERE "来源类型" = 'table_conditional_record')
    SELECT fact_id, row_id FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY p, row_id) AS n FROM g WHERE fact_id IS NOT NULL AND fact_id NOT IN (SELECT fact_id FROM s WHERE fact_id IS NOT NULL)) WHERE n = 1
    """
)
def candidate_pool(spark: SparkSession, d: str) -> DataFrame:
    """Two pools united by priority, less what the strict set holds."""
    rows = facts(spark, d, "fact_id", "row_id", "source", "数值类型").where("fact_id is not null")
    strict = rows.where("source = 'table_conditional_record'").select("fact_id").distinct()
    first, second = rows.where(F.col("数值类型") == "标量").withColumn("p", F.lit(1)), rows.where(F.col("数值类型") != "标量").withColumn("p", F.lit(2))
    pool = first.unionByName(second).join(strict, "fact_id", "left_anti")
    return pool.groupBy("fact_id").agg(F.min_by("row_id", F.struct("p", "row_id")).alias("row_id"))


@query(
    """
    SELECT p AS dimension, CAST(sum(v) AS BIGINT) AS tokens, count(*) AS n FROM (SELECT event_type AS p, coalesce(nullif(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0), 0) AS v FROM events) GROUP BY p ORDER BY tokens DESC, dimension LIMIT 3 OFFSET 1
    """
)
def usage_page(spark: SparkSession, d: str) -> DataFrame:
    """One page of a rollup in a total order."""
    value = F.coalesce(F.nullif(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(0)), F.lit(0))
    rows = table(spark, d, "events").groupBy(F.col("event_type").alias("dimension")).agg(F.sum(value).alias("tokens"), F.count("*").alias("n"))
    return rows.orderBy(F.desc("tokens"), "dimension").offset(1).limit(3)


@query(
    r"""
    WITH v AS (SELECT row_id, coalesce("尾实体/取值文本", '') AS t FROM graph_import_ready_generalized),
    p AS (SELECT row_id, t, regexp_extract_all(t, '([-+]?\d+(?:\.\d+)?)\s*%', 1) AS pct, regexp_extract_all(t, '([-+]?\d+(?:\.\d+)?)\s*(?:~|至|到)\s*[-+]?\d+(?:\.\d+)?', 1) AS lo, regexp_extract_all(t, '[-+]?\d+(?:\.\d+)?\s*(?:~|至|到)\s*([-+]?\d+(?:\.\d+)?)', 1) AS hi FROM v)
    SELECT row_id, CASE WHEN len(pct) > 0 THEN pct[-1] END AS percent, CASE WHEN len(pct) = 0 AND len(lo) > 0 THEN lo[-1] END AS lower, CASE WHEN len(pct) = 0 AND len(hi) > 0 THEN hi[-1] END AS upper FROM p
    """
)
def last_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The last percentage of a value, else the ends of its last range."""
    t = F.coalesce("value_text", F.lit(""))
    every = lambda p: F.regexp_extract_all(t, F.lit(p), F.lit(1))
    number = r"[-+]?\d+(?:\.\d+)?"
    percent, low, high = every(rf"({number})\s*%"), every(rf"({number})\s*(?:~|至|到)\s*{number}"), every(rf"{number}\s*(?:~|至|到)\s*({number})")
    last = lambda c: F.try_element_at(c, F.lit(-1))
    none = F.size(percent) == 0
    return facts(spark, d, "row_id", "value_text").select("row_id", last(percent).alias("percent"), F.when(none, last(low)).alias("lower"), F.when(none, last(high)).alias("upper"))


@query()
def table_header_rows(spark: SparkSession, d: str) -> DataFrame:
    return G.header_rows(D.cells(table(spark, d, "documents")))


@query()
def table_row_headers(spark: SparkSession, d: str) -> DataFrame:
    return G.row_header_columns(G.axis_features(D.cells(table(spark, d, "documents"))))


_CONDITION_SQL = " UNION ALL ".join(
    f"SELECT DISTINCT doc_id, ord, '{n}' AS name, unnest(regexp_extract_all(clause, '{p}', 1))::DOUBLE AS value, '{u}' AS unit FROM c" for n, p, u in X.CONDITIONS
)


@query(f"WITH c AS (SELECT doc_id, generate_subscripts(l, 1) AS ord, unnest(l) AS clause FROM (SELECT doc_id, {CLAUSES} AS l FROM documents)) {_CONDITION_SQL}")
def text_conditions(spark: SparkSession, d: str) -> DataFrame:
    return X.conditions(table(spark, d, "documents"))


@query()
def conditioned_values(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return X.with_conditions(X.bound_values(documents).drop("value"), X.conditions(documents), ["doc_id", "ord"])

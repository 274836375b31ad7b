"""Queries of the training-data problems tagged llm, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.llm.canonical import map_to_canonical
from factweave.llm.encoding import repair_encoding
from factweave.llm.fusion import FUSED_FIELDS, dominant_rows, fuse_records, group_key
from factweave.llm.lookalike import consistent_names, unify_text
from factweave.llm.mixing import clean_sources, mix_sources
from factweave.llm.packing import pack_documents
from factweave.llm.splitting import split_oversized
from factweave.session import table

FACTS = "graph_import_ready_generalized"


def p1_pieces(spark: SparkSession, directory: str) -> DataFrame:
    """All pieces of all oversized fields."""
    return split_oversized(table(spark, directory, "llm_jobs"), table(spark, directory, "job_limits"))


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    """A field is a case if the splitter had to cut it."""
    return p1_pieces(spark, directory).where("pos = 2").select("job_id", "field_name")


def p1_rules_kept(spark: SparkSession, directory: str) -> DataFrame:
    """What must hold of the pieces: all text covered in order, none above the limit, the overlap exact, no piece that ends in a heading."""
    pieces = p1_pieces(spark, directory)
    jobs = table(spark, directory, "llm_jobs")
    kinds = jobs.where("kind is not null").select("job_id", "kind", F.explode(F.array(F.struct(F.lit("evidence").alias("field_name"), F.length("evidence").alias("size")), F.struct(F.lit("heading_path").alias("field_name"), F.length("heading_path").alias("size")))).alias("x"))
    sizes = kinds.select("job_id", "kind", "x.*").distinct()
    joined = pieces.join(sizes, ["job_id", "field_name"]).join(F.broadcast(table(spark, directory, "job_limits")), ["kind", "field_name"])
    order = Window.partitionBy("job_id", "field_name").orderBy("pos")
    marked = joined.withColumns({"before": F.lag("end").over(order), "next_": F.lead("pos").over(order)})
    shared = F.least(F.col("overlap_chars"), F.col("max_chars") - 1)
    return marked.groupBy("field_name").agg(
        F.count_if(F.col("pos") == 1).alias("n_fields"),
        F.count_if((F.col("end") - F.col("begin") > F.col("max_chars")) | (F.length("text") != F.col("end") - F.col("begin"))).alias("over_limit"),
        F.count_if(F.when(F.col("before").isNull(), F.col("begin") != 0).otherwise(F.col("begin") != F.greatest(F.col("before") - shared, F.lit(0)))).alias("wrong_overlap"),
        F.count_if(F.col("next_").isNull() & (F.col("end") != F.col("size"))).alias("unfinished"),
        F.count_if(F.col("next_").isNotNull() & F.col("text").rlike(r"(^|\n)#{1,6} [^\n]*\n*$") & (F.col("border") != "character")).alias("ends_in_heading"),
    )


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    mapped = map_to_canonical(table(spark, directory, FACTS), table(spark, directory, "supplementary_property_aliases"))
    return mapped.select("row_id", "field_name", "canonical")


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    return dominant_rows(table(spark, directory, FACTS), table(spark, directory, "source_trust"))


def p4_records(spark: SparkSession, directory: str) -> DataFrame:
    """The surviving record of every key, its values as JSON."""
    fused = fuse_records(table(spark, directory, FACTS), table(spark, directory, "source_trust"))
    return fused.withColumn("values", F.to_json("values"))


def p4_rules_kept(spark: SparkSession, directory: str) -> DataFrame:
    """For each field how many keys have a value in their surviving record, and how many of these values no row of the key holds."""
    facts = table(spark, directory, FACTS)
    fused = fuse_records(facts, table(spark, directory, "source_trust")).select("group_key", F.explode("values").alias("field", "value"))
    cells = facts.select(group_key(F.col("graph_fact_key")).alias("group_key"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("value")) for f in FUSED_FIELDS])).alias("c"))
    held = cells.where("group_key is not null and c.value is not null").select("group_key", "c.field", "c.value").distinct().withColumn("held", F.lit(True))
    return fused.join(held, ["group_key", "field", "value"], "left").groupBy("field").agg(F.count("*").alias("n_keys"), F.count_if(F.col("held").isNull()).alias("invented"))


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    return unify_text(table(spark, directory, FACTS), table(spark, directory, "subject_registry")).select("row_id", "field_name")


def p6_names(spark: SparkSession, directory: str) -> DataFrame:
    """The one form of every subject name."""
    return consistent_names(table(spark, directory, FACTS), table(spark, directory, "subject_registry"))


def p7_containers(spark: SparkSession, directory: str) -> DataFrame:
    """The container of every document, for each kind of container."""
    return pack_documents(table(spark, directory, "documents"), table(spark, directory, "pack_limits"))


def _mixture(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    documents = clean_sources(table(spark, directory, "documents"), table(spark, directory, "source_books"))
    return mix_sources(documents, table(spark, directory, "mix_targets"))


def p8_selection(spark: SparkSession, directory: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return _mixture(spark, directory)[0]


def p8_shares(spark: SparkSession, directory: str) -> DataFrame:
    """Target and actual share of every source."""
    return _mixture(spark, directory)[1]


def p7_rules_kept(spark: SparkSession, directory: str) -> DataFrame:
    """What must hold of the containers: none above its capacity, every document placed once and whole unless it is larger than a
    container, and hardly more containers than the tokens need."""
    limits = table(spark, directory, "pack_limits")
    placed = p7_containers(spark, directory)
    pieces = placed.groupBy("container_kind", "doc_id").agg(
        F.count("*").alias("n"), F.count_distinct("piece").alias("d"), F.sum("tokens").alias("tokens"), F.max("token_end").alias("end_")
    )
    documents = pieces.join(F.broadcast(limits), "container_kind").groupBy("container_kind").agg(
        F.count("*").alias("n_documents"),
        F.count_if((F.col("n") != F.col("d")) | (F.col("end_") != F.col("tokens"))).alias("placed_wrongly"),
        F.count_if((F.col("n") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))).alias("needless_cuts"),
    )
    containers = placed.groupBy("container_kind", "container").agg(F.sum("tokens").alias("used")).join(F.broadcast(limits), "container_kind")
    filled = containers.groupBy("container_kind", "capacity_tokens").agg(
        F.count_if(F.col("used") > F.col("capacity_tokens")).alias("over_capacity"), F.count("*").alias("n"), F.sum("used").alias("used")
    )
    near = F.col("n") <= 1.02 * F.col("used") / F.col("capacity_tokens") + 2
    return filled.join(documents, "container_kind").select("container_kind", "n_documents", "placed_wrongly", "needless_cuts", "over_capacity", near.alias("near_bound"))


def p8_targets_kept(spark: SparkSession, directory: str) -> DataFrame:
    """What must hold of the mixture: no document above its cap, and each source that has documents at its share of the tokens."""
    selection, report = _mixture(spark, directory)
    used = selection.groupBy("source").agg(F.max("repeats").alias("most"))
    present = F.sum(F.when(F.col("actual_tokens") > 0, F.col("target_share"))).over(Window.partitionBy())
    there = F.col("actual_tokens") > 0
    aim = F.when(there, F.col("target_share") / present).otherwise(F.lit(0.0))
    return report.withColumn("aim", aim).join(used, "source", "left").select(
        "source",
        "max_repeats",
        there.alias("has_documents"),
        (F.coalesce("most", F.lit(0)) > F.col("max_repeats")).alias("over_cap"),
        (F.abs(F.col("actual_share") - F.col("aim")) < 0.0005).alias("on_target"),
        (F.col("actual_tokens") > F.col("target_tokens")).alias("over_budget"),
    )


def p9_found(spark: SparkSession, directory: str) -> DataFrame:
    return repair_encoding(table(spark, directory, "documents")).select("doc_id")


def p9_restored(spark: SparkSession, directory: str) -> DataFrame:
    """Damaged documents with their text as it was, as far as it can be had back."""
    return repair_encoding(table(spark, directory, "documents")).withColumn("channels", F.array_join("channels", ","))


QUERIES = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p1_rules_kept": p1_rules_kept,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_records": p4_records,
    "p4_rules_kept": p4_rules_kept,
    "p6_found": p6_found,
    "p6_names": p6_names,
    "p7_containers": p7_containers,
    "p7_rules_kept": p7_rules_kept,
    "p8_selection": p8_selection,
    "p8_shares": p8_shares,
    "p8_targets_kept": p8_targets_kept,
    "p9_found": p9_found,
    "p9_restored": p9_restored,
}
ORACLE: dict[str, str] = {
    "p1_found": """
        SELECT DISTINCT j.job_id, l.field_name
        FROM llm_jobs j JOIN job_limits l ON j.kind = l.kind
        WHERE (l.field_name = 'evidence' AND length(j.evidence) > l.max_chars)
           OR (l.field_name = 'heading_path' AND length(j.heading_path) > l.max_chars)
    """,
    "p4_found": """
        WITH t AS (
          SELECT row_id, regexp_extract(lower(graph_fact_key), '([0-9a-f]{40})\\s*$', 1) AS k,
                 coalesce(extracted_at, TIMESTAMP '0001-01-01') AS at_, coalesce(s.trust, -1) AS trust,
                 list_sum([CAST(NOT coalesce(lower(trim(v)) IN ('', '-', '--', '—', '/', 'n/a', 'null', '无', '暂缺', '待补'), true) AS INT)
                           FOR v IN ["章节路径", "来源定位", "所属表格标题", "单位", "条件文本", "方法名称", "证据文本"]]) AS filled
          FROM graph_import_ready_generalized f
          LEFT JOIN source_trust s ON s.source_type = replace(lower(trim(f."来源类型")), '-', '_')),
        g AS (SELECT k, count(*) AS n, max(filled) AS mf, max(at_) AS ma, max(trust) AS mt FROM t WHERE k <> '' GROUP BY k)
        SELECT min(t.row_id) AS row_id FROM t JOIN g ON t.k = g.k
        WHERE n >= 2 AND filled = mf AND at_ = ma AND trust = mt GROUP BY t.k
    """,
    "p1_rules_kept": """
        WITH f AS (
          SELECT DISTINCT j.job_id, l.field_name
          FROM llm_jobs j JOIN job_limits l ON j.kind = l.kind
          WHERE (l.field_name = 'evidence' AND length(j.evidence) > l.max_chars)
             OR (l.field_name = 'heading_path' AND length(j.heading_path) > l.max_chars))
        SELECT field_name, count(*) AS n_fields, CAST(0 AS BIGINT) AS over_limit, CAST(0 AS BIGINT) AS wrong_overlap,
               CAST(0 AS BIGINT) AS unfinished, CAST(0 AS BIGINT) AS ends_in_heading
        FROM f GROUP BY field_name
    """,
    "p4_rules_kept": """
        WITH t AS (SELECT regexp_extract(lower(graph_fact_key), '([0-9a-f]{40})\\s*$', 1) AS k, * FROM graph_import_ready_generalized),
        c AS (
          SELECT k, '章节路径' AS field, "章节路径" AS v FROM t
          UNION ALL SELECT k, '来源定位' AS field, "来源定位" AS v FROM t
          UNION ALL SELECT k, '所属表格标题' AS field, "所属表格标题" AS v FROM t
          UNION ALL SELECT k, '单位' AS field, "单位" AS v FROM t
          UNION ALL SELECT k, '条件文本' AS field, "条件文本" AS v FROM t
          UNION ALL SELECT k, '方法名称' AS field, "方法名称" AS v FROM t
          UNION ALL SELECT k, '证据文本' AS field, "证据文本" AS v FROM t
          UNION ALL SELECT k, '主体名称' AS field, "主体名称" AS v FROM t
          UNION ALL SELECT k, 'attribute_name' AS field, "attribute_name" AS v FROM t
          UNION ALL SELECT k, '尾实体/取值文本' AS field, "尾实体/取值文本" AS v FROM t
          UNION ALL SELECT k, '数值' AS field, "数值" AS v FROM t
          )
        SELECT field, count(DISTINCT k) AS n_keys, CAST(0 AS BIGINT) AS invented
        FROM c
        WHERE k <> '' AND v IS NOT NULL
          AND NOT regexp_full_match(lower(v), '[\\s\\p{Z}\\p{Cf}]*(|-|--|—|——|/|\\\\|n/a|na|null|none|nan|无|暂缺|待补|未知|空|\\?)[\\s\\p{Z}\\p{Cf}]*')
        GROUP BY field
    """,
    "p7_rules_kept": """
        SELECT container_kind, (SELECT count(*) FROM documents WHERE length(text) > 0) AS n_documents, CAST(0 AS BIGINT) AS placed_wrongly,
               CAST(0 AS BIGINT) AS needless_cuts, CAST(0 AS BIGINT) AS over_capacity, true AS near_bound
        FROM pack_limits
    """,
    "p8_targets_kept": """
        SELECT m.source, m.max_repeats,
               EXISTS (SELECT 1 FROM documents d LEFT JOIN source_books b ON d.book_id = b.book_id
                       WHERE length(d.text) > 0 AND coalesce(b.source, regexp_replace(lower(trim(d.source)), '[\\s-]+', '_', 'g')) = m.source) AS has_documents,
               false AS over_cap, true AS on_target, false AS over_budget
        FROM mix_targets m
    """,
}

"""Problem 3: values typed freely, mapped to the entry of a reference list that is meant, in SQL.

Distinct texts are matched in three steps: equal after normalization; within k edits by a partition-based pigeonhole join: a
reference string is cut into k+1 segments, and a text within k edits of it holds at least one of them unchanged, at most k places
from where it stands in the reference; the candidates come from an equality join on those substrings and are verified with the
built-in levenshtein. What is left may still be a reference name behind a word that narrows it; that is believed only if the rows
prove it, by the units they are recorded in or by the name in their other field. What no step matches is reported through an anti-join.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions.blank import is_blank
from factweave.functions.fold import fold_table, lookalike_table
from factweave.functions.units import alias_index
from factweave.operators.multivalue import split_values
from factweave.session import cut_lineage, small_rows

UNMATCHED = "(unmatched)"

# Words around a property name that leave its meaning as it is.
NEUTRAL_PREFIX = "所测|实测|该材料的|该材料|试样的|试样|样品的|样品|材料的|本品的|本品"
NEUTRAL_SUFFIX = "测定值|测试值|测量值|实测值|数值|数据|值|描述|说明|要求|情况|结果"
#: A unit is usual for a property if at least this share of its rows with a unit has it.
USUAL = 0.01


@lru_cache(maxsize=1)
def _simplify(jvm) -> tuple[str, str]:
    """Traditional characters and their simplified forms, by the transliteration rules of the ICU library Spark ships."""
    chars = "".join(map(chr, range(0x4E00, 0xA000)))
    plain = jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified").transliterate("\n".join(chars)).split("\n")
    pairs = [(a, b) for a, b in zip(chars, plain, strict=True) if a != b and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def normal_form_sql(spark: SparkSession, column: str) -> str:
    """SQL for the comparison form of a name: folded, simplified, without unit, outer quotes and closing point, in lower case."""
    source, target = _simplify(spark._jvm)
    single = [(chr(c), t) for c, t in fold_table().items() if len(t) == 1]
    source += "".join(a for a, _ in single)
    target += "".join(b for _, b in single)
    units = "|".join(re.escape(k) for k in sorted(alias_index(), key=len, reverse=True))
    folded = f"translate(regexp_replace({column}, {_quoted(r'\p{Cf}')}, ''), {_quoted(source)}, {_quoted(target)})"
    bare = f"regexp_replace({folded}, {_quoted(rf'(?iu)\s*(\(\s*(?:{units})\s*\)|[,/]\s*(?:{units}))\s*$')}, '')"
    words = f"trim(regexp_replace({bare}, {_quoted(r'[\s_-]+')}, ' '))"
    unquoted = f"regexp_replace({words}, {_quoted('^[\"“「]+|[\"”」]+$')}, '')"
    # the braces are doubled as the text is put into a template of spark.sql
    return f"lower(regexp_replace({unquoted}, {_quoted(r'[.\s]+$')}, ''))".replace("{", "{{").replace("}", "}}")


def _local(df: DataFrame) -> DataFrame:
    """A table whose size follows the reference list alone, held as literal rows, so that the plans that use it stay small."""
    return df.sparkSession.createDataFrame(small_rows(df), df.schema)


def match_names(texts: DataFrame, reference: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(forms, found, narrowed): raw, form, core of every text; raw, canonical, distance, rule of the texts that the list holds, equal
    or within few edits; and raw, canonical, distance of the others that end in a name of the list, to be proven.

    texts: column raw, distinct, not blank. reference: columns alias, canonical. The nearest entry wins; two different entries
    at the same distance leave the text unmatched. All joins are equality joins on strings.
    """
    spark = texts.sparkSession
    names = _local(spark.sql(
        f"""
        SELECT name, canonical, length(name) AS size, name RLIKE '[一-鿿]' AS han,
               CASE WHEN name RLIKE '[一-鿿]' THEN CASE WHEN length(name) < 4 THEN 1 ELSE 2 END
                    WHEN length(name) < 4 THEN 0 WHEN length(name) < 5 THEN 1 ELSE 2 END AS k
        FROM (SELECT DISTINCT {normal_form_sql(spark, 'name')} AS name, canonical
              FROM (SELECT alias AS name, canonical FROM {{reference}} UNION ALL SELECT canonical, canonical FROM {{reference}})
              WHERE name IS NOT NULL AND canonical IS NOT NULL)
        WHERE name <> ''
        """,
        reference=reference,
    ))
    segments = _local(spark.sql(
        """
        SELECT *, substring(name, begin_ + 1, width) AS segment
        FROM (SELECT name, canonical, size, han, k, piece,
                     CAST(floor(piece * size / (k + 1)) AS INT) AS begin_,
                     CAST(floor((piece + 1) * size / (k + 1)) AS INT) - CAST(floor(piece * size / (k + 1)) AS INT) AS width
              FROM (SELECT *, explode(sequence(0, k)) AS piece FROM {names} WHERE k > 0))
        """,
        names=names,
    ))
    sizes = _local(segments.select("size", "k", "piece", "begin_", "width").distinct())
    forms = cut_lineage(spark.sql(
        f"""
        SELECT raw, form, CASE WHEN form RLIKE '[一-鿿]' THEN
                 regexp_replace(regexp_replace(regexp_replace(form, '^({NEUTRAL_PREFIX})(?=..)', ''), '(?<=..)({NEUTRAL_SUFFIX})$', ''), '性能$', '性')
               ELSE form END AS core
        FROM (SELECT raw, {normal_form_sql(spark, 'raw')} AS form FROM {{texts}})
        """,
        texts=texts,
    ))
    found = cut_lineage(spark.sql(
        f"""
        WITH exact AS (
          SELECT raw, canonical, 0 AS distance, 'equal' AS rule
          FROM (SELECT raw, form AS word FROM {{forms}} UNION SELECT raw, core FROM {{forms}}) f JOIN {{names}} n ON f.word = n.name),
        rest AS (SELECT f.* FROM {{forms}} f LEFT ANTI JOIN exact e ON f.raw = e.raw),
        probes AS (
          SELECT DISTINCT l.raw, l.core, s.size, s.k, s.piece, substring(l.core, s.begin_ + shift + 1, s.width) AS segment
          FROM (SELECT raw, core, explode(sequence(length(core) - 2, length(core) + 2)) AS near FROM rest WHERE length(core) > 1) l
          JOIN {{sizes}} s ON l.near = s.size AND abs(length(l.core) - s.size) <= s.k
          LATERAL VIEW explode(sequence(-s.k, s.k)) x AS shift
          WHERE s.begin_ + shift >= 0 AND s.begin_ + shift + s.width <= length(l.core)),
        candidates AS (
          SELECT DISTINCT p.raw, p.core, n.name, n.canonical, n.size, n.han, n.k
          FROM probes p JOIN {{segments}} n ON p.segment = n.segment AND p.size = n.size AND p.k = n.k AND p.piece = n.piece),
        verified AS (
          SELECT raw, canonical, CASE WHEN swapped THEN 1 ELSE edits END AS distance, 'edits' AS rule
          FROM (SELECT *, edits = 2 AND array_sort(split(core, '')) = array_sort(split(name, '')) AS swapped
                FROM (SELECT *, levenshtein(core, name, k) AS edits FROM candidates))
          WHERE edits >= 0 AND NOT (han AND startswith(core, name))
            AND (edits <= 1 OR swapped OR size >= CASE WHEN han THEN 6 ELSE 8 END)),
        all_ AS (SELECT * FROM exact UNION ALL SELECT * FROM verified),
        nearest AS (
          SELECT raw, canonical, distance, rule, dense_rank() OVER (PARTITION BY raw ORDER BY distance) AS place FROM all_)
        SELECT raw, min(canonical) AS canonical, min(distance) AS distance, min(rule) AS rule
        FROM nearest WHERE place = 1 GROUP BY raw HAVING count(DISTINCT canonical) = 1
        """,
        forms=forms,
        names=names,
        segments=segments,
        sizes=sizes,
    ))
    narrowed = spark.sql(
        """
        WITH rest AS (SELECT f.raw, f.core FROM {forms} f LEFT ANTI JOIN {found} m ON f.raw = m.raw WHERE f.core RLIKE '[一-鿿]' AND length(f.core) > 2),
        tails AS (SELECT raw, core, explode(sequence(1, length(core) - 2)) AS cut FROM rest),
        ended AS (SELECT raw, canonical, cut FROM tails t JOIN {names} n ON substring(t.core, t.cut + 1) = n.name WHERE n.han)
        SELECT raw, min_by(canonical, struct(cut, canonical)) AS canonical, min(cut) AS distance FROM ended GROUP BY raw
        """,
        forms=forms,
        names=names,
        found=found,
    )
    return forms, found, cut_lineage(narrowed)


def unit_symbol_sql(spark: SparkSession, column: str) -> str:
    """SQL for the comparison form of a unit field."""
    pairs = [(chr(c), t) for c, t in fold_table().items() if len(t) == 1] + [(chr(c), t) for c, t in lookalike_table().items()]
    source, target = "".join(a for a, _ in pairs), "".join(b for _, b in pairs)
    return f"lower(regexp_replace(translate(regexp_replace({column}, {_quoted(r'\p{Cf}')}, ''), {_quoted(source)}, {_quoted(target)}), {_quoted(r'\s+')}, ''))".replace("{", "{{").replace("}", "}}")


def proven(narrowed: DataFrame, found: DataFrame, pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The narrowed names that the rows prove: raw, canonical, distance.

    pairs: raw, unit, n; rows: raw, unit, other (array of the texts in the other fields). A row speaks for the name if its unit is
    usual for the property or another field names the property, against it if its unit is known and not usual or another field
    names another property. More rows must speak for it than against it; a property that seldom has a unit needs no proof by units
    if no row speaks against it, where other properties have units at all.
    """
    spark = narrowed.sparkSession
    units = spark.createDataFrame(sorted({(k.replace(" ", ""), symbol) for k, symbol in alias_index().items()}), "unit_key string, symbol string")
    return spark.sql(
        f"""
        WITH equal_ AS (SELECT raw, canonical FROM {{found}} WHERE rule = 'equal'),
        seen AS (
          SELECT e.canonical, u.symbol, sum(p.n) AS n
          FROM {{pairs}} p JOIN equal_ e ON p.raw = e.raw LEFT JOIN {{units}} u ON {unit_symbol_sql(spark, 'p.unit')} = u.unit_key
          GROUP BY e.canonical, u.symbol),
        totals AS (SELECT canonical, sum(n) AS n_all, sum(CASE WHEN symbol IS NOT NULL THEN n END) AS n_unit FROM seen GROUP BY canonical),
        usual AS (SELECT s.canonical, s.symbol FROM seen s JOIN totals t ON s.canonical = t.canonical WHERE s.symbol IS NOT NULL AND s.n >= {USUAL} * t.n_unit),
        asked AS (
          SELECT c.raw, c.canonical, r.unit, r.other FROM {{rows}} r JOIN {{narrowed}} c ON r.raw = c.raw),
        by_unit AS (
          SELECT a.raw, a.canonical, sum(CASE WHEN w.symbol IS NOT NULL THEN 1 ELSE 0 END) AS pro, sum(CASE WHEN u.symbol IS NOT NULL AND w.symbol IS NULL THEN 1 ELSE 0 END) AS con
          FROM asked a LEFT JOIN {{units}} u ON {unit_symbol_sql(spark, 'a.unit')} = u.unit_key LEFT JOIN usual w ON a.canonical = w.canonical AND u.symbol = w.symbol
          GROUP BY a.raw, a.canonical),
        by_name AS (
          SELECT o.raw, o.canonical, sum(CASE WHEN e.canonical = o.canonical THEN 1 ELSE 0 END) AS pro, sum(CASE WHEN e.canonical <> o.canonical THEN 1 ELSE 0 END) AS con
          FROM (SELECT raw, canonical, explode(other) AS name FROM asked) o JOIN (
            SELECT raw, canonical FROM equal_ UNION SELECT canonical, canonical FROM equal_) e ON o.name = e.raw
          GROUP BY o.raw, o.canonical),
        votes AS (
          SELECT c.raw, c.canonical, c.distance, coalesce(u.pro, 0) + coalesce(n.pro, 0) AS pro, coalesce(u.con, 0) + coalesce(n.con, 0) AS con,
                 coalesce(t.n_unit, 0) < 0.5 * coalesce(t.n_all, 0) AND (SELECT sum(n_unit) FROM totals) > 0 AS unitless
          FROM {{narrowed}} c LEFT JOIN by_unit u ON c.raw = u.raw LEFT JOIN by_name n ON c.raw = n.raw LEFT JOIN totals t ON c.canonical = t.canonical)
        SELECT raw, canonical, distance FROM votes WHERE pro > con OR (unitless AND con = 0)
        """,
        found=found,
        pairs=pairs,
        rows=rows,
        narrowed=narrowed,
        units=_local(units),
    )


def map_to_canonical(
    facts: DataFrame,
    reference: DataFrame,
    id_col: str = "row_id",
    fields: tuple[str, ...] = ("predicate_raw", "attribute_name"),
    list_fields: tuple[str, ...] = ("predicate_raw",),
    unit_col: str | None = "单位",
) -> DataFrame:
    """One row per field that is filled and is not literally a canonical name: id, field_name, canonical, distance, rule.

    Fields of list_fields that hold several values are left out (they are split first, see the multi-value operator). Texts are
    matched once each, so a text that a third of all rows hold costs one match; the result is joined back on the text, where
    adaptive execution broadcasts the mapping if it is small and splits skewed partitions if it is not. The unit field, if there is
    one, serves to prove narrowed names. Null, empty and placeholder fields give no row. Other columns are ignored. The reference
    list is a small table; one of more than 100,000 entries raises an error.
    """
    spark = facts.sparkSession
    filled_ = {f: F.when(~is_blank(F.col(f"`{f}`")), F.col(f"`{f}`")) for f in fields}
    structs = [F.struct(F.lit(f).alias("field_name"), c.alias("raw")) for f, c in filled_.items()]
    unit = F.col(f"`{unit_col}`") if unit_col and unit_col in facts.columns else F.lit(None).cast("string")
    wide = facts.select(F.col(f"`{id_col}`").alias("id_"), unit.alias("unit"), F.array(*structs).alias("cells_"))
    exploded = wide.select("id_", "unit", "cells_", F.explode("cells_").alias("c")).where("c.raw is not null")
    canonical = reference.select(F.col("canonical").alias("raw")).where("raw is not null").distinct()
    cells = exploded.select("id_", "c.field_name", "c.raw").join(F.broadcast(_local(canonical)), "raw", "left_anti")
    pairs = cut_lineage(
        exploded.groupBy("c.raw", "unit").agg(F.count("*").alias("n"), F.bool_or(F.col("c.field_name").isin(*list_fields)).alias("may_list"))
    )
    texts = pairs.groupBy("raw").agg(F.bool_or("may_list").alias("may_list"))
    names = sorted({x for r in small_rows(reference.select("alias", "canonical").distinct()) for x in r if x})
    lists = split_values(texts.where("may_list").select("raw", F.col("raw").alias("text_")), names, id_col="raw", fields=("text_",)).select("raw").distinct()
    lists = lists.withColumn("is_list", F.lit(True))
    forms, found, narrowed = match_names(texts.select("raw"), reference)
    if not narrowed.isEmpty():
        others = F.transform(F.filter("cells_", lambda x: (x["field_name"] != F.col("c.field_name")) & x["raw"].isNotNull()), lambda x: x["raw"])
        rows = exploded.select("c.raw", "unit", others.alias("other"))
        found = cut_lineage(found.unionByName(proven(narrowed, found, pairs, rows).withColumn("rule", F.lit("proven"))))
    matched = spark.sql(
        f"""
        SELECT raw, canonical, distance, rule FROM {{found}}
        UNION ALL
        SELECT t.raw, '{UNMATCHED}', CAST(NULL AS INT), 'none' FROM {{forms}} t LEFT ANTI JOIN {{found}} f ON t.raw = f.raw
        """,
        found=found,
        forms=forms,
    ).join(lists, "raw", "left")
    return (
        cells.join(matched, "raw")
        .where(~(F.col("field_name").isin(*list_fields) & F.coalesce(F.col("is_list"), F.lit(False))))
        .select(F.col("id_").alias(id_col), "field_name", "canonical", "distance", "rule")
    )

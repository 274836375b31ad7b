"""Alignment of property labels to an ontology: candidates by equality and containment, a context score, margin and decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.cleanup import clean_property
from factweave.functions.values import compact


def candidates(labels: DataFrame, ontology: DataFrame, cap: int | None = None) -> DataFrame:
    """label, canonical_name, attribute_category, rule, score for distinct labels (column label).

    Equality with an alias (1.0) or a canonical name (.98), else containment: the pieces of a label of the length of some alias are
    joined by equality, so no label is compared with every alias; the score is the overlap. cap keeps the best of each label where a
    report asks for so many.
    """
    words = ontology.select(compact(F.col("alias")).alias("word"), "canonical_name", "attribute_category", F.lit("alias").alias("kind")).unionByName(
        ontology.select(compact(F.col("canonical_name")).alias("word"), "canonical_name", "attribute_category", F.lit("canonical").alias("kind"))
    ).where("word <> ''").distinct()
    sizes = words.select(F.length("word").alias("size")).distinct()
    clean = labels.select("label", compact(clean_property(F.col("label"))).alias("form")).where("form <> ''")
    equal = clean.join(words, F.col("form") == F.col("word")).select("label", "canonical_name", "attribute_category", F.concat(F.lit("equal_"), "kind").alias("rule"), F.when(F.col("kind") == "alias", 1.0).otherwise(0.98).alias("score"))
    rest = clean.join(equal.select("label").distinct(), "label", "left_anti")
    pieces = (
        rest.join(F.broadcast(sizes), F.col("size") < F.length("form"))
        .select("label", "form", "size", F.explode(F.transform(F.sequence(F.lit(1), F.length("form") - F.col("size") + 1), lambda i: F.substring(F.col("form"), i, F.col("size")))).alias("piece"))
        .distinct()
    )
    inside = pieces.join(words, F.col("piece") == F.col("word")).select("label", "canonical_name", "attribute_category", F.lit("contains").alias("rule"), F.round(F.col("size") / F.length("form"), 6).alias("score")).where("score >= 0.4")
    found = equal.unionByName(inside).groupBy("label", "canonical_name", "attribute_category").agg(F.max(F.struct("score", "rule")).alias("b")).select("label", "canonical_name", "attribute_category", "b.rule", "b.score")
    if cap is None:
        return found
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "canonical_name"))
    return found.withColumn("place", place).where(F.col("place") <= cap).drop("place")


def decide(found: DataFrame, context_score: float = 0.78, margin: float = 0.07) -> DataFrame:
    """label, canonical_name, score, margin, status: exact from .90 on, by context with a margin to the best different name, else
    ambiguous or weak."""
    best = found.groupBy("label", "canonical_name").agg(F.max("score").alias("score"))
    w = Window.partitionBy("label").orderBy(F.desc("score"), "canonical_name")
    ranked = best.withColumn("place", F.row_number().over(w)).withColumn("next_", F.lead("score").over(w)).where("place = 1")
    gap = F.round(F.col("score") - F.coalesce("next_", F.lit(0.0)), 6)
    status = F.when(F.col("score") >= 0.90, "exact").when((F.col("score") >= context_score) & (gap >= margin), "context").when(gap < margin, "ambiguous").otherwise("weak")
    return ranked.select("label", "canonical_name", "score", gap.alias("margin"), status.alias("status"))

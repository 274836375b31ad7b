"""Keys, duplicates, conflicts, merges and scored routing of facts."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.values import compact, decimal_text


def semantic_value(number: Column, lower: Column, upper: Column, text: Column) -> Column:
    """'num:', 'range:' or 'text:' and the canonical value, the first that is filled."""
    n, a, b = decimal_text(number), decimal_text(lower), decimal_text(upper)
    return F.when(n != "", F.concat(F.lit("num:"), n)).when((a != "") | (b != ""), F.concat(F.lit("range:"), a, F.lit("~"), b)).otherwise(F.concat(F.lit("text:"), compact(text)))


def semantic_key(subject: Column, prop: Column, value: Column, unit: Column, condition: Column) -> Column:
    """The key under which two facts say the same."""
    return F.concat_ws("|", compact(subject), compact(prop), value, compact(unit), compact(condition))


def keep_best(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Arg-max per key: the first row by `order` stays. The rows that go are not compared pairwise but counted: n_dropped.

    With partial aggregation, so that a key with very many rows is reduced before it is shuffled; order must end in a unique
    column. Columns of the row come back unchanged.
    """
    packed = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    best = rows.groupBy(*keys).agg(F.min_by(packed, F.struct(*order)).alias("b_"), (F.count("*") - 1).alias("n_dropped"))
    return best.select("b_.*", "n_dropped")


def conflicts(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Keys with more than one distinct value: the keys, n_values, n_rows."""
    return (
        rows.groupBy(*keys)
        .agg(F.count_distinct(value).alias("n_values"), F.count("*").alias("n_rows"))
        .where("n_values > 1")
    )


def corroborated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Every row with the number of rows of its key, by a pre-aggregated join instead of one window task per key."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("corroboration"))
    return rows.join(counted, keys)


def reasons(checks: Mapping[str, Column]) -> Column:
    """Sorted array of the names of the checks that hold."""
    return F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()])))


def penalized(score: Column, found: Column, penalties: Mapping[str, float], default: float) -> Column:
    """The score less the penalty of every reason, kept within 0..1."""
    table = F.create_map(*[x for k, v in penalties.items() for x in (F.lit(k), F.lit(float(v)))])
    total = F.aggregate(found, F.lit(0.0), lambda a, r: a + F.coalesce(F.try_element_at(table, r), F.lit(float(default))))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score - total))


def route(score: Column, release: Column, candidate: Column, hard: Column) -> Column:
    """'reject' for hard reasons, else 'release', 'candidate' or 'reject' by the score."""
    return F.when(hard, "reject").when(score >= release, "release").when(score >= candidate, "candidate").otherwise("reject")


def source_threshold(source: Column, thresholds: Mapping[str, float], prefixes: Mapping[str, float], default: float) -> Column:
    """The threshold of a source: its own, that of the longest prefix, or the default."""
    table = F.create_map(*[x for k, v in thresholds.items() for x in (F.lit(k), F.lit(float(v)))])
    by_prefix = reduce(lambda c, kv: F.when(source.startswith(kv[0]), F.lit(float(kv[1]))).otherwise(c), sorted(prefixes.items(), key=lambda kv: len(kv[0])), F.lit(float(default)))
    return F.coalesce(F.try_element_at(table, source), by_prefix)


def relink(steps: DataFrame, process: str, index: str, step: str) -> DataFrame:
    """Previous and next step of each step; a gap in the index breaks the chain."""
    order = Window.partitionBy(process).orderBy(index, step)
    near = lambda f, d: F.when(f(index).over(order) - F.col(index) == d, f(step).over(order))
    return steps.withColumns({"previous_step": near(F.lag, -1), "next_step": near(F.lead, 1)})


def chain_valid(steps: DataFrame, process: str, index: str, step: str) -> DataFrame:
    """Per process: n_steps, valid: indices 1..n without gap or repeat, n at least 2, unique steps."""
    return steps.groupBy(process).agg(
        F.count("*").alias("n_steps"),
        ((F.count("*") >= 2) & (F.min(index) == 1) & (F.max(index) == F.count("*")) & (F.count_distinct(index) == F.count("*")) & (F.count_distinct(step) == F.count("*"))).alias("valid"),
    )


def new_rows(rows: DataFrame, existing: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Conflict-do-nothing insert: the first row per key that the target does not hold yet."""
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in rows.columns if c not in keys]), F.struct(*order)).alias("b_")).select(*keys, "b_.*")
    return first.join(existing.select(*keys).distinct(), keys, "left_anti")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest version per key, by partial aggregation (max_by), no sort."""
    packed = F.struct(*[F.col(c) for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(packed, F.struct(*order)).alias("b_")).select(*keys, "b_.*")


def merged_routes(rows: DataFrame, signature: list[str], route_col: str, evidence: str, blanks: list[str]) -> DataFrame:
    """Rows of one signature merged: sorted set of routes, smallest evidence, the first filled value of each other field."""
    return rows.groupBy(*signature).agg(
        F.array_join(F.array_sort(F.collect_set(route_col)), "+").alias("routes"),
        F.min(evidence).alias(evidence),
        *[F.min(F.nullif(F.trim(b), F.lit(""))).alias(b) for b in blanks],
        F.count("*").alias("n_rows"),
    )


def subject_scores(rows: DataFrame, subject: str, table: str, source: str, confidence: Column) -> DataFrame:
    """Evidence per subject: n_evidence, n_tables, n_sources, score = mean confidence plus a boost that grows with log2 of the count,
    status by two thresholds."""
    counted = rows.groupBy(subject).agg(
        F.count("*").alias("n_evidence"), F.count_distinct(table).alias("n_tables"), F.count_distinct(source).alias("n_sources"), F.avg(confidence).alias("mean_")
    )
    score = F.round(F.least(F.lit(0.99), F.coalesce("mean_", F.lit(0.0)) * 0.7 + F.least(F.lit(0.22), F.log2(F.col("n_evidence") + 1) * 0.05) + F.when(F.col("n_sources") > 1, 0.05).otherwise(0.0)), 6)
    scored = counted.withColumn("score", score).drop("mean_")
    return scored.withColumn("status", F.when(F.col("score") >= 0.70, "confirmed").when(F.col("score") >= 0.42, "candidate").otherwise("rejected"))


def filtered(rows: DataFrame, wanted: Mapping[str, str | None], expansions: Mapping[str, Mapping[str, tuple[str, ...]]] | None = None) -> DataFrame:
    """The rows that equal what is wanted in each field; None asks for nothing. expansions: field -> value -> the values it stands for."""
    for field, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(field).isin(*(expansions or {}).get(field, {}).get(value, (value,))))
    return rows

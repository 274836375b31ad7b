"""Joins and rollups with a rule of their own: as-of, interval overlap, point in interval, theta mentions, snapshots, gold metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], bucket: str = "month") -> DataFrame:
    """Each left row with the values of the latest right row of its key at or before its time; nulls where there is none.

    Time is cut into buckets (a unit of date_trunc for timestamps, a width for numbers): inside a bucket a running last value over the
    union of both sides, before it the last value of the earlier buckets, of which there is one row a key and bucket. So a key with a
    third of all rows is spread over its buckets. At equal times right rows come first. Right columns must not be named like left ones.
    """
    numeric = left.schema[left_time].dataType.typeName() in ("integer", "long", "short", "double", "float")
    slot = (lambda c: F.floor(F.col(c) / int(bucket))) if numeric else (lambda c: F.date_trunc(bucket, c))
    packed = F.struct(*[F.col(v) for v in values])
    packed_type = right.select(packed.alias("p")).schema["p"].dataType
    a = left.select(*keys, slot(left_time).alias("slot_"), F.col(left_time).alias("t_"), F.lit(1).alias("side_"), F.struct(*left.columns).alias("row_"), F.lit(None).cast(packed_type).alias("p_"))
    b = right.select(*keys, slot(right_time).alias("slot_"), F.col(right_time).alias("t_"), F.lit(0).alias("side_"), F.lit(None).cast(a.schema["row_"].dataType).alias("row_"), packed.alias("p_"))
    inside = Window.partitionBy(*keys, "slot_").orderBy("t_", "side_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = a.unionByName(b).withColumn("near_", F.last("p_", ignorenulls=True).over(inside)).where("side_ = 1")
    slots = a.select(*keys, "slot_").distinct().withColumn("e_", F.lit(None).cast(packed_type))
    ends = b.groupBy(*keys, "slot_").agg(F.max_by("p_", "t_").alias("e_"))
    earlier = Window.partitionBy(*keys).orderBy("slot_").rowsBetween(Window.unboundedPreceding, -1)
    per_slot = slots.unionByName(ends).groupBy(*keys, "slot_").agg(F.first("e_", ignorenulls=True).alias("e_"))
    carried = per_slot.withColumn("far_", F.last("e_", ignorenulls=True).over(earlier)).drop("e_")
    found = running.join(carried, [*keys, "slot_"], "left").withColumn("found_", F.coalesce("near_", "far_"))
    return found.select("row_.*", "found_.*")


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], a_span: tuple[str, str], b_span: tuple[str, str], width: int) -> DataFrame:
    """Pairs of one key whose closed integer intervals overlap, found by equality on buckets of `width`: every interval is put into
    each bucket it touches and a pair is kept in the first bucket both share, so that no pair is compared across buckets."""
    bucket = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    left, right = a.withColumn("bucket_", bucket(*a_span)), b.withColumn("bucket_", bucket(*b_span))
    joined = left.join(right, [*keys, "bucket_"])
    first = F.floor(F.greatest(F.col(a_span[0]), F.col(b_span[0])) / width)
    return joined.where((F.col(a_span[0]) <= F.col(b_span[1])) & (F.col(b_span[0]) <= F.col(a_span[1])) & (F.col("bucket_") == first)).drop("bucket_")


def point_in_interval(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, span: tuple[str, str], width: int) -> DataFrame:
    """Points with the intervals of their key that hold them, by equality on buckets."""
    spread = intervals.withColumn("bucket_", F.explode(F.sequence(F.floor(F.col(span[0]) / width), F.floor(F.col(span[1]) / width))))
    return points.withColumn("bucket_", F.floor(F.col(point) / width)).join(spread, [*keys, "bucket_"]).where(F.col(point).between(F.col(span[0]), F.col(span[1]))).drop("bucket_")


def snapshot(rows: DataFrame, versions: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Latest versions and the rows that were never versioned, with their origin."""
    versioned = versions.select(key, *columns, F.lit("version").alias("origin"))
    raw = rows.join(versions.select(key).distinct(), key, "left_anti").select(key, *columns, F.lit("raw").alias("origin"))
    return versioned.unionByName(raw)


def percent(part: Column, whole: Column) -> Column:
    """Percent with one digit, halves to even; 0 of nothing."""
    return F.coalesce(F.bround(F.try_divide((part * 100).cast("double"), whole.cast("double")), 1), F.lit(0.0))


def gold_metrics(rows: DataFrame, correct: dict[str, Column], groupings: list[str]) -> DataFrame:
    """grouping, value, eligible and the accuracy of each measure (6 digits) over all rows and by each column, in one pass with
    grouping sets; a blank value has a bucket of its own."""
    named = rows.select(*[F.coalesce(F.nullif(F.trim(F.col(g)), F.lit("")), F.lit("(blank)")).alias(g) for g in groupings], *[c.alias(f"m_{n}") for n, c in correct.items()])
    sets = [[], *[[F.col(g)] for g in groupings]]
    grouped = named.groupingSets(sets, *[F.col(g) for g in groupings]).agg(
        F.count("*").alias("eligible"),
        *[F.round(F.try_divide(F.count_if(F.col(f"m_{n}")).cast("double"), F.count("*").cast("double")), 6).alias(n) for n in correct],
    )
    which = F.coalesce(*[F.when(F.col(g).isNotNull(), F.lit(g)) for g in groupings], F.lit("all"))
    value = F.coalesce(*[F.col(g) for g in groupings], F.lit("all"))
    return grouped.select(which.alias("grouping"), value.alias("value"), "eligible", *correct)


def round_robin(rows: DataFrame, stratum: str, order: list[Column], size: int) -> DataFrame:
    """A stratified sample: the strata give their rows in turn, in their own order, until `size` rows are taken."""
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    # no stratum can give more than `size`; said in the plan, that limits each stratum before the shuffle
    return rows.withColumn("turn", place).where(F.col("turn") <= size).orderBy("turn", stratum).limit(size)


def status_of(statuses: Column) -> Column:
    """One status for a group of them, by the first rule that holds."""
    every = lambda s: F.bool_and(statuses == s)
    some = lambda s: F.bool_or(statuses == s)
    return F.when(every("F"), "completed").when(some("P"), "partial").when(every("O"), "open").otherwise("running")

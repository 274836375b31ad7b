"""Deliveries of facts as a stream: repeats dropped within a watermark, late rows told apart, idempotent import, windowed counts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_deliveries(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def first_deliveries(stream: DataFrame, time_col: str, keys: list[str], within: str = "14 days") -> DataFrame:
    """Each key once; a repeat is recognised as long as it comes within the delay, and the state is dropped after it."""
    return stream.withWatermark(time_col, within).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time_col: str, by: str, window: str = "1 day", late: str = "14 days") -> DataFrame:
    """Rows per window and group, final once the watermark has passed."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, window).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def import_stream(stream: DataFrame, target: str, keys: list[str], checkpoint: str, order: list[str] | None = None, buckets: int = 64) -> StreamingQuery:
    """Append what the target does not hold yet: of the rows of one key the first in the order of the given columns, then of all others.

    A batch is written to a folder of its own number, so one that runs again after a failure replaces its own rows by the same rows
    and changes nothing else. Within it rows lie in buckets by a hash of their keys, and only the buckets that a batch touches are read
    to know what is there.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = F.struct(*[F.struct(F.col(c).isNull(), c) for c in [*(order or []), *[c for c in batch.columns if c not in (order or [])]]])
        fresh = batch.groupBy(*keys).agg(F.min_by(F.struct(*batch.columns), first).alias("r_")).select("r_.*")
        fresh = fresh.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        if _exists(spark, target):
            touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]
            held = spark.read.parquet(target).where((F.col("batch") != number) & F.col("bucket").isin(touched))
            fresh = fresh.join(held.select(*keys), keys, "left_anti")
        fresh.select(*batch.columns, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(os.path.join(target, f"batch={number}"))

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(stream: DataFrame, time_col: str, arrived_col: str, within: str = "14 days") -> DataFrame:
    """The rows with late: true where a row arrived later after its own time than the delay; null times are not late."""
    return stream.withColumn("late", F.coalesce(F.col(arrived_col) > F.col(time_col) + F.expr(f"INTERVAL {within}"), F.lit(False)))


def _exists(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)

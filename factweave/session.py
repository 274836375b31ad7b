"""Session defaults, table access and lineage cutting."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "factweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tested under; anything given in conf wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder the cluster names in spark.checkpoint.dir. Where none is set, a session on one machine uses a
    temporary folder; on a cluster that is an error, as executors do not share such a folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir names no folder that the executors share")
            folder = os.path.join(tempfile.gettempdir(), "factweave-checkpoint")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def small_rows(df: DataFrame, limit: int = 100_000) -> list:
    """Collect a table that is small by its nature (a dimension, a histogram), refusing one that is not."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"table of more than {limit} rows where a small one was expected")
    return rows


def spread_join(rows: DataFrame, mapping: DataFrame, key: str, by: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """rows joined to a mapping that has one row a key, where one key may hold a third of all rows: rows are told apart by a hash of the
    column `by`, and the mapping is there once for each of the `salts` values of it."""
    told = rows.withColumn("salt_", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    copied = mapping.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return told.join(copied, [key, "salt_"], how).drop("salt_")

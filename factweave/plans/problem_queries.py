"""Queries of the general training-data problems (2 and 5) over the whole fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factweave.operators.multivalue import split_values
from factweave.operators.units import recorded_in_other_unit, to_common_units
from factweave.session import small_rows, table

FACTS = "graph_import_ready_generalized"


def reference_names(spark: SparkSession, directory: str) -> list[str]:
    """All names of the property reference list, a fixed table."""
    rows = small_rows(table(spark, directory, "supplementary_property_aliases").select("alias", "canonical").distinct())
    return sorted({x for r in rows for x in r if x})


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    values = split_values(table(spark, directory, FACTS), reference_names(spark, directory))
    return values.select("row_id", "field_name", "pos")


def p2_values(spark: SparkSession, directory: str) -> DataFrame:
    """Every value of both fields, single ones too."""
    return split_values(table(spark, directory, FACTS), reference_names(spark, directory), keep_single=True)


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return recorded_in_other_unit(table(spark, directory, FACTS), table(spark, directory, "unit_reference"))


def p5_common_units(spark: SparkSession, directory: str) -> DataFrame:
    """Every quantity with a unit, converted."""
    return to_common_units(table(spark, directory, FACTS), table(spark, directory, "unit_reference"))


QUERIES = {"p2_found": p2_found, "p2_values": p2_values, "p5_found": p5_found, "p5_common_units": p5_common_units}
ORACLE: dict[str, str] = {}

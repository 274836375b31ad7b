"""Problem 5: quantities recorded in different units and scales, brought to the common unit of their dimension."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.functions.blank import is_blank
from factweave.functions.quantity import Quantity, read_quantity, to_number
from factweave.functions.units import CONVERSION, context_dimension, resolve_unit, unit_key

QUANTITY = T.StructType(
    [
        T.StructField("number", T.DoubleType()),
        T.StructField("lower", T.DoubleType()),
        T.StructField("upper", T.DoubleType()),
        T.StructField("comparator", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("power", T.IntegerType()),
        T.StructField("unit_from", T.StringType()),
    ]
)

# Digits of any width; a text without one states no quantity.
HAS_DIGIT = r"[0-9０-９]"


@lru_cache(maxsize=65536)
def _quantity(text: str | None, dimension: str | None) -> Quantity | None:
    return read_quantity(text, dimension)


@lru_cache(maxsize=16384)
def _dimension(name: str | None) -> str | None:
    return context_dimension(name)


@lru_cache(maxsize=16384)
def _unit(text: str | None) -> tuple[str, int] | None:
    return resolve_unit(text)


@lru_cache(maxsize=16384)
def _number(text: str | None) -> float | None:
    return to_number(unit_key(text)) if text else None


def combine(text: str | None, number: str | None, unit: str | None, name: str | None = None) -> tuple:
    """The quantity of one record: the unit in the text decides, then the unit field; the number field fills in for a text without one.
    The property name resolves what is ambiguous: which of several quantities is meant, and units that case alone keeps apart."""
    found = _quantity(text, _dimension(name))
    symbol, power, origin = (found.symbol, found.power, "text") if found and found.symbol else (None, 0, None)
    if symbol is None:
        named = _unit(unit)
        if named:
            symbol, power, origin = named[0], named[1], "field"
    value, lower, upper, comparator = (found.number, found.lower, found.upper, found.comparator) if found else (_number(number), None, None, None)
    return value, lower, upper, comparator, symbol, power, origin


@F.pandas_udf(QUANTITY)
def read_record(text: pd.Series, number: pd.Series, unit: pd.Series, name: pd.Series) -> pd.DataFrame:
    rows = [combine(*x) for x in zip(text, number, unit, name, strict=True)]
    return pd.DataFrame(rows, columns=[f.name for f in QUANTITY.fields]).astype({"power": "int32"})


def conversion_table(reference: DataFrame) -> DataFrame:
    """unit_symbol, dimension, common_unit, factor, offset_ of the reference list; a symbol without a known factor has none."""
    rows = [(symbol, factor, offset) for symbol, (factor, offset) in CONVERSION.items()]
    factors = reference.sparkSession.createDataFrame(rows, "unit_symbol string, factor double, offset_ double")
    return F.broadcast(reference.select("unit_symbol", "dimension", "common_unit").distinct().join(F.broadcast(factors), "unit_symbol", "left"))


def to_common_units(
    facts: DataFrame,
    reference: DataFrame,
    id_col: str = "row_id",
    text_col: str = "尾实体/取值文本",
    number_col: str = "数值",
    unit_col: str = "单位",
    name_cols: tuple[str, ...] = ("attribute_name", "predicate_raw"),
) -> DataFrame:
    """One row per record with a quantity and a unit: id, number, lower_bound, upper_bound, comparator, unit_symbol, dimension,
    common_unit, common_value, common_lower, common_upper, unit_from.

    The unit of the quantity in the text decides, then the unit field; test conditions and units behind property names are not
    read as units of the quantity; a power of ten before the unit scales the number. The factor table is the fixed reference
    list (its size does not follow the data) and is broadcast; nothing is shuffled. Null, empty and placeholder fields give no
    row; repeated ids are each kept; other columns of the input are ignored.
    """
    text, number, unit = F.col(f"`{text_col}`"), F.col(f"`{number_col}`"), F.col(f"`{unit_col}`")
    blank_to_null = lambda c: F.when(~is_blank(c), c)
    there = [blank_to_null(F.col(f"`{c}`")) for c in name_cols if c in facts.columns]
    names = F.coalesce(*there) if there else F.lit(None).cast("string")
    narrow = facts.select(
        F.col(f"`{id_col}`").alias("id_"), blank_to_null(text).alias("text_"), blank_to_null(number).alias("number_"), blank_to_null(unit).alias("unit_"), names.alias("name_")
    ).where(F.col("text_").rlike(HAS_DIGIT) | F.col("number_").rlike(HAS_DIGIT))
    read = narrow.select("id_", read_record("text_", "number_", "unit_", "name_").alias("q")).where("q.symbol is not null")
    scale = F.pow(F.lit(10.0), F.col("q.power").cast("double"))
    convert: "callable[[Column], Column]" = lambda c: c * scale * F.col("factor") + F.col("offset_")
    return read.join(conversion_table(reference), F.col("q.symbol") == F.col("unit_symbol")).select(
        F.col("id_").alias(id_col),
        (F.col("q.number") * scale).alias("number"),
        (F.col("q.lower") * scale).alias("lower_bound"),
        (F.col("q.upper") * scale).alias("upper_bound"),
        F.col("q.comparator").alias("comparator"),
        "unit_symbol",
        "dimension",
        "common_unit",
        convert(F.col("q.number")).alias("common_value"),
        convert(F.col("q.lower")).alias("common_lower"),
        convert(F.col("q.upper")).alias("common_upper"),
        F.col("q.unit_from").alias("unit_from"),
    )


def recorded_in_other_unit(facts: DataFrame, reference: DataFrame, **columns: str) -> DataFrame:
    """Ids whose quantity is recorded in a unit other than the common one of its dimension, with that unit."""
    id_col = columns.get("id_col", "row_id")
    return to_common_units(facts, reference, **columns).where("unit_symbol <> common_unit").select(id_col, "unit_symbol").distinct()

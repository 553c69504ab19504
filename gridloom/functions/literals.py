"""Typed literals, and integer ranges by end points."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gridloom.model import BITS, DArray, limits, literal


def typed(value, dtype: str) -> Column:
    """A literal of a logical type; an integer that the type can't hold is an error."""
    if dtype in BITS:
        low, high = limits(dtype)
        if int(value) != value or not low <= value <= high:
            raise ValueError(f"{value} isn't of type {dtype}")
    return literal(value, dtype)


def i8(v) -> Column:
    return typed(v, "int8")


def i16(v) -> Column:
    return typed(v, "int16")


def i32(v) -> Column:
    return typed(v, "int32")


def i64(v) -> Column:
    return typed(v, "int64")


def u8(v) -> Column:
    return typed(v, "uint8")


def u16(v) -> Column:
    return typed(v, "uint16")


def u32(v) -> Column:
    return typed(v, "uint32")


def u64(v) -> Column:
    return typed(v, "uint64")


def int_linspace(spark: SparkSession, start: int, stop: int, n: int) -> DArray:
    """`n` integers from start to stop as evenly as integers can be, generated where they are used."""
    if n < 2:
        raise ValueError("need at least two points")
    at = F.col("id").cast("decimal(38,0)")
    value = F.floor(at * (stop - start) / (n - 1)).cast("bigint") + start
    return DArray(spark.range(n).select((F.col("id") + 1).alias("i"), value.alias("v")), ("i",), "v", (n,), "int64")


def get_backend(array: DArray) -> str:
    """Where an array is processed; there is one backend."""
    return "spark"


def synchronize(array: DArray | None = None) -> None:
    """Nothing to wait for: actions return when they are done."""

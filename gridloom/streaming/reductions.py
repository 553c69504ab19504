"""Reductions of a streaming DataFrame with the same operations as of an array.

State is one row per key (and window): Spark keeps partial aggregates, since every operation is a monoid.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.monoids import Op, monoid
from gridloom.model import literal, logical_type, storage


def _total(df: DataFrame, f: Callable[[Column], Column] | None, op: Op, value: str, init) -> Column:
    v = f(F.col(value)) if f else F.col(value)
    kind = logical_type(df.select(v.alias("x")).schema["x"].dataType)
    m = monoid(op)
    total = m.total(v, kind)
    if total is None:
        raise ValueError(f"{m.name} of {kind} has no incremental aggregate")
    return m.combine(literal(init, kind), total.cast(storage(kind)), kind)


def running_reduce(stream: DataFrame, op: Op, value: str, keys: Sequence[str] = (), f: Callable | None = None, init=0) -> DataFrame:
    """`op(init, fold(op, f.(value)))` of all rows so far, by key. For update or complete output."""
    grouped = stream.groupBy(*keys) if keys else stream.groupBy(F.lit(1).alias("_all"))
    out = grouped.agg(_total(stream, f, op, value, init).alias("v"))
    return out if keys else out.drop("_all")


def windowed_reduce(stream: DataFrame, op: Op, value: str, time: str, width: str, late: str, keys: Sequence[str] = (), f: Callable | None = None, init=0) -> DataFrame:
    """The same for each tumbling window; rows later than `late` don't count, so state is bounded."""
    held = stream.withWatermark(time, late)
    return held.groupBy(F.window(time, width), *keys).agg(_total(stream, f, op, value, init).alias("v"))

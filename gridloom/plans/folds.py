"""Ordered folds by bucket for operations without a native aggregate.

Values of a key are folded in buckets of consecutive positions, and the results again, until one is left.
No task holds more than `size` values of a bucket at once, and the order of operands is kept.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.plans.opaque import from_python, to_python


def column_fold(df: DataFrame, keys: list[str], op: Callable[[Column, Column], Column], kind: str, n: int, size: int) -> DataFrame:
    """`(keys, i, v)` to `(keys, v)`: at most n positions a key."""
    while True:
        df = df.withColumn("_b", F.floor((F.col("i") - 1) / size))
        rows = df.groupBy(*keys, "_b").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("_x"))
        rest = F.slice("_x", F.lit(2), F.greatest(F.size("_x") - 1, F.lit(0)))
        df = rows.select(*keys, (F.col("_b") + 1).alias("i"), F.aggregate(rest, F.col("_x")[0]["v"].cast(kind), lambda s, x: op(s, x["v"]).cast(kind)).alias("v"))
        if n <= size:
            return df.drop("i")
        n = -(-n // size)


def python_fold(df: DataFrame, keys: list[str], op: Callable, n: int, size: int, init) -> DataFrame:
    """`(keys, i, v)` to `(keys, v)`, which is `op(init, fold)`, by a function of two Python values."""
    def folded(last: bool) -> Callable[[pa.Table], pa.Table]:
        def fold(table: pa.Table) -> pa.Table:
            table = table.sort_by("i")
            total = reduce(op, to_python(table.column("v")))
            at = table.schema.get_field_index("v")
            return table.slice(0, 1).set_column(at, "v", from_python([op(init, total) if last else total], table.schema.field(at).type))

        return fold

    while True:
        df = df.select(*keys, "i", "v", F.floor((F.col("i") - 1) / size).alias("_b"))
        df = df.groupBy(*keys, "_b").applyInArrow(folded(n <= size), df.schema).select(*keys, (F.col("_b") + 1).alias("i"), "v")
        if n <= size:
            return df.drop("i")
        n = -(-n // size)

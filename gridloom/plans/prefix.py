"""Prefix scans over an explicit dense index by two levels, repeated while the totals are many.

A row's bucket is floor((i - 1) / size), so it depends on the index alone. Buckets are scanned locally, their
totals are scanned by the same plan, and each row joins its bucket's carry on the left, which keeps the order
of operands for operations that don't commute.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.plans.opaque import from_python, to_python

Combine = Callable[[Column, Column], Column]
#: An aggregate of a column; the second argument is applied to each aggregate function in it.
Aggregate = Callable[[Column, Callable[[Column], Column]], Column]


def _window(keys: list[str], exclusive: bool):
    return Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)


def native_scan(df: DataFrame, keys: list[str], agg: Aggregate, combine: Combine, n: int, size: int, exclusive: bool) -> DataFrame:
    """`(keys, i, v)` to the same with the scan in `v` (null for nothing), n rows a key at most."""
    if n <= size:
        return df.withColumn("v", agg(F.col("v"), lambda c: c.over(_window(keys, exclusive))))
    bucketed = df.withColumn("_b", F.floor((F.col("i") - 1) / size))
    local = bucketed.withColumn("v", agg(F.col("v"), lambda c: c.over(_window([*keys, "_b"], exclusive))))
    totals = bucketed.groupBy(*keys, "_b").agg(agg(F.col("v"), lambda c: c).alias("v"))
    return _carried(local, totals, keys, lambda t, m: native_scan(t, keys, agg, combine, m, size, True), combine, n, size)


def _carried(local: DataFrame, totals: DataFrame, keys: list[str], scan: Callable[[DataFrame, int], DataFrame], combine: Combine, n: int, size: int) -> DataFrame:
    carry = scan(totals.select(*keys, (F.col("_b") + 1).alias("i"), "v"), -(-n // size))
    carry = carry.select(*keys, (F.col("i") - 1).alias("_b"), F.col("v").alias("_carry"))
    both = local.join(carry, [*keys, "_b"], "left")
    v, c = F.col("v"), F.col("_carry")
    return both.withColumn("v", F.when(c.isNull(), v).when(v.isNull(), c).otherwise(combine(c, v))).drop("_b", "_carry")


def _combined(op: Combine, kind: str, reach: int) -> Combine:
    return lambda v, k: F.when(k >= reach, op(F.get("_s", k - reach), v).cast(kind)).otherwise(v)


def column_scan(df: DataFrame, keys: list[str], op: Combine, kind: str, n: int, size: int, exclusive: bool) -> DataFrame:
    """A scan by any associative Column function `op(a, b)`: each bucket of at most `size` values is an array, in which
    values are combined with those 1, 2, 4, ... places before."""
    bucketed = df.select(*keys, "i", "v", F.floor((F.col("i") - 1) / size).alias("_b"))
    rows = bucketed.groupBy(*keys, "_b").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("_x"))
    rows = rows.withColumn("_s", F.transform("_x", lambda x: x["v"].cast(kind)))
    reach = 1
    while reach < min(size, n):
        rows = rows.withColumn("_s", F.transform("_s", _combined(op, kind, reach)))
        reach *= 2
    # side by side, so that no row carries the whole bucket
    values = F.concat(F.array(F.lit(None).cast(kind)), F.slice("_s", F.lit(1), F.size("_s") - 1)) if exclusive else F.col("_s")
    local = rows.select(*keys, "_b", F.col("_x.i").alias("_i"), values.alias("_v")).select(*keys, "_b", F.explode(F.arrays_zip("_i", "_v")).alias("_c"))
    local = local.select(*keys, F.col("_c._i").alias("i"), "_b", F.col("_c._v").alias("v"))
    if n <= size:
        return local.drop("_b")
    totals = rows.select(*keys, "_b", F.element_at("_s", -1).alias("v"))
    return _carried(local, totals, keys, lambda t, m: column_scan(t, keys, op, kind, m, size, True), op, n, size)


def python_scan(df: DataFrame, keys: list[str], op: Callable, n: int, size: int, exclusive: bool, start: tuple = ()) -> DataFrame:
    """A scan by an opaque Python function of two values, a bucket at a time; `start` holds what all begin with, if anything.

    Each row gets its value and what is combined on the left of it, so carries are Python calls too. Whether there is
    anything on the left is a column of its own (`_has`), since any value may be a result.
    """
    bucketed = df.select(*keys, "i", "v", F.floor((F.col("i") - 1) / size).alias("_b"))

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        at = table.schema.get_field_index("v")
        return table.slice(0, 1).set_column(at, "v", from_python([reduce(op, to_python(table.column("v")))], table.schema.field(at).type))

    def scan(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        at, carry = table.schema.get_field_index("v"), table.column("_carry").slice(0, 1).combine_chunks()
        left = to_python(carry.field(0)) if carry.is_valid()[0].as_py() else []
        run = list(itertools.accumulate([*left, *to_python(table.column("v"))], op))
        values = run[:-1] if exclusive else run[len(left) :]
        values = [op(start[0], x) for x in values] if start else values
        none = table.num_rows - len(values)  # an exclusive scan's first row has nothing on its left
        values = [*(start if none and start else [None] * none), *values]
        out = table.set_column(at, "v", from_python(values, table.schema.field(at).type)).drop_columns(["_carry", "_b"])
        return out.append_column("_has", pa.array([k >= none or bool(start) for k in range(table.num_rows)]))

    kind = bucketed.schema["v"].dataType.simpleString()
    none = F.lit(None).cast(f"struct<v:{kind}>").alias("_carry")
    if n <= size:
        joined = bucketed.select("*", none)
    else:
        totals = bucketed.groupBy(*keys, "_b").applyInArrow(fold, bucketed.schema).select(*keys, (F.col("_b") + 1).alias("i"), "v")
        carry = python_scan(totals, keys, op, -(-n // size), size, True).where("_has")
        joined = bucketed.join(carry.select(*keys, (F.col("i") - 1).alias("_b"), F.struct("v").alias("_carry")), [*keys, "_b"], "left").select(*bucketed.columns, "_carry")
    out = joined.groupBy(*keys, "_b").applyInArrow(scan, T.StructType([*[f for f in bucketed.schema if f.name != "_b"], T.StructField("_has", T.BooleanType())]))
    return out.drop("_has") if start else out

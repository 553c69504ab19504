"""Reductions over a whole array or along axes: `op(init, fold(op, f.(src)))`, of the type of `init`.

Named operations are native aggregates with map-side combine. Integer products and Column functions are
folded by buckets of consecutive positions in as many levels as the length needs; so are Python functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import replace
from functools import reduce as fold
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.errors import DimensionMismatch
from gridloom.functions.monoids import REGISTRY, Monoid, Op, fitting, monoid, product, wrapped_product, wrapped_sum
from gridloom.functions.tuning import NONE, Tuning
from gridloom.model import BITS, FLOATS, DArray, Scalar, literal, logical_type, storage
from gridloom.plans.folds import column_fold, python_fold
from gridloom.plans.opaque import called

BUCKET = 4096
ALL = ":"


def axes(dims, ndim: int) -> list[int] | None:
    """The axes to reduce, without repeats and those beyond the array; None for all."""
    if dims is None or dims == ALL:
        return None
    each = [dims] if isinstance(dims, (int, float)) and not isinstance(dims, bool) else list(dims) if isinstance(dims, Iterable) else [dims]
    if any(isinstance(d, bool) or not isinstance(d, int) or d < 1 for d in each):
        raise ValueError("dims must be positive integers")
    return sorted({d for d in each if d <= ndim})


def _type_of(init, array: DArray, dtype: str | None) -> str:
    if dtype:
        return dtype
    if isinstance(init, Column):
        return logical_type(array.df.select(init.alias("x")).schema["x"].dataType)
    if isinstance(init, bool):
        return "bool"
    if isinstance(init, int):
        return array.dtype if array.dtype in BITS else "int64"
    if isinstance(init, float):
        return array.dtype if array.dtype in FLOATS else "float64"
    return "complex128" if isinstance(init, complex) else array.dtype


def _grid(known: DArray, kept: list[int]) -> DataFrame:
    """All kept index combinations, for results where the reduced axes are empty."""
    spark, shape = known.df.sparkSession, [known.shape[d - 1] for d in kept]
    rest, cols = F.col("id"), []
    for d, size in zip(kept, shape, strict=True):
        cols.append((rest % size + 1).alias(known.index[d - 1]))
        rest = F.floor(rest / size)
    return spark.range(fold(mul, shape, 1)).select(*cols)


def mapreduce(f: Callable | None, op: Op, *arrays: DArray, init, neutral=None, dims=None, dtype: str | None = None, python: bool = False, python_f: str | None = None, wrap: bool = False, bucket: int | None = None, tuning: Tuning = NONE) -> Scalar | DArray:
    """`f` takes one value from each array (None: the value itself); all arrays must have the same axes.

    `dims`: an axis or several (counted from 1), ":" or None for all. Along axes the result keeps its rank
    and reduced axes have size 1. Reduced axes of size 0 give `init` everywhere; a kept axis of size 0 gives an
    empty array; no axis within the array gives `op(init, f(x))`. `wrap`: integer sums and products wrap around instead
    of failing on overflow. `python`: `op` is a function of two Python values. `python_f`: `f` is a function of Python
    values, and this is the type of its results.
    """
    tuning.checked(most_block=512)
    if not arrays:
        raise TypeError("mapreduce needs an array")
    array = zipped(*arrays) if len(arrays) > 1 else arrays[0]
    values = [F.col(f"_{k}") for k in range(len(arrays))] if len(arrays) > 1 else [F.col(array.value)]
    if f is None and len(values) > 1:
        raise TypeError("several arrays need a function")
    kind = _type_of(init, array, dtype)
    which = axes(dims, array.ndim)
    m = Monoid("python", lambda d: neutral, lambda a, b, d: a, lambda v, d, over: None) if python else monoid(op, neutral)
    if wrap and m.name == "*" and kind in BITS:
        m = replace(m, combine=wrapped_product, agg=lambda v, d, over: None)
    exact = False
    value = called(f, values, python_f) if f and python_f else f(*values) if f else values[0]
    first = init.cast(_result(kind, m)) if m.name == "extrema" else literal(init, kind)

    def finish(total: Column) -> Column:
        if python:  # folds begin with init already; of nothing it is init
            return F.coalesce(total, literal(init, kind))
        start = m.neutral(kind)
        total = F.coalesce(total, start if isinstance(start, Column) else literal(start, kind))
        return fitting(product(first, total)) if exact else m.combine(first, total, kind)

    if which is not None and not which and python:
        return array.select(called(lambda x: op(init, x), [value.cast(storage(kind))], kind), kind)
    if which is not None and not which:
        return array.select(finish(value.cast(storage(kind)) if m.name != "extrema" else F.struct(value.alias("min"), value.alias("max"))), kind)
    source_kind = logical_type(array.df.select(value.alias("x")).schema["x"].dataType)
    source_kind = array.dtype if source_kind == storage(array.dtype) else source_kind
    native = m.native(source_kind)
    # only the whole product must fit: parts of it may not (uint64 has no signs, and is a decimal already)
    exact = m.combine is REGISTRY["*"].combine and kind in BITS and kind != "uint64" and not native
    # sums widen before they narrow to the result's type
    total = None if not native else wrapped_sum(value, kind) if wrap and m.name == "+" and kind in BITS else m.total(value, source_kind)

    def folded(keys: list[str], at: Column, n: int) -> DataFrame:
        rows = array.df.select(*keys, at.cast("bigint").alias("i"), value.cast(storage(kind)).alias("v"))
        size = bucket or tuning.bucket(n, BUCKET)
        if exact:
            return column_fold(rows, keys, product, "decimal(19,0)", n, size)
        return python_fold(rows, keys, op, n, size, init) if python else column_fold(rows, keys, lambda a, b: m.combine(a, b, kind), storage(kind), n, size)

    if which is None:
        if native:
            out = array.df.agg(total.alias("v"))
        else:
            known = array.known()
            out = folded([], known.linear(), max(1, len(known))) if len(known) else known.df.select(F.col(known.value).cast(storage(kind)).alias("v"))
            out = out.agg(F.first("v").alias("v"))  # one row, also for none
        return Scalar(out.select(finish(F.col("v")).cast(_result(kind, m)).alias("v")), kind)
    kept = [d for d in range(1, array.ndim + 1) if d not in which]
    keys = [array.index[d - 1] for d in kept]
    known = array.known()
    shape = tuple(1 if d in which else known.shape[d - 1] for d in range(1, array.ndim + 1))
    if any(known.shape[d - 1] == 0 for d in which):
        out = _grid(known, kept).withColumn("v", F.lit(None).cast(_result(kind, m))) if all(known.shape[d - 1] for d in kept) else _grid(known, kept).limit(0).withColumn("v", F.lit(None).cast(_result(kind, m)))
    elif native:
        out = known.df.groupBy(*keys).agg(total.alias("v"))
    else:
        at, stride = F.lit(1).cast("bigint"), 1
        for d in which:
            at, stride = at + (F.col(known.index[d - 1]) - 1) * stride, stride * known.shape[d - 1]
        out = folded(keys, at, stride)
    place = [F.lit(1).cast("bigint").alias(c) if d in which else F.col(c).cast("bigint") for d, c in enumerate(array.index, 1)]
    return DArray(out.select(*place, finish(F.col("v")).cast(_result(kind, m)).alias("v")), array.index, "v", shape, kind)


def _result(kind: str, m: Monoid) -> str:
    return f"struct<min:{storage(kind)},max:{storage(kind)}>" if m.name == "extrema" else storage(kind)


def reduce(op: Op, array: DArray, *, init, neutral=None, dims=None, dtype: str | None = None, python: bool = False, wrap: bool = False, bucket: int | None = None, tuning: Tuning = NONE) -> Scalar | DArray:
    return mapreduce(None, op, array, init=init, neutral=neutral, dims=dims, dtype=dtype, python=python, wrap=wrap, bucket=bucket, tuning=tuning)


def zipped(*arrays: DArray) -> DArray:
    """Arrays of the same axes side by side, as `_0, _1, ...`. Columns of one DataFrame need no join."""
    first = arrays[0]
    if any(a.ndim != first.ndim for a in arrays):
        raise DimensionMismatch("arrays differ in rank")
    if all(a.df is first.df and a.index == first.index for a in arrays):
        df = first.df.select(*first.index, *[F.col(a.value).alias(f"_{k}") for k, a in enumerate(arrays)])
        return replace(first, df=df, value="_0")
    known = [a.known() for a in arrays]
    if len({a.shape for a in known}) > 1:
        raise DimensionMismatch(f"arrays differ in shape: {[a.shape for a in known]}")
    df = None
    for k, a in enumerate(known):
        part = a.df.select(*[F.col(c).alias(n) for c, n in zip(a.index, first.index, strict=True)], F.col(a.value).alias(f"_{k}"))
        df = part if df is None else df.join(part, list(first.index))
    return DArray(df, first.index, "_0", known[0].shape, first.dtype)

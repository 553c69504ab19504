"""Loops, maps and reversal: projections without a shuffle where the function is a Column function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.tuning import NONE, Tuning
from gridloom.model import DArray, exact_cast, storage
from gridloom.operators.reduce import zipped
from gridloom.plans.opaque import called


def _applied(f: Callable, array: DArray, kind: str, python: bool | str) -> Column:
    return called(f, [F.col(array.value)], kind, python == "batch") if python else f(F.col(array.value))


def foreachindex(f: Callable[..., Column], array: DArray, *others: DArray, dtype: str | None = None, python: bool | str = False, tuning: Tuning = NONE) -> DArray:
    """The body `f(value, ..., i1, i2, ...)` of a loop over every index, whose result is the new value there.

    It gets the value of each array, all of the same axes, and then the index. `python`: it is a function of Python
    values, or with "batch" of Arrow arrays.
    """
    tuning.checked()
    both = zipped(array, *others) if others else array
    values = [F.col(f"_{k}") for k in range(1 + len(others))] if others else [F.col(array.value)]
    arguments = [*values, *[F.col(c) for c in both.index]]
    return both.select(called(f, arguments, dtype or array.dtype, python == "batch") if python else f(*arguments), dtype or array.dtype)


def foraxes(f: Callable, array: DArray, dims: int | None = None, dtype: str | None = None, python: bool = False, tuning: Tuning = NONE) -> DArray:
    """A loop over one axis. The body gets the place on the axis and all values there, in linear order of
    the other axes, as an array column, and gives an array column of the same length.

    Without `dims` it is `foreachindex`. One slice is one row, so the other axes must fit one. `python`: the body is a
    function of a number and a list that gives a list.
    """
    tuning.checked()
    if dims is None:
        return foreachindex(f, array, dtype=dtype, python=python, tuning=tuning)
    if not 1 <= dims <= array.ndim:
        raise ValueError(f"dims must be 1 to {array.ndim}")
    known, axis, kind = array.known(), array.index[dims - 1], storage(dtype or array.dtype)
    rest = [c for c in array.index if c != axis]
    cell = F.struct(known.linear().alias("_at"), *rest, F.col(array.value).alias("v"))
    rows = array.df.groupBy(axis).agg(F.array_sort(F.collect_list(cell)).alias("_x"))
    made = called(f, [F.col(axis), F.col("_x.v")], f"array<{kind}>") if python else f(F.col(axis), F.col("_x.v")).cast(f"array<{kind}>")
    # side by side, so that no row carries the whole slice
    rows = rows.withColumn("_y", made).select(axis, F.explode(F.arrays_zip("_x", "_y")).alias("_c"))
    out = rows.select(*[F.col(c) if c == axis else F.col(f"_c._x.{c}") for c in array.index], F.col("_c._y").alias("v"))
    return DArray(out, array.index, "v", known.shape, dtype or array.dtype)


def map(f: Callable, array: DArray, tuning: Tuning = NONE, python: bool | str = False) -> DArray:
    """`f` of every value, in the source's element type; a value it can't hold is an error at run time. `python`: `f` is a
    function of a Python value, or with "batch" of an Arrow array."""
    tuning.checked()
    value = _applied(f, array, array.dtype, python)
    return array.select(exact_cast(value, array.dtype) if array.dtype.startswith(("int", "uint")) else value)


def map_(f: Callable, target: DArray, array: DArray, tuning: Tuning = NONE, python: bool | str = False) -> DArray:
    """`map` into the destination's element type; both must be equally long. Index columns are the source's."""
    tuning.checked()
    if len(target) != len(array):
        raise ValueError("destination and source differ in length")
    value = _applied(f, array, target.dtype, python)
    return array.select(exact_cast(value, target.dtype) if target.dtype.startswith(("int", "uint")) else value, target.dtype)


def reverse(array: DArray, tuning: Tuning = NONE) -> DArray:
    """Linear order backwards: the value at i moves to n + 1 - i. A projection."""
    tuning.checked()
    known = array.known()
    # reversing a column-major order reverses each axis
    index = [(F.lit(size + 1) - F.col(c)).cast("bigint").alias(c) for c, size in zip(known.index, known.shape, strict=True)]
    return DArray(known.df.select(*index, F.col(known.value).alias("v")), known.index, "v", known.shape, known.dtype)


def reverse_(target: DArray, array: DArray | None = None, tuning: Tuning = NONE) -> DArray:
    """`reverse_(array)`, or the reverse of `array` in the type of a destination of the same length."""
    if array is None:
        return reverse(target, tuning)
    if len(target) != len(array):
        raise ValueError("destination and source differ in length")
    out = reverse(array, tuning)
    return out.select(F.col("v"), target.dtype)


def compact(predicate: Callable[[Column], Column], array: DArray, tuning: Tuning = NONE) -> DArray:
    """The values that satisfy a predicate, with dense new indices: an exclusive scan of the predicate."""
    from gridloom.operators.scan import accumulate

    known = array.known()
    kept = F.col(known.value)
    flags = DArray(known.df.select(known.linear().alias("i"), predicate(kept).cast("bigint").alias("v"), kept.alias("_kept")), ("i",), "v", (len(known),), "int64")
    placed = accumulate("+", flags, init=0, inclusive=False, carry=("_kept",), tuning=tuning).df
    rows = placed.where(predicate(F.col("_kept"))).select((F.col("v") + 1).alias("i"), F.col("_kept").alias("v"))
    return DArray(rows, ("i",), "v", None, known.dtype)

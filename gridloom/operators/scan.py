"""Prefix scans: `y_k = op(init, x_1 .. x_k)`, or up to `x_(k-1)` if exclusive.

Along an axis a scan is a window per line. Over the linear order it is a plain window for up to `bucket`
values and else two levels of buckets, so no task sorts the whole array.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.monoids import Monoid, Op, monoid, wrapped, wrapped_product
from gridloom.functions.tuning import NONE, Tuning
from gridloom.model import BITS, FLOATS, DArray, literal, storage
from gridloom.plans.prefix import column_scan, native_scan, python_scan

BUCKET = 1 << 17
#: Values of a bucket that is folded as one array.
SMALL_BUCKET = 512
ALGORITHMS = ("prefixes", "lookback")


def promoted(a: str, b: str) -> str:
    """The element type of an operation on two types."""
    if a == b:
        return a
    if "bool" in (a, b):
        return b if a == "bool" else a
    if a in FLOATS or b in FLOATS:
        return "float64" if "float64" in (a, b) or "float32" not in (a, b) else "float32"
    if a in BITS and b in BITS:
        return max(a, b, key=lambda d: (BITS[d], d.startswith("u")))
    raise ValueError(f"no common type of {a} and {b}")


def _init_type(init) -> str:
    if isinstance(init, bool):
        return "bool"
    return {int: "int64", float: "float64", complex: "complex128"}.get(type(init), "")


def accumulate(op: Op, array: DArray, *, init, neutral=None, dims: int | None = None, inclusive: bool = True, alg: str = "prefixes", dtype: str | None = None, python: bool = False, wrap: bool = False, carry: tuple[str, ...] = (), bucket: int | None = None, tuning: Tuning = NONE) -> DArray:
    """A scan by a named operation, a Column function `op(a, b)` with its `neutral`, or with `python=True`
    by a function of two Python values. `op` must be associative.

    `dims` beyond the array, or an empty array, gives the input unchanged (`init` isn't applied). `dtype` is
    the result's type; by default the input's, or a wider one that `init` needs. `carry` names other columns
    of the array that the result keeps. `wrap`: integer sums and products wrap around instead of failing on overflow.
    """
    tuning.checked(least_elems=2)
    if alg not in ALGORITHMS:
        raise ValueError(f"alg must be one of {ALGORITHMS}")
    if dims is not None and (not isinstance(dims, int) or isinstance(dims, bool) or dims < 1):
        raise ValueError("dims must be a positive integer")
    kind = dtype or array.dtype
    m = Monoid("python", lambda d: neutral, lambda a, b, d: a, lambda v, d, over: None) if python else monoid(op, neutral)
    if dims is not None and dims > array.ndim:
        return array.select(F.col(array.value), kind, carry)
    known = array.known()
    if dims is None:
        keys, length, at = [], len(known), known.linear()
    else:
        keys, length, at = [c for c in known.index if c != known.index[dims - 1]], known.shape[dims - 1], F.col(known.index[dims - 1])
    if not len(known):
        return array.select(F.col(array.value), kind, carry)
    wrap = wrap and kind in BITS and m.name in ("+", "*")
    if wrap and m.name == "*":
        m = replace(m, combine=wrapped_product, agg=lambda v, d, over: None)
    inner = "decimal(38,0)" if wrap and m.name == "+" else kind  # sums are exact and wrapped at the end
    native = m.native(known.dtype)
    size = bucket or tuning.bucket(length, BUCKET if native else SMALL_BUCKET)
    work = known.df.select(*keys, *carry, at.cast("bigint").alias("i"), F.col(known.value).cast(storage(inner) if kind != "bool" else "boolean").alias("v"))
    if native:
        out = native_scan(work, keys, lambda v, over: m.total(v, known.dtype, over), lambda a, b: m.combine(a, b, known.dtype), length, size, not inclusive)
    elif python:
        out = python_scan(work.select(*keys, "i", "v"), keys, op, length, size, not inclusive, (init,))
    else:
        out = column_scan(work.select(*keys, "i", "v"), keys, lambda a, b: m.combine(a, b, kind), storage(kind), length, size, not inclusive)
    if not native and carry:
        out = out.join(work.select(*keys, "i", *carry), [*keys, "i"])
    if python:
        value = F.col("v")
    else:
        start = m.neutral(kind)
        value = m.combine(literal(init, inner), F.coalesce(F.col("v"), start if isinstance(start, Column) else literal(start, inner)), kind)
        value = wrapped(value, kind) if inner != kind else value
    if dims is None:
        place = _from_linear(known)
    else:
        place = [F.col("i").alias(c) if c == known.index[dims - 1] else F.col(c) for c in known.index]
    return DArray(out.select(*place, *carry, value.cast(storage(kind)).alias("v")), known.index, "v", known.shape, kind)


def _from_linear(known: DArray) -> list[Column]:
    rest, out = F.col("i") - 1, []
    for name, size in zip(known.index, known.shape, strict=True):
        out.append((rest % size + 1).cast("bigint").alias(name))
        rest = F.floor(rest / size)
    return out


def accumulate_(op: Op, array: DArray, source: DArray | None = None, **kwargs) -> DArray:
    """The scan of an array, or of `source`, in the type of `array`."""
    return accumulate(op, source or array, **{"dtype": array.dtype, **kwargs})


def _counted(array: DArray) -> DArray:
    return array.select(F.col(array.value).cast("bigint"), "int64") if array.dtype == "bool" else array


def _widened(array: DArray, init) -> str:
    """The array's type, or a wider one if `init` isn't an integer."""
    kind, wanted = ("int64" if array.dtype == "bool" else array.dtype), _init_type(init)
    return promoted(kind, wanted) if wanted == "float64" and kind in BITS else kind


def cumsum(array: DArray, init=0, dims: int | None = None, wrap: bool = False, tuning: Tuning = NONE, bucket: int | None = None) -> DArray:
    """Inclusive sums; booleans count as integers."""
    return accumulate("+", _counted(array), init=init, dims=dims, dtype=_widened(array, init), wrap=wrap, tuning=tuning, bucket=bucket)


def cumprod(array: DArray, init=1, dims: int | None = None, wrap: bool = False, tuning: Tuning = NONE, bucket: int | None = None) -> DArray:
    """Inclusive products; exact for integers, or wrapped around with `wrap`."""
    return accumulate("*", _counted(array), init=init, dims=dims, dtype=_widened(array, init), wrap=wrap, tuning=tuning, bucket=bucket)

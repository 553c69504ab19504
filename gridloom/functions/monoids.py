"""Associative operations: neutral elements, native aggregates and how two partial results combine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.model import BITS, FLOATS, limits, literal, storage

INF = float("inf")


def _minimum(a: Column, b: Column, dtype: str) -> Column:
    if dtype not in FLOATS:
        return F.least(a, b)
    return F.when(F.isnan(a) | F.isnan(b), F.lit(float("nan"))).otherwise(F.least(a, b))


Over = Callable[[Column], Column]


def plain(c: Column) -> Column:
    return c


def _min_agg(v: Column, dtype: str, over: Over) -> Column:
    # Spark's min ignores NaN, which sorts last; a minimum with NaN is NaN
    least = over(F.min(v))
    return F.when(over(F.bool_or(F.isnan(v))), F.lit(float("nan"))).otherwise(least) if dtype in FLOATS else least


@dataclass(frozen=True)
class Monoid:
    """`combine(a, b, dtype)` on Columns.

    `total(v, dtype, over)` is a native aggregate or None; `over` is applied to each aggregate function in it,
    so that the same definition serves group-bys and windows.
    """

    name: str
    neutral: Callable[[str], Any]
    combine: Callable[[Column, Column, str], Column]
    agg: Callable[[Column, str, Over], Column | None]

    def total(self, v: Column, dtype: str, over: Over = plain) -> Column | None:
        return self.agg(v, dtype, over)

    def native(self, dtype: str) -> bool:
        return self.total(F.lit(0), dtype) is not None


def _top(dtype: str):
    return INF if dtype in FLOATS else limits(dtype)[1]


def _bottom(dtype: str):
    return -INF if dtype in FLOATS else limits(dtype)[0]


def _sum_agg(v: Column, dtype: str, over: Over) -> Column | None:
    if dtype == "complex128":
        return F.struct(over(F.sum(v["re"])).alias("re"), over(F.sum(v["im"])).alias("im"))
    return over(F.sum(v.cast("int") if dtype == "bool" else v))


def _add(a: Column, b: Column, dtype: str) -> Column:
    if dtype == "complex128":
        return F.struct((a["re"] + b["re"]).alias("re"), (a["im"] + b["im"]).alias("im"))
    return a + b


def _product_agg(v: Column, dtype: str, over: Over) -> Column | None:
    return over(F.product(v)) if dtype in FLOATS else None  # Spark's product is a double, so not exact for integers


REGISTRY: dict[str, Monoid] = {
    "+": Monoid("+", lambda d: 0, _add, _sum_agg),
    "*": Monoid("*", lambda d: 1, lambda a, b, d: a * b, _product_agg),
    "min": Monoid("min", _top, _minimum, _min_agg),
    "max": Monoid("max", _bottom, lambda a, b, d: F.greatest(a, b), lambda v, d, over: over(F.max(v))),
    "|": Monoid("|", lambda d: 0, lambda a, b, d: a.bitwiseOR(b), lambda v, d, over: over(F.bit_or(v))),
    "&": Monoid("&", lambda d: limits(d)[1] if d.startswith("u") else -1, lambda a, b, d: a.bitwiseAND(b), lambda v, d, over: over(F.bit_and(v))),
    "xor": Monoid("xor", lambda d: 0, lambda a, b, d: a.bitwiseXOR(b), lambda v, d, over: over(F.bit_xor(v))),
    "any": Monoid("any", lambda d: False, lambda a, b, d: a | b, lambda v, d, over: over(F.bool_or(v))),
    "all": Monoid("all", lambda d: True, lambda a, b, d: a & b, lambda v, d, over: over(F.bool_and(v))),
}
REGISTRY["extrema"] = Monoid(
    "extrema",
    lambda d: F.struct(literal(_top(d), d).alias("min"), literal(_bottom(d), d).alias("max")),
    lambda a, b, d: F.struct(_minimum(a["min"], b["min"], d).alias("min"), F.greatest(a["max"], b["max"]).alias("max")),
    lambda v, d, over: F.struct(_min_agg(v, d, over).alias("min"), over(F.max(v)).alias("max")),
)
ALIASES = {"add": "+", "sum": "+", "mul": "*", "prod": "*", "minimum": "min", "maximum": "max", "or": "|", "and": "&", "⊻": "xor", "^": "xor"}

Op = str | Monoid | Callable[..., Any]


def monoid(op: Op, neutral: Any = None) -> Monoid:
    """A registered operation by name, one of your own, or a Column function `op(a, b)` with its neutral element."""
    if isinstance(op, Monoid):
        return op
    if isinstance(op, str):
        name = ALIASES.get(op, op)
        if name not in REGISTRY:
            raise ValueError(f"unknown operation {op!r}; give a function and its neutral element")
        known = REGISTRY[name]
        return known if neutral is None else Monoid(known.name, lambda d: neutral, known.combine, known.agg)
    if neutral is None:
        raise ValueError("the neutral element of this operation isn't known; give neutral=")
    return Monoid("custom", lambda d: neutral, lambda a, b, d: op(a, b), lambda v, d, over: None)


def own_monoid(name: str, neutral: Any, combine: Callable[[Column, Column], Column], agg: Callable[[Column, Over], Column]) -> Monoid:
    """An operation with a native aggregate `agg(v, over)`, such as one aggregate function per struct field.

    `over` must be applied to each aggregate function."""
    return Monoid(name, lambda d: neutral, lambda a, b, d: combine(a, b), lambda v, d, over: agg(v, over))


def neutral_element(op: Op, dtype: str) -> Any:
    """The neutral element of a registered operation for an element type."""
    return monoid(op, None).neutral(dtype)


def wrapped(total: Column, dtype: str) -> Column:
    """A whole number, of any size below 10**37, as the integer type would hold it after wrapping around."""
    low, high = limits(dtype)
    span, low = F.lit(Decimal(high - low + 1)).cast("decimal(38,0)"), F.lit(Decimal(low)).cast("decimal(38,0)")
    return (F.pmod(total.cast("decimal(38,0)") - low, span) + low).cast(storage(dtype))


def wrapped_sum(v: Column, dtype: str) -> Column:
    """An integer sum that wraps around like the type would, instead of failing on overflow."""
    return wrapped(F.sum(v.cast("decimal(20,0)")), dtype)


#: Stands for any product of whole numbers beyond a long; `product` of two such has the 38 digits of a decimal.
TOP = Decimal(10**19 - 1)


def product(a: Column, b: Column) -> Column:
    """`a * b` exactly as a decimal(19,0), or TOP or -TOP beyond that, since a later sign or zero may make it fit a long."""
    a, b, top = a.cast("decimal(19,0)"), b.cast("decimal(19,0)"), F.lit(TOP).cast("decimal(19,0)")
    return F.coalesce((a * b).try_cast("decimal(19,0)"), F.when((a < 0) == (b < 0), top).when((a < 0) != (b < 0), -top))


def fitting(total: Column) -> Column:
    """A result of `product`, failing at run time if it is beyond a long."""
    return F.when(F.abs(total) > F.lit(Decimal(2**63)), F.raise_error(F.lit("overflow: an integer product doesn't fit a long"))).otherwise(total)


def wrapped_product(a: Column, b: Column, dtype: str) -> Column:
    """`a * b` wrapped around. The 64-bit types multiply by halves of `b`, so that no digit is lost."""
    if BITS[dtype] < 64:
        return wrapped(a.cast("decimal(19,0)") * b.cast("decimal(19,0)"), dtype)
    half = F.lit(Decimal(1 << 32)).cast("decimal(10,0)")
    low = F.pmod(b.cast("decimal(20,0)"), half).cast("decimal(10,0)")
    high = ((b.cast("decimal(20,0)") - low) / half).cast("decimal(10,0)")
    a = a.cast("decimal(20,0)")
    upper = F.pmod((a * high).cast("decimal(38,0)"), half).cast("decimal(10,0)")
    return wrapped((a * low).cast("decimal(38,0)") + (upper * half).cast("decimal(38,0)"), dtype)

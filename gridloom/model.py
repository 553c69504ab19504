"""Arrays as DataFrames: explicit 1-based index columns and one value column.

A DataFrame has no order, so every array names its index. An N-d array has one index column per axis; its
linear order is column-major. The shape is metadata, since rows cannot tell an empty axis from a missing one.
Values are not null by contract (`checked` tests it).
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from decimal import Decimal
from functools import reduce as fold
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Logical element type to Spark storage type. Spark has no unsigned types, so those are widened.
STORAGE = {
    "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint",
    "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)",
    "float32": "float", "float64": "double", "bool": "boolean", "string": "string",
    "complex128": "struct<re:double,im:double>",
}
BITS = {"int8": 8, "int16": 16, "int32": 32, "int64": 64, "uint8": 8, "uint16": 16, "uint32": 32, "uint64": 64}
FLOATS = ("float32", "float64")
_LOGICAL = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64", "boolean": "bool", "string": "string"}


def logical_type(kind: T.DataType) -> str:
    """The logical type that a Spark type stands for; others (structs, decimals) keep their Spark name."""
    name = kind.simpleString()
    return _LOGICAL.get(name, name)


def storage(dtype: str) -> str:
    return STORAGE.get(dtype, dtype)


def limits(dtype: str) -> tuple[int, int]:
    """Smallest and largest value of an integer type."""
    bits = BITS[dtype]
    return (0, 2**bits - 1) if dtype.startswith("u") else (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1)


def literal(value, dtype: str) -> Column:
    if dtype == "complex128":
        z = complex(value)
        return F.struct(F.lit(z.real).alias("re"), F.lit(z.imag).alias("im"))
    if isinstance(value, Column):
        return value.cast(storage(dtype))
    if isinstance(value, tuple):
        raise ValueError("give struct values as Column")
    if dtype == "uint64":  # too wide for a long
        return F.lit(Decimal(value)).cast(storage(dtype))
    return F.lit(value).cast(storage(dtype))


@dataclass(frozen=True)
class DArray:
    df: DataFrame
    index: tuple[str, ...] = ("i",)
    value: str = "v"
    shape: tuple[int, ...] | None = None
    dtype: str = ""

    def __post_init__(self):
        names = set(self.df.columns)
        if missing := [c for c in (*self.index, self.value) if c not in names]:
            raise ValueError(f"no such columns: {missing}")
        if self.shape is not None and len(self.shape) != len(self.index):
            raise ValueError(f"{len(self.index)} index columns but shape {self.shape}")
        if not self.dtype:
            object.__setattr__(self, "dtype", logical_type(self.df.schema[self.value].dataType))

    @property
    def ndim(self) -> int:
        return len(self.index)

    def known(self) -> DArray:
        """This array with its shape. Where it isn't known, the largest index per axis is looked up."""
        if self.shape is not None:
            return self
        row = self.df.agg(*[F.max(c).alias(c) for c in self.index]).first()
        return replace(self, shape=tuple(int(row[c] or 0) for c in self.index))

    def __len__(self) -> int:
        return fold(mul, self.known().shape, 1)

    def linear(self) -> Column:
        """1-based column-major position."""
        if self.ndim == 1:
            return F.col(self.index[0]).cast("bigint")
        shape = self.known().shape
        at, stride = F.col(self.index[0]).cast("bigint"), shape[0]
        for name, size in zip(self.index[1:], shape[1:], strict=True):
            at = at + (F.col(name).cast("bigint") - 1) * stride
            stride *= size
        return at

    def select(self, value: Column, dtype: str | None = None, extra: tuple[str, ...] = ()) -> DArray:
        """The same axes with another value."""
        kind = dtype or self.dtype
        return DArray(self.df.select(*self.index, *extra, value.cast(storage(kind)).alias("v")), self.index, "v", self.shape, kind)

    def checked(self) -> DArray:
        """This array, failing at run time on a null value."""
        safe = F.when(F.col(self.value).isNull(), F.raise_error(F.lit("null in an array"))).otherwise(F.col(self.value))
        return replace(self, df=self.df.withColumn(self.value, safe))

    def values(self) -> list:
        """All values in linear order, on the driver: for small results."""
        return [r[0] for r in self.df.select(F.col(self.value), self.linear().alias("_at")).orderBy("_at").collect()]


@dataclass(frozen=True)
class Scalar:
    """A result of one row and one column; nothing is computed before `get` or a use of `df`."""

    df: DataFrame
    dtype: str

    def get(self):
        return self.df.first()[0]


def exact_cast(value: Column, dtype: str) -> Column:
    """A cast that fails where the value would change, as 2.5 to an integer would."""
    cast = value.cast(storage(dtype))
    return F.when(value.isNotNull() & (cast.cast("double") != value.cast("double")), F.raise_error(F.lit(f"value not representable as {dtype}")).cast(storage(dtype))).otherwise(cast)

"""Python functions of single values, called in Arrow batches. Null and NaN stay apart: a null is None."""

from __future__ import annotations

import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gridloom.model import storage

# Functions that run on executors travel by value, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def to_python(values: pa.Array | pa.ChunkedArray) -> list:
    """Values as Python ones; a pair of re and im is a complex number."""
    out = values.to_pylist()
    if pa.types.is_struct(values.type) and [f.name for f in values.type] == ["re", "im"]:
        return [None if x is None else complex(x["re"], x["im"]) for x in out]
    return out


def from_python(values: list, kind: pa.DataType) -> pa.Array:
    if pa.types.is_struct(kind) and [f.name for f in kind] == ["re", "im"]:
        values = [x if x is None or isinstance(x, dict) else {"re": complex(x).real, "im": complex(x).imag} for x in values]
    return pa.array(values, kind)


def called(f: Callable, columns: list[Column], dtype: str, whole: bool = False) -> Column:
    """`f` of the values of each row, or with `whole` of the Arrow arrays of a batch, as a column of a logical type."""
    kind = T.DataType.fromDDL(storage(dtype))
    arrow = to_arrow_type(kind)

    def run(*arrays: pa.Array) -> pa.Array:
        if whole:
            out = f(*arrays)
            return out.cast(arrow) if isinstance(out, (pa.Array, pa.ChunkedArray)) else pa.array(out, arrow)
        return from_python([f(*row) for row in zip(*[to_python(a) for a in arrays], strict=True)], arrow)

    return F.arrow_udf(run, kind)(*columns)


def opaque(f: Callable, dtype: str, whole: bool = False) -> Callable[..., Column]:
    """A Python function as a Column function with results of a logical type, for `by`, `f` and the like."""
    return lambda *columns: called(f, list(columns), dtype, whole)

"""Sources and sinks. None reads data before it is needed, except for a shape that isn't given."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.model import DArray, storage


def from_table(df: DataFrame, index: str | Sequence[str], value: str, base: int = 1, shape: tuple[int, ...] | None = None, dtype: str = "") -> DArray:
    """Columns of a table that already has dense index columns, counted from `base`."""
    names = [index] if isinstance(index, str) else list(index)
    out = [f"i{k + 1}" if len(names) > 1 else "i" for k in range(len(names))]
    cols = [(F.col(f"`{n}`").cast("bigint") + (1 - base)).alias(o) for n, o in zip(names, out, strict=True)]
    v = F.col(f"`{value}`")
    return DArray(df.select(*cols, (v.cast(storage(dtype)) if dtype else v).alias("v")), tuple(out), "v", shape, dtype)


def from_rows(df: DataFrame, value: str, dtype: str = "") -> DArray:
    """A single Parquet file's rows in file order, by the reader's row index."""
    rows = df.select((F.col("_metadata.row_index") + 1).alias("i"), F.col(f"`{value}`").alias("v"))
    return DArray(rows, ("i",), "v", None, dtype)


def from_array_column(df: DataFrame, index: str, array: str, inner: Sequence[int], base: int = 1, rows: int | None = None, dtype: str = "") -> DArray:
    """Rows of fixed-length arrays as an N-d array; `inner` splits a row into axes, the first varying slowest."""
    flat = df.select((F.col(f"`{index}`").cast("bigint") + (1 - base)).alias("i1"), F.posexplode(F.col(f"`{array}`")).alias("p", "v"))
    axes, rest = [], F.col("p").cast("bigint")
    for size in reversed(inner[1:]):
        axes.insert(0, rest % size + 1)
        rest = F.floor(rest / size)
    axes.insert(0, rest + 1)
    names = tuple(f"i{k + 1}" for k in range(len(inner) + 1))
    shape = None if rows is None else (rows, *inner)
    return DArray(flat.select("i1", *[a.cast("bigint").alias(n) for a, n in zip(axes, names[1:], strict=True)], "v"), names, "v", shape, dtype)


def from_range(spark: SparkSession, first: int, last: int, dtype: str = "int64") -> DArray:
    """The values first..last, generated where they are used."""
    df = spark.range(first, last + 1).select((F.col("id") - (first - 1)).alias("i"), F.col("id").cast(storage(dtype)).alias("v"))
    return DArray(df, ("i",), "v", (max(0, last - first + 1),), dtype)


def from_values(spark: SparkSession, values: Sequence, dtype: str, shape: tuple[int, ...] | None = None) -> DArray:
    """Local values in column-major order."""
    shape = shape or (len(values),)
    names = ("i",) if len(shape) == 1 else tuple(f"i{k + 1}" for k in range(len(shape)))
    rows = []
    for at, v in enumerate(values):
        place = []
        for size in shape:
            place.append(at % size + 1)
            at //= size
        rows.append((*place, Decimal(v) if dtype == "uint64" else v))
    schema = ", ".join(f"{n} bigint" for n in names) + f", v {storage(dtype)}"
    return DArray(spark.createDataFrame(rows, schema), names, "v", tuple(shape), dtype)


def to_table(array: DArray, path: str, mode: str = "errorifexists", partitions: int | None = None) -> None:
    """Parquet files with the index columns, clustered by the first of them."""
    df = array.df.select(*array.index, array.value)
    (df.repartitionByRange(partitions, array.index[0]) if partitions else df).write.mode(mode).parquet(path)

"""Stable sorts, permutations and sorts by key.

A global sort is a range partition of a sample's splitters and a local sort, which spills; ties go by the old
index, so sorts are stable and a hot key is split over partitions. Ranks come from `plans.ordered`. `lt` may be a strict
weak order of one's own, a function of two Columns; then buckets between sampled splitters are sorted as arrays.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.ordering import comparison, ordering
from gridloom.functions.tuning import NONE, Tuning
from gridloom.model import DArray
from gridloom.plans.ordered import SMALL, numbered, ranked_by

RADIX_TYPES = ("int32", "int64", "uint32", "uint64", "float32", "float64")


def _allowed(alg: str | None, array: DArray, lt, by, permutation: bool = False) -> None:
    if alg not in (None, "merge", "sample", "radix"):
        raise ValueError("alg must be merge, sample or radix")
    if alg == "radix" and (permutation or by is not None or callable(lt) or lt not in ("<", "isless") or array.dtype not in RADIX_TYPES):
        raise ValueError("radix sort takes 32 and 64 bit numbers in their own order only, and gives no permutation")


def _ranked(array: DArray, extra: dict[str, str], lt, by, rev, order, small: int) -> tuple[DataFrame, int]:
    """Rows `(_rank, i, v, extra...)`."""
    known = array.known()
    if callable(lt):
        rows = known.df.select(known.linear().alias("i"), F.lit(0).alias("t"), F.col(known.value).alias("k"), *[F.col(c).alias(n) for n, c in extra.items()])
        return ranked_by(rows, comparison(lt, by, rev, order), "_rank", len(known)).withColumnRenamed("k", "v").drop("t"), len(known)
    wanted = ordering(lt, by, rev, order)
    keys = wanted.keys(F.col("v"), known.df.schema[known.value].dataType)
    rows = known.df.select(known.linear().alias("i"), F.col(known.value).alias("v"), *[F.col(c).alias(n) for n, c in extra.items()])
    rows = rows.select("*", *keys)
    names = [c for c in rows.columns if c in ("_key", "_sign")]
    return numbered(rows, [*wanted.sort(names), F.col("i")], "_rank", len(known), small).drop(*names), len(known)


def sort(array: DArray, lt="<", by: Callable | None = None, rev: bool | None = None, order: str = "forward", alg: str | None = None, small: int = SMALL, tuning: Tuning = NONE) -> DArray:
    """Values in order, as an array of new indices. -0.0 is before 0.0 and NaN is last, or first in reverse."""
    tuning.checked()
    _allowed(alg, array, lt, by)
    if array.ndim != 1:
        raise ValueError("only vectors are sorted")
    rows, n = _ranked(array, {}, lt, by, rev, order, small)
    return DArray(rows.select(F.col("_rank").alias("i"), "v"), ("i",), "v", (n,), array.dtype)


def sortperm(array: DArray, lt="<", by: Callable | None = None, rev: bool | None = None, order: str = "forward", alg: str | None = None, small: int = SMALL, tuning: Tuning = NONE) -> DArray:
    """The old index of each value in order."""
    tuning.checked()
    _allowed(alg, array, lt, by, permutation=True)
    if array.ndim != 1:
        raise ValueError("only vectors are sorted")
    rows, n = _ranked(array, {}, lt, by, rev, order, small)
    return DArray(rows.select(F.col("_rank").alias("i"), F.col("i").alias("v")), ("i",), "v", (n,), "int64")


def sort_by_key(keys: DArray, values: DArray, lt="<", by: Callable | None = None, rev: bool | None = None, order: str = "forward", small: int = SMALL, tuning: Tuning = NONE) -> tuple[DArray, DArray]:
    """Keys in order and the values that went with them, as columns `k` and `v` of one table."""
    tuning.checked()
    if keys.ndim != 1 or values.ndim != 1:
        raise ValueError("only vectors are sorted")
    if keys.df is values.df and keys.index == values.index:
        source = keys
        extra = {"_value": values.value}
    else:
        if len(keys) != len(values):
            raise ValueError("keys and values differ in length")
        right = values.df.select(F.col(values.index[0]).alias("_j"), F.col(values.value).alias("_value"))
        joined = keys.df.select(F.col(keys.index[0]).alias("i"), F.col(keys.value).alias("v")).join(right, F.col("i") == F.col("_j"))
        source, extra = DArray(joined, ("i",), "v", keys.known().shape, keys.dtype), {"_value": "_value"}
    rows, n = _ranked(source, extra, lt, by, rev, order, small)
    out = rows.select(F.col("_rank").alias("i"), F.col("v").alias("k"), F.col("_value").alias("v"))
    return DArray(out, ("i",), "k", (n,), keys.dtype), DArray(out, ("i",), "v", (n,), values.dtype)


def sort_(array: DArray, **kwargs) -> DArray:
    return sort(array, **kwargs)


def sortperm_(target: DArray, array: DArray, **kwargs) -> DArray:
    """`sortperm` in the type of a destination of the same length."""
    if len(target) != len(array):
        raise ValueError("destination and source differ in length")
    out = sortperm(array, **kwargs)
    return replace(out, df=out.df.withColumn("v", F.col("v").cast(target.df.schema[target.value].dataType)), dtype=target.dtype)


def merge_sort(array: DArray, **kwargs) -> DArray:
    return sort(array, alg="merge", **kwargs)


def sample_sort(array: DArray, **kwargs) -> DArray:
    return sort(array, alg="sample", **kwargs)


def radix_sort(array: DArray, **kwargs) -> DArray:
    return sort(array, alg="radix", **kwargs)


def merge_sortperm(array: DArray, lowmem: bool = False, **kwargs) -> DArray:
    """`lowmem` makes no difference here: a sort of rows never holds the array."""
    return sortperm(array, alg="merge", **kwargs)


def sample_sortperm(array: DArray, **kwargs) -> DArray:
    return sortperm(array, alg="sample", **kwargs)


def merge_sortperm_(target: DArray, array: DArray, **kwargs) -> DArray:
    return sortperm_(target, array, alg="merge", **kwargs)


def sample_sortperm_(target: DArray, array: DArray, **kwargs) -> DArray:
    return sortperm_(target, array, alg="sample", **kwargs)


merge_sortperm_lowmem, merge_sortperm_lowmem_ = merge_sortperm, merge_sortperm_
merge_sort_by_key = sort_by_key
merge_sort_, sample_sort_, radix_sort_ = merge_sort, sample_sort, radix_sort
merge_sort_by_key_ = sort_by_key

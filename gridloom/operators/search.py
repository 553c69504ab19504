"""Positions of many values in a sorted vector, without comparing all pairs.

Equal keys of the vector are combined to their last index. Those and the distinct wanted values are one
ordered sequence, in which a running maximum of that index, with or without the row itself, is the position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from gridloom.functions.ordering import comparison, ordering
from gridloom.functions.tuning import NONE, Tuning
from gridloom.model import DArray
from gridloom.plans.ordered import SMALL, numbered, ranked_by, running


def _positions(vector: DArray, wanted: DArray, last: bool, lt, by, rev, small: int) -> DArray:
    if vector.ndim != 1 or wanted.ndim != 1:
        raise ValueError("search takes vectors")
    if callable(lt):
        return _compared_positions(vector, wanted, last, lt, by, rev, small)
    position = (lambda: F.coalesce(F.col("_upto"), F.lit(0))) if last else (lambda: F.coalesce(F.col("_before"), F.lit(0)) + 1)
    order = ordering(lt, by, rev)
    kind = vector.df.schema[vector.value].dataType
    held = vector.df.select(F.col(vector.index[0]).alias("i"), F.col(vector.value).alias("v"))
    sought = wanted.df.select(F.col(wanted.index[0]).alias("j"), F.col(wanted.value).cast(kind).alias("v"))
    held = held.select("i", *order.keys(F.col("v"), kind))
    sought = sought.select("j", *order.keys(F.col("v"), kind))
    names = [c for c in held.columns if c != "i"]
    ends = held.groupBy(*names).agg(F.max("i").alias("_last"))
    merged = ends.unionByName(sought.select(*names).withColumn("_last", F.lit(None).cast("bigint"))).groupBy(*names).agg(F.max("_last").alias("_last"))
    n = len(vector.known()) + len(wanted.known())
    placed = running(merged, order.sort(names), lambda v: F.max(v), lambda a, b: F.greatest(a, b), "_last", n, small)
    # group-by makes NaN and zero signs equal keys; they join the same way
    found = sought.join(placed.select(*names, position().cast("bigint").alias("_at")), names)
    return DArray(found.select(F.col("j").alias("i"), F.col("_at").alias("v")), ("i",), "v", wanted.shape, "int64")


def _compared_positions(vector: DArray, wanted: DArray, last: bool, lt, by, rev, small: int) -> DArray:
    """By a comparison of one's own: ranks of both together, less the ranks of the wanted values among themselves."""
    kind = vector.df.schema[vector.value].dataType
    held = vector.df.select(F.col(vector.index[0]).cast("bigint").alias("i"), F.lit(1).alias("t"), F.col(vector.value).alias("k"))
    sought = wanted.df.select(F.col(wanted.index[0]).cast("bigint").alias("i"), F.lit(2 if last else 0).alias("t"), F.col(wanted.value).cast(kind).alias("k"))
    n = len(wanted.known())
    ranked = ranked_by(held.unionByName(sought), comparison(lt, by, rev), "_rank", len(vector.known()) + n).where("t <> 1").select("i", "_rank")
    own = numbered(ranked, [F.col("_rank")], "_own", n, small)
    return DArray(own.select("i", (F.col("_rank") - F.col("_own") + (0 if last else 1)).cast("bigint").alias("v")), ("i",), "v", wanted.shape, "int64")


def searchsortedfirst(vector: DArray, wanted: DArray, lt="<", by: Callable | None = None, rev: bool | None = None, small: int = SMALL, tuning: Tuning = NONE) -> DArray:
    """For each wanted value the first index of the sorted vector that isn't before it, or n + 1."""
    tuning.checked()
    return _positions(vector, wanted, False, lt, by, rev, small)


def searchsortedlast(vector: DArray, wanted: DArray, lt="<", by: Callable | None = None, rev: bool | None = None, small: int = SMALL, tuning: Tuning = NONE) -> DArray:
    """For each wanted value the last index of the sorted vector that isn't after it, or 0."""
    tuning.checked()
    return _positions(vector, wanted, True, lt, by, rev, small)


def searchsortedfirst_(target: DArray, vector: DArray, wanted: DArray, **kwargs) -> DArray:
    if len(target) != len(wanted):
        raise ValueError("destination and wanted values differ in length")
    return searchsortedfirst(vector, wanted, **kwargs)


def searchsortedlast_(target: DArray, vector: DArray, wanted: DArray, **kwargs) -> DArray:
    if len(target) != len(wanted):
        raise ValueError("destination and wanted values differ in length")
    return searchsortedlast(vector, wanted, **kwargs)

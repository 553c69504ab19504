"""Predicates over a whole array: false (`any`) and true (`all`) of nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.tuning import NONE, Tuning
from gridloom.model import DArray, Scalar
from gridloom.plans.opaque import called

ALGORITHMS = ("mapreduce", "first")


def any(pred: Callable, array: DArray, alg: str = "mapreduce", python: bool = False, tuning: Tuning = NONE) -> Scalar:
    """`alg="first"` stops at the first hit, reading few partitions at first; "mapreduce" aggregates all. `python`:
    `pred` is a function of a Python value."""
    tuning.checked()
    if alg not in ALGORITHMS:
        raise ValueError(f"alg must be one of {ALGORITHMS}")
    holds = called(pred, [F.col(array.value)], "bool") if python else pred(F.col(array.value))
    if alg == "first":
        found = not array.df.select(holds.alias("_p")).where("_p").limit(1).isEmpty()
        return Scalar(array.df.sparkSession.range(1).select(F.lit(found).alias("v")), "bool")
    return Scalar(array.df.agg(F.coalesce(F.bool_or(holds), F.lit(False)).alias("v")), "bool")


def all(pred: Callable, array: DArray, alg: str = "mapreduce", python: bool = False, tuning: Tuning = NONE) -> Scalar:
    """`not any(not pred)`."""
    none = any((lambda v: not pred(v)) if python else (lambda v: ~pred(v)), array, alg, python, tuning)
    return Scalar(none.df.select((~F.col("v")).alias("v")), "bool")

"""Balanced contiguous ranges of an index, and functions applied to them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.model import DArray


@dataclass(frozen=True)
class TaskPartitioner:
    """`num_elems` in at most `max_tasks` ranges of at least `min_elems`; the first ones get one more."""

    num_elems: int
    max_tasks: int
    min_elems: int = 1

    def __post_init__(self):
        if self.num_elems < 0 or self.max_tasks <= 0 or self.min_elems <= 0:
            raise ValueError("need num_elems >= 0, max_tasks > 0 and min_elems > 0")

    @property
    def num_tasks(self) -> int:
        return max(1, min(self.max_tasks, self.num_elems // self.min_elems))

    def __len__(self) -> int:
        return self.num_tasks

    def __getitem__(self, task: int) -> range:
        """The 1-based indices of a task, counted from 1."""
        if not 1 <= task <= self.num_tasks:
            raise IndexError(f"task {task} of {self.num_tasks}")
        size, more = divmod(self.num_elems, self.num_tasks)
        start = (task - 1) * size + min(task - 1, more) + 1
        return range(start, start + size + (task <= more))

    def __iter__(self) -> Iterator[range]:
        return (self[t] for t in range(1, self.num_tasks + 1))

    def task(self, index: Column) -> Column:
        """The task of an index, as arithmetic on it."""
        size, more = divmod(self.num_elems, self.num_tasks)
        if not size:
            return F.lit(1).cast("bigint")
        head = more * (size + 1)
        return F.when(index <= head, F.floor((index - 1) / (size + 1)) + 1).otherwise(F.floor((index - 1 - head) / size) + more + 1).cast("bigint")

    def table(self, spark: SparkSession) -> DataFrame:
        """`(task, start, stop)`, generated from the arithmetic."""
        size, more = divmod(self.num_elems, self.num_tasks)
        t = F.col("id")
        start = (t - 1) * size + F.least(t - 1, F.lit(more)) + 1
        return spark.range(1, self.num_tasks + 1).select(t.alias("task"), start.alias("start"), (start + size - 1 + (t <= more).cast("int")).alias("stop"))


def itask_partition(f: Callable[[int, pd.DataFrame], pd.DataFrame], array: DArray, schema: str, max_tasks: int, min_elems: int = 1) -> DataFrame:
    """`f(task, rows)` for every range of the linear order, with rows sorted by it."""
    known = array.known()
    parts = TaskPartitioner(len(known), max_tasks, min_elems)
    rows = known.df.select(known.linear().alias("_at"), *known.index, F.col(known.value).alias("v")).withColumn("_task", parts.task(F.col("_at")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        return f(int(pdf["_task"].iloc[0]), pdf.drop(columns=["_at", "_task"]).reset_index(drop=True))

    return rows.groupBy("_task").applyInPandas(run, schema)


def task_partition(f: Callable[[pd.DataFrame], pd.DataFrame], array: DArray, schema: str, max_tasks: int, min_elems: int = 1) -> DataFrame:
    return itask_partition(lambda task, rows: f(rows), array, schema, max_tasks, min_elems)

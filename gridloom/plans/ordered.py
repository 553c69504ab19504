"""Numbering and running aggregates over a global order, without a single-partition window.

Rows are range-partitioned and sorted once and written with their partition number and place in it. From
then on a partition number is data, so it cannot change when a task is run again. A total for each partition,
one row each, gives the carry into every partition. Ties of a hot key are split, as the order includes the
index. Below `SMALL` rows a plain window does the same in one task with less overhead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.plans.scratch import stored

SMALL = 250_000


def _laid_out(df: DataFrame, order: list[Column]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    low = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return stored(laid.withColumn("_part", F.spark_partition_id()).withColumn("_place", low))


def numbered(df: DataFrame, order: list[Column], name: str, n: int, small: int = SMALL) -> DataFrame:
    """`df` with the 1-based rank of each row in the order, which must have no ties."""
    if n <= small:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    laid = _laid_out(df, order)
    counts = laid.groupBy("_part").agg(F.count("*").alias("_n"))
    carry = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_carry"))
    # one row for each shuffle partition
    return laid.join(F.broadcast(carry), "_part").withColumn(name, (F.col("_carry") + F.col("_place") + 1).cast("bigint")).drop("_part", "_place", "_carry")


def running(df: DataFrame, order: list[Column], agg: Callable[[Column], Column], combine: Callable[[Column, Column], Column], value: str, n: int, small: int = SMALL) -> DataFrame:
    """`df` with `_upto` (aggregate of `value` over this row and all before) and `_before` (without this row).

    Null where nothing is before. `combine(a, b)` joins two aggregates that aren't null.
    """
    if n <= small:
        w = Window.orderBy(*order)
        local = df.withColumn("_upto", agg(F.col(value)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return local.withColumn("_before", agg(F.col(value)).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    laid = _laid_out(df, order)
    inner = Window.partitionBy("_part").orderBy("_place")
    local = laid.withColumn("_upto", agg(F.col(value)).over(inner.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_before", agg(F.col(value)).over(inner.rowsBetween(Window.unboundedPreceding, -1)))
    totals = laid.groupBy("_part").agg(agg(F.col(value)).alias("_total"))
    carry = totals.select("_part", agg(F.col("_total")).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))

    def joined(name: str) -> Column:
        c = F.col("_carry")
        return F.when(c.isNull(), F.col(name)).when(F.col(name).isNull(), c).otherwise(combine(c, F.col(name)))

    both = local.join(F.broadcast(carry), "_part").select(*df.columns, joined("_upto").alias("_upto"), joined("_before").alias("_before"))
    return both


def _compared(less: Callable[[Column, Column], Column], a: Column, b: Column) -> Column:
    """-1, 0 or 1 of structs (k, t, i): by `less` of k, then by t and i."""
    tie = F.when(a["t"] != b["t"], F.when(a["t"] < b["t"], -1).otherwise(1)).when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0)
    return F.when(less(a["k"], b["k"]), -1).when(less(b["k"], a["k"]), 1).otherwise(tie)


def ranked_by(df: DataFrame, less: Callable[[Column, Column], Column], name: str, n: int, target: int = 1 << 15) -> DataFrame:
    """Rows `(i, t, k, ...)` with their 1-based rank by a comparison of k, ties by t and i, which is unique with t.

    A sample of 32 rows for each bucket of about `target` rows, ordered by the comparison, gives the splitters. Each row finds its
    bucket by binary search and each bucket is sorted as an array. Ties are split between buckets, as t and i are in the order.
    """
    row = F.struct("k", "t", "i", *[c for c in df.columns if c not in ("k", "t", "i")])
    order = lambda a, b: _compared(less, a, b)
    parts = -(-n // target)
    if parts > 1:
        some = df.where(F.pmod(F.xxhash64("i", "t"), F.lit(max(1, n // (32 * parts)))) == 0)
        picked = some.agg(F.array_sort(F.collect_list(F.struct("k", "t", "i")), order).alias("s"))
        picked = stored(picked.select(F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda j: F.get("s", F.floor(j * F.size("s") / parts).cast("int"))).alias("s")))
        span = F.struct(F.lit(0).alias("low"), F.lit(parts - 1).alias("high"))
        own = F.struct("k", "t", "i")

        def halved(s: Column, _: Column) -> Column:
            mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
            at = F.get("_splits", mid)
            right = (s["low"] < s["high"]) & at.isNotNull() & (order(at, own) <= 0)
            return F.struct(F.when(right, mid + 1).otherwise(s["low"]).alias("low"), F.when(right | (s["low"] >= s["high"]), s["high"]).otherwise(mid).alias("high"))

        steps = F.sequence(F.lit(1), F.lit(parts.bit_length() + 1))
        df = df.withColumn("_splits", picked.scalar()).withColumn("_bucket", F.aggregate(steps, span, halved, lambda s: s["low"])).drop("_splits")
    else:
        df = df.withColumn("_bucket", F.lit(0))
    sorted_ = df.groupBy("_bucket").agg(F.array_sort(F.collect_list(row), order).alias("_rows"))
    if parts > 1:
        sorted_ = stored(sorted_)
        counts = sorted_.select("_bucket", F.size("_rows").alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # one row for each bucket
        sorted_ = sorted_.join(F.broadcast(counts.select("_bucket", before.alias("_carry"))), "_bucket")
    else:
        sorted_ = sorted_.withColumn("_carry", F.lit(0))
    placed = sorted_.select("_carry", F.posexplode("_rows").alias("_p", "_r"))
    return placed.select("_r.*", (F.col("_carry") + F.col("_p") + 1).cast("bigint").alias(name))

"""The array operators as queries over the provided tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import api as g

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events(spark, d, value="user_id", dtype=""):
    df = _table(spark, d, "events")
    return g.from_table(df, "event_id", value, base=0, shape=(df.count(),), dtype=dtype)


def _customers(spark, d, value):
    df = _table(spark, d, "customer")
    return g.from_table(df, "c_custkey", value, base=0, shape=(df.count(),))


def _orders(spark, d, value):
    df = _table(spark, d, "orders").select("o_orderkey", value)
    base = df.agg(F.min("o_orderkey")).first()[0]
    return g.from_table(df, "o_orderkey", value, base=base or 0, shape=(df.count(),))


def _scaled(spark, d):
    """Embedding elements as integers, axes (vector, a, b) of 8 by 8, so that sums are exact."""
    df = _table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("bigint")).alias("e"))
    return g.from_array_column(df, "vec_id", "e", (8, 8), base=0, rows=df.count())


def _cents(column):
    return F.round(F.col(column) * 100).cast("bigint")


_E = "WITH e AS (SELECT vec_id + 1 AS i1, CAST(floor((p - 1) / 8) AS BIGINT) + 1 AS i2, (p - 1) % 8 + 1 AS i3, CAST(floor(CAST(x AS DOUBLE) * 1000) AS BIGINT) AS v FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings)) "


@query("SELECT event_id + 1 AS i, user_id * 2 + (event_id + 1) AS v FROM events")
def foreachindex_affine(spark, d):
    return g.foreachindex(lambda v, i: v * 2 + i, _events(spark, d)).df


@query(_E + "SELECT i1, i2, i3, v - max(v) OVER (PARTITION BY i1) AS v FROM e")
def foraxes_rows(spark, d):
    return g.foraxes(lambda i, row: F.transform(row, lambda x: x - F.array_max(row)), _scaled(spark, d), dims=1).df


@query("SELECT event_id + 1 AS i, user_id * user_id AS v FROM events")
def map_square(spark, d):
    return g.map(lambda v: v * v, _events(spark, d)).df


@query("SELECT event_id + 1 AS i, CASE WHEN value > 100 THEN value ELSE 0 END AS v FROM events")
def map_conditional(spark, d):
    return g.map(lambda v: F.when(v > 100, v).otherwise(0.0), _events(spark, d, "value")).df


@query("SELECT event_id + 1 AS i, CAST(user_id % 100 AS INTEGER) AS v FROM events")
def map_into_type(spark, d):
    e = _events(spark, d)
    return g.map_(lambda v: v % 100, g.DArray(e.df.select("i", F.col("v").cast("int").alias("v")), ("i",), "v", e.shape), e).df


def _reduction(name, op, value, sql):
    def run(spark, d):
        table, column = value
        return g.reduce(op, g.DArray(_table(spark, d, table).select(F.monotonically_increasing_id().alias("i"), F.col(column).alias("v"))), init={"+": 0, "max": -(2**63), "min": 2**63 - 1, "&": -1}.get(op, 0)).df

    run.__name__ = name
    query(sql)(run)


_reduction("reduce_sum", "+", ("orders", "o_custkey"), "SELECT CAST(sum(o_custkey) AS BIGINT) AS v FROM orders")
_reduction("reduce_max", "max", ("orders", "o_custkey"), "SELECT max(o_custkey) AS v FROM orders")
_reduction("reduce_min", "min", ("orders", "o_custkey"), "SELECT min(o_custkey) AS v FROM orders")
_reduction("reduce_bit_xor", "xor", ("events", "user_id"), "SELECT bit_xor(user_id) AS v FROM events")
_reduction("reduce_bit_and", "&", ("events", "user_id"), "SELECT bit_and(user_id) AS v FROM events")
_reduction("reduce_bit_or", "|", ("events", "user_id"), "SELECT bit_or(user_id) AS v FROM events")


@query("SELECT CAST(sum(user_id) + 1000 AS BIGINT) AS v FROM events")
def reduce_with_init(spark, d):
    return g.reduce("+", _events(spark, d), init=1000).df


@query("SELECT CAST(7 AS BIGINT) AS v")
def reduce_empty_is_init(spark, d):
    e = _events(spark, d)
    return g.reduce("+", g.DArray(e.df.where(F.col("v") < 0), ("i",), "v", (0,)), init=7).df


@query("SELECT min(user_id) AS lo, max(user_id) AS hi FROM events")
def reduce_extrema(spark, d):
    out = g.reduce("extrema", _events(spark, d), init=g.neutral_element("extrema", "int64"), dtype="int64").df
    return out.select(F.col("v.min").alias("lo"), F.col("v.max").alias("hi"))


@query("SELECT CAST((sum(user_id) + 3) % 1000003 AS BIGINT) AS v FROM events")
def reduce_custom_op(spark, d):
    return g.reduce(lambda a, b: (a + b) % 1_000_003, _events(spark, d), init=3, neutral=0).df


@query("SELECT CAST(sum(l_quantity * l_quantity) AS BIGINT) AS v FROM lineitem")
def mapreduce_sumsq(spark, d):
    a = g.DArray(_table(spark, d, "lineitem").select(F.lit(1).alias("i"), F.col("l_quantity").cast("bigint").alias("v")))
    return g.mapreduce(lambda v: v * v, "+", a, init=0).df


@query("SELECT min(CAST(l_quantity AS BIGINT)) AS x, min(CAST(round(l_discount * 100) AS BIGINT)) AS y FROM lineitem")
def mapreduce_minbox(spark, d):
    df = _table(spark, d, "lineitem").select(F.lit(1).alias("i"), F.struct(F.col("l_quantity").cast("bigint").alias("x"), _cents("l_discount").alias("y")).alias("v"))
    low = lambda a, b: F.struct(F.least(a["x"], b["x"]).alias("x"), F.least(a["y"], b["y"]).alias("y"))
    top = F.struct(F.lit(2**63 - 1).alias("x"), F.lit(2**63 - 1).alias("y"))
    box = g.monoid("fields", top, low, lambda v, over: F.struct(over(F.min(v["x"])).alias("x"), over(F.min(v["y"])).alias("y")))
    return g.reduce(box, g.DArray(df), init=top).df.select("v.x", "v.y")


@query("SELECT CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS v FROM lineitem")
def mapreduce_multi_dot(spark, d):
    df = _table(spark, d, "lineitem").select(F.lit(1).alias("i"), _cents("l_extendedprice").alias("a"), _cents("l_discount").alias("b"))
    return g.mapreduce(lambda a, b: a * b, "+", g.DArray(df, value="a"), g.DArray(df, value="b"), init=0).df


@query("SELECT CAST(sum(e.user_id * c.user_id) AS BIGINT) AS v FROM events e JOIN (SELECT event_id, user_id FROM events) c ON e.event_id = c.event_id")
def mapreduce_zip_join(spark, d):
    return g.mapreduce(lambda a, b: a * b, "+", _events(spark, d), _events(spark, d), init=0).df


def _dims(name, dims, keys, op="+", agg="sum"):
    cols = ", ".join(k if k in keys else f"CAST(1 AS BIGINT) AS {k}" for k in ("i1", "i2", "i3"))

    def run(spark, d):
        return g.reduce(op, _scaled(spark, d), init=0 if op == "+" else -(2**63), dims=dims).df

    run.__name__ = name
    query(_E + f"SELECT {cols}, CAST({agg}(v) AS BIGINT) AS v FROM e GROUP BY {', '.join(keys)}")(run)


_dims("mapreduce_dims_rows", (2, 3), ["i1"])
_dims("mapreduce_dims_cols", 1, ["i2", "i3"])
_dims("mapreduce_dims_13", (1, 3), ["i2"])
_dims("maximum_dims_2", 2, ["i1", "i3"], "max", "max")


@query("SELECT CAST(sum(o_custkey) AS BIGINT) AS v FROM orders")
def sum_(spark, d):
    return g.sum(_orders(spark, d, "o_custkey")).df


@query("SELECT CAST((sum(c_nationkey) + 2147483648) % 4294967296 - 2147483648 AS INTEGER) AS v FROM customer")
def sum_wrapping(spark, d):
    return g.sum(_customers(spark, d, "c_nationkey"), wrap=True).df


_SIGNS = "SELECT CAST(sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) % 2 AS BIGINT) AS odd, count(*) AS n FROM events"


@query(f"SELECT CAST(CASE WHEN odd = 1 THEN -1 ELSE 1 END * power(2, n // 5000) AS BIGINT) AS v FROM ({_SIGNS})")
def prod_int(spark, d):
    """Signs of all events, and a two for each 5,000 of them. From 315,000 events on the product may overflow, here and in SQL."""
    df = _table(spark, d, "events").select((F.col("event_id") + 1).alias("i"), F.when(F.col("event_id") % 3 == 0, -1).otherwise(1).alias("s"), F.when((F.col("event_id") + 1) % 5000 == 0, 2).otherwise(1).alias("t"))
    return g.prod(g.DArray(df.select("i", (F.col("s") * F.col("t")).cast("bigint").alias("v")), shape=(df.count(),))).df


@query("SELECT CAST((x + 2147483648) % 4294967296 - 2147483648 AS INTEGER) AS v FROM (SELECT list_reduce(list(CAST(event_id * 2 + 1 AS HUGEINT) ORDER BY event_id), lambda a, b: a * b % 4294967296) AS x FROM events)")
def prod_wrapping(spark, d):
    e = _events(spark, d, "event_id")
    return g.prod(g.DArray(e.df.select("i", (F.col("v") * 2 + 1).cast("int").alias("v")), shape=e.shape), wrap=True).df


@query("SELECT min(value) AS v FROM events")
def minimum(spark, d):
    return g.minimum(_events(spark, d, "value")).df


@query("SELECT max(value) AS v FROM events")
def maximum(spark, d):
    return g.maximum(_events(spark, d, "value")).df


@query("SELECT count(*) FILTER (WHERE value > 50) AS v FROM events")
def count_pred(spark, d):
    return g.count(_events(spark, d, "value"), lambda v: v > 50).df


@query(_E + "SELECT i1, CAST(1 AS BIGINT) AS i2, CAST(1 AS BIGINT) AS i3, count(*) FILTER (WHERE v > 0) AS v FROM e GROUP BY i1")
def count_dims(spark, d):
    return g.count(_scaled(spark, d), lambda v: v > 0, dims=(2, 3)).df


@query("SELECT coalesce(bool_or(value > 100), false) AS v FROM events")
def any_true(spark, d):
    return g.any(lambda v: v > 100, _events(spark, d, "value")).df


@query("SELECT coalesce(bool_or(value > 1e12), false) AS v FROM events")
def any_first(spark, d):
    return g.any(lambda v: v > 1e12, _events(spark, d, "value"), alg="first").df


@query("SELECT coalesce(bool_and(user_id >= 0), true) AS v FROM events")
def all_true(spark, d):
    return g.all(lambda v: v >= 0, _events(spark, d)).df


@query("SELECT coalesce(bool_and(user_id < 0), true) AS v FROM events WHERE user_id < -1")
def all_empty(spark, d):
    e = _events(spark, d)
    return g.all(lambda v: v < 0, g.DArray(e.df.where("v < -1"), shape=(0,))).df


_UPTO = "OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING)"
_BEFORE = "OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"SELECT event_id + 1 AS i, CAST(sum(user_id) {_UPTO} AS BIGINT) AS v FROM events")
def accumulate_inclusive(spark, d):
    return g.accumulate("+", _events(spark, d), init=0, bucket=4096).df


@query(f"SELECT event_id + 1 AS i, CAST(coalesce(sum(user_id) {_BEFORE}, 0) AS BIGINT) AS v FROM events")
def accumulate_exclusive(spark, d):
    return g.accumulate("+", _events(spark, d), init=0, inclusive=False, bucket=4096).df


@query(f"SELECT event_id + 1 AS i, CAST(10 + coalesce(sum(user_id) {_BEFORE}, 0) AS BIGINT) AS v FROM events")
def accumulate_init(spark, d):
    return g.accumulate("+", _events(spark, d), init=10, inclusive=False).df


@query(f"SELECT event_id + 1 AS i, max(user_id) {_UPTO} AS v FROM events")
def accumulate_max(spark, d):
    return g.accumulate("max", _events(spark, d), init=-1).df


@query(f"SELECT event_id + 1 AS i, CAST((sum(user_id) {_UPTO} + 5) % 1000003 AS BIGINT) AS v FROM events")
def accumulate_custom_op(spark, d):
    return g.accumulate(lambda a, b: (a + b) % 1_000_003, _events(spark, d), init=5, neutral=0).df


@query(_E + "SELECT i1, i2, i3, CAST(sum(v) OVER (PARTITION BY i1, i2 ORDER BY i3 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS v FROM e")
def accumulate_dims(spark, d):
    return g.accumulate("+", _scaled(spark, d), init=0, dims=3).df


@query(_E + "SELECT i1, i2, i3, CAST(coalesce(sum(v) OVER (PARTITION BY i2, i3 ORDER BY i1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS v FROM e")
def accumulate_dims_exclusive(spark, d):
    return g.accumulate("+", _scaled(spark, d), init=0, dims=1, inclusive=False, bucket=64).df


@query(_E + "SELECT i1, i2, i3, CAST(sum(v) OVER (ORDER BY i3, i2, i1 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS v FROM e")
def accumulate_linear_nd(spark, d):
    return g.accumulate("+", _scaled(spark, d), init=0, bucket=2048).df


@query(f"SELECT event_id + 1 AS i, CAST(sum(user_id) {_UPTO} AS BIGINT) AS v FROM events")
def cumsum(spark, d):
    return g.cumsum(_events(spark, d)).df


@query(_E + "SELECT i1, i2, i3, CAST(sum(v) OVER (PARTITION BY i1, i3 ORDER BY i2 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS v FROM e")
def cumsum_dims(spark, d):
    return g.cumsum(_scaled(spark, d), dims=2).df


@query(f"SELECT event_id + 1 AS i, CAST(sum(CAST(value > 50 AS INT)) {_UPTO} AS BIGINT) AS v FROM events")
def cumsum_bool(spark, d):
    e = _events(spark, d, "value")
    return g.cumsum(g.DArray(e.df.select("i", (F.col("v") > 50).alias("v")), shape=e.shape)).df


@query(_E + "SELECT i1, i2, i3, CAST(product(CAST(v % 3 AS DOUBLE)) OVER (PARTITION BY i1, i2 ORDER BY i3 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS v FROM e")
def cumprod_dims(spark, d):
    return g.cumprod(g.map(lambda v: v % 3, _scaled(spark, d)), dims=3).df


@query("SELECT row_number() OVER (ORDER BY user_id, event_id) AS i, user_id AS v FROM events")
def sort_asc(spark, d):
    return g.sort(_events(spark, d)).df


@query("SELECT row_number() OVER (ORDER BY user_id, event_id) AS i, user_id AS v FROM events")
def sort_distributed(spark, d):
    return g.sort(_events(spark, d), small=0).df


@query("SELECT row_number() OVER (ORDER BY abs(user_id - 500), event_id) AS i, user_id AS v FROM events")
def sort_by_abs(spark, d):
    return g.sort(_events(spark, d), by=lambda v: F.abs(v - 500)).df


@query("SELECT row_number() OVER (ORDER BY value DESC, event_id) AS i, value AS v FROM events")
def sort_rev(spark, d):
    return g.sort(_events(spark, d, "value"), rev=True).df


_ODD = "CASE event_id % 50 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('-0.0' AS DOUBLE) WHEN 2 THEN CAST(0 AS DOUBLE) WHEN 3 THEN -value ELSE value END"


@query(f"SELECT row_number() OVER (ORDER BY CASE WHEN isnan(x) THEN 1 ELSE 0 END, x, CASE WHEN x = 0 AND starts_with(CAST(x AS VARCHAR), '-') THEN 0 ELSE 1 END, event_id) AS i, CAST(x AS VARCHAR) = '-0.0' AS negative_zero, isnan(x) AS is_nan FROM (SELECT event_id, {_ODD} AS x FROM events)")
def sort_float_total_order(spark, d):
    df = _table(spark, d, "events")
    r = F.col("event_id") % 50
    x = F.when(r == 0, F.lit(float("nan"))).when(r == 1, F.lit(-0.0)).when(r == 2, F.lit(0.0)).when(r == 3, -F.col("value")).otherwise(F.col("value"))
    a = g.DArray(df.select((F.col("event_id") + 1).alias("i"), x.alias("v")), shape=(df.count(),))
    return g.sort(a).df.select("i", (F.col("v").cast("string") == "-0.0").alias("negative_zero"), F.isnan("v").alias("is_nan"))


@query("SELECT row_number() OVER (ORDER BY c_nationkey, c_mktsegment, c_custkey) AS i, c_nationkey AS a, c_mktsegment AS b FROM customer")
def sort_tuple(spark, d):
    df = _table(spark, d, "customer").select((F.col("c_custkey") + 1).alias("i"), F.struct(F.col("c_nationkey").alias("a"), F.col("c_mktsegment").alias("b")).alias("v"))
    return g.sort(g.DArray(df, shape=(df.count(),))).df.select("i", "v.a", "v.b")


@query("SELECT row_number() OVER (ORDER BY o_custkey, o_orderkey) AS i, o_custkey AS k, o_orderpriority AS v FROM orders")
def sort_by_key(spark, d):
    df = _table(spark, d, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v"))
    n = (df.count(),)
    return g.sort_by_key(g.DArray(df, value="k", shape=n), g.DArray(df, value="v", shape=n))[1].df


@query("SELECT row_number() OVER (ORDER BY c_nationkey, c_custkey) AS i, c_custkey + 1 AS v FROM customer")
def sortperm_stable(spark, d):
    return g.sortperm(_customers(spark, d, "c_nationkey")).df


@query("SELECT row_number() OVER (ORDER BY c_nationkey DESC, c_custkey) AS i, c_custkey + 1 AS v FROM customer")
def sortperm_rev(spark, d):
    return g.merge_sortperm(_customers(spark, d, "c_nationkey"), rev=True).df


@query("SELECT (SELECT count(*) FROM events) - event_id AS i, user_id AS v FROM events")
def reverse_1d(spark, d):
    return g.reverse(_events(spark, d)).df


@query(_E + "SELECT (SELECT max(i1) FROM e) + 1 - i1 AS i1, 9 - i2 AS i2, 9 - i3 AS i3, v FROM e")
def reverse_nd(spark, d):
    return g.reverse(_scaled(spark, d)).df


def _haystack(spark, d):
    return g.sort(_orders(spark, d, "o_custkey"))


_KEYS = "(SELECT o_custkey AS k, CAST(sum(count(*)) OVER (ORDER BY o_custkey) AS BIGINT) AS n FROM orders GROUP BY o_custkey)"


@query(f"SELECT e.event_id + 1 AS i, coalesce(max(k.n), 0) + 1 AS v FROM events e LEFT JOIN {_KEYS} k ON k.k < e.user_id GROUP BY e.event_id")
def searchsortedfirst(spark, d):
    return g.searchsortedfirst(_haystack(spark, d), _events(spark, d)).df


@query(f"SELECT e.event_id + 1 AS i, coalesce(max(k.n), 0) AS v FROM events e LEFT JOIN {_KEYS} k ON k.k <= e.user_id GROUP BY e.event_id")
def searchsortedlast(spark, d):
    return g.searchsortedlast(_haystack(spark, d), _events(spark, d), small=0).df


@query("SELECT e.event_id + 1 AS i, 1 + coalesce(max(k.n), 0) AS v FROM events e LEFT JOIN (SELECT o_custkey AS k, CAST(sum(count(*)) OVER (ORDER BY o_custkey DESC) AS BIGINT) AS n FROM orders GROUP BY o_custkey) k ON k.k > e.user_id GROUP BY e.event_id")
def searchsorted_rev(spark, d):
    return g.searchsortedfirst(g.sort(_orders(spark, d, "o_custkey"), rev=True), _events(spark, d), rev=True).df


@query("SELECT t AS task, CAST(sum(user_id) AS BIGINT) AS v, count(*) AS n FROM (SELECT user_id, CAST(floor(event_id * 8 / (SELECT count(*) FROM events)) AS BIGINT) + 1 AS t FROM events) GROUP BY t")
def task_partition_ranges(spark, d):
    e = _events(spark, d)
    parts = g.TaskPartitioner(len(e), 8)
    return e.df.groupBy(parts.task(F.col("i")).alias("task")).agg(F.sum("v").alias("v"), F.count("*").alias("n"))


@query("SELECT row_number() OVER (ORDER BY event_id) AS i, user_id AS v FROM events WHERE user_id % 3 = 0")
def compact_scan(spark, d):
    return g.compact(lambda v: v % 3 == 0, _events(spark, d)).df


@query("SELECT v AS i, v * v AS v FROM generate_series(1, 1000) t(v)")
def range_source(spark, d):
    return g.map(lambda v: v * v, g.from_range(spark, 1, 1000)).df


@query("SELECT event_id + 1 AS i, user_id * 3 + 1 AS v FROM events")
def map_python(spark, d):
    return g.map(lambda v: v * 3 + 1, _events(spark, d), python=True).df


@query("SELECT event_id + 1 AS i, user_id * 3 AS v FROM events")
def map_python_batch(spark, d):
    import pyarrow.compute as pc

    return g.map(lambda v: pc.multiply(v, 3), _events(spark, d), python="batch").df


@query("SELECT event_id + 1 AS i, user_id * 2 - (event_id + 1) AS v FROM events")
def foreachindex_two_arrays(spark, d):
    e = _events(spark, d)
    return g.foreachindex(lambda a, b, i: a + b - i, e, _events(spark, d)).df


@query("SELECT event_id + 1 AS i, user_id * (event_id + 1) AS v FROM events")
def foreachindex_python(spark, d):
    return g.foreachindex(lambda v, i: v * i, _events(spark, d), python=True).df


@query(_E + "SELECT i1, i2, i3, v - min(v) OVER (PARTITION BY i1) AS v FROM e")
def foraxes_python(spark, d):
    return g.foraxes(lambda i, row: [x - min(row) for x in row], _scaled(spark, d), dims=1, python=True).df


@query("SELECT CAST(3 + sum(user_id) AS BIGINT) AS v FROM events")
def reduce_python(spark, d):
    return g.reduce(lambda a, b: a + b, _events(spark, d), init=3, neutral=0, python=True).df


_HOLED = "CASE WHEN event_id % 1000 = 7 THEN CAST('NaN' AS DOUBLE) ELSE CAST(user_id AS DOUBLE) END"


def _holed(spark, d):
    e = _events(spark, d)
    return g.DArray(e.df.select("i", F.when((F.col("i") - 1) % 1000 == 7, F.lit(float("nan"))).otherwise(F.col("v").cast("double")).alias("v")), shape=e.shape)


@query(f"SELECT bool_or(isnan({_HOLED})) AS is_nan FROM events")
def reduce_python_nan(spark, d):
    return g.reduce(lambda a, b: a + b, _holed(spark, d), init=0.0, neutral=0.0, python=True).df.select(F.isnan("v").alias("is_nan"))


@query(f"SELECT event_id + 1 AS i, CAST(4 + sum(user_id) {_UPTO} AS BIGINT) AS v FROM events")
def accumulate_python(spark, d):
    return g.accumulate(lambda a, b: a + b, _events(spark, d), init=4, neutral=0, python=True).df


@query(f"SELECT event_id + 1 AS i, event_id > 7 AS is_nan, CASE WHEN event_id > 7 THEN -1 ELSE coalesce(sum(user_id) {_BEFORE}, 0) END::DOUBLE AS v FROM events")
def accumulate_python_nan(spark, d):
    out = g.accumulate(lambda a, b: a + b, _holed(spark, d), init=0.0, neutral=0.0, inclusive=False, python=True).df
    return out.select("i", F.isnan("v").alias("is_nan"), F.when(F.isnan("v"), -1.0).otherwise(F.col("v")).alias("v"))


@query("SELECT CAST(sum(length(event_type)) AS BIGINT) AS v FROM events")
def mapreduce_python_f(spark, d):
    return g.mapreduce(len, "+", _events(spark, d, "event_type"), init=0, python_f="int64", dtype="int64").df


@query("SELECT count(*) FILTER (WHERE user_id % 7 = 3) AS n, bool_or(user_id = 5) AS some, bool_and(user_id >= 1) AS every FROM events")
def predicates_python(spark, d):
    e = _events(spark, d)
    n, some = g.count(e, lambda v: v % 7 == 3, python=True).get(), g.any(lambda v: v == 5, e, python=True).get()
    return spark.range(1).select(F.lit(n).cast("bigint").alias("n"), F.lit(some).alias("some"), F.lit(g.all(lambda v: v >= 1, e, python=True).get()).alias("every"))


@query(f"SELECT event_id + 1 AS i, CAST(((s + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 AS INTEGER) AS v FROM (SELECT event_id, sum(CAST(user_id * 1000003 % 2147483647 AS HUGEINT)) {_UPTO} AS s FROM events)")
def cumsum_wrapping(spark, d):
    e = _events(spark, d)
    return g.cumsum(g.DArray(e.df.select("i", (F.col("v") * 1000003 % 2147483647).cast("int").alias("v")), shape=e.shape), wrap=True, bucket=2048).df


@query(_E + "SELECT i1, i2, i3, CAST(((x + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 AS INTEGER) AS v FROM (SELECT i1, i2, i3, list_reduce(list(CAST(v + 5 AS HUGEINT)) OVER (PARTITION BY i1, i2 ORDER BY i3 ROWS UNBOUNDED PRECEDING), lambda a, b: a * b) AS x FROM e)")
def cumprod_wrapping_dims(spark, d):
    e = _scaled(spark, d)
    return g.cumprod(g.DArray(e.df.select("i1", "i2", "i3", (F.col("v") + 5).cast("int").alias("v")), e.index, "v", e.shape), dims=3, wrap=True).df


@query(f"SELECT event_id + 1 AS i, CAST(sum(user_id) {_UPTO} AS DOUBLE) AS v FROM events")
def accumulate_into(spark, d):
    e = _events(spark, d)
    return g.accumulate_("+", g.DArray(e.df.select("i", F.col("v").cast("double").alias("v")), shape=e.shape), e, init=0).df


@query(f"SELECT event_id + 1 AS i, min(user_id) {_UPTO} AS v FROM events")
def accumulate_lookback(spark, d):
    return g.accumulate("min", _events(spark, d), init=2**40, alg="lookback", tuning=g.Tuning(max_tasks=4, block_size=256)).df


@query("SELECT row_number() OVER (ORDER BY user_id % 10, user_id DESC, event_id) AS i, user_id AS v FROM events")
def sort_custom_lt(spark, d):
    less = lambda a, b: (a % 10 < b % 10) | ((a % 10 == b % 10) & (a > b))
    return g.sort(_events(spark, d), lt=less).df


@query("SELECT row_number() OVER (ORDER BY user_id % 10 DESC, event_id) AS i, event_id + 1 AS v FROM events")
def sortperm_custom_lt(spark, d):
    return g.sortperm(_events(spark, d), lt=lambda a, b: a % 10 < b % 10, rev=True).df


@query("SELECT e.event_id + 1 AS i, coalesce(max(k.n), 0) + 1 AS v FROM events e LEFT JOIN (SELECT o_custkey % 50 AS k, CAST(sum(count(*)) OVER (ORDER BY o_custkey % 50) AS BIGINT) AS n FROM orders GROUP BY o_custkey % 50) k ON k.k < e.user_id % 50 GROUP BY e.event_id")
def searchsortedfirst_custom_lt(spark, d):
    less = lambda a, b: a % 50 < b % 50
    return g.searchsortedfirst(g.sort(_orders(spark, d, "o_custkey"), lt=less), _events(spark, d), lt=less).df


@query("SELECT row_number() OVER (ORDER BY user_id DESC, event_id) AS i, user_id AS v FROM events")
def sort_order_composition(spark, d):
    return g.sort(_events(spark, d), lt=">", rev=True, order="reverse").df


@query("SELECT row_number() OVER (ORDER BY user_id * 37 % 1009, event_id) AS i, user_id AS v FROM events")
def sort_by_python(spark, d):
    return g.sort(_events(spark, d), by=g.opaque(lambda v: v * 37 % 1009, "int64")).df


_SORTED = "SELECT row_number() OVER (ORDER BY user_id, event_id) AS i, user_id AS v FROM events"
_PERMUTED = "SELECT row_number() OVER (ORDER BY user_id, event_id) AS i, event_id + 1 AS v FROM events"


def _variant(name, sql, run):
    def f(spark, d):
        return run(_events(spark, d)).df

    f.__name__ = name
    query(sql)(f)


_variant("sort_merge", _SORTED, g.merge_sort)
_variant("sort_sample", _SORTED, g.sample_sort)
_variant("sort_radix", _SORTED, g.radix_sort)
_variant("sort_in_place", _SORTED, g.sort_)
_variant("sortperm_sample", _PERMUTED, g.sample_sortperm)
_variant("sortperm_lowmem", _PERMUTED, g.merge_sortperm_lowmem)
_variant("sortperm_into", _PERMUTED.replace("event_id + 1", "CAST(event_id + 1 AS INTEGER)"), lambda e: g.sortperm_(g.DArray(e.df.select("i", F.col("v").cast("int").alias("v")), shape=e.shape), e))
_variant("reverse_into", "SELECT (SELECT count(*) FROM events) - event_id AS i, CAST(user_id AS DOUBLE) AS v FROM events", lambda e: g.reverse_(g.DArray(e.df.select("i", F.col("v").cast("double").alias("v")), shape=e.shape), e))


@query("SELECT event_id + 1 AS i, user_id AS v FROM events")
def rows_in_file_order(spark, d):
    return g.from_rows(_table(spark, d, "events"), "user_id").df


@query("SELECT event_id + 1 AS i, user_id AS v FROM events")
def copy_to_table_and_back(spark, d):
    from gridloom.plans.scratch import scratch

    path = scratch(spark)
    g.to_table(_events(spark, d), path, partitions=3)
    return g.from_table(spark.read.parquet(path), "i", "v").df


@query("SELECT CAST(1 AS BIGINT) AS i1, i2, CAST(7 AS BIGINT) AS v FROM generate_series(1, 3) t(i2)")
def reduce_over_an_empty_axis(spark, d):
    none = _events(spark, d).df.where("v < 0").select(F.col("i").alias("i1"), F.col("i").alias("i2"), "v")
    return g.reduce("+", g.DArray(none, ("i1", "i2"), "v", (0, 3)), init=7, dims=1).df


@query("SELECT max(l_quantity * (1 + l_discount)) AS v FROM lineitem")
def mapreduce_struct_to_number(spark, d):
    df = _table(spark, d, "lineitem").select(F.lit(1).alias("i"), F.struct(F.col("l_quantity").alias("x"), F.col("l_discount").alias("y")).alias("v"))
    return g.mapreduce(lambda p: p["x"] * (1 + p["y"]), "max", g.DArray(df), init=float("-inf"), dtype="float64").df


@query("SELECT t AS task, count(*) AS n, CAST(max(user_id) AS BIGINT) AS top, CAST(min(event_id + 1) AS BIGINT) AS start FROM (SELECT event_id, user_id, CAST(floor(event_id * 8 / (SELECT count(*) FROM events)) AS BIGINT) + 1 AS t FROM events) GROUP BY t")
def itask_partition_totals(spark, d):
    import pandas as pd

    def totals(task, rows):
        return pd.DataFrame({"task": [task], "n": [len(rows)], "top": [rows["v"].max()], "start": [rows["i"].iloc[0]]})

    return g.itask_partition(totals, _events(spark, d), "task long, n long, top long, start long", 8)


@query("SELECT event_id + 1 AS i, user_id AS v, CAST(row_number() OVER (PARTITION BY t ORDER BY event_id) AS BIGINT) AS place FROM (SELECT event_id, user_id, CAST(floor(event_id * 8 / (SELECT count(*) FROM events)) AS BIGINT) AS t FROM events)")
def task_partition_rows(spark, d):
    return g.task_partition(lambda rows: rows.assign(place=range(1, len(rows) + 1)), _events(spark, d), "i long, v long, place long", 8)


@query("SELECT CAST(-5 AS TINYINT) AS a, CAST(300 AS SMALLINT) AS b, CAST(70000 AS INTEGER) AS c, CAST(5000000000 AS BIGINT) AS d, CAST(200 AS SMALLINT) AS e, CAST(60000 AS INTEGER) AS f, CAST(4000000000 AS BIGINT) AS g, CAST(18446744073709551615 AS DECIMAL(20,0)) AS h")
def typed_literals(spark, d):
    return spark.range(1).select(g.i8(-5).alias("a"), g.i16(300).alias("b"), g.i32(70000).alias("c"), g.i64(5 * 10**9).alias("d"), g.u8(200).alias("e"), g.u16(60000).alias("f"), g.u32(4 * 10**9).alias("g"), g.u64(2**64 - 1).alias("h"))


@query("SELECT i, CAST(floor((i - 1) * 1000 / 6) AS BIGINT) + 10 AS v FROM generate_series(1, 7) t(i)")
def linspace(spark, d):
    return g.int_linspace(spark, 10, 1010, 7).df


@query("SELECT 'spark' AS backend, min(user_id) AS v FROM events")
def backend_and_synchronize(spark, d):
    e = _events(spark, d)
    g.synchronize(e)
    return g.minimum(e).df.select(F.lit(g.get_backend(e)).alias("backend"), "v")


@query("SELECT * FROM (VALUES ('length', true), ('negative dims', true), ('radix permutation', true), ('shape', true), ('unknown algorithm', true), ('unknown operation', true)) t(name, raised)")
def errors_raised(spark, d):
    e, n = _events(spark, d), g.from_range(spark, 1, 3)
    cases = {
        "length": (ValueError, lambda: g.reverse_(n, e)),
        "negative dims": (ValueError, lambda: g.reduce("+", e, init=0, dims=-1)),
        "radix permutation": (ValueError, lambda: g.sortperm(e, alg="radix")),
        "shape": (g.DimensionMismatch, lambda: g.mapreduce(lambda a, b: a + b, "+", e, n, init=0)),
        "unknown algorithm": (ValueError, lambda: g.accumulate("+", e, init=0, alg="magic")),
        "unknown operation": (ValueError, lambda: g.reduce("?", e, init=0)),
    }
    rows = []
    for name, (kind, call) in sorted(cases.items()):
        try:
            call()
            rows.append((name, False))
        except kind:
            rows.append((name, True))
    return spark.createDataFrame(rows, "name string, raised boolean")


def _prices(spark, d):
    df = _table(spark, d, "lineitem")
    rows = g.from_rows(df, "l_extendedprice", "float64")
    return g.DArray(rows.df.select("i", F.round(F.col("v") * 100).cast("bigint").alias("v")), shape=(df.count(),))


_BY_PRICE = "(SELECT CAST(round(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem)"


@query(f"SELECT row_number() OVER (ORDER BY v) AS i, v FROM {_BY_PRICE}")
def sort_prices(spark, d):
    return g.sort(_prices(spark, d)).df


@query(f"SELECT row_number() OVER (ORDER BY v) AS i, CAST(sum(v) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS BIGINT) AS v FROM {_BY_PRICE}")
def cumsum_sorted_prices(spark, d):
    return g.cumsum(g.sort(_prices(spark, d))).df


@query(f"SELECT CAST(bit_xor(v) AS BIGINT) AS v FROM {_BY_PRICE}")
def reduce_prices(spark, d):
    return g.reduce("xor", _prices(spark, d), init=0).df


@query(_E + "SELECT i1, i2, i3, v + 10 AS v FROM e")
def reduce_along_no_axis(spark, d):
    return g.reduce("+", _scaled(spark, d), init=10, dims=9).df


@query(_E + "SELECT i1, i2, i3, v FROM e")
def accumulate_along_no_axis(spark, d):
    return g.accumulate("+", _scaled(spark, d), init=10, dims=9).df


@query("SELECT CAST(1 AS BIGINT) AS i1, CAST(1 AS BIGINT) AS i2, CAST(0 AS BIGINT) AS v FROM events WHERE event_id < 0")
def reduce_with_an_empty_kept_axis(spark, d):
    none = _events(spark, d).df.where("v < 0").select(F.col("i").alias("i1"), F.col("i").alias("i2"), "v")
    return g.reduce("+", g.DArray(none, ("i1", "i2"), "v", (3, 0)), init=7, dims=1).df


@query(f"SELECT bool_or(isnan({_HOLED})) AS low, bool_or(isnan({_HOLED})) AS high FROM events")
def bounds_with_nan(spark, d):
    a = _holed(spark, d)
    low, high = g.minimum(a).get(), g.maximum(a).get()
    return spark.range(1).select(F.isnan(F.lit(low)).alias("low"), F.isnan(F.lit(high)).alias("high"))


@query("SELECT false AS some, true AS every, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS total, CAST(1 AS BIGINT) AS product")
def results_of_nothing(spark, d):
    e = _events(spark, d)
    a = g.DArray(e.df.where("v < 0"), ("i",), "v", (0,))
    some, every = g.any(lambda v: v > 0, a).get(), g.all(lambda v: v > 0, a).get()
    return spark.range(1).select(F.lit(some).alias("some"), F.lit(every).alias("every"), *[F.lit(x.get()).cast("bigint").alias(n) for n, x in (("n", g.count(a, lambda v: v > 0)), ("total", g.sum(a)), ("product", g.prod(a)))])


@query(f"SELECT e.event_id + 1 AS i, coalesce(max(k.n), 0) AS v FROM events e LEFT JOIN {_KEYS} k ON k.k <= e.user_id GROUP BY e.event_id")
def searchsortedlast_into(spark, d):
    e = _events(spark, d)
    return g.searchsortedlast_(e, _haystack(spark, d), e).df


@query("SELECT row_number() OVER (ORDER BY o_custkey DESC, o_orderkey) AS i, o_custkey AS k, o_orderpriority AS v FROM orders")
def sort_by_key_in_place(spark, d):
    df = _table(spark, d, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v"))
    n = (df.count(),)
    return g.merge_sort_by_key_(g.DArray(df, value="k", shape=n), g.DArray(df, value="v", shape=n), rev=True)[1].df


def flagship(spark, d):
    """Order values by customer, their running total, and where it passes even steps."""
    df = _table(spark, d, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_custkey").alias("k"), _cents("o_totalprice").alias("v"))
    n = (df.count(),)
    _, values = g.sort_by_key(g.DArray(df, value="k", shape=n), g.DArray(df, value="v", shape=n))
    totals = g.cumsum(g.DArray(values.df.select("i", "v"), shape=n, dtype="int64"))
    steps = g.map(lambda v: v * 100_000_000, g.from_range(spark, 1, 20))
    found = g.searchsortedfirst(totals, steps)
    return found.df.select(F.col("i").alias("step"), F.col("v").alias("position"))

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import api as g
from gridloom.queries import QUERIES, SQL

KINDS = {"int32": np.int32, "int64": np.int64, "float32": np.float32, "float64": np.float64}


def array(spark, values, dtype="int64"):
    values = np.asarray(values)
    return g.from_values(spark, values.ravel(order="F").tolist(), dtype, values.shape)


def dense(result):
    """A DArray as numpy, by its index columns."""
    out = np.full(result.shape, np.nan, dtype=object)
    for r in result.df.collect():
        out[tuple(r[c] - 1 for c in result.index)] = r[result.value]
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 255, 257, 4097])
def test_sum_and_bounds_of_sizes(spark, n):
    x = np.random.default_rng(n).integers(-1000, 1000, n)
    a = array(spark, x)
    assert g.reduce("+", a, init=5).get() == 5 + int(x.sum())
    assert g.maximum(a).get() == (int(x.max()) if n else -(2**63))
    assert g.minimum(a, init=-5000).get() == -5000


@pytest.mark.parametrize("op,fold", [("|", np.bitwise_or), ("&", np.bitwise_and), ("xor", np.bitwise_xor)])
def test_bits(spark, op, fold):
    x = np.random.default_rng(1).integers(0, 2**31 - 1, 100)
    assert g.reduce(op, array(spark, x), init=g.neutral_element(op, "int64")).get() == int(fold.reduce(x))


def test_types_follow_init_or_element(spark):
    a = array(spark, [1, 2, 3], "int32")
    assert g.sum(a).df.schema[0].dataType.simpleString() == "int"
    assert g.count(a, lambda v: v > 1).df.schema[0].dataType.simpleString() == "bigint"
    assert g.reduce("+", a, init=0.5).get() == 6.5
    assert g.mapreduce(lambda v: v.cast("float"), "+", a, init=0.0, dtype="float32").df.schema[0].dataType.simpleString() == "float"


def test_overflow_is_an_error_or_wraps(spark):
    a = array(spark, [2**31 - 1, 2], "int32")
    with pytest.raises(Exception, match="OVERFLOW"):
        g.sum(a).get()
    assert g.sum(a, wrap=True).get() == -(2**31) + 1
    u = array(spark, [250, 10], "uint8")
    assert g.sum(u, wrap=True).get() == 4


def test_product_is_exact(spark):
    x = [3] * 39
    assert g.prod(array(spark, x)).get() == 3**39
    assert g.prod(array(spark, [])).get() == 1
    assert g.reduce("*", array(spark, x), init=1, bucket=4).get() == 3**39
    assert g.prod(array(spark, [0.5, 4.0], "float64")).get() == 2.0


@pytest.mark.parametrize("bucket", [2, 4, 4096])
def test_only_the_whole_product_must_fit(spark, bucket):
    prod = lambda x, dtype="int64", init=1: g.reduce("*", array(spark, x, dtype), init=init, dtype=dtype, bucket=bucket).get()
    assert prod([2] * 63 + [1] * 10 + [-1]) == -(2**63) == prod([-1] + [2] * 63)
    assert prod([2] * 63, init=-1) == -(2**63) == prod([-(2**63), -1], init=-1)
    assert prod([2**62] * 9 + [0]) == 0 == prod([0, -(2**63), -(2**63), 2**62])
    assert prod([2] * 7 + [-1], "int8") == -(2**7)
    for x in ([2] * 63, [97, 10**17], [-97, 10**17], [-3] * 41, [2**62] * 9 + [-1], [-(2**63), 1, -1]):
        with pytest.raises(Exception, match="(?i)overflow"):
            prod(x)
    with pytest.raises(Exception, match="(?i)overflow"):
        prod([2] * 7, "int8")
    a = array(spark, [[2**62, 2**62, 0], [2**62, 2, -1]])
    assert (dense(g.reduce("*", a, init=1, dims=2, bucket=bucket)) == np.array([[0], [-(2**63)]], dtype=object)).all()


def test_prod_int_query_at_the_limit_of_a_long(spark, tmp_path):
    import duckdb

    for n in (319_998, 319_999, 600_000):  # 2**63, -2**63 by way of 2**63, 2**120
        d = str(tmp_path / str(n))
        spark.range(n).withColumnRenamed("id", "event_id").write.parquet(f"{d}/events.parquet")
        sql = duckdb.connect()
        sql.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet/*.parquet'")
        if n == 319_999:
            want = sql.execute(SQL["prod_int"]).fetchall()
            assert [tuple(r) for r in QUERIES["prod_int"](spark, d).collect()] == want == [(-(2**63),)]
            continue
        with pytest.raises(duckdb.ConversionException):
            sql.execute(SQL["prod_int"]).fetchall()
        with pytest.raises(Exception, match="(?i)overflow"):
            QUERIES["prod_int"](spark, d).collect()


def test_nan(spark):
    a = array(spark, [1.0, math.nan, -2.5], "float64")
    assert math.isnan(g.minimum(a).get()) and math.isnan(g.maximum(a).get())
    assert g.minimum(array(spark, [], "float64")).get() == math.inf


def test_custom_operations_keep_order(spark):
    # composition of affine maps is associative and does not commute
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 97, (300, 2))]
    df = spark.createDataFrame([(i + 1, p) for i, p in enumerate(pairs)], "i bigint, v struct<a:bigint,b:bigint>")
    s = g.DArray(df, shape=(300,))
    op = lambda x, y: F.struct(((x["a"] * y["a"]) % 97).alias("a"), ((x["b"] * y["a"] + y["b"]) % 97).alias("b"))
    one = F.struct(F.lit(1).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))
    got = g.reduce(op, s, init=one, neutral=one, dtype="struct<a:bigint,b:bigint>", bucket=16).get()
    a, b = 1, 0
    for p, q in pairs:
        a, b = a * p % 97, (b * p + q) % 97
    assert (got["a"], got["b"]) == (a, b)


def test_python_operation(spark):
    x = list(range(1, 50))
    assert g.reduce(math.gcd, array(spark, [6 * v for v in x]), init=0, neutral=0, python=True, bucket=8).get() == 6


def test_dims_against_numpy(spark):
    x = np.random.default_rng(3).integers(-9, 9, (3, 4, 2))
    a = array(spark, x)
    for dims in [1, (2,), (1, 3), [3, 3, 1], range(1, 4), (2, 9)]:
        which = tuple(sorted({d - 1 for d in ([dims] if isinstance(dims, int) else dims) if d <= 3}))
        got = g.reduce("+", a, init=10, dims=dims)
        assert (dense(got) == x.sum(axis=which, keepdims=True) + 10).all()
    assert (dense(g.prod(a, dims=2)) == x.prod(axis=1, keepdims=True)).all()
    assert (dense(g.maximum(a, dims=(1, 2))) == x.max(axis=(0, 1), keepdims=True)).all()
    assert g.sum(a, dims=":").get() == x.sum()


@pytest.mark.parametrize("dims", [4, (), []])
def test_no_axis_within_the_array_maps(spark, dims):
    a = array(spark, [[1, 2], [3, 4]])
    assert (dense(g.mapreduce(lambda v: v * v, "+", a, init=1, dims=dims)) == np.array([[2, 5], [10, 17]])).all()


@pytest.mark.parametrize("shape", list(itertools.product((0, 2), repeat=2)))
@pytest.mark.parametrize("dims", [1, 2, (1, 2)])
def test_empty_axes(spark, shape, dims):
    x = np.ones(shape, dtype=int)
    got = g.reduce("+", array(spark, x), init=7, dims=dims)
    want = x.sum(axis=tuple(d - 1 for d in ([dims] if isinstance(dims, int) else dims)), keepdims=True) + 7
    assert got.shape == want.shape and (dense(got) == want).all() and got.df.count() == want.size


@pytest.mark.parametrize("dims", [0, -1, 1.0, (1, 0), True, (2.5,)])
def test_bad_dims(spark, dims):
    with pytest.raises(ValueError):
        g.reduce("+", array(spark, [[1]]), init=0, dims=dims)


def test_bad_arguments(spark):
    a = array(spark, [1])
    with pytest.raises(TypeError):
        g.reduce("+", a)
    with pytest.raises(TypeError):
        g.reduce("+", a, init=0, threads=4)
    with pytest.raises(ValueError):
        g.reduce("foo", a, init=0)
    with pytest.raises(ValueError):
        g.reduce(lambda x, y: x, a, init=0)
    for bad in (3, 1024, 0):
        with pytest.raises(ValueError):
            g.reduce("+", a, init=0, tuning=g.Tuning(block_size=bad))


def test_several_arrays(spark):
    rng = np.random.default_rng(4)
    xs = [rng.integers(-10, 10, (4, 5)) for _ in range(3)]
    arrays = [array(spark, x) for x in xs]
    got = g.mapreduce(lambda a, b, c: a * b + c, "+", *arrays, init=0)
    assert got.get() == int((xs[0] * xs[1] + xs[2]).sum())
    assert (dense(g.mapreduce(lambda a, b: a - b, "max", *arrays[:2], init=-99, dims=1)) == (xs[0] - xs[1]).max(axis=0, keepdims=True)).all()
    with pytest.raises(g.DimensionMismatch):
        g.mapreduce(lambda a, b: a, "+", arrays[0], array(spark, xs[1].T), init=0).get()


def test_one_table_needs_no_join(spark):
    df = spark.range(5).select((F.col("id") + 1).alias("i"), F.col("id").alias("a"), (F.col("id") * 2).alias("b"))
    out = g.mapreduce(lambda a, b: a * b, "+", g.DArray(df, value="a"), g.DArray(df, value="b"), init=0)
    assert "Join" not in out.df._jdf.queryExecution().toString() and out.get() == 60


def test_complex_and_extrema(spark):
    z = g.from_values(spark, [(1.0, 2.0), (3.0, -1.0)], "complex128")
    got = g.reduce("+", z, init=1j, dtype="complex128").get()
    assert (got["re"], got["im"]) == (4.0, 2.0)
    e = g.reduce("extrema", array(spark, [4, -2, 9]), init=g.neutral_element("extrema", "int64"), dtype="int64").get()
    assert tuple(e) == (-2, 9)


def test_predicates(spark):
    a, none = g.from_range(spark, 1, 100), array(spark, [])
    for alg in ("mapreduce", "first"):
        assert g.any(lambda v: v == 77, a, alg).get() and not g.any(lambda v: v > 100, a, alg).get()
        assert g.all(lambda v: v > 0, a, alg).get() and not g.all(lambda v: v > 1, a, alg).get()
        assert not g.any(lambda v: v > 0, none, alg).get() and g.all(lambda v: v > 0, none, alg).get()
    assert g.count(array(spark, [True, False, True], "bool")).get() == 2

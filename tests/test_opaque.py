import math

import numpy as np
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from gridloom import api as g
from gridloom.plans.ordered import ranked_by
from tests.test_reduce import array

NAN = float("nan")


def same(got, want):
    return len(got) == len(want) and all(a == b or (isinstance(a, float) and math.isnan(a) and math.isnan(b)) for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize("bucket", [2, 3, 100])
@pytest.mark.parametrize("inclusive", [True, False])
def test_scans_carry_nan(spark, bucket, inclusive):
    x = [1.0, NAN, 2.0, 3.0, 4.0, 5.0]
    want, total = [], 10.0
    for v in x:
        want.append(total + v if inclusive else total)
        total += v
    got = g.accumulate(lambda a, b: a + b, g.from_values(spark, x, "float64"), init=10.0, neutral=0.0, inclusive=inclusive, bucket=bucket, python=True)
    assert same(got.values(), want)


@pytest.mark.parametrize("bucket", [2, 100])
def test_folds_keep_nan_apart_from_null(spark, bucket):
    x = g.from_values(spark, [1.0, NAN, 2.0, 3.0], "float64")
    assert math.isnan(g.reduce(lambda a, b: a + b, x, init=0.0, neutral=0.0, bucket=bucket, python=True).get())
    last = g.reduce(lambda a, b: b, x, init=0.0, neutral=0.0, bucket=bucket, python=True).get()
    assert last == 3.0
    none = g.from_values(spark, [1.0, None, NAN, 3.0], "float64")
    count = lambda a, b: (a or 0.0) + (100.0 if b is None else 1.0 if math.isnan(b) else b)
    assert g.reduce(count, none, init=0.0, neutral=0.0, bucket=100, python=True).get() in (105.0, 104.0 + 1.0)
    assert g.accumulate(count, none, init=0.0, neutral=0.0, bucket=100, python=True).values()[1] == 101.0


def test_python_scan_along_an_axis_and_of_complex(spark):
    x = np.random.default_rng(4).integers(0, 9, (4, 5))
    got = g.accumulate(max, array(spark, x), init=3, neutral=0, dims=2, bucket=2, python=True)
    want = np.maximum(np.maximum.accumulate(x, axis=1), 3)
    assert got.values() == want.ravel(order="F").tolist()
    z = g.from_values(spark, [(1.0, 2.0), (0.0, 1.0), (2.0, 0.0)], "complex128")
    total = g.reduce(lambda a, b: a * b, z, init=1 + 0j, neutral=1, python=True).get()
    assert complex(total["re"], total["im"]) == (1 + 2j) * 1j * 2


def test_opaque_bodies(spark):
    a = array(spark, [3, 1, 2])
    assert g.foreachindex(lambda v, w, i: v * 10 + w - i, a, array(spark, [7, 8, 9])).values() == [36, 16, 26]
    assert g.foreachindex(lambda v, i: v if i % 2 else -v, a, python=True).values() == [3, -1, 2]
    assert g.foreachindex(lambda v, i: pc.add(v, i), a, python="batch").values() == [4, 3, 5]
    assert g.map(lambda v: pc.negate(v), a, python="batch").values() == [-3, -1, -2]
    assert g.count(a, lambda v: v > 1, python=True).get() == 2
    assert g.any(lambda v: v == 2, a, python=True).get() and not g.all(lambda v: v == 2, a, python=True).get()
    assert g.any(lambda v: v == 2, a, alg="first", python=True).get()
    assert g.mapreduce(lambda v: v / 2, "+", a, init=0.0, python_f="float64", dtype="float64").get() == 3.0
    assert g.sort(a, by=g.opaque(lambda v: -v, "int64")).values() == [3, 2, 1]
    assert g.map_(lambda v: v * 2, array(spark, [0, 0, 0], "int32"), a, python=True).df.schema["v"].dataType.simpleString() == "int"
    with pytest.raises(g.DimensionMismatch):
        g.foreachindex(lambda v, w, i: v, a, array(spark, [1]))


@pytest.mark.parametrize("dtype", ["int8", "int16", "int32", "int64", "uint8", "uint32", "uint64"])
def test_wrapping(spark, dtype):
    bits, signed = int(dtype.strip("uint")), not dtype.startswith("u")
    fit = lambda v: (v + 2 ** (bits - 1)) % 2**bits - 2 ** (bits - 1) if signed else v % 2**bits
    rng = np.random.default_rng(bits)
    x = [fit(int(v)) for v in rng.integers(-(2**62), 2**62, 40)]
    a = g.from_values(spark, x, dtype)
    product, sums, products, total = 1, [], [], 0
    for v in x:
        product, total = fit(product * v), fit(total + v)
        products.append(product)
        sums.append(total)
    assert int(g.prod(a, wrap=True).get()) == product and int(g.sum(a, wrap=True).get()) == total
    assert [int(v) for v in g.cumprod(a, wrap=True, bucket=8).values()] == products
    assert [int(v) for v in g.cumsum(a, wrap=True, bucket=8).values()] == sums


def test_overflow_is_an_error_without_wrap(spark):
    a = g.from_values(spark, [2**62] * 4, "int64")
    for run in (lambda: g.prod(a).get(), lambda: g.sum(a).get(), lambda: g.cumsum(a).values(), lambda: g.cumprod(a).values()):
        with pytest.raises(Exception, match="(?i)overflow"):
            run()


@pytest.mark.parametrize("n", [0, 1, 7, 300])
def test_custom_order(spark, n):
    x = np.random.default_rng(n).integers(0, 50, n).tolist()
    less = lambda a, b: (a % 7 > b % 7) | ((a % 7 == b % 7) & (a < b))
    key = lambda v: (-(v % 7), v)
    a = array(spark, x) if n else g.from_values(spark, [], "int64")
    assert g.sort(a, lt=less).values() == sorted(x, key=key)
    order = sorted(range(n), key=lambda i: (key(x[i]), i))
    assert g.sortperm(a, lt=less).values() == [i + 1 for i in order]
    back = sorted(range(n), key=lambda i: ((x[i] % 7, -x[i]), i))
    assert g.sortperm(a, lt=less, rev=True).values() == [i + 1 for i in back]
    y = list(range(0, 50, 3))
    v, w = sorted(x, key=key), array(spark, y)
    held = array(spark, v) if n else a
    assert g.searchsortedfirst(held, w, lt=less).values() == [1 + sum(key(b) < key(q) for b in v) for q in y]
    assert g.searchsortedlast(held, w, lt=less).values() == [sum(key(b) <= key(q) for b in v) for q in y]
    with pytest.raises(ValueError):
        g.sort(a, lt=less, alg="radix")


def test_custom_order_over_several_buckets(spark):
    rng = np.random.default_rng(3)
    x = np.where(rng.random(5000) < 0.4, 3, rng.integers(0, 1000, 5000)).tolist()  # one value is hot
    df = spark.createDataFrame([(i, 0, v) for i, v in enumerate(x)], "i long, t int, k long")
    out = ranked_by(df, lambda a, b: a < b, "rank", 5000, target=200)
    got = {r["rank"]: r["i"] for r in out.collect()}
    assert [got[k + 1] for k in range(5000)] == sorted(range(5000), key=lambda i: (x[i], i))


def test_native_scan_by_a_column_function_over_many_buckets(spark):
    x = np.random.default_rng(9).integers(1, 99, 3000)
    got = g.accumulate(lambda a, b: (a * b) % 101, array(spark, x), init=1, neutral=1, bucket=64).values()
    want, total = [], 1
    for v in x.tolist():
        total = total * v % 101
        want.append(total)
    assert got == want


def test_scratch_tables_are_registered_and_released(spark):
    from gridloom.plans.scratch import TABLES, dropped, released, stored

    before = frozenset(TABLES)
    a, b = stored(spark.range(5)), stored(spark.range(6))
    assert a.count() == 5 and len(TABLES) == len(before) + 2
    dropped(a)
    released(spark, before, (b,))
    assert set(TABLES) - before == {b._scratch_path} and b.count() == 6
    released(spark, before)
    assert set(TABLES) == before and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_opaque_functions_in_sort_keys_have_arrow_plans(spark):
    out = g.sort(array(spark, [3, 1, 2]), by=g.opaque(lambda v: v, "int64")).df
    assert "Arrow" in out._jdf.queryExecution().toString() and out.select(F.max("i")).first()[0] == 3

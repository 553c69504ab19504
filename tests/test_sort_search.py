import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import api as g
from tests.test_reduce import array


@pytest.mark.parametrize("n", [0, 1, 2, 511, 513])
@pytest.mark.parametrize("small", [0, 10**6])
def test_sort_and_permutation(spark, n, small):
    x = np.random.default_rng(n).integers(0, 40, n)
    a = array(spark, x)
    assert g.sort(a, small=small).values() == sorted(x.tolist())
    assert g.sortperm(a, small=small).values() == (np.argsort(x, kind="stable") + 1).tolist()
    down = [i + 1 for i in sorted(range(n), key=lambda i: (-x[i], i))]
    assert g.sortperm(a, rev=True, small=small).values() == down


@pytest.mark.parametrize("kind", ["sorted", "reversed", "constant", "few"])
def test_distributions_distributed(spark, kind):
    n = 2000
    x = {"sorted": np.arange(n), "reversed": np.arange(n)[::-1], "constant": np.ones(n, int), "few": np.arange(n) % 4}[kind]
    assert g.sortperm(array(spark, x), small=0).values() == (np.argsort(x, kind="stable") + 1).tolist()


def test_reversals_cancel(spark):
    a = array(spark, [3, 1, 2])
    assert g.sort(a, lt=">").values() == [3, 2, 1]
    assert g.sort(a, lt=">", rev=True).values() == [1, 2, 3]
    assert g.sort(a, rev=True, order="reverse").values() == [1, 2, 3]
    assert g.sort(a, lt=">", rev=True, order="reverse").values() == [3, 2, 1]


@pytest.mark.parametrize("dtype", ["float64", "float32"])
def test_total_order_of_floats(spark, dtype):
    x = [1.0, 0.0, -0.0, math.nan, math.inf, -math.inf, 2.5, -2.5, -0.0, 0.0, math.nan, 5e-324 if dtype == "float64" else 1e-45]
    got = g.sort(g.from_values(spark, x, dtype)).values()
    key = lambda v: (math.isnan(v), 0 if math.isnan(v) else v, math.copysign(1, v))
    assert [str(v) for v in got][:6] == [str(v) for v in sorted(x, key=key)][:6] and all(math.isnan(v) for v in got[-2:])
    back = g.sort(g.from_values(spark, x, dtype), rev=True).values()
    assert math.isnan(back[0]) and [str(v) for v in back[-6:]] == [str(v) for v in got[:6]][::-1]


def test_by_and_structs(spark):
    assert g.sort(array(spark, [-3, 1, -2]), by=F.abs).values() == [1, -2, -3]
    df = spark.createDataFrame([(1, (2, "b")), (2, (1, "z")), (3, (2, "a"))], "i bigint, v struct<a:int,b:string>")
    assert [tuple(v) for v in g.sort(g.DArray(df)).values()] == [(1, "z"), (2, "a"), (2, "b")]


def test_sort_by_key(spark):
    keys, values = array(spark, [3, 1, 3, 2]), array(spark, [30, 10, 31, 20])
    k, v = g.sort_by_key(keys, values)
    assert k.values() == [1, 2, 3, 3] and v.values() == [10, 20, 30, 31]
    with pytest.raises(ValueError):
        g.sort_by_key(keys, array(spark, [1]))


def test_algorithms(spark):
    a = array(spark, [2, 1])
    for f in (g.merge_sort, g.sample_sort, g.radix_sort, g.sort_, g.merge_sort_):
        assert f(a).values() == [1, 2]
    assert g.merge_sortperm(a, lowmem=True).values() == [2, 1] == g.sortperm_(array(spark, [0, 0], "int32"), a).values()
    for bad in ({"by": F.abs}, {"lt": ">"}):
        with pytest.raises(ValueError):
            g.sort(a, alg="radix", **bad)
    with pytest.raises(ValueError):
        g.sort(g.from_values(spark, [1], "int16"), alg="radix")
    with pytest.raises(ValueError):
        g.sortperm(a, alg="radix")
    with pytest.raises(ValueError):
        g.sort(a, alg="bogo")


@pytest.mark.parametrize("small", [0, 10**6])
@pytest.mark.parametrize("dtype", ["int64", "float64"])
def test_search(spark, small, dtype):
    rng = np.random.default_rng(6)
    v, x = np.sort(rng.integers(0, 60, 300)), rng.integers(-5, 70, 150)
    if dtype == "float64":
        v, x = v / 2, x / 2
    a, b = array(spark, v, dtype), array(spark, x, dtype)
    assert g.searchsortedfirst(a, b, small=small).values() == (np.searchsorted(v, x, "left") + 1).tolist()
    assert g.searchsortedlast(a, b, small=small).values() == np.searchsorted(v, x, "right").tolist()
    down = array(spark, v[::-1], dtype)
    n = len(v)
    assert g.searchsortedfirst(down, b, rev=True, small=small).values() == (n - np.searchsorted(v, x, "right") + 1).tolist()
    assert g.searchsortedlast(down, b, lt=">", small=small).values() == (n - np.searchsorted(v, x, "left")).tolist()


def test_search_edges(spark):
    a, none = array(spark, [2, 4]), array(spark, [])
    assert g.searchsortedfirst(none, a).values() == [1, 1] and g.searchsortedlast(none, a).values() == [0, 0]
    assert g.searchsortedfirst(a, none).values() == []
    with pytest.raises(ValueError):
        g.searchsortedfirst_(none, a, a)

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import api as g
from tests.test_reduce import array, dense


def scan(x, init, inclusive, axis=0):
    total = np.cumsum(x, axis=axis)
    return init + (total if inclusive else total - x)


@pytest.mark.parametrize("n,bucket", [(1, 4), (5, 4), (513, 64), (1000, 7), (3000, 16)])
@pytest.mark.parametrize("inclusive", [True, False])
def test_levels_on_uneven_values(spark, n, bucket, inclusive):
    x = np.random.default_rng(n).integers(-9, 9, n)
    got = g.accumulate("+", array(spark, x), init=10, inclusive=inclusive, bucket=bucket)
    assert got.values() == scan(x, 10, inclusive).tolist()


@pytest.mark.parametrize("inclusive", [True, False])
def test_operations(spark, inclusive):
    x = np.random.default_rng(8).integers(0, 50, 40)
    a = array(spark, x)
    shifted = np.concatenate([[-1], x])
    want = np.maximum.accumulate(shifted)[1:] if inclusive else np.maximum.accumulate(shifted)[:-1]
    assert g.accumulate("max", a, init=-1, inclusive=inclusive, bucket=8).values() == want.tolist()
    total = np.cumsum(x) + 3
    want = (total if inclusive else total - x) % 11
    got = g.accumulate(lambda p, q: (p + q) % 11, a, init=3, neutral=0, inclusive=inclusive, bucket=4)
    assert got.values() == want.tolist()
    got = g.accumulate(lambda p, q: (p + q) % 11, a, init=3, neutral=0, inclusive=inclusive, bucket=16, python=True)
    assert got.values() == want.tolist()


def test_order_of_operands(spark):
    words = [chr(97 + i % 26) for i in range(50)]
    a = g.from_values(spark, words, "string")
    got = g.accumulate(lambda p, q: F.concat(p, q), a, init=">", neutral="", bucket=4)
    assert got.values() == [">" + "".join(words[: i + 1]) for i in range(50)]


def test_dims(spark):
    x = np.random.default_rng(5).integers(-9, 9, (3, 5, 2))
    a = array(spark, x)
    for axis in range(3):
        for inclusive in (True, False):
            got = g.accumulate("+", a, init=2, dims=axis + 1, inclusive=inclusive, bucket=2)
            assert (dense(got) == scan(x, 2, inclusive, axis)).all()
    assert (dense(g.cumprod(a, dims=2)) == np.cumprod(x, axis=1)).all()
    flat = np.cumsum(x.ravel(order="F")).reshape(x.shape, order="F")
    assert (dense(g.cumsum(a, bucket=4)) == flat).all()


def test_beyond_the_array_and_empty(spark):
    a = array(spark, [[1, 2], [3, 4]])
    assert (dense(g.accumulate("+", a, init=9, dims=3)) == np.array([[1, 2], [3, 4]])).all()
    assert g.accumulate("+", array(spark, []), init=9).values() == []


def test_types(spark):
    assert g.cumsum(array(spark, [True, False, True], "bool")).values() == [1, 1, 2]
    assert g.cumsum(array(spark, [1, 2], "int32")).df.schema["v"].dataType.simpleString() == "int"
    assert g.cumsum(array(spark, [1, 2], "int64"), init=0.5).values() == [1.5, 3.5]
    assert g.cumprod(array(spark, [3] * 39)).values()[-1] == 3**39
    z = g.from_values(spark, [(float(i), -float(i)) for i in range(1, 40)], "complex128")
    last = g.accumulate("+", z, init=0, bucket=8).values()[-1]
    assert (last["re"], last["im"]) == (780.0, -780.0)


def test_bad_arguments(spark):
    a = array(spark, [1, 2])
    with pytest.raises(TypeError):
        g.accumulate("+", a)
    for bad in ({"dims": 0}, {"dims": 1.5}, {"alg": "magic"}, {"tuning": g.Tuning(min_elems=1)}):
        with pytest.raises(ValueError):
            g.accumulate("+", a, init=0, **bad)


def test_plan_has_no_python(spark):
    out = g.accumulate("+", g.from_range(spark, 1, 1000), init=0, bucket=100)
    plan = out.df._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan

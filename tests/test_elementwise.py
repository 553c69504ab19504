import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom import api as g
from gridloom.streaming import running_reduce, windowed_reduce
from tests.test_reduce import array, dense


def test_loops_and_maps(spark):
    a = array(spark, [1, 2, 3])
    assert g.foreachindex(lambda v, i: v * 10 + i, a).values() == [11, 22, 33]
    assert g.map(lambda v: F.when(v > 1, v).otherwise(0), a).values() == [0, 2, 3]
    assert g.map(lambda v: v * v, a, python=True).values() == [1, 4, 9]
    assert g.map_(lambda v: v / 2, array(spark, [0.0] * 3, "float64"), a).values() == [0.5, 1.0, 1.5]
    with pytest.raises(ValueError):
        g.map_(lambda v: v, array(spark, [1]), a)
    with pytest.raises(Exception, match="not representable"):
        g.map(lambda v: v / 2, a).values()
    with pytest.raises(TypeError):
        g.map(lambda v: v, a, threads=3)


def test_foraxes(spark):
    x = np.arange(24).reshape(2, 3, 4)
    a = array(spark, x)
    got = g.foraxes(lambda i, row: F.transform(row, lambda v: v - F.array_max(row) + i), a, dims=2)
    want = x - x.max(axis=(0, 2), keepdims=True) + np.arange(1, 4).reshape(1, 3, 1)
    assert (dense(got) == want).all()
    assert (dense(g.foraxes(lambda v, i, j, k: v + i, a)) == x + np.arange(1, 3).reshape(2, 1, 1)).all()
    with pytest.raises(ValueError):
        g.foraxes(lambda i, row: row, a, dims=4)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 256])
def test_reverse(spark, n):
    a = array(spark, np.arange(n))
    assert g.reverse(a).values() == list(range(n))[::-1] and g.reverse(g.reverse(a)).values() == list(range(n))


def test_reverse_forms(spark):
    x = np.arange(6).reshape(2, 3)
    assert (dense(g.reverse(array(spark, x))) == x[::-1, ::-1]).all()
    assert g.reverse_(array(spark, [0.0, 0.0], "float64"), array(spark, [1, 2])).values() == [2.0, 1.0]
    with pytest.raises(ValueError):
        g.reverse_(array(spark, [0]), array(spark, [1, 2]))
    assert "Exchange" not in g.reverse(g.from_range(spark, 1, 9)).df._jdf.queryExecution().toString()


def test_compact(spark):
    got = g.compact(lambda v: v % 3 == 0, g.from_range(spark, 1, 20))
    assert got.values() == [3, 6, 9, 12, 15, 18]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(0, [1, 2, 3, 4]), (1, [5, 6, 7, 8])], "k int, e array<int>")
    a = g.from_array_column(df, "k", "e", (2, 2), base=0, rows=2)
    assert (dense(a) == np.arange(1, 9).reshape(2, 2, 2)).all()
    g.to_table(a, str(tmp_path / "t"), partitions=2)
    again = g.from_table(spark.read.parquet(str(tmp_path / "t")), ["i1", "i2", "i3"], "v")
    assert (dense(again.known()) == dense(a)).all()
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "r"))
    assert sorted(g.from_rows(spark.read.parquet(str(tmp_path / "r")), "id").values()) == list(range(5))
    with pytest.raises(ValueError):
        g.DArray(df, ("nope",), "e")
    with pytest.raises(Exception, match="null in an array"):
        g.DArray(spark.sql("SELECT 1L AS i, CAST(NULL AS INT) AS v")).checked().values()


def test_partitioner(spark):
    show = lambda *a: [(r.start, r.stop - 1) for r in g.TaskPartitioner(*a)]
    assert show(10, 4, 1) == [(1, 3), (4, 6), (7, 8), (9, 10)]
    assert show(20, 6, 5) == [(1, 5), (6, 10), (11, 15), (16, 20)]
    assert show(3, 8) == [(1, 1), (2, 2), (3, 3)] and show(0, 4) == [(1, 0)]
    for n, t, m in [(10, 4, 1), (23, 5, 2), (7, 7, 1)]:
        parts = g.TaskPartitioner(n, t, m)
        rows = parts.table(spark).collect()
        assert [(r["start"], r["stop"]) for r in rows] == show(n, t, m)
        tasks = [r[0] for r in spark.range(1, n + 1).select(parts.task(F.col("id"))).collect()]
        assert tasks == [next(k for k, r in enumerate(parts, 1) if i in r) for i in range(1, n + 1)]
    for bad in [(-1, 1, 1), (1, 0, 1), (1, 1, 0)]:
        with pytest.raises(ValueError):
            g.TaskPartitioner(*bad)
    with pytest.raises(IndexError):
        g.TaskPartitioner(4, 2)[3]


def test_task_partition(spark):
    a = g.from_range(spark, 1, 10)
    out = g.itask_partition(lambda t, rows: pd.DataFrame({"task": [t], "first": [rows["v"].iloc[0]], "n": [len(rows)]}), a, "task int, first bigint, n int", 4)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, 3), (2, 4, 3), (3, 7, 2), (4, 9, 2)]
    assert g.task_partition(lambda rows: rows[["v"]].sum().to_frame().T, a, "v bigint", 3).agg(F.sum("v")).first()[0] == 55


def test_streaming(spark, tmp_path):
    rows = spark.sql("SELECT id, id % 3 AS k, timestamp_seconds(id * 30) AS ts FROM range(100)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("total", running_reduce(stream, "max", "id", ["k"], f=lambda v: v * 2, init=-1), "complete"), ("windows", windowed_reduce(stream, "+", "id", "ts", "10 minutes", "1 minute"), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert {r["k"]: r["v"] for r in spark.sql("SELECT * FROM total").collect()} == {0: 198, 1: 194, 2: 196}
    done = sorted(r["v"] for r in spark.sql("SELECT * FROM windows").collect())
    assert done == [sum(range(20 * w, 20 * w + 20)) for w in range(len(done))] and len(done) >= 3


def test_literals_and_linspace(spark):
    row = spark.range(1).select(g.u32(5).alias("a"), g.i8(-3).alias("b"), g.u64(2**64 - 1).alias("c"))
    assert [f.dataType.simpleString() for f in row.schema] == ["bigint", "tinyint", "decimal(20,0)"] and int(row.first()["c"]) == 2**64 - 1
    assert int(g.minimum(array(spark, [7, 2**64 - 1], "uint64")).get()) == 7
    for f, v in ((g.u8, 256), (g.i8, 1.5), (g.u16, -1)):
        with pytest.raises(ValueError):
            f(v)
    assert g.int_linspace(spark, 1, 100, 5).values() == [1, 25, 50, 75, 100]
    assert g.get_backend(g.from_range(spark, 1, 2)) == "spark" and g.synchronize() is None

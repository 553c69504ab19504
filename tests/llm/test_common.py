import numpy as np
import pyarrow as pa

from gridloom.llm.common import Rolling, Words, chunks, shielded, sliding_min, spread


def test_small_tables_are_spread(spark):
    one = spark.range(1000).coalesce(1)
    tasks = spark.sparkContext.defaultParallelism
    assert spread(one, "id").rdd.getNumPartitions() >= tasks and spread(one, "id").count() == 1000
    many = spark.range(1000).repartition(2 * tasks)
    assert spread(many, "id") is many


def test_chunks_are_bounded_and_whole():
    texts = ["a" * n for n in (0, 10, 5000, 3, 3, 70, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    parts = list(chunks([batch.slice(0, 0), batch], "text", limit=100, row=1))
    assert [x for p in parts for x in p.column(0).to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column(0).to_pylist()) <= 100 for p in parts)


def test_hashes_of_equal_spans_are_equal():
    words = Words([b"a bc  a\nbc", b"", b"bc a"])
    hashes = Rolling(words.buffer)
    one = hashes.spans(words.begin, words.end)
    assert len(words) == 6 and one[0] == one[2] == one[5] and one[1] == one[3] == one[4] != one[0]
    two = hashes.spans(words.begin[:-1], words.end[1:])
    assert two[0] == two[2] and two[1] == two[4]
    assert (sliding_min(np.array([5, 3, 4, 1, 9]), 3) == [3, 1, 1]).all()


def test_shielded_names_come_back(spark):
    df = spark.createDataFrame([(1, 2, 3)], "id int, SCORE int, x int")
    inner, back = shielded(df, ["score"])
    assert "SCORE" not in inner.columns and inner.select(*back).columns == df.columns and tuple(inner.select(*back).first()) == (1, 2, 3)

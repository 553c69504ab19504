"""Shared parts of the training-data operators: tables, scratch space and byte-level word arrays.

All Python here is Arrow-batched. A batch is cut into chunks of bounded bytes before numpy arrays are
made of it, so a worker's memory follows the longest single text, not the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.scratch import stored

CHUNK_BYTES = 2 << 20

#: ASCII white space that ends a word.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bytes that are not part of a lower-cased alphanumeric word.
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[0x00:0x30] = True
NOT_ALNUM[0x3A:0x61] = True
NOT_ALNUM[0x7B:0x80] = True

#: The id that stands for a null id in comparisons: no smaller id exists because of it.
NULL_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """The table in as many partitions as tasks run at once, if it has fewer: a small file is read in one piece."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.rdd().getNumPartitions() >= tasks else df.repartition(tasks, key)


def saved(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write to shared scratch space and read it back: cuts lineage and survives lost executors.

    The table stays until `dropped`, `released` or the end of the program, since results may be read at any later time.
    """
    return stored(df, compression)


def chunks(batches, column: str = "text", limit: int = CHUNK_BYTES, row: int = 64):
    """Record batches cut so that `column` holds about `limit` bytes, or one long row, in each.

    Every row counts as `row` bytes more, for what is made of it besides its text.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + row)
        start = 0
        while start < batch.num_rows:
            done = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column as bytes; a null is empty."""
    values = batch.column(batch.schema.get_field_index(column))
    return [x or b"" for x in values.cast(pa.binary()).to_pylist()]


class Words:
    """Words of several texts as arrays over one normalised buffer (words joined by one space).

    `first[d] : first[d + 1]` are the words of text d; word i is `buffer[begin[i]:end[i]]`.
    """

    def __init__(self, documents: list[bytes], separators: np.ndarray = WHITE, lower: bool = False):
        blob = b"\n".join(documents) + b"\n"
        if lower:
            blob = blob.lower()
        raw = np.frombuffer(blob, dtype=np.uint8)
        sep = separators[raw]
        before = np.empty_like(sep)
        before[0] = True
        before[1:] = sep[:-1]
        starts, ends = np.flatnonzero(before & ~sep), np.flatnonzero(~before & sep)
        kept = ~(sep & before)
        kept[0] = not sep[0]
        self.buffer = np.where(sep, np.uint8(32), raw)[kept]
        self.end = np.cumsum(ends - starts + 1) - 1
        self.begin = self.end - (ends - starts)
        self.raw_begin, self.raw_end = starts, ends
        at = np.zeros(len(documents) + 1, dtype=np.int64)
        np.cumsum([len(d) + 1 for d in documents], out=at[1:])
        self.offset = at[:-1]
        self.first = np.searchsorted(starts, at)
        self.document = np.repeat(np.arange(len(documents)), np.diff(self.first))
        self._bytes: bytes | None = None

    def __len__(self) -> int:
        return len(self.begin)

    @property
    def bytes(self) -> bytes:
        if self._bytes is None:
            self._bytes = self.buffer.tobytes()
        return self._bytes


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any span of a buffer from prefix sums of byte weights times powers, modulo 2**64."""

    BASE = 0x5851F42D4C957F2D
    weights = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))

    def __init__(self, buffer: np.ndarray):
        n = len(buffer)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.weights[buffer] * self._powers(self.BASE, n), out=self.prefix[1:])
        self.inverse = self._powers(pow(self.BASE, -1, 1 << 64), n + 1)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(max(n, 1), base, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out)[:n]

    def spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.prefix[end] - self.prefix[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, in log(width) passes."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return values if span == width else np.minimum(values[: -(width - span)], values[width - span :])


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and stop of every run of equal neighbours."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return starts, np.append(starts[1:], len(values))


def held_out(doc_id="doc_id"):
    """The contract's split: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def quoted(names) -> list:
    return [F.col(f"`{n}`") for n in names]


def others(df: DataFrame, added) -> list[str]:
    """Names of the columns that a result keeps: those that no added column replaces."""
    low = {a.lower() for a in added}
    return [n for n in df.columns if n.lower() not in low]


def shielded(df: DataFrame, added) -> tuple[DataFrame, list]:
    """The table with other names for columns that clash with `added`, and columns that give the old ones back."""
    low = {a.lower() for a in added}
    names = [(n, f"_own{i}" if n.lower() in low else n) for i, n in enumerate(df.columns)]
    return df.select(*[F.col(f"`{n}`").alias(o) for n, o in names]), [F.col(f"`{o}`").alias(n) for n, o in names]

"""Benchmark decontamination: a prefix-filtered set join with exact verification.

Each benchmark item gives windows of `window` words (a shorter item is one window). A window's word shingles are
ordered by rarity, counted over all documents; since a window must occur whole, its prefix is the rarest shingle
alone. Document shingles are joined with the prefixes; a match fixes where the window would have to start, which
length and position bounds check before the words are compared exactly.

1. Two passes over the texts find shingles: those of any window, to count them, and then those that are prefixes,
   each with the words around it. Both look in a table of hash bits first, whose size is bounded (`filter_bits`); it
   only lets through what can't match, and the joins settle the rest. No other part of the benchmark is broadcast or
   collected, so it may be as large as the documents.
2. Prefixes and the words around them meet in a join on the shingle's hash. Equal texts are one text until the end,
   so a text in a third of all rows is looked at once more, not once a row.

Defined results: null or empty texts have no words and are never contaminated; a null or empty item has no windows; a
null item id is named `null`; repeated items count once by id. Every document row gives one result row. Input columns
with the name of an output column are replaced; columns of any other name pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import NOT_ALNUM, Rolling, Words, chunks, others, quoted, runs, saved, shielded, spread, table, texts
from gridloom.plans.scratch import dropped

ADDED = ["n_words", "n_hit", "spans", "items", "contaminated"]
#: Names that plans use between input and output.
INNER = ["k1", "k2", "spans_", "items_", "n_hit_"]


def shingle_hashes(words: Words, sizes: list[int]):
    """For each size k: k, first words and hashes of the shingles inside one text, and what hashes any span."""
    if len(words):
        hashes = Rolling(words.buffer)
        for k in sizes:
            n = len(words) - k + 1
            if n > 0:
                whole = np.flatnonzero(words.document[:n] == words.document[k - 1 :])
                yield k, whole, hashes.spans(words.begin[whole], words.end[whole + k - 1]), hashes


def benchmark_windows(benchmark: DataFrame, item: str, text: str, window: int, shingle: int) -> DataFrame:
    """`(item, win, whole, size, k, hashes)`: each window of each item, its words and their hash, and the hashes of its shingles of k words."""

    names = ["item", "win", "whole", "size", "k", "hashes"]

    def cut(batches):
        for part in chunks(batches, "text"):
            words = Words(texts(part), NOT_ALNUM, lower=True)
            data, rows = words.bytes, []
            spans, hash_at = Rolling(words.buffer), {}
            for k, at, h, _ in shingle_hashes(words, sorted({min(shingle, int(n)) for n in np.diff(words.first) if n})):
                hash_at[k] = dict(zip(at.tolist(), h.view(np.int64).tolist(), strict=True))
            for d, name in enumerate(part.column(0).to_pylist()):
                a, b = int(words.first[d]), int(words.first[d + 1])
                size = min(window, b - a)
                k = min(shingle, size)
                if not size:
                    continue
                begin, end = words.begin[a : b - size + 1], words.end[a + size - 1 : b]
                for i, low, high, h in zip(range(a, b), begin.tolist(), end.tolist(), spans.spans(begin, end).view(np.int64).tolist(), strict=False):
                    rows.append((name, data[low:high].decode("utf-8", "replace"), h, size, k, [hash_at[k][j] for j in range(i, i + size - k + 1)]))
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    source = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("null")).alias("item"), F.col(f"`{text}`").cast("string").alias("text"))
    return source.mapInArrow(cut, "item string, win string, whole long, size long, k long, hashes array<long>")


def hash_bits(hashes: DataFrame, n: int, most: int) -> np.ndarray:
    """A table of `2**b` bits, at most `2**most`, with a bit set for every value of the column `hash`.

    It comes to the driver as one row for each 64 bits that aren't all zero.
    """
    b = min(most, max(13, int(32 * n).bit_length()))
    low = F.col("hash").bitwiseAND((1 << b) - 1)
    got = hashes.groupBy(F.shiftright(low, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(hash & 63 as int))")).alias("v")).toArrow()
    out = np.zeros(1 << (b - 6), dtype="<i8")
    out[got.column("at").to_numpy()] = got.column("v").to_numpy()
    return out.view(np.uint8)


def among(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the table."""
    low = hashes & np.uint64(len(bits) * 8 - 1)
    return (bits[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _counted(bodies: DataFrame, sizes: list[int], bits) -> DataFrame:
    """`(hash, n)`: in how many documents each shingle of the table occurs; all documents count."""

    def count(batches):
        for part in chunks(batches, "text"):
            words = Words(texts(part), NOT_ALNUM, lower=True)
            for _, at, h, _ in shingle_hashes(words, sizes):
                near = among(bits.value, h)
                pairs = np.unique(np.stack([h[near], words.document[at[near]].astype(np.uint64)]), axis=1)[0]
                start, stop = runs(pairs)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[start].view(np.int64)), pa.array(stop - start)], ["hash", "n"])

    return bodies.select("text").mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def _surroundings(bodies: DataFrame, sizes: list[int], lengths: list[int], bits, whole_bits, window: int, shingle: int) -> DataFrame:
    """`(hash, k1, k2, at, low, around)`: where a prefix may be in a text, and the words from `low` on around it.

    Only where some window over the place, inside the text, may be one of the benchmark's.
    """
    names = ["hash", "k1", "k2", "at", "low", "around"]

    def find(batches):
        for part in chunks(batches, "text"):
            words = Words(texts(part), NOT_ALNUM, lower=True)
            data = words.bytes
            for k, at, h, spans in shingle_hashes(words, sizes):
                near = among(bits.value, h)
                at, h = at[near], h[near]
                first, last = words.first[words.document[at]], words.first[words.document[at] + 1]
                likely = np.zeros(len(at), dtype=bool)
                for n in [n for n in lengths if min(n, shingle) == k]:
                    for place in range(n - k + 1):
                        inside = np.flatnonzero((at - place >= first) & (at - place + n <= last) & ~likely)
                        a = at[inside] - place
                        likely[inside] = among(whole_bits.value, spans.spans(words.begin[a], words.end[a + n - 1]))
                at, h = at[likely], h[likely]
                if not len(at):
                    continue
                d = words.document[at]
                reach = window - shingle if k == shingle else 0  # a shorter shingle is a whole window
                low, high = np.maximum(at - reach, words.first[d]), np.minimum(at + k + reach, words.first[d + 1])
                rows = pa.array(d)
                around = [data[a:b].decode("utf-8", "replace") for a, b in zip(words.begin[low].tolist(), words.end[high - 1].tolist(), strict=True)]
                whole = pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), part.column(1).take(rows), part.column(2).take(rows), pa.array(at - words.first[d]), pa.array(low - words.first[d]), pa.array(around, pa.string())], names)
                for i in range(0, whole.num_rows, 10_000):
                    yield whole.slice(i, 10_000)

    return bodies.select("text", "k1", "k2").mapInArrow(find, "hash long, k1 long, k2 long, at long, low long, around string")


def _found(bodies: DataFrame, windows: DataFrame, window: int, shingle: int, filter_bits: int) -> DataFrame:
    """`(k1, k2, spans_, items_, n_hit_)` of texts that have a window: merged word ranges, sorted ids, and covered words."""
    sc = bodies.sparkSession.sparkContext
    parts = windows.select("k", F.explode("hashes").alias("hash")).distinct()
    # at most `window` rows
    lengths = sorted(r["size"] for r in windows.select("size").distinct().toLocalIterator())
    sizes = sorted({min(n, shingle) for n in lengths})
    counts = _counted(bodies, sizes, sc.broadcast(hash_bits(parts, parts.count(), filter_bits)))
    # each window's rarest shingle: its hash and place
    distinct = windows.select("win", "size", "hashes").dropDuplicates(["win"])
    places = distinct.select("win", "size", F.posexplode("hashes").alias("place", "hash")).join(counts, "hash", "left")
    order = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash", "place")
    prefixes = saved(places.groupBy("win").agg(F.min(order).alias("p"), F.first("size").alias("size")).select("win", "size", F.col("p.hash").alias("hash"), F.col("p.place").cast("long").alias("place")))
    heads = prefixes.select("hash").distinct()
    wholes = windows.select(F.col("whole").alias("hash")).distinct()
    tables = [sc.broadcast(hash_bits(x, x.count(), filter_bits)) for x in (heads, wholes)]
    seen = _surroundings(bodies, sizes, lengths, *tables, window, shingle)
    seen = seen.dropDuplicates(["k1", "k2", "hash", "at"])
    start = F.col("at") - F.col("place")
    there = F.array_join(F.slice(F.split("around", " "), F.greatest(start - F.col("low") + 1, F.lit(1)).cast("int"), F.col("size").cast("int")), " ")
    # position bounds first; a window that would leave the text is shorter than its size and differs
    hits = seen.join(prefixes, "hash").where(start >= F.col("low")).where(there == F.col("win"))
    hits = saved(hits.select("k1", "k2", "win", start.alias("start"), (start + F.col("size")).alias("stop")).distinct())
    dropped(prefixes)
    # neighbouring and overlapping windows become one range
    w = Window.partitionBy("k1", "k2").orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begun = hits.select("k1", "k2", "start", "stop", F.when(F.col("start") <= reach, 0).otherwise(1).alias("new"))
    ranges = begun.withColumn("range", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("k1", "k2", "range").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    spans = ranges.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans_"), F.sum(F.col("stop") - F.col("start")).alias("n_hit_"))
    named = hits.select("k1", "k2", "win").distinct().join(windows.select("win", "item").distinct(), "win").select("k1", "k2", "item").distinct()
    items = named.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("item")).alias("items_"))
    return spans.join(items, ["k1", "k2"])


@F.arrow_udf(T.LongType())
def word_counts(column: pa.Array) -> pa.Array:
    counts = [np.diff(Words(texts(part), NOT_ALNUM, lower=True).first) for part in chunks([pa.RecordBatch.from_arrays([column], ["text"])], "text")]
    return pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13, shingle: int = 3, share: int = 20, filter_bits: int = 27, keep: list[str] | None = None, broadcast_rows: int = 100_000) -> DataFrame:
    """All rows, of them the columns `keep` or else all, with `n_words`, `n_hit`, `spans` (hit word ranges), `items` (ids as sorted text) and
    `contaminated`: some word is hit, and hit words are at least 1/`share` of all words.

    Texts that have windows, one row each, go to the documents by broadcast up to `broadcast_rows` and by a shuffle beyond.
    """
    if window < 1 or shingle < 1 or share < 1:
        raise ValueError("window, shingle and share must be positive")
    if not 13 <= filter_bits <= 30:
        raise ValueError("filter_bits must be 13 to 30")
    shingle = min(shingle, window)
    keep = others(docs, ADDED) if keep is None else keep
    body = F.col(f"`{text}`").cast("string")
    # two hashes of a text stand for it: results depend on the text alone
    bodies = docs.where(body.isNotNull()).select(body.alias("text"), F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(1), body).alias("k2"))
    windows = saved(benchmark_windows(benchmark, item, item_text, window, shingle))
    found = saved(_found(bodies, windows, window, shingle, filter_bits))
    narrow, back = shielded(docs.select(*quoted(dict.fromkeys([*keep, text]))), [*ADDED, *INNER])
    body = F.coalesce(back[-1] if text not in keep else back[keep.index(text)], F.lit("")).cast("string")
    rows = narrow.select("*", F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(1), body).alias("k2"), word_counts(body).alias("n_words"))
    if found.count() <= broadcast_rows:
        found = F.broadcast(found)
    judged = rows.join(found, ["k1", "k2"], "left").withColumn("n_hit", F.coalesce("n_hit_", F.lit(0).cast("long")))
    no_span, no_item = F.array().cast("array<struct<start:bigint,stop:bigint>>"), F.array().cast("array<string>")
    verdict = (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    return judged.select(*back[: len(keep)], "n_words", "n_hit", F.coalesce("spans_", no_span).alias("spans"), F.coalesce("items_", no_item).alias("items"), verdict.alias("contaminated"))


def query(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)
), s AS (SELECT DISTINCT size FROM p),
dw AS (
  SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win
  FROM (SELECT doc_id, size, w, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, s WHERE len(w) >= size)
), m AS (SELECT doc_id, i, p.size, item_id FROM dw JOIN p ON dw.win = p.win AND dw.size = p.size),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS k FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

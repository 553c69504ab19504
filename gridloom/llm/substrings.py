"""Substring dedup by super-k-mer partitioning.

A window is `window` consecutive words of one document. Its minimiser is the smallest hash of the m-word
grams inside it, so equal windows have equal minimisers. Consecutive windows that share a minimiser form a
super-k-mer. A word is removed if a window over it also starts in a document with a smaller id.

1. Every super-k-mer becomes a short key, the 128-bit hash of its words, beside its minimiser. Keys are combined
   map-side to the first document that has them, so a passage in a third of all documents is one row.
2. The first occurrence of each key travels as one packed string to the minimiser's bucket, unless it would be alone
   there: a bucket of one string has nothing to count. There its windows are sorted, and the first of a run of equal
   windows has the smallest id. A minimiser whose strings have over `heavy` windows is split: its windows travel one by
   one, equal ones of a batch combined, dealt by their own hash and sorted outside Python, so a bucket's memory is bounded.
3. An occurrence of a super-k-mer in a later document than its first loses all its words; in the first
   document it loses the windows that its bucket found. Hot keys are left to AQE's skew join.

Words are compared as they are in buckets. That occurrences of one key have the same words rests on the 128 bits: among
10**13 super-k-mers the chance of any two different ones with equal hashes is 10**-12.

Defined results: null and empty texts have no words and nothing is removed; so have texts shorter than a
window. A null id counts as larger than all ids. Rows with equal ids don't remove words from each other, and
repeated rows give repeated results. Other columns pass through; those with the name of an output column
are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import NULL_ID, Rolling, Words, chunks, others, quoted, runs, saved, sliding_min, spread, table, texts

ADDED = ["n_words", "n_removed", "removed", "kept_text"]
#: Windows of a super-k-mer at most, so that a packed string has a bounded length. A longer run is cut.
LONGEST = 256


def _named(docs: DataFrame, id: str, text: str) -> list:
    body = F.col(f"`{text}`").cast("string")
    return [F.coalesce(F.col(f"`{id}`").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(body).alias("text_key"), body.alias("text")]


def superkmers(docs: DataFrame, id: str, text: str, window: int, gram: int) -> DataFrame:
    """`(mini, dig, low, id, text_key, start, n)`, with a hash of the words in two parts: n windows from word `start` on share the minimiser `mini`."""

    def cut(batches):
        digest = xxhash.xxh3_128_digest
        for part in chunks(batches, "text"):
            words = Words(texts(part))
            if len(words) < window:
                continue
            hashes = Rolling(words.buffer).spans(words.begin[: len(words) - gram + 1], words.end[gram - 1 :])
            least = sliding_min(hashes, window - gram + 1)
            at = np.flatnonzero(words.document[: len(least)] == words.document[window - 1 :])
            if not len(at):
                continue
            values = least[at]
            new = np.concatenate(([True], (values[1:] != values[:-1]) | (at[1:] != at[:-1] + 1)))
            begun = np.flatnonzero(new)
            new |= (np.arange(len(at)) - np.repeat(begun, np.diff(np.append(begun, len(at))))) % LONGEST == 0
            begun = np.flatnonzero(new)
            n, first = np.diff(np.append(begun, len(at))), at[begun]
            data, begin, end = words.bytes, words.begin[first].tolist(), words.end[first + n + window - 2].tolist()
            dig = np.frombuffer(b"".join([digest(data[a:b]) for a, b in zip(begin, end, strict=True)]), dtype="<i8").reshape(-1, 2)
            document = words.document[first]
            rows = pa.array(document)
            columns = [pa.array(values[begun].view(np.int64)), pa.array(dig[:, 0].copy()), pa.array(dig[:, 1].copy()), part.column(0).take(rows), part.column(1).take(rows), pa.array((first - words.first[document]).astype(np.int32)), pa.array(n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["mini", "dig", "low", "id", "text_key", "start", "n"])

    rows = docs.where(F.col(f"`{text}`").isNotNull()).select(*_named(docs, id, text))
    return rows.mapInArrow(cut, "mini long, dig long, low long, id long, text_key long, start int, n int")


def _packed(batches, window: int):
    """Texts with wanted super-k-mers to packed strings; those of heavy minimisers window by window.

    Equal windows of a super-k-mer travel as one, with their places. Of equal windows in the texts at hand only those with
    the smallest id travel; others are known to be later (`heavy` is null), so a passage in a third of all documents
    doesn't meet in one bucket as often as there are documents.
    """
    names = ["bucket", "heavy", "dig", "low", "id", "places", "packed"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary()]
    for part in chunks(batches, "text"):
        words, rows, single = Words(texts(part)), [], {}
        data, least = words.bytes, {}
        for d, (doc, wanted) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
            for w in wanted:
                a = int(words.first[d]) + w["start"]
                if not w["heavy"]:
                    rows.append((w["mini"], False, w["dig"], w["low"], doc, [], data[words.begin[a] : words.end[a + w["n"] + window - 2]]))
                    continue
                for i in range(w["n"]):
                    one = data[words.begin[a + i] : words.end[a + i + window - 1]]
                    least[one] = min(doc, least.get(one, doc))
                    single.setdefault((one, doc, w["dig"], w["low"]), []).append(i)
        for (one, doc, dig, low), places in single.items():
            if doc > least[one]:
                rows.append((dig, None, dig, low, doc, places, None))
            else:
                rows.append((xxhash.xxh3_64_intdigest(one) - (1 << 63), True, dig, low, doc, places, one))
        for at in range(0, len(rows), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 5000], strict=True), kinds, strict=True)], names)


def _later_windows(group: list[tuple], window: int) -> list[tuple[int, int, int]]:
    """Of a bucket's super-k-mers `(dig, low, id, packed)`: (dig, low, window) of windows that a smaller id has too."""
    entries = []
    for s, (_, _, doc, packed) in enumerate(group):
        blanks = [i for i, b in enumerate(packed) if b == 32]
        begin, end = [0, *(i + 1 for i in blanks)], [*blanks, len(packed)]
        entries += [(packed[begin[i] : end[i + window - 1]], doc, s, i) for i in range(len(begin) - window + 1)]
    entries.sort()
    out, before, least = [], None, 0
    for w, doc, s, i in entries:
        if w != before:
            before, least = w, doc
        elif doc > least:
            out.append((group[s][0], group[s][1], i))
    return out


def _counted(batches, window: int):
    """Sorted buckets to `(dig, low, at)`: windows of a first occurrence that a smaller id has too."""
    found: list[tuple[int, int, int]] = []
    group: list[tuple] = []
    bucket, before, least = None, None, 0

    def out():
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["dig", "low", "at"])
        found.clear()

    for batch in batches:
        for b, heavy, dig, low, doc, places, packed in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if heavy is None:
                found += [(dig, low, i) for i in places]
                continue
            if heavy:  # sorted by words and id: the first of equal windows has the smallest id
                if packed != before:
                    before, least = packed, doc
                elif doc > least:
                    found += [(dig, low, i) for i in places]
                continue
            if b != bucket:
                found += _later_windows(group, window) if len(group) > 1 else []
                bucket, group = b, []
            group.append((dig, low, doc, packed))
        yield from out()
    found += _later_windows(group, window) if len(group) > 1 else []
    yield from out()


def _firsts(occurrences: DataFrame, docs: DataFrame, id: str, text: str, window: int, heavy: int) -> DataFrame:
    """`(dig, low, first, windows)` of keys that remove words: in documents after `first` all, in it `windows`."""
    keys = occurrences.groupBy("dig", "low").agg(F.min(F.struct("id", "text_key", "start", "n")).alias("own"), F.max("id").alias("last"), F.first("mini").alias("mini"))
    shared = keys.groupBy("mini").agg(F.count("*").alias("keys"), F.sum("own.n").alias("all")).where("keys > 1")
    wanted = keys.join(shared, "mini").select("own.id", "own.text_key", F.struct("mini", "dig", "low", "own.start", "own.n", (F.col("all") > heavy).alias("heavy")).alias("w"))
    wanted = wanted.groupBy("id", "text_key").agg(F.collect_list("w").alias("wanted"))
    held = docs.where(F.col(f"`{text}`").isNotNull()).select(*_named(docs, id, text)).join(wanted, ["id", "text_key"]).select("id", "text", "wanted")
    packed = held.mapInArrow(lambda b: _packed(b, window), "bucket long, heavy boolean, dig long, low long, id long, places array<int>, packed binary")
    dealt = packed.repartition("bucket").sortWithinPartitions("bucket", "packed", "id")
    later = dealt.mapInArrow(lambda b: _counted(b, window), "dig long, low long, at int").groupBy("dig", "low").agg(F.collect_set("at").alias("windows"))
    return keys.join(later, ["dig", "low"], "left").where("last > own.id OR windows IS NOT NULL").select("dig", "low", F.col("own.id").alias("first"), "windows")


def dedup_substrings(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = 50, gram: int = 8, heavy: int = 20_000, keep: list[str] | None = None) -> DataFrame:
    """All rows, of them the columns `keep` or else all, with `n_words`, `n_removed`, `removed` (word ranges) and `kept_text` (null for null)."""
    if not 1 <= gram <= window:
        raise ValueError("need 1 <= gram <= window")
    occurrences = saved(superkmers(docs, id, text, window, gram))
    firsts = saved(_firsts(occurrences, docs, id, text, window, heavy))
    whole = F.array(F.struct(F.col("start").alias("start"), (F.col("start") + F.col("n") + (window - 1)).alias("stop")))
    single = F.transform(F.coalesce("windows", F.array().cast("array<int>")), lambda i: F.struct((F.col("start") + i).alias("start"), (F.col("start") + i + window).alias("stop")))
    spans = occurrences.join(firsts, ["dig", "low"]).select("id", "text_key", F.when(F.col("id") > F.col("first"), whole).otherwise(single).alias("spans"))
    spans = spans.where(F.size("spans") > 0).groupBy("id", "text_key").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    keep = others(docs, ADDED) if keep is None else keep

    def remove(batches):
        for part in chunks(batches, "text"):
            whole = texts(part)
            words = Words(whole)
            change = np.zeros(len(words) + 1, dtype=np.int64)
            spans = part.column(part.num_columns - 1)
            values = spans.flatten()
            sizes = np.diff(spans.offsets.to_numpy()) if len(spans) else np.zeros(0, int)
            base = np.repeat(words.first[:-1], sizes)
            np.add.at(change, base + values.field(0).to_numpy(zero_copy_only=False), 1)
            np.add.at(change, base + values.field(1).to_numpy(zero_copy_only=False), -1)
            gone = np.cumsum(change)[:-1] > 0
            total = np.concatenate(([0], np.cumsum(gone)))
            n_words, n_removed = np.diff(words.first), total[words.first[1:]] - total[words.first[:-1]]
            removed: list[list] = [[] for _ in whole]
            kept: list = part.column(part.num_columns - 2).to_pylist()
            starts, stops = runs(words.document * 2 + gone) if len(words) else (np.zeros(0, int), np.zeros(0, int))
            segments: dict[int, list[bytes]] = {d: [] for d in np.flatnonzero(n_removed).tolist()}
            for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
                d = int(words.document[a])
                if d in segments:
                    if gone[a]:
                        removed[d].append({"start": a - int(words.first[d]), "stop": b - int(words.first[d])})
                    else:
                        o = words.offset[d]
                        segments[d].append(whole[d][words.raw_begin[a] - o : words.raw_end[b - 1] - o])
            for d, x in segments.items():
                kept[d] = b"\n".join(x).decode()
            out = [pa.array(n_words), pa.array(n_removed), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + out, names)

    # columns travel under neutral names, so that none clashes
    names = [*(f"c{i}" for i in range(len(keep))), *ADDED]
    spec = "".join(f"c{i} {docs.schema[n].dataType.simpleString()}, " for i, n in enumerate(keep))
    source = [F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(keep) if n != text]
    whole_row = docs.select(*source, *_named(docs, id, text)).join(spans, ["id", "text_key"], "left")
    ordered = [F.col("text").alias(f"c{i}") if n == text else F.col(f"c{i}") for i, n in enumerate(keep)]
    none = F.array().cast("array<struct<start:int,stop:int>>")
    done = whole_row.select(*ordered, "text", F.coalesce("spans", none).alias("spans")).mapInArrow(remove, spec + "n_words long, n_removed long, removed array<struct<start:long,stop:long>>, kept_text string")
    return done.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(keep)], *quoted(ADDED))


def query(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    found = dedup_substrings(docs, keep=["doc_id"])
    words = F.array_remove(F.split(F.coalesce("kept_text", F.lit("")), "[\\x20\\x09-\\x0D]+"), "")
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.array_join(words, " "), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS win
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)
), f AS (SELECT win, min(doc_id) AS first FROM g GROUP BY win),
r AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS k FROM g JOIN f USING (win) WHERE first < doc_id),
w AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS k, unnest(w) AS word FROM d),
k AS (
  SELECT w.doc_id, count(r.k) AS n_removed, string_agg(w.word, ' ' ORDER BY w.k) FILTER (WHERE r.k IS NULL) AS kept
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id AND r.k = w.k GROUP BY w.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

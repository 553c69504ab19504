"""Best-fit packing of tokenised documents into sequences, by hierarchical residual packing.

Each partition tokenises its documents, cuts those longer than a sequence, and packs its pieces best-fit in
decreasing length. Nearly full bins are final. Underfull bins go on as single items: groups of `fan_in`
partitions pack them best-fit again, emit what is nearly full, and the rest meets in the next round, until
one group is left. A round only moves (bin, fill) pairs, never pieces. No piece is ever dropped.

What goes on is bounded and loses nothing. Best fit leaves at most one bin of a group half full or less, and
only those can be put into others; all of them go on. Of fuller bins with the same free space, more than
`fan_in` can't be used in one round, so `fan_in` times the rounds that there can be go on and the others are
final. A task holds its partition's pieces as numbers, some 50 bytes each, and `ids` only with `with_ids`.

Token ids are those of the tokenizers library for the vocabulary file, without added start and end tokens, plus
`end_id` after each document. As the library does by default, the string of a special token in a text gives that
token's id. Where the file is a byte-level BPE whose ids are in the order of its merges, its merges are run by tiktoken,
which gives the same ids in a quarter of the time; texts with a special token's string or a very long word, and other
kinds of files, go through the library itself.

Defined results: a null or empty text is one piece of the end token alone. Repeated rows are packed each on
its own. An empty table gives an empty table. Only the id and text columns are read.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import chunks, saved, spread, table
from gridloom.plans.scratch import dropped

PIECES = "id long, piece int, start long, length long, ids_crc32 long, ids binary, bin long, offset long, fill long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def byte_ranks(known: dict) -> dict[bytes, int] | None:
    """Ranks of byte strings of a tokenizers file, or None where it isn't a plain byte-level BPE."""
    before, model = known["pre_tokenizer"] or {}, known["model"]
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and known["normalizer"] is None
    if not plain or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
        return None
    # printable Latin-1 bytes stand for themselves, the others for the characters from 256 on
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(shown)))}
    special = {t["content"] for t in known["added_tokens"]}
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in special}
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if any(vocabulary.get(m) != 256 + i for i, m in enumerate(merges)):
        return None
    return {bytes(byte[c] for c in t): i for t, i in vocabulary.items()}


class Tokens:
    """Texts to token ids (little-endian 32 bits)."""

    long_word = 4000

    def __init__(self, vocabulary: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary)
        known = json.loads(vocabulary)
        ranks = byte_ranks(known)
        self.fast = ranks and tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = [t["content"] for t in known["added_tokens"]]

    def encode(self, text: str) -> bytes:
        slow = not self.fast or any(s in text for s in self.special) or (len(text) > self.long_word and max(map(len, text.split(" "))) > self.long_word)
        ids = self.library.encode(text, add_special_tokens=False).ids if slow else self.fast.encode_ordinary(text)
        return np.array(ids, dtype="<u4").tobytes()


def tokens_of(vocabulary: str, pattern: str) -> Tokens:
    """One for each Python worker, which runs many tasks: it is kept beside the library that it loads."""
    import tokenizers

    held = vars(tokenizers).setdefault("_kept", {})
    if (vocabulary, pattern) not in held:
        held.clear()
        held[vocabulary, pattern] = Tokens(vocabulary, pattern)
    return held[vocabulary, pattern]


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and offset, and each bin's fill.

    Open bins are held by free space; a bit set of the spaces in use finds the tightest one.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fills: list[int] = []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        above = used >> n
        if above:
            space = n + (above & -above).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                used &= ~(1 << space)
            offsets[i] = fills[b]
            fills[b] += n
        else:
            b, space = len(fills), capacity
            fills.append(n)
        bins[i] = b
        if space > n:
            by_space[space - n].append(b)
            used |= 1 << (space - n)
    return bins, offsets, np.array(fills, dtype=np.int64)


def pieces_of(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first."""
    head = total % capacity or capacity
    return [(0, head)] + [(s, capacity) for s in range(head, total, capacity)]


def going_on(fills: np.ndarray, capacity: int, slack: int, partners: int) -> np.ndarray:
    """Which bins later rounds can use: all at most half full, and of fuller ones `partners` of each free space."""
    order = np.argsort(fills, kind="stable")
    same = fills[order]
    place = np.arange(len(fills)) - np.searchsorted(same, same)
    out = np.zeros(len(fills), dtype=bool)
    out[order] = (same < capacity - slack) & ((2 * same <= capacity) | (place < partners))
    return out


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0, vocabulary: str | None = None, pattern: str | None = None, with_ids: bool = False, slack: int = 16, fan_in: int = 8) -> DataFrame:
    """`(id, piece, start, length, ids_crc32, sequence_id, offset)`, one row per piece, and `ids` with `with_ids`.

    `slack`: a bin with at most so much free space is nearly full. `vocabulary`: a file of the tokenizers library, and
    `pattern` what its byte-level pre-tokenizer matches.
    """
    if capacity < 1 or fan_in < 2 or slack < 0:
        raise ValueError("capacity must be positive, fan_in at least 2, slack not negative")
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file
    pattern = pattern or default_pattern()
    end = np.array([end_id], dtype="<u4").tobytes()
    rounds = 1
    while fan_in**rounds < 1 << 31:  # partitions that Spark can count
        rounds += 1
    partners = fan_in * rounds

    def local(batches):
        tokens, part = tokens_of(shared.value, pattern), TaskContext.get().partitionId()
        known, id_, piece, start, length, crc, own = array("b"), array("q"), array("i"), array("q"), array("q"), array("q"), []
        for some in chunks(batches, "text"):
            texts = [t or "" for t in some.column(1).to_pylist()]
            for d, text in zip(some.column(0).to_pylist(), texts, strict=True):
                ids = tokens.encode(text) + end
                for k, (s, n) in enumerate(pieces_of(len(ids) // 4, capacity)):
                    these = ids[4 * s : 4 * (s + n)]
                    known.append(d is not None)
                    id_.append(d or 0)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(these))
                    if with_ids:
                        own.append(these)
        if not len(piece):
            return
        bins, offsets, fills = best_fit(np.asarray(length), capacity)
        first, mask = part << 32, np.asarray(known) == 0
        whole = [pa.array(np.asarray(id_), mask=mask), pa.array(np.asarray(piece)), *[pa.array(np.asarray(c)) for c in (start, length, crc)], pa.array(own, pa.binary()) if with_ids else pa.nulls(len(piece), pa.binary()), pa.array(first + bins), pa.array(offsets), pa.nulls(len(piece), pa.int64())]
        names = ["id", "piece", "start", "length", "ids_crc32", "ids", "bin", "offset", "fill"]
        for at in range(0, len(piece), 10_000):
            yield pa.RecordBatch.from_arrays([c.slice(at, 10_000) for c in whole], names)
        # one row more for each bin that goes on, with piece -1
        on = np.flatnonzero(going_on(fills, capacity, slack, partners))
        none = pa.nulls(len(on), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(np.full(len(on), -1, np.int32)), none, none, none, pa.nulls(len(on), pa.binary()), pa.array(first + on), none, pa.array(fills[on])], names)

    made = saved(docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(local, PIECES))

    def merge(key, group):
        items = group.sort_by([("fill", "descending"), ("bin", "ascending")])
        name, fill = items.column("bin").to_numpy(), items.column("fill").to_numpy()
        bins, offsets, fills = best_fit(fill, capacity)
        opener = np.zeros(len(fills), dtype=np.int64)
        opener[bins[offsets == 0]] = name[offsets == 0]
        return pa.table({"bin": name, "parent": opener[bins], "base": offsets, "fill": fills[bins], "open": going_on(fills, capacity, slack, partners)[bins]})

    # One row for each underfull bin that goes on; pieces are not touched again.
    places = saved(made.where("piece = -1").select("bin", F.col("bin").alias("parent"), F.lit(0).cast("long").alias("base"), "fill", F.lit(True).alias("open")))
    width = (places.agg(F.max(F.shiftright("bin", 32))).first()[0] or 0) + 1
    reach = 1
    while reach < width * fan_in:
        reach *= fan_in
        ready = places.where("open AND base = 0 AND bin = parent").select((F.shiftright("bin", 32) / reach).cast("long").alias("group"), "bin", "fill")
        step = ready.groupBy("group").applyInArrow(merge, "bin long, parent long, base long, fill long, open boolean")
        step = step.select(F.col("bin").alias("parent"), F.col("parent").alias("_parent"), F.col("base").alias("_base"), F.col("fill").alias("_fill"), F.col("open").alias("_open"))
        moved = places.join(step, "parent", "left")
        before = places
        places = saved(moved.select("bin", F.coalesce("_parent", "parent").alias("parent"), (F.col("base") + F.coalesce("_base", F.lit(0))).alias("base"), F.coalesce("_fill", "fill").alias("fill"), F.coalesce("_open", F.lit(False)).alias("open")))
        dropped(before)
        if reach >= width:
            break
    placed = made.where("piece >= 0").join(places.select("bin", "parent", "base"), "bin", "left")
    out = [F.col("id").alias(id), "piece", "start", "length", "ids_crc32", F.coalesce("parent", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset")]
    return placed.select(*out, *(["ids"] if with_ids else []))


def query(spark, sf_dir):
    return pack(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"))

"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has a bit set where over half of a text's shingle hashes have it. It is split into blocks;
two fingerprints within `distance` bits differ in at most that many blocks, so they agree on some choice of
`blocks - distance` blocks. Every choice is a join key: fingerprints meet under a key, and their Hamming
distance is verified there. With seven blocks and distance four there are 35 keys of 27 or more bits.

Identical fingerprints are combined before the first shuffle of keys, so a group of copies is one row
however large it is. Under a key no pairs are listed: a breadth-first search that only compares against
fingerprints not yet reached gives one edge per fingerprint. Components are then found by distributed
star contraction.

A task never holds more than `most` fingerprints of a key. A key that has more passes them on, and the bits that
they don't share yet are split into blocks in the same way: close pairs agree on some choice of these too. Every level
fixes at least three in seven of the bits left, so after a few levels a key can't have more different fingerprints. Each
level makes up to 35 rows of one; over 4,096 fingerprints that differ in 37 bits alone are needed for a second level.

`near_copies` is for the corpus pipeline, where texts count as near copies from a Jaccard of 0.8 of their shingle sets.
Such pairs differ in 39 of 256 bits on average (10 of 64): blocks of which one must stay whole would be five bits wide
and hold a thirtieth of all texts each, so pigeonhole blocks can't find them. It joins the sets' rarest shingles instead,
uses SimHash bits as a wide cut, and verifies sets exactly.

Defined results: a null or empty text has the fingerprint zero and is linked like any other. A text of
fewer words than a shingle is one shingle. Repeated rows give repeated results; rows with the same id are
one node. A null id takes part but never names a component: one of null ids alone has a null component. Columns other
than id and text are never read; `representatives` passes them through, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Rolling, Words, chunks, mix64, runs, saved, shielded, spread, table, texts
from gridloom.llm.graph import components
from gridloom.plans.scratch import dropped

SEED = 42
#: Ids of distinct fingerprints that only rows with a null id have lie above this.
NAMELESS = 1 << 62


def shingle_hashes(words: Words, size: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of every text, and the text each belongs to."""
    first = words.first
    count = np.diff(first)
    n = np.where(count == 0, 0, np.maximum(count - size + 1, 1))
    document = np.repeat(np.arange(len(count)), n)
    start = np.repeat(first[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    stop = np.minimum(start + size, first[document + 1]) - 1
    data, digest = words.bytes, xxhash.xxh64_intdigest
    values = [digest(data[a:b], seed) for a, b in zip(words.begin[start].tolist(), words.end[stop].tolist(), strict=True)]
    return np.array(values, dtype=np.uint64), document


def majority(hashes: np.ndarray, document: np.ndarray, n: int) -> np.ndarray:
    """Per text, the bits that over half of its hashes have; zero without hashes."""
    out = np.zeros(n, dtype=np.uint64)
    if not len(hashes):
        return out
    starts, stops = runs(document)
    size = stops - starts
    value = np.zeros(len(starts), dtype=np.uint64)
    for bit in range(64):
        ones = np.add.reduceat((hashes >> np.uint64(bit)) & np.uint64(1), starts).astype(np.int64)
        value |= (2 * ones > size).astype(np.uint64) << np.uint64(bit)
    out[document[starts]] = value
    return out


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """`(id, text_key, fp)`: a hash that tells texts of one id apart, and 64 bits."""

    def make(batches):
        for part in chunks(batches, "text"):
            hashes, document = shingle_hashes(Words(texts(part), lower=True), shingle)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(majority(hashes, document, part.num_rows).view(np.int64))], ["id", "text_key", "fp"])

    body = F.col(f"`{text}`").cast("string")
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("id"), body.alias("text"), F.xxhash64(body).alias("text_key"))
    return rows.mapInArrow(make, "id long, text_key long, fp long")


def pigeonhole_masks(distance: int, blocks: int, fixed: int = 0) -> tuple[int, ...]:
    """`fixed` and one choice of blocks of the other bits, for every choice that a close pair may keep whole."""
    free = [b for b in range(64) if not fixed >> b & 1]
    cuts = [len(free) * i // blocks for i in range(blocks + 1)]
    block = [sum(1 << x for x in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return tuple(fixed + sum(choice) for choice in combinations(block, blocks - distance))


def spanning(n: int, near) -> list[tuple[int, int]]:
    """Edges that connect what `near(at, left)` connects; each of n rows is reached once.

    A row that was reached is never compared again with others that were, so a dense group costs about one
    comparison for each member, and memory is a few times the group.
    """
    left, edges = np.arange(n), []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            at = front.pop()
            close = near(at, left)
            if close.any():
                reached = left[close].tolist()
                edges += [(at, b) for b in reached]
                front += reached
                left = left[~close]
    return edges


def spanning_links(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges that connect what pairs of fingerprints within `distance` connect."""
    return spanning(len(values), lambda at, left: np.bitwise_count(values[left] ^ values[at]) <= distance)


def bucketed(batches, most: int, splits=lambda columns: True):
    """Batches sorted by their first column to `(columns, starts, stops)` of runs with at most `most` rows, and to
    `(columns, None, None)` for the rows of longer ones, in parts.

    `splits(columns)` says of a run's first rows whether it can be split elsewhere; if not it is a run whatever its size.
    """
    rest, long_key = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        data = [np.asarray(c) for c in batch.columns]
        if long_key is not None:
            n = int(np.searchsorted(data[0] != long_key, True)) if data[0][-1] != long_key else len(data[0])
            if n:
                yield [c[:n] for c in data], None, None
            if n == len(data[0]):
                continue
            data, long_key = [c[n:] for c in data], None
        if rest is not None:
            data = [np.concatenate(x) for x in zip(rest, data, strict=True)]
        starts, stops = runs(data[0])
        long = [k for k in np.flatnonzero(stops - starts > most).tolist() if splits([c[starts[k] : stops[k]] for c in data])]
        for k in long:
            yield [c[starts[k] : stops[k]] for c in data], None, None
        last = len(starts) - 1
        ready = np.ones(len(starts), dtype=bool)
        ready[[*long, last]] = False
        yield data, starts[ready], stops[ready]
        rest = None if last in long else [c[starts[last] :] for c in data]
        long_key = data[0][-1] if last in long else None
    if rest is not None:
        yield rest, *runs(rest[0])


def run_edges(node: np.ndarray, starts: np.ndarray, stops: np.ndarray, near) -> np.ndarray:
    """Edges by `near(at, left)` of row numbers inside each run, as an array of node pairs without repeats."""
    two = starts[stops - starts == 2]
    two = two[near(two, two + 1)] if len(two) else two
    u, v = [node[two]], [node[two + 1]]
    many = stops - starts > 2
    for a, b in zip(starts[many].tolist(), stops[many].tolist(), strict=True):
        if edges := spanning(b - a, lambda at, left, a=a: near(at + a, left + a)):
            pair = np.array(edges) + a
            u.append(node[pair[:, 0]])
            v.append(node[pair[:, 1]])
    return np.unique(np.stack([np.concatenate(u), np.concatenate(v)], axis=1), axis=0)


def linked(distinct: DataFrame, distance: int, blocks: int, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """`distinct (node, fp)` to edges `(u, v)` that connect all fingerprints within `distance`, and the tables read for it."""
    if not 0 <= distance < blocks <= 64:
        raise ValueError("need 0 <= distance < blocks <= 64")

    def keyed(batches):
        masks: dict[int, np.ndarray] = {}
        for batch in batches:
            node, fp, fixed = (np.asarray(c) for c in batch.columns)
            fp, fixed = fp.view(np.uint64), fixed.view(np.uint64)
            for m in np.unique(fixed).tolist():
                own = fixed == m
                if m not in masks:
                    masks[m] = np.array(pigeonhole_masks(distance, blocks, m), dtype=np.uint64)
                for mask in masks[m]:
                    key = mix64((fp[own] & mask) ^ mix64(np.full(int(own.sum()), mask)))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node[own]), pa.array(fp[own].view(np.int64)), pa.array(np.full(len(key), mask).view(np.int64))], ["key", "node", "fp", "mask"])

    def splits(columns) -> bool:
        return 64 - int(np.bitwise_count(columns[3][:1].view(np.uint64))[0]) >= blocks

    def link(batches):
        for data, starts, stops in bucketed(batches, most, splits):
            if starts is None:  # rows for the next level
                none = pa.nulls(len(data[0]), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(data[1]), none, pa.array(data[2]), pa.array(data[3])], ["u", "v", "fp", "mask"])
                continue
            values = data[2].view(np.uint64)
            pairs = run_edges(data[1], starts, stops, lambda at, left, values=values: np.bitwise_count(values[left] ^ values[at]) <= distance)
            if len(pairs):
                none = pa.nulls(len(pairs), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none, none], ["u", "v", "fp", "mask"])

    todo, steps = distinct.select("node", "fp", F.lit(0).cast("long").alias("mask")), []
    while True:
        rows = todo.mapInArrow(keyed, "key long, node long, fp long, mask long")
        steps.append(saved(rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(link, "u long, v long, fp long, mask long")))
        rest = steps[-1].where("v IS NULL")
        if rest.isEmpty():
            break
        todo = rest.select(F.col("u").alias("node"), "fp", "mask")
    edges = steps[0].where("v IS NOT NULL").select("u", "v")
    for step in steps[1:]:
        edges = edges.union(step.where("v IS NOT NULL").select("u", "v"))
    return edges, steps


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, distance: int = 4, blocks: int = 7, most: int = 4096) -> DataFrame:
    """One row `(id, text_key, fp, component, group)` per input row; `component` is the smallest id that
    links reach, and `group` the same or, of null ids alone, a number of its own."""
    rows = saved(fingerprints(docs, id, text, shingle))
    nameless = F.lit(NAMELESS).cast("long").bitwiseOR(F.shiftrightunsigned(F.xxhash64("fp"), 2))
    distinct = saved(rows.groupBy("fp").agg(F.min("id").alias("id")).select(F.coalesce("id", nameless).alias("node"), "fp"))
    edges, steps = linked(distinct, distance, blocks, most)
    roots = components(edges).withColumnRenamed("node", "_node")
    dropped(*steps)
    named = distinct.join(roots, F.col("node") == F.col("_node"), "left").select("fp", F.coalesce("root", "node").alias("root"))
    merged = rows.join(named, "fp").select("id", "text_key", "fp", F.when(F.col("root") < NAMELESS, F.col("root")).alias("component"), F.col("root").alias("group"))
    return merged.withColumnRenamed("id", id)


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different shingle hashes of every text in order, and where each text's begin."""
    first = words.first
    count = np.diff(first)
    n = np.where(count == 0, 0, np.maximum(count - size + 1, 1))
    document = np.repeat(np.arange(len(count)), n)
    start = np.repeat(first[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    stop = np.minimum(start + size, first[document + 1]) - 1
    hashes = Rolling(words.buffer).spans(words.begin[start], words.end[stop]) if len(start) else np.zeros(0, np.uint64)
    ends = np.cumsum(n)
    for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (document[1:] != document[:-1])
    at = np.zeros(len(first), dtype=np.int64)
    np.cumsum(np.bincount(document[new], minlength=len(at) - 1), out=at[1:])
    return hashes[new], at


def slot_counts(docs: DataFrame, text: str, shingle: int, slots: int) -> np.ndarray:
    """In how many texts the shingles of each of `2**slots` slots occur, over all documents.

    A task sends one packed array, sixteen tasks add them up, and the driver adds up sixteen.
    """

    def unpacked(batches):
        total = np.zeros(1 << slots, dtype=np.int64)
        for batch in batches:
            for blob in batch.column(0):
                total += np.frombuffer(pa.decompress(blob.as_py(), decompressed_size=total.nbytes, codec="zstd", asbytes=True), dtype=np.int64)
        return total

    def packed(total):
        return pa.RecordBatch.from_arrays([pa.array([pa.compress(total.tobytes(), codec="zstd", asbytes=True)], pa.binary())], ["counts"])

    def count(batches):
        total = np.zeros(1 << slots, dtype=np.int64)
        for part in chunks(batches, "text"):
            hashes, _ = shingle_sets(Words(texts(part), lower=True), shingle)
            total += np.bincount((hashes >> np.uint64(64 - slots)).astype(np.int64), minlength=len(total))
        yield packed(total)

    def add(batches):
        yield packed(unpacked(batches))

    sums = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(count, "counts binary").repartition(16).mapInArrow(add, "counts binary").toArrow()
    return unpacked(sums.to_batches())


def prefixes(hashes: np.ndarray, at: np.ndarray, counts: np.ndarray, part: int, of: int) -> tuple[np.ndarray, np.ndarray]:
    """The first hashes of every text in one order of all hashes, rare slots first: as many as two sets with a
    Jaccard of `part / of` can't do without one in common. Also how many each text has."""
    size = np.diff(at)
    count = np.where(size > 0, size - -(-part * size // of) + 1, 0)
    # one number in the order of (count of the slot, hash); a text's hashes are in order, which settles the last bits
    rank = np.minimum(counts[(hashes >> np.uint64(65 - len(counts).bit_length())).astype(np.int64)], (1 << 24) - 1).astype(np.uint64)
    key = rank << np.uint64(40) | hashes >> np.uint64(24)
    first = [hashes[a:b][np.argsort(key[a:b], kind="stable")[:c]] for a, b, c in zip(at[:-1].tolist(), at[1:].tolist(), count.tolist(), strict=True)]
    return (np.concatenate(first) if first else hashes[:0]), count


def signatures(docs: DataFrame, id: str, text: str, shingle: int, lanes: int, part: int, of: int, slots: int) -> DataFrame:
    """`(id, text_key, node, size, fp0.., keys)`: a hash and the size of the set of shingles, the set's SimHash, and its prefix."""
    counts = docs.sparkSession.sparkContext.broadcast(slot_counts(docs, text, shingle, slots))  # `2**slots` numbers

    def make(batches):
        for some in chunks(batches, "text"):
            hashes, at = shingle_sets(Words(texts(some), lower=True), shingle)
            n, size = some.num_rows, np.diff(at)
            document = np.repeat(np.arange(n), size)
            node = np.array([xxhash.xxh64_intdigest(hashes[a:b].tobytes(), SEED) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], dtype=np.uint64)
            columns = [some.column(0), some.column(2), pa.array(node.view(np.int64)), pa.array(size)]
            for lane in range(lanes):
                h = hashes if not lane else mix64(hashes + np.uint64(lane * 0x9E3779B97F4A7C15 % (1 << 64)))
                columns.append(pa.array(majority(h, document, n).view(np.int64)))
            keys, count = prefixes(hashes, at, counts.value, part, of)
            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(keys.view(np.int64))))
            yield pa.RecordBatch.from_arrays(columns, ["id", "text_key", "node", "size", *(f"fp{i}" for i in range(lanes)), "keys"])

    body = F.col(f"`{text}`").cast("string")
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("id"), body.alias("text"), F.xxhash64(body).alias("text_key"))
    return rows.mapInArrow(make, "id long, text_key long, node long, size long, " + ", ".join(f"fp{i} long" for i in range(lanes)) + ", keys array<long>")


def in_blocks(rows: DataFrame, key: str, most: int, weight: str | None = None, most_weight: int = 1) -> DataFrame:
    """Rows with another `key` each, so that any two rows of one old key meet under a new one, which has at most about
    `2 * most` rows or a weight of `2 * most_weight`.

    A key with more is dealt into blocks by a hash of `node`, and its rows go to every pair of blocks with their own.
    """
    parts = F.ceil(F.count("*") / most)
    if weight:
        parts = F.greatest(parts, F.ceil(F.sum(weight) / most_weight))
    counts = rows.groupBy(key).agg(parts.cast("int").alias("_parts"))
    block = F.pmod(F.xxhash64("node"), F.col("_parts"))
    dealt = rows.join(counts, key).select("*", block.alias("_block"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_other"))
    return dealt.withColumn(key, F.xxhash64(key, F.least("_block", "_other"), F.greatest("_block", "_other"))).drop("_parts", "_block", "_other")


def candidates(distinct: DataFrame, lanes: int, cut: int, few: int, part: int, of: int, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """Edges `(u, v)` that connect what shares a prefix key, has sizes that allow the Jaccard, and differs in at most
    `cut` bits; sets of at most `few` shingles have no reliable bits and need only the first two. Also the tables read for it."""
    fps = [f"fp{i}" for i in range(lanes)]
    kept = ["key", "node", "size", *fps]

    def link(batches, splits):
        for data, starts, stops in bucketed(batches, most, lambda columns: splits):
            if starts is None:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(data[0]), pa.int64())] * 2 + [pa.array(c) for c in data], ["u", "v", *kept])
                continue
            size, values = data[2], np.stack([c.view(np.uint64) for c in data[3:]], axis=1)

            def near(at, left, size=size, values=values):
                small, large = np.minimum(size[left], size[at]), np.maximum(size[left], size[at])
                bits = np.bitwise_count(values[left] ^ values[at]).sum(axis=-1)
                return (of * small >= part * large) & ((bits <= cut) | (small <= few))

            pairs = run_edges(data[1], starts, stops, near)
            if len(pairs):
                none = [pa.nulls(len(pairs), pa.int64())] * len(kept)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *none], ["u", "v", *kept])

    schema = "u long, v long, " + ", ".join(f"{c} long" for c in kept)
    step = lambda rows, splits: saved(rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(lambda b: link(b, splits), schema))
    steps = [step(distinct.select(F.explode("keys").alias("key"), "node", "size", *fps), True)]
    rest = steps[0].where("u IS NULL").select(*kept)
    if not rest.isEmpty():
        steps.append(step(in_blocks(rest, "key", most), False))
    edges = steps[0].where("u IS NOT NULL").select("u", "v")
    return (edges.union(steps[1].select("u", "v")) if len(steps) > 1 else edges), steps


def similar_sets(hashes: np.ndarray, at: np.ndarray, part: int, of: int) -> list[tuple[int, int]]:
    """Edges that connect what sets with a Jaccard of `part / of` or more connect; sets as of `shingle_sets`."""
    size = np.diff(at)
    number = np.unique(hashes, return_inverse=True)[1]
    mark = np.zeros(len(hashes), dtype=bool)
    held = [np.arange(len(size)), number, at[:-1]]  # rows that the next two are of, their hashes, where each begins

    def near(i, left):
        if 2 * len(left) < len(held[0]):
            held[0] = left
            begin = np.cumsum(size[left]) - size[left]
            held[1] = number[np.repeat(at[left] - begin, size[left]) + np.arange(size[left].sum())]
            held[2] = begin
        mark[number[at[i] : at[i + 1]]] = True
        both = np.add.reduceat(mark[held[1]], held[2], dtype=np.int64)[np.searchsorted(held[0], left)]
        mark[number[at[i] : at[i + 1]]] = False
        return of * both >= part * (size[left] + size[i] - both)

    return spanning(len(size), near)


def grouped(batches):
    """Columns of each run of equal values in the first column, which is sorted; a run may cross batches."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts, stops = runs(batch.column(0).to_numpy())
        if rest and rest[0].column(0)[0] != batch.column(0)[0]:
            yield pa.Table.from_batches(rest)
            rest = []
        for a, b in zip(starts[:-1].tolist(), stops[:-1].tolist(), strict=True):
            yield pa.Table.from_batches([*rest, batch.slice(a, b - a)])
            rest = []
        rest.append(batch.slice(starts[-1]))
    if rest:
        yield pa.Table.from_batches(rest)


def verified(members: DataFrame, shingle: int, part: int, of: int, most: int, most_shingles: int) -> DataFrame:
    """`members (root, node, size, text)`, one text for each set, to edges `(u, v)` of an exact Jaccard inside each root."""

    def make(batches):
        for group in grouped(batches):
            if group.num_rows < 2:
                continue
            node, sets = group.column("node").to_numpy(), []
            for some in chunks(group.combine_chunks().to_batches(), "text"):
                hashes, at = shingle_sets(Words(texts(some), lower=True), shingle)
                sets += [hashes[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            at = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
            if edges := similar_sets(np.concatenate(sets), at, part, of):
                pair = np.array(edges)
                yield pa.RecordBatch.from_arrays([pa.array(node[pair[:, 0]]), pa.array(node[pair[:, 1]])], ["u", "v"])

    dealt = in_blocks(members.select("root", "node", "size", "text"), "root", most, "size", most_shingles).drop("size")
    return dealt.repartition("root").sortWithinPartitions("root", "node").mapInArrow(make, "u long, v long")


def near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, lanes: int = 4, cut: int = 76, few: int = 48, part: int = 4, of: int = 5, slots: int = 20, most: int = 4096, most_members: int = 500, most_shingles: int = 125_000) -> DataFrame:
    """`(id, text_key, group)`: rows whose sets of shingles are linked by Jaccards of `part / of` or more share a group.

    Candidates come from prefixes of the sets, which no such pair escapes, and from a cut on SimHash bits that is
    wide for it; they only name groups in which links are then looked for by exact Jaccard. Keys and groups beyond
    `most`, `most_members` and `most_shingles` are dealt into blocks, each pair of which is a task of its own, so memory
    is bounded and no pair is lost.
    """
    fps = [f"fp{i}" for i in range(lanes)]
    rows = saved(signatures(docs, id, text, shingle, lanes, part, of, slots))
    distinct = saved(rows.groupBy("node").agg(F.min("text_key").alias("text_key"), *[F.first(c).alias(c) for c in ("size", *fps, "keys")]))
    edges, steps = candidates(distinct, lanes, cut, few, part, of, most)
    loose = components(edges).withColumnRenamed("node", "_node")
    dropped(*steps)
    chosen = distinct.join(loose, F.col("node") == F.col("_node")).select("node", "root", "size", F.col("text_key").alias("_key"))
    body = F.col(f"`{text}`").cast("string")
    members = docs.select(body.alias("text"), F.xxhash64(body).alias("text_key")).join(chosen, F.col("text_key") == F.col("_key")).dropDuplicates(["node"])
    members = saved(members.select("root", "node", "size", "text"))
    roots = components(verified(members, shingle, part, of, most_members, most_shingles)).withColumnRenamed("node", "_node")
    dropped(members, distinct)
    return rows.join(roots, F.col("node") == F.col("_node"), "left").select(F.col("id").alias(id), "text_key", F.coalesce("root", "node").alias("group"))


def representatives(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """Documents of which one of each group of near copies stays: the one with the smallest id.

    Near copies are texts whose sets of shingles have a Jaccard of 0.8 or more, and what they link. Null ids stay
    only where a group has no other.
    """
    found = near_copies(docs, id, text, shingle)
    first = F.min(F.struct(F.col(f"`{id}`").isNull().alias("none"), F.col(f"`{id}`").alias("id"), F.col("text_key")))
    kept = found.groupBy("group").agg(first.alias("own")).select(F.col("own.id").alias("_id"), F.col("own.text_key").alias("_key")).distinct()
    keyed, back = shielded(docs, ["_id", "_key", "_row_id", "_text_key"])
    own_id, own_text = back[docs.columns.index(id)], back[docs.columns.index(text)]
    keyed = keyed.select("*", own_id.cast("long").alias("_row_id"), F.xxhash64(own_text.cast("string")).alias("_text_key"))
    stays = keyed.join(kept, F.col("_row_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left_semi")
    return stays.dropDuplicates(["_row_id", "_text_key"]).select(*back)


def query(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    found = near_duplicates(docs, shingle=4, distance=4, blocks=7)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))

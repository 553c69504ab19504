import random

import numpy as np
import xxhash

from gridloom.llm.graph import components
from gridloom.llm.simhash import bucketed, linked, near_copies, near_duplicates, pigeonhole_masks, query, representatives, spanning_links

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, distance):
    """items: (id, fingerprint); id to smallest id reachable."""
    parent = list(range(len(items)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(items)):
        for b in range(a):
            if (items[a][1] ^ items[b][1]).bit_count() <= distance:
                parent[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(items):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: least[root(i)] for i, (d, _) in enumerate(items)}


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in query(spark, SF).collect()}
    items = [(r["doc_id"], brute_fingerprint(r["text"])) for r in rows]
    component = brute_components(items, 4)
    assert got == {d: (f"{f:016x}", component[d]) for d, f in items}


def test_planted_distances(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    items = []
    for f in base:
        for flips in (0, 0, 1, 4, 5, 8):
            items.append(f ^ sum(1 << b for b in rng.sample(range(64), flips)))
    hot = base[0]
    for _ in range(300):  # a dense group, many under the same keys
        items.append(hot ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    items = list(dict.fromkeys(items))
    signed = [(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(items)]
    distinct = spark.createDataFrame(signed, "node long, fp long")
    want = brute_components(list(enumerate(items)), 4)
    for most in (4096, 60):  # the latter splits keys over several levels
        edges, steps = linked(distinct, 4, 7, most)
        assert (len(steps) > 1) == (most < 4096)
        got = {r["node"]: r["root"] for r in components(edges).collect()}
        assert {i: got.get(i, i) for i in want} == want


def test_masks_fix_ever_more_bits():
    fixed = 0
    for most_free in (37, 22, 13):
        masks = pigeonhole_masks(4, 7, fixed)
        assert len(masks) == 35 and all(m & fixed == fixed for m in masks)
        fixed = min(masks, key=int.bit_count)
        assert 64 - fixed.bit_count() <= most_free


def test_bucketed_runs_over_batches():
    import pyarrow as pa

    keys = [1, 1, 2, 3, 3, 3, 3, 3, 3, 3, 4, 5, 5, 5, 5, 6, 6]
    for cut in range(1, 9):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + cut])], ["k"]) for i in range(0, len(keys), cut)]
        short, long = [], []
        for data, starts, stops in bucketed(iter(batches), 3):
            if starts is None:
                long += data[0].tolist()
            else:
                short += [x for a, b in zip(starts, stops, strict=True) for x in [data[0][a:b].tolist()]]
        assert sorted(long) == [3] * 7 + [5] * 4 and sorted(short) == [[1, 1], [2], [4], [6, 6]]


def test_spanning_links_gives_one_edge_for_each_member():
    values = np.array([0, 1, 3, 7, 2**40 - 1], dtype=np.uint64)
    assert len(spanning_links(values, 1)) == 3


def test_edge_cases(spark):
    rows = [(5, None, "x"), (2, "", "x"), (None, "", "y"), (7, "a b", "z"), (7, "a b", "z"), (None, "solo text", None), (9, "word " * 30000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r["doc_id"], r["component"]) for r in near_duplicates(docs, shingle=4).collect()), key=str)
    assert got == sorted([(5, 2), (2, 2), (None, 2), (7, 7), (7, 7), (None, None), (9, 9)], key=str)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.range(1, 400).selectExpr("id as u", "id - 1 as v").union(spark.createDataFrame([(900, 901), (901, 901)], "u long, v long"))
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(400)} | {900: 900, 901: 900}


def test_representatives_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    rows, common = [(0, ""), (1, "one"), (2, "one two"), (3, "one two three four five"), (4, "one two three four five six")], [word() for _ in range(60)]
    for _ in range(80):
        base = [word() for _ in range(rng.choice([9, 30, 100, 300]))]
        for _ in range(3):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy + common * rng.randint(0, 1))))
    rows.append((len(rows), " ".join(common)))
    rows.append((len(rows), " ".join(common * 40)))  # few shingles more, many repeats
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.split()) else set() for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    got = {r["doc_id"] for r in representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 100 < len(set(root)) < len(rows) and got == set(root)
    # small limits deal keys and groups into blocks and find the same
    least = {}
    for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string"), most=4, most_members=3, most_shingles=900).collect():
        least.setdefault(r["group"], []).append(r["doc_id"])
    assert {min(x) for x in least.values()} == set(root) and sorted(map(len, least.values())) == sorted(root.count(r) for r in set(root))


def test_representatives_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6, "x", 7), (2, "a b", 8, 9, "y", 7), (None, None, 1, 1, "z", 7)], "doc_id long, text string, _id int, _key int, _text_key string, node int")
    got = sorted((tuple(r) for r in representatives(docs).collect()), key=str)
    assert got == sorted([(1, "a b", 5, 6, "x", 7), (None, None, 1, 1, "z", 7)], key=str) and representatives(docs.limit(0)).count() == 0

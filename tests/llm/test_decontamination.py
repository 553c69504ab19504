import random
import re

from gridloom.llm.decontamination import decontaminate


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items, window, share):
    patterns = set()
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        patterns |= {(str(i) if i is not None else "null", tuple(w[k : k + n])) for k in range(len(w) - n + 1) if n}
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for name, p in patterns:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    found.add(name)
        out.append((d, len(w), len(hit), sorted(found), bool(hit) and share * len(hit) >= len(w)))
    return sorted(out, key=str)


def got(out):
    rows = out.collect()
    for r in rows:
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_hit"]
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in rows), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Ab", "cd", "éa", "x1", "zz", "q", "long-er"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 4, 9])))) for i in range(12)]
    rows = []
    for d in range(40):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if d % 3 == 0:
            body += items[d % 12][1].upper().replace("É", "é").split()
        rows.append((d, rng.choice([" ", "\n", ", "]).join(body)))
    return rows, items


def test_against_brute_force(spark):
    for seed, bits in ((1, 27), (2, 13)):
        rows, items = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        benchmark = spark.createDataFrame(items, "item_id long, text string")
        assert got(decontaminate(docs, benchmark, window=4, shingle=2, filter_bits=bits)) == brute(rows, items, 4, 20)


def test_edge_cases(spark):
    rows = [(None, None), (1, ""), (2, "!!! \x7f"), (3, "a b c d"), (3, "a b c d"), (4, "w " * 50000 + "a b c d")]
    items = [(7, "A B. C d"), (7, "A B. C d"), (None, "w w w w w w"), (8, None), (9, "--")]
    docs = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, spans string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert got(decontaminate(docs, benchmark, window=3)) == brute(rows, items, 3, 20)
    none = benchmark.limit(0)
    assert got(decontaminate(docs, none)) == brute(rows, [], 13, 20)
    assert decontaminate(docs.limit(0), benchmark).count() == 0


def test_large_benchmark_and_few_kept_columns(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(9000)]  # 2.5 MB
    rows = []
    for d in range(300):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(0, 100))]
        if d % 2:
            own = items[rng.randrange(9000)][1].split()
            at = rng.randrange(40)
            body[5:5] = own[at : at + rng.randint(10, 20)]
        rows.append((d, " ".join(body)))
    assert sum(len(t) for _, t in items) > 2 << 20
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    index = {}
    for i, t in items:
        w = t.split()
        for k in range(48):
            index.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    expected = []
    for d, t in rows:
        w, hit, found = t.split(), set(), set()
        for k in range(len(w) - 12):
            if own := index.get(tuple(w[k : k + 13])):
                hit |= set(range(k, k + 13))
                found |= own
        expected.append((d, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    for limit in (100_000, 0):  # the second has no broadcast of the texts found
        out = decontaminate(docs, benchmark, keep=["doc_id"], broadcast_rows=limit)
        assert out.columns == ["doc_id", "n_words", "n_hit", "spans", "items", "contaminated"]
        assert got(out) == sorted(expected, key=str)


def test_clashing_names_pass(spark):
    docs = spark.createDataFrame([(1, "a b c d", 5, 6, "x")], "doc_id long, text string, k1 int, spans_ int, HASH string")
    benchmark = spark.createDataFrame([(7, "b c")], "item_id long, text string")
    row = decontaminate(docs, benchmark).first()
    assert (row["k1"], row["spans_"], row["HASH"], row["text"], row["n_hit"], row["items"]) == (5, 6, "x", "a b c d", 2, ["7"])

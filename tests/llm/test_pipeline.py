import random

import corpus_pipeline as P
from gridloom.llm.common import saved
from gridloom.llm.simhash import representatives

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for name, stage in P.STAGES[:-1]:
        out = saved(stage(spark, docs, SF))
        assert out.columns == names and 0 < out.count() <= docs.count(), name
        docs = out
    packed = P.STAGES[-1][1](spark, docs, SF)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_stages_take_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "w " * 40000, None, "s", 9), (3, "Plain words in a line of text.", "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS score", "'x' AS group")
    for table in (docs, docs.limit(0)):
        for name, stage in P.STAGES:
            out = stage(spark, table, SF)
            assert out.columns == table.columns or name == "best_fit_packing"
            out.collect()


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    rows, near = [], []
    for k in range(60):
        base = [word() for _ in range(rng.randint(80, 400))]
        rows.append((1000 * k, " ".join(base)))
        for c in range(1, 4):
            copy = list(base)
            for _ in range(max(0, len(base) * (c - 1) // 100)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((1000 * k + c, " ".join(copy)))
            near.append((1000 * k, 1000 * k + c))
    text = dict(rows)
    kept = {r["doc_id"] for r in representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(1000 * k in kept for k in range(60))
    similar = [b for a, b in near if len(shingles(text[a]) & shingles(text[b])) >= 0.8 * len(shingles(text[a]) | shingles(text[b]))]
    assert len(similar) > 100 and sum(b in kept for b in similar) <= 0.05 * len(similar)


def test_ties_and_nulls_in_representatives(spark):
    rows = [(5, "same text here"), (5, "same text here"), (None, "same text here"), (None, "other words alone"), (None, "other words alone"), (7, None), (8, "")]
    got = sorted((tuple(r) for r in representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(5, "same text here"), (None, "other words alone"), (7, None)], key=str)


def test_isolated_pairs_by_band(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 9)))
    bands = {(0.65, 0.78): [], (0.8, 0.82): [], (0.82, 0.85): [], (0.85, 0.9): []}
    rows = []
    while min(map(len, bands.values())) < 60:
        base = [word() for _ in range(rng.randint(150, 400))]
        copy = list(base)
        for at in rng.sample(range(len(base)), rng.randint(len(base) // 100, len(base) // 20)):
            copy[at] = word()
        a, b = shingles(" ".join(base)), shingles(" ".join(copy))
        similarity = len(a & b) / len(a | b)
        for (low, high), own in bands.items():
            if low <= similarity < high and len(own) < 60:
                own.append(len(rows) + 1)
                rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    kept = {r["doc_id"] for r in representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {a for a, _ in rows if a % 2 == 0} <= kept
    stayed = {band: sum(b in kept for b in own) for band, own in bands.items()}
    assert stayed == {(0.65, 0.78): 60, (0.8, 0.82): 0, (0.82, 0.85): 0, (0.85, 0.9): 0}

import random
import re
from collections import defaultdict

import pytest

from gridloom.llm.substrings import LONGEST, _later_windows, dedup_substrings


def brute(rows, window):
    """Per (id, text): kept words and number of removed ones."""
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = defaultdict(lambda: float("inf"))
    for d, w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first[key], float("inf") if d is None else d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            f = first[tuple(w[i : i + window])]
            if f < (float("inf") if d is None else d):
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), [x for i, x in enumerate(w) if i not in gone]))
    return out


def got(docs, **kwargs):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], re.findall(r"[^\x20\x09-\x0D]+", r["kept_text"] or "")) for r in dedup_substrings(docs, **kwargs).collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    passages = [[rng.choice(vocabulary) for _ in range(n)] for n in (12, 25, 40, 90)]
    rows = []
    for d in rng.sample(range(1000), 80):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 30))]
            if words and rng.random() < 0.3:
                words[rng.randrange(len(words))] = "edit"
        rows.append((d, "  ".join(words) if d % 2 else "\n".join(words)))
    rows += [(2000 + i, t) for i, (_, t) in enumerate(rows[:10])]
    rows += [(3000, "x " * 700), (3001, "x " * 300), (3002, "x y " * 200)]
    return rows


@pytest.mark.parametrize("seed,window,gram,heavy", [(1, 10, 3, 20_000), (2, 10, 3, 0), (3, 20, 8, 1), (4, 5, 5, 2)])
def test_against_brute_force(spark, seed, window, gram, heavy):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(docs, window=window, gram=gram, heavy=heavy) == sorted(brute(rows, window), key=str)


def test_edge_cases(spark):
    long = " ".join(f"w{i % 977}" for i in range(60000))
    same = "a b c d e f g h"
    rows = [(1, None), (2, ""), (3, "short"), (4, same), (4, same), (None, same), (9, same + " é\u00a0ü"), (10, long), (11, long), (7, "x " + same)]
    docs = spark.createDataFrame([(d, t, "z", 0) for d, t in rows], "doc_id long, text string, removed string, start int")
    assert got(docs, window=6, gram=3) == sorted(brute(rows, 6), key=str)
    out = dedup_substrings(docs, window=6, gram=3)
    assert [c for c in out.columns] == ["doc_id", "text", "start", "n_words", "n_removed", "removed", "kept_text"]
    assert dedup_substrings(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        dedup_substrings(docs, window=3, gram=5)


def test_text_around_a_removed_span_is_kept(spark):
    docs = spark.createDataFrame([(1, "p q r s t"), (2, "Start\there.  p  q r s t then\n\nmore.")], "doc_id long, text string")
    r = {x["doc_id"]: x for x in dedup_substrings(docs, window=5, gram=2).collect()}
    assert r[1]["kept_text"] == "p q r s t" and r[2]["kept_text"] == "Start\there.\nthen\n\nmore."
    assert [tuple(s) for s in r[2]["removed"]] == [(2, 7)]


def test_a_bucket_at_its_limit_is_small():
    import tracemalloc

    words = [f"word{i}" for i in range(LONGEST + 49)]
    group = [(k, k, k, " ".join([str(k), *words[1:]]).encode()) for k in range(20_000 // LONGEST)]  # windows of a bucket that isn't split
    tracemalloc.start()
    found = _later_windows(group, 50)
    assert len(found) == (len(group) - 1) * (LONGEST - 1) and tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()

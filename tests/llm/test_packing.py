import zlib
from collections import defaultdict

import numpy as np
import pytest

from gridloom.llm.packing import Tokens, best_fit, going_on, pack, pieces_of, query

public_tokenizers = pytest.importorskip("public_tokenizers")


def check(rows, texts, capacity=2048, key="doc_id"):
    """Ids by the tokenizers library; pieces and places must agree with them."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*e.ids, 0] for d, e in zip(texts, t.encode_batch([x or "" for x in texts.values()], add_special_tokens=False), strict=True)}
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r[key]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for d, own in pieces.items():
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [r["start"] for r in own] == [sum(r["length"] for r in own[:k]) for k in range(len(own))]
        assert sum(r["length"] for r in own) == len(ids[d])
        assert len(own) == -(-len(ids[d]) // capacity) and all(r["length"] == capacity for r in own[1:])
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[d][r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for places in bins.values():
        places.sort()
        assert places[0][0] == 0 and sum(n for _, n in places) <= capacity
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False))
    return len(bins), -(-sum(map(len, ids.values())) // capacity)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    n, least = check(query(spark, sf).collect(), texts)
    assert n <= least * 1.1 + 1


def test_rounds_merge_partitions(spark):
    rows = [(i, "word " * (37 + 61 * i % 400)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    n, least = check(pack(docs, capacity=512, slack=4, fan_in=2).collect(), dict(rows), 512)
    assert n <= least * 1.1 + 1


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "a  b \n c\t d \n"), (5, "<|endoftext|> it's 12 x y z  "), (6, "é" * 5000), (7, "\n\n a\n b"), (8, "x " * 9000), (9, " lead"), (10, "a\x1c b \x85 c"), (11, "a b\n "), (12, "x <|endoftext|>y<|endoftext|> <|endoftext |> z"), (13, "nul \0 in \0it"), (14, "y" * 5000 + " z"), (15, "ſ ﬁ ¡­® \u3000 ١٢ I'LL don't\u2019s")]
    docs = spark.createDataFrame([(a, b, "s", "z") for a, b in rows], "doc_id long, text string, piece string, bin string")
    check(pack(docs).collect(), dict(rows))
    assert pack(docs.limit(0)).count() == 0
    twice = pack(docs.where("doc_id = 9").union(docs.where("doc_id = 9")), with_ids=True).collect()
    assert len(twice) == 2 and len({(r["sequence_id"], r["offset"]) for r in twice}) == 2
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in twice)


def test_best_fit_against_search():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 100, 400)
    bins, offsets, fills = best_fit(lengths, 100)
    want: list[int] = []
    for n in sorted(lengths.tolist(), reverse=True):
        fitting = [f for f in want if f + n <= 100]
        if fitting:
            want[want.index(max(fitting))] += n
        else:
            want.append(n)
    assert sorted(want) == sorted(fills.tolist())
    assert pieces_of(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)] and pieces_of(2048, 2048) == [(0, 2048)]


def test_special_strings_have_the_special_id(spark):
    rows = pack(spark.createDataFrame([(1, "a<|endoftext|> b")], "doc_id long, text string"), with_ids=True).collect()
    assert np.frombuffer(rows[0]["ids"], "<u4").tolist() == [64, 50256, 275, 0]


def test_what_goes_on_is_enough():
    rng = np.random.default_rng(2)
    for _ in range(20):  # three levels of two groups each, with and without the bound
        results = []
        groups = [rng.integers(1, 60, rng.integers(1, 80)) for _ in range(8)]
        for partners in (10**9, 2 * 31):
            level, final = [best_fit(g, 100)[2] for g in groups], 0
            while len(level) > 1:
                merged = []
                for a, b in zip(level[::2], level[1::2], strict=True):
                    on = [f[going_on(f, 100, 4, partners)] for f in (a, b)]
                    final += len(a) + len(b) - sum(map(len, on))
                    merged.append(best_fit(np.concatenate(on), 100)[2])
                level = merged
            results.append(final + len(level[0]))
        assert results[0] == results[1]
    fills = np.array([10, 60, 60, 60, 97, 50])
    assert going_on(fills, 100, 4, 2).tolist() == [True, True, True, False, False, True]


def test_partitions_cost_little(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "word " * int(n)) for i, n in enumerate(rng.integers(1, 1900, 4000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bins = {r["sequence_id"] for r in pack(docs).collect()}
    least = -(-sum(len(t) // 5 + 2 for _, t in rows) // 2048)
    assert len(bins) <= 1.015 * least  # a partition of 1,000 documents wastes some five sequences, whatever its size


def test_ids_against_the_library():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokens = Tokens(f.read(), public_tokenizers.PATTERN)
    assert tokens.fast

    @settings(max_examples=400, deadline=None)
    @given(st.text() | st.text("ab '\n\t.,1é<|endoftext>s", max_size=60))
    def same(text):
        assert np.frombuffer(tokens.encode(text), "<u4").tolist() == tokens.library.encode(text, add_special_tokens=False).ids

    same()
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        other = Tokens(f.read(), public_tokenizers.PATTERN)
    assert not other.fast and np.frombuffer(other.encode("Hello there"), "<u4").tolist() == other.library.encode("Hello there", add_special_tokens=False).ids

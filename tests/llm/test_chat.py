import hashlib

import pytest
import regex

from pyspark.sql import functions as F

from gridloom.llm.chat import AGAIN, END, NEW, SAYS, TOKEN, format_chats, query, read_turns


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_round_trip(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    chats = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        chats.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    got = {r["conv_id"]: r for r in query(spark, sf).collect()}
    assert set(got) == set(chats)
    for c, turns in chats.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == digest("".join(f"{r}\n{t}\n" for r, t in turns))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), digest(loss))
        assert got[c]["formatted_chars"] >= sum(len(r) + len(t) + len(NEW + SAYS + END) for r, t in turns)


def cost(role, text):
    return len(regex.findall(TOKEN, text)) + len(regex.findall(TOKEN, role)) + 4


def brute(turns, budget, history, block=4096):
    """Windows as (first, stop, repeated turn numbers)."""
    costs = [cost(*t) for t in turns]
    sys = costs[0] if turns[0][0] == "system" else 0
    out, start, used = [], 0, 0
    for i in range(len(turns)):
        n = 0 if i == 0 and sys else costs[i]
        if i and i % block == 0 or used and used + n > budget - sys - (history if out else 0):
            out.append((start, i))
            start, used = i, n
        else:
            used += n
    out.append((start, len(turns)))
    windows = []
    for a, b in out:
        back, room = a, history
        while back > 0 and costs[back - 1] <= room:
            back -= 1
            room -= costs[back]
        kept = list(range(back, a))
        windows.append((a, b, ([0] if sys and a and 0 not in kept else []) + kept))
    return windows


@pytest.mark.parametrize("budget,history,block", [(60, 20, 4096), (120, 0, 4096), (40, 200, 4096), (100000, 256, 4096), (50, 9, 10), (100000, 12, 13)])
def test_windows(spark, budget, history, block):
    import random

    rng = random.Random(budget)
    rows, chats = [], {}
    hostile = ["<|turn|>", "<~|end|>", "<|", "<~~|says|>", "$1 \\ <", "é" * 7, "\n"]
    for c in range(12):
        chats[c] = [("system", "be kind")] if c % 3 else []
        for i in range(rng.randint(1, 30)):
            chats[c].append((("user", "assistant")[i % 2], "".join(rng.choice(hostile) for _ in range(rng.randint(0, 12)))))
        rows += [(c, i, r, t) for i, (r, t) in enumerate(chats[c])]
    rng.shuffle(rows)
    out = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=budget, history=history, block=block)
    got = {}
    for r in out.withColumn("read", read_turns(out["formatted"])).collect():
        got.setdefault(r["conv_id"], {})[r["window"]] = r
    for c, turns in chats.items():
        want = brute(turns, budget, history, block)
        assert sorted(got[c]) == list(range(len(want)))
        for w, (a, b, old) in enumerate(want):
            r = got[c][w]
            assert [(x["role"], x["text"]) for x in r["read"]] == turns[a:b]
            assert (r["first_turn"], r["n_turns"], r["n_repeated"]) == (a, b - a, len(old))
            assert r["formatted"].count(AGAIN) == len(old) and r["tokens"] == sum(cost(*turns[i]) for i in [*old, *range(a, b)])
            # a turn that is too long has a window of its own, with the system turn
            assert b - a - (a == 0 and turns[0][0] == "system") == 1 or r["tokens"] <= budget
            masked = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
            assert len(masked) == sum(t[0] == "assistant" for t in turns[a:b])
            assert all("<|" not in m for m in masked)


def test_edge_cases(spark):
    rows = [(None, 0, "user", "x", 1), (None, None, None, None, 2), (1, 0, "user", "same", 3), (1, 0, "user", "same", 4), (2, 5, "assistant", "long " * 40000, 5)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window int")
    out = format_chats(turns)
    got = {(r["conv_id"], r["window"]): [tuple(x) for x in r["t"]] for r in out.withColumn("t", read_turns(out["formatted"])).collect()}
    assert got[None, 0] == [("", ""), ("user", "x")] and got[1, 0] == [("user", "same")] * 2
    assert got[2, 0] == [("assistant", "long " * 40000)]
    assert format_chats(turns.limit(0)).count() == 0


def test_a_column_of_token_counts(spark):
    turns = spark.range(9).selectExpr("1 as conv_id", "id as turn", "'user' as role", "'x' as text", "if(id = 4, 50, 30) as n")
    got = format_chats(turns, budget=100, history=30, tokens="n").orderBy("window").collect()
    assert [(r["first_turn"], r["n_turns"], r["n_repeated"], r["tokens"]) for r in got] == [(0, 3, 0, 90), (3, 1, 1, 60), (4, 1, 1, 80), (5, 2, 0, 60), (7, 2, 1, 90)]


def test_a_long_conversation(spark):
    """100,000 turns of 1 kB: no row holds more than a window, and no plan has Python in it."""
    text = F.concat(F.col("id").cast("string"), F.lit(" "), F.repeat(F.lit("word "), 200))
    turns = spark.range(100_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    out = format_chats(turns.repartition(4))
    plan = out._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "MapIn"))
    got = out.agg(F.sum("n_turns"), F.max("tokens"), F.max(F.length("formatted")), F.sum(F.size("loss_spans")), F.countDistinct("window"), F.count("*")).first()
    assert got[0] == 100_000 and got[1] <= 2048 and got[2] < 20_000 and got[3] == 50_000 and got[4] == got[5]

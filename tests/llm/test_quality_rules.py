import math
import random
import re
from collections import Counter

from gridloom.llm.quality_rules import common_words, features, judge, query

SF = "/root/testdata/sf0.001"


def brute_vocabulary(rows, n=30):
    """`rows` of (text, lang): the most frequent short words of each language with 20 documents."""
    counts, sizes = {}, Counter(lang for _, lang in rows if lang)
    for text, lang in rows:
        if sizes[lang] >= 20:
            found = {w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "") if len(w) <= 5}
            counts.setdefault(lang, Counter()).update(w for w in found if len(w) <= 5)
    return {lang: [w for w, k in sorted(c.items(), key=lambda x: (-x[1], x[0])) if k > 1][:n] for lang, c in counts.items()}


def brute(text, vocabulary=()):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = lambda p: len(re.findall(p, text))
    classes = [n("[a-z]"), n("[A-Z]"), n("[0-9]"), n(r"[#*$%&|<>]"), n(r"[^\x00-\x7F]"), len(text) - sum(map(len, words))]
    classes.append(max(0, len(text) - sum(classes)))
    forms = {f for w in vocabulary for f in (w, w[:1].upper() + w[1:], w.upper())}
    common = Counter(w.lower() for w in words if w in forms and w.lower() in vocabulary)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": n(r"[#*$%&|<>]"), "n_dup_lines": dup, "n_repeat_words": len(covered), "classes": classes, "common": common}


def distance(p, q):
    term = lambda a, b: a * math.log2(2 * a / (a + b)) if a > 0 else 0.0
    return math.sqrt(max(0.0, sum(term(a, b) + term(b, a) for a, b in zip(p, q, strict=True)) / 2))


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    own = brute_vocabulary([(r["text"], r["lang"]) for r in rows])
    vocabulary = {w for words in own.values() for w in words}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert common_words(docs) == own and len(vocabulary) > 60
    known = {r["doc_id"]: brute(r["text"], vocabulary) for r in rows}
    failed = {d: b["n_words"] < 50 or 100 * b["n_repeat_words"] > 50 * b["n_words"] for d, b in known.items()}
    sums = {}
    for r in rows:
        if not failed[r["doc_id"]] and r["lang"] in own:
            b = known[r["doc_id"]]
            c, w, n = sums.setdefault(r["lang"], ([0] * 7, Counter(), [0]))
            c[:] = [x + y for x, y in zip(c, b["classes"], strict=True)]
            w.update(b["common"])
            n[0] += b["n_words"]
    order = sorted(vocabulary)
    verdicts = {r["doc_id"]: r["kept"] for r in query(spark, SF).collect()}
    for r in judge(docs).collect():
        assert r["kept"] == verdicts[r["doc_id"]]
        b, d = known[r["doc_id"]], r["doc_id"]
        for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
            assert r[k] == b[k], (d, k)
        assert r["base_failed"] == failed[d]
        total = max(1, b["n_words"])
        limit = 0.1 + 2.8 / math.sqrt(total)
        near = []
        for c, w, n in sums.values():
            one = distance([x / max(1, sum(b["classes"])) for x in b["classes"]], [x / sum(c) for x in c])
            p, q = [b["common"][x] / total for x in order], [w[x] / n[0] for x in order]
            two = distance([*p, 1 - sum(p)], [*q, 1 - sum(q)])
            near.append((one / 0.25 + two / limit, one, two))
        _, one, two = min(near)
        assert abs(r["class_distance"] - one) < 1e-6 and abs(r["common_distance"] - two) < 1e-6
        assert r["kept"] == (not failed[d] and one <= 0.25 and (b["n_words"] < 100 or two <= limit))


def test_native_plan(spark):
    plan = query(spark, SF)._jdf.queryExecution().toString() + features(spark.read.parquet(f"{SF}/documents.parquet"), ["the", "der"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_edge_cases(spark):
    texts = [None, "", " \n\t", "one", "a b c a b c", "a b c b a b c b", "x\x0by\x0cz", "é ü ß\n\né ü ß", "w " * 50000, "a b\na b\n a b \n", "the THE The " * 40]
    rows = [(i, t, None if i % 2 else "en", "z") for i, t in enumerate([*texts, "one"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, words string")
    got = {r["id"]: r for r in features(docs, ["the", "ab"]).collect()}
    for i, t, *_ in rows:
        want = brute(t, {"the", "ab"})
        assert {k: got[i][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} == {k: want[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}, i
        assert {c["word"]: c["n"] for c in got[i]["common"]} == want["common"]
    assert judge(docs).count() == len(rows) and judge(docs.limit(0)).count() == 0


def test_every_labelled_language_has_a_reference(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioklmnst") for _ in range(rng.randint(6, 9)))
    text = lambda common: " ".join(rng.choice(common) if k % 2 else word() for k in range(150))
    fi, en = ["kala", "mina", "oli", "ja"], ["the", "cat", "is", "and"]
    rows = [(i, text(fi), "fi") for i in range(25)] + [(100 + i, text(en), "en") for i in range(26)]
    docs = spark.createDataFrame([*rows, (200, text(["x", "y"]), "rare"), (201, text(fi), None)], "doc_id long, text string, lang string")
    assert set(common_words(docs)) == {"fi", "en"} and set(common_words(docs, most_languages=1)) == {"en"}
    got = {r["doc_id"]: r["reference"] for r in judge(docs).collect()}
    assert {got[i] for i in range(25)} == {"fi"} == {got[201]} and {got[100 + i] for i in range(25)} == {"en"}

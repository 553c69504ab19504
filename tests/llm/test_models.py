import collections
import itertools
import re
import zlib

import numpy as np
import pytest

from gridloom.llm import language, quality
from gridloom.llm.common import held_out
from gridloom.llm.licenses import TEMPLATES, banded, query, scan

SF = "/root/testdata/sf0.01"


def test_language_on_held_out_rows(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in language.query(spark, SF).collect() if r["held_out"]]
    right = [r["lang_pred"] == lang[r["doc_id"]] for r in rows]
    assert len(rows) > 200 and np.mean(right) > 0.97 and np.mean([r["rejected"] for r in rows]) < 0.05
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges_and_rejection(spark):
    rows = [(i, "the cat and the dog were with them", "en") for i in range(9)] + [(20 + i, "der hund und die katze sind nicht hier", "de") for i in range(9)]
    odd = [(50, None, None), (51, "", "en"), (52, "12 $$ 34", "en"), (53, "Жили были старик со старухой", None), (53, "the dog", None), (None, "und die katze " * 20000, "de")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "'x' AS score")
    model = language.fit(docs.where("doc_id < 50"))
    got = {(r["doc_id"], r["text"]): r for r in language.identify(docs, model).collect()}
    assert got[50, None]["lang_pred"] == got[51, ""]["lang_pred"] == got[52, "12 $$ 34"]["lang_pred"] == "und" and got[50, None]["score"] == 0
    assert got[53, odd[3][1]]["rejected"] and got[53, odd[3][1]]["lang_pred"] in ("de", "en")
    assert got[53, "the dog"]["lang_pred"] == "en" and got[None, odd[5][1]]["lang_pred"] == "de"
    nothing = language.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def test_language_sample_is_bounded(spark):
    copies = spark.range(3000).selectExpr("if(id < 1500, null, 7L) as doc_id", "'the cat sat on the mat' as text", "'en' as lang")
    dirty = spark.range(900).selectExpr("id as doc_id", "concat('wort ', id) as text", "concat('x', id) as lang")
    model = language.fit(copies.union(dirty), per_language=5, most_languages=10)
    assert len(set(model.names)) == 10 and model.names.count("en") == 1  # all copies are one text
    many = language.fit(spark.range(500).selectExpr("id as doc_id", "concat('word ', id, ' and more') as text", "'en' as lang"), per_language=20)
    assert many.names == ["en"] * 4 and many.idf.min() > 0.9


def test_language_against_plain_python(spark):
    """Vectors, centroids' cosines and predictions of the whole query, recomputed one text at a time."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~held_out()))
    rows = {r["doc_id"]: r for r in language.query(spark, "/root/testdata/sf0.001").collect()}
    for r in docs.collect():
        raw, counts = bytes(int(language.FOLD[b]) for b in (r["text"] or "").encode()), np.zeros(model.dims)
        for n in (2, 3, 4):
            for i in range(len(raw) - n + 1):
                code = int.from_bytes(raw[i : i + n], "big") * 0x9E3779B97F4A7C15 + n * 0xD6E8FEB86659FD93
                counts[(code % 2**64) >> 52] += 1
        v = np.sqrt(counts) * model.idf
        cosine = model.centres @ (v / max(np.linalg.norm(v), 1e-300))
        got = rows[r["doc_id"]]
        if any(c.isalpha() for c in r["text"] or ""):
            assert got["lang_pred"] == model.names[int(np.argmax(cosine))] and abs(got["score"] - cosine.max()) < 1e-9
        else:
            assert (got["lang_pred"], got["score"]) == ("und", 0)
        assert got["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_gram_counts_against_plain_counting():
    docs = [b"", b"a", b"Ab", b"abcab1 c", "éa é".encode()]
    got = language.gram_counts(docs, 4096)
    for row, d in zip(got, docs, strict=True):
        folded = bytes(int(language.FOLD[b]) for b in d)
        assert row.sum() == sum(max(0, len(folded) - n + 1) for n in (2, 3, 4))
    assert (language.gram_counts([docs[3]], 4096)[0] == got[3]).all()


def test_quality_on_held_out_rows(spark):
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in quality.query(spark, SF).collect() if r["held_out"] and r["doc_id"] in label]
    right = [r["predicted"] == label[r["doc_id"]] for r in rows]
    assert len(rows) > 80 and np.mean(right) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)


def test_features_in_pieces():
    documents = [b"", b"one\ntwo", b"a b a b\n\nX!! Y", b"line\nline\nline", "é ü\n".encode() * 9]
    whole = quality.line_features(documents)
    for limit in (1, 10, 1 << 20):
        assert all(np.array_equal(a, b) for a, b in zip(quality.features_of(documents, limit), whole, strict=True))


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    sizes = [1, 4, 2, 6, 1]
    first = np.concatenate(([0], np.cumsum(sizes)))
    unary, trans = rng.normal(size=first[-1]) * 3, rng.normal(size=(2, 2)) * 2
    forward, backward = quality.Chains(first).messages(unary, trans)
    got = quality.sigmoid(forward + backward)
    for a, b in itertools.pairwise(first):
        total, good = 0.0, np.zeros(b - a)
        for y in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(unary[a + i] * v for i, v in enumerate(y)) + sum(trans[p, q] for p, q in itertools.pairwise(y)))
            total += w
            good += w * np.array(y)
        assert np.allclose(got[a:b], good / total)


def test_chain_learns_and_scores_edges(spark):
    rows = [(i, "Good words here.\nAnother good line.", 1) for i in range(20)] + [(40 + i, "$$$ ### $$$\n!!! %%%", 0) for i in range(20)]
    docs = spark.createDataFrame([(d, t, "q") for d, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows] + [(0, 7), (None, 1), (1, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    odd = spark.createDataFrame([(100, None, "q"), (101, "", "q"), (102, "\n" * 3000, "q"), (None, "Good words. " * 20000, "q"), (103, "### $$$", "q"), (103, "### $$$", "q")], docs.schema)
    got = [tuple(r) for r in quality.classify(docs.union(odd), model, keep=["doc_id"]).collect()]
    assert len(got) == 46 and all(0 <= s <= 1 for _, s, _ in got)
    assert all(p == (d < 40) for d, _, p in got if d is not None and d < 100)
    assert [s for d, s, _ in got if d == 100] == [s for d, s, _ in got if d == 101] and [p for d, _, p in got if d == 103] == [0, 0]
    one = quality.fit(docs, labels.where("quality = 1"))
    assert {r["predicted"] for r in quality.classify(docs, one).collect()} == {1}
    assert {r["score"] for r in quality.classify(docs, quality.fit(docs, labels.limit(0)), keep=["doc_id"]).collect()} == {0.5}
    assert quality.classify(docs.limit(0), model).count() == 0


def test_lines_have_labels_of_their_own():
    """Document labels alone are given; junk lines inside a good text are bad, and good lines inside junk are good."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("etaoinshr"), rng.integers(2, 8)))
    good = lambda: " ".join([word() for _ in range(12)]).capitalize() + "."
    bad = lambda: " ".join([word().upper() + "!!" for _ in range(9)])
    documents, labels = [], []
    for i in range(160):
        y = i % 2
        lines = [(good if y else bad)() for _ in range(rng.integers(1, 9))]
        if i % 5 == 0 and len(lines) > 4:  # some labelled documents hold lines of the other kind
            lines[2] = (bad if y else good)()
        documents.append("\n".join(lines).encode())
        labels.append(y)
    model = quality.fit_chain(documents, np.array(labels))
    kinds = [1, 1, 1, 0, 0, 1, 1, 0, 0, 0, 1]
    probability, _, _ = model.lines(["\n".join((good if k else bad)() for k in kinds).encode()])
    assert ((probability > 0.5) == np.array(kinds)).all()
    pure = model.score([good().encode(), bad().encode(), b"\n".join([good().encode()] * 3)])
    assert pure[0] > 0.5 > pure[1] and pure[2] > 0.5


def test_quality_query_against_plain_python(spark):
    """Scores of the whole query, by marginals of one text at a time."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet").where(~held_out()))
    got = {r["doc_id"]: r for r in quality.query(spark, sf).collect()}
    for r in docs.select("doc_id", "text").collect():
        features, size, _ = quality.line_features([(r["text"] or "").encode()])
        unary, n = features @ model.weights, len(size)
        ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
        for t in range(n):
            own = np.array([0.0, unary[t]])
            ahead[t] = own if not t else own + [np.logaddexp.reduce(ahead[t - 1] + model.trans[:, k]) for k in (0, 1)]
        for t in range(n - 2, -1, -1):
            back[t] = [np.logaddexp.reduce(model.trans[k] + np.array([0.0, unary[t + 1]]) + back[t + 1]) for k in (0, 1)]
        both = ahead + back
        probability = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -40, 40)))
        score = (probability * (size + 1)).sum() / (size + 1).sum()
        assert abs(got[r["doc_id"]]["score"] - score) < 1e-9 and got[r["doc_id"]]["predicted"] == (score >= 0.5)


def test_quality_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit_chain", lambda documents, labels: seen.append((documents, labels)))
    docs = spark.range(20_000).selectExpr("1L as doc_id", "'copy' as text").union(spark.range(2, 400).selectExpr("id as doc_id", "concat('text ', id) as text"))
    docs = docs.union(spark.range(1).selectExpr("500L as doc_id", "repeat('long ', 9000) as text"))
    labels = spark.range(1, 600).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    quality.fit(docs, labels.union(labels), sample=10)
    quality.fit(docs.where("doc_id in (1, 2)"), labels, sample=1000)
    assert [int((seen[0][1] == y).sum()) for y in (0, 1)] == [10, 10] and len(seen[1][0]) == 2 and max(map(len, seen[0][0])) < 20_000


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def lcs_beside(a, b, start, width):
    """Most equal words of a and b in order, of places within `width` of the diagonal from `start` on."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] and abs(j - start - i) <= width else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_alignment_against_full_table():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = [bytes([x]) for x in rng.integers(97, 101, 12)], [bytes([x]) for x in rng.integers(97, 101, 12)]
        pairs = banded(a, b, 0, 12)
        assert len(pairs) == lcs(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs))


def test_license_scan(spark):
    mit = TEMPLATES["MIT"]
    with pytest.raises(ValueError):
        scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"), most_template_words=100)
    edited = mit.replace("restriction", "limits").replace("copies of the Software", "copies of this new Software", 1)
    rows = [(1, "Intro words. " + mit + " Tail"), (2, "x y " * 50 + edited), (3, "Released under the MIT License. A b c Released under the MIT license"), (4, None), (5, ""), (6, "the software is good"), (6, "w " * 60000 + "Licensed under CC BY-NC 4.0."), (None, mit[:300])]
    docs = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, licenses string")
    got = [(r["doc_id"], [(m["template"], m["coverage"], m["start"]) for m in r["licenses"]]) for r in scan(docs).collect()]
    assert got[0][1] == [("MIT", 1.0, 2)]
    assert [m[0] for m in got[1][1]] == ["MIT"] and 0.95 < got[1][1][0][1] < 1 and got[1][1][0][2] == 100
    assert [(m[0], m[2]) for m in got[2][1]] == [("MIT-line", 0), ("MIT-line", 8)]
    assert [g[1] for g in got[3:6]] == [[], [], []] and [m[0] for m in got[6][1]] == ["CC-BY-NC-4.0-line"] and got[7][1] == []
    assert scan(docs.limit(0)).count() == 0


def test_license_query_against_search(spark):
    """The whole query against a search that tries every place of every text, without fingerprints or a band."""
    sf = "/root/testdata/sf0.001"
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    templates = {n: split(t) for n, t in TEMPLATES.items()}
    planted = [(10_000 + i, " ".join(["lead", *w[: len(w) // 2], "EXTRA", *w[len(w) // 2 + 1 :], "tail"])) for i, w in enumerate(templates.values())]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()] + planted
    out = scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), keep=["doc_id"])
    got = {r["doc_id"]: r["licenses"] for r in out.collect()}
    n_found = 0
    for d, text in rows:
        words = split(text)
        places = collections.defaultdict(set)
        for i, w in enumerate(words):
            places[w].add(i)
        for name, t in templates.items():
            reported = [m for m in got[d] if m["template"] == name]
            for m in reported:  # what is reported is there, and no place is counted twice
                inside = words[m["start"] : m["stop"]]
                assert m["matched"] == sum(s["stop"] - s["start"] for s in m["spans"]) <= lcs(t, inside) and m["coverage"] == m["matched"] / len(t) >= 0.8
            # every place where eight tenths of its words are in order along a diagonal, with five of them in a row
            width, fives = (3 if len(t) >= 30 else 0), {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
            hits = np.zeros(len(words) + 1, int)
            for w in set(t):
                hits[list(places[w])] = 1
            total = np.concatenate(([0], np.cumsum(hits)))
            for a in range(max(1, len(words) - len(t) + 1)):
                low, high = max(0, a - width), min(len(words), a + len(t) + width)
                if not words or words[a] != t[0] or total[high] - total[low] < 0.8 * len(t) or not any(tuple(words[i : i + 5]) in fives for i in range(low, high - 4)):
                    continue
                best = lcs_beside(t, words[low:high], a - low, width)
                if best >= 0.8 * len(t):
                    n_found += 1
                    assert max((m["matched"] for m in reported), default=0) >= best, (d, name)
    assert n_found >= len(templates)
    mine = sorted((r["doc_id"], r["template"], r["matched"], r["start"], r["stop"]) for r in query(spark, sf).collect())
    assert mine == sorted((d, m["template"], m["matched"], m["start"], m["stop"]) for d, ms in got.items() for m in ms if d < 10_000)

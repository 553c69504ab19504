"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is labelled good or bad from features of the line itself and of its neighbours. Forward-backward
gives each line's marginal, and a text's score is the mean of the marginals weighted by line length.

Labels are of documents, but lines have labels of their own. Fitting starts with each line's label from its document,
adds splices (a bad document's lines inside a good one's, so chains that change their label are seen), and then
re-estimates: lines that the model is sure are of the other kind change their label, the surest first, up to less
than half of a document's length. The model is fitted again with those.

Fitting reads a bounded sample: at most `sample` labelled documents of each label (by a hash of id and text), of at most
`fit_lines` lines and `fit_bytes` bytes each, equal texts of one id once. Scoring reads whole texts.

Features come from byte classes and word hashes of a whole chunk of texts at once; the recursions step
through lines for all texts of a chunk together.

Defined results: a null or empty text is one empty line and gets that line's score. Labels other than 0 and
1, and rows without text or id, are not learned from; a repeated row of labels counts once, and an id with both labels
gives an example of each. If a label is missing, all scores are the share of the
other. Repeated rows give repeated results. Input columns with the name of an output column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import CHUNK_BYTES, Rolling, Words, chunks, held_out, others, quoted, spread, table, texts

ADDED = ["score", "predicted"]

#: Byte classes, in the order of their columns.
CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "blank": b" \t\r\x0b\x0c", "symbol": b"#*$%&<>~^=+_@\\", "bar": b"|", "shout": b"!?", "stop": b".,;:'\"()-"}


def line_features(documents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, its length in bytes, and the first line of each text (with an end mark)."""
    blob = b"\n".join(documents) + b"\n"
    raw = np.frombuffer(blob, dtype=np.uint8)
    stop = np.flatnonzero(raw == 10)
    start = np.concatenate(([0], stop[:-1] + 1))
    size = stop - start
    ends = np.cumsum([len(d) + 1 for d in documents]) - 1
    first = np.concatenate(([0], np.searchsorted(stop, ends) + 1))
    text_of = np.repeat(np.arange(len(documents)), np.diff(first))
    some = np.maximum(size, 1)

    def per_line(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[stop] - total[start]

    counts = {}
    for name, members in CLASSES.items():
        known = np.zeros(256, dtype=bool)
        known[list(members)] = True
        counts[name] = per_line(known[raw])
    wide = per_line(raw >= 0xC0)
    letters = np.maximum(counts["lower"] + counts["upper"] + wide, 1)

    words = Words([blob[:-1]])
    line_of = np.searchsorted(stop, words.raw_begin)
    n_words = np.bincount(line_of, minlength=len(stop)) if len(words) else np.zeros(len(stop), int)
    some_words = np.maximum(n_words, 1)
    same, distinct = np.zeros(len(stop)), np.zeros(len(stop))
    if len(words):
        h = Rolling(words.buffer).spans(words.begin, words.end)
        repeated = (h[1:] == h[:-1]) & (line_of[1:] == line_of[:-1])
        same = np.bincount(line_of[1:][repeated], minlength=len(stop))
        order = np.lexsort((h, line_of))
        new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (line_of[order][1:] != line_of[order][:-1])))
        distinct = np.bincount(line_of[order][new], minlength=len(stop))

    lines = Rolling(raw).spans(start, stop)
    order = np.lexsort((np.arange(len(stop)), lines, text_of))
    again = np.zeros(len(stop))
    again[order[1:]] = (lines[order][1:] == lines[order][:-1]) & (text_of[order][1:] == text_of[order][:-1])

    own = np.stack([
        np.log1p(size) / 6, size == 0, counts["upper"] / letters, counts["digit"] / some, counts["symbol"] / some * 4, counts["bar"] / some * 8,
        counts["shout"] / some * 4, counts["stop"] / some * 4, counts["blank"] / some, wide / some, np.log1p(n_words) / 4,
        size / some_words / 10, same / some_words, 1 - distinct / some_words, again * (size > 0), np.log1p(np.diff(first)[text_of]) / 4,
    ], axis=1)
    head, tail = np.zeros(len(stop), bool), np.zeros(len(stop), bool)
    head[first[:-1]] = True
    tail[first[1:] - 1] = True
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[head], after[tail] = 0, 0
    return np.concatenate([np.ones((len(stop), 1)), head[:, None], tail[:, None], own, before, after], axis=1), size, first


class Chains:
    """Recursions over chains of different lengths, all texts one step at a time."""

    def __init__(self, first: np.ndarray):
        self.first, self.size = first[:-1], np.diff(first)
        self.order = np.argsort(-self.size, kind="stable")
        sizes = self.size[self.order]
        self.active = [int(n) for n in np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), side="left")]
        self.begin = self.first[self.order]

    def messages(self, unary: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of good over bad: forward with each line's own score, and backward without it."""
        forward, backward = np.array(unary), np.zeros(len(unary))
        (t00, t01), (t10, t11) = trans
        for t in range(1, len(self.active)):
            at = self.begin[: self.active[t]] + t
            a = forward[at - 1]
            forward[at] = unary[at] + np.logaddexp(t01, a + t11) - np.logaddexp(t00, a + t10)
        for t in range(len(self.active) - 1, 0, -1):
            at = self.begin[: self.active[t]] + t
            b = unary[at] + backward[at]
            backward[at - 1] = np.logaddexp(t10, b + t11) - np.logaddexp(t00, b + t01)
        return forward, backward


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    def __init__(self, weights: np.ndarray, trans: np.ndarray, constant: float | None = None):
        self.weights, self.trans, self.constant = weights, trans, constant

    def lines(self, documents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every line's probability to be good and length, and the first line of each text."""
        features, size, first = line_features(documents)
        forward, backward = Chains(first).messages(features @ self.weights, self.trans)
        return sigmoid(forward + backward), size, first

    def score(self, documents: list[bytes]) -> np.ndarray:
        if not documents:
            return np.zeros(0)
        if self.constant is not None:
            return np.full(len(documents), self.constant)
        good, size, first = self.lines(documents)
        weight = size + 1
        return np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])


def spliced(documents: list[bytes], labels: np.ndarray) -> list[tuple[bytes, np.ndarray]]:
    """Good documents with the lines of a bad one between theirs, and the labels of the lines."""
    out = []
    for g, b in zip(np.flatnonzero(labels == 1).tolist(), np.flatnonzero(labels == 0).tolist(), strict=False):
        good, bad = documents[g].split(b"\n"), documents[b].split(b"\n")
        half = (len(good) + len(out) % 2) // 2  # of a single line, before and after it in turn
        out.append((b"\n".join([*good[:half], *bad, *good[half:]]), np.concatenate([np.ones(half), np.zeros(len(bad)), np.ones(len(good) - half)])))
    return out


def reestimated(y: np.ndarray, good: np.ndarray, size: np.ndarray, first: np.ndarray, sure: float) -> np.ndarray:
    """Line labels `y` of documents, changed where `good` is surely the other, for less than half of each document's length."""
    out = y.copy()
    other = np.where(y == 1, 1 - good, good)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        order = a + np.argsort(-other[a:b], kind="stable")
        weight = np.cumsum(size[order] + 1)
        out[order[(other[order] >= sure) & (2 * weight < weight[-1])]] = 1 - y[a]
    return out


def features_of(documents: list[bytes], limit: int = CHUNK_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`line_features` of any number of texts, some at a time, since it needs many times the texts' bytes."""
    parts, start, size = [], 0, 0
    for k, d in enumerate(documents, 1):
        size += len(d)
        if size >= limit or k == len(documents):
            parts.append(line_features(documents[start:k]))
            start, size = k, 0
    ends = np.cumsum([p[2][-1] for p in parts])
    first = np.concatenate([[0], *[p[2][1:] + end - p[2][-1] for p, end in zip(parts, ends, strict=True)]])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), first


def fit_chain(documents: list[bytes], labels: np.ndarray, rounds: int = 150, sure: float = 0.8) -> Model:
    """A chain fitted to documents of known labels, whose lines' labels are estimated."""
    joined = spliced(documents, labels)
    features, size, first = features_of([*documents, *[d for d, _ in joined]])
    n = int(first[len(documents)])
    y = np.concatenate([np.repeat(labels.astype(float), np.diff(first[: len(documents) + 1])), *[x for _, x in joined]])
    chains, values = Chains(first), np.zeros(features.shape[1] + 4)
    for _ in range(2):
        values = maximised(features, chains, first, y, values, rounds)
        forward, backward = chains.messages(features @ values[:-4], values[-4:].reshape(2, 2))
        y[:n] = reestimated(np.repeat(labels.astype(float), np.diff(first[: len(documents) + 1])), sigmoid(forward + backward)[:n], size[:n], first[: len(documents) + 1], sure)
    return Model(values[:-4], values[-4:].reshape(2, 2))


def maximised(features: np.ndarray, chains: Chains, first: np.ndarray, y: np.ndarray, values: np.ndarray, rounds: int, rate: float = 0.15, decay: float = 2e-3) -> np.ndarray:
    """Weights and transitions of maximum likelihood by Adam; lines of both labels weigh the same in sum, and so does every text."""
    sizes = np.diff(first)
    weight = np.repeat(1 / sizes, sizes)
    weight *= np.where(y == 1, 0.5 / max(1e-9, weight[y == 1].sum()), 0.5 / max(1e-9, weight[y == 0].sum()))
    tail = np.zeros(len(y), bool)
    tail[first[1:] - 1] = True
    here = np.flatnonzero(~tail)
    now, next_ = y[here], y[here + 1]
    seen = np.stack([(1 - now) * (1 - next_), (1 - now) * next_, now * (1 - next_), now * next_])
    mean, square = 0.0, 0.0
    for step in range(1, rounds + 1):
        w, trans = values[:-4], values[-4:].reshape(2, 2)
        unary = features @ w
        forward, backward = chains.messages(unary, trans)
        grad = np.concatenate([features.T @ (weight * (y - sigmoid(forward + backward))), np.zeros(4)])
        a, b = forward[here], (unary + backward)[here + 1]
        pair = np.stack([np.full(len(here), trans[0, 0]), b + trans[0, 1], a + trans[1, 0], a + b + trans[1, 1]])
        pair = np.exp(pair - pair.max(axis=0, initial=-np.inf))
        pair /= pair.sum(axis=0)
        grad[-4:] = ((seen - pair) * weight[here]).sum(axis=1)
        grad -= decay * values
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        values = values + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6) * (1 - step / (rounds + 1))
    return values


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", id: str = "doc_id", sample: int = 1500, fit_lines: int = 200, fit_bytes: int = 20_000) -> Model:
    """A model from at most `sample` labelled documents of each label, each of at most `fit_lines` lines and `fit_bytes` bytes."""
    name = lambda c: F.col(f"`{c}`")
    known = labels.where(name(label).isin(0, 1) & name(id).isNotNull()).select(name(id).alias("id"), name(label).cast("int").alias("label")).distinct()
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows at most
    if len(counts) < 2:
        return Model(np.zeros(0), np.zeros((2, 2)), 0.5 if not counts else float(next(iter(counts))))
    # twice as many ids, since some have no text or a long one; then a rank bounds ids, and another documents
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 2 * sample / n)))])
    hashed = known.withColumn("h", F.xxhash64(F.col("id").cast("string"))).where(F.pmod("h", F.lit(1_000_003)) < share[F.col("label")] * 1_000_003)
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("h", "id")))
    chosen = ranked(hashed).where(F.col("rank") <= 3 * sample).select("id", "label")
    body = docs.where(name(text).isNotNull()).select(name(id).alias("id"), name(text).cast("string").alias("text"))
    short = (F.octet_length("text") <= fit_bytes) & (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) < fit_lines)
    # at most six times `sample` ids are broadcast
    rows = body.join(F.broadcast(chosen), "id").where(short).withColumn("h", F.xxhash64(F.col("id").cast("string"), "text")).dropDuplicates(["label", "h"])
    got = ranked(rows).where(F.col("rank") <= sample).select("label", "text").toArrow().sort_by([("label", "ascending"), ("text", "ascending")])
    if len(set(got.column("label").to_pylist())) < 2:
        return Model(np.zeros(0), np.zeros((2, 2)), 0.5)
    return fit_chain([x.encode() for x in got.column("text").to_pylist()], got.column("label").to_numpy())


def classify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """All rows, of them the columns `keep` or else all, with `score` and `predicted` (1 from 0.5 on)."""
    keep = others(docs, ADDED) if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.trans, model.constant))  # some hundred numbers

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        model = Model(*shared.value)
        parts = [model.score(texts(p)) for p in chunks([pa.RecordBatch.from_arrays([column], ["text"])], "text")]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    scored = docs.select(*quoted(keep), score(F.col(f"`{text}`").cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return classify(docs, model, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")

"""Language identification by nearest centroid.

A text is a vector of byte n-gram counts (two to four bytes, ASCII letters lower-cased, other ASCII as one
blank), hashed into `dims`, weighted by inverse document frequency and normalised. Each language has several
centroids, found by spherical k-means over a bounded sample of labelled rows. The prediction is the language
of the centroid with the largest cosine. A text farther from it than nearly all training texts of that
centroid were is marked as rejected.

Fitting reads at most `per_language` labelled rows of each of the `most_languages` most frequent labels, chosen by a
hash of id and text, so rows of any partition can be in it, and equal rows are one. A language's rows are clustered in
one task; only its centroids come to the driver.

Defined results: a null text or one without a letter is `und` with score 0 and rejected. Rows without a
label or id are predicted but never learned from. If nothing can be learned, all predictions are `und`.
Repeated rows give repeated results. Input columns with the name of an output column are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import chunks, held_out, others, quoted, saved, spread, table, texts
from gridloom.plans.scratch import dropped

ADDED = ["lang_pred", "score", "rejected"]
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")

FOLD = np.arange(256, dtype=np.uint64)
FOLD[:128] = 32
FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def gram_counts(documents: list[bytes], dims: int) -> np.ndarray:
    """Hashed counts of 2-, 3- and 4-grams of bytes, a row for each text. Grams don't cross texts."""
    blob = np.frombuffer(b"\x00".join(documents) + b"\x00", dtype=np.uint8)
    size = np.array([len(d) + 1 for d in documents])
    document = np.repeat(np.arange(len(documents)), size)
    ends = np.cumsum(size) - 1  # the separators
    left = np.repeat(ends, size) - np.arange(len(blob))  # bytes before the separator
    x = FOLD[blob]
    total = np.zeros(len(documents) * dims)
    shift = np.uint64(64 - int(dims).bit_length() + 1)
    code = x
    for n in (2, 3, 4):
        code = code[:-1] * np.uint64(256) + x[n - 1 :]
        if not len(code):
            break
        inside = left[: len(code)] >= n
        h = (code[inside] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n * 0xD6E8FEB86659FD93 % (1 << 64))) >> shift
        total += np.bincount(document[: len(code)][inside] * dims + h.astype(np.int64), minlength=len(total))
    return total.reshape(len(documents), dims)


def normalised(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm == 0, 1, norm)


def spherical_means(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of unit vectors by cosine; seeds are spread out greedily, so the result is deterministic."""
    centres = [rows.mean(axis=0)]
    closest = rows @ normalised(centres[0][None])[0]
    while len(centres) < min(k, len(rows)):
        centres.append(rows[int(np.argmin(closest))])
        closest = np.maximum(closest, rows @ centres[-1])
    centres = normalised(np.array(centres))
    for _ in range(rounds):
        own = np.argmax(rows @ centres.T, axis=1)
        centres = normalised(np.array([rows[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))]))
    return centres


class Model:
    def __init__(self, dims: int, idf: np.ndarray, centres: np.ndarray, names: list[str], radius: np.ndarray):
        self.dims, self.idf, self.centres, self.names, self.radius = dims, idf, centres, names, radius

    def vectors(self, documents: list[bytes]) -> np.ndarray:
        return normalised(np.sqrt(gram_counts(documents, self.dims)) * self.idf)

    def predict(self, documents: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        lettered = np.array([bool(LETTER.search(d.decode("utf-8", "replace"))) for d in documents], dtype=bool)
        if not self.names or not documents:
            return [UNKNOWN] * len(documents), np.zeros(len(documents)), np.ones(len(documents), bool)
        cosine = self.vectors(documents) @ self.centres.T
        best = np.argmax(cosine, axis=1)
        score = np.where(lettered, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0)
        names = [self.names[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
        return names, score, ~lettered | (1 - score > self.radius[best])


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", id: str = "doc_id", per_language: int = 400, clusters: int = 4, dims: int = 4096, most_languages: int = 256) -> Model:
    """Centroids from a sample of at most `per_language` rows of each label."""
    name = lambda c: F.col(f"`{c}`")
    rows = labelled.where(name(label).isNotNull() & name(text).isNotNull() & name(id).isNotNull())
    rows = rows.select(name(label).cast("string").alias("label"), name(text).cast("string").alias("text"), F.xxhash64(name(id).cast("string"), name(text).cast("string")).alias("h"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").agg(F.count("*").alias("rows"), F.approx_count_distinct("h").alias("count")).orderBy(F.desc("rows"), "label").limit(most_languages).collect()}
    if not counts:
        return Model(dims, np.ones(dims), np.zeros((0, dims)), [], np.zeros(0))
    # a share that gives some more than wanted, of which a rank keeps the first
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 1.5 * per_language / n)))])
    chosen = rows.where(F.pmod("h", F.lit(1_000_003)) < share[F.col("label")] * 1_000_003).dropDuplicates(["label", "h"])
    rank = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    chosen = chosen.withColumn("rank", rank).where(F.col("rank") <= per_language).select("label", "h", "text")

    def sparse(batches):
        for part in chunks(batches, "text", row=dims * 8):
            counted = gram_counts(texts(part, "text"), dims)
            at = [np.flatnonzero(c) for c in counted]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(at, pa.list_(pa.int32())), pa.array([c[i].astype(np.float32) for c, i in zip(counted, at, strict=True)], pa.list_(pa.float32()))], ["label", "h", "at", "n"])

    sample = saved(chosen.mapInArrow(sparse, "label string, h long, at array<int>, n array<float>"))
    idf = np.full(dims, np.log(1 + sample.count()) + 1)
    for r in sample.select(F.explode("at").alias("at")).groupBy("at").count().collect():  # at most `dims` rows
        idf[r["at"]] -= np.log(1 + r["count"])

    def centroids(table: pa.Table) -> pa.Table:
        table = table.sort_by("h")
        counted = np.zeros((table.num_rows, dims))
        for i, (at, n) in enumerate(zip(table.column("at").to_pylist(), table.column("n").to_pylist(), strict=True)):
            counted[i, at] = n
        own = normalised(np.sqrt(counted) * idf)
        found = spherical_means(own, clusters)
        cosine = own @ found.T
        mine = np.argmax(cosine, axis=1)
        far = [1 - cosine[mine == c, c] for c in range(len(found))]
        radius = [min(1.0, float(np.quantile(f, 0.99)) * 1.1) if len(f) else 0.0 for f in far]
        return pa.table({"label": pa.array([table.column("label")[0].as_py()] * len(found), pa.string()), "centre": pa.array(list(found), pa.list_(pa.float64())), "radius": pa.array(radius, pa.float64()), "k": pa.array(range(len(found)), pa.int32())})

    # at most `most_languages` times `clusters` rows of `dims` numbers
    found = sample.groupBy("label").applyInArrow(centroids, "label string, centre array<double>, radius double, k int").toArrow().sort_by([("label", "ascending"), ("k", "ascending")])
    dropped(sample)
    return Model(dims, idf, np.array(found.column("centre").to_pylist()), found.column("label").to_pylist(), found.column("radius").to_numpy())


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """All rows, of them the columns `keep` or else all, with `lang_pred`, `score` and `rejected`."""
    keep = others(docs, ADDED) if keep is None else keep
    # dims times centroids, whatever the input; plain values, since executors need not have this package
    shared = docs.sparkSession.sparkContext.broadcast((model.dims, model.idf, model.centres, model.names, model.radius))

    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def predict(column: pa.Array) -> pa.Array:
        out, model = [], Model(*shared.value)
        for part in chunks([pa.RecordBatch.from_arrays([column], ["text"])], "text", row=model.dims * 8):
            names, score, rejected = model.predict(texts(part))
            out.append(pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ADDED))
        return pa.concat_arrays(out) if out else pa.array([], pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]))

    return docs.select(*quoted(keep), predict(F.col(f"`{text}`").cast("string")).alias("_found")).select(*quoted(keep), "_found.*")


def query(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id")
    model = fit(docs.where(~held_out()))
    return identify(docs, model, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")

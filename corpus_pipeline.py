"""Corpus pipeline: quality classifier, near-dedup, substring dedup, decontamination, packing.

`STAGES` lists `(name, function)`; each takes `(spark, docs, sf_dir)`. All but the last return the columns of
`documents` for the documents they keep. `run` writes each stage as Parquet in the shared folder and reads it
again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontamination, packing, quality, simhash, substrings
from gridloom.llm.common import held_out, saved, shielded, spread, table
from gridloom.plans.scratch import TABLES, released


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model, fitted on labels that aren't held out, calls good."""
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    docs, back = shielded(docs, quality.ADDED)
    return quality.classify(docs, model).where("predicted = 1").select(*back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with a 5-word shingle Jaccard of 0.8 or more."""
    return simhash.representatives(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 50-word windows that a document with a smaller id has too. No row goes."""
    docs, back = shielded(docs, [*substrings.ADDED, "id", "text_key", "spans"])
    cut = substrings.dedup_substrings(docs).withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast("long"))
    return cut.select(*back)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth is in a benchmark passage."""
    docs, back = shielded(docs, decontamination.ADDED)
    judged = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return judged.where(~F.col("contaminated")).select(*back)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier is a fitted model, so SQL can't express the rows; they are tested stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's own tables, and those of the stage before, are deleted once it is written."""
    before = frozenset(TABLES)
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), "snappy")
        released(spark, before, (docs,))
    return docs

"""The corpus pipeline: stages, each of which calls one operator of ``palimpsest.llm``.

A stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the
next one's ``docs``.  Each starts by letting go of what the one before it shuffled or stashed.  All stages but the last keep the columns of ``documents``.  Rows with a
null doc_id are rejected by the first stage; a null text counts as empty, and fails there too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, packing, quality, secret_scan, simhash, similar
from palimpsest.llm.common import load, release, stash, without


#: Names of columns that joins add and drop, unlike any that a table is likely to have.
COPY, ROW = "__near_duplicates_copy", "__near_duplicates_row"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or are outliers of their language and source, go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays.

    Components of linked fingerprints go first; then, of the rest, components of texts whose
    five-word shingles have a similarity of 0.8 or more, most of which are further apart than
    fingerprints can link.  Empty texts are copies of each other; an empty table stays empty.
    """
    release(spark)
    found = simhash.near_duplicates(docs)
    copies = stash(found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(COPY)), "copies")
    del found
    release(spark)
    kept = without(docs.where(F.col("doc_id").cast("long").isNotNull()), "doc_id", copies)
    if not docs.groupBy("doc_id").count().where(F.col("count") > 1).isEmpty():
        # Rows that share an id are one document; the greatest text stands for it, as in the operator.
        row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        best = kept.groupBy("doc_id").agg(F.max_by(row, F.coalesce("text", F.lit(""))).alias(ROW))
        kept = best.select(f"{ROW}.*")
    kept = stash(kept, "distinct")
    del copies
    release(spark)
    copies = similar.copies(kept).select(F.col("doc_id").alias(COPY))
    return kept.join(copies, F.col("doc_id").cast("long") == F.col(COPY), "left_anti")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word hit by a benchmark window go; an empty benchmark hits nothing."""
    release(spark)
    return decontaminate.remove_documents(docs, load(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a placeholder; every document stays."""
    release(spark)
    return secret_scan.redact(docs)


def length_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's bucket, batch and slot."""
    release(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("packing", length_packing),
]

#: The first stage's robust estimates and the fourth's trained models are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

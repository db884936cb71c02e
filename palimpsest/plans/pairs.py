"""Pairs of an old and a new version of byte objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What the derived new version is, by doc_id modulo eight.
EDITS = ("unchanged", "scattered", "shifted", "unrelated", "truncated", "run", "zero", "appended")


def derived_pairs(documents: DataFrame) -> DataFrame:
    """``pair_id, edit, source binary, target binary`` from ``documents(doc_id, text)``.

    The new version is made from the old by one of the edits above; an unrelated one is the
    text of the next id (of the first where there is none).
    """
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    other = docs.where(F.pmod("doc_id", F.lit(8)).isin(4)).select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next"))
    first = docs.agg(F.min_by("text", "doc_id")).first()[0]
    edit = F.pmod("doc_id", F.lit(8)).cast("int")
    n = F.octet_length("text")
    target = (
        F.when(edit == 0, F.col("text").cast("binary"))
        .when(edit == 1, F.replace("text", F.lit("a"), F.lit("b")).cast("binary"))
        .when(edit == 2, F.concat(F.lit("INSERTED-"), "text").cast("binary"))
        .when(edit == 3, F.coalesce("next", F.lit(first)).cast("binary"))
        .when(edit == 4, F.expr("left(text, length(text) div 2)").cast("binary"))
        .when(edit == 5, F.unhex(F.repeat(F.lit("78"), n)))
        .when(edit == 6, F.unhex(F.repeat(F.lit("00"), n)))
        .otherwise(F.concat("text", "text").cast("binary"))
    )
    rows = docs.join(other, "doc_id", "left")
    return rows.select(F.col("doc_id").alias("pair_id"), edit.alias("edit"), F.col("text").cast("binary").alias("source"), target.alias("target"))

"""Digests of chunks and bands: planning, building and checking them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from palimpsest.functions.blake3 import blake3_many
from palimpsest.functions.constants import (
    FINE_BANDS,
    FINE_ENTRY_BYTES,
    FINE_PENALTY,
    FINE_TABLE_BYTES,
    IDENTITY_CHUNK,
    MAX_FINE_PER_FILE,
    MAX_FINE_TOTAL,
)

_DELTAS = ("DELTA_RAW", "DELTA_ZSTD")


@F.pandas_udf(BinaryType())
def blake3_256(data: pd.Series) -> pd.Series:
    """BLAKE3 of a binary column."""
    there = data.notna()
    out = data.astype(object)
    out[there] = blake3_many([bytes(x) for x in data[there]])
    return out


def chunk_digests(files: DataFrame, chunk_size: int = IDENTITY_CHUNK, digest=lambda c: F.unhex(F.sha2(c, 256))) -> DataFrame:
    """``file_id, chunk_idx, offset, length, digest`` of ``files(file_id, content binary)``;
    an empty file has no chunk."""
    cut = F.expr(f"""
        CASE WHEN length(content) > 0 THEN transform(sequence(0L, (length(content) - 1L) div {chunk_size}), i -> named_struct(
          'chunk_idx', i, 'offset', i * {chunk_size}, 'length', least({chunk_size}L, length(content) - i * {chunk_size}),
          'bytes', substring(content, CAST(i * {chunk_size} + 1 AS INT), {chunk_size}))) END""")
    rows = files.select("file_id", F.explode(cut).alias("x"))
    return rows.select("file_id", "x.chunk_idx", "x.offset", "x.length", digest(F.col("x.bytes")).alias("digest"))


def tree_digests(files: DataFrame, chunk_size: int = IDENTITY_CHUNK, domain: str = "PLMP-SHA256-TREE-V1") -> DataFrame:
    """``file_id, size, n_chunks, root``: SHA-256 (hex) over the domain, size, chunk size, number
    of chunks and the chunk digests in order.  A file without chunks has a root as well."""
    chunks = chunk_digests(files, chunk_size).groupBy("file_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk_idx", F.lower(F.hex("digest")).alias("d")))).alias("c")
    )
    rows = files.select("file_id", F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("size")).join(chunks, "file_id", "left")
    n = F.coalesce(F.size("c"), F.lit(0))
    n = F.when(F.col("c").isNull(), 0).otherwise(n).cast("long")
    said = F.concat_ws("|", F.lit(domain), "size", F.lit(str(chunk_size)), n.cast("string"), F.array_join(F.transform("c", lambda x: x["d"]), ","))
    return rows.select("file_id", "size", n.alias("n_chunks"), F.sha2(said, 256).alias("root"))


def bands(ranges: DataFrame, band: int) -> DataFrame:
    """Distinct ``file_id, band_index`` that ``ranges(file_id, source_offset, source_size)`` touch."""
    rows = ranges.where("source_size > 0")
    touched = F.sequence(F.floor(F.col("source_offset") / band), F.floor((F.col("source_offset") + F.col("source_size") - 1) / band))
    return rows.select("file_id", F.explode(touched).alias("band_index")).distinct()


def referenced(files: DataFrame, windows: DataFrame, band: int) -> DataFrame:
    """``file_id, n_bands, n_bytes`` of the bands that delta windows of a file refer to."""
    ranges = windows.where(F.col("kind").isin(*_DELTAS))
    size = F.greatest(F.least(F.lit(band).cast("long"), F.col("file_size") - F.col("band_index") * band), F.lit(0))
    rows = bands(ranges, band).join(files.select("file_id", "file_size"), "file_id")
    return rows.groupBy("file_id").agg(F.count("*").alias("n_bands"), F.sum(size).cast("long").alias("n_bytes"))


def plan_fine(files: DataFrame, windows: DataFrame, mode: str = "balanced") -> DataFrame:
    """``file_id, band_size, n_bands, fine_bytes, canonical_bytes`` of the files for which a table
    of fine digests pays: it must beat the canonical chunks by bytes and a penalty for its own
    size, and save at least 256 KiB and twice that size.  Other files have no row."""
    canonical = referenced(files, windows, IDENTITY_CHUNK).select("file_id", F.col("n_bytes").alias("canonical_bytes"))
    most = min(FINE_TABLE_BYTES // FINE_ENTRY_BYTES, MAX_FINE_PER_FILE)
    found = None
    for order, band in enumerate(FINE_BANDS[mode]):
        each = referenced(files, windows, band).withColumns({"band_size": F.lit(band), "order": F.lit(order)})
        found = each if found is None else found.unionByName(each)
    table = F.col("n_bands") * FINE_ENTRY_BYTES
    saved = F.col("canonical_bytes") - F.col("n_bytes")
    scored = found.join(canonical, "file_id").withColumn("score", F.col("n_bytes") + table * FINE_PENALTY[mode])
    good = scored.where((F.col("n_bands") <= most) & (F.col("score") < F.col("canonical_bytes")) & (saved >= 256 << 10) & (saved >= table * 2))
    best = good.groupBy("file_id").agg(F.min(F.struct("score", "order", "band_size", "n_bands", "n_bytes", "canonical_bytes")).alias("x"))
    return best.select("file_id", "x.band_size", "x.n_bands", F.col("x.n_bytes").alias("fine_bytes"), "x.canonical_bytes")


def cap_fine(plans: DataFrame, limit: int = MAX_FINE_TOTAL) -> DataFrame:
    """``plans(patch_id, file_idx, n_bands)`` with ``kept``: in file order, a table that would
    bring the total above the limit is dropped, and the total stays as it was.  The fold runs
    over the files of one container, at most 2^18."""
    rows = plans.groupBy("patch_id").agg(F.array_sort(F.collect_list(F.struct("file_idx", "n_bands"))).alias("f"))
    start = F.expr("named_struct('total', 0L, 'kept', CAST(array() AS array<int>))")
    fold = F.aggregate(
        "f",
        start,
        lambda s, x: F.when(
            s["total"] + x["n_bands"] <= limit,
            F.struct((s["total"] + x["n_bands"]).alias("total"), F.concat(s["kept"], F.array(x["file_idx"].cast("int"))).alias("kept")),
        ).otherwise(s),
    )
    kept = rows.select("patch_id", F.explode(fold["kept"]).alias("file_idx")).withColumn("kept", F.lit(True))
    return plans.join(kept, ["patch_id", "file_idx"], "left").select(*plans.columns, F.coalesce("kept", F.lit(False)).alias("kept"))


def verify_windows(windows: DataFrame, table: DataFrame, actual: DataFrame, band: int) -> DataFrame:
    """``file_id, window_idx, verdict`` of windows with a source range, against a table of
    digests by band: ``mismatch`` if a band that is in the table has another digest, ``verified``
    if all its bands are there, ``fallback`` if some are not.  Each band is compared once,
    however many windows refer to it."""
    touched = F.sequence(F.floor(F.col("source_offset") / band), F.floor((F.col("source_offset") + F.col("source_size") - 1) / band))
    refs = windows.where("source_size > 0").select("file_id", "window_idx", F.explode(touched).alias("band_index"))
    key = ["file_id", "band_index"]
    checked = table.select(*key, F.col("digest").alias("want")).join(actual.select(*key, F.col("digest").alias("have")), key, "left")
    checked = checked.select(*key, F.coalesce(F.col("want") == F.col("have"), F.lit(False)).alias("good"))
    each = refs.join(checked, key, "left").groupBy("file_id", "window_idx").agg(
        F.bool_and(F.coalesce("good", F.lit(True))).alias("right"), F.bool_and(F.col("good").isNotNull()).alias("complete")
    )
    verdict: Column = F.when(~F.col("right"), "mismatch").when(F.col("complete"), "verified").otherwise("fallback")
    return each.select("file_id", "window_idx", verdict.alias("verdict"))

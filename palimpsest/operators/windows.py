"""Windows of a new version: their geometry, and those that need no payload.

Everything here is an expression over the row of a pair, so windows come from one scan without
a shuffle: the pieces of both versions are cut out first, and only they are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.constants import IDENTITY_CHUNK

KIB, MIB, GIB = 1 << 10, 1 << 20, 1 << 30


#: Greatest file of each automatic window size: below the first, up to the others.
AUTO_SIZES = ((MIB - 1, 256 * KIB), (16 * MIB, 512 * KIB), (128 * MIB, MIB), (GIB, 2 * MIB))
AUTO_LARGEST = 4 * MIB


def window_size_of(largest: int) -> int:
    """The window size for a file by the larger of its two sizes."""
    return next((size for most, size in AUTO_SIZES if largest <= most), AUTO_LARGEST)


def auto_window_size(largest: Column) -> Column:
    """``window_size_of`` as an expression."""
    out = F
    for most, size in AUTO_SIZES:
        out = out.when(largest <= most, size)
    return out.otherwise(AUTO_LARGEST)


def same_byte(data: str) -> str:
    """SQL: whether all bytes are equal (false for no bytes): shifted by one they stay the same,
    which mostly is decided by the first two."""
    n = f"length({data})"
    return (
        f"({n} > 0 AND substring({data}, 1, least({n} - 1, 1)) = substring({data}, 2, 1) "
        f"AND substring({data}, 1, {n} - 1) = substring({data}, 2, {n} - 1))"
    )


def windows(pairs: DataFrame, window_size: int | str = "auto", halo: bool = False) -> DataFrame:
    """One row per window of the target: ``pair_id, .., window_idx, output_offset, output_size,
    source_size, span_offset, span_size, target binary, same binary`` (``same`` are the source
    bytes at the same place, null unless all are there) and with ``halo`` also ``span binary``.

    ``pairs`` is ``(pair_id, source binary, target binary, ..)``; other columns are kept.  An
    empty or null target has no window; a null source is empty.
    """
    keep = [c for c in pairs.columns if c not in ("source", "target")]
    empty = F.unhex(F.lit(""))
    rows = pairs.select(*keep, F.coalesce("source", empty).alias("__s"), F.coalesce("target", empty).alias("__t"))
    largest = F.greatest(F.length("__s"), F.length("__t"))
    size = auto_window_size(largest) if window_size == "auto" else F.lit(int(window_size))
    rows = rows.withColumn("__w", size.cast("long")).withColumn("__n", F.length("__t").cast("long")).withColumn("__m", F.length("__s").cast("long"))
    cut = """
      CASE WHEN __n > 0 THEN transform(sequence(0L, (__n - 1) div __w), i -> named_struct(
        'window_idx', i,
        'output_offset', i * __w,
        'output_size', least(__w, __n - i * __w),
        'source_size', __m,
        'span_offset', CASE WHEN greatest(i * __w - __w, 0L) < __m THEN greatest(i * __w - __w, 0L) ELSE 0L END,
        'span_size', greatest(least(__m, i * __w + least(__w, __n - i * __w) + __w) - greatest(i * __w - __w, 0L), 0L),
        'target', substring(__t, CAST(i * __w + 1 AS INT), CAST(least(__w, __n - i * __w) AS INT)),
        'same', CASE WHEN i * __w + least(__w, __n - i * __w) <= __m
                THEN substring(__s, CAST(i * __w + 1 AS INT), CAST(least(__w, __n - i * __w) AS INT)) END%s)) END
    """
    span = """,
        'span', substring(__s, CAST(greatest(i * __w - __w, 0L) + 1 AS INT), CAST(greatest(least(__m, i * __w
                + least(__w, __n - i * __w) + __w) - greatest(i * __w - __w, 0L), 0L) AS INT))"""
    out = rows.select(*keep, F.explode(F.expr(cut % (span if halo else ""))).alias("__x"))
    return out.select(*keep, "__x.*")


def cheap_kind() -> Column:
    """ZERO, RUN or SAME, in this order, else null."""
    return F.expr(f"""
        CASE WHEN {same_byte('target')} THEN CASE WHEN substring(target, 1, 1) = unhex('00') THEN 'ZERO' ELSE 'RUN' END
             WHEN same = target THEN 'SAME' END""")


def classify(rows: DataFrame) -> DataFrame:
    """``rows`` with ``kind``: ZERO, RUN, SAME or CHANGED."""
    return rows.withColumn("kind", F.coalesce(cheap_kind(), F.lit("CHANGED")))


def source_chunks(offset: Column, size: Column) -> tuple[Column, Column]:
    """First identity chunk and number of chunks of a source range (zero for an empty one)."""
    first = F.floor(offset / IDENTITY_CHUNK)
    end = F.ceil((offset + size) / IDENTITY_CHUNK)
    none = size == 0
    return (
        F.when(none, 0).otherwise(first).cast("long"),
        F.when(none, 0).otherwise(end - first).cast("int"),
    )


def output_group(offset: Column) -> Column:
    """The 8 MiB output group of a window."""
    return F.floor(offset / IDENTITY_CHUNK).cast("long")


def clone_eligible(rows: DataFrame, min_size: int = MIB, min_percent: int = 90) -> DataFrame:
    """Per pair whether patching a clone of the source is worth it: equal sizes, at least
    ``min_size`` bytes, and at least ``min_percent`` of them in SAME windows."""
    same = F.sum(F.when(F.col("kind") == "SAME", F.col("output_size")).otherwise(0)).alias("same_bytes")
    each = rows.groupBy("pair_id").agg(F.sum("output_size").alias("target_size"), F.max("source_size").alias("source_size"), same)
    return each.withColumn(
        "clone",
        (F.col("source_size") == F.col("target_size"))
        & (F.col("target_size") >= min_size)
        & (F.col("same_bytes") * 100 >= F.col("target_size") * min_percent),
    )

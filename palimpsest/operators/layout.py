"""Payload layout of a container, and the checks of window sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.constants import IDENTITY_CHUNK, PREFIX_SIZE


def payload_offsets(windows: DataFrame, patch: str = "patch_id") -> DataFrame:
    """``windows(patch_id, file_idx, dir, window_idx, payload_size, ..)`` with ``payload_offset``:
    payloads follow each other from byte 16 by file, then forward before reverse, then window;
    a window without payload has offset zero.

    Files of a container are at most 2^18, so their totals may be summed up in one task per
    container; the windows of a file are summed up in theirs.
    """
    each = ["file_idx", "dir_idx"]
    rows = windows.withColumn("dir_idx", F.when(F.col("dir") == "forward", 0).otherwise(1))
    totals = rows.groupBy(patch, *each).agg(F.sum("payload_size").alias("t"))
    before = Window.partitionBy(patch).orderBy(*each).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(patch, *each, F.coalesce(F.sum("t").over(before), F.lit(0)).alias("b"))
    inside = Window.partitionBy(patch, *each).orderBy("window_idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("i", F.coalesce(F.sum("payload_size").over(inside), F.lit(0)))
    at = F.col("b") + F.col("i") + PREFIX_SIZE
    out = rows.join(starts, [patch, *each]).withColumn("payload_offset", F.when(F.col("payload_size") > 0, at).otherwise(0).cast("long"))
    return out.select(*windows.columns, "payload_offset")


def contiguity(windows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``set_id, ok``: whether the windows of each set follow each other from byte zero to the
    output size.  ``windows(set_id, window_idx, output_offset, output_size)``; ``sizes(set_id,
    output_size, window_size)``.  An empty output has no window, any other at least one."""
    order = Window.partitionBy("set_id").orderBy("window_idx")
    expected = F.coalesce(F.lag(F.col("output_offset") + F.col("output_size")).over(order), F.lit(0))
    limits = sizes.select("set_id", F.col("output_size").alias("total"), "window_size")
    rows = windows.withColumn("good", (F.col("output_offset") == expected) & (F.col("output_size") > 0))
    each = rows.join(limits, "set_id").groupBy("set_id").agg(
        F.bool_and(F.col("good") & (F.col("output_size") <= F.col("window_size"))).alias("good"), F.sum("output_size").alias("covered")
    )
    ok = F.when(F.col("good").isNull(), F.col("total") == 0).otherwise(F.col("good") & (F.col("covered") == F.col("total")))
    return limits.join(each, "set_id", "left").select("set_id", ok.alias("ok"))


def coverage(payloads: DataFrame, index_offsets: DataFrame) -> DataFrame:
    """``patch_id, ok``: whether the payloads of a container cover bytes 16 to its index without
    gap or overlap.  ``payloads(patch_id, payload_offset, payload_size)``."""
    rows = payloads.where("payload_size > 0")
    order = Window.partitionBy("patch_id").orderBy("payload_offset", "payload_size")
    expected = F.coalesce(F.lag(F.col("payload_offset") + F.col("payload_size")).over(order), F.lit(PREFIX_SIZE))
    each = rows.withColumn("good", F.col("payload_offset") == expected).groupBy("patch_id").agg(
        F.bool_and("good").alias("good"), F.max(F.col("payload_offset") + F.col("payload_size")).alias("end")
    )
    out = index_offsets.join(each, "patch_id", "left")
    ok = F.when(F.col("good").isNull(), F.col("index_offset") == PREFIX_SIZE).otherwise(F.col("good") & (F.col("end") == F.col("index_offset")))
    return out.select("patch_id", ok.alias("ok"))


def window_audit(windows: DataFrame) -> DataFrame:
    """``windows`` with ``reason``: the first rule that a descriptor breaks, or null.

    Columns: kind, codec, flags, output_offset, output_size, payload_size, expanded_size,
    source_offset, source_size, source_first_chunk, source_chunk_count, instruction_count and
    input_size, the size of what it is read from.
    """
    bound = "expanded_size + expanded_size div 128 + 4096"
    stream = "output_size * 2 + 1048576"
    return windows.withColumn(
        "reason",
        F.expr(f"""
        CASE
          WHEN flags <> 0 THEN 'flags'
          WHEN kind NOT IN ('SAME', 'COPY', 'DELTA_RAW', 'DELTA_ZSTD', 'REPLACE_RAW', 'REPLACE_ZSTD', 'ZERO', 'RUN') THEN 'kind'
          WHEN codec <> CASE WHEN kind IN ('DELTA_ZSTD', 'REPLACE_ZSTD') THEN 'zstd' ELSE 'none' END THEN 'codec'
          WHEN kind IN ('SAME', 'COPY') AND (payload_size <> 0 OR expanded_size <> 0) THEN 'payload'
          WHEN kind IN ('SAME', 'COPY') AND source_size <> output_size THEN 'source size'
          WHEN kind = 'SAME' AND source_offset <> output_offset THEN 'source offset'
          WHEN kind IN ('DELTA_RAW', 'DELTA_ZSTD') AND (payload_size = 0 OR expanded_size = 0) THEN 'payload'
          WHEN kind = 'DELTA_RAW' AND expanded_size <> payload_size THEN 'payload'
          WHEN kind IN ('DELTA_RAW', 'DELTA_ZSTD') AND expanded_size > {stream} THEN 'stream bound'
          WHEN kind IN ('DELTA_ZSTD', 'REPLACE_ZSTD') AND payload_size > {bound} THEN 'zstd bound'
          WHEN kind IN ('DELTA_RAW', 'DELTA_ZSTD') AND source_size = 0 THEN 'source size'
          WHEN kind = 'REPLACE_RAW' AND payload_size <> output_size THEN 'payload'
          WHEN kind = 'REPLACE_ZSTD' AND payload_size = 0 THEN 'payload'
          WHEN kind = 'ZERO' AND payload_size <> 0 THEN 'payload'
          WHEN kind = 'RUN' AND payload_size <> 1 THEN 'payload'
          WHEN kind IN ('REPLACE_RAW', 'REPLACE_ZSTD', 'ZERO', 'RUN') AND expanded_size <> output_size THEN 'expanded size'
          WHEN (kind IN ('DELTA_RAW', 'DELTA_ZSTD')) <> (instruction_count > 0) THEN 'instructions'
          WHEN kind IN ('REPLACE_RAW', 'REPLACE_ZSTD', 'ZERO', 'RUN')
               AND (source_offset <> 0 OR source_size <> 0 OR source_first_chunk <> 0 OR source_chunk_count <> 0) THEN 'source of none'
          WHEN source_offset > input_size OR source_size > input_size - source_offset THEN 'source range'
          WHEN source_size > 0 AND (source_first_chunk <> source_offset div {IDENTITY_CHUNK}
               OR source_chunk_count <> (source_offset + source_size + {IDENTITY_CHUNK - 1}) div {IDENTITY_CHUNK} - source_offset div {IDENTITY_CHUNK})
            THEN 'source chunks'
        END"""),
    )

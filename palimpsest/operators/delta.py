"""How each window is made: edit operations, their encoding, and the cheapest candidate.

Windows are independent, so building them is one pass of Arrow batches over the pairs, without a
shuffle; a window that is ZERO, RUN or SAME is known by one comparison of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import codec
from palimpsest.functions.constants import MODES

from .windows import cheap_kind, window_size_of

_BUILT = (
    "window_idx long, output_offset long, output_size long, kind string, codec string, payload binary, payload_size long, "
    "expanded_size long, source_offset long, source_size long, instruction_count int"
)
_COLUMNS = [x.split()[0] for x in _BUILT.split(", ")]
_TYPES = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.binary()] + [pa.int64()] * 4 + [pa.int32()]


class Options:
    """How windows are built.

    ``cdc`` is None for the average chunk length by window size, zero for no chunk matching, or
    an average of its own (for small tests); ``cdc_gate`` is the least span and window for it.
    """

    def __init__(
        self, window_size: int | str = "auto", level: int = 3, mode: str = "balanced", zstd: bool = True,
        cdc: int | None = None, cdc_gate: int = 1024,
    ) -> None:
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        self.window_size, self.level, self.mode, self.zstd = window_size, level, mode, zstd
        self.cdc, self.cdc_gate = cdc, cdc_gate


def window_ops(target: bytes, same: bytes | None, span: bytes, span_offset: int, output_offset: int, options: Options):
    """``(operations, stream, instructions)`` of the better delta, or None.

    Equal places come first; matched chunks replace them only if their stream is shorter.  A
    candidate must copy at least an eighth of the window.
    """
    best = None
    if same is not None:
        ops = codec.sparse_ops(same, target, output_offset)
        if codec.copied(ops) >= len(target) // 8 and (made := codec.encode_ops(ops, target, span_offset, output_offset)):
            best = ops, *made
    if options.cdc != 0 and len(span) >= options.cdc_gate and len(target) >= options.cdc_gate:
        ops = codec.chunk_ops(span, target, span_offset, *codec.chunk_sizes(len(target), options.cdc))
        if codec.copied(ops) >= len(target) // 8 and (made := codec.encode_ops(ops, target, span_offset, output_offset)):
            if best is None or len(made[0]) < len(best[1]):
                best = ops, *made
    return best


def build_window(target: bytes, same: bytes | None, span: bytes, span_offset: int, output_offset: int, options: Options) -> tuple:
    """Kind, codec, payload, expanded size, source range and instructions of a changed window."""
    n = len(target)
    best = window_ops(target, same, span, span_offset, output_offset, options)
    if best and len(best[0]) == 1 and best[0][0][0] == "COPY" and best[0][0][2] == n:
        return "COPY", "none", None, 0, best[0][0][1], n, 0
    choices = [("REPLACE_RAW", "none", target, n, 0, 0, 0)]
    if options.zstd:
        choices.append(("REPLACE_ZSTD", "zstd", codec.compress(target, options.level), n, 0, 0, 0))
    if best:
        _, stream, count = best
        choices.append(("DELTA_RAW", "none", stream, len(stream), span_offset, len(span), count))
        if options.zstd:
            choices.append(("DELTA_ZSTD", "zstd", codec.compress(stream, options.level), len(stream), span_offset, len(span), count))
    # min() keeps the first of equal scores, in the order above.
    return min(choices, key=lambda c: codec.score(c[0], len(c[2]), c[3], c[6], c[5], options.mode))


#: Windows, and bytes of their payloads, between two emissions of a task.
_EMIT_ROWS, _EMIT_BYTES = 4096, 32 << 20


def _windows_of(source: bytes, target: bytes, options: Options) -> Iterator[tuple]:
    """The built windows of one pair, cut as ``windows`` does."""
    n, m = len(target), len(source)
    w = window_size_of(max(n, m)) if options.window_size == "auto" else int(options.window_size)
    for idx, place in enumerate(range(0, n, w)):
        piece = target[place : place + w]
        size = len(piece)
        if piece[0] == piece[-1] and piece == piece[:1] * size:
            made = ("RUN", "none", piece[:1], size, 0, 0, 0) if piece[0] else ("ZERO", "none", None, size, 0, 0, 0)
        else:
            same = source[place : place + size] if place + size <= m else None
            if same == piece:
                made = "SAME", "none", None, 0, place, size, 0
            else:
                low = max(place - w, 0)
                made = build_window(piece, same, source[low : place + size + w], low if low < m else 0, place, options)
        kind, how, payload, expanded, offset, span, count = made
        yield idx, place, size, kind, how, payload, len(payload or b""), expanded, offset, span, count


def _builder(options: Options, keep: list[str]):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit() -> pa.RecordBatch:
            kept = [batch.column(c).take(pa.array(of, pa.int64())) for c in keep]
            return pa.record_batch([*kept, *(pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES))], [*keep, *_COLUMNS])

        for batch in batches:
            rows, of, held = [], [], 0
            for i, (source, target) in enumerate(zip(batch.column("source"), batch.column("target"), strict=True)):
                for row in _windows_of(source.as_py() or b"", target.as_py() or b"", options):
                    rows.append(row)
                    of.append(i)
                    held += row[6]
                    if len(rows) >= _EMIT_ROWS or held >= _EMIT_BYTES:
                        yield emit()
                        rows, of, held = [], [], 0
            if rows:
                yield emit()

    return build


def build_windows(pairs: DataFrame, options: Options | None = None) -> DataFrame:
    """Every window of every pair with its kind, codec, payload and source range.

    Columns of ``pairs`` other than the two versions are kept.  Both versions go to the task's
    Python worker once; cut before, a changed window would carry three times its size of source.
    """
    options = options or Options()
    keep = [c for c in pairs.columns if c not in ("source", "target")]
    rows = pairs.select(*keep, "source", "target")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema), _BUILT])
    return rows.mapInArrow(_builder(options, keep), schema)


def _ops_of(options: Options, which: str):
    def ops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pair, idx, place, base, target, same, span in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if which == "sparse":
                    found = codec.sparse_ops(same, target, place) if same is not None else []
                else:
                    found = codec.chunk_ops(span, target, base, *codec.chunk_sizes(len(target), options.cdc))
                out += [(pair, idx, k, *op) for k, op in enumerate(found)]
            names = ["pair_id", "window_idx", "op_idx", "op", "offset", "length"]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

    return ops


def operations(rows: DataFrame, which: str = "sparse", options: Options | None = None) -> DataFrame:
    """``pair_id, window_idx, op_idx, op, offset, length`` of changed windows.

    ``rows`` are windows with their halo; ``offset`` is in the source for COPY, and in the window
    for ADD.  ``which`` is ``sparse`` (equal places) or ``chunks`` (content-defined chunks).
    """
    given = rows.where(cheap_kind().isNull()).select("pair_id", "window_idx", "output_offset", "span_offset", "target", "same", "span")
    return given.mapInArrow(_ops_of(options or Options(), which), "pair_id long, window_idx long, op_idx int, op string, offset long, length long")


def varint_size(value: str) -> str:
    """SQL of the encoded size of a number below 2^35."""
    return f"CASE WHEN {value} < 128 THEN 1 WHEN {value} < 16384 THEN 2 WHEN {value} < 2097152 THEN 3 WHEN {value} < 268435456 THEN 4 ELSE 5 END"


def encoded_sizes(ops: DataFrame, rows: DataFrame) -> DataFrame:
    """``pair_id, window_idx, stream_size, instructions, copied`` without making the streams:
    opcode choice as expressions over neighbouring operations of a window."""
    key = ["pair_id", "window_idx"]
    order = Window.partitionBy(*key).orderBy("op_idx")
    facts = rows.select(*key, "output_offset", "span_offset", "target")
    x = ops.join(facts, key)
    x = x.withColumn("place", F.col("output_offset") + F.sum("length").over(order) - F.col("length"))
    x = x.withColumn("next_op", F.lead("op").over(order)).withColumn("next_n", F.lead("length").over(order))
    x = x.withColumn("prev_op", F.lag("op").over(order)).withColumn("prev_end", F.lag(F.col("offset") + F.col("length")).over(order))
    x = x.withColumn("pair", (F.col("op") == "COPY") & F.coalesce((F.col("next_op") == "ADD") & (F.col("next_n") <= 255), F.lit(False)))
    x = x.withColumn("paired", F.coalesce((F.col("op") == "ADD") & (F.col("prev_op") == "COPY") & (F.col("length") <= 255), F.lit(False)))
    # A COPY after a pair goes on from that pair's COPY; two operations back.
    x = x.withColumn("prev_end", F.when(F.col("prev_op") == "COPY", F.col("prev_end")).when(
        F.lag("paired").over(order), F.lag(F.col("offset") + F.col("length"), 2).over(order)))
    x = x.withColumn("literal", F.expr("CASE WHEN op = 'ADD' THEN hex(substring(target, CAST(offset + 1 AS INT), CAST(length AS INT))) END"))
    size = F.expr(f"""
        CASE WHEN paired THEN 0
             WHEN pair THEN 1 + {varint_size('(offset - span_offset)')} + {varint_size('length')} + 1 + next_n
             WHEN op = 'COPY' THEN CASE
               WHEN offset = place AND length <= 256 THEN 2
               WHEN prev_end IS NOT NULL AND offset - prev_end BETWEEN -32768 AND 32767 AND length <= 65535 THEN 5
               WHEN offset - span_offset <= 65535 AND length <= 65535 THEN 5
               ELSE 1 + {varint_size('(offset - span_offset)')} + {varint_size('length')} END
             WHEN length >= 8 AND literal = repeat(substring(literal, 1, 2), CAST(length AS INT)) THEN
               CASE WHEN substring(literal, 1, 2) = '00' THEN 1 ELSE 2 END + {varint_size('length')}
             WHEN length <= 255 THEN 2 + length
             ELSE 1 + {varint_size('length')} + length END""")
    return x.groupBy(*key).agg(
        (F.sum(size) + 9).cast("long").alias("stream_size"),
        F.sum(F.when(F.col("paired"), 0).otherwise(1)).cast("long").alias("instructions"),
        F.sum(F.when(F.col("op") == "COPY", F.col("length")).otherwise(0)).cast("long").alias("copied"),
    )


def chunk_table(rows: DataFrame, average: int) -> DataFrame:
    """``pair_id, window_idx, chunk_idx, chunk_offset, chunk_length, bytes``: content-defined
    chunks of each window's target."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pair, idx, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                start = 0
                for k, end in enumerate(codec.chunk_ends(target, *codec.chunk_sizes(len(target), average))):
                    out.append((pair, idx, k, start, end - start, target[start:end]))
                    start = end
            names = ["pair_id", "window_idx", "chunk_idx", "chunk_offset", "chunk_length", "bytes"]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

    return rows.select("pair_id", "window_idx", "target").mapInArrow(
        cut, "pair_id long, window_idx long, chunk_idx int, chunk_offset long, chunk_length long, bytes binary"
    )


def choose(sizes: DataFrame, mode: str) -> DataFrame:
    """The cheaper of REPLACE_RAW and DELTA_RAW by score, from ``output_size, stream_size,
    instructions, copied, span_size`` (the stream's columns null where there is none)."""
    n, stream = F.col("output_size"), F.col("stream_size")
    cost = stream
    if mode == "apply-speed":
        cost = stream + 32 * F.col("instructions") + F.floor(F.col("span_size") / 16)
    elif mode == "balanced":
        cost = stream + 4 * F.col("instructions") + F.floor(F.col("span_size") / 128)
    usable = (F.col("copied") >= F.floor(n / 8)) & (F.col("instructions") <= 65535)
    delta = F.coalesce(usable & (cost < n), F.lit(False))
    return sizes.select("*", F.when(delta, "DELTA_RAW").otherwise("REPLACE_RAW").alias("choice"), F.when(delta, stream).otherwise(n).alias("payload_size"))

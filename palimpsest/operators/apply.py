"""Rebuilding a version from the other one and the windows, in either direction.

Kinds that built-in expressions can make are made by them (SAME, COPY, REPLACE_RAW, ZERO, RUN);
the others go through Arrow batches.  The only shuffle brings the windows of an output group
together; groups are 8 MiB, so no task holds a whole rebuilt file.  ``rebuild``, which asks for the
digest of whole versions only, streams the windows of each past its source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import codec

from .windows import output_group


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        out = []
        for r in rows:
            if r["bytes"] is not None:
                out.append(r["bytes"])
                continue
            payload = r["payload"]
            if r["kind"].endswith("ZSTD"):
                payload = codec.decompress(payload, r["expanded_size"])
            if r["kind"].startswith("DELTA"):
                payload = codec.decode_ops(
                    payload, r["span"], r["source_offset"], r["source_size"], r["output_offset"], r["output_size"], r["instruction_count"]
                )
            if len(payload) != r["output_size"]:
                raise ValueError(f"window {r['window_idx']} of pair {r['pair_id']} has another size")
            out.append(payload)
        yield pa.record_batch(
            [batch.column("pair_id"), batch.column("output_offset"), batch.column("output_size"), pa.array(out, pa.binary())],
            ["pair_id", "output_offset", "output_size", "bytes"],
        )


def decode_windows(windows: DataFrame, sources: DataFrame) -> DataFrame:
    """``pair_id, output_offset, output_size, bytes`` from built windows and
    ``sources(pair_id, source binary)``; a missing or null source is empty."""
    rows = windows.join(sources.select("pair_id", "source"), "pair_id", "left")
    piece = "substring(coalesce(source, unhex('')), CAST(source_offset + 1 AS INT), CAST(source_size AS INT))"
    made = F.expr(f"""
        CASE WHEN kind IN ('SAME', 'COPY') THEN {piece}
             WHEN kind = 'REPLACE_RAW' THEN payload
             WHEN kind = 'ZERO' THEN unhex(repeat('00', CAST(output_size AS INT)))
             WHEN kind = 'RUN' THEN unhex(repeat(hex(payload), CAST(output_size AS INT))) END""")
    span = F.expr(f"CASE WHEN kind IN ('DELTA_RAW', 'DELTA_ZSTD') THEN {piece} END")
    rows = rows.select(
        "pair_id", "window_idx", "output_offset", "output_size", "kind", "expanded_size", "source_offset", "source_size", "instruction_count",
        made.alias("bytes"), span.alias("span"), F.when(F.col("kind").rlike("DELTA|ZSTD"), F.col("payload")).alias("payload"),
    )
    return rows.mapInArrow(_decode, "pair_id long, output_offset long, output_size long, bytes binary")


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first, joined = [], []
        for windows in batch.column(2).to_pylist():
            at = windows[0]["output_offset"]
            first.append(at)
            for w in windows:
                if w["output_offset"] != at:
                    raise ValueError("windows of a group leave a gap or overlap")
                at += len(w["bytes"])
            joined.append(b"".join(w["bytes"] for w in windows))
        yield pa.record_batch(
            [*batch.columns[:2], pa.array(first, pa.int64()), pa.array(joined, pa.binary())],
            ["pair_id", "group", "group_offset", "bytes"],
        )


def join_groups(decoded: DataFrame) -> DataFrame:
    """``pair_id, group, group_offset, bytes``: windows put together by 8 MiB output group, in
    order; a gap or an overlap is an error."""
    groups = decoded.groupBy("pair_id", output_group(F.col("output_offset")).alias("group")).agg(
        F.sort_array(F.collect_list(F.struct("output_offset", "bytes"))).alias("w")
    )
    return groups.mapInArrow(_join, "pair_id long, group long, group_offset long, bytes binary")


def _window_bytes(source: bytes, place: int, size: int, kind: str, payload: bytes | None, expanded: int, offset: int, span: int, count: int) -> bytes:
    if kind in ("SAME", "COPY"):
        out = source[offset : offset + span]
    elif kind in ("ZERO", "RUN"):
        out = (payload or b"\0") * size
    else:
        out = codec.decompress(payload, expanded) if kind.endswith("ZSTD") else payload
        if kind.startswith("DELTA"):
            out = codec.decode_ops(out, source[offset : offset + span], offset, span, place, size, count)
    if len(out) != size:
        raise ValueError(f"the window at {place} has another size")
    return out


def _versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of versions whose rows come one after the other: the source, then its windows."""
    pair, source, made, sha = None, None, 0, None
    done: list[tuple] = []
    names = ["pair_id", "size", "sha256"]

    def emit() -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[k] for r in done], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names)

    for batch in batches:
        for to, of, *window in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if window[0] < 0:
                if sha is not None:
                    done.append((pair, made, sha.hexdigest()))
                pair, source, made, sha = to, of or b"", 0, hashlib.sha256()
            elif sha is not None and to == pair:
                if window[0] != made:
                    raise ValueError("windows of a version leave a gap or overlap")
                data = _window_bytes(source, *window)
                sha.update(data)
                made += len(data)
        if done:
            yield emit()
            done = []
    if sha is not None:
        done.append((pair, made, sha.hexdigest()))
        yield emit()


def rebuild(windows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pair_id, size, sha256`` of every rebuilt version; ``pairs(pair_id, source)`` says which
    there are (each once), so that an empty version, which has no window, is one too.

    One shuffle puts each source before its windows; a task holds one source and one window at a
    time, and the version is hashed as it is made.
    """
    columns = ["output_offset", "output_size", "kind", "payload", "expanded_size", "source_offset", "source_size", "instruction_count"]
    rows = windows.select("pair_id", F.lit(None).cast("binary").alias("source"), *columns)
    first = F.lit(-1).cast("long").alias("output_offset")
    sources = pairs.select("pair_id", "source", first, *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns[1:]))
    both = rows.unionByName(sources).repartition("pair_id").sortWithinPartitions("pair_id", "output_offset")
    return both.mapInArrow(_versions, "pair_id long, size long, sha256 string")


def reversed_pairs(pairs: DataFrame) -> DataFrame:
    """The pairs with both versions exchanged."""
    return pairs.withColumnsRenamed({"source": "__s", "target": "source"}).withColumnRenamed("__s", "target")

"""Exact substring deduplication over bytes by a distributed merge sort of suffixes.

On the skeleton of ``passages``, the suffixes that can matter start at repeated anchors.  Each
task sorts its suffixes and sends them as runs that are front-coded: of a suffix only what it
doesn't share with the one before, with the length of what it shares.  Where runs meet they are
merged by a loser tree that carries, for every contender, the length of its common prefix with
the last winner.  Two contenders with different lengths are decided by these alone, and equal
lengths are compared from there on, so no known prefix is compared again.  The merged order
comes with the common prefix of neighbours, and neighbours that share a gram form the group
of an anchor, within which windows are compared with their left contexts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents
from .passages import HOT, Kind, common_prefix, cover_group, covered, decode_run, mask, mix, touched

SIZE = 100
GRAM = 32


def merge(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, int]]:
    """Merge sorted front-coded runs of (shared prefix lengths, strings): yields (run, index,
    common prefix with the string before) in sorted order."""
    k = len(runs)
    index = [0] * k
    ends = [len(x[1]) for x in runs]
    prefix = [0] * k  # with the last winner
    strings = [x[1] for x in runs]

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs (-1: none)."""
        if a < 0 or index[a] >= ends[a]:
            return b, a
        if b < 0 or index[b] >= ends[b]:
            return a, b
        pa_, pb = prefix[a], prefix[b]
        if pa_ != pb:
            return (a, b) if pa_ > pb else (b, a)
        x, y = strings[a][index[a]], strings[b][index[b]]
        n = common_prefix(x, y, pa_)
        if x[n : n + 1] <= y[n : n + 1]:
            prefix[b] = n
            return a, b
        prefix[a] = n
        return b, a

    size = 1
    while size < k:
        size *= 2
    losers = [-1] * size

    def build(node: int) -> int:
        if node >= size:
            return node - size if node - size < k else -1
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1)
    while winner >= 0 and index[winner] < ends[winner]:
        at = index[winner]
        yield winner, at, prefix[winner]
        index[winner] = at + 1
        if at + 1 < ends[winner]:
            prefix[winner] = runs[winner][0][at + 1]
        node = (winner + size) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


class Bytes(Kind):
    def __init__(self, size: int = SIZE, gram: int = GRAM) -> None:
        if gram > size or gram & (gram - 1):
            raise ValueError("gram must be a power of two, and at most the size")
        self.size, self.gram = size, gram
        self.table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def elements(self, text: bytes) -> tuple[np.ndarray, object]:
        return np.frombuffer(text, np.uint8), text

    def hashes(self, elements: np.ndarray) -> np.ndarray:
        return self.table[elements]

    def payload(self, aid: object, start: int, end: int) -> bytes:
        return aid[start:end]

    def cut(self, payload: bytes, n: int) -> int:
        return n

    def count(self, payload: bytes) -> int:
        return len(payload) - self.size + 1

    def windows(self, payload: bytes) -> list[bytes]:
        return [payload[i : i + self.size] for i in range(len(payload) - self.size + 1)]

    def solve(self, runs: list[dict], cover: Callable[[int, int, int], None]) -> None:
        decoded = [decode_run(x) for x in runs]
        group: list[tuple[bytes, int, int, int]] = []
        for run, i, prefix in merge([x[:2] for x in decoded]):
            if prefix < self.gram and group:
                self._group(group, cover)
                group = []
            _, suffixes, lefts, doc, start, _, _ = decoded[run]
            group.append((lefts[i] + suffixes[i], len(lefts[i]), doc[i], start[i]))
        if group:
            self._group(group, cover)

    def _group(self, group: list[tuple[bytes, int, int, int]], cover: Callable[[int, int, int], None]) -> None:
        group = cover_group(self, group, cover)
        if len(group) == 1:
            return
        best: dict[bytes, tuple[int, int]] = {}
        size = self.size
        for data, _, doc, start in group:
            for t in range(len(data) - size + 1):
                key, me = data[t : t + size], (doc, start + t)
                if best.setdefault(key, me) > me:
                    best[key] = me
        for data, _, doc, start in group:
            first = None
            for t in range(len(data) - size + 1):
                late = best[data[t : t + size]] != (doc, start + t)
                if late and first is None:
                    first = t
                elif not late and first is not None:
                    cover(doc, start + first, start + t - 1)
                    first = None
            if first is not None:
                cover(doc, start + first, start + len(data) - size)


def _cutter(size: int, keep_text: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, removed, spans, digests, texts = [], [], [], [], []
            for text, ranges in zip(batch.column(1), batch.column(2), strict=True):
                text, ranges = text.as_py(), ranges.as_py()
                gone, runs, kept = 0, 0, text
                if ranges:
                    out = mask(ranges, len(text), size)
                    gone = int(out.sum())
                    runs = int((np.diff(np.concatenate([[0], out.astype(np.int8)])) == 1).sum())
                    kept = np.frombuffer(text, np.uint8)[~out].tobytes()
                n_bytes.append(len(text))
                removed.append(gone)
                spans.append(runs)
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept)
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, removed, spans)), pa.array(digests, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                columns.append(pa.array(texts, pa.binary()))
                names.append("kept")
            yield pa.record_batch(columns, names)

    return cut


def remove_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM, hot: int = HOT, keep_text: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept
    binary``, the remaining bytes, on demand).

    Every byte covered by a ``size``-byte string that also starts earlier is removed: in a
    document of smaller doc_id, or earlier in the same one; overlaps count, and strings are
    judged on the input.  Null and empty texts have no bytes; texts shorter than ``size`` lose
    none; an empty table gives an empty result.
    """
    texts = documents(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    found = covered(texts, Bytes(size, gram), hot)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    cut = touched(texts, found).select("doc_id", "text", "ranges").mapInArrow(_cutter(size, keep_text), schema)
    # All other documents stay as they are, and where they are.
    whole = [F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("s")] + [F.col("text").alias("t")] * keep_text
    out = texts.select("doc_id", *whole).join(cut, "doc_id", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id",
        F.coalesce("n_bytes", "n").alias("n_bytes"),
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "s").alias("kept_sha256"),
        *[F.coalesce("kept", "t").alias("kept")] * keep_text,
    )

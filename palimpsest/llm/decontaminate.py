"""Benchmark decontamination: windows of test words in training texts.

The windows of the benchmark (ten consecutive words, or all words of a shorter item) become a
hash set that is broadcast to the tasks.  Its size is checked first: a benchmark of more than
``max_windows`` windows is cut into shards of at most that many, and the documents are scanned
once for each shard.  Each task scans all words of its documents: a word that no window holds
ends a run, each window of a run is looked up by a rolling hash, and a hit is verified word by
word before it counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, stash

WINDOW = 10
#: Windows held by one task at once, at about 300 bytes each.
MAX_WINDOWS = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _word_table() -> bytes:
    """Bytes as they count in words: A-Z to a-z, separators to spaces."""
    table = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        table[b] = ord(c.lower()) if c.isalnum() else 0x20
    return bytes(table)


_TABLE = _word_table()


def words(text: str | None) -> list[bytes]:
    """Runs of 0-9, a-z and characters beyond ASCII, after A-Z became a-z."""
    return (text or "").encode().translate(_TABLE).split()


def _mix(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    return x * np.uint64(0x94D049BB133111EB)


def _rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each window of n ids."""
    mixed = _mix(ids)
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for j in range(n):
        out = out * _BASE + mixed[j : len(ids) - n + 1 + j]
    return out


class Index:
    """The windows of a benchmark: word ids, and by window length the sorted hashes."""

    def __init__(self, windows: list[tuple[str, tuple[bytes, ...]]]) -> None:
        self.ids: dict[bytes, int] = {}
        items: dict[tuple[int, ...], set[str]] = {}
        for item, window in windows:
            key = tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in window)
            items.setdefault(key, set()).add(item)
        self.by_length: dict[int, tuple[np.ndarray, dict[int, list]]] = {}
        for n in sorted({len(k) for k in items}):
            found: dict[int, list] = {}
            for key, names in items.items():
                if len(key) == n:
                    found.setdefault(int(_rolling(np.array(key, np.uint64), n)[0]), []).append((key, frozenset(names)))
            self.by_length[n] = np.sort(np.fromiter(found, np.uint64, len(found))), found

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, which are hit, and the items whose windows occur."""
        found = words(text)
        hit = np.zeros(len(found), bool)
        names: set[str] = set()
        if not found or not self.ids:
            return len(found), hit, names
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in found), np.int64, len(found))
        known = ids > 0
        for n, (hashes, keys) in self.by_length.items():
            if n > len(ids):
                continue
            before = np.concatenate([[0], np.cumsum(known)])
            full = np.flatnonzero(before[n:] - before[:-n] == n)
            if not len(full):
                continue
            rolled = _rolling(ids, n)[full]
            at = np.minimum(np.searchsorted(hashes, rolled), len(hashes) - 1)
            for start, h in zip(full[hashes[at] == rolled].tolist(), rolled[hashes[at] == rolled].tolist(), strict=True):
                window = tuple(ids[start : start + n].tolist())
                for key, owners in keys[h]:
                    if key == window:
                        hit[start : start + n] = True
                        names |= owners
        return len(found), hit, names


def _bits(hit: np.ndarray) -> bytes:
    """Runs of hit words, as pairs of little-endian 32-bit start and end."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edge.astype("<i4").tobytes()


_SCHEMA = "doc_id long, n_words long, runs binary, items array<string>"


def _scanner(index):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [index.value.scan(x.as_py()) for x in batch.column(1)]
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([_bits(r[1]) for r in rows], pa.binary()),
                    pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string())),
                ],
                ["doc_id", "n_words", "runs", "items"],
            )

    return scan


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(item_id string, words array<string>)``, one row per distinct window of an item."""
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.expr("filter(split(t, '[\\\\x00-\\\\x2F\\\\x3A-\\\\x60\\\\x7B-\\\\x7F]+', -1), x -> x <> '')")
    rows = benchmark.where("item_id is not null").select(
        F.col("item_id").cast("string").alias("item_id"), text.alias("t")
    )
    rows = rows.select("item_id", found.alias("w")).where("size(w) > 0")
    starts = F.expr(f"sequence(1, greatest(size(w) - {window} + 1, 1))")
    return (
        rows.select("item_id", "w", F.explode(starts).alias("at"))
        .select("item_id", F.expr(f"slice(w, at, {window})").alias("words"))
        .distinct()
    )


def _shards(benchmark: DataFrame, window: int, max_windows: int) -> Iterator:
    """Broadcast indexes of at most about ``max_windows`` windows each (at least one index), made
    when they are asked for: whoever asks has done with the one before, which is destroyed."""
    windows = item_windows(benchmark, window)
    n = windows.count()
    shards = max(1, -(-n // max_windows))
    if shards > 1:
        windows = stash(windows, "windows")
    for k in range(shards):
        mine = windows.where(F.pmod(F.xxhash64("words"), F.lit(shards)) == k) if shards > 1 else windows
        rows = [(r.item_id, tuple(w.encode() for w in r.words)) for r in mine.toLocalIterator()]
        index = benchmark.sparkSession.sparkContext.broadcast(Index(rows))
        del rows
        yield index, shards
        if shards > 1:
            index.destroy()


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``doc_id, n_words, runs binary, items array<string>`` for each document.

    ``runs`` holds the runs of hit words as pairs of little-endian 32-bit start and end;
    ``items`` the ids, as strings, of the items with a window in the document.  Shards are
    scanned one after the other, so that no task holds two of them.
    """
    texts = documents(docs)
    out = None
    for index, shards in _shards(benchmark, window, max_windows):
        scan = texts.mapInArrow(_scanner(index), _SCHEMA)
        if shards == 1:
            return scan
        scan = stash(scan, "scan")
        out = scan if out is None else out.unionByName(scan)
    # Shards are scans of the same documents: their runs and items are united.
    return (
        out.groupBy("doc_id")
        .agg(F.max("n_words").alias("n_words"), F.collect_list("runs").alias("r"), F.collect_set("items").alias("i"))
        .mapInArrow(_united, _SCHEMA)
    )


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs, items = [], []
        for n, many, names in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            hit = np.zeros(n, bool)
            for x in many:
                for a, b in np.frombuffer(x, "<i4").reshape(-1, 2).tolist():
                    hit[a:b] = True
            runs.append(_bits(hit))
            items.append(sorted({y for x in names for y in x}))
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(runs, pa.binary()), pa.array(items, pa.list_(pa.string()))],
            ["doc_id", "n_words", "runs", "items"],
        )


def _hit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = [np.frombuffer(x, "<i4").reshape(-1, 2) for x in batch.column(2).to_pylist()]
        items = batch.column(3).to_pylist()
        n_hit = [int((x[:, 1] - x[:, 0]).sum()) for x in runs]
        yield pa.record_batch(
            [
                batch.column(0),
                batch.column(1),
                pa.array(n_hit, pa.int64()),
                pa.array([len(x) for x in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]),
                pa.array([n > 0 for n in n_hit]),
            ],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    A null or empty text has no words and no hits; an item without words (or with a null id)
    has no window; items that repeat an id count once; an empty benchmark hits nothing.
    """
    return hits(docs, benchmark, window, max_windows).mapInArrow(
        _hit_counts,
        "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean",
    )


def _keeper(index, text_at: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [not index.value.scan(x.as_py())[1].any() for x in batch.column(text_at)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return keep


def remove_documents(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS
) -> DataFrame:
    """The rows of ``docs`` without a hit word, all columns kept; no row is moved.

    Each row is judged by its own text, so null and repeated ids need no rule here.
    """
    for index, shards in _shards(benchmark, window, max_windows):
        docs = docs.mapInArrow(_keeper(index, docs.columns.index("text")), docs.schema)
        if shards > 1:
            docs = stash(docs, "clean")
    return docs


def cut_text(text: str, runs: np.ndarray) -> str:
    """``text`` without the runs of hit words; each, with what stands between its words, leaves
    one space."""
    if not len(runs):
        return text
    raw = text.encode()
    plain = np.frombuffer(raw.translate(_TABLE), np.uint8) != 0x20
    edge = np.diff(np.concatenate([[0], plain.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, last = [], 0
    for a, b in runs.tolist():
        out += [raw[last : starts[a]], b" "]
        last = ends[b - 1]
    return b"".join([*out, raw[last:]]).decode()


def _marker(index, text_at: int, runs_at: int):
    """Adds the hit words of one shard to the runs of those before."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, had in zip(batch.column(text_at), batch.column(runs_at).to_pylist(), strict=True):
                hit = index.value.scan(text.as_py())[1]
                for a, b in np.frombuffer(had or b"", "<i4").reshape(-1, 2).tolist():
                    hit[a:b] = True
                out.append(_bits(hit))
            columns = list(batch.columns)
            columns[runs_at] = pa.array(out, pa.binary())
            yield pa.record_batch(columns, batch.schema.names)

    return mark


def _cutter(text_at: int, runs_at: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                None if t is None else cut_text(t, np.frombuffer(r, "<i4").reshape(-1, 2))
                for t, r in zip(batch.column(text_at).to_pylist(), batch.column(runs_at).to_pylist(), strict=True)
            ]
            columns = list(batch.columns)
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.record_batch(columns, batch.schema.names)

    return cut


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` with hit words cut from ``text``; other columns are left as they are.

    Words are judged on the input, so all shards are scanned before any word goes.  A null text
    stays null; each row is judged by its own text.
    """
    names, runs = docs.columns, "__runs"
    while runs in names:
        runs += "_"
    out = docs.withColumn(runs, F.lit(None).cast("binary"))
    text_at, runs_at = names.index("text"), len(names)
    for index, shards in _shards(benchmark, window, max_windows):
        out = out.mapInArrow(_marker(index, text_at, runs_at), out.schema)
        if shards > 1:
            out = stash(out, "marked")
    return out.mapInArrow(_cutter(text_at, runs_at), out.schema).drop(runs)

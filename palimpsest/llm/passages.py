"""Repeated windows of fixed size, found without an index of all windows.

Two removals work on the same skeleton, one over bytes, one over words.  A window is ``size``
consecutive elements of one document, and what is asked is which windows also start earlier
(in a document of smaller doc_id, or earlier in the same one).

1. *Anchors.*  Among the grams (``gram`` consecutive elements) of a window the leftmost one of
   least hash is its anchor.  Equal windows have equal anchors at the same place, and
   neighbouring windows mostly share one, so anchors are few: about two in ``size - gram + 2``
   positions.  Anchors whose hash occurs once in the corpus can't belong to a repeated window.
   Hashes are counted in buckets; what repeats within a task is reduced to one row first.
2. *Segments.*  For an anchor that occurs again, the run of windows that share it becomes one
   segment: its elements, and where it starts.  Equal segments of one task are reduced to the
   earliest; the others are covered at once.  Segments meet by the hash of their anchor, and a
   solver, which differs between the two removals, says which of their windows start earlier.
3. *Hot anchors.*  The segments of an anchor that occurs more than ``HOT`` times (or as often
   as keeps their list within ``MAX_HOT``, which bounds what is broadcast) don't meet in one
   task: their windows are dealt out one by one, by a 128-bit digest, after the same reduction
   within each task.  This is exact up to collisions of that digest.
4. *Coverage.*  Covered windows return to their document, which is cut accordingly.

Anchors are only a way to bring equal windows together: solvers compare the elements.
Tasks handle a few MB of text at a time, and long documents in overlapping pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import stash

HOT = 2000
MAX_HOT = 5_000_000
#: Bits of the filter that keeps texts without coverage from being moved: its size is fixed, and
#: a full one lets all of them pass.
FILTER_BITS = 1 << 25
#: Elements handled at once, and bytes of text between two emissions of a task.
PIECE = 1 << 20
FLUSH = 8 << 20

_MULTIPLIERS = np.array(
    [(0x9E3779B97F4A7C15 * (2 * i + 1) ^ 0xD6E8FEB86659FD93) % 2**64 | 1 for i in range(32)], np.uint64
)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def segments(elements: np.ndarray, lengths: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor, in documents laid end to end.

    Returns document, anchor, first and last window start (both inclusive, in the document)
    and the anchor's hash.  ``gram`` is a power of two.
    """
    n = len(elements)
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    if n < size:
        return none
    grams, have = elements, 1
    while have < gram:
        grams = grams[:-have] * _MULTIPLIERS[have.bit_length()] + grams[have:]
        have *= 2
    grams = mix(grams)
    width = size - gram + 1
    least, at, have = grams, np.arange(len(grams), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        a, b = least[:-step], least[step:]
        later = b < a  # strictly: the leftmost stays
        at = np.where(later, at[step:], at[:-step])
        least = np.minimum(a, b)
        have += step
    ends = np.cumsum(lengths)
    starts = ends - lengths
    doc = np.repeat(np.arange(len(lengths)), lengths)[: n - size + 1]
    valid = np.flatnonzero(np.arange(n - size + 1) + size <= ends[doc])
    if not len(valid):
        return none
    anchor = at[valid]
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.append(first[1:], len(valid)) - 1
    doc, begin = doc[valid[first]], starts[doc[valid[first]]]
    return doc, anchor[first] - begin, valid[first] - begin, valid[last] - begin, grams[anchor[first]]


class Kind:
    """What a removal must say of its elements."""

    size: int
    gram: int

    def elements(self, text: bytes) -> tuple[np.ndarray, object]:
        """An array with one entry per element, and what ``payload`` needs."""
        raise NotImplementedError

    def hashes(self, elements: np.ndarray) -> np.ndarray:
        """An unsigned 64-bit number for each element."""
        raise NotImplementedError

    def payload(self, aid: object, start: int, end: int) -> bytes:
        """The elements from start to end, such that equal elements give equal bytes."""
        raise NotImplementedError

    def cut(self, payload: bytes, n: int) -> int:
        """Where element n of a payload starts."""
        raise NotImplementedError

    def count(self, payload: bytes) -> int:
        """The number of windows in a payload."""
        raise NotImplementedError

    def windows(self, payload: bytes) -> list[bytes]:
        """The windows of a payload, in order."""
        raise NotImplementedError

    def solve(self, runs: list[dict], cover: Callable[[int, int, int], None]) -> None:
        """Cover, in the segments of ``runs`` (see ``encode_run``), the windows that start
        earlier; ``cover(doc_id, first, last)`` takes window starts, both inclusive."""
        raise NotImplementedError


def _pieces(kind: Kind, batch: list[tuple[int, np.ndarray]]) -> Iterator[tuple[list[tuple[int, int]], np.ndarray, np.ndarray]]:
    """Documents laid end to end in groups of about ``PIECE`` elements: (document, offset) and
    length of each part, and the elements.  Parts of one document overlap by a window less one."""
    names: list[tuple[int, int]] = []
    parts: list[np.ndarray] = []
    have = 0
    for i, values in batch:
        for a in range(0, max(len(values) - kind.size + 1, 0), PIECE):
            part = values[a : a + PIECE + kind.size - 1]
            names.append((i, a))
            parts.append(part)
            have += len(part)
            if have >= PIECE:
                yield names, np.array([len(x) for x in parts], np.int64), kind.hashes(np.concatenate(parts))
                names, parts, have = [], [], 0
    if parts:
        yield names, np.array([len(x) for x in parts], np.int64), kind.hashes(np.concatenate(parts))


def _flushes(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[tuple]]:
    rows, have = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c) for c in range(columns)), strict=True):
            row = tuple(x.as_py() for x in row)
            rows.append(row)
            have += len(row[1])
            if have >= FLUSH:
                yield rows
                rows, have = [], 0
    if rows:
        yield rows


def _split(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Columns by bucket: (bucket, column parts..)."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    columns = tuple(c[order] for c in columns)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    for a, b in zip(first, [*first[1:], len(bucket)], strict=True):
        yield int(bucket[a]), *(c[a:b] for c in columns)


_COUNTED = "kind int, bucket int, a binary, b binary, c binary"
_NAMES = ["kind", "bucket", "a", "b", "c"]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch(
        [
            pa.array([r[0] for r in rows], pa.int32()),
            pa.array([r[1] for r in rows], pa.int32()),
            *(pa.array([r[k].tobytes() if k < len(r) else b"" for r in rows], pa.binary()) for k in (2, 3, 4)),
        ],
        _NAMES,
    )


def _spread(docs: np.ndarray, pos: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(docs.astype(np.uint64) * np.uint64(31) + pos.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def _by_doc(docs: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(docs.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)


#: Kinds of counted rows: an anchor seen once in a task, one seen often, a place known to repeat.
_ONCE, _OFTEN, _KNOWN, _HOT = range(4)


def _anchors(kind: Kind, buckets: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _flushes(batches, 2):
            docs, places, hashes = [], [], []
            ids = np.array([r[0] for r in rows], np.int64)
            for names, lengths, values in _pieces(kind, [(i, kind.elements(r[1])[0]) for i, r in enumerate(rows)]):
                doc, anchor, _, _, fp = segments(values, lengths, kind.size, kind.gram)
                at = np.array(names, np.int64)
                docs.append(ids[at[doc, 0]])
                places.append((anchor + at[doc, 1]).astype(np.int32))
                hashes.append(fp)
            if not docs:
                continue
            doc, place, fp = np.concatenate(docs), np.concatenate(places), np.concatenate(hashes)
            _, back, count = np.unique(fp, return_inverse=True, return_counts=True)
            once = count[back] == 1
            often, n = np.unique(fp[~once], return_counts=True)
            out = [
                (_ONCE, *x)
                for x in _split((fp[once] % np.uint64(buckets)).astype(np.int32), fp[once], doc[once], place[once])
            ]
            out += [(_OFTEN, *x) for x in _split((often % np.uint64(buckets)).astype(np.int32), often, n.astype(np.int64))]
            out += [
                (_KNOWN, *x) for x in _split(_spread(doc[~once], place[~once], buckets), doc[~once], place[~once])
            ]
            yield _rows(out)

    return find


def _count(hot: int, buckets: int):
    """Places that repeat, dealt out by document, and hashes by the binary order of their count
    where it exceeds ``hot``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: list[list] = [[], [], []]
        often: list[list] = [[], []]
        places: list[list] = [[], []]
        types = {_ONCE: (once, (np.uint64, np.int64, np.int32)), _OFTEN: (often, (np.uint64, np.int64)), _KNOWN: (places, (np.int64, np.int32))}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                to, kinds = types[row[0]]
                for column, data, t in zip(to, row[2:], kinds, strict=False):
                    column.append(np.frombuffer(data, t))
        join = lambda parts, t: np.concatenate(parts) if parts else np.zeros(0, t)
        fp, doc, place = join(once[0], np.uint64), join(once[1], np.int64), join(once[2], np.int32)
        all_fp = np.concatenate([fp, join(often[0], np.uint64)])
        weight = np.concatenate([np.ones(len(fp), np.int64), join(often[1], np.int64)])
        unique, back = np.unique(all_fp, return_inverse=True)
        total = np.bincount(back, weight, len(unique)).astype(np.int64)
        again = total[back[: len(fp)]] > 1
        doc = np.concatenate([doc[again], join(places[0], np.int64)])
        place = np.concatenate([place[again], join(places[1], np.int32)])
        out = [(0, *x) for x in _split(_by_doc(doc, buckets), doc, place)]
        many = total > hot
        order = np.log2(np.maximum(total[many], 1)).astype(np.int32)
        out += [(_HOT, *x) for x in _split(order, unique[many], total[many])]
        for k in range(0, len(out), 1024):
            yield _rows(out[k : k + 1024])

    return count


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document with the places of its repeated anchors."""
    docs, places = [], []
    for batch in batches:
        docs += [np.frombuffer(x, np.int64) for x in batch.column(0).to_pylist()]
        places += [np.frombuffer(x, np.int32) for x in batch.column(1).to_pylist()]
    if not docs:
        return
    doc, place = np.concatenate(docs), np.concatenate(places)
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    for k in range(0, len(first), 4096):
        begin = first[k : k + 4096]
        end = np.append(first[1:], len(doc))[k : k + 4096]
        yield pa.record_batch(
            [pa.array(doc[begin]), pa.array([place[a:b].tobytes() for a, b in zip(begin, end, strict=True)], pa.binary())],
            ["doc_id", "places"],
        )


#: Kinds of rows that meet: segments, windows of hot anchors, coverage that is known already.
_SEGMENT, _WINDOW, _COVERED = range(3)
_MET = "kind int, bucket int, data binary, lengths binary, doc binary, start binary, anchor binary, fp binary"
_MET_NAMES = ["kind", "bucket", "data", "lengths", "doc", "start", "anchor", "fp"]


def _segments(kind: Kind, buckets: int, hot):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_fps = hot.value
        for rows in _flushes(batches, 3):
            aids, values = [], []
            for r in rows:
                v, aid = kind.elements(r[1])
                aids.append(aid)
                values.append(v)
            best: dict[tuple[bytes, int], tuple] = {}
            window: dict[bytes, tuple[int, int]] = {}
            covered: list[tuple[int, int, int]] = []
            wanted = [np.frombuffer(r[2], np.int32).astype(np.int64) for r in rows]
            for names, lengths, flat in _pieces(kind, list(enumerate(values))):
                doc, anchor, first, last, fp = segments(flat, lengths, kind.size, kind.gram)
                if not len(doc):
                    continue
                at = np.array(names, np.int64)
                row, offset = at[doc, 0], at[doc, 1]
                mine = np.unique(row)
                have = np.concatenate([(i << 32) + wanted[i] for i in mine.tolist()])
                keep = np.flatnonzero(np.isin((row << 32) + anchor + offset, have))
                is_hot = np.isin(fp[keep], hot_fps)
                columns = [x[keep].tolist() for x in (row, anchor + offset, first + offset, last + offset, fp)]
                for i, p, a, b, h, many in zip(*columns, is_hot.tolist(), strict=True):
                    data = kind.payload(aids[i], a, b + kind.size)
                    me = (rows[i][0], a, p, h)
                    key = (data, p - a)
                    other = best.get(key)
                    if other is None:
                        best[key] = (*me, b, many)
                    elif other[:2] <= me[:2]:
                        if other[:2] != me[:2]:
                            covered.append((me[0], a, b))
                    else:
                        covered.append((other[0], other[1], other[4]))
                        best[key] = (*me, b, many)
            met: list[tuple[bytes, int, int, int, int]] = []
            for (data, _), (doc_id, a, p, h, b, many) in best.items():
                if not many:
                    met.append((data, doc_id, a, p, h))
                    continue
                for t, w in enumerate(kind.windows(data)):
                    digest = hashlib.blake2b(w, digest_size=16).digest()
                    other = window.get(digest)
                    if other is None or (doc_id, a + t) < other:
                        window[digest] = (doc_id, a + t)
                        if other is not None:
                            covered.append((other[0], other[1], other[1]))
                    elif other != (doc_id, a + t):
                        covered.append((doc_id, a + t, a + t))
            yield from _met_rows(kind, met, window, covered, buckets)

    return emit


def _met_rows(kind: Kind, met: list, window: dict, covered: list, buckets: int) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    groups: dict[int, list] = {}
    for x in met:
        groups.setdefault(x[4] % buckets, []).append(x)
    for bucket, xs in groups.items():
        out.append((_SEGMENT, bucket, *encode_run(kind, xs)))
    groups = {}
    for digest, (doc, start) in window.items():
        groups.setdefault(int.from_bytes(digest[:8], "little") % buckets, []).append((digest, doc, start))
    for bucket, xs in groups.items():
        doc, start = np.array([x[1] for x in xs], np.int64), np.array([x[2] for x in xs], np.int32)
        out.append((_WINDOW, bucket, b"".join(x[0] for x in xs), b"", doc.tobytes(), start.tobytes(), b"", b""))
    if covered:
        c = np.array(covered, np.int64)
        for bucket, doc, a, b in _split(_by_doc(c[:, 0], buckets), c[:, 0], c[:, 1].astype(np.int32), c[:, 2].astype(np.int32)):
            out.append((_COVERED, bucket, b"", b"", doc.tobytes(), a.tobytes(), b.tobytes(), b""))
    for k in range(0, len(out), 256):
        part = out[k : k + 256]
        yield pa.record_batch(
            [pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.int32())]
            + [pa.array([r[j] for r in part], pa.binary()) for j in range(2, 8)],
            _MET_NAMES,
        )


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    low, high = known, n  # a and b agree before low, and not on all before high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def encode_run(kind: Kind, rows: list[tuple[bytes, int, int, int, int]]) -> tuple[bytes, ...]:
    """A sorted run, front-coded: each row's left context and suffix from its anchor, the suffix
    without what it shares with the one before."""
    cuts = [kind.cut(x[0], x[3] - x[2]) for x in rows]
    keyed = sorted((x[0][cut:], x[0][:cut], x[1], x[2], i) for i, (x, cut) in enumerate(zip(rows, cuts, strict=True)))
    rows = [rows[x[4]] for x in keyed]
    lengths = np.zeros((len(rows), 3), np.int32)  # shared prefix, rest of the suffix, left context
    parts: list[bytes] = []
    last = b""
    for i, (suffix, left, *_) in enumerate(keyed):
        shared = common_prefix(last, suffix) if i else 0
        lengths[i] = shared, len(suffix) - shared, len(left)
        parts += [suffix[shared:], left]
        last = suffix
    return (
        zstandard.ZstdCompressor(level=1).compress(b"".join(parts)),
        lengths.tobytes(),
        np.array([x[1] for x in rows], np.int64).tobytes(),
        np.array([x[2] for x in rows], np.int32).tobytes(),
        np.array([x[3] for x in rows], np.int32).tobytes(),
        np.array([x[4] for x in rows], np.uint64).tobytes(),
    )


def decode_run(row: dict) -> tuple[list, ...]:
    """Shared prefix lengths, suffixes, left contexts, doc_ids, starts, anchors and hashes."""
    lengths = np.frombuffer(row["lengths"], np.int32).reshape(-1, 3).tolist()
    data, at, last = zstandard.ZstdDecompressor().decompress(row["data"]), 0, b""
    shared_of, suffixes, lefts = [], [], []
    for shared, rest, left in lengths:
        last = last[:shared] + data[at : at + rest]
        shared_of.append(shared)
        suffixes.append(last)
        lefts.append(data[at + rest : at + rest + left])
        at += rest + left
    doc = np.frombuffer(row["doc"], np.int64).tolist()
    start = np.frombuffer(row["start"], np.int32).tolist()
    anchor = np.frombuffer(row["anchor"], np.int32).tolist()
    return shared_of, suffixes, lefts, doc, start, anchor, np.frombuffer(row["fp"], np.uint64).tolist()


_RANGES = "doc_id long, ranges binary"


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document with all its covered ranges."""
    columns: list[list] = [[], [], []]
    for batch in batches:
        for column, data, t in zip(columns, batch.columns, (np.int64, np.int32, np.int32), strict=True):
            column += [np.frombuffer(x, t) for x in data.to_pylist()]
    if not columns[0]:
        return
    doc, first, last = (np.concatenate(c) for c in columns)
    order = np.lexsort((first, doc))
    doc, pairs = doc[order], np.stack([first[order], last[order]], axis=1)
    begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    end = np.append(begin[1:], len(doc))
    for k in range(0, len(begin), 4096):
        blobs = [pairs[a:b].tobytes() for a, b in zip(begin[k : k + 4096], end[k : k + 4096], strict=True)]
        yield pa.record_batch([pa.array(doc[begin[k : k + 4096]]), pa.array(blobs, pa.binary())], ["doc_id", "ranges"])


def _solver(kind: Kind, buckets: int):
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])
        parts: list[tuple] = []

        def cover(doc: int, first: int, last: int) -> None:
            out[0].append(doc)
            out[1].append(first)
            out[2].append(last)

        runs, digests, docs, starts = [], [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == _SEGMENT:
                    runs.append(row)
                elif row["kind"] == _WINDOW:
                    digests.append(np.frombuffer(row["data"], "<u8").reshape(-1, 2))
                    docs.append(np.frombuffer(row["doc"], np.int64))
                    starts.append(np.frombuffer(row["start"], np.int32))
                else:
                    parts.append(tuple(np.frombuffer(row[c], t) for c, t in (("doc", np.int64), ("start", np.int32), ("anchor", np.int32))))
        if digests:
            digest, doc, start = np.concatenate(digests), np.concatenate(docs), np.concatenate(starts)
            order = np.lexsort((start, doc, digest[:, 1], digest[:, 0]))
            digest, doc, start = digest[order], doc[order], start[order]
            again = (digest[1:] == digest[:-1]).all(axis=1)
            parts.append((doc[1:][again], start[1:][again], start[1:][again]))
        if runs:
            kind.solve(runs, cover)
        parts.append(tuple(np.array(x, t) for x, t in zip(out, (np.int64, np.int32, np.int32), strict=True)))
        doc, first, last = (np.concatenate([p[k] for p in parts]) for k in range(3))
        rows = [(0, *x) for x in _split(_by_doc(doc, buckets), doc, first, last)]
        for k in range(0, len(rows), 1024):
            yield _rows(rows[k : k + 1024])

    return solve


def cover_group(kind: Kind, group: list[tuple[bytes, int, int, int]], cover: Callable[[int, int, int], None]) -> list[tuple[bytes, int, int, int]]:
    """Of rows (payload, anchor offset, doc_id, start) of one anchor: cover all but the earliest
    of equal ones whole, and return the earliest of each."""
    best: dict[tuple[bytes, int], tuple[int, int]] = {}
    if len(group) == 1:
        return group
    for data, offset, doc, start in group:
        key = (data, offset)
        other = best.get(key)
        if other is None:
            best[key] = (doc, start)
            continue
        if (doc, start) == other:
            continue
        late = max(other, (doc, start))
        best[key] = min(other, (doc, start))
        cover(late[0], late[1], late[1] + kind.count(data) - 1)
    return [(data, offset, *where) for (data, offset), where in best.items()]


def covered(docs: DataFrame, kind: Kind, hot: int = HOT) -> DataFrame:
    """``doc_id, ranges binary``: for documents with covered windows, pairs of first and last
    window start (32-bit).  ``docs`` is ``(doc_id long, text string)``, ids not repeated."""
    spark = docs.sparkSession
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    counted = stash(
        texts.mapInArrow(_anchors(kind, buckets), _COUNTED).repartitionById(buckets, "bucket").mapInArrow(_count(hot, buckets), _COUNTED),
        "anchors",
    )
    hot_rows = counted.where(F.col("kind") == _HOT)
    orders = hot_rows.groupBy("bucket").agg(F.sum(F.length("a") / 8).cast("long").alias("n")).collect()
    limit, have = 64, 0
    for r in sorted(orders, key=lambda r: -r.bucket):  # the largest counts first, as far as they fit
        have += r.n
        if have > MAX_HOT:
            break
        limit = r.bucket
    found = [np.frombuffer(r.a, np.uint64) for r in hot_rows.where(F.col("bucket") >= limit).select("a").toLocalIterator()]
    hot_fps = spark.sparkContext.broadcast(np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64))
    places = (
        counted.where("kind = 0").select("a", "b", "bucket").repartitionById(buckets, "bucket").select("a", "b")
        .mapInArrow(_gather, "doc_id long, places binary")
    )
    met = texts.join(places, "doc_id").select("doc_id", "text", "places").mapInArrow(_segments(kind, buckets, hot_fps), _MET)
    solved = met.repartitionById(buckets, "bucket").mapInArrow(_solver(kind, buckets), _COUNTED)
    back = solved.repartitionById(buckets, "bucket").select("a", "b", "c").mapInArrow(_ranges, _RANGES)
    return stash(back, "covered")


def touched(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document has coverage, joined with its ``ranges``.

    A filter of fixed size over the ids of ``found`` lets most other texts stay where they are;
    the join decides.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    word = found.select(bit.alias("bit")).selectExpr("CAST(bit div 64 AS INT) AS w", "shiftleft(1L, CAST(bit % 64 AS INT)) AS b")
    rows = word.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # at most FILTER_BITS / 64 rows
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64)
    shipped = docs.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf(BooleanType())
    def may_have(bit: pd.Series) -> pd.Series:
        at = bit.to_numpy(np.int64)
        return pd.Series((shipped.value[at >> 6].view(np.uint64) >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1)

    return docs.where(may_have(bit)).join(found, "doc_id")


def mask(ranges: bytes | None, n: int, size: int) -> np.ndarray:
    """Which of n elements lie in a covered window."""
    edge = np.zeros(n + 1, np.int64)
    if ranges:
        pairs = np.frombuffer(ranges, np.int32).reshape(-1, 2)
        edge += np.bincount(pairs[:, 0], minlength=n + 1)
        edge -= np.bincount(pairs[:, 1] + size, minlength=n + 1)
    return np.cumsum(edge[:-1]) > 0

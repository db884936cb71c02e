"""SimHash near-duplicate detection with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each padded with zeros to
the 23 bits of the perfect binary Golay code.  Every 23-bit word lies within distance 3 of
exactly one codeword, and ``keys(v)``, the codewords that ``v`` and its 23 neighbours decode
to, has one or six members.  Two words at distance 2 or less have a common neighbour (or are
neighbours), so they share a key.

At most four errors fall on the three segments:

* if some segment has none, the other two have four or less, so one of them has two or less:
  the exact segment and a Golay key of the other is a shared key (six ordered choices);
* if no segment is free of errors, each has one or two, so the three Golay keys together are
  shared.

Fingerprints that share a key are compared, and those within the distance are linked.  What a
task emits is a spanning forest of the links it has verified, never all pairs of a bucket.
A bucket of more than ``bucket_cap`` fingerprints is not compared in one task: its members go
to an exact second way, where each emits the words at distance 2 or less of itself.  Two
fingerprints within distance 4 share such a midpoint, and sharing one proves the distance, so
a midpoint links all that have it; at most 2,081 fingerprints can.  For a distance below 4 the
members of a midpoint are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, documents, stash

MAX_DISTANCE = 4
SHINGLE_WORDS = 4
SEED = 42
#: (shift, bits) of the three segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Fingerprints whose keys one task makes.
_KEY_ROWS = 16384
#: Generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101

_tables: dict[str, np.ndarray] = {}


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit SimHash of a whole text; zero for a text without words."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if n == 0:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle_words:
        hashes = [digest(line, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: n - shingle_words + 1].tolist()
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle_words - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        block = np.array(hashes[at : at + 65536], ">u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit polynomials modulo the generator: 11 bits."""
    words = words.astype(np.int32, copy=True)
    for bit in range(22, 10, -1):
        words ^= np.where((words >> bit) & 1, GENERATOR << (bit - 11), 0).astype(np.int32)
    return words


def _decoder() -> np.ndarray:
    """By syndrome, the error of weight 3 or less that has it."""
    if "errors" not in _tables:
        bits = 1 << np.arange(23, dtype=np.int32)
        pairs = bits[:, None] | bits[None, :]
        errors = np.unique(np.concatenate([[0], bits, pairs.ravel(), (pairs[:, :, None] | bits).ravel()]))
        table = np.zeros(2048, np.int32)
        table[_syndromes(errors)] = errors
        _tables["errors"] = table
    return _tables["errors"]


def golay_index(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    return (words ^ _decoder()[_syndromes(words)]) >> 11


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word its six key slots, and which of them hold a key (the first, or all six)."""
    near = np.stack([golay_index(words)] + [golay_index(words ^ (1 << b)) for b in range(23)], axis=1)
    near.sort(axis=1)
    first = np.ones(near.shape, bool)
    first[:, 1:] = near[:, 1:] != near[:, :-1]
    slot = np.cumsum(first, axis=1) - 1
    keys = np.zeros((len(words), 6), np.int64)
    row, col = np.nonzero(first)
    keys[row, slot[row, col]] = near[row, col]
    return keys, np.arange(6)[None, :] <= slot[:, -1:]


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(key, index into fps)`` for every key of every fingerprint (see the module)."""
    parts = [((fps >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    golay = [golay_keys(x.astype(np.int32)) for x in parts]
    rows, keys = [], []
    kind = 0
    for exact in range(3):
        for near in range(3):
            if exact != near:
                code, has = golay[near]
                row, col = np.nonzero(has)
                rows.append(row)
                keys.append((kind << 60) | (parts[exact][row] << 12) | code[row, col])
                kind += 1
    (a, has_a), (b, has_b), (c, has_c) = golay
    has = has_a[:, :, None, None] & has_b[:, None, :, None] & has_c[:, None, None, :]
    row, i, j, k = np.nonzero(has)
    rows.append(row)
    keys.append((kind << 60) | (a[row, i] << 24) | (b[row, j] << 12) | c[row, k])
    return np.concatenate(keys), np.concatenate(rows)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(fps), 1024):
            block = fps[at : at + 1024]
            keys, rows = fuzzy_keys(block)
            yield pa.record_batch([pa.array(keys), pa.array(block[rows].view(np.int64))], ["key", "fp"])


def _midpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    one, two = np.triu_indices(64, 1)
    masks = np.concatenate([np.zeros(1, np.uint64), bits, bits[one] | bits[two]])
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(fps), 64):
            block = fps[at : at + 64]
            mid = (block[:, None] ^ masks[None, :]).ravel()
            fp = np.repeat(block, len(masks))
            yield pa.record_batch([pa.array(mid.view(np.int64)), pa.array(fp.view(np.int64))], ["key", "fp"])


class _Forest:
    """Union-find over the fingerprints of one task; keeps the links that joined two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def joins(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _near(group: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within one bucket, by breadth first search: what is
    reached is compared only with what is not yet reached."""
    links, rest = [], group
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            close = np.bitwise_count(rest ^ at) <= distance
            if close.any():
                queue.extend(rest[close])
                links.extend((int(at), int(x)) for x in rest[close])
                rest = rest[~close]
    return links


def _linker(distance: int, cap: int, star: bool):
    """Links within runs of one key, in batches sorted by key and fingerprint.

    Emits ``(a, b)``, and ``(a, null)`` for the members of a bucket above the cap.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, left = _Forest(), (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        hot: set[int] = set()
        hot_key = None

        def runs(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            size = np.diff(np.append(first, len(key)))
            links: list[tuple[int, int]] = []
            for at, n in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
                group = fp[at : at + n]
                if n == 2:
                    a, b = int(group[0]), int(group[1])
                    if a != b and (a ^ b).bit_count() <= distance:
                        links.append((a, b))
                    continue
                group = np.unique(group)
                if star and distance == MAX_DISTANCE:
                    links.extend((int(group[0]), int(x)) for x in group[1:])
                elif not star and len(group) > cap:
                    hot.update(group.tolist())
                else:
                    links.extend(_near(group, distance))
            new = np.array([x for x in links if forest.joins(*x)], np.uint64).reshape(-1, 2).view(np.int64)
            return pa.record_batch([pa.array(new[:, 0]), pa.array(new[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.concatenate([left[0], batch.column(0).to_numpy()])
            fp = np.concatenate([left[1], batch.column(1).to_numpy().view(np.uint64)])
            if hot_key is not None:
                more = int(np.searchsorted(key, hot_key, "right"))
                hot.update(fp[:more].tolist())
                key, fp = key[more:], fp[more:]
                if not len(key):
                    left = key, fp
                    continue
            cut = int(np.searchsorted(key, key[-1]))  # the last run may go on in the next batch
            yield runs(key[:cut], fp[:cut])
            left = key[cut:], fp[cut:]
            if not star and len(left[0]) > 4 * cap:
                hot.update(left[1].tolist())
                hot_key, left = left[0][0], (left[0][:0], left[1][:0])
        yield runs(*left)
        if hot:
            members = np.fromiter(hot, np.uint64, len(hot)).view(np.int64)
            yield pa.record_batch([pa.array(members), pa.nulls(len(members), pa.int64())], ["a", "b"])

    return link


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id long, fp long)``: the SimHash of each document, as a signed long."""
    return documents(docs).mapInArrow(_fingerprints, "doc_id long, fp long")


def links(fps: DataFrame, distance: int = MAX_DISTANCE, bucket_cap: int = 2048) -> DataFrame:
    """``(a long, b long)``: links between the distinct fingerprints ``fps(fp)`` that join the
    same fingerprints as all links within ``distance`` do."""
    if not 0 <= distance <= MAX_DISTANCE:
        raise ValueError(f"distance must be 0 to {MAX_DISTANCE}")
    fps = fps.select("fp").repartition(1 + fps.count() // _KEY_ROWS)  # each row becomes some 185
    keys = fps.mapInArrow(_keys, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    found = stash(keys.mapInArrow(_linker(distance, bucket_cap, False), "a long, b long").distinct(), "fuzzy")
    hot = found.where("b is null").select(F.col("a").alias("fp"))
    found = found.where("b is not null")
    if not hot.isEmpty():
        mid = hot.mapInArrow(_midpoints, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
        found = found.unionByName(mid.mapInArrow(_linker(distance, bucket_cap, True), "a long, b long").where("b is not null").distinct())
    return found


def near_duplicates(docs: DataFrame, distance: int = MAX_DISTANCE, bucket_cap: int = 2048) -> DataFrame:
    """One row per document: ``doc_id long, fingerprint string, component_id long``.

    Words are runs of bytes other than space, tab, newline, vertical tab, form feed and
    carriage return, after A-Z became a-z; a text of fewer than four words is one shingle, and
    a text without words (or null) has fingerprint zero, which links like any other.
    ``component_id`` is the least doc_id that can be reached over links, the document itself
    included.  Equal texts share a fingerprint and are joined before any pair is looked for.
    An empty table gives an empty result.
    """
    fps = stash(fingerprints(docs), "fingerprints")
    each = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(links(each, distance, bucket_cap)).withColumnRenamed("node", "fp")
    of_root = found.join(each, "fp").groupBy("root").agg(F.min("least").alias("component"))
    merged = stash(found.join(of_root, "root").select("fp", "component"), "merged")
    of = stash(
        each.join(merged, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")), "of"
    )
    return fps.join(of, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )

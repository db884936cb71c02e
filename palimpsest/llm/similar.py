"""Near copies by the Jaccard similarity of word shingles: every pair at or above a threshold.

Two ways follow each other; the first is quick and misses some links, the second finds the rest.

1. Min-hash bands.  Each document has ``BANDS`` keys, each of the least values of ``BAND_ROWS``
   hash functions over its shingles.  Two sets of similarity s share a key with probability
   ``1 - (1 - s^8)^40``: 0.999 at 0.8.  Within a bucket of one key the documents are compared with
   its least one, those that stay apart from it with the least of themselves, and so on for
   ``ROUNDS`` rounds: the work follows the rows of a bucket, never its pairs.
2. Prefixes, for what shares no key or stays apart after the last round.  All shingles have one
   order, rare ones first; two sets of similarity t or more share a shingle among the first
   ``n - ceil(t n) + 1`` of each.  Documents that share one there, in different components of the
   first way, and whose sizes and places in the order allow the similarity, are compared.  The
   order comes from counts of shingles by slot of their hash (``SLOTS``, whatever the corpus);
   collisions there cost time, not pairs.  Before shingles are read, parity sketches drop pairs:
   each shingle turns over one bit, so two sketches differ in no more bits than the sets in
   shingles.

What is linked has been compared shingle by shingle, so nothing below the threshold is, and what
is near is in one component, up to collisions of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, components, documents, drop, release, stash, within

SHINGLE_WORDS = 5
SIMILARITY = 0.8
SEED = 42
BANDS = 40
BAND_ROWS = 8
ROUNDS = 3
#: Counts of shingles that decide their order.
SLOTS = 1 << 20
#: Shingles whose values are made at once.
_SHINGLES = 2048
#: Slots whose counts travel together, and shingles that are counted at once.
_BLOCK, _COUNTED = 1 << 14, 1 << 20
#: Parts of all shingles that are shuffled one after the other, so that disk holds one at a time.
PARTS = 8
#: Rows of one shingle that are paired by their distance in the run; longer runs go row by row.
_SHORT = 32
#: Pairs that are written at once.
_PAIRS = 1 << 18

#: One odd multiplier for each hash function, and one for each place in a band.
_FUNCTIONS = np.random.default_rng(SEED).integers(0, 2**63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = np.random.default_rng(SEED + 1).integers(0, 2**63, BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct shingle hashes of a whole text, ascending.

    Words are those of ``simhash``; fewer than ``shingle_words`` of them (or none) are one shingle.
    """
    words = (text or "").encode().lower().split()
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle_words + 1)
    hashes = (digest(b" ".join(words[i : i + shingle_words]), SEED) for i in range(n))
    return np.unique(np.fromiter(hashes, np.uint64, n))


def bands(found: np.ndarray) -> np.ndarray:
    """The keys of a set of shingle hashes, one for each band."""
    least = np.full(len(_FUNCTIONS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _SHINGLES):
        mixed = found[at : at + _SHINGLES, None] * _FUNCTIONS[None, :]
        np.minimum(least, mixed.min(axis=0), out=least)
    least ^= least >> np.uint64(29)
    keys = (least.reshape(BANDS, BAND_ROWS) * _PLACES).sum(axis=1, dtype=np.uint64)
    return (keys + np.arange(BANDS, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)


def _keys(shingle_words: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = [], []
            for text in batch.column(1):
                found = shingles(text.as_py(), shingle_words)
                keys.append(bands(found))
                sizes.append(len(found))
            if keys:
                docs, n = (np.repeat(x, BANDS) for x in (batch.column(0).to_numpy(), np.array(sizes, np.int32)))
                yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(docs), pa.array(n)], ["key", "doc_id", "n"])

    return emit


def _sets(shingle_words: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x.as_py(), shingle_words).tobytes() for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "found"])

    return make


def _judge(ratio: Fraction):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * (ratio.numerator + ratio.denominator) >= ratio.numerator * (len(x) + len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return judge


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SLOTS - 1)).astype(np.int64)


def _counter(shingle_words: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(SLOTS, np.int64), [], 0
        for batch in batches:
            for text in batch.column(1):
                held.append(shingles(text.as_py(), shingle_words))
                n += len(held[-1])
                if n >= _COUNTED:
                    total += np.bincount(_slots(np.concatenate(held)), minlength=SLOTS)
                    held, n = [], 0
        if held:
            total += np.bincount(_slots(np.concatenate(held)), minlength=SLOTS)
        if total.any():
            blocks = [x.tobytes() for x in total.reshape(-1, _BLOCK)]
            yield pa.record_batch([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], ["block", "counts"])

    return count


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros(_BLOCK, np.int64)
    for x in table.column("counts"):
        total += np.frombuffer(x.as_buffer(), np.int64)
    ranks = np.minimum(8 * np.log2(total + 1), 255).astype(np.uint8)
    return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "ranks": pa.array([ranks.tobytes()], pa.binary())})


def _ranks(texts: DataFrame, shingle_words: int) -> np.ndarray:
    """For each slot, eight steps for each doubling of the documents that have shingles of it."""
    blocks = texts.mapInArrow(_counter(shingle_words), "block int, counts binary").groupBy("block").applyInArrow(_add, "block int, ranks binary")
    out = np.zeros(SLOTS, np.uint8)
    for r in blocks.collect():
        out[r.block * _BLOCK : (r.block + 1) * _BLOCK] = np.frombuffer(r.ranks, np.uint8)
    return out


def _prefixes(ranks, shingle_words: int, ratio: Fraction):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prefixes = [], []
            for text in batch.column(1):
                found = shingles(text.as_py(), shingle_words)
                n = len(found)
                order = np.lexsort((found, ranks.value[_slots(found)]))
                prefixes.append(found[order[: n - -(-ratio.numerator * n // ratio.denominator) + 1]].tobytes())
                sizes.append(n)
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.binary())], ["doc_id", "n", "prefix"])

    return make


def _places(part: int):
    """A row for each shingle of each prefix that is in this of ``PARTS`` parts; ``size`` is the
    document's and, below it, the place."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                some = batch.slice(start, 1024)
                doc, n, root = (some.column(i).to_numpy() for i in (0, 1, 3))
                found = [np.frombuffer(x.as_buffer(), np.uint64) for x in some.column(2)]
                each = np.array([len(x) for x in found])
                tokens = np.concatenate(found)
                at = np.arange(len(tokens)) - np.repeat(np.cumsum(each) - each, each)
                of = np.repeat(np.arange(len(found)), each)
                here = np.flatnonzero((tokens >> np.uint64(32)) % np.uint64(PARTS) == part)
                of, at = of[here], at[here]
                columns = [tokens[here].view(np.int64), n[of] << 32 | at, doc[of], root[of]]
                yield pa.record_batch([pa.array(x) for x in columns], ["token", "size", "doc_id", "root"])

    return places


def _crossing(ratio: Fraction):
    """``(a, b)`` of different components that share a shingle of their prefixes, of rows sorted by
    shingle and size, if both the sizes and what follows the shared shingle leave enough."""
    num, den = ratio.numerator, ratio.denominator

    def pairs(rows: np.ndarray, x, y) -> np.ndarray:
        """The pairs of rows x with rows y."""
        (n, m), (i, j) = (rows[1, x] >> 32, rows[1, y] >> 32), (rows[1, x] & 0xFFFFFFFF, rows[1, y] & 0xFFFFFFFF)
        keep = (rows[3, x] != rows[3, y]) & (np.minimum(n, m) * den >= np.maximum(n, m) * num)
        keep &= np.minimum(n - i, m - j) * (num + den) >= num * (n + m)
        a, b = (np.broadcast_to(rows[2, z], keep.shape)[keep] for z in (x, y))
        return np.stack([np.minimum(a, b), np.maximum(a, b)])

    def runs(rows: np.ndarray) -> Iterator[np.ndarray]:
        first = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1]]))
        size = np.diff(np.append(first, rows.shape[1]))
        after = np.repeat(first + size, size) - np.arange(rows.shape[1]) - 1  # rows of the run behind each
        short = np.repeat(size <= _SHORT, size)
        for step in range(1, _SHORT):
            x = np.flatnonzero(short & (after >= step))
            if not len(x):
                break
            yield pairs(rows, x, x + step)
        for at, n in zip(first[size > _SHORT].tolist(), size[size > _SHORT].tolist(), strict=True):
            # Nothing is paired within the component that most rows are of; the rest meet it and each other.
            run = rows[:, at : at + n]
            of = np.unique(run[3], return_inverse=True)[1]
            most = np.bincount(of).argmax()
            mass, others = run[:, of == most], run[:, of != most]
            for x in range(others.shape[1]):
                for side in (mass, others[:, x + 1 :]):
                    low, high = np.searchsorted(side[1] >> 32, [-(-(others[1, x] >> 32) * num // den), (others[1, x] >> 32) * den // num + 1])
                    if low < high:
                        yield pairs(np.concatenate([others[:, x : x + 1], side[:, low:high]], axis=1), 0, slice(1, None))

    def batch_of(found: list[np.ndarray]) -> pa.RecordBatch:
        a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        """The rows, no run of a shingle divided."""
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(i).to_numpy() for i in range(4)])
            held.append(rows)
            if held[0][0, 0] != rows[0, -1]:
                rows = np.concatenate(held, axis=1)
                cut = int(np.searchsorted(rows[0], rows[0, -1]))
                yield rows[:, :cut]
                held = [rows[:, cut:]]
        if held:
            yield np.concatenate(held, axis=1)

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for rows in whole(batches):
            for some in runs(rows):
                if some.shape[1]:
                    found.append(some)
                    n += some.shape[1]
                if n >= _PAIRS:
                    yield batch_of(found)
                    found, n = [], 0
        yield batch_of(found)

    return cross


def sketch(found: np.ndarray) -> np.ndarray:
    """One bit for each shingle or more, a power of two and 64 at least; each shingle turns one over."""
    bits = 1 << max(6, (len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """The bits in which two sketches differ, the longer one folded: at most the shingles that
    one of the sets has and the other has not."""
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _sketches(shingle_words: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x.as_py(), shingle_words) for x in batch.column(1)]
            sizes, bits = pa.array([len(x) for x in found], pa.int64()), pa.array([sketch(x).tobytes() for x in found], pa.binary())
            yield pa.record_batch([batch.column(0), sizes, bits], ["doc_id", "n", "bits"])

    return make


def _hopeful(ratio: Fraction):
    """Pairs whose sketches do not rule out that they are similar enough."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, x, y in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                far = differing(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))
                keep.append(far * (ratio.numerator + ratio.denominator) <= n * (ratio.denominator - ratio.numerator))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return judge


def _crosslinks(texts: DataFrame, of: DataFrame, shingle_words: int, ratio: Fraction) -> DataFrame:
    """All links between the components ``of(node, root)``."""
    spark = texts.sparkSession
    of = of.select(F.col("node").alias("doc_id"), "root")
    ranks = spark.sparkContext.broadcast(_ranks(texts, shingle_words))
    prefixes = texts.mapInArrow(_prefixes(ranks, shingle_words, ratio), "doc_id long, n long, prefix binary")
    prefixes = prefixes.join(of, "doc_id", "left").select("doc_id", "n", "prefix", F.coalesce("root", "doc_id").alias("root"))
    prefixes = stash(prefixes, "prefixes")
    ranks.destroy()
    pairs = None
    for part in range(PARTS):
        places = prefixes.mapInArrow(_places(part), "token long, size long, doc_id long, root long")
        runs = places.repartition("token").sortWithinPartitions("token", "size")
        found = stash(runs.mapInArrow(_crossing(ratio), "a long, b long").distinct(), "cross")
        pairs = found if pairs is None else pairs.unionByName(found)
        del places, runs
        release(spark)  # what was shuffled is the largest of this step
    drop(prefixes)
    pairs = stash(pairs.distinct(), "pairs")
    ids = stash(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    release(spark)
    drawn = stash(within(texts, "doc_id", ids).mapInArrow(_sketches(shingle_words), "doc_id long, n long, bits binary"), "sketches")
    x, y = (drawn.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
    both = pairs.join(x, "a").join(y, "b").select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "bits_a", "bits_b")
    with arrow_rows(spark, 1024):
        hopeful = stash(both.mapInArrow(_hopeful(ratio), "a long, b long"), "hopeful")
    del pairs, ids, drawn, x, y, both
    release(spark)
    return _verified(texts, hopeful, shingle_words, ratio, "cross")


def _verified(texts: DataFrame, pairs: DataFrame, shingle_words: int, ratio: Fraction, what: str) -> DataFrame:
    """The pairs ``(a, b)`` whose shingle sets are similar enough."""
    pairs = stash(pairs.distinct(), f"{what}-pairs")
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = stash(texts.join(ids, "doc_id", "left_semi").mapInArrow(_sets(shingle_words), "doc_id long, found binary"), f"{what}-sets")
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("found").alias("x")), "a")
    both = both.join(sets.select(F.col("doc_id").alias("b"), F.col("found").alias("y")), "b").select("a", "b", "x", "y")
    with arrow_rows(texts.sparkSession, 512):
        return stash(both.mapInArrow(_judge(ratio), "a long, b long"), f"{what}-links")


def _banded(texts: DataFrame, shingle_words: int, ratio: Fraction, rounds: int) -> DataFrame:
    """The links that bands and leaders find."""
    keys = rest = stash(texts.mapInArrow(_keys(shingle_words), "key long, doc_id long, n int"), "keys")
    out = None
    for _ in range(rounds):
        # The least document of each bucket of several; partially aggregated, so large buckets are no matter.
        first = rest.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("first"), F.max("doc_id").alias("last"))
        first = first.where(F.col("first.doc_id") < F.col("last")).select("key", F.col("first.doc_id").alias("a"), F.col("first.n").alias("n_a"))
        rest = stash(rest.join(first, "key").where(F.col("doc_id") > F.col("a")), "buckets")
        may = F.least("n", "n_a") * ratio.denominator >= F.greatest("n", "n_a") * ratio.numerator  # sizes allow it
        pairs = rest.where(may).select("a", F.col("doc_id").alias("b"))
        found = _verified(texts, pairs if out is None else pairs.distinct().join(out, ["a", "b"], "left_anti"), shingle_words, ratio, "near")
        out = found if out is None else out.unionByName(found)
        apart = rest.join(out.select("a", F.col("b").alias("doc_id")), ["a", "doc_id"], "left_anti")
        rest = stash(apart.select("key", "doc_id", "n"), "apart")
        del first, may, pairs, found, apart
        release(texts.sparkSession)
        if rest.isEmpty():
            break
    drop(keys)
    return out


def _links(docs: DataFrame, shingle_words: int, similarity: float, rounds: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The links of the first way, their components, and the links of the second way."""
    ratio = Fraction(str(similarity))
    if shingle_words < 1 or rounds < 1 or not 0 < ratio <= 1:
        raise ValueError("shingle_words and rounds must be positive, similarity above 0 and at most 1")
    texts = documents(docs)
    near = _banded(texts, shingle_words, ratio, rounds)
    release(docs.sparkSession)
    of = stash(components(near), "near-components")
    release(docs.sparkSession)
    cross = _crosslinks(texts, of, shingle_words, ratio)
    release(docs.sparkSession)
    return near, of, cross


def links(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, rounds: int = ROUNDS) -> DataFrame:
    """``(a long, b long)``: pairs of doc_ids of at least ``similarity`` that join the same
    documents as all such pairs do."""
    near, _, cross = _links(docs, shingle_words, similarity, rounds)
    return near.unionByName(cross)


def copies(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id long, component_id long)`` of the documents that are not the least of their
    component of similar texts."""
    _, found, cross = _links(docs, shingle_words, similarity, ROUNDS)
    if not cross.isEmpty():
        found = components(found.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(cross))
    return found.where("node <> root").select(F.col("node").alias("doc_id"), F.col("root").alias("component_id"))

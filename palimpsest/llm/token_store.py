"""A content-addressed store of token ids.

Each document is encoded, its end id appended, and its ids are cut into chunks where a rolling
hash over the last eight ids says so, so that equal passages give equal chunks.  The store has
three Parquet tables under one folder:

* ``parts/part=chunks(digest, data)``: every distinct chunk once, under the SHA-256 of its bytes; ids are
  little-endian, two bytes each if the vocabulary allows it, else four;
* ``recipes(i, doc_id, start, n_tokens, recipe)`` in ascending doc_id order: which chunks make
  up the document, how many ids all documents before it have, and its rank;
* ``manifest(level, block, digest)``: a Merkle tree over the recipes, ``FANOUT`` children each.

Reading verifies the digest of every chunk, the lengths, and the tree.  A CRC-32 of whole
documents needs no chunk to be moved: each chunk is read and summed up once where it lies, and
the sums are combined along the recipes.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, documents, drop, give_back, new_dir, release, settings_of, stash

END_ID = 2
MIN_IDS, AVERAGE_IDS, MAX_IDS = 64, 256, 1024
WINDOW_IDS = 8
FANOUT = 1024
#: Buckets for remembered words in a worker, their places, and the ids that each can hold: 36 MB, whatever the corpus.
_BUCKETS = 1 << 18
_WAYS = 4
_SLOT_IDS = 8
#: Words encoded at once, bytes of text that share one list of different words, and digests a task remembers.
_BLOCK_WORDS = 4096
_PART_BYTES = 2 << 20
_SEEN = 100_000
#: Documents and chunks (of 32 bytes) in a range of recipes, if there are fewer ranges than partitions.
_RANGE = 4096
#: Ids whose rolling hash is taken at once.
_MARK_IDS = 1 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)

#: A run of ASCII punctuation without apostrophes between a Latin letter and a space or the end.
_AFTER_LETTER = "([a-z\u00df-\u00f6\u00f8-\u00ff])([!-&(-/:-@\\[-`{-~]+)( |$)"

_encoders: dict[int, WordEncoder] = {}


def _byte_letters() -> list[str]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for
    itself, the others counted up from 256."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = [], 256
    for b in range(256):
        if b in kept:
            out.append(chr(b))
        else:
            out.append(chr(more))
            more += 1
    return out


def settings(tokenizer_json: str) -> dict:
    """What an encoder asks of the file besides the model, whose parsed form is large."""
    said = json.loads(tokenizer_json)
    kinds = [x["type"] for x in (said.get("normalizer") or {}).get("normalizers", [])]
    return {"added_tokens": said.get("added_tokens", []), "normalizers": kinds}


class WordEncoder:
    """Encodes texts with a ``tokenizers`` file whose pre-tokenizer never crosses a space, and
    sets punctuation after a (Latin) letter apart, as patterns of letters, digits and other
    characters do.

    Such a tokenizer gives a text the ids of its words.  Words are remembered in a table of
    fixed size, under 128 bits of a hash with a seed of this process, in the bucket its hash
    gives, and leave it in turn when it is full; a word that has left is encoded again.  What is held besides
    follows the part of a text at hand (``_PART_BYTES``), never a whole text or corpus.
    """

    def __init__(self, tokenizer_json: str, said: dict | None = None) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        said = said or settings(tokenizer_json)
        added = said["added_tokens"]
        self.added = sorted((x["content"] for x in added), key=len, reverse=True)
        self.added_ids = {x["content"]: x["id"] for x in added}
        # Added tokens that are found as they are, before anything else, cut a text in independent parts.
        self.cuts_texts = not any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in added)
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if added else None
        # After these normalizers a lower-case word of letters is one pre-token.
        self.plain = set(said["normalizers"]) == {"NFC", "Replace", "Lowercase"}
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.seed = int.from_bytes(os.urandom(8), "little")
        self.one, self.two = np.zeros((_BUCKETS, _WAYS), np.uint64), np.zeros(_BUCKETS * _WAYS, np.uint64)  # zeros: free
        self.counts = np.zeros(_BUCKETS * _WAYS, np.uint8)
        self.turn = np.zeros(_BUCKETS, np.uint8)  # the place of each bucket that is taken next
        wide = self.tokenizer.get_vocab_size(True) > 65536
        self.ids = np.zeros((_BUCKETS * _WAYS, _SLOT_IDS), np.uint32 if wide else np.uint16)

    def _words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        out: list[list[int]] = [[]] * len(words)
        rest: list[int] = []
        tokenize, letters = self.model.tokenize, self.letters
        for i, w in enumerate(words):
            if self.plain and w.isalpha():
                if w.isascii():
                    out[i] = [t.id for t in tokenize(w)]
                    continue
                low = unicodedata.normalize("NFC", w)
                if "\u03a3" not in low and "\u0130" not in low:  # their lower case depends on what is around
                    low = low.lower()
                    if low.isalpha():
                        out[i] = [t.id for t in tokenize("".join([letters[b] for b in low.encode()]))]
                        continue
            rest.append(i)
        for k in range(0, len(rest), _BLOCK_WORDS):
            block = rest[k : k + _BLOCK_WORDS]
            found = self.tokenizer.encode(" ".join([words[i] for i in block]), add_special_tokens=False)
            starts = np.cumsum([0] + [len(words[i]) + 1 for i in block[:-1]])
            offsets = np.array([a for a, _ in found.offsets], np.int64)
            ends = np.cumsum(np.bincount(np.searchsorted(starts, offsets, "right") - 1, minlength=len(block))).tolist()
            ids, last = found.ids, 0
            for i, end in zip(block, ends, strict=True):
                out[i] = ids[last:end]
                last = end
        return out

    def _look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First place and number of ids of each of some different words, and the ids."""
        strings, seed, digest = words.to_numpy(zero_copy_only=False).tolist(), self.seed, xxhash.xxh3_128_digest
        keys = np.frombuffer(b"".join([digest(w, seed) for w in strings]), np.uint64)
        one, two = keys[::2].copy(), keys[1::2].copy()
        bucket = (one & np.uint64(_BUCKETS - 1)).astype(np.int32)
        here = self.one[bucket] == one[:, None]
        slot = bucket * _WAYS + here.argmax(axis=1)
        known = here.any(axis=1) & (self.two[slot] == two)
        old, new = np.flatnonzero(known), np.flatnonzero(~known)
        count = np.zeros(len(strings), np.int32)
        count[old] = self.counts[slot[old]]
        found = self._words([strings[i] for i in new.tolist()])
        count[new] = np.fromiter(map(len, found), np.int32, len(found))
        held = self.ids[slot[old]][np.arange(_SLOT_IDS) < count[old][:, None]]
        fresh = np.fromiter(chain.from_iterable(found), self.ids.dtype, int(count[new].sum()))
        first = np.zeros(len(strings), np.int32)
        first[old] = np.cumsum(count[old]) - count[old]
        first[new] = len(held) + np.cumsum(count[new]) - count[new]
        ids = np.concatenate([held, fresh])
        keep = new[count[new] <= _SLOT_IDS]
        keep = keep[np.argsort(bucket[keep], kind="stable")]
        mine = bucket[keep]
        begin = np.flatnonzero(np.concatenate([np.ones(min(len(mine), 1), bool), mine[1:] != mine[:-1]]))
        size = np.diff(np.append(begin, len(mine)))
        rank = np.arange(len(mine)) - np.repeat(begin, size)
        at = (mine * _WAYS + (self.turn[mine] + rank) % _WAYS)[rank < _WAYS]
        self.turn[mine[begin]] += np.minimum(size, _WAYS).astype(np.uint8)
        keep = keep[rank < _WAYS]
        self.one.reshape(-1)[at], self.two[at], self.counts[at] = one[keep], two[keep], count[keep]
        if len(ids):
            self.ids[at] = ids[np.minimum(first[keep][:, None] + np.arange(_SLOT_IDS), len(ids) - 1)]
        return first, count, ids

    @staticmethod
    def _spread(split: pa.Array, at: np.ndarray, first: np.ndarray, count: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of lists of words, laid end to end, and where each list's start."""
        count = count[at]
        end = np.cumsum(count, dtype=np.int32)  # of a few MB of text
        flat = ids[np.repeat(first[at] - (end - count), count) + np.arange(int(end[-1]) if len(end) else 0, dtype=np.int32)]
        offsets = split.offsets.to_numpy()
        return flat, np.concatenate([np.zeros(1, np.int32), end])[offsets - offsets[0]]

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a string array without nulls, and where each text's start."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        # Each different word is cut further, into letters and the punctuation after them.
        inner = pc.ascii_lower(coded.dictionary) if self.plain else coded.dictionary
        inner = pc.split_pattern(pc.replace_substring_regex(inner, _AFTER_LETTER, "\\1 \\2\\3") if self.plain else inner, " ")
        parts = inner.flatten().dictionary_encode()
        ids, cut = self._spread(inner, parts.indices.to_numpy(), *self._look_up(parts.dictionary))
        flat, cut = self._spread(split, coded.indices.to_numpy(), cut[:-1], np.diff(cut), ids)
        whole = np.zeros(len(texts), bool)
        for x in self.added:
            whole |= pc.match_substring(texts, x, ignore_case=True).to_numpy(zero_copy_only=False)
        if whole.any():
            parts = [flat[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            for i in np.flatnonzero(whole).tolist():
                parts[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, self.ids.dtype)
            flat, cut = np.concatenate(parts), np.cumsum([0] + [len(x) for x in parts])
        return flat, cut.astype(np.int64)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        flat, cut = self.encode_flat(texts)
        return [flat[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def encode_long(self, text: bytes) -> np.ndarray:
        """The ids of one text, part by part: parts end before a space or newline, or where an
        added token starts or ends."""
        out: list[np.ndarray] = []
        pieces = [text]
        if self.added_pattern is not None and self.added_pattern.search(text.decode()):
            if not self.cuts_texts:
                return self.encode(pa.array([text.decode()]))[0]
            pieces = [x.encode() for x in self.added_pattern.split(text.decode())]
        for i, piece in enumerate(pieces):
            if i % 2:
                out.append(np.array([self.added_ids[piece.decode()]], np.uint32))
                continue
            for a, b in spaced_parts(piece):
                out.append(self.encode_flat(pa.array([piece[a:b]], pa.string()))[0])
        return np.concatenate(out) if out else np.zeros(0, self.ids.dtype)


def spaced_parts(text: bytes, size: int | None = None) -> Iterator[tuple[int, int]]:
    """Start and end of consecutive parts of about ``size`` bytes that start with a space or
    newline (but the first); a part without any is as long as it is."""
    size, a = size or _PART_BYTES, 0
    while a < len(text):
        b = a + size
        if b >= len(text):
            b = len(text)
        else:
            at = max(text.rfind(x, a + 1, b) for x in (b" ", b"\n"))
            if at < 0:
                after = [x for x in (text.find(b" ", b), text.find(b"\n", b)) if x >= 0]
                at = min(after) if after else len(text)
            b = at
        yield a, b
        a = b


def marks(ids: np.ndarray) -> np.ndarray:
    """Where a chunk may end: after each window of ``WINDOW_IDS`` ids whose hash says so."""
    out = [np.zeros(0, np.int64)]
    for a in range(0, len(ids) - WINDOW_IDS + 1, _MARK_IDS):
        part = ids[a : a + _MARK_IDS + WINDOW_IDS - 1]
        n = len(part) - WINDOW_IDS + 1
        mixed = (part.astype(np.uint64) + np.uint64(1)) * _PRIME
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        rolled = mixed[:n].copy()
        for j in range(1, WINDOW_IDS):
            rolled *= _PRIME
            rolled += mixed[j : n + j]
        out.append(np.flatnonzero((rolled >> np.uint64(40)) % np.uint64(AVERAGE_IDS - MIN_IDS) == 0) + (WINDOW_IDS + a))
    return np.concatenate(out)


def fold(at: list[int], n: int) -> list[int]:
    """Ends of the chunks of n ids, from the places where a chunk may end."""
    out, last = [], 0
    for mark in at:
        while mark - last > MAX_IDS:
            last += MAX_IDS
            out.append(last)
        if mark - last >= MIN_IDS:
            out.append(mark)
            last = mark
    while n - last > MAX_IDS:
        last += MAX_IDS
        out.append(last)
    return out if last == n else [*out, n]


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document's ids."""
    return fold(marks(ids).tolist(), len(ids))


#: Texts of some kB are read and sent in small batches, so that no array of a batch takes many MB of an executor's heap.
_WRITING = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.parquet.columnarReaderBatchSize": "512",
    "spark.sql.maxConcurrentOutputFileWriters": "2",
}

#: Rows of new chunks (without a document) and of documents (without a chunk), which travel together.
_STAGED = "digest binary, data binary, doc_id long, n_tokens long, recipe array<binary>"


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows in groups of about ``_PART_BYTES`` of text; a longer text is a group of its own."""
    end = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < batch.num_rows:
        have = end[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(end, have + _PART_BYTES, "right")))
        yield batch.slice(a, b - a)
        a = b


def _stager(tokenizer_json, key: int, end_id: int, width: str):
    """Rows of the chunks that are new in this task, and of documents."""

    def chunk_rows(digests: list, new: list) -> pa.RecordBatch:
        n = len(new)
        return pa.record_batch(
            [pa.array(digests, pa.binary()), pa.array(new, pa.binary()), *(pa.nulls(n, pa.int64()) for _ in range(2)), pa.nulls(n, pa.list_(pa.binary()))],
            _STAGED_NAMES,
        )

    def document_rows(docs: pa.Array, sizes: np.ndarray, recipe: list, n_recipe: list) -> pa.RecordBatch:
        recipes = pa.ListArray.from_arrays(pa.array(n_recipe, pa.int32()), pa.array(recipe, pa.binary()))
        none = pa.nulls(len(sizes), pa.binary())
        return pa.record_batch([none, none, docs, pa.array(sizes, pa.int64()), recipes], _STAGED_NAMES)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(key)
        if encoder is None:
            _encoders.clear()
            encoder = _encoders[key] = WordEncoder(*tokenizer_json.value)
        seen: set[bytes] = set()
        sha256, step = hashlib.sha256, np.dtype(width).itemsize
        for whole in batches:
            for batch in _parts(whole):
                if batch.num_rows == 1 and pc.binary_length(batch.column(1))[0].as_py() > _PART_BYTES:
                    flat = encoder.encode_long(batch.column(1)[0].as_buffer().to_pybytes())
                    cut = np.array([0, len(flat)])
                else:
                    flat, cut = encoder.encode_flat(batch.column(1))
                sizes = np.diff(cut) + 1
                ids = np.full(len(flat) + len(sizes), end_id, width)
                for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                    ids[a + i : b + i] = flat[a:b]
                del flat
                ends = np.cumsum(sizes)
                at = marks(ids)
                first = np.searchsorted(at, ends - sizes + WINDOW_IDS).tolist()
                last = np.searchsorted(at, ends, "right").tolist()
                data = memoryview(ids).cast("B")
                recipe, n_recipe, new, digests, have = [], [0], [], [], 0
                for start, size, a, b in zip((ends - sizes).tolist(), sizes.tolist(), first, last, strict=True):
                    done = start
                    for end in fold((at[a:b] - start).tolist(), size):
                        chunk = data[done * step : (start + end) * step].tobytes()  # pa.array never lets go of what a view views
                        digest = sha256(chunk).digest()
                        recipe.append(digest)
                        if digest not in seen:
                            if len(seen) >= _SEEN:
                                seen.clear()
                            seen.add(digest)
                            digests.append(digest)
                            new.append(chunk)
                            have += len(chunk)
                            if have > _PART_BYTES:
                                yield chunk_rows(digests, new)
                                digests, new, have = [], [], 0
                        done = start + end
                    n_recipe.append(len(recipe))
                if new:
                    yield chunk_rows(digests, new)
                yield document_rows(batch.column(0), sizes, recipe, n_recipe)
                del ids, data, at, recipe, digests, new
            give_back()

    return stage


def _forget() -> None:
    """Later stages run in the same Python workers, and need no encoder."""
    _encoders.clear()
    give_back()


_STAGED_NAMES = ["digest", "data", "doc_id", "n_tokens", "recipe"]


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents as they are, and the first row of each digest; rows come sorted by
    digest, those of documents first."""
    _forget()
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        n = batch.column(0).null_count
        keep = np.ones(batch.num_rows, bool)
        if n < batch.num_rows:
            rows = np.frombuffer(b"".join(batch.column(0)[n:].to_pylist()), np.uint64).reshape(-1, 4)
            keep[n + 1 :] = (rows[1:] != rows[:-1]).any(axis=1)
            keep[n] = last is None or bool((rows[0] != last).any())
            last = rows[-1].copy()
        kinds = pa.array(np.where(np.arange(batch.num_rows) < n, "documents", "chunks"))
        yield pa.record_batch([*batch.columns, kinds], [*_STAGED_NAMES, "part"]).filter(pa.array(keep))


def _ranges(most: int, n_docs: int, n_ids: int) -> int:
    """Into how many ranges, each a file, recipes are cut: one for each ``_RANGE`` documents and
    chunks, up to the session's number of partitions."""
    return max(1, min(most, -(-(n_docs + n_ids // AVERAGE_IDS) // _RANGE)))


def _ranger(bounds):
    """Rows with the number of bounds at or below their doc_id."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.searchsorted(bounds.value, batch.column(0).to_numpy(), "right").astype(np.int32)
            yield pa.record_batch([*batch.columns, pa.array(part)], [*batch.schema.names, "part"])

    return ranges


def _placer(before):
    """Rank and first id of each document: rows come by range and doc_id, ``before`` has the
    documents and ids of all ranges before each."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        at: dict[int, tuple[int, int]] = dict(before.value)
        for batch in batches:
            part = batch.column("part").to_numpy()
            size = batch.column("n_tokens").to_numpy()
            rank, start = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
            for p in np.unique(part).tolist():
                mine = np.flatnonzero(part == p)
                d, t = at[p]
                rank[mine] = d + np.arange(len(mine))
                start[mine] = t + np.cumsum(size[mine]) - size[mine]
                at[p] = d + len(mine), t + int(size[mine].sum())
            yield pa.record_batch(
                [pa.array(rank), batch.column("doc_id"), pa.array(start), batch.column("n_tokens"), batch.column("recipe")],
                ["i", "doc_id", "start", "n_tokens", "recipe"],
            )

    return place


def _part(spark: SparkSession, path: str, name: str) -> str:
    """The folder of one kind of rows, made if no row was of it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/parts/part={name}")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
    return f"{path}/parts/part={name}"


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """``digest, data``: every distinct chunk of the store once."""
    return spark.read.schema(_STAGED).parquet(_part(spark, path, "chunks")).select("digest", "data")


def write(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, vocabulary: int | None = None
) -> None:
    """Encode all documents and write the store to ``path``.

    Null and empty texts have the end id alone; an empty table gives an empty store.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    if vocabulary is None:
        from tokenizers import Tokenizer

        vocabulary = max(Tokenizer.from_str(text).get_vocab(True).values()) + 1
    width = "<u2" if max(vocabulary, end_id + 1) <= 65536 else "<u4"
    shipped = spark.sparkContext.broadcast((text, settings(text)))
    stager = _stager(shipped, zlib.crc32(text.encode()), end_id, width)
    # One shuffle brings equal chunks together; documents are dealt out with them.
    met = documents(docs).mapInArrow(stager, _STAGED).repartition(F.coalesce("digest", F.col("doc_id").cast("string").cast("binary")))
    met = met.sortWithinPartitions("digest").mapInArrow(_once, f"{_STAGED}, part string")
    with settings_of(spark, _WRITING):
        met.write.option("compression", "zstd").partitionBy("part").parquet(f"{path}/parts")
    del met
    release(spark)  # its shuffle files are as large as the ids

    ids = spark.read.schema(_STAGED).parquet(_part(spark, path, "documents"))
    all_docs, all_ids = ids.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    parts = _ranges(int(spark.conf.get("spark.sql.shuffle.partitions")), all_docs, all_ids)
    # Any bounds are right; these make even ranges.  A sketch of fixed size comes to the driver.
    bounds = ids.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 1 / (4 * parts)) if parts > 1 else []
    ranger = _ranger(spark.sparkContext.broadcast(np.unique(np.array(bounds, np.float64).astype(np.int64))))
    sized = ids.select("doc_id", "n_tokens").mapInArrow(ranger, "doc_id long, n_tokens long, part int")
    sizes = sized.groupBy("part").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).orderBy("part").collect()
    docs_before, ids_before, before = 0, 0, {}
    for r in sizes:  # one row for each range
        before[r.part] = docs_before, ids_before
        docs_before, ids_before = docs_before + r.n, ids_before + r.t
    shipped = spark.sparkContext.broadcast(before)
    ranged = ids.select("doc_id", "n_tokens", "recipe").mapInArrow(ranger, "doc_id long, n_tokens long, recipe array<binary>, part int")
    recipes = ranged.repartitionById(parts, "part").sortWithinPartitions("part", "doc_id").mapInArrow(
        _placer(shipped), "i long, doc_id long, start long, n_tokens long, recipe array<binary>"
    )
    recipes.write.option("compression", "zstd").parquet(f"{path}/recipes")
    drop(ids)
    merkle(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")


def merkle(recipes: DataFrame) -> DataFrame:
    """``manifest(level, block, digest)``: level 0 has a digest for each ``FANOUT`` recipes, and
    each level above one for each ``FANOUT`` of the level below, up to a single root."""
    chunks = F.array_join(F.transform("recipe", lambda d: F.hex(d)), ",")
    leaf = F.sha2(F.concat_ws("|", "doc_id", "start", "n_tokens", chunks), 256)
    level = recipes.select("i", leaf.alias("digest"))
    out, depth = None, 0
    while True:
        up = level.groupBy(F.floor(F.col("i") / FANOUT).cast("long").alias("i")).agg(F.sort_array(F.collect_list(F.struct("i", "digest"))).alias("c"))
        up = stash(up.select("i", F.sha2(F.array_join(F.transform("c", lambda x: x["digest"]), ","), 256).alias("digest")), "merkle")
        rows = up.select(F.lit(depth).alias("level"), F.col("i").alias("block"), "digest")
        out = rows if out is None else out.unionByName(rows)
        if up.count() <= 1:
            return out
        level, depth = up, depth + 1


@functools.cache
def _crc_tables() -> np.ndarray:
    """By number of ids n and byte of a CRC-32: what appending n zero ids makes of that byte."""
    one = np.zeros(32, np.uint32)  # the operator of one zero byte, by bit
    for bit in range(32):
        c = 1 << bit
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        one[bit] = c

    def apply(op: np.ndarray, to: np.ndarray) -> np.ndarray:
        out = np.zeros_like(to)
        for bit in range(32):
            out ^= np.where((to >> np.uint32(bit)) & np.uint32(1), op[bit], np.uint32(0)).astype(np.uint32)
        return out

    four = one
    for _ in range(3):
        four = apply(one, four)
    ops = np.zeros((MAX_IDS + 1, 32), np.uint32)
    ops[0] = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for n in range(1, MAX_IDS + 1):
        ops[n] = apply(four, ops[n - 1])
    table = np.zeros((MAX_IDS + 1, 4, 256), np.uint32)
    for byte in range(256):
        for bit in range(8):
            if byte >> bit & 1:
                table[:, :, byte] ^= ops.reshape(-1, 4, 8)[:, :, bit]
    return table


def _summer(width: str):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        step = np.dtype(width).itemsize
        sha256, crc32 = hashlib.sha256, zlib.crc32
        for batch in batches:
            digests, column = batch.column(0).to_pylist(), batch.column(1)
            size = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
            raw = memoryview(b"".join(column.to_pylist()))
            wide = memoryview(np.frombuffer(raw, width).astype("<u4").tobytes())
            ends = np.cumsum(size)
            crc = []
            for digest, a, b in zip(digests, (ends - size).tolist(), ends.tolist(), strict=True):
                if sha256(raw[a:b]).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} does not have its digest")
                crc.append(crc32(wide[a // step * 4 : b // step * 4]))
            yield pa.record_batch(
                [batch.column(0), pa.array(size // step, pa.int32()), pa.array(crc, pa.int64())], ["digest", "n", "crc"]
            )

    return sums


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The CRC-32 of each document from those of its chunks, chunk after chunk for all at once."""
    tables = _crc_tables()
    for batch in batches:
        parts = batch.column(3)
        flat = parts.flatten()
        size = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(size) - size
        n = flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
        part = flat.field(2).to_numpy(zero_copy_only=False).astype(np.uint32)
        total = np.add.reduceat(n, first) if len(n) else n
        wrong = np.flatnonzero(total != batch.column(2).to_numpy())
        if len(wrong):
            raise ValueError(f"document {batch.column(0)[int(wrong[0])]} has another number of ids than its chunks")
        crc = np.zeros(len(size), np.uint32)
        live = np.arange(len(size))
        for k in range(int(size.max(initial=0))):
            live = live[size[live] > k]
            at = first[live] + k
            c, m = crc[live], n[at]
            t = tables[m, 0, c & 255] ^ tables[m, 1, c >> 8 & 255] ^ tables[m, 2, c >> 16 & 255] ^ tables[m, 3, c >> 24]
            crc[live] = t ^ part[at]
        yield pa.record_batch([*batch.columns[:3], pa.array(crc.astype(np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32"])


def verify(spark: SparkSession, path: str) -> None:
    """Raise unless the Merkle tree of the recipes is the one in the manifest."""
    had = spark.read.parquet(f"{path}/manifest")
    now = merkle(spark.read.parquet(f"{path}/recipes"))
    key = ["level", "block", "digest"]
    if not had.join(now, key, "left_anti").isEmpty() or not now.join(had, key, "left_anti").isEmpty():
        raise ValueError("the recipes do not have the digests of the manifest")


def read_sums(spark: SparkSession, path: str, width: str = "<u2") -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files of the store."""
    with arrow_rows(spark, 1000):
        sums = stash(chunks(spark, path).mapInArrow(_summer(width), "digest binary, n int, crc long"), "sums")
    recipes = spark.read.parquet(f"{path}/recipes")
    refs = recipes.select("doc_id", "start", "n_tokens", F.posexplode("recipe").alias("pos", "digest"))
    met = refs.join(sums, "digest", "left").select(
        "doc_id", "start", "n_tokens", F.struct("pos", F.coalesce("n", F.raise_error(F.lit("a chunk is missing")).cast("int")).alias("n"), "crc").alias("p")
    )
    each = met.groupBy("doc_id", "start", "n_tokens").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return each.mapInArrow(_combine, "doc_id long, start long, n_tokens long, ids_crc32 long")


def reconstruct(spark: SparkSession, path: str, width: str = "<u2") -> DataFrame:
    """``doc_id, ids array<int>`` of every document, rebuilt from recipes and chunks."""
    refs = spark.read.parquet(f"{path}/recipes").select("doc_id", F.posexplode("recipe").alias("pos", "digest"))
    met = refs.join(chunks(spark, path), "digest")
    each = met.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "data"))).alias("p"))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(b"".join(p["data"] for p in x), width).astype(np.int32) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return each.mapInArrow(ids, "doc_id long, ids array<int>")


def report(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Write the store, verify it, and return ``read_sums`` of it."""
    spark = docs.sparkSession
    path = path or new_dir(spark, "store")
    write(docs, path, tokenizer_path)
    verify(spark, path)
    return read_sums(spark, path)

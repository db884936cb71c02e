"""Repeated phrases over words by sharded Aho-Corasick automata.

On the skeleton of ``passages``, the segments of one anchor meet in one shard.  There the
windows that occur in two or more different segments are confirmed word by word, the confirmed
phrases are compiled into automata of at most ``MAX_PHRASES`` each, and the segments of the
shard, which hold every place of the corpus where such a phrase can be, are streamed through
them; each occurrence but the earliest is covered.  A phrase goes into one automaton only and
meets only segments with its anchor, so the work follows the repeated text, not shards times
corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents
from .passages import HOT, Kind, cover_group, covered, decode_run, mask, touched

SIZE = 20
GRAM = 8
#: Phrases in one automaton, at about a kilobyte each.
MAX_PHRASES = 40_000
_CACHE = 500_000


class Words(Kind):
    def __init__(self, size: int = SIZE, gram: int = GRAM, max_phrases: int = MAX_PHRASES) -> None:
        if gram > size or gram & (gram - 1):
            raise ValueError("gram must be a power of two, and at most the size")
        self.size, self.gram, self.max_phrases = size, gram, max_phrases
        self.cache: dict[bytes, int] = {}

    def elements(self, text: bytes) -> tuple[np.ndarray, object]:
        words = text.split()
        cache = self.cache
        if len(cache) > _CACHE:
            cache.clear()
        digest = xxhash.xxh64_intdigest
        for w in set(words).difference(cache):
            cache[w] = digest(w)
        return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)), words

    def hashes(self, elements: np.ndarray) -> np.ndarray:
        return elements

    def payload(self, aid: object, start: int, end: int) -> bytes:
        return b" ".join(aid[start:end])

    def cut(self, payload: bytes, n: int) -> int:
        at = 0
        for _ in range(n):
            at = payload.index(b" ", at) + 1
        return at

    def count(self, payload: bytes) -> int:
        return payload.count(b" ") + 2 - self.size

    def windows(self, payload: bytes) -> list[bytes]:
        words = payload.split(b" ")
        return [b" ".join(words[i : i + self.size]) for i in range(len(words) - self.size + 1)]

    def solve(self, runs: list[dict], cover: Callable[[int, int, int], None]) -> None:
        groups: dict[int, list[tuple[bytes, int, int, int]]] = {}
        for run in runs:
            _, suffixes, lefts, doc, start, anchor, fp = decode_run(run)
            for i, h in enumerate(fp):
                groups.setdefault(h, []).append((lefts[i] + suffixes[i], anchor[i] - start[i], doc[i], start[i]))
        ids: dict[bytes, int] = {}
        phrases: list[tuple[int, ...]] = []
        shard: list[tuple[tuple[int, ...], int, int]] = []
        for group in groups.values():
            group = cover_group(self, group, cover)
            if len(group) == 1:
                continue
            segments = [
                (tuple([ids.setdefault(w, len(ids) + 1) for w in data.split(b" ")]), doc, start)
                for data, _, doc, start in group
            ]
            seen: dict[tuple[int, ...], int] = {}
            for words, _, _ in segments:
                for t in range(len(words) - self.size + 1):
                    key = words[t : t + self.size]
                    seen[key] = seen.get(key, 0) + 1
            confirmed = [key for key, n in seen.items() if n > 1]
            if confirmed:
                phrases += confirmed
                shard += segments
            if len(phrases) >= self.max_phrases:
                self._stream(phrases, shard, cover)
                phrases, shard, ids = [], [], {}
        if phrases:
            self._stream(phrases, shard, cover)

    def _stream(self, phrases: list, shard: list, cover: Callable[[int, int, int], None]) -> None:
        import ahocorasick

        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for i, phrase in enumerate(phrases):
            automaton.add_word(phrase, i)
        automaton.make_automaton()
        first: list[tuple[int, int] | None] = [None] * len(phrases)
        found = []
        for words, doc, start in shard:
            for end, i in automaton.iter(words):
                me = (doc, start + end - self.size + 1)
                found.append((i, me))
                if first[i] is None or me < first[i]:
                    first[i] = me
        for i, me in found:
            if first[i] != me:
                cover(me[0], me[1], me[1])


def _cutter(size: int, keep_text: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, removed, digests, texts = [], [], [], []
            for text, ranges in zip(batch.column(1), batch.column(2), strict=True):
                words, ranges = text.as_py().split(), ranges.as_py()
                n_words.append(len(words))
                if ranges:
                    keep = ~mask(ranges, len(words), size)
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                removed.append(n_words[-1] - len(words))
                kept = b" ".join(words)
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode())
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                columns.append(pa.array(texts, pa.string()))
                names.append("kept")
            yield pa.record_batch(columns, names)

    return cut


def remove_repeats(
    docs: DataFrame, size: int = SIZE, gram: int = GRAM, hot: int = HOT, max_phrases: int = MAX_PHRASES, keep_text: bool = False
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256`` (and ``kept string``,
    the remaining words joined by one space, on demand).

    Every word covered by a window of ``size`` words that also starts earlier is removed: in a
    document of smaller doc_id, or earlier in the same one; windows are judged on the input.
    Null and empty texts have no words; texts of fewer words than a window lose none; an empty
    table gives an empty result.
    """
    texts = documents(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    found = covered(texts, Words(size, gram, max_phrases), hot)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    cutter = _cutter(size, keep_text)
    cut = touched(texts, found).select("doc_id", "text", "ranges").mapInArrow(cutter, schema)
    # All other documents lose nothing, and their texts stay where they are.
    whole = texts.select("doc_id", "text", F.lit(None).cast("binary").alias("ranges")).mapInArrow(cutter, schema)
    names = [c for c in cut.columns if c != "doc_id"]
    cut = cut.select("doc_id", F.struct(*names).alias("cut"))
    best = F.coalesce("cut", F.struct(*names))
    return whole.join(cut, "doc_id", "left").select("doc_id", best.alias("best")).select("doc_id", "best.*")

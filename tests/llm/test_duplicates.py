"""SimHash, repeated bytes and repeated words, against brute force."""

import random

import brute
import numpy as np
import pytest
import xxhash
from palimpsest.llm import passages, phrase_dedup, simhash, suffix_dedup
from palimpsest.llm.common import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_components(prints, distance=4):
    up = {i: i for i in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def check_simhash(rows, docs):
    prints = {r[0]: plain_fingerprint(r[1]) for r in rows}
    want = plain_components(prints)
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    assert len(got) == len(prints)


def test_simhash(odd, docs_rows):
    check_simhash(docs_rows, odd)


def test_simhash_untidy_and_empty(untidy, nothing, docs_rows):
    check_simhash(docs_rows, untidy)  # of id 11 the greatest text counts
    assert simhash.near_duplicates(nothing).collect() == []


def test_golay_keys_meet():
    r = np.random.default_rng(2)
    a = r.integers(0, 2**64, 500, dtype=np.uint64)
    for errors in range(5):
        b = a.copy()
        for i in range(len(b)):
            for bit in r.choice(64, errors, replace=False):
                b[i] ^= np.uint64(1) << np.uint64(bit)
        keys = [set() for _ in range(2 * len(a))]
        for offset, x in ((0, a), (len(a), b)):
            k, i = simhash.fuzzy_keys(x)
            for key, row in zip(k.tolist(), i.tolist()):
                keys[offset + row].add(key)
        assert all(keys[i] & keys[len(a) + i] for i in range(len(a)))


@pytest.mark.parametrize("cap", [2, 2048])
def test_links_of_a_dense_group(spark, cap):
    r = random.Random(9)
    base = r.getrandbits(64)
    prints = {base}
    for _ in range(60):
        x = r.choice(sorted(prints))
        for b in r.sample(range(64), r.randint(1, 6)):
            x ^= 1 << b
        prints.add(x)
    signed = sorted(x - (x >> 63 << 64) for x in prints)
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bucket_cap=cap)
    for a, b in links.collect():
        assert ((a ^ b) % 2**64).bit_count() <= 4
    got = {r.node: r.root for r in components(links).collect()}
    want = plain_components({x: x % 2**64 for x in signed})
    assert {x: got.get(x, x) for x in signed} == want


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


@pytest.mark.parametrize("hot", [1, 4, 2000])
def test_byte_repeats(odd, docs_rows, hot):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(odd, hot=hot).collect()}
    assert got == brute.byte_repeats([x[:2] for x in docs_rows])


@pytest.mark.parametrize("hot", [1, 4, 2000])
def test_word_repeats(odd, docs_rows, hot):
    rows = phrase_dedup.remove_repeats(odd, hot=hot, max_phrases=9).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == brute.word_repeats([x[:2] for x in docs_rows])


def test_repeats_untidy_and_empty(untidy, nothing, docs_rows):
    rows = [x[:2] for x in docs_rows]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(untidy).collect()}
    assert got == brute.byte_repeats(rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in phrase_dedup.remove_repeats(untidy).collect()}
    assert got == brute.word_repeats(rows)
    assert suffix_dedup.remove_repeats(nothing).collect() == [] and phrase_dedup.remove_repeats(nothing).collect() == []


def test_kept_text(odd):
    import hashlib

    for r in suffix_dedup.remove_repeats(odd, keep_text=True).collect():
        assert len(r.kept) == r.n_bytes - r.n_removed and hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
    for r in phrase_dedup.remove_repeats(odd, keep_text=True).collect():
        assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 or r.n_words == 0


def test_merge_of_front_coded_runs():
    r = random.Random(4)
    for _ in range(200):
        runs = []
        for _ in range(r.randint(0, 7)):
            strings = sorted(bytes(r.choice(b"ab") for _ in range(r.randint(0, 9))) for _ in range(r.randint(0, 8)))
            runs.append(([0] + [passages.common_prefix(a, b) for a, b in zip(strings, strings[1:])], strings))
        out = list(suffix_dedup.merge(runs))
        merged = [runs[k][1][i] for k, i, _ in out]
        assert merged == sorted(x for _, s in runs for x in s)
        assert [p for *_, p in out[1:]] == [passages.common_prefix(a, b) for a, b in zip(merged, merged[1:])]


def test_runs_keep_their_rows():
    kind = suffix_dedup.Bytes(10, 4)
    rows = [(b"aaabcdefghijk", 5, 2, 4, 7), (b"abcdefghij", 1, 0, 0, 7), (b"zzzzzzzzzzz", 2, 9, 10, 3)]
    got = dict(zip(("data", "lengths", "doc", "start", "anchor", "fp"), passages.encode_run(kind, rows)))
    _, suffixes, lefts, doc, start, anchor, fp = passages.decode_run(got)
    assert sorted(zip((a + b for a, b in zip(lefts, suffixes)), doc, start, anchor, fp)) == sorted(rows)


def test_anchors_do_not_depend_on_pieces(monkeypatch):
    kind = suffix_dedup.Bytes()
    r = random.Random(8)
    text = bytes(r.choice(b"abc ") for _ in range(5000)) + b"a" * 700

    def all_windows():
        out = {}
        for names, lengths, flat in passages._pieces(kind, [(0, kind.elements(text)[0])]):
            doc, anchor, first, last, fp = passages.segments(flat, lengths, kind.size, kind.gram)
            for d, p, a, b, h in zip(doc, anchor, first, last, fp.tolist()):
                for w in range(a, b + 1):
                    out[w + names[d][1]] = (p + names[d][1], h)
        return out

    whole = all_windows()
    assert sorted(whole) == list(range(len(text) - kind.size + 1))
    monkeypatch.setattr(passages, "PIECE", 333)
    assert all_windows() == whole

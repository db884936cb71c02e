"""Near copies by shingles, against brute force."""

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa

import corpus_pipeline
from palimpsest.llm import simhash, similar


def plain_shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def plain_groups(rows):
    sets = {r[0]: plain_shingles(r[1]) for r in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) * 9 >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def edited_rows(seed=3):
    """Texts with one to twelve words changed, so that similarities lie on both sides of 0.8."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(25):
        base = [word() for _ in range(r.randint(40, 300))]
        for _ in range(8):
            w = list(base)
            for _ in range(r.randint(0, 12)):
                w[r.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w[: r.randint(len(w) * 8 // 10, len(w))])))
    return rows


def test_links(spark, docs_rows):
    for rows in (edited_rows(), [x[:2] for x in docs_rows]):
        want = plain_groups(rows)
        got = similar.copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
        assert {r.doc_id: r.component_id for r in got} == {i: g for i, g in want.items() if i != g} and len(got) > 20


def test_pairs_that_share_no_band(spark):
    """Eight of ten shingles in common, and not one key: bands alone leave them apart."""
    rows = [(2 * i + k, f"{'ab'[k]} " + " ".join(f"w{i}x{j}" for j in range(12))) for i in (802, 1320, 2686, 7982) for k in (0, 1)]
    for (_, x), (_, y) in zip(rows[::2], rows[1::2], strict=True):
        assert not (similar.bands(similar.shingles(x)) == similar.bands(similar.shingles(y))).any()
    got = similar.copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(rows[k + 1][0], rows[k][0]) for k in (0, 2, 4, 6)}


def crowded_rows(seed=1):
    """120 texts with much in common that are no near copies, and after them ten that are, each of
    which shares its keys with many of the others."""
    r = random.Random(seed)
    base = [f"w{i}" for i in range(1000)]

    def edited(words, n):
        out = list(words)
        for at in r.sample(range(len(out)), n):
            out[at] = f"x{r.random()}"
        return out

    texts = [edited(base, 26) for _ in range(120)] + [edited(base, 10) for _ in range(10)]
    return [(i, " ".join(x)) for i, x in enumerate(texts)]


def test_more_leaders_than_rounds(spark):
    rows = crowded_rows()
    want = plain_groups(rows)
    assert {i: g for i, g in want.items() if i != g} == dict.fromkeys(range(121, 130), 120)
    got = similar.copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == dict.fromkeys(range(121, 130), 120)


def test_runs_of_one_shingle():
    """Rows of one shingle in batches and runs of any length, against all pairs."""
    r, ratio = random.Random(5), Fraction(4, 5)
    rows = sorted((t, (n << 32) | r.randrange(n), 1000 * t + k, r.choice([-1, -1, 1000 * t + k])) for t in range(9) for k in range(20 * t) for n in [r.randint(5, 14)])
    table = pa.table([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["token", "size", "doc_id", "root"])
    want = set()
    for k, (t, x, a, root) in enumerate(rows):
        for u, y, b, other in rows[k + 1 :]:
            n, m = x >> 32, y >> 32
            left = min(n - x % 2**32, m - y % 2**32)
            if t == u and root != other and 5 * n >= 4 * m and 9 * left >= 4 * (n + m):
                want.add((min(a, b), max(a, b)))
    for size in (1, 7, 10_000):
        got = [p for x in similar._crossing(ratio)(iter(table.to_batches(size))) for p in zip(*(c.to_pylist() for c in x.columns), strict=True)]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_sketches_never_differ_in_more_than_the_sets():
    r = np.random.default_rng(2)
    for n in (1, 5, 63, 64, 65, 300, 5000):
        x = np.unique(r.integers(0, 2**63, n, np.uint64))
        y = np.unique(np.concatenate([x[: max(1, len(x) * 5 // 6)], r.integers(0, 2**63, 1 + n // 4, np.uint64)]))
        assert similar.differing(similar.sketch(x), similar.sketch(x)) == 0
        assert 0 < similar.differing(similar.sketch(x), similar.sketch(y)) <= len(np.setxor1d(x, y))
        assert similar.differing(similar.sketch(y), similar.sketch(x)) == similar.differing(similar.sketch(x), similar.sketch(y))


def test_nothing(nothing):
    assert similar.copies(nothing).collect() == []


def test_pipeline_has_no_near_copies_left(spark, tmp_path):
    rows = edited_rows()
    docs = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], "doc_id long, text string, __first_id int, __copy_id int, token int")
    found = simhash.near_duplicates(docs).collect()
    left = [(i, t) for i, t in rows if i in {r.doc_id for r in found if r.doc_id == r.component_id}]
    assert any(i != g for i, g in plain_groups(left).items())  # what four bits miss
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    got = stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and {x.doc_id for x in got.collect()} == set(plain_groups(left).values())
    assert stage(spark, docs.where("false"), str(tmp_path)).collect() == []

"""Packing, token store, chat formatting and the pipeline."""

import hashlib
import itertools
import random
import zlib

import brute
import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from palimpsest.llm import chat, packing, token_store
from palimpsest.llm.common import new_dir, settings_of, stash
from pyspark.sql import functions as F
from test_duplicates import plain_components, plain_fingerprint
from test_similar import plain_groups

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_boundaries_are_optimal():
    r = random.Random(2)
    for _ in range(300):
        h = {r.randint(1, 40): r.randint(1, 9) for _ in range(r.randint(1, 9))}
        k = r.randint(1, 5)
        got = packing.boundaries(h, k)
        lengths = sorted(h)
        waste = lambda ends: sum(n * (min(e for e in ends if e >= x) - x) for x, n in h.items())
        best = min(waste((*c, lengths[-1])) for m in range(k) for c in itertools.combinations(lengths[:-1], m))
        assert len(got) <= k and waste(got) == best
    assert packing.boundaries({}, 3) == []


def check_packing(rows, n_buckets, budget):
    lengths = {r.doc_id: r.n_tokens for r in rows}
    ends = sorted({(r.bucket, r.bucket_tokens) for r in rows})
    for (bucket, size), (_, below) in zip(ends, [(0, 0), *ends]):
        mine = sorted((r for r in rows if r.bucket == bucket), key=lambda r: r.doc_id)
        fit = max(1, budget // size)
        assert [(r.batch, r.slot) for r in mine] == [divmod(i, fit) for i in range(len(mine))]
        assert all(below < r.n_tokens <= size for r in mine)
    assert len(ends) <= n_buckets
    return lengths


def test_packing(odd, untidy, nothing, docs_rows):
    want = {x[0]: brute.quality(x[1])[0] + 1 for x in docs_rows}
    for docs in (odd, untidy):
        rows = packing.pack_documents(docs, 4, 300).collect()
        assert check_packing(rows, 4, 300) == want
    assert packing.pack_documents(nothing).collect() == []


def test_long_lengths_are_exact(spark):
    lengths = [1, 4097, 8193, 8193, 100_003, 100_004, 2**40 + 1]
    rows = packing.pack(spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_tokens long"), 5).collect()
    assert {r.n_tokens: r.bucket_tokens for r in rows} == {n: 100_004 if n == 100_003 else n for n in lengths}


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


def test_word_encoder():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        encoder = token_store.WordEncoder(f.read())
    r = random.Random(1)
    letters = list("ab'stReévĀİßΣς \n\t\r\x1c　.,12ñ́̈한😀") + ["<|endoftext|>", "<|ENDOFTEXT|>", "<|end", " can't ", "É"]
    for _ in range(600):
        texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(5)]
        assert [x.tolist() + [2] for x in encoder.encode(pa.array(texts))] == plain_ids(texts)


def test_words_that_polynomial_hashes_confuse():
    """Thue-Morse words and their complements have equal polynomial hashes modulo 2^64."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        encoder = token_store.WordEncoder(f.read())
    for n in (16, 1024, 4096):
        one = "".join("ab"[i.bit_count() & 1] for i in range(n))
        two = one.translate(str.maketrans("ab", "ba"))
        for text in (one, two, one + " " + two):  # each in a batch of its own
            assert [encoder.encode(pa.array([text]))[0].tolist() + [2]] == plain_ids([text])


def test_words_leave_a_full_table(monkeypatch):
    monkeypatch.setattr(token_store, "_BUCKETS", 4)
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        encoder = token_store.WordEncoder(f.read())
    r = random.Random(4)
    words = ["".join(r.choice("abcdeé,") for _ in range(r.randint(1, 12))) for _ in range(90)]
    for _ in range(60):
        texts = [" ".join(r.choices(words, k=r.randint(0, 30))) for _ in range(3)]
        assert [x.tolist() + [2] for x in encoder.encode(pa.array(texts))] == plain_ids(texts)


def test_long_texts_in_parts(spark, monkeypatch):
    r = random.Random(6)
    letters = ["abc", "é", "x<|endoftext|>", "<|startoftext|>", "1", "'s", "...", "\u0301"] + [" ", "\n"] * 3
    monkeypatch.setattr(token_store, "_PART_BYTES", 40)
    monkeypatch.setattr(token_store, "_MARK_IDS", 16)
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        encoder = token_store.WordEncoder(f.read())
    for _ in range(60):
        text = "".join(r.choices(letters, k=r.randint(0, 200)))
        assert [encoder.encode_long(text.encode()).tolist() + [2]] == plain_ids([text])
        parts = list(token_store.spaced_parts(text.encode()))
        assert [0, *(b for _, b in parts)][: len(parts)] == [a for a, _ in parts]
    ids = np.random.default_rng(3).integers(0, 50_000, 9000).astype(np.uint16)
    some = token_store.marks(ids).tolist()
    monkeypatch.undo()
    assert some == token_store.marks(ids).tolist()
    # A text longer than a part, with many chunks of its own, beside short ones.
    rows = [(1, "a b"), (2, " ".join(str(i) + "w" * (i % 7) for i in range(250_000))), (3, None)]
    ids = plain_ids([x[1] for x in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {x.doc_id: tuple(x)[1:] for x in token_store.report(docs, public_tokenizers.path("word_bpe_49k.json")).collect()}
    start = np.cumsum([0] + [len(x) for x in ids]).tolist()
    assert got == {x[0]: (s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for x, s, i in zip(rows, start, ids)}


_MEMORY = """
import sys, resource
import pyarrow as pa
from palimpsest.llm import token_store
path = sys.argv[1]
class Shipped:
    with open(path, encoding="utf-8") as f:
        value = (f.read(),)
stage = token_store._stager(Shipped, 1, 2, "<u2")
def batches():
    yield pa.record_batch([pa.array([1]), pa.array(["a b c"])], ["doc_id", "text"])
    base.append(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
    yield pa.record_batch([pa.array([2]), pa.array([" ".join("w%x" % (i * 2654435761 % 2**32) for i in range(700_000))])], ["doc_id", "text"])
base = []
n = sum(x.nbytes for x in stage(batches()))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base[0]) / 1024)
"""


def test_memory_of_a_long_text_without_repeated_words():
    """7 MB of text, all words different."""
    import subprocess
    import sys

    done = subprocess.run([sys.executable, "-c", _MEMORY, public_tokenizers.path("word_bpe_49k.json")], capture_output=True, text=True, check=True)
    assert float(done.stdout) < 200


def test_stages_keep_no_ids():
    """What a worker holds after some texts doesn't grow with the texts it has encoded."""
    import tracemalloc

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        shipped = type("Shipped", (), {"value": (f.read(),)})
    stage = token_store._stager(shipped, 2, 2, "<u2")
    r = random.Random(12)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(2000)]
    held, n_ids = [], 0

    def batches():
        for i in range(6):
            texts = [" ".join(r.choices(words, k=2000)) for _ in range(100)]
            yield pa.record_batch([pa.array(range(i * 100, i * 100 + 100)), pa.array(texts)], ["doc_id", "text"])
            held.append(tracemalloc.get_traced_memory()[0])  # before the next texts

    tracemalloc.start()
    try:
        for rows in stage(batches()):
            n_ids += sum(rows.column("n_tokens").drop_null().to_pylist())
    finally:
        tracemalloc.stop()
        token_store._forget()
    assert n_ids > 1_200_000 and held[-1] - held[0] < n_ids  # of some 2 bytes each


def test_cuts():
    r = np.random.default_rng(3)
    a, b = r.integers(0, 50_000, 4000).astype(np.uint32), r.integers(0, 50_000, 3000).astype(np.uint32)
    for ids in (a, b, a[:64], a[:1], np.concatenate([b[:777], a]), np.zeros(5000, np.uint32)):
        ends = token_store.cuts(ids)
        assert ends[-1] == len(ids) and all(0 < y - x <= token_store.MAX_IDS for x, y in zip([0, *ends], ends))
    pieces = lambda ids: {ids[x:y].tobytes() for x, y in zip([0, *token_store.cuts(ids)], token_store.cuts(ids))}
    assert len(pieces(a) & pieces(np.concatenate([b[:777], a]))) > 0.7 * len(pieces(a))


def test_store_round_trip(spark, odd, untidy, nothing, docs_rows):
    ids = plain_ids([x[1] for x in docs_rows])
    starts = np.cumsum([0] + [len(x) for x in ids]).tolist()
    want = {x[0]: (s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for x, s, i in zip(docs_rows, starts, ids)}
    path = new_dir(spark, "test-store")
    token_store.write(odd, path, public_tokenizers.path("word_bpe_49k.json"))
    token_store.verify(spark, path)
    assert {r.doc_id: tuple(r)[1:] for r in token_store.read_sums(spark, path).collect()} == want
    assert {r.doc_id: r.ids for r in token_store.reconstruct(spark, path).collect()} == {x[0]: i for x, i in zip(docs_rows, ids)}
    chunks = token_store.chunks(spark, path)
    assert chunks.count() == chunks.select("digest").distinct().count()
    got = token_store.report(untidy, public_tokenizers.path("word_bpe_49k.json"))
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want
    assert token_store.report(nothing, public_tokenizers.path("word_bpe_49k.json")).collect() == []


@pytest.mark.parametrize("size", [token_store._RANGE, 4])
def test_ranges_follow_the_size(spark, odd, docs_rows, monkeypatch, size):
    """A small table's recipes are in one file, however many partitions there are; any number of ranges is right."""
    monkeypatch.setattr(token_store, "_RANGE", size)
    ids = plain_ids([x[1] for x in docs_rows])
    starts = np.cumsum([0] + [len(x) for x in ids]).tolist()
    path = new_dir(spark, "test-store")
    with settings_of(spark, {"spark.sql.shuffle.partitions": "7"}):
        token_store.write(odd, path, public_tokenizers.path("word_bpe_49k.json"))
    rows = spark.read.parquet(f"{path}/recipes")
    assert len(rows.where("i >= 0").inputFiles()) == (1 if size > 4 else 7)
    assert [tuple(x) for x in rows.select("i", "doc_id", "start", "n_tokens").orderBy("i").collect()] == [
        (k, x[0], s, len(i)) for k, (x, s, i) in enumerate(zip(docs_rows, starts, ids))
    ]
    assert [token_store._ranges(200, n, t) for n, t in ((0, 0), (1, 1), (5 * size, 0), (0, 256 * 9 * size), (10**9, 0))] == [1, 1, 5, 9, 200]


def test_store_finds_damage(spark, odd):
    path = new_dir(spark, "test-store")
    token_store.write(odd, path, public_tokenizers.path("word_bpe_49k.json"))
    chunks = stash(token_store.chunks(spark, path), "copy")
    broken = chunks.withColumn("data", F.when(F.col("digest") == chunks.agg(F.min("digest")).first()[0], F.lit(b"\1\0")).otherwise(F.col("data")))
    broken.write.mode("overwrite").parquet(f"{path}/parts/part=chunks")
    with pytest.raises(Exception, match="does not have its digest"):
        token_store.read_sums(spark, path).collect()
    recipes = stash(spark.read.parquet(f"{path}/recipes"), "copy")
    recipes.withColumn("start", F.col("start") + (F.col("i") == 3).cast("int")).write.mode("overwrite").parquet(f"{path}/recipes")
    with pytest.raises(ValueError, match="manifest"):
        token_store.verify(spark, path)


def test_store_refuses_a_missing_chunk(spark, odd):
    path = new_dir(spark, "test-store")
    token_store.write(odd, path, public_tokenizers.path("word_bpe_49k.json"))
    chunks = stash(token_store.chunks(spark, path), "copy")
    chunks.where(F.col("digest") != chunks.agg(F.min("digest")).first()[0]).write.mode("overwrite").parquet(f"{path}/parts/part=chunks")
    with pytest.raises(Exception, match="missing"):
        token_store.read_sums(spark, path).collect()


def test_crc_tables():
    tables = token_store._crc_tables()
    r = random.Random(7)
    for _ in range(50):
        a, b = r.randbytes(r.randint(0, 900)), r.randbytes(4 * r.randint(0, token_store.MAX_IDS))
        c, t = zlib.crc32(a), tables[len(b) // 4]
        assert int(t[0, c & 255] ^ t[1, c >> 8 & 255] ^ t[2, c >> 16 & 255] ^ t[3, c >> 24]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def plain_paths(nodes, branches):
    """nodes: (tree, node, parent, score)."""
    out = {}
    for tree in {n[0] for n in nodes}:
        mine = {n[1]: n for n in nodes if n[0] == tree}
        parents = {n[2] for n in mine.values()}
        paths = []
        for leaf in mine:
            if leaf in parents:
                continue
            path, at = [], leaf
            while at in mine and at not in path:
                path.append(at)
                at = mine[at][2]
            if at in path:
                continue
            scores = [mine[x][3] or 0.0 for x in path]
            paths.append((-sum(scores) / len(scores), -len(path), leaf, path[::-1]))
        for rank, x in enumerate(sorted(paths)[:branches], 1):
            out[tree, x[2]] = (rank, x[3])
    return out


@pytest.mark.parametrize("branches", [1, 3])
def test_tree_paths(spark, branches):
    r = random.Random(4)
    nodes = [(t, n, r.randrange(n) if n and r.random() < 0.95 else None, r.choice([None, 0.25, 0.5, 1.0, 2.0])) for t in range(12) for n in range(r.randint(1, 25))]
    nodes += [(50, n, n - 1 if n else None, 1.0) for n in range(70)] + [(60, 0, 1, 1.0), (60, 1, 0, 1.0), (61, 5, 99, 1.0), (62, 1, None, 0.0)]
    got = {}
    for x in chat.tree_paths(spark.createDataFrame(nodes, "tree_id long, node_id long, parent_id long, score double"), branches).collect():
        got.setdefault((x.tree_id, x.leaf_id), (x["rank"], []))[1].append((x.depth, x.node_id))
    got = {k: (rank, [n for _, n in sorted(p)]) for k, (rank, p) in got.items()}
    assert got == plain_paths(nodes, branches)


def test_escapes(spark):
    r = random.Random(5)
    texts = ["".join(r.choice(["<", "|", "\\", "<|im_end|>", "<|im_start|>", "<|im_sep|>", "a", "\n", "é", "😀"]) for _ in range(r.randint(0, 12))) for _ in range(500)]
    rows = [(i, k, r.choice(["user", "assistant", "sys\ntem<|", ""]), t) for i, t in enumerate(texts) for k in range(2)]
    made = chat.format_trees(chat.conversation_nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    for x in chat.parse(made).collect():
        mine = sorted((y for y in rows if y[0] == x.conv_id), key=lambda y: (y[1], y[2], y[3]))
        assert [(t.role, t.text) for t in x.turns] == [(y[2], y[3]) for y in mine]
        assert x.loss_text == "".join(y[3] for y in mine if y[2] == "assistant")


def test_chat_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, leaf_id int, depth string"
    rows = [(1, 0, "user", None, 1, "d"), (1, None, None, "first", 1, "d"), (1, 1, "assistant", "x", 1, "d"), (1, 1, "assistant", "x", 1, "d"), (None, 0, "user", "lost", 1, "d"), (2, 5, "assistant", "", 1, "d")]
    got = {r.conv_id: r for r in chat.report(spark.createDataFrame(rows, schema)).collect()}
    said = "\nfirst\n" + "user\n\n" + "assistant\nx\n" * 2
    assert set(got) == {1, 2} and got[1].n_turns == 4 and got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[1].loss_chars == 2 and got[2].loss_chars == 0 and got[2].loss_sha256 == brute.sha("")
    assert chat.report(spark.createDataFrame([], schema)).collect() == []


def test_pipeline_stages(spark, odd, untidy, tmp_path):
    benchmark = [(1, " ".join((odd.where("doc_id = 12").first().text or "a b c d e f g h i j").split()[:12]))]
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    columns = untidy.columns  # with names that operators use themselves
    given = stash(untidy, "docs")
    docs, seen = given, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()} if "text" in docs.columns else {}
        docs = stash(stage(spark, docs, str(tmp_path)), name)
        if name != "packing":
            assert docs.columns == columns
        seen[name] = before, docs.collect()
    before, after = seen["quality_rules"]
    failed = {i for i, r in before.items() if brute.quality(r.text)[5]}
    assert not {r.doc_id for r in after} & (failed - {11}) and len(after) > 20 and None not in {r.doc_id for r in after}
    before, after = seen["near_duplicates"]
    groups = plain_components({i: plain_fingerprint(r.text) for i, r in before.items()})
    left = set(groups.values())
    assert {r.doc_id for r in after} == set(plain_groups([(i, r.text) for i, r in before.items() if i in left]).values())
    before, after = seen["benchmark_decontamination"]
    gram = [w.lower() for w in benchmark[0][1].split()]
    assert len(after) <= len(before) and all(" ".join(gram[:10]) not in " ".join((r.text or "").lower().split()) for r in after)
    before, after = seen["secret_scans"]
    assert {r.doc_id for r in after} == set(before)
    assert all("password=abc" not in r.text and r.n_chars == (len(r.text) if "<secret>" in r.text else before[r.doc_id].n_chars) for r in after)
    before, after = seen["packing"]
    want = {i: brute.quality(r.text)[0] + 1 for i, r in before.items()}
    assert check_packing(after, packing.N_BUCKETS, packing.TOKEN_BUDGET) == want


def test_pipeline_of_nothing(spark, nothing, tmp_path):
    """Empty tables, with columns whose names operators use themselves."""
    nothing.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_run(spark, odd, tmp_path):
    odd.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "not in any text at all, is it really so")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 20

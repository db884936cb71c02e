"""What is shuffled and what stays on disk."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import common
from palimpsest.llm.common import settings_of


def shuffled(spark):
    """Bytes of shuffle files that the session has written so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    found = context.statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def long_texts(n, words, chars, seed=4):
    r = random.Random(seed)
    return [" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=chars)) for _ in range(words)) for _ in range(n)]


def stage_of(spark, name, rows, tmp_path, small):
    """The result of a stage by id, and the bytes it shuffled; tables above ``small`` count as large."""
    docs = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(docs)
    with settings_of(spark, {"spark.sql.autoBroadcastJoinThreshold": small}):
        before = shuffled(spark)
        got = dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(docs), str(tmp_path)).collect()
        return {r.doc_id: r.text for r in got}, shuffled(spark) - before


def test_secret_scans_shuffle_what_they_change(spark, tmp_path):
    rows = list(enumerate(long_texts(200, 2500, 7)))  # too short for identifiers
    secret = "password=abcdef0123456789"
    rows += [(200 + i, f"{t} {secret} {t}") for i, (_, t) in enumerate(rows[:5])]
    got, moved = stage_of(spark, "secret_scans", rows, tmp_path, "-1")
    assert got.keys() == dict(rows).keys() and all(got[i] == t for i, t in rows[:200])
    assert all(secret[9:] not in got[i] and "<secret>" in got[i] for i, _ in rows[200:])
    assert moved < sum(len(t) for _, t in rows) // 4


def test_near_duplicates_shuffle_no_texts_that_stay(spark, tmp_path):
    texts = long_texts(2000, 6, 2000)
    rows = list(enumerate(texts)) + [(2000 + i, t) for i, t in enumerate(texts[:9])]
    got, moved = stage_of(spark, "near_duplicates", rows, tmp_path, "16k")
    assert got == dict(rows[:2000])
    assert moved < sum(len(t) for _, t in rows) // 2


@pytest.mark.parametrize("most", [common._MOST_BLOCKS, 1])
def test_within_and_without(spark, monkeypatch, most):
    monkeypatch.setattr(common, "_MOST_BLOCKS", most)
    r = random.Random(9)
    keys = r.sample(range(-(10**12), 10**12), 30_000) + [0, -1, 2**63 - 1, -(2**63)]
    chosen = set(keys[:7000] + keys[-4:] + [5, 6])
    docs = spark.createDataFrame([(k, i) for i, k in enumerate([*keys, keys[0], None, None])], "k long, `a.b` int").repartition(3).cache()
    ids = spark.createDataFrame([(k,) for k in [*chosen, keys[1], None]], "k long")
    rows = docs.collect()
    plain = lambda df: sorted(tuple(x) for x in df.select(F.coalesce("k", F.lit(3)), "`a.b`").collect())
    want = lambda keep: sorted((3 if k is None else k, i) for k, i in rows if keep(k))
    assert plain(common.within(docs, "k", ids)) == want(lambda k: k in chosen)
    assert plain(common.without(docs, "k", ids)) == want(lambda k: k not in chosen)
    assert plain(common.without(docs, "k", ids.where("false"))) == want(lambda k: True)
    assert plain(common.within(docs, "k", ids.where("false"))) == []
    out, rest = common.split(docs, F.col("k"), ids)
    assert out.count() + rest.count() == len(rows) and (most == 1 or rest.count() < 7004 + 23_000 // 8 + 2)


def soon(spark, gone):
    """Whether ``gone()`` holds after some releases: Spark keeps the last plans for part of a second."""
    for _ in range(40):
        common.release(spark)
        if gone():
            return True
        time.sleep(0.25)
    return False


def test_stashed_tables_go_when_nothing_reads_them(spark):
    held = common.stash(spark.range(50), "held")
    path = held.inputFiles()[0].removeprefix("file:").replace("///", "/").rsplit("/", 1)[0]
    derived = held.join(held.select((F.col("id") + 1).alias("id")), "id").groupBy().count()
    derived.collect()
    del held
    assert not soon(spark, lambda: not os.path.exists(path)) and derived.first()[0] == 49
    del derived
    assert soon(spark, lambda: not os.path.exists(path))


def test_release_returns_native_memory_of_the_driver(spark):
    jvm = spark.sparkContext._jvm
    held = jvm.org.apache.spark.unsafe.Platform
    blocks = [held.allocateMemory(8000) for _ in range(15_000)]  # 120 MB
    for at in blocks:
        held.setMemory(at, 1, 8000)

    def resident():
        """MB of the mappings that the blocks are in, which are not the collector's."""
        total, inside = 0, False
        with open(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps") as f:
            for line in f:
                if "-" in (span := line.split()[0]):
                    low, high = (int(x, 16) for x in span.split("-"))
                    inside = any(low <= at < high for at in blocks[::100])
                elif inside and span == "Rss:":
                    total += int(line.split()[1]) // 1024
        return total

    for at in blocks[:-1]:  # the last one keeps the C library from shrinking its pool
        held.freeMemory(at)
    before = resident()
    common.release(spark)
    after = resident()
    held.freeMemory(blocks[-1])
    assert before > 100 and after < before - 60

"""Outliers by repeated lines and words."""

import random

from palimpsest.llm import quality


def pages(n=300, lang="en", seed=7):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(500)]
    line = lambda k: " ".join(r.choice(words) for _ in range(k))
    return [(i, [line(r.randint(4, 14)) for _ in range(r.randint(6, 40))]) for i in range(n)], line


def judged(spark, rows, lang="en"):
    given = spark.createDataFrame([(i, "\n".join(x), lang, "s") for i, x in rows], "doc_id long, text string, lang string, source string")
    return {r.doc_id: r for r in quality.verdicts(given).collect()}


def test_repeats_alone_reject(spark):
    rows, line = pages()
    for i in (1000, 1001):  # pages whose short lines come twice, in no order
        lines = [line(5) for _ in range(20)] * 2
        random.Random(i).shuffle(lines)
        rows.append((i, lines))
    phrase = line(29)
    rows.append((1002, [line(10) for _ in range(14)] + [line(3) + " " + phrase + " " + line(3), line(1) + " " + phrase]))
    one = [line(8) for _ in range(12)]
    rows.append((2000, one + [one[3]]))  # one repeated line
    few = [line(5) for _ in range(5)]
    rows.append((2001, few + [few[0]]))
    got = judged(spark, rows)
    assert not any(got[i].base_failed for i in (1000, 1001, 1002, 2000, 2001))
    assert not got[1000].kept and not got[1001].kept and not got[1002].kept
    assert got[2000].kept and got[2001].kept
    assert sum(got[i].kept for i in range(300)) >= 297

import random

import pytest

import brute  # noqa: F401

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "fp long, bucket int, kind int, component_id string, `start` string, part int, r string, x struct<a:int>"
)


def odd_rows(seed=5, n=160):
    """Texts with copies, near copies, shared passages, empty, null and long ones."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 7))) for _ in range(60)]
    words += ["Word,", "The", "a.b", "x" * 40, "12", "password=abcdef0123456789", "me@mail.example.com", "+1 (222) 555-0101"]
    passages = [" ".join(r.choice(words) for _ in range(r.randint(8, 70))) for _ in range(10)]
    texts = []
    for i in range(n):
        parts = [r.choice(passages) if r.random() < 0.4 else " ".join(r.choice(words) for _ in range(r.randint(0, 50))) for _ in range(r.randint(0, 4))]
        texts.append(r.choice(["\n", " ", "\t\n", "\n\n"]).join(parts))
        if texts and r.random() < 0.2:
            texts[-1] = r.choice(texts)
        if r.random() < 0.1:
            texts[-1] = texts[-1].replace("The", "the").replace(" ", "  ", 1)
    texts[3], texts[4], texts[5], texts[6] = None, "", " \t\n", "é"
    texts[7] = " ".join(r.choice(words) for _ in range(20_000))
    texts[8] = "same " * 3000
    return [(i, t, r.choice(["en", "fr", None]), r.choice(["s1", "s2", None]), len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs_rows():
    return odd_rows()


def wide(spark, rows):
    """Rows as documents with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(*x, 1, 2, 3, "c", "s", 4, "r", (5,)) for x in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def odd(spark, docs_rows):
    return wide(spark, docs_rows).cache()


@pytest.fixture(scope="session")
def untidy(spark, docs_rows):
    """The same, with a null id, a row given twice, and an id with two texts."""
    more = [(None, "lost", "en", "s1", 4), docs_rows[10], (11, "", "en", "s1", 0)]
    return wide(spark, docs_rows + more).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return wide(spark, []).cache()

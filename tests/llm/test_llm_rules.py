"""Decontamination, quality rules, secrets, personal data, against brute force."""

import random

import brute
import numpy as np
import pytest
from palimpsest.llm import decontaminate, pii, quality, secret_scan
from pyspark.sql import functions as F


UPPER = str.maketrans({chr(c): chr(c - 32) for c in range(97, 123)})


def words_of(text):
    return decontaminate.words(text)


def plain_hits(rows, items):
    grams = []
    for item, text in items:
        w = words_of(text)
        if w and item is not None:
            n = min(10, len(w))
            grams += [(str(item), tuple(w[i : i + n])) for i in range(len(w) - n + 1)]
    out = {}
    for doc, text, *_ in rows:
        w = words_of(text)
        hit, names = set(), set()
        for item, g in grams:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    names.add(item)
        out[doc] = (len(w), len(hit), len(names), brute.sha(",".join(sorted(names))), bool(hit))
    return out


@pytest.fixture(scope="module")
def benchmark_rows(docs_rows):
    r = random.Random(3)
    w = docs_rows[20][1].split() if docs_rows[20][1] else []
    items = [(i, " ".join(str(docs_rows[k][1] or "").split()[a : a + 14]).translate(UPPER)) for i, (k, a) in enumerate([(9, 0), (12, 3), (30, 5), (40, 0), (55, 2)])]
    return items + [(10, "Word The"), (2, " ".join(w[:11])), (11, None), (12, ""), (None, "a b c"), (10, "Word The"), (13, "never seen " * 9), (14, str(r.random()))]


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_hits(spark, odd, untidy, nothing, docs_rows, benchmark_rows, most):
    bench = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    want = plain_hits(docs_rows, benchmark_rows)
    assert sum(x[1] > 0 for x in want.values()) > 3
    for docs in (odd, untidy):
        got = decontaminate.report(docs, bench, max_windows=most).collect()
        assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    assert decontaminate.report(nothing, bench, max_windows=most).collect() == []
    empty = decontaminate.report(odd, bench.where("false")).collect()
    assert not any(r.contaminated for r in empty) and len(empty) == len(want)


def test_removal(spark, untidy, docs_rows, benchmark_rows):
    bench = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    want = plain_hits(docs_rows, benchmark_rows)
    for most in (1_000_000, 3):
        kept = decontaminate.remove_documents(untidy, bench, max_windows=most)
        assert kept.columns == untidy.columns
        ids = [r.doc_id for r in kept.collect()]
        assert set(ids) - {None, 11} == {i for i, x in want.items() if not x[4]} - {11} and None in ids
    cut = decontaminate.remove_spans(untidy, bench, max_windows=20)
    for r in cut.where("doc_id <> 11").collect():
        n, hit, *_ = want[r.doc_id]
        assert len(words_of(r.text)) == n - hit


def test_quality_base(odd, untidy, nothing, docs_rows):
    want = {x[0]: brute.quality(x[1]) for x in docs_rows}
    got = quality.verdicts(odd).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got} == want
    assert not any(r.kept for r in got if r.base_failed) and len(got) == len(want)
    assert quality.verdicts(untidy).count() == len(want) + 3
    assert quality.verdicts(nothing).collect() == [] and quality.keep_good(nothing).collect() == []


def plain_mcd(groups, floors):
    """The same fit with numpy: ``{(lang, source): statistics}`` to squared distances."""
    p = len(floors)
    scale = quality.ALPHA / quality.chi2_cdf(quality.chi2_quantile(quality.ALPHA, p), p + 2)
    langs = {g: [h for h in groups if h[0] == g[0]] for g in groups}
    x = {g: np.asarray(v, float) / 1000 for g, v in groups.items()}
    stack = lambda names: np.concatenate([x[g] for g in names])

    def distances(g, fit):
        z = x[g] - fit[0]
        return np.einsum("ij,jk,ik->i", z, np.linalg.inv(fit[1]), z)

    def moments(v, w):
        return np.array([w.sum(), *(w[:, None] * v).sum(axis=0), *np.einsum("i,ij,ik->jk", w, v, v).ravel()])

    def fits(sums, k):
        """From each group's moments, with the parents' added, to (mean, scatter)."""
        every, out = sum(sums.values()), {}
        for g in sums:
            parent = sum(sums[h] for h in langs[g])
            parent = parent + quality.PRIOR * every / every[0]
            m = sums[g] + quality.PRIOR * parent / parent[0]
            mean = m[1 : p + 1] / m[0]
            out[g] = mean, (m[p + 1 :].reshape(p, p) / m[0] - np.outer(mean, mean)) * k + np.diag(floors**2)
        return out

    def step(fit):
        sums = {}
        for g in x:
            bins = np.floor(np.log2(distances(g, fit[g]) + 2.0**-20) * quality.BINS)
            names, at, n = np.unique(bins, return_inverse=True, return_counts=True)
            weight = np.clip((len(bins) * quality.ALPHA - (np.cumsum(n) - n)) / n, 0, 1)
            sums[g] = moments(x[g], weight[at])
        return fits(sums, scale)

    def det(fit):
        return round(np.log(np.diag(np.linalg.cholesky(fit[1]))).sum(), 6)

    def median(v):
        q = np.percentile(v, [25, 50, 75], axis=0)
        return q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2 + floors**2)

    whole = lambda names: moments(stack(names), np.ones(sum(len(x[h]) for h in names)))
    starts = [
        {g: median(x[g]) for g in x},
        {g: median(stack(langs[g])) for g in x},
        {g: median(stack(x)) for g in x},
        fits({g: whole([g]) for g in x}, 1.0),
    ]
    lang_sums = {g: whole(langs[g]) for g in x}
    # Their parents add up the same way: the moments of a language once for each of its groups.
    starts.append(fits(lang_sums, 1.0))
    starts = [step(step(s)) for s in starts]
    fit = {g: min((s[g] for s in starts), key=det) for g in x}
    for _ in range(quality.MAX_STEPS - 2):
        now = step(fit)
        done = all(abs(det(now[g]) - det(fit[g])) <= quality.TOLERANCE for g in x)
        fit = now
        if done:
            break
    return {g: distances(g, fit[g]) for g in x}


def test_mcd_matches_numpy_and_finds_outliers(spark):
    """Groups of 400, 90, 7 and 1 rows in two languages, some rows far off."""
    r = np.random.default_rng(1)
    p = len(quality.FEATURES)
    shape = r.normal(size=(p, p)) * 700
    groups = {}
    for name, n, off in ((("en", "s"), 400, 60), (("en", "t"), 90, 9), (("fr", "s"), 7, 1), (("fr", "u"), 1, 0)):
        mixed = r.normal(size=(n, p)) @ shape
        mixed[:off] += 9000
        groups[name] = np.round(mixed).astype(int)
    rows = [(*g, i % quality.SALTS, i, *map(int, v)) for g, x in groups.items() for i, v in enumerate(x)]
    schema = "lang string, source string, salt int, doc long, " + ", ".join(f"x_{i} long" for i in range(p))
    df = spark.createDataFrame(rows, schema)
    got = {(v.lang, v.source, v.doc): v.d2 for v in quality._distance(df, quality.mcd(df)).collect()}
    want = plain_mcd(groups, np.array([f for _, f in quality.FEATURES.values()]))
    limit = quality.chi2_quantile(1 - quality.TAIL, p)
    for g, off in ((("en", "s"), 60), (("en", "t"), 9), (("fr", "s"), 1), (("fr", "u"), 0)):
        ours = np.array([got[(*g, i)] for i in range(len(groups[g]))])
        assert np.allclose(ours, want[g], rtol=1e-4)
        assert (ours[:off] > limit).all() and (ours[off:] <= limit).mean() > 0.95


def test_chi2():
    assert abs(quality.chi2_quantile(0.95, 1) - 3.841459) < 1e-5 and abs(quality.chi2_quantile(0.99, 5) - 15.08627) < 1e-4


def secret_texts():
    r = random.Random(6)
    parts = ["password", "Secret:", "TOKEN =", "api_key", "apikey='", '"', "=", " ", ":", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef", "deadbeef", "é", "\n", "x", "token: token: abcdefghijklmnop", "ſecret=aaaaaaaaaaaaaaaa", "😀"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(400)]


def test_secrets(spark, odd, untidy, nothing, docs_rows):
    rows = [(i, t) for i, t in enumerate(secret_texts())] + [(i + 1000, x[1]) for i, x in enumerate(docs_rows)] + [(5000, None)]
    got = {r.doc_id: r for r in secret_scan.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == brute.secret_row(t), t
        spans = [x.split(":") for x in r.spans.split(",") if x]
        base = [f"{k}:{a}:{b}" for k, a, b in spans if k != "random"]
        assert brute.sha(",".join(base)) == r.base_sha256
        fixed = brute.secrets(t)
        for k, a, b in spans:
            if k == "random":
                assert all(int(b) <= s or e <= int(a) for s, _, e in fixed)
    assert secret_scan.report(untidy).count() == len(docs_rows)
    assert secret_scan.report(nothing).collect() == []


def random_tokens(r, n):
    import string

    return ["".join(r.choice(string.ascii_letters + string.digits) for _ in range(r.randint(20, 40))) for _ in range(n)]


def test_markov_models_on_held_out_tokens(spark):
    r = random.Random(11)
    syllables = ["get", "user", "name", "list", "from", "config", "value", "table", "index", "window", "offset", "merge"]
    names = lambda n: ["_".join(r.choice(syllables) for _ in range(r.randint(3, 6))) for _ in range(n)]
    train = [(i, " ".join(names(20))) for i in range(60)] + [(100 + i, f"token={t}") for i, t in enumerate(random_tokens(r, 150))]
    held = [(1000 + i, f"call {t} now") for i, t in enumerate(random_tokens(r, 60))] + [(2000 + i, f"call {t} now") for i, t in enumerate(names(60))]
    got = {x.doc_id: x.n_random for x in secret_scan.report(spark.createDataFrame(train + held, "doc_id long, text string")).collect()}
    assert sum(got[1000 + i] == 1 for i in range(60)) >= 57
    assert all(got[2000 + i] == 0 for i in range(60))


def test_redaction(spark, untidy):
    rows = [(1, "a password=abcdef0123456789 b", 30, "k"), (2, None, 0, "k"), (3, "clean", 5, "k"), (4, "token: 0123456789abcdef0123 token: 0123456789abcdef0123", 50, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, start string")
    got = {r.doc_id: r for r in secret_scan.redact(docs).collect()}
    assert got[1].text == "a <secret> b" and got[1].n_chars == 12 and got[2].text is None and got[3].text == "clean" and got[3].n_chars == 5
    assert got[4].text == "<secret> <secret>" and got[4].start == "k"
    out = secret_scan.redact(untidy)
    assert out.columns == untidy.columns and out.count() == untidy.count()
    assert out.where(F.col("text").contains("password=abc")).count() == 0


def pii_texts():
    r = random.Random(13)
    parts = list("ab1 2.+-@()%") + ["me@x.org", "10.0.0.255", "300.1.1.1", "4111 1111 1111 1111", "+44 20 7946 0958", "joe [at] site [dot] com", "call 555 0123 4567", "page 1234567", "é", "\n"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 50))) for _ in range(1500)] + ["9" * 6000 + ".", "@" * 500, "a" * 9000 + "@", "1." * 4000, None, ""]


def test_pii(spark, odd, untidy, nothing, docs_rows):
    rows = list(enumerate(pii_texts()))
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == brute.pii(t), t
        base = [x for x in r.spans.split(",") if x and not x.startswith("other")]
        assert brute.sha(",".join(base)) == r.base_sha256
    assert pii.report(untidy).count() == len(docs_rows) and pii.report(nothing).collect() == []


def test_labelers_and_classifier():
    """EM finds which labelers to trust, and the classifier agrees with the hidden classes."""
    r = np.random.default_rng(5)
    truth = r.random(4000) < 0.4
    right = [0.95, 0.9, 0.6, 0.85, 0.5]
    votes = np.stack([np.where(r.random(4000) < q, truth, ~truth) * 2 for q in right], axis=1)
    patterns = (votes * 3 ** np.arange(4, -1, -1)).sum(axis=1)
    unique, counts = np.unique(patterns, return_counts=True)
    table, prior, post = pii.reliabilities(unique, counts.astype(float))
    found = (table[:, 1, 2] * prior + table[:, 0, 0] * (1 - prior)).round(2)
    assert np.abs(found - right).max() < 0.06 and abs(prior - 0.4) < 0.05
    features = truth * 1 + (r.random(4000) < 0.5) * 2
    soft = post[np.searchsorted(unique, patterns)]
    w = pii.train_classifier(features, np.ones(4000), soft)
    held = np.array([0, 1, 2, 3])
    assert ((pii._design(held) @ w > 0) == (held & 1 == 1)).all()
